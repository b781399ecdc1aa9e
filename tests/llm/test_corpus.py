"""Operators that compare texts with each other, against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from textdist.llm import backoff, bwt, components, decontam, jaccard, suffixes

WORD = r"[^\x20\x09-\x0D]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# suffix arrays

def removed(rows, window):
    seen, out = set(), {}
    for k, text in sorted(set(rows)):
        b = (text or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if b[i : i + window] in seen:
                mark[i : i + window] = b"\1" * window
            seen.add(b[i : i + window])
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out[k] = (len(b), sum(mark), sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"group": 2}])
def test_suffixes(messy, messy_rows, options):
    want = removed([r for r in messy_rows if r[0] is not None], 40)
    rows = suffixes.remove(messy, window=40, levels=(10, 20), **options).drop("kept").collect()
    assert len(rows) == len(messy_rows)
    for r in rows:
        got = (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        if r.doc_id is None:
            assert got[1:3] == (0, 0)
        else:
            assert got == want[r.doc_id]
    assert sum(v[1] for v in want.values()) > 1000


def test_suffixes_empty(nothing):
    assert suffixes.remove(nothing).count() == 0


def test_transform_of_a_collection():
    rng = random.Random(4)
    for width, cap in itertools.product((1, 2), (3, 5)):
        for _ in range(40):
            strings = [bytes(rng.choice(b"ab\0") for _ in range(width * rng.randint(0, 12))) for _ in range(rng.randint(1, 9))]
            data = np.frombuffer(b"".join(strings), np.uint8)
            offs = np.r_[0, np.cumsum([len(s) for s in strings])]
            symbols, text, ends, lengths = bwt.phases(data, offs, width)
            whole = ends == offs[1:][text]
            keys, common, before, place = bwt.build(symbols, ends[whole], lengths[whole], cap, width)
            order = [None] * len(keys)
            for i, s in enumerate(strings):
                at = int(place[i])
                for o in range(0, len(s) + 1, width):
                    order[at] = s[o:]
                    assert before[at] == (int.from_bytes(s[o - width : o], "big") if o else 0)
                    at = int(keys[at] & bwt.TAIL)
            assert order == sorted(order)
            for a, b, c in zip(order, order[1:], common[1:]):
                k = 0
                while k < min(len(a), len(b)) and a[k : k + width] == b[k : k + width]:
                    k += width
                assert c == min(k // width, cap)


def test_minima():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 250, 5000).astype(np.uint8)
    lo = rng.integers(0, 5000, 3000)
    hi = np.minimum(lo + rng.integers(0, 4000, 3000), 4999)
    assert bwt.Minima(values).of(lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi)]


# Jaccard

def shingles(text, size=5):
    w = re.findall(WORD, low(text))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def test_jaccard(messy, messy_rows):
    sets = {k: shingles(t) for k, t in messy_rows if k is not None}
    part = {k: k for k in sets}

    def find(k):
        while part[k] != k:
            k = part[k]
        return k

    links = 0
    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
            links += 1
            x, y = sorted((find(a), find(b)))
            part[y] = x
    assert links > 5
    rows = jaccard.classes(messy).collect()
    assert len(rows) == len(messy_rows)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))


def test_jaccard_small_chunks_and_frequent_shingles(spark, monkeypatch):
    """A group of near copies over several chunks, a passage in all texts, and only the second half of the join."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocab) for _ in range(12))
    base = [rng.choice(vocab) for _ in range(120)]
    rows = []
    for k in range(40):
        own = list(base)
        own[rng.randrange(120)] = "zz%d" % k
        rows.append((k, " ".join(own) + " " + passage))
    rows += [(k, passage + " " + " ".join(rng.choice(vocab) for _ in range(60))) for k in range(40, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 3)
    want = {k: (0 if k < 40 else k) for k, _ in rows}
    assert {r.doc_id: r.component_id for r in jaccard.classes(df).collect()} == want
    near = jaccard.components
    monkeypatch.setattr(jaccard, "MINIMA", 0)  # no leaders: shingle groups find every link
    assert {r.doc_id: r.component_id for r in jaccard.classes(df).collect()} == want and near is components.components


def test_jaccard_passage_shared_by_chance(spark, monkeypatch):
    """Texts that share a passage of five words are not brought together as whole sets; those that link are."""
    words = lambda k: [f"p{k}_{i}" for i in range(5)] + [f"v{k}_{i}" for i in range(100)] + [f"p{k + 1}_{i}" for i in range(5)]
    rows = [(k, " ".join(words(k))) for k in range(60)]
    rows.append((60, rows[3][1] + " zz"))
    sent, links = [], jaccard._links

    def counted(docs, pairs, *rest):
        pairs = pairs.persist()
        sent.append({tuple(r) for r in pairs.collect()})
        return links(docs, pairs, *rest)

    monkeypatch.setattr(jaccard, "_links", counted)
    monkeypatch.setattr(jaccard, "MINIMA", 0)
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{k: k for k in range(60)}, 60: 3}
    assert sent[-1] == {(3, 60)}


def test_jaccard_marks_lose_no_link(spark):
    """Rows of one id with different texts: a pair stays if any of them may link; long texts have marks that repeat."""
    long = [f"w{i}" for i in range(90_000)]
    rows = [(1, " ".join(long)), (1, "a b c d e f g"), (2, " ".join(long[:-9000])), (3, "a b c d e f g h"), (4, ""), (5, " ".join(long[:30_000])), (6, None)]
    docs = spark.createDataFrame(rows, "_k long, _t string").repartition(3)
    pairs = spark.createDataFrame([(1, b) for b in range(2, 7)], "a long, b long")
    assert {tuple(r) for r in jaccard._possible(docs, pairs, 5, 75, 100).collect()} == {(1, 2), (1, 3)}


def test_jaccard_star_of_copies(spark, monkeypatch):
    """Copies that link with their original, whose id is the largest, and not with each other."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(400)]
    rows = [(90, " ".join(base))]
    for k in range(40):
        own = list(base)
        for j in rng.sample(range(0, 400, 8), 9):
            own[j] = f"z{k}_{j}"
        rows.append((k, " ".join(own)))
    monkeypatch.setattr(jaccard, "CHUNK", 6)
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert set(got.values()) == {0}


def test_jaccard_copies_in_descending_id_order(spark, monkeypatch):
    """Two groups of exact copies that link, the least id of each last in its slice, and only the second half of the join."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    other = list(base)
    other[rng.randrange(50, 150)] = "zz"
    one, two, alone = " ".join(base), " ".join(other), " ".join(f"v{i}" for i in range(60))
    rows = [(k, one if k % 2 else two) for k in range(20, 0, -1)] + [(30, alone), (25, alone), (None, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(jaccard, "MINIMA", 0)
    got = {r.doc_id: r.component_id for r in jaccard.classes(df).collect()}
    assert got == {**{k: 1 for k in range(1, 21)}, 30: 25, 25: 25, None: None}


def test_trie_finds_the_links_of_all_pairs():
    rng = random.Random(6)
    for _ in range(40):
        pool = [np.uint64(x) for x in rng.sample(range(1 << 40), 40)]
        sets = [np.unique(np.array(rng.sample(pool, rng.randint(1, 20)), np.uint64)) for _ in range(14)]
        sets += [np.unique(np.r_[s, rng.sample(pool, 1)]) for s in sets[:8]]
        sets = list({s.tobytes(): s for s in sets}.values())
        got = jaccard.joined(list(range(len(sets))), sets, 75, 100)
        part = list(range(len(sets)))

        def root(i, part=part):
            while part[i] != i:
                i = part[i]
            return i

        for a, b in itertools.combinations(range(len(sets)), 2):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                part[max(root(a), root(b))] = min(root(a), root(b))
        mine = list(range(len(sets)))
        for a, b in got:
            x, y = sorted((next(i for i in [a] if True), b))
            x, y = (mine[x], mine[y])
            mine = [min(x, y) if m in (x, y) else m for m in mine]
        assert [[root(i) == root(j) for j in range(len(sets))] for i in range(len(sets))] == [[a == b for b in mine] for a in mine]


def test_jaccard_empty(nothing):
    assert jaccard.classes(nothing).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    part = {v: {v} for x in links for v in x}
    for a, b in links:
        if part[a] is not part[b]:
            part[a] |= part[b]
            for v in part[b]:
                part[v] = part[a]
    got = {r.v: r.c for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: min(part[v]) for a, b in links if a != b for v in (a, b)}


# decontamination

def contaminated(docs, items, window=13):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = collections.defaultdict(set)
    for k, t in items:
        w = word(t)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[i : i + window])].add(k)
    out = []
    for k, t in docs:
        w, hit, found = word(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own is not None:
                    hit |= set(range(i, i + size))
                    found |= own
        names = sorted(str(x) for x in found if x is not None)
        out.append((k, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, messy, messy_rows, limit):
    rng = random.Random(8)
    docs = [t for _, t in messy_rows if t and len(t.split()) > 40]
    cut = lambda t, n: " ".join(t.split()[5 : 5 + n]).upper()
    items = [(i, cut(rng.choice(docs), rng.choice([3, 8, 12, 13, 14, 30]))) for i in range(14)] + [(20, None), (21, ""), (22, "long long long"), (None, cut(docs[0], 15)), (3, cut(docs[1], 20))]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, f long")
    rows = decontam.contamination(messy, bench, broadcast_rows=limit).drop("_x").collect()
    want = contaminated(messy_rows, items)
    assert collections.Counter(map(tuple, rows)) == collections.Counter(want)
    assert sum(x[-1] for x in want) > 3


def test_decontamination_empty(spark, messy, messy_rows, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(messy, bench).where("n_hit > 0").count() == 0
    assert decontam.contamination(nothing, bench).count() == 0


# backoff

@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(messy, messy_rows, order, monkeypatch):
    monkeypatch.setattr(backoff, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(backoff, "ENTRIES_PER_BUCKET", 20_000)
    docs = [re.findall(WORD, low(t)) for _, t in messy_rows]
    count = lambda w: collections.Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total, size, want = collections.Counter(), sum(map(len, docs)), collections.Counter()
    for w in docs:
        total.update(count(w))
    for (k, _), w in zip(messy_rows, docs):
        own, n, log, off, unseen = count(w), max(size - len(w), 1), 0.0, 0, 0
        c = lambda g, own=own: total[g] - own[g]
        for i in range(len(w)):
            longest = min(i + 1, order)
            for m in range(longest, -1, -1):
                g = tuple(w[i - m + 1 : i + 1])
                if m == 0 or c(g) > 0:
                    break
            log += (longest - m) * math.log(0.4) + (math.log(c(g) / (c(g[:-1]) if m > 1 else n)) if m else -math.log(n))
            off, unseen = off + (m < longest), unseen + (m == 0)
        want[k, len(w), round(log, 3), off, unseen] += 1
    rows = backoff.score(messy, order=order).collect()
    assert collections.Counter((r.doc_id, r.n_words, round(r.log_score, 3), r.n_backed_off, r.n_unseen) for r in rows) == want
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in rows)


def test_backoff_query_of_order_3(spark, tmp_path):
    """A word is scored by its trigram where another document has it, and backs off twice where none has its bigram."""
    from textdist.llm import queries

    rows = [(1, "a b c"), (2, "a b c"), (3, "a b d"), (4, "x y c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op9_stupid_backoff_order3"](spark, str(tmp_path)).collect()}
    assert got[1].log_score == pytest.approx(math.log(2 / 9) + math.log(2 / 2) + math.log(1 / 2), abs=1e-4)
    assert (got[1].n_backed_off, got[1].n_unseen) == (0, 0)
    back = math.log(0.4)
    assert got[4].log_score == pytest.approx(-math.log(9) + back + (-math.log(9) + 2 * back) + (math.log(2 / 9) + 2 * back), abs=1e-4)
    assert (got[4].n_backed_off, got[4].n_unseen) == (3, 2)


def test_backoff_empty(nothing):
    assert backoff.score(nothing).count() == 0


def test_least_of_ranges_of_every_length():
    """Minima against plain ranges: within a block, over its edge, and over many blocks."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 255, 1000).astype(np.uint8)
    lo = np.r_[rng.integers(0, 1000, 3000), np.arange(0, 930)]
    hi = np.r_[np.minimum(lo[:3000] + rng.integers(0, 400, 3000), 999), np.arange(0, 930) + bwt.BLOCK - 1]
    hi = np.r_[hi[:3000], np.minimum(hi[3000:], 999)]
    assert bwt.Minima(values).of(lo, hi).tolist() == [int(values[a : b + 1].min()) for a, b in zip(lo, hi)]
