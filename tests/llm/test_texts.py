"""Operators on single texts against brute force, on messy rows and an empty table."""

import base64
import collections
import hashlib
import math
import random
import re

import pytest

import public_tokenizers
from textdist.llm import bpe, licences, quality, sharding

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def base_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    repeat = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat), failed)


def test_quality_base_and_measures(messy, messy_rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = quality.quality(messy, PIECES, lang="lang", min_texts=10).collect()
    assert len(rows) == len(messy_rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows), key=key)
    assert got == sorted(((k, base_of(t)) for k, t in messy_rows), key=key)
    by_id = {r.doc_id: r for r in rows}
    for k, t in messy_rows[:20]:
        ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", t) for i in model.encode(w)]
        r, c = by_id[k], collections.Counter(ids)
        bits = -sum(v / len(ids) * math.log2(v / len(ids)) for v in c.values())
        assert r.n_tokens == len(ids) and r.chars_per_token == pytest.approx(r.word_chars / len(ids))
        assert r.token_entropy == pytest.approx(bits / math.log2(min(len(ids), model.get_piece_size())))
        assert r.byte_share == pytest.approx(sum(v for i, v in c.items() if model.is_byte(i)) / len(ids))
    assert all(not r.kept for r in rows if r.base_failed) and any(r.kept for r in rows)


def test_quality_rejects_mangled_text_and_keeps_prose(spark):
    rng = random.Random(9)
    words = "the quick brown fox jumps over a lazy dog and then it runs away from green fields near town where people walk home after work".split()
    clean = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 60))) for _ in range(60)]
    mangled = " ".join(w.upper() + "%%%$$" for t in clean[:4] for w in t.split()[:30])
    rows = list(enumerate(clean)) + [(100, " ".join(f"{i}{w}" for i, w in enumerate(mangled.split())))]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()}
    assert not got[100] and sum(got[i] for i in range(60)) >= 55


def _prose(rng, n, low=40, high=200):
    words = "the quick brown fox jumps over a lazy dog and then it runs away from green fields near town where people walk home after work".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randint(low, high))) for _ in range(n)]


def _mangled(rng, n=120):
    return " ".join(rng.choice("qxzvjk") + rng.choice("qxzvjk") for _ in range(n))


@pytest.mark.parametrize("copies", [50, 200])
def test_quality_fit_counts_copies_once(spark, copies):
    """A group of copies, a third of the rows or most of them, neither narrows its band nor leaves it unjudged."""
    rng = random.Random(14)
    clean = _prose(rng, 100)
    rows = list(enumerate(clean)) + [(500, _mangled(rng))]
    alone = {r.doc_id: (r.middle, r.kept) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()}
    more = rows + [(1000 + i, clean[0]) for i in range(copies)]
    got = {r.doc_id: (r.middle, r.kept) for r in quality.quality(spark.createDataFrame(more, "doc_id long, text string"), PIECES).collect()}
    assert {k: v for k, v in got.items() if k < 1000} == alone
    assert not got[500][1] and sum(got[i][1] for i in range(100)) >= 98


def test_quality_near_copies_leave_room(spark):
    rng = random.Random(15)
    clean, base = _prose(rng, 40), _prose(rng, 1, 150, 150)[0].split()
    near = [" ".join([*base[:i], "dog", *base[i + 1 :]]) for i in range(60)]
    rows = list(enumerate(clean + near)) + [(500, _mangled(rng))]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()}
    assert not got[500] and sum(got[i] for i in range(40)) >= 38


def test_quality_small_bands_have_limits(spark):
    """A language with few texts is judged by its script's fit, a table of few texts by fixed limits."""
    rng = random.Random(16)
    few = [(i, t, "de") for i, t in enumerate(_prose(rng, 5))] + [(100, _mangled(rng), "de")]
    many = few + [(200 + i, t, "en") for i, t in enumerate(_prose(rng, 60))]
    for rows in (few, many):
        got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES, lang="lang").collect()}
        assert not got.pop(100) and all(got[i] for i in range(5))


def test_byte_bpe(messy, messy_rows, spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for k, t in messy_rows:
        ids = own.encode_ordinary(t or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[k, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in bpe.round_trip(messy, RANKS).collect()) == want
    coded = bpe.encode(messy.where("doc_id < 80").dropDuplicates(["doc_id"]), RANKS)
    texts = dict(messy_rows)
    for r in bpe.decode(coded, RANKS).collect():
        assert bytes(r.bytes).decode() == (texts[r.doc_id] or "")
    for r in coded.where("doc_id in (0, 74)").collect():
        data = texts[r.doc_id].encode()
        ends = [*r.offsets[1:], len(data)]
        assert [ranks[data[a:b]] for a, b in zip(r.offsets, ends)] == list(r.ids)


def test_pre_tokenisation_is_the_patterns(spark):
    import numpy as np
    import regex

    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("ab'stlrevmd  \n\t　1٣!?é漢_") for _ in range(rng.randint(1, 60)))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        assert bpe.token_starts(points).tolist() == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]


def test_licences(spark):
    body = "some words of prose\nReleased under the MIT License.\nmore words here and there"
    grant = licences.TEMPLATES["MIT-grant"].replace("free of charge", "free of any charge")
    rows = [(1, body), (2, None), (3, ""), (4, "MIT"), (5, f"intro\n\n{grant[:200]}\n{grant[200:]}\n\nend"), (1, body), (None, "licensed under cc by-nc 4.0")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gram string")
    got = sorted(((r.doc_id or -1, r.kind, r.unit, r.licence) for r in licences.scan(df).collect()))
    assert got == [(-1, "line", 0, "CC-BY-NC-4.0"), (1, "line", 1, "MIT"), (5, "paragraph", 1, "MIT-grant")]
    assert licences.scan(df.where("1 = 0")).count() == 0


def test_licence_probes_miss_nothing():
    """Every run of a template's words that still matches it holds a probe."""
    found = licences.probes(licences.TEMPLATES, 0.8)
    for text in licences.TEMPLATES.values():
        words = re.findall(r"[0-9a-z]+", text.lower())
        need = math.ceil((len(words) - 1) * 0.8 / 1.2)
        for a in range(len(words)):
            for b in range(a + need + 1, len(words) + 1):
                part = " ".join(words[a:b])
                assert any(p in part for p in found)


def test_sharding(messy, messy_rows, nothing, tmp_path, spark):
    rows = sharding.assign(messy, limit=2000).collect()
    assert len(rows) == len(messy_rows)
    held = collections.defaultdict(list)
    for r in rows:
        held[r.shard].append(r)
    names = sorted(held)
    assert not any(b.startswith(a) for a in names for b in names if a != b)  # prefix-free: a directory
    for name, own in held.items():
        assert {r.shard_bytes for r in own} == {sum(r.n_bytes for r in own)} and {r.depth for r in own} == {len(name)}
        assert own[0].fits or len({r.doc_id for r in own}) == 1
        if name:  # its parent had to split
            parent = [r for n, rs in held.items() if n.startswith(name[:-1]) for r in rs]
            assert sum(r.n_bytes for r in parent) > 2000 and len(parent) > 1
    assert sharding.assign(nothing).count() == 0
    docs = messy.where("doc_id < 70").dropDuplicates(["doc_id"]).select("doc_id", "text")
    where = sharding.assign(docs, limit=2000)
    sharding.write_shards(docs, where, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 70 and back.select("shard").distinct().count() == where.select("shard").distinct().count()


def test_empty_tables(nothing):
    assert quality.quality(nothing, PIECES, lang="lang").count() == 0
    assert bpe.round_trip(nothing, RANKS).count() == 0
