"""n-grams of large tables: worked in turns, and told back to the slices that hold them."""

import os
import random
from collections import Counter

import pyarrow as pa
import pytest

from textdist.operators import ngrams as N
from textdist.operators import packed as K
from textdist.operators import self_bleu as B


@pytest.fixture
def turns(monkeypatch):
    """Small tables take as many turns as large ones."""
    monkeypatch.setattr(K, "TURN_BYTES", 64)


def texts(n, seed=5, words=40):
    pick = random.Random(seed)
    return [" ".join(pick.choice("abcdefghé") + pick.choice(["", "", "x", " "]) for _ in range(pick.randint(0, words))) for _ in range(n)]


def grams(text, n):
    tokens = text.split(" ")
    return Counter(" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def test_turns_share_out_the_ngrams():
    """Every n-gram has one turn, and a turn moves about its share of them."""
    table = pa.table({"t": [" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(300)) for i in range(40)]})
    size = lambda turn, turns: sum(len(d) for b in K.counted_slices("t", {1, 2, 3, 4}, [], 8, turn, turns)(iter(table.to_batches())) for d in b.column("_data").to_pylist())
    whole, parts = size(0, 1), [size(turn, 4) for turn in range(4)]
    assert sum(parts) == whole and max(parts) < 0.3 * whole


def test_totals_in_turns(spark, turns):
    rows = [(i % 3 or None, t) for i, t in enumerate(texts(60))] + [(1, None)]
    df = spark.createDataFrame(rows, "g int, t string")
    assert K.turn_count(K.text_bytes(df, "t")) == K.TURNS > 1
    want = {}
    for g, t in rows:
        for n in (1, 2, 3, 4):
            want.setdefault((g, n), Counter()).update(grams(t, n) if t is not None else {})
    got = {(r.g, r.n): (r.uniq, r.total) for r in N.ngram_totals(df, "t", by=["g"]).collect() if r.g is not None}
    assert got == {k: (len(v), sum(v.values())) for k, v in want.items() if k[0] is not None}
    every = {r.n: r.uniq for r in N.ngram_totals(df, "t").collect()}
    assert every == {n: len(set().union(*(v for (_, m), v in want.items() if m == n))) for n in (1, 2, 3, 4)}


def test_a_turns_shuffle_files_go_when_it_ends(spark, turns, monkeypatch):
    """Disk holds the n-grams of one turn: what a turn shuffled is gone when the next begins."""
    folders = [str(d) for d in spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    held = lambda: sum(f.endswith(".data") and f.startswith("shuffle_") for top in folders for _, _, names in os.walk(top) for f in names)
    seen, made = [], K.cut_lineage

    def cut(df):
        out = made(df)
        seen.append(held())
        return out

    monkeypatch.setattr(K, "cut_lineage", cut)
    # kept alive, so that the driver's garbage collector cannot be what drops the files
    kept = []
    write = K.by_bucket
    monkeypatch.setattr(K, "by_bucket", lambda *a: kept.append(write(*a)) or kept[-1])
    df = spark.createDataFrame([(t,) for t in texts(80)], "t string")
    before = held()
    N.ngram_totals(df, "t")
    assert len(seen) == K.TURNS and len(kept) == K.TURNS
    assert max(seen) - before <= 16 * 2  # as many as one turn's tasks, not as four turns'


@pytest.mark.parametrize("slices", [1, 5])
def test_losses_in_turns(spark, turns, slices):
    """Losses by brute force: groups with nulls, rows of one key, rows without key, copies."""
    given = texts(50, words=14) + ["a b a", "a b a"]
    rows = [(i % 3 or None, None if i % 11 == 0 else i // 2, t) for i, t in enumerate(given)] + [(1, 3, None)]
    df = spark.createDataFrame(rows, "g int, id bigint, t string")
    per = {}
    for g, key, t in rows:
        for n in (1, 2, 3):
            for gram, c in (grams(t, n) if t is not None else {}).items():
                per.setdefault((g, n, gram), Counter())[key] += c
    loss, uniq, total = Counter(), Counter(), Counter()
    for (g, n, _), held in per.items():
        uniq[g, n] += 1
        total[g, n] += sum(held.values())
        (key, top), *rest = held.most_common()
        runner = rest[0][1] if rest else 0
        if key is not None and top > runner:
            loss[g, key, n] += top - runner
    found = B.gram_summary(df, "id", "t", [1, 2, 3], ["g"], slices=slices).collect()
    assert {(r.g, r.id, r.n): r.loss for r in found if r.id is not None} == dict(loss)
    assert {(r.g, r.n): (r.uniq, r.total) for r in found if r.id is None} == {k: (uniq[k], total[k]) for k in uniq}


def test_a_slice_sends_no_owners_and_finds_its_losses_itself(spark, monkeypatch):
    """What moves is a hash and a count per n-gram of a slice; of losses a row per text and order, however many buckets there are."""
    monkeypatch.setattr(K, "BUCKET_GRAMS", 64)
    assert K.SHARED.itemsize == 14 and set(K.SHARED.names) == {"f", "e", "v"}
    df = spark.createDataFrame(list(enumerate(texts(40))), "id bigint, t string").withColumns({"_group": K.group_hash([]), "_slice": K.F.expr("cast(id % 4 as int)")})
    size = K.text_bytes(df, "t")
    assert K.bucket_count(spark, size, [1, 2]) > 8
    shared = K.Shared(df, "t", {1, 2}, 4, size, K.owned_grams("id", "t", []), K.other_tops)
    losses = shared.finished(K.losses_of("id", []), "id bigint, n int, loss bigint, uniq bigint, total bigint").collect()
    named = [(r.id, r.n) for r in losses if r.id is not None]
    assert len(named) == len(set(named)) and len(losses) - len(named) <= 4 * 2


def test_texts_that_change_between_readings_are_told(spark):
    df = spark.createDataFrame(list(enumerate(texts(8))), "id bigint, t string").withColumns({"_group": K.group_hash([]), "_slice": K.F.lit(0)})
    shared = K.Shared(df, "t", {1}, 1, 1, K.owned_grams("id", "t", []), K.other_tops)
    codes = shared.codes()
    changed = K.Shared(df.where("id < 2"), "t", {1}, 1, 1, shared.held, shared.code)
    changed.codes = lambda: codes
    with pytest.raises(Exception, match="the texts changed"):
        changed.finished(K.losses_of("id", []), "id bigint, n int, loss bigint, uniq bigint, total bigint").collect()


def test_frequencies_in_turns(spark, turns):
    """Texts, copies of texts and groups by brute force."""
    given = texts(50, words=14) + ["a b a"] * 20 + ["", " ", "é"]
    rows = [(i % 3 or None, t) for i, t in enumerate(given)] + [(1, None)]
    df = spark.createDataFrame(rows, "g int, t string").repartition(5)
    want = Counter()
    for g, t in rows:
        for n in (1, 2, 4):
            for gram, c in (grams(t, n) if t is not None else {}).items():
                want[g, n, gram] += c
    got = [((r.g, r.n, r.gram), r.freq) for r in N.ngram_frequencies(df, "t", [1, 2, 4], by=["g"]).collect()]
    assert len(got) == len(want) and dict(got) == dict(want)


def test_texts_of_ngrams_do_not_move_and_leave_in_small_batches(monkeypatch):
    """A slice names its n-grams itself and a batch at a time, so a worker never holds the texts of all of them."""
    monkeypatch.setattr(K, "GATHER_ROWS", 100)
    table = pa.table({"t": [" ".join(f"w{i * 31 + j}" for j in range(50)) for i in range(20)], "_group": [0] * 20, "_copies": [1] * 20})
    read = K.placed_grams("t", [])(table)
    back = ((n, f, e, v, v, more) for n, f, e, v, more in read({1, 4}, 0, 1))
    batches = list(K.named_grams([])(table, back))
    assert max(b.num_rows for b in batches) <= 100
    named = Counter(x for b in batches for x in b.column("gram").to_pylist())
    assert named == Counter(set(g for t in table.column("t").to_pylist() for n in (1, 4) for g in grams(t, n)))
    assert all(x.dtype.kind in "ui" for n, f, e, v, _ in read({1, 4}, 0, 1) for x in (f, e, v))


def test_slices_are_small():
    """Two workers and a JVM share an executor of 3 GB; a worker takes about 40 bytes per byte of its slice."""
    assert K.SLICE_BYTES <= 8 << 20
