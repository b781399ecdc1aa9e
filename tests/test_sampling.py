import hashlib

import pytest
from pyspark.sql import functions as F

from textdist.operators import sampling as S


def digest(seed, key):
    return hashlib.md5(f"{seed}-{key}".encode()).hexdigest()


@pytest.mark.parametrize("limit", [10**6, 0])
def test_hash_sample_small_and_bucketed_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "TOP_N_LIMIT", limit)
    df = spark.range(5000)
    got = {r.id for r in S.hash_sample(df, "id", 3, n=777).collect()}
    assert got == set(sorted(range(5000), key=lambda k: digest(3, k))[:777])


def test_sample_does_not_depend_on_partitions(spark):
    a = {r.id for r in S.hash_sample(spark.range(1000).repartition(3), "id", 5, ratio=0.2).collect()}
    b = {r.id for r in S.hash_sample(spark.range(1000).repartition(17), "id", 5, ratio=0.2).collect()}
    assert a == b and len(a) == 200


def test_sample_share_rounds_down_per_group(spark):
    df = spark.range(24).withColumn("g", F.when(F.col("id") < 4, "small").otherwise("large"))
    got = S.hash_sample(df, "id", 1, ratio=0.2, by=["g"]).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"large": 4}
    with pytest.raises(ValueError):
        S.hash_sample(df, "id", 1)


@pytest.mark.parametrize("as_text", [False, True])
def test_dense_index_by_ranges(spark, as_text):
    keys = [k * 7 + (k % 3) for k in range(3000)]
    df = spark.createDataFrame([(f"k{k:06d}" if as_text else k,) for k in keys[::-1]], "k string" if as_text else "k bigint")
    rows = S.dense_index(df, "k", bucket_rows=100).orderBy("k").collect()
    assert [r.idx for r in rows] == list(range(3000))


def test_first_n_large_and_short(spark, monkeypatch):
    monkeypatch.setattr(S, "TOP_N_LIMIT", 0)
    assert sorted(r.id for r in S.first_n(spark.range(100), "id", 30).collect()) == list(range(30))
    assert S.first_n(spark.range(10), "id", 30).count() == 10


def test_equal_length(spark):
    p, q = S.equal_length(spark.range(10), spark.range(7), "id")
    assert (p.count(), q.count()) == (7, 7) and p.agg(F.max("id")).first()[0] == 6


def test_batches_keep_the_short_last_one(spark):
    sizes = S.with_batches(spark.range(10), "id", 4).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [4, 4, 2]


def test_in_context_examples(spark):
    bios = spark.createDataFrame([(i, f"t{i} x", "c " * 400) for i in range(5)], "k int, title string, content string")
    got = S.in_context_examples(spark.range(20), "id", bios, "k", 3, 9, max_title_words=1)
    rows = got.collect()
    assert len(rows) == 20 and all(len(r.examples) == 3 for r in rows)
    assert {len(e.content.split(" ")) for r in rows for e in r.examples} == {350}
    assert {e.title for r in rows for e in r.examples} == {f"t{i}" for i in range(5)}
    assert S.widen_examples(got, 2).columns == ["id", "example_0", "example_1"]


def test_draw_uses_every_item(spark):
    items = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "k int, prompt string")
    drawn = S.draw_with_replacement(spark.range(200), "id", items, "k", 1, "prompt")
    counts = [r["count"] for r in drawn.groupBy("prompt").count().collect()]
    assert sum(counts) == 200 and len(counts) == 4 and min(counts) > 25


def test_latest_run_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("a", 2, 6), ("b", 1, 2)], "k string, ts int, v int")
    got = {r.k: r.v for r in S.latest_run(df, ["k"], "ts", tie=["v"]).collect()}
    assert got == {"a": 6, "b": 2}
    assert [r.v for r in S.latest_run(df, ["k"], "ts", date=1, tie=["v"]).orderBy("k").collect()] == [1, 2]


def test_numbers_follow_any_order(spark):
    df = spark.createDataFrame([(i, i * 7919 % 100) for i in range(1000)], "k int, score int")
    rows = S.numbered(df, [F.desc("score"), F.asc("k")], "place", partitions=7).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1000))
    assert [(r.score, r.k) for r in rows] == sorted(((i * 7919 % 100, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))


def test_only_keys_are_sorted(spark):
    wide = spark.range(500).withColumn("text", F.lit("x"))
    text = S.dense_index(wide, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "Sort" not in text and text.count("Join") == 1
    nothing = S.dense_index(wide.where("id < 0"), "id")
    assert nothing.count() == 0 and nothing.columns == ["id", "text", "idx"]


@pytest.mark.parametrize("leaf", [1 << 16, 4])
def test_samples_by_thresholds(spark, monkeypatch, leaf):
    monkeypatch.setattr(S, "LEAF_ROWS", leaf)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string")
    got = {(r.g, r.id) for r in S.hash_sample(df, "id", 9, ratio=0.1, by=["g"]).collect()}
    want = set()
    for g in {g for _, g in rows}:
        ids = sorted((k for k, x in rows if x == g), key=lambda k: digest(9, k))
        want |= {(g, k) for k in ids[: int(len(ids) * 0.1)]}
    assert got == want
    few = S.hash_sample(df, "id", 9, n=2, by=["g"]).groupBy("g").count().collect()
    assert {r["count"] for r in few} == {2}


def test_large_first_n_with_a_null_key(spark, monkeypatch):
    monkeypatch.setattr(S, "TOP_N_LIMIT", 0)
    df = spark.createDataFrame([(k, "t") for k in [None, 5, 3, 9]], "k int, t string")
    assert {r.k for r in S.first_n(df, "k", 3).collect()} == {None, 3, 5}
    assert {r.k for r in S.first_n(df, "k", 1).collect()} == {None}
