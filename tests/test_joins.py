import pytest
from pyspark.sql import functions as F

from textdist.operators import entity, joins


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lookup_join_paths_agree(spark, limit):
    # Two thirds of the facts share one key.
    facts = spark.range(300).withColumn("k", F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 7))
    table = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = joins.lookup_join(facts, table, ["k"], F.col("id"), "left", limit)
    want = facts.join(table, "k", "left")
    assert sorted(map(tuple, got.select("id", "v").collect()), key=str) == sorted(map(tuple, want.select("id", "v").collect()), key=str)


def test_grid_is_measured(spark):
    grid = joins.experiment_grid(spark.range(2).toDF("a"), spark.range(3).toDF("b"))
    assert grid.count() == 6
    assert joins.experiment_grid(spark.range(2).toDF("a"), spark.range(200_000).toDF("b")).count() == 400_000


def test_first_per_title_drops_untitled(spark):
    df = spark.createDataFrame([("t", "b", 2), ("t", "a", 3), (None, "c", 1)], "title string, label string, item int")
    assert [tuple(r) for r in entity.one_per_title(df, "title", ["label", "item"]).collect()] == [("t", "a", 3)]


def test_entity_facts(spark):
    people = spark.createDataFrame([(1, "good"), (2, "good"), (3, "bad")], "e int, badge string")
    badges = spark.createDataFrame([("good",)], "badge string")
    titles = spark.createDataFrame([(1, "One")], "e int, title string")
    labels = spark.createDataFrame([(1, "l1"), (2, "l2")], "e int, label string")
    jobs = spark.createDataFrame([(1, "poet", "en"), (1, "actor", "en"), (1, "poet", "en"), (2, "dichter", "de")], "e int, occupation string, lang string")
    rows = entity.entity_facts(people, badges, titles, jobs, labels, "e", "badge").orderBy("e").collect()
    assert [(r.e, r.title, r.label, r.occupations) for r in rows] == [(1, "One", "l1", "actor, poet"), (2, None, "l2", "")]


def test_pages(spark):
    items = spark.createDataFrame([("a",), ("b",)], "title string")
    pages = spark.createDataFrame([("a",), ("a",)], "page string")
    assert [r.title for r in joins.existing_pages(items, pages, "title", "page").collect()] == ["a"]
    assert [r.title for r in joins.missing_pages(items, pages, "title", "page").collect()] == ["b"]


def test_only_hot_keys_are_copied(spark):
    """Of a table too large to broadcast, the rows of hot keys alone meet every slice of the facts."""
    facts = spark.range(6000).withColumn("k", F.when(F.col("id") < 3000, 0).when(F.col("id") < 3100, F.lit(None).cast("long")).otherwise(F.col("id")))
    table = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = joins.hot_keys(facts, ["k"])
    assert [r.k for r in hot.where("k IS NOT NULL").collect()] == [0]
    assert joins.salted_copies(table, ["k"], hot, 32).count() == 6000 + 31
    got = joins.lookup_join(facts, table, ["k"], F.col("id"), "left", 0).select("id", "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, facts.join(table, "k", "left").select("id", "v").collect()), key=str)
