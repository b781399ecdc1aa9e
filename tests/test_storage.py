import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textdist.sources import cache, tables

ROOT = Path(__file__).resolve().parents[1]


def test_jsonl(spark, tmp_path):
    for name, lines in {"web.jsonl": ["one", "two", "three"], "web.train.jsonl": ["a\nb"], "web.test.jsonl": ["c"]}.items():
        (tmp_path / name).write_text("".join(json.dumps({"text": t, "id": 1}) + "\n" for t in lines))
    assert [r.text for r in tables.read_jsonl(spark, str(tmp_path), "web", limit=2, order="text").collect()] == ["one", "three"]
    assert [r.text for r in tables.read_jsonl(spark, str(tmp_path), "web", limit=2, range_bytes=7).collect()] == ["one", "two"]
    rows = tables.read_jsonl(spark, str(tmp_path), "web", ["train", "test"], limit=1).collect()
    assert {(r.split, r.text) for r in rows} == {("train", "a\nb"), ("test", "c")}
    rows = tables.read_jsonl(spark, str(tmp_path), "web", ["train", "test"]).collect()
    assert {(r.split, r.text) for r in rows} == {("train", "a\nb"), ("test", "c")}


def test_bindings_document(spark, tmp_path):
    path = tmp_path / "facts.json"
    path.write_text(json.dumps({"results": {"bindings": [
        {"itemLabel": {"value": "A"}, "wikiTitle": {"value": "a"}}, {"itemLabel": {"value": "B"}}]}}, indent=2))
    rows = tables.read_bindings(spark, str(path), ("itemLabel", "wikiTitle")).collect()
    assert [tuple(r) for r in rows] == [("A", "a"), ("B", None)]


def test_splits(spark, tmp_path):
    parts = {"train": spark.range(5), "test": spark.range(2)}
    tables.write_splits(parts, str(tmp_path / "s"))
    got = {r.split: r["count"] for r in tables.read_table(spark, str(tmp_path / "s")).groupBy("split").count().collect()}
    assert got == {"train": 5, "test": 2}


def test_materialize_reads_what_it_stored(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    root = str(tmp_path / "c")
    for _ in range(2):
        assert cache.materialize(build, spark, root, {"k": 4}).count() == 3
    assert len(calls) == 1
    cache.materialize(build, spark, root, {"k": 5})
    cache.materialize(build, spark, root, {"k": 4}, recompute=True)
    assert len(calls) == 3
    assert cache.parameter_key({"a": 1, "b": 2}) == cache.parameter_key({"b": 2, "a": 1})


def test_fill_missing_computes_only_new_keys(spark, tmp_path):
    seen = []

    def compute(rows):
        seen.append(rows.count())
        return rows.withColumn("v", F.col("id") * 2)

    cache.fill_missing(spark.range(4), compute, str(tmp_path), {}, ["id"])
    out = cache.fill_missing(spark.range(6), compute, str(tmp_path), {}, ["id"])
    assert seen == [4, 2] and sorted(r.v for r in out.collect()) == [0, 2, 4, 6, 8, 10]


def test_metrics_table(spark, tmp_path):
    path = str(tmp_path / "m")
    cache.append_metrics(cache.metric_rows(spark, "r", {"a": 1, "b": None}, step=0), path)
    cache.append_metrics(spark.createDataFrame([("r", "c", 2.0)], "run_id string, name string, value double"), path)
    got = {(r.step, r.name, r.value) for r in cache.read_metrics(spark, path).collect()}
    assert got == {(0, "a", 1.0), (0, "b", None), (None, "c", 2.0)}
    maps = {r.step: r.metrics for r in cache.metric_maps(cache.read_metrics(spark, path)).collect()}
    assert maps == {0: {"a": 1.0}, None: {"c": 2.0}}


def test_lineage_is_cut_in_the_folder_the_session_names(tmp_path):
    """The setting is fixed at start, so a session of its own is needed."""
    script = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession, functions as F
from textdist.session import cut_lineage
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
cut = cut_lineage(spark.range(10).withColumn("v", F.monotonically_increasing_id()))
assert cut.count() == 10
print("PATH", cut.inputFiles()[0])
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120)
    assert f"PATH file://{tmp_path}/cut-" in out.stdout, out.stderr[-2000:]
