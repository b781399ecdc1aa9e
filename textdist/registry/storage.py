"""Sources, sinks and caches, through a new folder in the shared place."""

from pyspark.sql import functions as F

from textdist.functions.text import word_count
from textdist.sources import cache, ranges, tables
from textdist.registry.base import query, table
from textdist.session import scratch_path

SPLIT = "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'valid' ELSE 'train' END"


def splits(spark, d):
    docs = table(spark, d, "documents").withColumn("split", F.expr(SPLIT))
    return {s: docs.where(F.col("split") == s).drop("split") for s in tables.SPLITS}


@query("jsonl_source", f"SELECT {SPLIT} AS split, md5(text) AS digest FROM documents")
def jsonl(spark, d):
    folder = scratch_path(spark, "jsonl")
    for name, part in splits(spark, d).items():
        part.select("text", "doc_id").write.json(f"{folder}/web.{name}.jsonl")
    return tables.read_jsonl(spark, folder, "web", list(tables.SPLITS)).select("split", F.md5("text").alias("digest"))


@query("jsonl_first_lines", "SELECT md5(text) AS digest FROM (SELECT text FROM documents ORDER BY doc_id, text LIMIT 400)")
def jsonl_first_lines(spark, d):
    """The first 400 lines as stored, of files of which the first ones hold them."""
    folder = scratch_path(spark, "jsonl")
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text").write.json(f"{folder}/web.jsonl")
    return tables.read_jsonl(spark, folder, "web", limit=400, range_bytes=1 << 20).select(F.md5("text").alias("digest"))


@query("columnar_roundtrip", "SELECT doc_id, md5(text) AS digest, lang FROM documents")
def columnar(spark, d):
    path = scratch_path(spark, "table")
    source = table(spark, d, "documents").select("doc_id", "text", "lang")
    tables.write_table(source, path, ["lang"])
    return tables.read_table(spark, path, "doc_id bigint, text string, lang string").select("doc_id", F.md5("text").alias("digest"), "lang")


@query("split_writer", f"SELECT {SPLIT} AS split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def split_writer(spark, d):
    path = scratch_path(spark, "splits")
    tables.write_splits(splits(spark, d), path)
    return tables.read_table(spark, path).groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("binding_documents", """SELECT c_name AS "itemLabel", c_mktsegment AS "wikiTitle" FROM customer
  UNION ALL SELECT 'second ' || c_custkey, NULL FROM customer""")
def bindings(spark, d):
    """Documents of up to 100 000 customers, several to a file, read by ranges that begin anywhere in them."""
    value = lambda c: F.struct(c.alias("value"))
    binding = lambda **fields: F.concat(F.to_json(F.struct(*[value(c).alias(f) for f, c in fields.items()])), F.lit(","))
    first = binding(itemLabel=F.col("c_name"), wikiTitle=F.col("c_mktsegment"))
    second = binding(itemLabel=F.concat(F.lit("second "), F.col("c_custkey")))
    customers = table(spark, d, "customer").withColumn("document", F.expr("c_custkey div 100000"))
    records = customers.select("document", F.lit(1).alias("part"), F.concat_ws("\n", first, second).alias("value"))
    ends = customers.groupBy("document").agg(F.count("*").alias("n")).select("document", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.format_string('{"head": {"bindings": [{"n": %d}]}, "results": {"bindings": [', "n").alias("value")),
        F.struct(F.lit(2).alias("part"), F.lit("null]}}").alias("value")),
    )).alias("end")).select("document", "end.*")
    path = scratch_path(spark, "bindings")
    records.unionByName(ends).repartition("document").sortWithinPartitions("document", "part").select("value").write.text(path)
    size = sum(n for _, n in ranges.files_of(spark, path))
    return tables.read_bindings(spark, path, ("itemLabel", "wikiTitle"), range_bytes=min(ranges.RANGE_BYTES, max(size // 16, 4096)))


@query("feature_cache", "SELECT doc_id, len(string_split(text, ' ')) AS words FROM documents")
def feature_cache(spark, d):
    """A first fill with the labelled documents, then with all: only the rest is computed."""
    root, docs = scratch_path(spark, "cache"), table(spark, d, "documents")
    count = lambda rows: rows.select("doc_id", F.size(F.split("text", " ", -1)).cast("bigint").alias("words"))
    labelled = docs.join(table(spark, d, "labels"), "doc_id", "left_semi")
    cache.fill_missing(labelled, count, root, {"feature": "words"}, ["doc_id"])
    return cache.fill_missing(docs, count, root, {"feature": "words"}, ["doc_id"])


@query("metric_cache", "SELECT lang AS name, round(avg(len(string_split(text, ' '))), 6) AS value FROM documents GROUP BY lang")
def metric_cache(spark, d):
    """The second call reads what the first one stored."""
    root = scratch_path(spark, "metrics")
    build = lambda: table(spark, d, "documents").groupBy(F.col("lang").alias("name")).agg(F.round(F.avg(word_count(F.col("text"))), 6).alias("value"))
    cache.materialize(build, spark, root, {"metric": "mean words"})
    return cache.materialize(build, spark, root, {"metric": "mean words"})


@query("metric_sink", """SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS name, count(*) AS n, round(sum(value), 6) AS total, max(event_id) AS last_step
  FROM events GROUP BY 1, 2""")
def metric_sink(spark, d):
    path = scratch_path(spark, "tracked")
    rows = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("int").alias("step"), F.col("event_type").alias("name"), "value")
    for tracked in (rows.where("name = 'error'"), rows.where("name <> 'error'")):
        cache.append_metrics(tracked, path)
    return cache.read_metrics(spark, path).groupBy("run_id", "name").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("step").cast("bigint").alias("last_step"))
