"""Text and columnar tables with explicit schemas."""

from functools import reduce

from pyspark.sql import functions as F

from textdist.sources import ranges

TEXT_SCHEMA = "text string"
SPLITS = ("train", "valid", "test")

BINDING_FIELDS = ("itemLabel", "wikiTitle", "genderLabel", "birthDate", "occupations")


def read_jsonl(spark, folder, name, split=None, limit=None, order=None, range_bytes=ranges.RANGE_BYTES):
    """Field ``text`` of ``{name}.jsonl`` or ``{name}.{split}.jsonl``. ``split`` may be a list:
    all files are read at once and tagged. ``limit`` keeps the first lines by ``order``, a field of the lines or "text"; without an order
    it keeps the first lines of each split as stored, and reads only the byte ranges that hold them. There a blank line counts as a
    line but gives no row."""
    parts = [None] if split is None else [split] if isinstance(split, str) else list(split)
    paths = [f"{folder}/{name}.jsonl" if s is None else f"{folder}/{name}.{s}.jsonl" for s in parts]
    if limit is not None and order is None:
        found = [ranges.lines(spark, p, limit, range_bytes).withColumn("split", F.lit(s)) for p, s in zip(paths, parts)]
        df = reduce(lambda a, b: a.unionByName(b), found).where(F.trim("line") != "")
        return df.select(F.from_json("line", TEXT_SCHEMA)["text"].alias("text"), *([] if split is None else ["split"]))
    more = "" if order in (None, "text") else f", {order} long"
    df = spark.read.schema(TEXT_SCHEMA + more).json(paths)
    if split is not None:
        df = df.withColumn("split", F.regexp_extract(F.input_file_name(), r"\.([^./]+)\.jsonl(?:/|$)", 1))
    if limit is not None:
        df = df.orderBy(order).limit(limit)
    return df.drop(order) if more else df


def read_bindings(spark, path, fields=BINDING_FIELDS, at=("results", "bindings"), range_bytes=ranges.RANGE_BYTES):
    """Nested query results, ``results.bindings[*].{field}.value``, as one row per binding. A document of any size is
    read by ranges of bytes. A field a binding lacks is null."""
    inside = ", ".join(f"`{f}` struct<value: string>" for f in fields)
    binding = F.from_json("record", inside)
    rows = ranges.nested_records(spark, path, at, range_bytes).select(binding.alias("_b"))
    return rows.select(*[F.col(f"_b.`{f}`.value").alias(f) for f in fields])


def read_table(spark, path, schema=None):
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_table(df, path, partition_by=(), mode="overwrite"):
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def stack_splits(parts):
    """{split: table} as one table with a ``split`` column."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("split", F.lit(s)) for s, df in parts.items()])


def write_splits(parts, path):
    write_table(stack_splits(parts), path, ["split"])
