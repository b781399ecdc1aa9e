"""Joins that hold under skew, and the joins the evaluation loops stand for."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20
SALTS = 32
HOT_SHARE = 1000


def with_field(df, name, kind):
    """Schema of ``df`` with one more column."""
    return T.StructType(df.schema.fields + [T.StructField(name, kind)])


def small_enough(df, limit=BROADCAST_BYTES):
    """Measure the text form of a table, stopping at the limit: a proven size bound."""
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(4)) for c in df.columns), F.lit(16))
    rows = limit // 16 + 1
    return (df.limit(rows).agg(F.sum(width)).first()[0] or 0) <= limit


def hot_keys(facts, keys, share=HOT_SHARE):
    """Keys with more than one in ``share`` of the rows, so fewer than ``share`` of them."""
    counts = facts.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c")).first()[0] or 0
    return counts.where(F.col("_c") * share > total).select(*keys, F.lit(True).alias("_hot"))


def salted_copies(table, keys, hot, salts):
    """The rows of a hot key once for each salt, all others once."""
    last = F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0)).cast("long")
    marked = table.join(F.broadcast(hot), keys, "left")
    return marked.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_hot")


def lookup_join(facts, table, keys, spread, how="inner", limit=BROADCAST_BYTES, salts=SALTS):
    """Join many fact rows to one table row per key. A measured small table is broadcast.
    Of a large one the rows of hot keys are salted: copies of them meet the slices of the hot key; all other rows move once.
    ``spread`` is a fact column whose values vary inside a hot key."""
    keys = list(keys)
    if small_enough(table, limit):
        return facts.join(F.broadcast(table), keys, how)
    hot = hot_keys(facts, keys)
    slot = F.pmod(F.xxhash64(spread), F.lit(salts))
    # Rows with a null key meet nothing; they are spread like those of a hot key.
    absent = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    sliced = facts.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | absent, slot).otherwise(F.lit(0).cast("long"))).drop("_hot")
    return sliced.join(salted_copies(table, keys, hot, salts), keys + ["_salt"], how).drop("_salt")


def attach_predictions(source, predictions, key):
    """Add prediction columns to their source rows by row key."""
    return source.join(predictions, key)


def stack_sides(q, p):
    """Q over P with a ``side`` column; filter on it to split back."""
    return q.withColumn("side", F.lit("q")).unionByName(p.withColumn("side", F.lit("p")))


def first_per_key(df, keys, order):
    """One row per key, the least by ``order``. A partial aggregate, so a hot key costs one
    row per task; a window would sort the whole key in one."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def concat_distinct(df, keys, value, out, separator=", "):
    """Distinct values of a group, sorted and joined; no values give an empty string."""
    distinct = df.select(*keys, value).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), separator).alias(out))


def existing_pages(entities, pages, title, page_title):
    """Entities that have a page."""
    return entities.join(pages.select(F.col(page_title).alias(title)).distinct(), title, "left_semi")


def missing_pages(entities, pages, title, page_title):
    """Entities whose page does not exist: the reject report."""
    return entities.join(pages.select(F.col(page_title).alias(title)).distinct(), title, "left_anti")


def experiment_grid(*tables):
    """Every combination of parameter tables; one measured small is broadcast."""
    grid = tables[0]
    for table in tables[1:]:
        grid = grid.crossJoin(F.broadcast(table) if small_enough(table, 1 << 20) else table)
    return grid
