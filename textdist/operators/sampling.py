"""Order, samples, dense row numbers and batches on a table with a unique key.

Row numbers come from one sort of the keys alone: range partitions count their rows, a row's number is its
place in its partition plus the rows before that partition, and wide rows are joined last. Samples find the
largest hash they keep by counting hash prefixes, so a sample is one filter; neither the driver nor one task
ever holds it.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textdist.functions.keys import hash_index, hash_order
from textdist.functions.text import MAX_BIO_WORDS, first_words
from textdist.operators.joins import lookup_join
from textdist.session import cut_lineage

TOP_N_LIMIT = 20_000
#: hex digits of one counting step, and rows of a group that are sorted in one place
DIGITS, LEAF_ROWS = 3, 1 << 16
PLACE_BITS = 33
MAX_TITLE_WORDS = 10


def seeded_shuffle(df, key, seed):
    return df.orderBy(hash_order(seed, F.col(key)), key)


def hash_sample(df, key, seed, n=None, ratio=None, by=()):
    """Seeded sample without replacement: the first ``n`` rows, or the share ``ratio``
    rounded down, of each ``by`` group in hash order. A null group is a group."""
    if (n is None) == (ratio is None):
        raise ValueError("give either n or ratio")
    by = list(by)
    order = hash_order(seed, F.col(key))
    if not by and n is not None and n <= TOP_N_LIMIT:
        return df.orderBy(order, key).limit(n)
    target = F.lit(n).cast("long") if ratio is None else F.floor(F.col("_n") * F.lit(ratio))
    keyed = df.withColumn("_g", F.struct(*by, F.lit(0).alias("_0"))).withColumn("_h", order)
    last = last_hashes(keyed.select("_g", "_h"), target)
    if not by:
        found = last.first()
        return df.where(order <= found["_last"]) if found else df.limit(0)
    return lookup_join(keyed, cut_lineage(last), ["_g"], F.col("_h")).where("_h <= _last").select(*df.columns)


def last_hashes(hashes, target):
    """Rows (_g, _last): the ``target``-th least hash of each group, the largest if it has fewer; ``target`` is a column of the
    group's row count ``_n``. Groups of target 0 are left out. Counts of hash prefixes narrow the place down, digit by digit,
    until a group's candidates are at most ``LEAF_ROWS``."""
    hashes = cut_lineage(hashes)
    found, width = hashes.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")), 0
    found = found.select("_g", F.lit("").alias("_prefix"), F.least(target, F.col("_n")).alias("_left"), F.col("_n").alias("_c"))
    found = cut_lineage(found.where("_left > 0"))
    while (found.agg(F.max("_c")).first()[0] or 0) > LEAF_ROWS and width < 30:
        inside = _with_prefix(hashes, found, width)
        width += DIGITS
        # at most 16 ** DIGITS rows per group from here
        counts = inside.groupBy("_g", "_left", F.substring("_h", 1, width).alias("_prefix")).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy("_g").orderBy("_prefix"))
        found = counts.withColumn("_left", F.col("_left") - upto + F.col("_c")).where("_left > 0 AND _left <= _c")
        found = cut_lineage(found.select("_g", "_prefix", "_left", "_c"))
    inside = _with_prefix(hashes, found, width)
    return inside.groupBy("_g").agg(F.array_sort(F.collect_list("_h")).alias("_all"), F.first("_left").alias("_left")).select(
        "_g", F.expr("_all[CAST(_left - 1 AS INT)]").alias("_last"))


def _with_prefix(hashes, found, width):
    """The hashes of each group under its prefix. Every group has one row in ``found``."""
    kept = lookup_join(hashes, found.select("_g", "_prefix", "_left"), ["_g"], F.col("_h"))
    return kept.where(F.substring("_h", 1, width) == F.col("_prefix")) if width else kept


def numbered(df, order, out="idx", partitions=None):
    """Rows with 0, 1, 2, … in ``order``, written to the shared folder. One sort: range partitions number their
    rows in place, and only their counts (a row for each partition) reach the driver."""
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = cut_lineage(sorted_rows.withColumn("_m", F.monotonically_increasing_id()))
    counts = {r["_p"]: r["count"] for r in placed.groupBy(F.shiftright("_m", PLACE_BITS).cast("int").alias("_p")).count().collect()}
    before, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(p, 0)
    shift = F.element_at(F.lit(offsets or [0]).cast("array<bigint>"), F.shiftright("_m", PLACE_BITS).cast("int") + 1)
    place = F.col("_m").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.withColumn(out, place + shift).drop("_m")


def dense_index(df, key, out="idx", bucket_rows=None):
    """Add 0, 1, 2, … in order of a unique key. Only keys are sorted; wide rows join their number last.
    ``bucket_rows`` is the rows of a range; by default there are as many ranges as shuffle partitions."""
    partitions = None if bucket_rows is None else max(1, -(-df.count() // bucket_rows))
    index = numbered(df.select(key), [F.col(key)], out, partitions)
    if df.columns == [key]:
        return index
    index = index.withColumnRenamed(key, "_key")
    return df.join(index, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def first_n(df, key, n):
    """First ``n`` rows in key order; what exists when the table is shorter. A large ``n`` finds the key of row ``n`` first: one filter."""
    if n <= TOP_N_LIMIT:
        return df.orderBy(key).limit(n)
    last = numbered(df.select(key), [F.col(key)], "_i").where(F.col("_i") == n - 1).first()
    if last is None:
        return df
    none = F.col(key).isNull()
    return df.where(none if last[key] is None else none | (F.col(key) <= F.lit(last[key])))


def equal_length(p, q, key):
    """Cut the longer side to the length of the shorter, in key order."""
    n_p, n_q = p.count(), q.count()
    if n_p > n_q:
        p = first_n(p, key, n_q)
    elif n_q > n_p:
        q = first_n(q, key, n_p)
    return p, q


def draw_with_replacement(draws, draw_key, items, item_key, seed, value):
    """One item per draw row, uniform and independent of partitioning."""
    indexed = dense_index(items.select(item_key, value), item_key, "_i").select("_i", value)
    place = hash_index(seed, F.lit(items.count()), F.col(draw_key))
    return lookup_join(draws.withColumn("_i", place), indexed, ["_i"], F.col(draw_key)).drop("_i")


def draw_from_values(draws, draw_key, values, seed, out):
    """One of a short literal list per draw row: an array lookup, no join."""
    choice = F.array(*[F.lit(v) for v in values])
    return draws.withColumn(out, F.get(choice, hash_index(seed, F.lit(len(values)), F.col(draw_key)).cast("int")))


def in_context_examples(samples, sample_key, bios, bio_key, n_icl, seed,
                        max_title_words=MAX_TITLE_WORDS, max_content_words=MAX_BIO_WORDS):
    """``n_icl`` biographies per sample, drawn with replacement and cut to size, in slot order."""
    index = dense_index(bios.select(bio_key), bio_key, "_i")
    size = index.count()
    slots = samples.select(
        sample_key, F.explode(F.sequence(F.lit(0), F.lit(n_icl - 1))).alias("_slot")
    ).withColumn("_i", hash_index(seed, F.lit(size), F.col(sample_key), F.col("_slot")))
    # Keys first: a text moves only to the samples that drew it.
    drawn = lookup_join(slots, index, ["_i"], F.xxhash64(sample_key, "_slot")).select(sample_key, "_slot", bio_key)
    cut = bios.select(
        bio_key,
        first_words(F.col("title"), max_title_words).alias("title"),
        first_words(F.col("content"), max_content_words).alias("content"),
    )
    # n_icl entries per group, fixed by the caller.
    picked = lookup_join(drawn, cut, [bio_key], F.xxhash64(sample_key, "_slot")).groupBy(sample_key).agg(
        F.array_sort(F.collect_list(F.struct("_slot", "title", "content"))).alias("_e")
    )
    return picked.select(
        sample_key,
        F.transform("_e", lambda e: F.struct(e["title"].alias("title"), e["content"].alias("content"))).alias("examples"),
    )


def widen_examples(df, n_icl):
    """One struct column per slot: example_0, example_1, …"""
    wide = [F.get("examples", F.lit(i)).alias(f"example_{i}") for i in range(n_icl)]
    return df.select(*[c for c in df.columns if c != "examples"], *wide)


def with_batches(df, key, batch_size, out="batch"):
    """Fixed-size batches in key order; the last one may be shorter."""
    return dense_index(df, key, "_i").withColumn(out, F.floor(F.col("_i") / batch_size)).drop("_i")


def latest_run(runs, keys, ts, date=None, tie=()):
    """The newest row per key, or the row of a chosen time."""
    if date is not None:
        runs = runs.where(F.col(ts) == F.lit(date))
    rank = F.struct(ts, *tie)
    rest = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")
