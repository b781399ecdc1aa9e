"""Sharding by extendible hashing, in DataFrame functions only.

A row's hash is 60 bits of the MD5 of its key. A bucket is a prefix of those bits; one over the byte limit
splits on its next bit, all others stay, so the directory is deep only where data is dense. The directory
is found from sums over cells (prefixes a few bits longer than an even spread needs), at every depth at once;
only cells that are over the limit themselves are opened further, by more bits.

Edges: null texts weigh 0 bytes; a null key hashes like the empty string. A bucket of one row is never split, and
rows of equal keys never part: such a shard may pass the limit and says so (``fits`` false). An empty table has no shards.
"""

import math

from pyspark.sql import functions as F

from textdist.session import cut_lineage

BITS = 60
#: bits beyond an even spread at first, and added to what is still too large
FIRST_BITS, MORE_BITS = 4, 8
BROADCAST_CELLS = 500_000


def hashed(key):
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _leaves(cells, bits, above, limit):
    """For cells (prefix of ``bits`` bits, bytes, rows): the depth over ``above`` at which each one's bucket is settled, or null."""
    each = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(above), F.lit(bits))).alias("depth"))
    each = each.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    nodes = each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    done = nodes.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS))
    met = each.select("cell", "depth", "prefix").join(done, ["depth", "prefix"])
    first = met.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("leaf"))
    return cells.select("cell").join(first, "cell", "left").select("cell", "leaf.*")


def assign(df, key="doc_id", text="text", limit=1 << 20):
    """Rows (key, n_bytes, shard, depth, shard_bytes, shard_rows, fits), one per row of ``df``; ``shard`` is the bucket's bits."""
    rows = cut_lineage(df.select(F.col(key).alias("_k"), hashed(F.col(key)).alias("h"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits, above, left, settled = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + FIRST_BITS), 0, rows, []
    while True:
        cell = F.shiftright("h", BITS - bits)
        cells = left.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        leaves = cut_lineage(_leaves(cells, bits, above, limit))
        small = leaves.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
        met = left.withColumn("cell", cell).join(F.broadcast(leaves) if small else leaves, "cell").drop("cell")
        settled.append(met.where("depth IS NOT NULL"))
        if bits == BITS or leaves.where("depth IS NULL").isEmpty():
            break
        left = met.where("depth IS NULL").select("_k", "h", "n_bytes")
        above, bits = bits + 1, min(BITS, bits + MORE_BITS)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    name = F.expr("CASE WHEN depth = 0 THEN '' ELSE lpad(conv(prefix, 10, 2), depth, '0') END")
    return out.select(F.col("_k").alias(key), "n_bytes", name.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", (F.col("shard_bytes") <= limit).alias("fits"))


def write_shards(df, directory, path, key="doc_id"):
    """Write the rows of ``df`` in a folder for each shard. ``directory`` is ``assign``'s result, one row for each key."""
    where = directory.select(F.col(key).alias("_k"), F.concat(F.lit("b"), "shard").alias("shard")).distinct()
    rows = df.join(where, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    rows.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)


SQL = """
WITH r AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, coalesce(strlen(text), 0) AS n_bytes FROM documents),
n AS (SELECT d AS depth, h >> CAST(60 - d AS BIGINT) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM r, (SELECT unnest(range(0, 61)) AS d) GROUP BY ALL),
f AS (SELECT * FROM n WHERE shard_bytes <= 1048576 OR shard_rows = 1 OR depth = 60),
a AS (SELECT r.doc_id, r.h, r.n_bytes, min(depth) AS depth FROM r JOIN f ON f.prefix = r.h >> CAST(60 - f.depth AS BIGINT) GROUP BY ALL)
SELECT a.doc_id, a.n_bytes, right(CAST(CAST(a.h >> CAST(60 - a.depth AS BIGINT) AS BIT) AS VARCHAR), CAST(a.depth AS INT)) AS shard, CAST(a.depth AS INT) AS depth,
       f.shard_bytes, f.shard_rows, f.shard_bytes <= 1048576 AS fits
FROM a JOIN f ON f.depth = a.depth AND f.prefix = a.h >> CAST(60 - a.depth AS BIGINT)
"""
