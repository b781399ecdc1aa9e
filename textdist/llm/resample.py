"""Importance resampling towards a target distribution.

A feature is a run of consecutive words; it falls into one of a fixed number of buckets by its CRC. The gain of a bucket is
the logarithm of how much more often the target holds it than the documents do. A document's weight is the sum of the gains
of its features; noise from its id (Gumbel) turns "highest score" into a weighted draw without replacement.

Inside a task Arrow kernels do the work: lower case, split by a pattern, flatten, encode as a dictionary; neighbours'
dictionary indices form longer runs, CRCs are taken of distinct runs only, gains are taken by index and summed per
text. Across tasks there are two passes over the texts. The first gives counts per bucket (``buckets`` rows a task, so the
driver gets ``buckets`` rows), the second one narrow row per document. Ranks come from a range-partitioned sort of the
narrow rows, never from one task.

Edges: null and empty texts have no features and weight 0. Rows keep their keys; repeated rows are scored each for itself.
A null key scores like an empty one and is last among ties, then fewer features, then lower weight come first. An empty table gives no rows; an empty target
gives gains as if it held each bucket once. Other columns are left alone.
"""

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import functions as F

from textdist.llm.bytesbatch import slices, sums
from textdist.operators.sampling import numbered
from textdist.session import cut_lineage

#: bytes between words, of lower-cased text
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(texts):
    """Dictionary-encoded words of an Arrow string array and the bounds of each text in them."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), GAP)
    flat = pc.list_flatten(parts)
    some = pc.not_equal(flat, "")
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), out=bounds[1:])
    kept = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(some.to_numpy(zero_copy_only=False), out=kept[1:])
    return flat.filter(some).dictionary_encode(), kept[bounds]


def features(texts, least, most, buckets):
    """For each length of run: the bucket of each distinct run, the index of every occurrence into them, and the
    bounds of each text in the occurrences. Then the number of words of each text."""
    words, bounds = words_of(texts)
    one, index = words.dictionary, words.indices.to_numpy()
    made, runs, at, codes = [], one, np.arange(len(index)), index
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for size in range(1, most + 1):
        if size > 1:
            # a run and the word after it, where both lie in one text
            inside = at + size - 1 < len(index)
            inside[inside] = text[at[inside] + size - 1] == text[at[inside]]
            at, codes = at[inside], codes[inside]
            after = index[at + size - 1]
            pairs, codes = np.unique(codes.astype(np.int64) * max(len(one), 1) + after, return_inverse=True)
            runs = pc.binary_join_element_wise(runs.take(pa.array(pairs // max(len(one), 1))), one.take(pa.array(pairs % max(len(one), 1))), " ")
        if size >= least:
            raw = runs.cast(pa.binary()).to_pylist()
            bucket = np.fromiter(map(crc32, raw), np.int64, len(raw)) % buckets
            made.append((bucket, codes, np.searchsorted(at, bounds)))
    return made, np.diff(bounds)


def bucket_counts(df, text="text", least=1, most=1, buckets=10_000):
    """Rows (bucket, n): occurrences of features in all texts. A task sends at most ``buckets`` rows."""
    texts = df.select(F.col(text).cast("string").alias("_t"))

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "_t"):
                for bucket, codes, _ in features(part.column(0), least, most, buckets)[0]:
                    total += np.bincount(bucket[codes], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs, target, text="text", least=1, most=1, buckets=10_000):
    """Gain of every bucket in thousandths, rounded down. ``buckets`` counts of each table reach the driver."""
    both = []
    for table in (docs, target):
        counts = np.zeros(buckets, np.int64)
        for r in bucket_counts(table, text, least, most, buckets).collect():
            counts[r.bucket] = r.n
        both.append(counts.tolist())
    every, total = float(sum(both[0]) + buckets), float(sum(both[1]) + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * every / ((s + 1.0) * total))) for s, t in zip(*both)], np.int64)


def weights(docs, gain, key="doc_id", text="text", least=1, most=1):
    """Rows (key, n_words, n_features, weight), one per row of ``docs``."""
    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                made, n_words = features(part.column("_t"), least, most, buckets)
                count, weight = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
                for bucket, codes, bounds in made:
                    count += np.diff(bounds)
                    weight += sums(gain[bucket][codes], bounds)
                yield pa.RecordBatch.from_arrays([part.column("_k"), *map(pa.array, (n_words, count, weight))], names=["_k", "n_words", "n_features", "weight"])

    kind = dict(rows.dtypes)["_k"]
    return rows.mapInArrow(run, f"_k {kind}, n_words long, n_features long, weight long").withColumnRenamed("_k", key)


def noise(seed, key):
    """Gumbel noise in thousandths, rounded down, from the seed and a key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs, target, key="doc_id", text="text", seed=2024, percent=10, min_words=20, least=1, most=1, buckets=10_000):
    """Rows (key, n_features, weight, score, rank), one per row of ``docs``: the draw ranks ``percent`` of the rows with at least
    ``min_words`` words (rounded down) by score; all others have no rank."""
    gain = gains(docs, target, text, least, most, buckets)
    rows = weights(docs, gain, key, text, least, most)
    rows = cut_lineage(rows.withColumn("score", F.col("weight") + noise(seed, key)))
    able = rows.where(F.col("n_words") >= min_words)
    many = percent * able.count() // 100
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("n_features"), F.asc("weight")]
    placed = numbered(able, order, "_i")
    ranked = placed.withColumn("rank", F.when(F.col("_i") < many, F.col("_i") + 1)).drop("_i")
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(key, "n_features", "weight", "score", "rank")


def drawn(docs, ranked, key="doc_id"):
    """The rows of ``docs`` whose key the draw ranked, with all their columns."""
    return docs.join(ranked.where("rank IS NOT NULL").select(key), key, "left_semi")


SQL = r"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
w AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
x AS (SELECT side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM w),
c AS (SELECT side, doc_id, word, count(*) AS n FROM x GROUP BY ALL),
h AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM c)),
l AS (SELECT word, list_transform(range(0, len(h), 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[i + 1]) - 1) + strpos('0123456789ABCDEF', h[i + 2]) - 1) AS bytes FROM h),
k AS (SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM l, tab),
n AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM c JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT sum(s) + 10000 FROM n)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (SELECT coalesce(sum(t), 0) + 10000 FROM n)::DOUBLE))) AS BIGINT) AS gain FROM n),
f AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM c JOIN k USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM documents LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM r) THEN r END AS rank
FROM s LEFT JOIN r USING (doc_id)
"""
