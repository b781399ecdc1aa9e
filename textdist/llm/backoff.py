"""Stupid-backoff scores of every document under the n-gram counts of all others.

Relationally: n-grams of order 0 (the corpus size) to ``order`` are exploded from all texts and counted by hash; counts join the n-grams
of each document; log scores are summed per document. A document's own n-grams are taken out of the counts
it is scored by, else nothing would ever back off.

The join moves sorted hashes, not rows per n-gram. Texts are dealt into chunks of bounded size; a chunk counts its
n-grams once, however often they occur in it, and asks for their totals: its sorted hashes go to the buckets that
partition the count table by hash range, the bucket sums all that were sent, and returns to each chunk the totals in the order asked. A
frequent n-gram is so one entry per chunk and bucket. Answers meet the chunk's texts in a cogroup on the chunk.

A word's score is count(n-gram) / count(its context) for the longest n-gram that occurs elsewhere, times ``alpha`` for
every order backed off; a word that occurs nowhere else scores as if counted once, one order further.

Edges: null, empty and blank texts have no words, sum 0 and a null mean. Rows keep their keys; each row is a document of its own, so equal
rows count for each other. With no words elsewhere, the corpus size is taken as 1. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textdist.llm.bytesbatch import SPACE, flat, mix, spans
from textdist.llm.shingles import gram_hashes, lowered, span_hashes

CHUNK_BYTES = 12 << 20
ENTRIES_PER_BUCKET = 1_000_000
WHOLE = np.uint64(0x5851F42D4C957F2D)


def _shrunk(batches):
    """Texts compressed one by one, as (_t binary, _size); a text that compression does not shorten stays as it is."""
    for batch in batches:
        packed, size = [], []
        for text in batch.column("_t").cast(pa.binary()).to_pylist():
            short = None if text is None else pa.compress(text, codec="zstd", asbytes=True)
            packed.append(text if text is None or len(short) >= len(text) else short)
            size.append(None if text is None else len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_k"), batch.column("chunk"), pa.array(packed, pa.binary()), pa.array(size, pa.int64())], names=["_k", "chunk", "_t", "_size"])


def _texts(table):
    rows = zip(table.column("_t").to_pylist(), table.column("_size").to_pylist())
    return pa.chunked_array([pa.array(
        [t if t is None or len(t) == n else pa.decompress(t, n, codec="zstd", asbytes=True) for t, n in rows], pa.binary())])


def _words(table):
    data, offs = flat(_texts(table))
    data = lowered(data)
    starts, ends = spans(data, offs, SPACE)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offs)


def _grams(words, bounds, order):
    """Per order k: hash of the k words that end at each place, and whether they lie in one text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = []
    for k in range(1, order + 1):
        g, ok = np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
        if len(words) >= k:
            g[k - 1 :] = mix(gram_hashes(words, k) + np.uint64(k))
            ok[k - 1 :] = text[k - 1 :] == text[: len(words) - k + 1]
        out.append((g, ok))
    return text, out


def _distinct(grams, n):
    """Sorted distinct hashes of a chunk, that of order 0 among them, and their counts."""
    every = np.concatenate([*(g[ok] for g, ok in grams), np.full(n, WHOLE)])
    return np.unique(every, return_counts=True)


def _places(text, grams):
    """One sort of a chunk's n-grams: how many differ, the place of each among the sorted distinct hashes and how often its text has it,
    per order; and the place of order 0."""
    every = np.concatenate([*(g[ok] for g, ok in grams), np.full(min(1, len(text)), WHOLE)])
    texts = np.concatenate([*(text[ok].astype(np.int32) for _, ok in grams), np.full(min(1, len(text)), -1, np.int32)])
    order = np.argsort(every, kind="stable")  # of equal ones, those of one text stay together
    every = every[order]
    opens = np.ones(len(every), bool)
    opens[1:] = every[1:] != every[:-1]
    del every
    texts = texts[order]
    mine = opens.copy()
    mine[1:] |= texts[1:] != texts[:-1]
    del texts
    at, own = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
    at[order] = np.cumsum(opens, dtype=np.int32) - 1
    run = np.diff(np.append(np.flatnonzero(mine), len(order))).astype(np.int32)
    own[order] = np.repeat(run, run)
    cut = np.cumsum([0] + [int(ok.sum()) for _, ok in grams])
    return [(at[a:b], own[a:b]) for a, b in zip(cut, cut[1:])], at[-1] if len(at) else 0


def _split(hashes, buckets):
    """Bounds of the hash ranges of the buckets in a sorted array."""
    edges = [(b << 64) // buckets for b in range(buckets)]
    return np.r_[np.searchsorted(hashes, np.array(edges, np.uint64)), len(hashes)]


def _zip(x):
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unzip(x, n, kind):
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _packed(sorted_hashes):
    """Sorted hashes as byte planes of their differences: the high planes are nearly constant."""
    step = np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8")
    return _zip(step.view(np.uint8).reshape(-1, 8).T)


def _unpacked(x, n):
    planes = _unzip(x, n * 8, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def _asking(order, buckets):
    def ask(table):
        words, bounds = _words(table)
        _, grams = _grams(words, bounds, order)
        hashes, counts = _distinct(grams, len(words))
        cut = _split(hashes, buckets)
        some = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({
            "bucket": pa.array(some, pa.int32()), "chunk": pa.array([chunk] * len(some), pa.int32()),
            "n": pa.array([int(cut[b + 1] - cut[b]) for b in some], pa.int64()),
            "hashes": pa.array([_packed(hashes[cut[b] : cut[b + 1]]) for b in some], pa.binary()),
            "counts": pa.array([_zip(counts[cut[b] : cut[b + 1]].astype(np.int64)) for b in some], pa.binary())})

    return ask


def _answer(batches):
    """The count table of each bucket, and from it the totals of every chunk's hashes."""
    asked = {}
    for batch in batches:
        for row in batch.to_pylist():
            asked.setdefault(row["bucket"], []).append(row)
    for bucket, rows in asked.items():
        hashes = np.concatenate([_unpacked(r["hashes"], r["n"]) for r in rows])
        counts = np.concatenate([_unzip(r["counts"], r["n"], np.int64) for r in rows])
        order = np.argsort(hashes)
        opens = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
        totals = np.add.reduceat(counts[order], np.flatnonzero(opens))
        back = np.empty(len(order), np.int64)
        back[order] = totals[np.cumsum(opens) - 1]
        cut = np.r_[0, np.cumsum([r["n"] for r in rows])]
        yield pa.RecordBatch.from_arrays([
            pa.array([r["chunk"] for r in rows], pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array([r["n"] for r in rows], pa.int64()),
            pa.array([_zip(back[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())], names=["chunk", "bucket", "n", "totals"])


def _scores(words, bounds, order, alpha, totals):
    """(sum of log scores, words that backed off, words seen nowhere else) per text. ``totals`` has the count of each of the sorted
    distinct hashes."""
    text, grams = _grams(words, bounds, order)
    places, whole = _places(text, grams)
    n = len(bounds) - 1
    left = []  # counts elsewhere of the gram that ends at each place, per order
    for (g, ok), (at, own) in zip(grams, places):
        c = np.zeros(len(words), np.int64)
        c[ok] = totals[at] - own
        left.append(c)
    size = totals[whole] if len(words) else 0
    elsewhere = np.maximum(size - np.diff(bounds), 1)[text].astype(float)
    longest = np.minimum(np.arange(len(words)) - bounds[:-1][text] + 1, order)
    log, done, used = np.zeros(len(words)), np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    for k in range(order, 0, -1):
        hit = ~done & (left[k - 1] > 0)
        context = elsewhere[hit] if k == 1 else left[k - 2][np.flatnonzero(hit) - 1].astype(float)
        log[hit] = np.log(left[k - 1][hit] / context)
        used[hit] = k
        done |= hit
    log[~done] = -np.log(elsewhere[~done])
    log += (longest - used) * np.log(alpha)
    total = np.bincount(text, log, n)
    return total, np.bincount(text[used < longest], minlength=n), np.bincount(text[~done], minlength=n)


def score(df, key="doc_id", text="text", order=2, alpha=0.4):
    """Rows (key, n_words, log_score, mean_log_score, n_backed_off, n_unseen), one per row of ``df``. Natural logarithms."""
    docs = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    total = docs.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_BYTES))
    buckets = max(1, -(-total * order // (8 * ENTRIES_PER_BUCKET)))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("_k", "_t"), F.lit(chunks)).cast("int"))
    kind = dict(docs.dtypes)["_k"]
    docs = docs.select("_k", "chunk", "_t").mapInArrow(_shrunk, f"_k {kind}, chunk int, _t binary, _size long")
    asked = docs.groupBy("chunk").applyInArrow(_asking(order, buckets), "bucket int, chunk int, n long, hashes binary, counts binary")
    answers = asked.repartitionById(buckets, F.col("bucket")).mapInArrow(_answer, "chunk int, bucket int, n long, totals binary")

    def finish(left, right):
        words, bounds = _words(left)
        rows = sorted(right.select(["bucket", "n", "totals"]).to_pylist(), key=lambda r: r["bucket"])
        totals = np.concatenate([_unzip(r["totals"], r["n"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        log, off, unseen = _scores(words, bounds, order, alpha, totals)
        n = np.diff(bounds)
        mean = pa.array(np.divide(log, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)
        return pa.table({"_k": left.column("_k"), "n_words": pa.array(n), "log_score": pa.array(log), "mean_log_score": mean,
                         "n_backed_off": pa.array(off, pa.int64()), "n_unseen": pa.array(unseen, pa.int64())})

    schema = f"_k {kind}, n_words long, log_score double, mean_log_score double, n_backed_off long, n_unseen long"
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema).withColumnRenamed("_k", key)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS y FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT x, count(*) AS c FROM p GROUP BY x), ud AS (SELECT doc_id, x, count(*) AS c FROM p GROUP BY ALL),
b AS (SELECT y, x, count(*) AS c FROM p WHERE y IS NOT NULL GROUP BY ALL), bd AS (SELECT doc_id, y, x, count(*) AS c FROM p WHERE y IS NOT NULL GROUP BY ALL),
q AS (SELECT p.doc_id, i, greatest((SELECT count(*) FROM p) - len(d.w), 1) AS n, u.c - ud.c AS c1, b.c - bd.c AS c2, uy.c - udy.c AS cy
      FROM p JOIN d USING (doc_id) JOIN u USING (x) JOIN ud USING (doc_id, x) LEFT JOIN b USING (y, x) LEFT JOIN bd USING (doc_id, y, x)
      LEFT JOIN u AS uy ON uy.x = p.y LEFT JOIN ud AS udy ON udy.x = p.y AND udy.doc_id = p.doc_id),
s AS (SELECT doc_id, CASE WHEN c2 > 0 THEN ln(c2 / cy) WHEN c1 > 0 THEN ln(c1 / n) + (least(i, 2) - 1) * ln(0.4) ELSE -ln(n) + least(i, 2) * ln(0.4) END AS l,
      NOT coalesce(c2 > 0, false) AND (i > 1 OR c1 = 0) AS off, NOT coalesce(c2 > 0, false) AND c1 = 0 AS unseen FROM q),
t AS (SELECT doc_id, sum(l) AS l, count(*) FILTER (off) AS n_backed_off, count(*) FILTER (unseen) AS n_unseen FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(l, 0), 4) AS log_score, round(l / len(w), 4) AS mean_log_score,
       coalesce(n_backed_off, 0) AS n_backed_off, coalesce(n_unseen, 0) AS n_unseen FROM d LEFT JOIN t USING (doc_id)
"""

#: the same for order 3
SQL_3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS y, CASE WHEN i > 2 THEN w[i - 2] END AS z FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT x, count(*) AS c FROM p GROUP BY x), ud AS (SELECT doc_id, x, count(*) AS c FROM p GROUP BY ALL),
b AS (SELECT y, x, count(*) AS c FROM p WHERE y IS NOT NULL GROUP BY ALL), bd AS (SELECT doc_id, y, x, count(*) AS c FROM p WHERE y IS NOT NULL GROUP BY ALL),
g AS (SELECT z, y, x, count(*) AS c FROM p WHERE z IS NOT NULL GROUP BY ALL), gd AS (SELECT doc_id, z, y, x, count(*) AS c FROM p WHERE z IS NOT NULL GROUP BY ALL),
q AS (SELECT p.doc_id, i, greatest((SELECT count(*) FROM p) - len(d.w), 1) AS n, u.c - ud.c AS c1, b.c - bd.c AS c2, g.c - gd.c AS c3, uy.c - udy.c AS cy, bz.c - bdz.c AS cz
      FROM p JOIN d USING (doc_id) JOIN u USING (x) JOIN ud USING (doc_id, x) LEFT JOIN b USING (y, x) LEFT JOIN bd USING (doc_id, y, x)
      LEFT JOIN g USING (z, y, x) LEFT JOIN gd USING (doc_id, z, y, x)
      LEFT JOIN u AS uy ON uy.x = p.y LEFT JOIN ud AS udy ON udy.x = p.y AND udy.doc_id = p.doc_id
      LEFT JOIN b AS bz ON bz.y = p.z AND bz.x = p.y LEFT JOIN bd AS bdz ON bdz.y = p.z AND bdz.x = p.y AND bdz.doc_id = p.doc_id),
k AS (SELECT *, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS used FROM q),
s AS (SELECT doc_id, CASE used WHEN 3 THEN ln(c3 / cz) WHEN 2 THEN ln(c2 / cy) WHEN 1 THEN ln(c1 / n) ELSE -ln(n) END + (least(i, 3) - used) * ln(0.4) AS l,
      used < least(i, 3) AS off, used = 0 AS unseen FROM k),
t AS (SELECT doc_id, sum(l) AS l, count(*) FILTER (off) AS n_backed_off, count(*) FILTER (unseen) AS n_unseen FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(l, 0), 4) AS log_score, round(l / len(w), 4) AS mean_log_score,
       coalesce(n_backed_off, 0) AS n_backed_off, coalesce(n_unseen, 0) AS n_unseen FROM d LEFT JOIN t USING (doc_id)
"""
