"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's words are hashed, its grams of ``gram`` words are hashed from those, and the least gram hash of every
``window - gram + 1`` consecutive grams is a fingerprint. Two texts that share ``window`` words share a
fingerprint, whichever texts surround it. Fingerprints of the items are met with those of all documents; a meeting
place is extended word by word, and counts when at least ``window`` words agree. Every hit window holds a
fingerprint, so the union over meeting places is all that is hit. Items shorter than the window are one window each, found by
the hash of as many words, at every place of a document, and compared by their words.

The items' fingerprints are broadcast only if counting them finds at most ``broadcast_rows``; beyond, the
fingerprints meet in a shuffle and only texts with a meeting place are read again.

Edges: null and empty texts have no words and no hits. Rows keep their keys: a key may be null or repeated, each
row is judged by its own text. An item without an id marks words but is not counted or listed; a repeated id counts once.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000


def words(text):
    """Lower-cased words of a text as an array; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def _let(value, body):
    """``body`` of ``value``, evaluated once: a column named in a lambda would be worked out again for every element
    wherever the optimizer moves its expression there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(length, size):
    """1-based starts of the runs of ``size`` in an array of ``length``."""
    return F.when(F.col(length) >= size, F.sequence(F.lit(1), F.col(length) - (size - 1))).otherwise(F.array().cast("array<int>"))


def _grams(hashes, length, size):
    return _let(F.col(hashes), lambda h: F.transform(_places(length, size), lambda i: F.xxhash64(F.slice(h, i, size))))


def _hashed(df, key, text):
    """Columns _k, _x (hash of the text), w (words), n (how many), h (hashes of words)."""
    rows = df.select(F.col(key).alias("_k"), F.xxhash64(F.col(text)).alias("_x"), words(F.col(text).cast("string")).alias("w"))
    return rows.select("*", F.size("w").alias("n")).select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


def _winnowed(rows, gram, window):
    """Adds g (hashes of grams) and f (least of every run of grams a window spans)."""
    run = window - gram + 1
    rows = rows.select("*", _grams("h", "n", gram).alias("g"))
    return rows.select("*", _let(F.col("g"), lambda g: F.transform(_places("n", window), lambda i: F.array_min(F.slice(g, i, run)))).alias("f"))


def _around(i, size, gram, window):
    """The words before a gram and after it, nearest first, as two arrays: all that a window around it can hold."""
    reach = window - gram
    first = F.greatest(i - reach, F.lit(1))
    before = F.reverse(F.slice("w", first, i - first))
    return before, F.slice("w", i + gram, F.lit(reach)), F.slice("w", i, F.lit(gram))


def _seeds(rows, at, gram, window):
    """A row for each place (1-based) in ``at``: the fingerprint there, and the words around."""
    rows = rows.select("_k", "_x", "w", "g", F.explode(at).alias("p"))
    before, after, own = _around(F.col("p"), "n", gram, window)
    return rows.select("_k", "_x", "p", F.element_at("g", F.col("p")).alias("f"), before.alias("before"), after.alias("after"), own.alias("own"))


def _agreeing(a, b):
    """How many leading elements of two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.array_position(same, F.lit(False)) > 0, F.array_position(same, F.lit(False)) - 1).otherwise(F.size(same)).cast("int")


def _item_fingerprints(items, gram, window):
    run = window - gram + 1
    rows = _winnowed(items.where(F.col("n") >= window), gram, window)
    best = lambda f, i: F.array_max(F.slice(f, F.greatest(i - (run - 1), F.lit(1)), F.least(i, F.lit(run))))
    both = F.struct("f", "g")
    chosen = _let(both, lambda x: F.filter(_places("n", gram), lambda i: best(x["f"], i) == F.element_at(x["g"], i)))
    seeds = _seeds(rows, chosen, gram, window).drop("_x", "p")
    return seeds.select(F.col("_k").alias("item"), "f", F.col("before").alias("ib"), F.col("after").alias("ia"), F.col("own").alias("io")).distinct()


def _joined(rows, found, on, limit):
    """Rows whose ``on`` is in ``found``: broadcast if counted small, else by shuffle."""
    return rows.join(F.broadcast(found) if found.limit(limit + 1).count() <= limit else found, on)


def _long_hits(docs, items, gram, window, limit):
    found = _item_fingerprints(items, gram, window)
    marks = found.select("f").distinct()
    rows = _winnowed(docs, gram, window)
    small = marks.limit(limit + 1).count() <= limit
    where = lambda f: _let(F.col("g"), lambda g: F.filter(_places("n", gram), lambda i: F.element_at(g, i) == f))
    met = rows.select("*", F.explode(F.array_distinct("f")).alias("m"))
    if small:
        met = met.join(F.broadcast(marks.withColumnRenamed("f", "m")), "m")
        seeds = _seeds(met, where(F.col("m")), gram, window)
    else:
        met = met.select("_k", "_x", "m").distinct().join(marks.withColumnRenamed("f", "m"), "m")
        met = met.groupBy(F.col("_k").alias("_k2"), F.col("_x").alias("_x2")).agg(F.collect_set("m").alias("ms"))
        rows = rows.join(met, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_x") == F.col("_x2"))).drop("_k2", "_x2")
        at = _let(F.struct("g", "ms"), lambda x: F.filter(_places("n", gram), lambda i: F.array_contains(x["ms"], F.element_at(x["g"], i))))
        seeds = _seeds(rows, at, gram, window)
    pairs = seeds.join(F.broadcast(found) if small and found.limit(limit + 1).count() <= limit else found, "f").where(F.col("own") == F.col("io"))
    pairs = pairs.select("_k", "_x", "item", "p", _agreeing("before", "ib").alias("a"), _agreeing("after", "ia").alias("b"))
    return pairs.where(F.col("a") + F.col("b") + gram >= window).select(
        "_k", "_x", "item", (F.col("p") - F.col("a")).alias("lo"), (F.col("p") + gram + F.col("b")).alias("hi"))


def _short_hits(docs, items, size, limit):
    """Hits of the items of exactly ``size`` words."""
    found = items.where(F.col("n") == size).select(F.col("_k").alias("item"), F.xxhash64("h").alias("m"), F.col("w").alias("iw")).distinct()
    rows = docs.select("_k", "_x", "w", F.posexplode(_grams("h", "n", size)).alias("p", "m"))
    rows = rows.select("_k", "_x", "m", (F.col("p") + 1).alias("lo"), F.slice("w", F.col("p") + 1, size).alias("own"))
    met = _joined(rows, found, "m", limit).where(F.col("own") == F.col("iw"))
    return met.select("_k", "_x", "item", "lo", (F.col("lo") + size).alias("hi"))


def hit_spans(documents, benchmark, key="doc_id", text="text", item_key="item_id", item_text="text", gram=5, window=13, broadcast_rows=BROADCAST_ROWS) -> DataFrame:
    """Rows (_k, _x, item, lo, hi): words lo to hi - 1 (from 1) of a document stand in an item."""
    docs, items = _hashed(documents, key, text), _hashed(benchmark, item_key, item_text)
    short = [r.n for r in items.where((F.col("n") < window) & (F.col("n") > 0)).select("n").distinct().collect()]
    parts = [_long_hits(docs, items, gram, window, broadcast_rows), *(_short_hits(docs, items, m, broadcast_rows) for m in sorted(short))]
    return reduce(DataFrame.unionByName, parts)


def contamination(documents, benchmark, key="doc_id", text="text", share=20, **options):
    """Rows (key, _x, n_words, n_hit, n_items, items_sha256, contaminated), one per row of ``documents``.

    A document is contaminated if at least 1 / ``share`` of its words, and any, are hit."""
    from pyspark.sql import Window

    spans = hit_spans(documents, benchmark, key, text, **options)
    ends = spans.groupBy("_k", "_x", "lo").agg(F.max("hi").alias("hi"), F.collect_set("item").alias("items"))
    before = F.max("hi").over(Window.partitionBy("_k", "_x").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("_k", "_x", "items", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(before, F.lit(0)))).alias("new"))
    hits = ends.groupBy("_k", "_x").agg(F.sum("new").cast("long").alias("hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    hits = hits.select(F.col("_k").alias("_k2"), F.col("_x").alias("_x2"), "hit", F.sort_array(F.transform("items", lambda i: i.cast("string"))).alias("items"))
    rows = documents.select(F.col(key).alias("_k"), F.xxhash64(F.col(text)).alias("_x"), F.size(words(F.col(text).cast("string"))).cast("long").alias("n_words"))
    rows = rows.join(hits, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_x") == F.col("_x2")), "left")
    n_hit = F.coalesce("hit", F.lit(0))
    return rows.select(
        F.col("_k").alias(key), "_x", "n_words", n_hit.cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
u AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
      FROM (SELECT d.*, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM v) WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, i, u.m FROM u JOIN v USING (g, m)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
