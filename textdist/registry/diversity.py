"""n-gram tables, Distinct-n and Self-BLEU over whole texts."""

from pyspark.sql import functions as F

from textdist.functions.text import word_count
from textdist.operators import ngrams, self_bleu as B
from textdist.plans import evaluate, scorers
from textdist.registry.base import query, table

GRAMS = """t AS (SELECT doc_id, source, string_split(text, ' ') AS tk, len(string_split(text, ' ')) AS len FROM documents),
  w AS (SELECT doc_id, source, unnest(tk) AS a, generate_subscripts(tk, 1) AS i FROM t),
  l AS (SELECT doc_id, source, a, lead(a, 1) OVER d AS b, lead(a, 2) OVER d AS c, lead(a, 3) OVER d AS e FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
  g AS (SELECT doc_id, source, 1 AS n, a AS gram FROM l UNION ALL SELECT doc_id, source, 2, a || ' ' || b FROM l WHERE b IS NOT NULL
    UNION ALL SELECT doc_id, source, 3, a || ' ' || b || ' ' || c FROM l WHERE c IS NOT NULL
    UNION ALL SELECT doc_id, source, 4, a || ' ' || b || ' ' || c || ' ' || e FROM l WHERE e IS NOT NULL)"""


@query("unigram_frequencies", "SELECT token AS gram, count(*) AS freq FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) GROUP BY token")
def unigrams(spark, d):
    return ngrams.ngram_frequencies(table(spark, d, "documents"), "text", [1]).select("gram", "freq")


@query("ngram_spectrum", f"""WITH {GRAMS} SELECT CAST(n AS BIGINT) AS n, freq, count(*) AS grams FROM
  (SELECT n, gram, count(*) AS freq FROM g GROUP BY n, gram) GROUP BY n, freq""")
def spectrum(spark, d):
    return ngrams.ngram_frequencies(table(spark, d, "documents"), "text").groupBy(
        F.col("n").cast("bigint").alias("n"), "freq").agg(F.count("*").alias("grams"))


DISTINCT = """SELECT {by} CAST(n AS BIGINT) AS n, CAST(count(DISTINCT gram) AS BIGINT) AS uniq, count(*) AS total,
  round(count(DISTINCT gram) / count(*), 9) AS distinct_n FROM g GROUP BY {by} n"""


@query("distinct_n", f"WITH {GRAMS} " + DISTINCT.format(by=""))
def distinct(spark, d):
    out = ngrams.distinct_n(table(spark, d, "documents"), "text")
    return out.select(F.col("n").cast("bigint").alias("n"), "uniq", "total", F.round("distinct_n", 9).alias("distinct_n"))


@query("distinct_n_by_source", f"WITH {GRAMS} " + DISTINCT.format(by="source,"))
def distinct_by_source(spark, d):
    out = ngrams.distinct_n(table(spark, d, "documents"), "text", by=["source"])
    return out.select("source", F.col("n").cast("bigint").alias("n"), "uniq", "total", F.round("distinct_n", 9).alias("distinct_n"))


# The largest count of a gram in any other text, by definition, text by text.
LEAVE_ONE_OUT = GRAMS + """,
  k AS (SELECT {by} doc_id, n, gram, count(*) AS c FROM g GROUP BY {by} doc_id, n, gram),
  o AS (SELECT {by} doc_id, n, c, max(c) OVER (PARTITION BY {by} n, gram ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING
    EXCLUDE CURRENT ROW) AS other FROM k),
  m AS (SELECT doc_id, CAST(coalesce(sum(CASE WHEN n = 1 THEN least(c, coalesce(other, 0)) END), 0) AS BIGINT) AS match_1,
    CAST(coalesce(sum(CASE WHEN n = 2 THEN least(c, coalesce(other, 0)) END), 0) AS BIGINT) AS match_2,
    CAST(coalesce(sum(CASE WHEN n = 3 THEN least(c, coalesce(other, 0)) END), 0) AS BIGINT) AS match_3,
    CAST(coalesce(sum(CASE WHEN n = 4 THEN least(c, coalesce(other, 0)) END), 0) AS BIGINT) AS match_4 FROM o GROUP BY doc_id),
  r AS (SELECT a.doc_id, arg_min(b.len, abs(b.len - a.len) * 10000000 + b.len) AS closest_len FROM t a JOIN t b
    ON a.doc_id <> b.doc_id {same} GROUP BY a.doc_id)"""
ALL = LEAVE_ONE_OUT.format(by="", same="")
BY_SOURCE = LEAVE_ONE_OUT.format(by="source,", same="AND a.source = b.source")


def bleu_sql(order):
    logs = " + ".join(
        f"{1.0 / order!r} * ln((CASE WHEN match_{n} = 0 THEN 0.1 ELSE match_{n} END) / greatest(1, len - {n - 1}))" for n in range(1, order + 1))
    return f"""CASE WHEN len = 0 OR match_1 = 0 THEN 0.0 ELSE
    (CASE WHEN len > closest_len THEN 1.0 ELSE exp(1 - closest_len / len) END) * exp({logs}) END"""


@query("closest_lengths", f"WITH {ALL} SELECT DISTINCT CAST(len AS BIGINT) AS len, CAST(closest_len AS BIGINT) AS closest_len FROM t JOIN r USING (doc_id)")
def closest(spark, d):
    lengths = table(spark, d, "documents").select("doc_id", word_count(F.col("text")).alias("len"))
    return B.closest_lengths(lengths).select(F.col("len").cast("bigint").alias("len"), F.col("closest_len").cast("bigint").alias("closest_len"))


@query("leave_one_out_matches", f"""WITH {ALL} SELECT doc_id, CAST(len AS BIGINT) AS len, CAST(closest_len AS BIGINT) AS closest_len,
  match_1, match_2, match_3, match_4 FROM t JOIN r USING (doc_id) JOIN m USING (doc_id)""")
def matches(spark, d):
    out = B.leave_one_out_matches(table(spark, d, "documents"), "doc_id", "text", 4)
    return out.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in out.columns[1:]])


@query("sentence_bleu", f"WITH {ALL} SELECT doc_id, round({bleu_sql(4)}, 9) AS bleu FROM t JOIN r USING (doc_id) JOIN m USING (doc_id)")
def sentence(spark, d):
    return B.sentence_bleu(table(spark, d, "documents"), "doc_id", "text", 4).select("doc_id", F.round("bleu", 9).alias("bleu"))


SAMPLED = """s AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER ({part} ORDER BY md5('12345-' || CAST(doc_id AS VARCHAR)), doc_id) AS k,
    count(*) OVER ({part}) AS c FROM documents) WHERE k <= floor(c * 0.2))"""
ORDERS = " UNION ALL ".join(f"SELECT {n} AS n, {bleu_sql(n)} AS b FROM x" for n in (1, 2, 3, 4))


@query("self_bleu", f"""WITH {ALL}, {SAMPLED.format(part='')}, x AS (SELECT * FROM t JOIN r USING (doc_id) JOIN m USING (doc_id) JOIN s USING (doc_id)),
  b AS ({ORDERS}) SELECT CAST(n AS BIGINT) AS n, round(avg(b), 9) AS bleu, count(*) AS n_samples FROM b GROUP BY n""")
def self_bleu(spark, d):
    out = B.self_bleu(table(spark, d, "documents"), "doc_id", "text", [1, 2, 3, 4])
    return out.select(F.col("n").cast("bigint").alias("n"), F.round("bleu", 9).alias("bleu"), "n_samples")


SCORED = """, d AS (SELECT {by} n, count(DISTINCT gram) / count(*) AS v FROM g GROUP BY {by} n),
  x AS (SELECT t.source, {bleu} AS b FROM t JOIN r USING (doc_id) JOIN m USING (doc_id) JOIN s USING (doc_id))
  SELECT {by} 'distinct-' || n AS name, round(v, 9) AS value FROM d
  UNION ALL SELECT {by} 'bleu-4', round(avg(b), 9) FROM x {group}
  UNION ALL SELECT {by} 'n_samples', CAST(count(*) AS DOUBLE) FROM x {group}"""


@query("diversity_scorer", f"WITH {ALL}, {SAMPLED.format(part='')}" + SCORED.format(by="", bleu=bleu_sql(4), group=""))
def diversity(spark, d):
    return scorers.diversity(table(spark, d, "documents"), "doc_id", "text").select("name", F.round("value", 9).alias("value"))


@query("diversity_by_run", f"WITH {BY_SOURCE}, {SAMPLED.format(part='PARTITION BY source')}"
       + SCORED.format(by="source,", bleu=bleu_sql(4), group="GROUP BY source"))
def diversity_by_run(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("formatted_text"))
    return evaluate.evaluate_diversity(rows, "doc_id", run="source").select("source", "name", F.round("value", 9).alias("value"))
