"""Buckets, histograms and divergence curves."""

from pyspark.sql import functions as F

from textdist.operators import cluster, histogram as H
from textdist.plans import scorers
from textdist.functions.keys import hash_index
from textdist.registry.base import query, table, vector_sides, vectors
from textdist.registry.vectors import CENTRES, VEC, label_centres

HIST = """h AS (SELECT label AS bucket, count(*) FILTER (vec_id % 2 = 0) / (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) AS p,
    count(*) FILTER (vec_id % 2 = 1) / (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 1) AS q FROM embeddings GROUP BY label)"""
# The same per source: a document's language is its bucket.
LANG = "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END"
HALF = "CAST('0x' || substr(md5('3-' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % 2"
HIST_BY = f"""c AS (SELECT source, {LANG} AS bucket, count(*) FILTER ({HALF} = 0) AS a, count(*) FILTER ({HALF} = 1) AS b FROM documents GROUP BY 1, 2),
  h AS (SELECT source, bucket, a / sum(a) OVER (PARTITION BY source) AS p, b / sum(b) OVER (PARTITION BY source) AS q FROM c)"""


def hist(spark, d):
    return H.histogram(vectors(spark, d), "label", buckets=10)


def hist_by_source(spark, d):
    bucket = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    # A source has ids of one parity only, so a hash halves it.
    half = F.when(hash_index(3, F.lit(2), F.col("doc_id")) == 0, "p").otherwise("q")
    docs = table(spark, d, "documents").select("source", half.alias("side"), bucket.alias("bucket"))
    return H.histogram(docs, by=["source"])


def kl(a, b):
    return f"CASE WHEN {a} > 0 THEN (CASE WHEN {b} > 0 THEN {a} * ln({a} / {b}) ELSE CAST('inf' AS DOUBLE) END) ELSE 0 END"


def curve(by=""):
    r = "(w * p + (1 - w) * q)"
    group = f"GROUP BY {by} i"
    ends = f"(SELECT DISTINCT {by} 1 AS one FROM h)"
    return f"""w AS (SELECT i, 1e-6 + (i - 1) * (1 - 2e-6) / 24 AS w FROM range(1, 26) r(i)),
  z AS (SELECT {by} i, exp(-5 * greatest(0, sum({kl('q', r)}))) AS x, exp(-5 * greatest(0, sum({kl('p', r)}))) AS y FROM h, w {group}),
  curve AS (SELECT {by} 0 AS i, 1.0 AS x, 0.0 AS y FROM {ends} UNION ALL SELECT {by} i, x, y FROM z UNION ALL SELECT {by} 26, 0.0, 1.0 FROM {ends})"""


def area(by=""):
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    return f"""s AS (SELECT {by} x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, x + lag(x) OVER w AS sx, y + lag(y) OVER w AS sy FROM curve
    WINDOW w AS ({part} ORDER BY i)),
  m AS (SELECT {by} abs(sum(dx * sy / 2)) AS a, abs(sum(dy * sx / 2)) AS b FROM s {'GROUP BY ' + by.rstrip(', ') if by else ''})"""


FRONTIER = """2 * sum(CASE WHEN p = 0 AND q = 0 THEN 0 WHEN p = 0 THEN q / 4 WHEN q = 0 THEN p / 4 WHEN abs(p - q) > 1e-8
  THEN 0.25 * (p + q) - 0.5 * p * q * (ln(p) - ln(q)) / (p - q) ELSE 0 END)"""


def angles(by=""):
    return f"""t AS (SELECT i AS theta, tan(i * pi() / 2000) AS t FROM range(1, 1000) r(i)),
  prc AS (SELECT {by} theta, greatest(0, least(1, sum(least(t * p, q)))) AS alpha, greatest(0, least(1, sum(least(p, q / t)))) AS beta FROM h, t GROUP BY {by} theta)"""


def f_score(beta):
    return f"(1 + {beta * beta}) * (alpha * beta) / ({beta * beta} * alpha + beta + 1e-10)"


def rounded(df, *keys, digits=9):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


@query("bucket_count", """SELECT label, greatest(2, CAST(round_even(least(count(*) FILTER (vec_id % 2 = 0), count(*) FILTER (vec_id % 2 = 1)) / 10.0, 0) AS INTEGER)) AS buckets
  FROM embeddings GROUP BY label""")
def bucket_count(spark, d):
    sides = vectors(spark, d).groupBy("label").agg(
        F.count(F.when(F.col("side") == "p", 1)).alias("n"), F.count(F.when(F.col("side") == "q", 1)).alias("m"))
    return sides.select("label", H.bucket_count_column(F.col("n"), F.col("m")).alias("buckets"))


@query("assign_to_centroids", f"""WITH {CENTRES} SELECT vec_id, CAST(arg_min(bucket, list_distance(x, c)) AS INTEGER) AS bucket FROM ({VEC}), c GROUP BY vec_id""")
def assign(spark, d):
    return cluster.assign_to_centroids(vectors(spark, d), label_centres(spark, d)).select("vec_id", "bucket")


@query("assign_to_centroids_blocks", f"""WITH {CENTRES} SELECT vec_id, CAST(arg_min(bucket, list_distance(x, c)) AS INTEGER) AS bucket FROM ({VEC}), c GROUP BY vec_id""")
def assign_blocks(spark, d):
    """The block-join form that large centroid sets take."""
    return cluster.assign_to_centroids(vectors(spark, d), label_centres(spark, d), block_rows=4, limit=0).select("vec_id", "bucket")


@query("histogram", f"WITH {HIST} SELECT bucket, round(p, 9) AS p, round(q, 9) AS q FROM h")
def histogram(spark, d):
    return rounded(hist(spark, d), "bucket")


@query("histogram_by_source", f"WITH {HIST_BY} SELECT source, bucket, round(p, 9) AS p, round(q, 9) AS q FROM h")
def histogram_by(spark, d):
    return rounded(hist_by_source(spark, d), "source", "bucket")


@query("kl_divergence", f"WITH {HIST} SELECT round(sum({kl('p', 'q')}), 9) AS kl_pq, round(sum({kl('q', 'p')}), 9) AS kl_qp FROM h")
def kl_divergence(spark, d):
    return rounded(H.kl_divergence(hist(spark, d)))


@query("divergence_curve", f"WITH {HIST}, {curve()} SELECT CAST(i AS INTEGER) AS i, round(x, 9) AS x, round(y, 9) AS y FROM curve")
def divergence_curve(spark, d):
    return rounded(H.divergence_curve(hist(spark, d)), "i")


@query("area_under_curve", f"WITH {HIST}, {curve()}, {area()} SELECT round(a, 9) AS y_over_x, round(b, 9) AS x_over_y FROM m")
def areas(spark, d):
    c = H.divergence_curve(hist(spark, d))
    other = H.area_under_curve(c, "y", "x").select("area").scalar()
    return H.area_under_curve(c).select(F.round("area", 9).alias("y_over_x"), F.round(other, 9).alias("x_over_y"))


@query("mauve", f"WITH {HIST}, {curve()}, {area()} SELECT round((a + b) / 2, 9) AS mauve FROM m")
def mauve(spark, d):
    return rounded(H.mauve(H.divergence_curve(hist(spark, d))))


@query("frontier_integral", f"WITH {HIST} SELECT round({FRONTIER}, 9) AS frontier_integral FROM h")
def frontier(spark, d):
    return rounded(H.frontier_integral(hist(spark, d)))


@query("pr_curve", f"WITH {HIST}, {angles()} SELECT CAST(theta AS INTEGER) AS theta, round(alpha, 9) AS alpha, round(beta, 9) AS beta FROM prc")
def pr_curve(spark, d):
    return rounded(H.pr_curve(hist(spark, d)), "theta")


@query("f_beta", f"WITH {HIST}, {angles()} SELECT CAST(theta AS INTEGER) AS theta, round({f_score(1.0)}, 9) AS f1 FROM prc")
def f_beta(spark, d):
    return H.pr_curve(hist(spark, d)).select("theta", F.round(H.f_beta(F.col("alpha"), F.col("beta")), 9).alias("f1"))


BOTH = f"round(max({f_score(0.125)}), 8) AS precision, round(max({f_score(8.0)}), 8) AS recall"


@query("curve_scores", f"WITH {HIST}, {angles()} SELECT {BOTH} FROM prc")
def curve_scores(spark, d):
    return rounded(H.curve_scores(H.pr_curve(hist(spark, d))), digits=8)


@query("divergence_metrics_by_source", f"""WITH {HIST_BY}, {curve('source, ')}, {area('source, ')}, {angles('source, ')},
  f AS (SELECT source, {FRONTIER} AS frontier_integral FROM h GROUP BY source), b AS (SELECT source, {BOTH} FROM prc GROUP BY source)
  SELECT source, round((m.a + m.b) / 2, 8) AS mauve, round(frontier_integral, 8) AS frontier_integral, precision, recall FROM m JOIN f USING (source) JOIN b USING (source)""")
def metrics_by_source(spark, d):
    return rounded(H.divergence_metrics(hist_by_source(spark, d), by=["source"]), "source", digits=8)


@query("kmeans_buckets")
def kmeans(spark, d):
    v = vectors(spark, d)
    return cluster.kmeans_buckets(v.select("vec_id", "x", "side"), 20, restarts=3, max_iter=50).groupBy("bucket", "side").agg(F.count("*").alias("n"))


@query("mauve_call")
def mauve_call(spark, d):
    p, q = vector_sides(spark, d)
    return scorers.mauve_call(p, q, "vec_id")[0]


@query("mauve_scorer")
def mauve_scorer(spark, d):
    p, q = vector_sides(spark, d)
    return scorers.mauve_scorer(p, q, "vec_id")
