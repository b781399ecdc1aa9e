"""k-NN radii and PRDC."""

from pyspark.sql import functions as F

from textdist.operators import manifold as M
from textdist.plans import scorers
from textdist.registry.base import query, vector_sides, vectors

SIDES = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, vec_id % 2 AS q FROM embeddings)"
RADII = SIDES + """, n AS (SELECT a.vec_id, list_distance(a.x, b.x) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x)) AS r
    FROM v a JOIN v b ON a.q = b.q AND a.vec_id <> b.vec_id),
  k AS (SELECT v.vec_id, v.x, v.q, n.dist AS radius FROM v JOIN n ON n.vec_id = v.vec_id AND n.r = {k})"""
PAIRS = RADII + """, d AS (SELECT p.vec_id AS p, q.vec_id AS q, list_distance(p.x, q.x) AS dist, p.radius AS rp, q.radius AS rq
    FROM k p JOIN k q ON p.q = 0 AND q.q = 1),
  byq AS (SELECT q, max(CASE WHEN dist < rp THEN 1 ELSE 0 END) AS inside, sum(CASE WHEN dist < rp THEN 1 ELSE 0 END) AS held FROM d GROUP BY q),
  byp AS (SELECT p, max(CASE WHEN dist < rq THEN 1 ELSE 0 END) AS recalled, CASE WHEN min(dist) < any_value(rp) THEN 1 ELSE 0 END AS covered FROM d GROUP BY p)"""
PRDC = """ SELECT round((SELECT avg(inside) FROM byq), 9) AS precision, round((SELECT avg(recalled) FROM byp), 9) AS recall,
  round((SELECT avg(held) FROM byq) / {k}, 9) AS density, round((SELECT avg(covered) FROM byp), 9) AS coverage"""


@query("knn_radius", RADII.format(k=5) + " SELECT vec_id, round(radius, 9) AS radius FROM k")
def radius(spark, d):
    p, q = vector_sides(spark, d)
    both = M.knn_radius(p, "vec_id", 5).unionByName(M.knn_radius(q, "vec_id", 5))
    return both.select("vec_id", F.round("radius", 9).alias("radius"))


@query("ball_membership", PAIRS.format(k=4) + """ SELECT 'q' AS side, q AS vec_id, CAST(held AS BIGINT) AS held, CAST(inside AS BIGINT) AS hit FROM byq
  UNION ALL SELECT 'p', p, CAST(covered AS BIGINT), CAST(recalled AS BIGINT) FROM byp""")
def membership(spark, d):
    p, q = vector_sides(spark, d)
    m = M.ball_membership(p, q, "vec_id", 4)
    rows = F.array(
        F.when(F.col("wq") > 0, F.struct(F.lit("q").alias("side"), F.col("q_id").alias("vec_id"), F.col("held").alias("held"), (F.col("held") > 0).cast("bigint").alias("hit"))),
        F.when(F.col("wp") > 0, F.struct(F.lit("p").alias("side"), F.col("p_id").alias("vec_id"), F.col("covered").alias("held"), F.col("recalled").alias("hit"))))
    return m.select(F.explode(rows).alias("r")).where("r is not null").select("r.*")


def prdc_rows_sql(p, q, k=4):
    """Scorer rows ``name, value`` of two ``(id, x)`` queries, cut to equal length in id order."""
    return f"""(WITH a AS (SELECT 0 AS q, id, x, row_number() OVER (ORDER BY id) AS r FROM ({p}) UNION ALL
      SELECT 1, id, x, row_number() OVER (ORDER BY id) FROM ({q})),
    v AS (SELECT q, id, x FROM a WHERE r <= (SELECT min(m) FROM (SELECT max(r) AS m FROM a GROUP BY q))),
    n AS (SELECT s.q, s.id, list_distance(s.x, t.x) AS dist, row_number() OVER (PARTITION BY s.q, s.id ORDER BY list_distance(s.x, t.x)) AS r
      FROM v s JOIN v t ON s.q = t.q AND s.id <> t.id),
    k AS (SELECT v.q, v.id, v.x, n.dist AS radius FROM v JOIN n ON n.q = v.q AND n.id = v.id AND n.r = {k}),
    d AS (SELECT p.id AS p, q.id AS q, list_distance(p.x, q.x) AS dist, p.radius AS rp, q.radius AS rq FROM k p JOIN k q ON p.q = 0 AND q.q = 1),
    byq AS (SELECT q, max(CASE WHEN dist < rp THEN 1 ELSE 0 END) AS inside, sum(CASE WHEN dist < rp THEN 1 ELSE 0 END) AS held FROM d GROUP BY q),
    byp AS (SELECT p, max(CASE WHEN dist < rq THEN 1 ELSE 0 END) AS recalled, CASE WHEN min(dist) < any_value(rp) THEN 1 ELSE 0 END AS covered FROM d GROUP BY p)
    SELECT 'prdc.precision' AS name, round(avg(inside), 9) AS value FROM byq UNION ALL SELECT 'prdc.recall', round(avg(recalled), 9) FROM byp
    UNION ALL SELECT 'prdc.density', round(avg(held) / {k}, 9) FROM byq UNION ALL SELECT 'prdc.coverage', round(avg(covered), 9) FROM byp)"""


def rounded(df):
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


@query("prdc", PAIRS.format(k=4) + PRDC.format(k=4))
def prdc(spark, d):
    p, q = vector_sides(spark, d)
    return rounded(M.prdc(p, q, "vec_id", 4))


@query("prdc_many_blocks", PAIRS.format(k=5) + PRDC.format(k=5))
def prdc_blocks(spark, d):
    """The same with small blocks, so that pivots, bounds and routing are at work."""
    p, q = vector_sides(spark, d)
    return rounded(M.prdc(p, q, "vec_id", 5, block_rows=128))


@query("prdc_call_without_pca", PAIRS.format(k=5) + PRDC.format(k=5))
def call(spark, d):
    p, q = vector_sides(spark, d)
    return rounded(scorers.prdc_call(p, q, "vec_id", pca=False))


@query("prdc_by_label_sides", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label < 5 THEN 0 ELSE 1 END AS q FROM embeddings)
  """ + PAIRS.format(k=4)[len(SIDES):] + PRDC.format(k=4))
def by_label(spark, d):
    v = vectors(spark, d)
    return rounded(M.prdc(v.where("label < 5"), v.where("label >= 5"), "vec_id", 4))


UNIT = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, vec_id % 2 AS q FROM embeddings),
  v AS (SELECT vec_id, list_transform(x, lambda a: a / sqrt(list_sum(list_transform(x, lambda b: b * b)))) AS x, q FROM e)"""


@query("prdc_call_full_rank_pca", UNIT + PAIRS.format(k=4)[len(SIDES):] + PRDC.format(k=4))
def call_full_rank(spark, d):
    """PCA that keeps all variance turns the unit vectors and changes no distance."""
    p, q = vector_sides(spark, d)
    return rounded(scorers.prdc_call(p, q, "vec_id", k=4, pca=0.9999999999))


@query("prdc_call_with_pca")
def call_pca(spark, d):
    p, q = vector_sides(spark, d)
    return scorers.prdc_call(p, q, "vec_id", k=4)


@query("prdc_scorer")
def scorer(spark, d):
    p, q = vector_sides(spark, d)
    return scorers.prdc_scorer(p, q, "vec_id")
