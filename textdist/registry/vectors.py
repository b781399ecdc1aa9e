"""Vector preparation."""

from pyspark.sql import functions as F

from textdist.functions.vectors import euclidean, normalized
from textdist.operators import vectors as V
from textdist.registry.base import query, table, vector_sides, vectors


def exploded(df, key):
    return df.select(key, F.posexplode("x").alias("j", "v")).select(key, F.col("j").cast("bigint").alias("j"), F.round("v", 9).alias("v"))


VEC = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings"
AT = "generate_subscripts(x, 1) - 1 AS j"


@query("resolve_features", f"SELECT vec_id, {AT}, round(unnest(x), 9) AS v FROM ({VEC})")
def resolve(spark, d):
    return exploded(V.resolve_features(table(spark, d, "embeddings"), feature_col="embedding"), "vec_id")


@query("resolve_hashed_text", "SELECT doc_id, CAST(len(string_split(text, ' ')) AS DOUBLE) AS mass FROM documents")
def resolve_text(spark, d):
    # Hashed counts of a text add up to its words.
    docs = table(spark, d, "documents").select("doc_id", "text")
    return V.resolve_features(docs, text_col="text", dim=64).select("doc_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("mass"))


def shape_encoder():
    import numpy as np

    return lambda texts: np.array([[len(t), t.count(" ") + 1, t.count("\n")] for t in texts], dtype=float)


@query("featurize_callable", """SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(len(string_split(text, ' ')) AS DOUBLE) AS words,
  CAST(length(text) - length(replace(text, E'\\n', '')) AS DOUBLE) AS breaks FROM documents""")
def featurize(spark, d):
    out = V.featurize(table(spark, d, "documents").select("doc_id", "text"), "text", shape_encoder)
    return out.select("doc_id", F.col("x")[0].alias("chars"), F.col("x")[1].alias("words"), F.col("x")[2].alias("breaks"))


@query("normalize_l2", f"""WITH e AS ({VEC}), n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS n FROM e)
  SELECT vec_id, {AT}, round(unnest(list_transform(x, lambda v: v / n)), 9) AS v FROM n""")
def l2(spark, d):
    return exploded(vectors(spark, d).select("vec_id", normalized(F.col("x")).alias("x")), "vec_id")


@query("normalize_l1", f"""WITH e AS ({VEC}), n AS (SELECT vec_id, x, list_sum(list_transform(x, lambda v: abs(v))) AS n FROM e)
  SELECT vec_id, {AT}, round(unnest(list_transform(x, lambda v: v / n)), 9) AS v FROM n""")
def l1(spark, d):
    return exploded(vectors(spark, d).select("vec_id", normalized(F.col("x"), "l1").alias("x")), "vec_id")


CENTRES = f"""u AS (SELECT label, unnest(x) AS v, {AT} FROM ({VEC})),
  c AS (SELECT label AS bucket, list(m ORDER BY j) AS c FROM (SELECT label, j, avg(v) AS m FROM u GROUP BY label, j) GROUP BY label)"""


def label_centres(spark, d):
    means = vectors(spark, d).select("label", F.posexplode("x").alias("j", "v")).groupBy("label", "j").agg(F.avg("v").alias("v"))
    # One entry per dimension.
    return means.groupBy(F.col("label").alias("bucket")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("x"))


@query("distance_to_centre", f"""WITH {CENTRES} SELECT vec_id, round(list_distance(x, c), 9) AS distance FROM ({VEC}) e JOIN c ON c.bucket = e.label""")
def distance(spark, d):
    centres = label_centres(spark, d).select(F.col("bucket").alias("label"), F.col("x").alias("c"))
    return vectors(spark, d).join(centres, "label").select("vec_id", F.round(euclidean(F.col("x"), F.col("c")), 9).alias("distance"))


@query("cumulative_variance", f"""WITH u AS (SELECT unnest(x) AS v, {AT} FROM ({VEC})), s AS (SELECT j, var_pop(v) AS s FROM u GROUP BY j),
  r AS (SELECT j, s / (SELECT sum(s) FROM s) AS ratio FROM s), c AS (SELECT row_number() OVER (ORDER BY ratio DESC, j) AS i, sum(ratio) OVER (ORDER BY ratio DESC, j) AS cum FROM r)
  SELECT CAST(i AS BIGINT) AS i, round(cum, 9) AS cumulative, CASE WHEN i = (SELECT min(i) FROM c WHERE cum >= 0.9) THEN 1 ELSE 0 END AS reached FROM c""")
def cumulative(spark, d):
    from pyspark.sql import Window

    spread = vectors(spark, d).select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.var_pop("v").alias("s"))
    # One row per dimension from here on.
    ranked = spread.select("j", (F.col("s") / F.sum("s").over(Window.partitionBy(F.lit(1)))).alias("ratio")).select(
        "ratio", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("ratio"), "j")).cast("bigint").alias("i"))
    total = V.cumulative_variance(ranked, "ratio", "i")
    first = F.min(F.when(F.col("cumulative") >= 0.9, F.col("i"))).over(Window.partitionBy(F.lit(1)))
    return total.select("i", F.round("cumulative", 9).alias("cumulative"), F.when(F.col("i") == first, 1).otherwise(0).alias("reached"))


@query("pca_projection")
def pca(spark, d):
    p, q = V.reduce_pca(*vector_sides(spark, d), "vec_id")
    return p.unionByName(q).select("vec_id", F.size("x").alias("kept"))


@query("pca_whitened")
def whitened(spark, d):
    p, q = V.reduce_pca(*vector_sides(spark, d), "vec_id", whiten=True)
    return p.unionByName(q).select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(
        F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev("v"), 6).alias("deviation"))


@query("pca_skipped", f"SELECT vec_id, {AT}, round(unnest(x), 9) AS v FROM ({VEC})")
def skipped(spark, d):
    p, q = V.reduce_pca(*vector_sides(spark, d), "vec_id", explained_variance=1, norm="none")
    return exploded(p.unionByName(q), "vec_id")
