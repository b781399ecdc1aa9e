"""Divergence of two distributions given as bucket histograms.

A histogram has rows ``(by…, bucket, p, q)``. All functions work per ``by`` group, so many
runs are scored in one job. Bucket counts may grow with the data: curves are computed from
partial sums per group, never from bucket × angle rows.
"""

import math
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

# Grid and scale of the divergence curve, scale of the frontier integral,
# number of angles of the precision-recall curve, and the two F-scores read from it.
CURVE_POINTS = 25
WEIGHT_MARGIN = 1e-6
MAUVE_SCALE = 5.0
FRONTIER_SCALE = 2.0
NEAR_EQUAL = 1e-8
ANGLES = 1000
F_BETA_EPSILON = 1e-10
PRECISION_BETA = 1 / 8
RECALL_BETA = 8.0


def _grouped(df, by):
    return df.groupBy(*by)


def bucket_count(n_p, n_q, num_buckets="auto"):
    """A tenth of the smaller side, rounded half to even, at least 2; or the given int."""
    if num_buckets == "auto":
        return max(2, round(min(n_p, n_q) / 10))
    if isinstance(num_buckets, bool) or not isinstance(num_buckets, int):
        raise ValueError("num_buckets must be 'auto' or an int")
    return num_buckets


def bucket_count_column(n_p, n_q):
    return F.greatest(F.lit(2), F.bround(F.least(n_p, n_q) / 10)).cast("int")


def histogram(df, bucket="bucket", side="side", by=(), buckets=None):
    """Share of each side per bucket. With ``buckets`` = K every bucket 0 … K−1 has a row.
    Rows are counted per bucket first, so a bucket with a third of all rows is one sum. A
    group with an empty side has null shares, and so null metrics."""
    by = list(by)
    counts = df.groupBy(*by, F.col(bucket).cast("int").alias("bucket")).agg(
        F.count(F.when(F.col(side) == "p", 1)).alias("_p"), F.count(F.when(F.col(side) == "q", 1)).alias("_q"))
    totals = _grouped(counts, by).agg(F.sum("_p").alias("_tp"), F.sum("_q").alias("_tq"))
    if buckets is not None:
        if by:
            spine = totals.select(*by, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
        else:
            spine = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        counts = spine.join(counts, by + ["bucket"], "left").na.fill(0, ["_p", "_q"])
    if by:
        counts, total_p, total_q = counts.join(totals, by), F.col("_tp"), F.col("_tq")
    else:
        total_p, total_q = totals.select("_tp").scalar(), totals.select("_tq").scalar()
    return counts.select(
        *by, "bucket", F.try_divide(F.col("_p"), total_p).alias("p"), F.try_divide(F.col("_q"), total_q).alias("q"))


def _kl_term(p, q):
    return (
        F.when(p.isNull() | q.isNull(), F.lit(None).cast("double")).when(p == 0, F.lit(0.0))
        .when(q > 0, p * F.log(p / q)).otherwise(F.lit(math.inf))
    )


def _not_negative(v):
    return F.when(v < 0, F.lit(0.0)).otherwise(v)


def kl_divergence(hist, by=()):
    """KL(p‖q) and KL(q‖p); infinite where one side has a bucket the other lacks."""
    p, q = F.col("p"), F.col("q")
    return _grouped(hist, by).agg(
        _not_negative(F.sum(_kl_term(p, q))).alias("kl_pq"), _not_negative(F.sum(_kl_term(q, p))).alias("kl_qp"))


def mixture_weights(points=CURVE_POINTS):
    """Even grid from 1e-6 to 1 − 1e-6."""
    step = (1 - 2 * WEIGHT_MARGIN) / max(1, points - 1)
    return [WEIGHT_MARGIN + i * step for i in range(points)]


def divergence_curve(hist, by=(), scale=MAUVE_SCALE, points=CURVE_POINTS):
    """Rows ``(by…, i, x, y)``, i = 0 … points+1. Point i mixes r = w·p + (1−w)·q and is
    exp(−scale·KL(q‖r)), exp(−scale·KL(p‖r)); the ends are (1, 0) and (0, 1)."""
    by = list(by)
    p, q, w = F.col("p"), F.col("q"), F.col("_g.w")
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(mixture_weights(points), start=1)])
    r = w * p + (1 - w) * q
    point = lambda kl: F.exp(F.lit(-scale) * _not_negative(F.sum(kl)))
    # Each task folds its buckets to one row per group and weight before anything moves.
    inner = hist.withColumn("_g", F.explode(grid)).groupBy(*by, F.col("_g.i").alias("i")).agg(
        point(_kl_term(q, r)).alias("x"), point(_kl_term(p, r)).alias("y"))
    ends = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, x, y in ((0, 1.0, 0.0), (points + 1, 0.0, 1.0))]))
    groups = _grouped(hist, by).agg(F.count("*").alias("_n"))
    return inner.unionByName(groups.select(*by, ends.alias("_e")).select(*by, "_e.*"))


def area_under_curve(curve, x="x", y="y", by=(), order="i"):
    """Trapezoid area along the curve index. The curve is monotone, so the index order is
    the value order wherever values differ."""
    by = list(by)
    along = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(order)
    part = (F.col(x) - F.lag(x).over(along)) * (F.col(y) + F.lag(y).over(along)) / 2
    return _grouped(curve.withColumn("_a", part), by).agg(F.abs(F.sum("_a")).alias("area"))


def mauve(curve, by=()):
    """Mean of the areas of y over x and x over y."""
    by = list(by)
    along = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("i")
    dx, dy = F.col("x") - F.lag("x").over(along), F.col("y") - F.lag("y").over(along)
    sx, sy = F.col("x") + F.lag("x").over(along), F.col("y") + F.lag("y").over(along)
    parts = curve.withColumn("_a", dx * sy / 2).withColumn("_b", dy * sx / 2)
    return _grouped(parts, by).agg(
        (F.lit(0.5) * (F.abs(F.sum("_a")) + F.abs(F.sum("_b")))).alias("mauve"))


def frontier_integral(hist, by=(), scale=FRONTIER_SCALE):
    p, q = F.col("p"), F.col("q")
    apart = 0.25 * (p + q) - 0.5 * (p * q * (F.log(p) - F.log(q)) / (p - q))
    term = (
        F.when(p.isNull() | q.isNull(), F.lit(None).cast("double")).when((p == 0) & (q == 0), 0.0).when(p == 0, q / 4).when(q == 0, p / 4)
        .when(F.abs(p - q) > NEAR_EQUAL, apart).otherwise(0.0)
    )
    return _grouped(hist, by).agg((F.sum(term) * F.lit(scale)).alias("frontier_integral"))


def pr_curve(hist, by=(), angles=ANGLES):
    """Rows ``(by…, theta, alpha, beta)`` for theta = 1 … angles−1, with slope
    t = tan(theta·π/2/angles), alpha = Σ min(t·p, q) and beta = Σ min(p, q/t).

    A bucket gives t·p below its own angle atan(q/p) and q from there on. So buckets are
    first summed by the angle where they turn (at most ``angles`` rows per group), and
    running sums over the angles give every point.
    """
    by = list(by)
    turn = F.when(F.col("p") > 0, F.ceil(F.atan(F.col("q") / F.col("p")) * F.lit(2 * angles / math.pi))).otherwise(F.lit(angles))
    turned = hist.withColumn("theta", F.greatest(F.lit(1), F.least(F.lit(angles), turn)).cast("int")).groupBy(
        *by, "theta").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    base = _grouped(hist, by).agg((F.count("*") == F.count(F.col("p") + F.col("q"))).alias("_known"))
    spine = base.select(*by, "_known", F.explode(F.sequence(F.lit(1), F.lit(angles))).alias("theta"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    upto = group.orderBy("theta").rowsBetween(Window.unboundedPreceding, 0)
    after = group.orderBy("theta").rowsBetween(1, Window.unboundedFollowing)
    slope = F.tan(F.col("theta") * F.lit(math.pi / 2 / angles))
    sums = spine.join(turned, by + ["theta"], "left").na.fill(0.0, ["_p", "_q"]).select(
        *by, "theta", "_known", F.sum("_q").over(upto).alias("_flat"), F.coalesce(F.sum("_p").over(after), F.lit(0.0)).alias("_steep"))
    clip = lambda v: F.when(F.col("_known"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return sums.where(F.col("theta") < angles).select(
        *by, "theta",
        clip(slope * F.col("_steep") + F.col("_flat")).alias("alpha"),
        clip(F.col("_steep") + F.col("_flat") / slope).alias("beta"))


def f_beta(precision, recall, beta=1.0, epsilon=F_BETA_EPSILON):
    """F-score column. Values outside [0, 1] raise when evaluated."""
    if beta <= 0:
        raise ValueError(f"beta must be positive, got {beta!r}")
    score = (1 + beta**2) * (precision * recall) / (beta**2 * precision + recall + epsilon)
    valid = (precision.between(0, 1) & recall.between(0, 1)) | precision.isNull() | recall.isNull()
    return F.when(valid, score).otherwise(F.raise_error(F.lit("precision and recall must be in [0, 1]")).cast("double"))


def curve_scores(curve, by=()):
    """Precision and recall read from the curve: the largest F(1/8) and the largest F(8)."""
    a, b = F.col("alpha"), F.col("beta")
    return _grouped(curve, by).agg(
        F.max(f_beta(a, b, PRECISION_BETA)).alias("precision"), F.max(f_beta(a, b, RECALL_BETA)).alias("recall"))


def divergence_metrics(hist, by=(), scale=MAUVE_SCALE, points=CURVE_POINTS):
    """``(by…, mauve, frontier_integral, precision, recall)`` of each histogram."""
    by = list(by)
    parts = [
        mauve(divergence_curve(hist, by, scale, points), by),
        frontier_integral(hist, by),
        curve_scores(pr_curve(hist, by), by),
    ]
    # Stacked and folded to one row per group, so the parts need no join.
    names = [c for part in parts for c in part.columns if c not in by]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _grouped(stacked, by).agg(*[F.max(c).alias(c) for c in names])
