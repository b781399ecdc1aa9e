"""Scorers: tables in, long metric rows ``(name, value)`` out."""

from functools import reduce

from pyspark.sql import functions as F

from textdist.operators import cluster, histogram, manifold
from textdist.operators.blocks import BLOCK_ROWS
from textdist.operators.joins import stack_sides
from textdist.operators.ngrams import DISTINCT_ORDERS, ratio_of, with_all_orders
from textdist.operators.sampling import equal_length
from textdist.operators.self_bleu import gram_summary, self_bleu
from textdist.operators.vectors import EXPLAINED_VARIANCE, reduce_pca
from textdist.session import cut_lineage

# Defaults of the scorers in evaluation runs.
RUN_SEED = 1235
RUN_K = 4
BLEU_SEED = 12345
BLEU_RATIO = 0.2
BLEU_ORDERS = (4,)


def long_rows(wide, prefix="", by=()):
    """Metric columns of a wide row as rows ``(by…, name, value)``."""
    names = [c for c in wide.columns if c not in by]
    pairs = [F.struct(F.lit(prefix + c).alias("name"), F.col(c).cast("double").alias("value")) for c in names]
    return wide.select(*by, F.explode(F.array(*pairs)).alias("_r")).select(*by, "_r.*")


def prdc_call(p, q, key, k=manifold.DEFAULT_K, pca=True, fit_rows=-1, seed=25, block_rows=BLOCK_ROWS):
    """PRDC of feature tables ``(key, x)``; with ``pca`` rows are normalised and reduced."""
    if pca:
        share = EXPLAINED_VARIANCE if pca is True else pca
        p, q = reduce_pca(p, q, key, share, fit_rows=fit_rows, seed=seed)
    return manifold.prdc(p, q, key, k, block_rows=block_rows)


def prdc_scorer(p, q, key, k=RUN_K, pca=True, seed=0, **options):
    p, q = equal_length(p, q, key)
    return long_rows(prdc_call(p, q, key, k, pca, seed=seed, **options), "prdc.")


def mauve_call(p, q, key, num_buckets="auto", pca=EXPLAINED_VARIANCE, fit_rows=-1, restarts=cluster.RESTARTS,
               max_iter=cluster.MAX_ITERATIONS, scale=histogram.MAUVE_SCALE, points=histogram.CURVE_POINTS, seed=25,
               norm="l2", whiten=False):
    """Cluster both sides together and compare the bucket histograms. Returns
    ``(metrics, artifacts)``: one wide row, and tables hist, divergence_curve and pr_curve."""
    k = histogram.bucket_count(p.count(), q.count(), num_buckets)
    p, q = reduce_pca(p, q, key, pca, norm, whiten, fit_rows, seed)
    stacked = stack_sides(q.select("x"), p.select("x"))
    placed = cluster.kmeans_buckets(stacked, k, restarts=restarts, max_iter=max_iter, seed=seed + 2)
    hist = cut_lineage(histogram.histogram(placed, buckets=k))
    artifacts = {
        "hist": hist,
        "divergence_curve": histogram.divergence_curve(hist, scale=scale, points=points),
        "pr_curve": histogram.pr_curve(hist),
    }
    return histogram.divergence_metrics(hist, scale=scale, points=points), artifacts


def mauve_scorer(p, q, key, pca=True, seed=0, **options):
    p, q = equal_length(p, q, key)
    wide, _ = mauve_call(p, q, key, pca=EXPLAINED_VARIANCE if pca is True else pca, seed=seed, **options)
    return long_rows(wide.withColumnRenamed("frontier_integral", "fi_score"), "mauvepr.")


SCORERS = {"mauvepr": mauve_scorer, "prdc": prdc_scorer}
RUN_SCORERS = {"mauvepr": {"seed": RUN_SEED, "pca": True}, "prdc": {"seed": RUN_SEED, "pca": True, "k": RUN_K}}


def register_scorer(name, scorer):
    """Any ``(p, q, key, **params) -> (name, value)`` function can join the registry."""
    SCORERS[name] = scorer


def score(p, q, key, scorers=None):
    """Run scorers by name on one pair and stack their rows."""
    chosen = RUN_SCORERS if scorers is None else scorers
    unknown = [n for n in chosen if n not in SCORERS]
    if unknown:
        raise ValueError(f"unknown scorers {unknown}, known are {sorted(SCORERS)}")
    return merge_metrics([SCORERS[n](p, q, key, **params) for n, params in chosen.items()])


def merge_metrics(tables):
    return reduce(lambda a, b: a.unionByName(b), tables)


def diversity(df, key, tokens, orders=DISTINCT_ORDERS, bleu_orders=BLEU_ORDERS, ratio=BLEU_RATIO, seed=BLEU_SEED, by=()):
    """Distinct-n, Self-BLEU and the number of sampled texts, per group, as long rows. Both
    metrics read one summary of the n-grams, so texts are expanded once."""
    by = list(by)
    expanded = sorted(set(orders) | set(range(1, max(bleu_orders) + 1)))
    # At most one row per text and order, written once.
    summary = gram_summary(df, key, tokens, expanded, by)
    counted = summary.where(F.col("n").isin(*orders)).groupBy(*by, "n").agg(F.sum("uniq").alias("uniq"), F.sum("total").alias("total"))
    distinct = ratio_of(with_all_orders(df, counted, orders, by)).select(
        *by, F.concat(F.lit("distinct-"), F.col("n")).alias("name"), F.col("distinct_n").cast("double").alias("value"))
    bleus = self_bleu(df, key, tokens, bleu_orders, ratio, seed, by, summary)
    rows = bleus.select(*by, F.explode(F.array(
        F.struct(F.concat(F.lit("bleu-"), F.col("n")).alias("name"), F.col("bleu").alias("value")),
        F.struct(F.lit("n_samples").alias("name"), F.col("n_samples").cast("double").alias("value")))).alias("_r"))
    return distinct.unionByName(rows.select(*by, "_r.*").distinct())
