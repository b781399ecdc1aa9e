"""Vectors from text, normalisation, PCA, truncation and padding."""

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, PCA, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textdist.functions.text import words
from textdist.functions.vectors import normalized
from textdist.operators.joins import stack_sides, with_field
from textdist.operators.sampling import hash_sample

EXPLAINED_VARIANCE = 0.9
MAX_TOKENS = 1024
FEATURE_BATCH = 16


def resolve_features(df, feature_col=None, token_col=None, text_col=None, fn=None, dim=256, batch_size=FEATURE_BATCH):
    """``df`` with vector column ``x`` from features if given, else tokens, else text."""
    if feature_col is not None:
        return df.withColumn("x", F.col(feature_col).cast("array<double>"))
    if token_col is None and text_col is None:
        raise ValueError("give at least one of feature_col, token_col, text_col")
    if fn is not None:
        return featurize(df, token_col or text_col, fn, batch_size)
    if token_col is None:
        token_col = "_tokens"
        df = df.withColumn("_tokens", words(F.col(text_col)))
    return hashed_features(df, token_col, dim).drop("_tokens")


def featurize(df, col, fn, batch_size=FEATURE_BATCH):
    """Add ``x``, computed by a user callable in batches on the executors. ``fn()`` builds the
    model once per task and returns ``encode(list of inputs) -> (n, d) array``."""

    def run(batches):
        encode = fn()
        for batch in batches:
            for s in range(0, batch.num_rows, batch_size):
                part = batch.slice(s, batch_size)
                vectors = np.asarray(encode(part.column(col).to_pylist()), dtype=np.float64)
                yield pa.RecordBatch.from_arrays(
                    part.columns + [pa.array(list(vectors), pa.list_(pa.float64()))], part.schema.names + ["x"])

    return df.mapInArrow(run, with_field(df, "x", T.ArrayType(T.DoubleType())))


def hashed_features(df, token_col, dim=256, idf=False):
    """Model-free default: hashed term counts, optionally weighted by rarity."""
    tf = HashingTF(inputCol=token_col, outputCol="_tf", numFeatures=dim).transform(df)
    if idf:
        tf = IDF(inputCol="_tf", outputCol="_v").fit(tf).transform(tf).drop("_tf")
    else:
        tf = tf.withColumnRenamed("_tf", "_v")
    return tf.withColumn("x", vector_to_array("_v")).drop("_v")


def truncate_tokens(col, max_len=MAX_TOKENS):
    return F.slice(col, 1, max_len)


def components_for(ratios, threshold=EXPLAINED_VARIANCE):
    """Least number of leading components whose shares reach the threshold."""
    total = 0.0
    for i, share in enumerate(ratios, start=1):
        total += share
        if total >= threshold:
            return i
    return len(ratios)


def cumulative_variance(df, ratio, order, by=()):
    """Running sum of explained-variance shares."""
    along = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(order)
    return df.withColumn("cumulative", F.sum(ratio).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def skip_pca(explained_variance):
    """One rule for both metric families: None, False and 1 mean no PCA."""
    return explained_variance is None or explained_variance is False or explained_variance == 1


def reduce_pca(p, q, key, explained_variance=EXPLAINED_VARIANCE, norm="l2", whiten=False, fit_rows=-1, seed=25):
    """Normalise, fit PCA on Q over P, keep enough components, project both sides.

    The d × d covariance is the only thing that reaches the driver. Projections are not
    centred unless whitened: a common shift changes no distance and no cluster.
    """
    p = p.withColumn("x", normalized(F.col("x"), norm))
    q = q.withColumn("x", normalized(F.col("x"), norm))
    if explained_variance is True:
        explained_variance = EXPLAINED_VARIANCE
    if skip_pca(explained_variance):
        return p, q
    if not 0 < explained_variance < 1:
        raise ValueError(f"explained_variance must be in (0, 1), got {explained_variance!r}")
    both = stack_sides(q.select(key, "x"), p.select(key, "x"))
    if fit_rows == 0 or fit_rows < -1:
        raise ValueError(f"fit_rows must be -1 or positive, got {fit_rows!r}")
    if fit_rows > 0:
        both = hash_sample(both.withColumn("_k", F.concat("side", F.lit(":"), F.col(key).cast("string"))), "_k", seed, n=fit_rows)
    vectors = both.select(array_to_vector("x").alias("_v"))
    d = both.select(F.size("x")).first()[0]
    model = PCA(k=d, inputCol="_v", outputCol="_z").fit(vectors)
    kept = components_for(model.explainedVariance.toArray(), explained_variance)
    if whiten:
        stats = model.transform(vectors).select(
            Summarizer.mean(F.col("_z")).alias("m"), Summarizer.std(F.col("_z")).alias("s")).first()
        mean, dev = F.lit(stats.m.toArray().tolist()), F.lit([v or 1.0 for v in stats.s.toArray().tolist()])

    def project(df):
        z = F.slice(vector_to_array("_z"), 1, kept)
        out = model.transform(df.withColumn("_v", array_to_vector("x"))).withColumn("x", z).drop("_v", "_z")
        if whiten:
            centred = F.zip_with("x", F.slice(mean, 1, kept), lambda v, m: v - m)
            out = out.withColumn("x", F.zip_with(centred, F.slice(dev, 1, kept), lambda v, s: v / s))
        return out

    return project(p), project(q)
