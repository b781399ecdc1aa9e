"""Evaluations of the three tasks, and sweeps over their settings.

A sweep's settings are a handful of parameter tuples, so the driver loops over them. Each
step runs as Spark jobs over its whole tables; ``max_samples`` limits the rows per side where a caller asks for it.

Results are cached by all that decides them: the task, ``features`` (names the featuriser, its model and layer),
``source`` (names the tables), the scorers with their parameters, and every option.
"""

from pyspark.sql import functions as F

from textdist.functions import text as X
from textdist.operators.sampling import first_n, hash_sample
from textdist.plans.scorers import RUN_SCORERS, diversity, score
from textdist.sources.cache import append_metrics, materialize, metric_rows

# The default sweeps.
REF_SEEDS = (1, 2)
N_ICL_SWEEP = tuple(range(1, 13))
MODEL_SEEDS = tuple(range(1, 6))


def format_continuations(generations, k=10, unit="chars"):
    """Web-text generations: prompt prefix and prediction, cut."""
    return generations.withColumn("formatted_text", X.continuation_text(F.col("text"), F.col("prediction"), k, unit=unit))


def format_references(refs):
    return refs.withColumn("formatted_text", X.reference_text(F.col("text")))


def format_creative(generations):
    return generations.withColumn("formatted_text", X.creative_text(F.col("prediction")))


def format_biographies(generations):
    return generations.withColumn("formatted_text", X.before_delimiter(F.col("prediction")))


def format_biography_references(refs):
    return refs.withColumn("formatted_text", X.title_and_content(F.col("title"), F.col("content")))


def score_experiments(build, settings, key, scorers=None):
    """``build(**setting) -> (p, q)``; rows ``(step, name, value)`` of every setting."""
    out = None
    for step, setting in enumerate(settings):
        p, q = build(**setting)
        rows = score(p, q, key, scorers).select(F.lit(step).alias("step"), "name", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def _first(df, key, n):
    return df if n is None else first_n(df, key, n)


def _sample(df, key, seed, n):
    return df if n is None else hash_sample(df, key, seed, n=n)


def _features(df, key, featurize, root, params, recompute=False):
    return materialize(lambda: featurize(df).select(key, "x"), df.sparkSession, root, params, recompute)


def evaluate_webtext(refs, generations, key, featurize, features, source, root, run_id, ref_seeds=REF_SEEDS, max_samples=None,
                     k_words=10, unit="chars", scorers=None, recompute=False):
    """Score generations against a fresh reference sample per seed; cached by all parameters."""
    spark = refs.sparkSession
    base = {"task": "webtext", "features": features, "source": source, "n": max_samples}
    shape = {"run": run_id, "k": k_words, "unit": unit}
    q_text = format_continuations(_first(generations, key, max_samples), k_words, unit)
    q = _features(q_text, key, featurize, f"{root}/q", {**base, **shape}, recompute)
    out = None
    for seed in ref_seeds:
        p_text = format_references(_sample(refs, key, seed, max_samples))
        p = _features(p_text, key, featurize, f"{root}/ref", {**base, "seed": seed}, recompute)
        params = {**base, **shape, "seed": seed, "scorers": scorers or RUN_SCORERS}
        rows = materialize(lambda: score(p, q, key, scorers), spark, f"{root}/metrics", params, recompute)
        rows = rows.select(F.lit(run_id).alias("run_id"), F.lit(seed).alias("ref_seed"), "name", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def evaluate_biographies(refs, generations_of, key, featurize, features, source, root, run_id, sink, ref_seeds=REF_SEEDS,
                         n_icl_list=N_ICL_SWEEP, max_samples=None, scorers=None, recompute=False):
    """Sweep the number of in-context examples. A step that fails leaves an error row and the
    sweep goes on. Rows go to the metrics table ``sink``."""
    spark = refs.sparkSession
    base = {"task": "biography", "features": features, "source": source, "n": max_samples}
    for seed in ref_seeds:
        p_text = format_biography_references(_sample(refs, key, seed, max_samples))
        p = _features(p_text, key, featurize, f"{root}/ref", {**base, "seed": seed}, recompute)
        for step, n_icl in enumerate(n_icl_list):
            run = f"{run_id}/ref{seed}"
            append_metrics(metric_rows(spark, run, {"n_icl": n_icl}, step), sink)
            try:
                q_text = format_biographies(_first(generations_of(n_icl), key, max_samples))
                q = _features(q_text, key, featurize, f"{root}/q", {**base, "run": run_id, "n_icl": n_icl}, recompute)
                params = {**base, "run": run_id, "seed": seed, "n_icl": n_icl, "scorers": scorers or RUN_SCORERS}
                rows = materialize(lambda: score(p, q, key, scorers), spark, f"{root}/metrics", params, recompute)
                append_metrics(rows.withColumn("run_id", F.lit(run)).withColumn("step", F.lit(step)), sink)
            except Exception as error:
                note = f"n_icl {n_icl}: {type(error).__name__}: {str(error)[:500]}"
                append_metrics(metric_rows(spark, run, {"error": None}, step, note), sink)


def evaluate_pairs(generations_of, model_a, seed_a, model_b, key, featurize, features, source, root, seeds_b=MODEL_SEEDS,
                   max_samples=None, scorers=None, recompute=False):
    """Compare two models on creative texts, one pair per seed of B; finished pairs are read,
    not computed again."""

    base = {"task": "creative", "features": features, "source": source, "n": max_samples}

    def vectors(model, seed):
        rows = format_creative(_first(generations_of(model, seed), key, max_samples))
        return _features(rows, key, featurize, f"{root}/features", {**base, "model": model, "seed": seed}, recompute)

    a, out = None, None
    for seed_b in seeds_b:
        pair = f"{model_a}_s{seed_a}_vs_{model_b}_s{seed_b}"
        a = vectors(model_a, seed_a) if a is None else a
        params = {**base, "pair": pair, "scorers": scorers or RUN_SCORERS}
        rows = materialize(lambda: score(a, vectors(model_b, seed_b), key, scorers), a.sparkSession, f"{root}/pairs", params, recompute)
        rows = rows.select(F.lit(pair).alias("pair"), "name", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def evaluate_diversity(generations, key, run="run_id", text="formatted_text", root=None, params=None, recompute=False, **options):
    """Diversity of every run in one job, keyed by the run column. With ``root`` the rows are cached by ``params``, which
    must name the generations, and by every option."""
    build = lambda: diversity(generations, key, text, by=[run] if run else [], **options)
    if root is None:
        return build()
    if not params:
        raise ValueError("a cached evaluation needs params that name its input")
    return materialize(build, generations.sparkSession, root, {"task": "diversity", "run": run, "text": text, **options, **params}, recompute)
