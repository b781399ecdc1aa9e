"""Run parameters: flat maps, identity and grid."""

from pyspark.sql import functions as F

# What a missing parameter means.
DEFAULT_TOP_P = 1.0
DEFAULT_TEMPERATURE = 1.0
DEFAULT_REPETITION_PENALTY = 0.0


def generation_hparams(task_has_words=False):
    """Flat parameter map of the columns of a run, defaults filled in."""
    text = lambda c: c.cast("string")
    entries = [
        F.lit("model"), F.col("model"),
        F.lit("nucleus_p"), text(F.coalesce("top_p", F.lit(DEFAULT_TOP_P))),
        F.lit("temperature"), text(F.coalesce("temperature", F.lit(DEFAULT_TEMPERATURE))),
        F.lit("repetition_penalty"), text(F.coalesce("repetition_penalty", F.lit(DEFAULT_REPETITION_PENALTY))),
        F.lit("max_new_tokens"), text(F.col("max_new_tokens")),
        F.lit("generation_seed"), text(F.col("seed")),
    ]
    if task_has_words:
        entries += [F.lit("n_words"), text(F.col("top_k_words"))]
    return F.create_map(*entries)


def prefixed(params, prefix):
    """A Python parameter dict as a literal map with prefixed names."""
    flat = [F.lit(v) for k, value in params.items() for v in (f"{prefix}{k}", str(value))]
    return F.create_map(*flat)


def scorer_hparams(scorers):
    return F.map_concat(*[prefixed(params, f"{name}_") for name, params in scorers.items()])


def feature_hparams(feat_model, layer):
    return prefixed({"layer": layer, "feat_model": feat_model}, "")


def self_bleu_hparams(ratio, tokenizer, orders, bleu_orders):
    return F.map_concat(
        prefixed({"sample_ratio": ratio, "tokenizer": tokenizer}, "bleu-"),
        prefixed({"n_lst_bleu": list(bleu_orders), "n_lst": list(orders)}, ""))


def task_variant():
    return F.when(F.col("task") == "webtext", F.concat(F.lit("words"), F.col("top_k_words"))).when(
        F.col("task") == "wikipedia_bio", F.concat(F.lit("icl"), F.col("n_icl"))).otherwise(F.lit("all"))


def sampling_name(greedy=None):
    """Name of the decoding settings; ``greedy`` is a column that is true where nothing is sampled."""
    penalty = F.coalesce("repetition_penalty", F.lit(DEFAULT_REPETITION_PENALTY))
    sampled = F.concat(
        F.lit("p"), F.coalesce("top_p", F.lit(DEFAULT_TOP_P)), F.lit("_t"),
        F.coalesce("temperature", F.lit(DEFAULT_TEMPERATURE)), F.lit("_r"), penalty)
    return sampled if greedy is None else F.when(greedy, F.concat(F.lit("greedy_r"), penalty)).otherwise(sampled)


RUN_KEYS = ("task", "variant", "model", "sampling", "seed")


def with_run_key(runs, extra=()):
    """Partition columns of a run and one ``run_id`` hashed from them, its time and ``extra``
    columns such as feature model, layer and k. Where ``do_sample`` is false, decoding was greedy."""
    greedy = ~F.coalesce(F.col("do_sample"), F.lit(True)) if "do_sample" in runs.columns else None
    keyed = runs.withColumn("variant", task_variant()).withColumn("sampling", sampling_name(greedy))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*RUN_KEYS, "run_ts", *extra)]
    return keyed.withColumn("run_id", F.sha2(F.concat_ws("/", *parts), 256))
