import numpy as np
import pytest
from pyspark.sql import functions as F

from textdist.operators.vectors import hashed_features
from textdist.plans import evaluate, runs as R, scorers
from textdist.sources.cache import read_metrics

PRDC = {"prdc": {"k": 2, "pca": False}}


def hashed(df):
    return hashed_features(df.withColumn("_t", F.split("formatted_text", " ", -1)), "_t", 8).drop("_t")


def texts(spark, n, word, name="text"):
    return spark.createDataFrame([(i, f"{word} {i % 7} {i} end") for i in range(n)], f"id bigint, {name} string")


def test_mauve_of_equal_sides(points):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(60, 4))
    wide, parts = scorers.mauve_call(points(rows), points(rows), "id", restarts=2, max_iter=20)
    r = wide.first()
    assert r.mauve == pytest.approx(1) and r.frontier_integral == 0 and r.precision == pytest.approx(1)
    assert parts["pr_curve"].count() == 999 and parts["divergence_curve"].count() == 27
    assert parts["hist"].agg(F.sum("p"), F.sum("q")).first() == pytest.approx((1, 1))


def test_multi_scorer(points):
    rng = np.random.default_rng(2)
    p, q = points(rng.normal(size=(40, 3))), points(rng.normal(size=(50, 3)))
    got = {r.name: r.value for r in scorers.score(p, q, "id").collect()}
    assert sorted(got) == ["mauvepr.fi_score", "mauvepr.mauve", "mauvepr.precision", "mauvepr.recall",
                           "prdc.coverage", "prdc.density", "prdc.precision", "prdc.recall"]
    with pytest.raises(ValueError, match="unknown scorers"):
        scorers.score(p, q, "id", {"bertscore": {}})


def test_own_scorer(points, monkeypatch):
    monkeypatch.setattr(scorers, "SCORERS", dict(scorers.SCORERS))
    scorers.register_scorer("rows", lambda p, q, key: p.agg(F.lit("rows").alias("name"), F.count("*").cast("double").alias("value")))
    assert scorers.score(points([1, 2]), points([1]), "id", {"rows": {}}).first().value == 2


def test_experiments(points):
    rows = evaluate.score_experiments(
        lambda shift: (points([0, 1, 2, 3]), points([shift, 1 + shift, 2 + shift, 3 + shift])), [{"shift": 0}, {"shift": 100}], "id", PRDC)
    got = {(r.step, r.name): r.value for r in rows.collect()}
    assert got[0, "prdc.precision"] == 1 and got[1, "prdc.precision"] == 0


def test_webtext_reads_its_cache(spark, tmp_path):
    gens = texts(spark, 20, "gen").withColumn("prediction", F.concat(F.lit("said "), "text"))
    calls = []
    feature = lambda df: calls.append(1) or hashed(df)
    run = lambda: evaluate.evaluate_webtext(texts(spark, 30, "ref"), gens, "id", feature, "f", "texts", str(tmp_path), "r", scorers=PRDC)
    first, second = sorted(map(tuple, run().collect())), sorted(map(tuple, run().collect()))
    assert first == second and len(first) == 8 and len(calls) == 3


def test_biographies_record_errors_and_go_on(spark, tmp_path):
    refs = texts(spark, 20, "ref", "content").withColumn("title", F.lit("t"))

    def generations(n_icl):
        if n_icl == 1:
            raise LookupError("missing")
        return texts(spark, 20, "gen", "prediction")

    sink = str(tmp_path / "sink")
    evaluate.evaluate_biographies(refs, generations, "id", hashed, "hashed", "texts", str(tmp_path), "r", sink, (1,), (1, 2), scorers=PRDC)
    rows = read_metrics(spark, sink).collect()
    assert [(r.step, r.note) for r in rows if r.name == "error"] == [(0, "n_icl 1: LookupError: missing")]
    assert {r.name for r in rows if r.step == 1} == {"n_icl", "prdc.precision", "prdc.recall", "prdc.density", "prdc.coverage"}


def test_pairs_skip_finished(spark, tmp_path):
    calls = []

    def generations(model, seed):
        calls.append((model, seed))
        return texts(spark, 12 + seed, model, "prediction")

    for seeds in ((1,), (1, 2)):
        out = evaluate.evaluate_pairs(generations, "a", 1, "b", "id", hashed, "hashed", "texts", str(tmp_path), seeds, scorers=PRDC)
        assert out.count() == 4 * len(seeds)
    assert calls.count(("b", 1)) == 1


def test_hparams_and_keys(spark):
    runs = spark.createDataFrame(
        [("webtext", "m", None, 0.6, None, 615, 1, None, 10, "2024-01-01"), ("wikipedia_bio", "m", 0.9, None, 1.18, 448, 1, 3, None, "2024-01-01")],
        "task string, model string, top_p double, temperature double, repetition_penalty double, max_new_tokens int, seed int, n_icl int, top_k_words int, run_ts string")
    rows = R.with_run_key(runs).select("*", R.generation_hparams(True).alias("h")).collect()
    assert rows[0].h["nucleus_p"] == "1.0" and rows[0].h["n_words"] == "10" and rows[0].variant == "words10"
    assert rows[1].h["temperature"] == "1.0" and rows[1].variant == "icl3" and rows[0].run_id != rows[1].run_id
    flat = spark.range(1).select(R.scorer_hparams(scorers.RUN_SCORERS).alias("a"), R.self_bleu_hparams(0.2, "split", (1, 2), (4,)).alias("b"),
                                 R.feature_hparams("hash", "-1").alias("c")).first()
    assert flat.a["prdc_k"] == "4" and flat.b["bleu-sample_ratio"] == "0.2" and flat.c["layer"] == "-1"


def test_cached_rows_differ_by_features_source_and_scorers(spark, tmp_path):
    """One root, two featurisers, two sources, two scorer settings: each gets its own rows."""
    gens = texts(spark, 30, "gen").withColumn("prediction", F.col("text"))
    refs = texts(spark, 30, "ref")
    seen = []
    long = lambda df: df.select("*", F.array(F.length("formatted_text").cast("double"), F.lit(0.0)).alias("x"))
    flat = lambda df: df.select("*", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    for build, features in ((long, "length"), (flat, "id")):
        rows = evaluate.evaluate_webtext(refs, gens, "id", build, features, "texts", str(tmp_path), "r", ref_seeds=(1,), scorers=PRDC)
        seen.append(sorted((r.name, r.value) for r in rows.collect()))
    assert seen[0] != seen[1]
    with pytest.raises(ValueError):
        evaluate.evaluate_diversity(gens, "id", root=str(tmp_path))
