import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textdist.operators import histogram as H


def hist(spark, p, q):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, q))]
    return spark.createDataFrame(rows, "bucket int, p double, q double")


@pytest.mark.parametrize("p, q, want", [
    ([.5, .5, 0], [.25, .25, .5], (0.278113725367, 0.306852819440, 0.503863187, 0.984828876)),
    ([.25, .25, .5], [.5, .5, 0], (0.278113725367, 0.306852819440, 0.984828875, 0.503863187)),
    ([.5, .5], [.5, .5], (1, 0, 1, 1)),
    ([1, 0], [0, 1], (0.004072096262, 1, 0, 0)),
    ([.1, .2, .3, .4], [.4, .3, .2, .1], (0.653853663353, 0.143763373972, 0.955791501, 0.955791502))])
def test_fixture(spark, p, q, want):
    r = H.divergence_metrics(hist(spark, p, q)).first()
    assert (r.mauve, r.frontier_integral) == pytest.approx(want[:2], abs=1e-9)
    assert (r.precision, r.recall) == pytest.approx(want[2:], abs=2e-9)


def test_bucket_count():
    assert [H.bucket_count(n, n) for n in (25, 35, 5, 4000)] == [2, 4, 2, 400]
    assert H.bucket_count(9, 9, 7) == 7
    for bad in ("many", 2.5, True):
        with pytest.raises(ValueError):
            H.bucket_count(9, 9, bad)


def test_histogram_has_every_bucket(spark):
    df = spark.createDataFrame([("p", 0), ("p", 2), ("q", 2)], "side string, bucket int")
    rows = H.histogram(df, buckets=4).orderBy("bucket").collect()
    assert [(r.p, r.q) for r in rows] == [(0.5, 0.0), (0.0, 0.0), (0.5, 1.0), (0.0, 0.0)]


def test_group_with_an_empty_side_is_null(spark):
    df = spark.createDataFrame([("a", "p", 0), ("b", "p", 0), ("b", "q", 0)], "g string, side string, bucket int")
    h = H.histogram(df, by=["g"])
    got = {r.g: r for r in H.divergence_metrics(h, by=["g"]).collect()}
    assert got["a"].frontier_integral is None and got["a"].mauve is None and got["a"].precision is None
    assert got["b"].frontier_integral == 0 and got["b"].mauve == pytest.approx(1)


def test_kl(spark):
    r = H.kl_divergence(hist(spark, [.5, .5], [1, 0])).first()
    assert r.kl_pq == math.inf and r.kl_qp == pytest.approx(math.log(2))


def test_curve_shape_and_f_beta(spark):
    curve = H.divergence_curve(hist(spark, [.2, .8], [.6, .4])).orderBy("i").collect()
    assert len(curve) == 27 and (curve[0].x, curve[0].y, curve[-1].x, curve[-1].y) == (1, 0, 0, 1)
    with pytest.raises(ValueError):
        H.f_beta(F.lit(0.5), F.lit(0.5), 0)
    bad = spark.range(1).select(H.f_beta(F.lit(1.5), F.lit(0.5)).alias("f"))
    with pytest.raises(Exception, match="precision and recall"):
        bad.collect()


shares = st.lists(st.integers(0, 20), min_size=2, max_size=7)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(shares, shares)
def test_pr_curve_equals_direct_sums(spark, a, b):
    size = min(len(a), len(b))
    p, q = np.array(a[:size], dtype=float), np.array(b[:size], dtype=float)
    if not p.sum() or not q.sum():
        return
    p, q = p / p.sum(), q / q.sum()
    rows = H.pr_curve(hist(spark, p, q)).orderBy("theta").collect()
    t = np.tan(np.arange(1, 1000) * math.pi / 2000)[:, None]
    assert np.allclose([r.alpha for r in rows], np.clip(np.minimum(t * p, q).sum(1), 0, 1), atol=1e-12)
    assert np.allclose([r.beta for r in rows], np.clip(np.minimum(p, q / t).sum(1), 0, 1), atol=1e-12)
    m = H.divergence_metrics(hist(spark, p, q)).first()
    assert all(-1e-9 <= v <= 1 + 1e-9 for v in m)
