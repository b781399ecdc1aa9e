import numpy as np
import pytest
from pyspark.sql import functions as F

from textdist.functions.vectors import normalized
from textdist.operators import cluster, vectors as V
from textdist.operators.manifold import prdc


def test_normalise(points):
    rows = points([[3, 4], [0, 0]]).select(normalized(F.col("x")).alias("a"), normalized(F.col("x"), "l1").alias("b")).collect()
    assert rows[0].a == [0.6, 0.8] and rows[0].b == pytest.approx([3 / 7, 4 / 7]) and rows[1].a == [0, 0]
    with pytest.raises(ValueError):
        normalized(F.col("x"), "l3")


def test_pca_of_full_rank_is_a_rotation(points):
    rng = np.random.default_rng(3)
    p, q = points(rng.normal(size=(50, 4))), points(rng.normal(size=(50, 4)))
    a = prdc(*V.reduce_pca(p, q, "id", 0.9999999), "id", 3).first()
    b = prdc(*V.reduce_pca(p, q, "id", None), "id", 3).first()
    assert tuple(a) == pytest.approx(tuple(b))


def test_pca_keeps_the_share_asked_for(points):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(80, 3)) * [10, 1, 0.1]
    p, q = V.reduce_pca(points(rows), points(rows + 0.01), "id", 0.9, norm="none")
    assert {len(r.x) for r in p.collect()} == {1} and q.count() == 80
    assert V.components_for([0.5, 0.25, 0.25], 0.75) == 2 and V.components_for([0.5, 0.25], 0.9) == 2


def test_pca_arguments(points):
    p = points([[1, 2], [2, 1], [3, 3]])
    for bad in (1.5, -0.1):
        with pytest.raises(ValueError):
            V.reduce_pca(p, p, "id", bad)
    with pytest.raises(ValueError):
        V.reduce_pca(p, p, "id", 0.9, fit_rows=0)
    assert V.reduce_pca(p, p, "id", 0.9, fit_rows=3)[0].count() == 3


def test_whitening(points):
    rng = np.random.default_rng(6)
    p, q = V.reduce_pca(points(rng.normal(size=(60, 3))), points(rng.normal(size=(60, 3))), "id", 0.9999, whiten=True)
    x = np.array([r.x for r in p.unionByName(q).collect()])
    assert np.allclose(x.mean(0), 0, atol=1e-9) and np.allclose(x.std(0, ddof=1), 1)


def test_resolve_features(spark):
    df = spark.createDataFrame([("a b", ["a", "b"], [1.0, 2.0])], "t string, k array<string>, f array<float>")
    assert V.resolve_features(df, feature_col="f", token_col="k").first().x == [1.0, 2.0]
    assert sum(V.resolve_features(df, token_col="k", dim=8).first().x) == 2
    assert sum(V.resolve_features(df, text_col="t", dim=8).first().x) == 2
    with pytest.raises(ValueError):
        V.resolve_features(df)


def test_featurize_builds_once_per_task(spark):
    def build():
        calls = []

        def encode(texts):
            calls.append(len(texts))
            return np.array([[len(calls), len(t)] for t in texts], dtype=float)

        return encode

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id int, t string").coalesce(1)
    rows = V.featurize(df, "t", build, batch_size=4).orderBy("id").collect()
    assert [r.x for r in rows][-1] == [3.0, 9.0] and "x" not in df.columns


def test_assignment_paths_agree(points):
    rng = np.random.default_rng(7)
    rows, centres = rng.normal(size=(200, 3)), rng.normal(size=(30, 3))
    df, c = points(rows), points(centres).select(F.col("id").cast("int").alias("bucket"), "x")
    want = ((rows[:, None] - centres[None]) ** 2).sum(-1).argmin(1).tolist()
    small = cluster.assign_to_centroids(df, c).orderBy("id").collect()
    large = cluster.assign_to_centroids(df, c, block_rows=8, limit=0).orderBy("id").collect()
    assert [r.bucket for r in small] == want == [r.bucket for r in large]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_kmeans_finds_clusters(points, limit):
    rng = np.random.default_rng(8)
    centre = np.array([[0, 0], [50, 0], [0, 50]])
    df = points(centre[np.arange(90) % 3] + rng.normal(size=(90, 2)))
    found = cluster.kmeans_centroids(df, 3, restarts=4, max_iter=20, block_rows=32, limit=limit)
    got = np.array(sorted(r.x for r in found.collect()))
    assert got.shape == (3, 2)
    placed = cluster.assign_to_centroids(df, found)
    assert sorted(r["count"] for r in placed.groupBy("bucket").count().collect()) == [30, 30, 30]


def test_kmeans_with_fewer_points_than_buckets(points):
    found = cluster.kmeans_centroids(points([[0.0], [0.0], [5.0], [5.0]]), 4, restarts=2, max_iter=5)
    assert 1 <= found.count() <= 4


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_kmeans_keeps_k_centroids_of_few_distinct_points(points, limit):
    df = points([[i % 6, (i % 6) ** 2] for i in range(60)])
    found = cluster.kmeans_centroids(df, 6, restarts=2, max_iter=5, block_rows=32, limit=limit)
    assert sorted(tuple(r.x) for r in found.collect()) == [(float(i), float(i * i)) for i in range(6)]
    assert cluster.kmeans_centroids(df, 9, restarts=1, max_iter=3, limit=limit).count() == 6


def test_lloyd_steps_by_numpy_whichever_way_sums_travel(points, monkeypatch):
    monkeypatch.setattr(cluster, "SUM_BYTES", 80)  # two buckets a range
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 3)) + 4 * (np.arange(300) % 4)[:, None]
    starts = [data[r : r + 5].copy() for r in range(2)]
    rows = points(data).select("x").repartition(4).persist()
    straight = cluster._collected_steps(rows, [s.copy() for s in starts], 6, 1e-9)
    shuffled = cluster._collected_steps(rows, [s.copy() for s in starts], 6, 1e-9, limit=0)
    for start, a, b in zip(starts, straight, shuffled):
        now = start
        for _ in range(6):
            near = ((data[:, None] - now[None]) ** 2).sum(2).argmin(1)
            now = np.array([data[near == i].mean(0) if (near == i).any() else now[i] for i in range(5)])
        cost = ((data[:, None] - now[None]) ** 2).sum(2).min(1).sum()
        assert a[0] == b[0] and (a[1] == b[1]).all()
        assert a[0] == pytest.approx(cost) and a[1] == pytest.approx(now)
    rows.unpersist()


def test_nearest_is_exact_whatever_the_scale():
    rng = np.random.default_rng(11)
    tight = rng.normal(size=(6, 16))
    cases = [(rng.normal(size=(400, 20)), rng.normal(size=(70, 20))), (1e-30 * rng.normal(size=(50, 4)), 1e-30 * rng.normal(size=(20, 4))),
             (1e100 * rng.normal(size=(50, 4)), 1e100 * rng.normal(size=(20, 4))), (1e6 + rng.normal(size=(50, 4)), 1e6 + rng.normal(size=(20, 4))),
             (rng.integers(0, 3, (300, 3)) * 1.0, rng.integers(0, 3, (40, 3)) * 1.0), (np.ones((9, 3)), np.ones((4, 3))),
             (np.repeat(tight, 30, 0) + 1e-7 * rng.normal(size=(180, 16)), np.repeat(tight, 20, 0) + 1e-7 * rng.normal(size=(120, 16)))]
    for x, y in cases:
        found, dist = cluster._nearest(x, y)
        every = np.sqrt(np.add.reduce(np.ascontiguousarray(((x[:, None] - y[None]) ** 2).transpose(2, 0, 1)), axis=0))
        assert (found == every.argmin(1)).all() and dist == pytest.approx(every.min(1), rel=1e-12)


def test_rows_of_a_bucket_meet_in_few_even_tasks(points):
    rng = np.random.default_rng(12)
    middle = 100 * rng.normal(size=(64, 5))
    data = np.concatenate([middle[rng.permutation(64 * 30) % 64] + rng.normal(size=(64 * 30, 5)), np.tile(middle[:1], (1000, 1))])
    dealt = cluster._near_together(points(data).select("x").repartition(6), middle, 8)
    rows = dealt.select("x", F.spark_partition_id().alias("p")).collect()
    assert sorted(tuple(r.x) for r in rows) == sorted(map(tuple, data.tolist()))
    assert np.bincount([r.p for r in rows], minlength=8).max() < 1.3 * len(data) / 8
    home, _ = cluster._nearest(np.array([r.x for r in rows]), middle)
    assert len({(h, r.p) for h, r in zip(home.tolist(), rows)}) < 2 * 64
    dealt.unpersist()


def test_restarts_that_fit_by_turns_take_the_same_steps(points, monkeypatch):
    rng = np.random.default_rng(13)
    df = points(rng.normal(size=(400, 3)))
    tables = []
    monkeypatch.setattr(cluster, "_table_steps", lambda *a: tables.append(a))
    whole, turns = (cluster.kmeans_centroids(df, 40, restarts=3, max_iter=8, limit=limit).orderBy("bucket").collect() for limit in (1 << 20, 2 * 8 * 40 * 3))
    assert not tables and whole == turns
