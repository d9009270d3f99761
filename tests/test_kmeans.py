"""Grouped k-means and X-Means: both ways to measure, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import cluster, kmeans


def blobs(spark, seed=3, per=30, groups=(("a", 1, 3), ("b", 1, 5), (None, 2, 2), ("one", 7, 1))):
    """Groups with so many well separated blobs, one group of copies, one of a single row."""
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for ds, label, k in groups:
        for c in range(k):
            for x in rng.normal(20 * c, 0.5, (per, 3)):
                rows.append((ds, label, i, x.tolist()))
                i += 1
    rows += [("copies", 1, i + j, [1.0, 2.0, 3.0]) for j in range(20)] + [("lone", 1, i + 20, [4.0, 4.0, 4.0])]
    return spark.createDataFrame(rows, "ds string, label int, row_id bigint, features array<double>")


@pytest.fixture(params=["task", "rounds", "turns"])
def way(request, monkeypatch):
    """Whole fits in tasks; one job a round; rounds with more centers than travel at once."""
    if request.param != "task":
        monkeypatch.setattr(kmeans, "SMALL", 25)
    if request.param == "turns":
        monkeypatch.setattr(kmeans, "TABLE_BYTES", 100)
    return request.param


def test_centers_are_means_of_their_nearest_rows(spark, way):
    df = blobs(spark)
    grp = ["ds", "label"]
    got = {}
    for r in cluster.fit_centers(df, grp, {("a", 1): 3, ("b", 1): 5, (None, 2): 4, ("one", 7): 2, ("copies", 1): 3, ("lone", 1): 2}, 42, restarts=4).collect():
        got.setdefault((r["ds"], r["label"]), []).append(r["center"])
    assert {k: len(v) for k, v in got.items()} == {("a", 1): 3, ("b", 1): 5, (None, 2): 4, ("one", 7): 2, ("copies", 1): 1, ("lone", 1): 1}
    rows = {}
    for r in df.collect():
        rows.setdefault((r["ds"], r["label"]), []).append(r["features"])
    for key, centers in got.items():
        x, c = np.array(rows[key]), np.array(centers)
        near = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
        assert np.allclose([x[near == i].mean(0) for i in range(len(c))], c, atol=1e-7)
        if key in (("a", 1), ("b", 1)):  # every blob is found
            assert sorted(np.bincount(near).tolist()) == [30] * len(c)


def test_xmeans_of_all_groups(spark, way):
    found = cluster.estimate_k(blobs(spark), ["ds", "label"])
    assert found[("a", 1)] == 3 and found[("b", 1)] == 5 and found[(None, 2)] == 2 and found[("lone", 1)] == 1 and found[("copies", 1)] == 2
    assert cluster.estimate_k(blobs(spark).where("ds = 'b'"), [], k_max=4)[()] <= 4


def test_jobs_do_not_grow_with_groups(spark, monkeypatch):
    """One job a round for all groups; one in all where they are small."""
    seen = []
    inner = kmeans.spread

    def counted(frame):
        measure = inner(frame)
        return lambda specs, squares=False: seen.append(len(specs)) or measure(specs, squares)

    monkeypatch.setattr(kmeans, "spread", counted)
    df = blobs(spark, groups=[(f"g{i}", 0, 2) for i in range(6)])
    cluster.fit_centers(df, ["ds"], 2, 1, restarts=3)
    assert not seen
    monkeypatch.setattr(kmeans, "SMALL", 25)
    cluster.fit_centers(df, ["ds"], 2, 1, restarts=3)
    assert seen[0] == 6 and len(seen) < 15


def test_bisecting_and_empty(spark, way):
    df = blobs(spark).where("ds = 'b'")
    got = np.array([r["center"] for r in cluster.fit_centers(df, [], 5, 42, bisecting=True).collect()])
    assert len(got) == 5
    assert cluster.fit_centers(df.limit(0), ["ds"], 5, 42).isEmpty() and cluster.fit_centers(df.limit(0), [], 5, 42).isEmpty()
    assert cluster.estimate_k(df.limit(0), ["ds"]) == {}


def test_not_worse_than_random_starts(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id bigint, features array<double>")

    def cost(c):
        return ((x[:, None] - c) ** 2).sum(-1).min(1).sum()

    def plain(c):
        for _ in range(200):
            near = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
            c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        return cost(c)

    own = cost(np.array([r["center"] for r in cluster.fit_centers(df, [], 6, 42).collect()]))
    assert own <= np.median([plain(x[rng.choice(400, 6, replace=False)]) for _ in range(15)])


@pytest.mark.parametrize("kept", [0, 1 << 13, 1 << 20])
def test_steps_without_a_job_are_lloyd_steps(spark, monkeypatch, kept):
    """However many rows in doubt travel, centers, rows and costs are those of plain steps; with them, far fewer jobs are needed."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1500, 6)), np.repeat(rng.normal(size=(5, 6)), 30, axis=0)])
    df = spark.createDataFrame([(0, i, r.tolist()) for i, r in enumerate(x)], "gid int, row_id long, features array<double>").repartition(3)
    starts = {0: [x[:7], x[40:44], np.vstack([x[:3], np.full((1, 6), 50.0)])]}
    monkeypatch.setattr(kmeans, "DOUBT_BYTES", kept)
    inner, jobs = kmeans.spread(df), []
    got = kmeans.lloyd(lambda specs, squares=False: jobs.append(1) or inner(specs, squares), starts)[0]
    steps = []
    plain = kmeans.inside({0: x})
    want = kmeans.lloyd(lambda specs, squares=False: steps.append(1) or plain(specs, squares), starts)[0]
    for (c, n, cost), (c0, n0, cost0) in zip(got, want):
        assert np.allclose(c, c0, atol=1e-7) and n.tolist() == n0.tolist() and np.allclose(cost, cost0)
    assert len(jobs) <= len(steps) + 2 and (kept < 1 << 20 or len(jobs) < 0.6 * len(steps))
    halves = [kmeans.halves(m, {0: x[:6]})[0] for m in (inner, plain)]
    for a, b in zip(*halves):
        assert (a is None) == (b is None) and (a is None or np.allclose(a[1][0], b[1][0], atol=1e-7) and a[1][1].tolist() == b[1][1].tolist())
    few = [kmeans.lloyd(m, starts, rounds=9)[0] for m in (inner, plain)]  # a limit of steps holds for both
    assert all(np.allclose(a[0], b[0], atol=1e-7) and np.allclose(a[2], b[2]) for a, b in zip(*few))
