"""Ordered boosting: whole groups in tasks against job by job, the ordered rule, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_forest import DDL, data

from evenkeel.operators import boosting


def shares(model, df):
    return {(r["ds"], r["row_id"]): r["share"] for r in model.predict(df).collect()}


def test_tasks_and_jobs_agree(spark, monkeypatch):
    df = spark.createDataFrame(data(80, 3), DDL).repartition(3)
    unseen = spark.createDataFrame(data(40, 3, seed=6) + [("other", 1, 0, [0.0] * 3)], DDL)
    settings = {"rounds": 5, "depth": 2, "rate": 0.3, "bins": 16, "patience": 4}
    want = shares(boosting.Boosting(df, ["ds"], **settings), unseen)
    assert len(want) == 80 and max(want.values()) > 0.6 > 0.4 > min(want.values())
    monkeypatch.setattr(boosting, "LOCAL", 10)
    monkeypatch.setattr(boosting, "RENEW", 2)
    monkeypatch.setattr(boosting, "HIST_BYTES", 1)  # one group at a time
    monkeypatch.setattr(boosting, "MODEL_BYTES", 1)
    got = shares(boosting.Boosting(df, ["ds"], **settings), unseen)
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-9)


def test_buckets_halve():
    ids = np.arange(100_000)
    b = boosting.buckets(ids, 42, top := boosting.top_of(len(ids)))
    assert b.min() == 0 and b.max() == top and abs((b == top).mean() - 0.5) < 0.01 and 2 < (b == 0).sum() < 30


def test_no_row_helps_to_predict_itself():
    """Flipping a row's class leaves the score that its gradient comes from as it was, for one round."""
    rng = np.random.default_rng(3)
    codes, ids = rng.integers(0, 8, (60, 3)).astype(np.uint8), np.arange(60)
    top = boosting.top_of(60)
    bucket = boosting.buckets(ids, 1, top)
    y = rng.integers(0, 2, 60).astype(float)
    tree = [(0, 3), (1, 2)]
    seen = []
    for flip in (False, True):
        own = y.copy()
        own[7] = 1 - own[7] if flip else own[7]
        sums = boosting.leaf_sums(codes, own, bucket, np.zeros((60, top + 2)), tree)[:-2].reshape(2, -1, top + 2)
        values = sums[0] / (sums[1] + 3.0)
        seen.append(values[boosting.leaves_of(codes, tree)][7])
    assert seen[0][bucket[7]] == seen[1][bucket[7]] and seen[0][-1] != seen[1][-1]


@pytest.mark.parametrize("noise", [True, False])
def test_stopping_and_accuracy(spark, noise):
    """Pure noise stops early; an exclusive-or with a tenth of labels flipped is learned on held-out rows."""
    rng = np.random.default_rng(4)
    rows, held = data(400, 3, 1), data(200, 3, 2)
    if noise:
        rows = [(ds, i, int(rng.integers(2)), x) for ds, i, _, x in rows]
    model = boosting.Boosting(spark.createDataFrame(rows, DDL), ["ds"], rounds=300, rate=0.1, patience=20)
    lengths = [len(t) for t in model.trees.values()]
    if noise:
        assert max(lengths) < 60
    else:
        got = shares(model, spark.createDataFrame(held, DDL))
        assert np.mean([(got[r[0], r[1]] > 0.5) == r[2] for r in held]) > 0.82 and min(lengths) >= 5


def test_odd_groups(spark):
    rows = [("one", i, 1, [float(i)]) for i in range(5)] + [("copies", i, i % 2, [3.0]) for i in range(8)] + [("lone", 1, 0, [1.0])] + [(None, i, i // 15, [float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, DDL)
    got = shares(boosting.Boosting(df, ["ds"], rounds=40, rate=0.3), df)
    assert len(got) == len(rows) and all(0 < p < 1 for p in got.values())
    assert got[None, 0] < 0.5 < got[None, 29]
    assert boosting.Boosting(df.limit(0), ["ds"]).predict(df).count() == 0


@pytest.mark.parametrize("held", [False, True])
def test_scores_that_are_read_give_the_same_trees(held):
    """A task that keeps three scores a row finds the cuts and leaf sums of the full table of scores."""
    rng = np.random.default_rng(5)
    codes, y, ids = rng.integers(0, 9, (300, 4)).astype(np.uint8), rng.integers(0, 2, 300).astype(float), np.arange(300)
    top = boosting.top_of(300)
    bucket, score = boosting.buckets(ids, 1, top, held), np.zeros((300, top + 2))
    inside = boosting.Inside(0, codes, y, bucket, top, 3.0)
    assert len(inside.score) < 4 * 300
    for _ in range(3):
        tree = []
        for _ in range(3):
            gain = boosting.gains(boosting.histogram(codes, y, bucket, score, tree, inside.bins), 3.0)
            best = int(np.round(gain, 9).argmax())
            assert inside.cuts({0: tree})[0] == (best // gain.shape[1], best % gain.shape[1])
            tree.append((best // gain.shape[1], best % gain.shape[1]))
        sums = boosting.leaf_sums(codes, y, bucket, score, tree)
        assert np.array_equal(inside.leaves({0: tree})[0], sums)
        values = 0.3 * np.divide(*(sums[:-2].reshape(2, -1, top + 2) + np.array([0.0, 3.0])[:, None, None]))
        inside.step({0: (tree, values)})
        score += values[boosting.leaves_of(codes, tree)]


def test_a_middling_group_takes_no_job_a_level(spark, monkeypatch):
    monkeypatch.setattr(boosting, "Spread", None)
    df = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 7 > 3).cast("int").alias("label"), F.array((F.col("id") % 7).cast("double")).alias("features"))
    got = boosting.Boosting(df, rounds=3, rate=1.0).predict(df).join(df, "row_id")
    assert got.where((F.col("share") > 0.5) != (F.col("label") == 1)).count() == 0


def test_a_level_may_count_the_smaller_side_only(monkeypatch):
    """Histograms of the other side by difference: the trees are the same, and fewer rows are counted."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 8, (3000, 6)).astype(np.uint8)
    y = ((codes[:, 0] > 3) ^ (codes[:, 1] > 2) ^ (rng.random(3000) < 0.2)).astype(float)
    ids, top = np.arange(3000), boosting.top_of(3000)
    counted, real = [], boosting.binned
    monkeypatch.setattr(boosting, "binned", lambda codes, leaf, leaves, bins, g, h, rows=None: counted.append(len(leaf) if rows is None else len(rows)) or real(codes, leaf, leaves, bins, g, h, rows))

    def trees():
        counted.clear()
        inside = boosting.Inside(0, codes, y, boosting.buckets(ids, 42, top), top, 3.0)
        return boosting.boost(inside, {0: top}, 20, 4, 0.1, 3.0, None)[0]

    want, every = trees(), sum(counted)
    monkeypatch.setattr(boosting, "PARTED", 0)
    got = trees()
    assert sum(counted) < 0.7 * every
    assert [t for t, _ in got] == [t for t, _ in want] and all(np.allclose(a, b) for (_, a), (_, b) in zip(got, want))
    monkeypatch.setattr(boosting, "SURE", 10.0)
    assert [t for t, _ in trees()] == [t for t, _ in want] and sum(counted) == every  # a small ``l2`` takes no differences
