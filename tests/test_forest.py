"""Grouped forests: tasks, levels and both ways to score give the same trees; small ones equal brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import classifiers, forest

DDL = "ds string, row_id bigint, label int, features array<double>"


def data(n=120, dim=4, seed=5, groups=("a", None)):
    rng = np.random.default_rng(seed)
    rows = []
    for ds in groups:
        x = np.round(rng.normal(size=(n, dim)), 1)
        y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
        flip = rng.random(n) < 0.1
        rows += [(ds, i, int(y[i] ^ flip[i]), x[i].tolist()) for i in range(n)]
    return rows


def exact_tree(x, y, depth=None, level=0):
    """Gini, all features, cuts midways, ties to the order of features that the node draws: compared by training accuracy and impurity."""
    if len(set(y)) < 2 or level == depth:
        return 1
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for c in values[:-1] / 2 + values[1:] / 2:
            low = x[:, j] <= c
            score = sum((np.bincount(y[s]) ** 2).sum() / s.sum() for s in (low, ~low))
            if best is None or score > best[0] + 1e-12:
                best = score, low
    return 1 + exact_tree(x[best[1]], y[best[1]], depth, level + 1) + exact_tree(x[~best[1]], y[~best[1]], depth, level + 1) if best else 1


def shares(model, df):
    return {(r["ds"], r["row_id"]): tuple(np.round(r["shares"], 12)) for r in model.predict(df).collect()}


def test_same_forest_by_tasks_levels_and_journeys(spark, monkeypatch):
    df = spark.createDataFrame(data(), DDL)
    unseen = spark.createDataFrame(data(seed=6) + [("other", 1, 0, [0.0] * 4)], DDL)
    one = forest.Forest(df, ["ds"], trees=4)
    want = shares(one, unseen)
    assert len(want) == 240 and not one.tops  # a group without training rows predicts nothing
    assert shares(forest.Forest(df.repartition(9), ["ds"], trees=4), unseen) == want
    monkeypatch.setattr(forest, "LOCAL", 30)
    monkeypatch.setattr(forest, "HIST_BYTES", 1 << 14)  # two nodes at a time
    levels = forest.Forest(df, ["ds"], trees=4)
    assert max(len(t.key) for t in levels.tops.values()) > 5
    assert shares(levels, unseen) == want
    monkeypatch.setattr(forest, "MODEL_BYTES", 0)
    monkeypatch.setattr(forest, "SCORED", 50)
    assert shares(levels, unseen) == want and shares(one, unseen) == want
    monkeypatch.setattr(forest, "TABLE_BYTES", 0)
    assert shares(forest.Forest(df, ["ds"], trees=4), unseen) == want


@pytest.mark.parametrize("depth", [None, 3])
def test_tree_against_brute_force(spark, depth):
    rows = data(90, 3, groups=("a",))
    model = forest.Forest(spark.createDataFrame(rows, DDL), ["ds"], trees=1, bootstrap=False, mtry=0, depth=depth)
    x, y = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    tree = model.subtrees.first()
    if depth:  # the best cut at the root, and no node below the limit
        low = x[:, tree["feature"][0]] <= tree["cut"][0]
        own = sum((np.bincount(y[s]) ** 2).sum() / s.sum() for s in (low, ~low))
        every = [sum((np.bincount(y[s]) ** 2).sum() / s.sum() for s in (x[:, j] <= c, x[:, j] > c)) for j in range(3) for c in np.unique(x[:, j])[:-1]]
        assert own == max(every) and len(tree["feature"]) <= 15
    else:
        got = shares(model, spark.createDataFrame(rows, DDL))
        same = {}
        for r in rows:
            same.setdefault(tuple(r[3]), []).append(r[2])
        assert all(got["a", r[1]][1] == round(np.mean(same[tuple(r[3])]), 12) for r in rows)  # pure but for equal rows
        assert abs(len(tree["feature"]) - exact_tree(x, y)) <= 12  # ties may fall otherwise


def test_bootstrap_weights():
    w = np.stack([forest.draws(np.arange(4000), 42, t) for t in range(20)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.06


def test_cuts():
    x = np.array([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0], [4.0, 5.0]])
    cuts = forest.cuts_of(x, 256)
    assert cuts[0].tolist() == [1.5, 3.0] and cuts[1].tolist() == []
    assert forest.encode(x, cuts).tolist() == [[0, 0], [1, 0], [2, 0], [2, 0]]
    wide = forest.cuts_of(np.arange(10_000.0)[:, None], 256)[0]
    assert len(wide) == 255 and np.abs(np.diff(wide) - 10_000 / 256).max() < 2


def test_odd_groups(spark):
    """One class, copies only, one row, three classes, null group, no rows."""
    rows = [("one", i, 1, [float(i)]) for i in range(5)] + [("copies", i, i % 2, [3.0]) for i in range(8)] + [("lone", 1, 0, [1.0])]
    rows += [(None, i, i // 10, [float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, DDL)
    model = forest.Forest(df, ["ds"], trees=30)
    got = shares(model, df)
    assert model.labels == [0, 1, 2] and len(got) == len(rows) and all(abs(sum(s) - 1) < 1e-9 for s in got.values())
    assert got["one", 0][1] == 1 and got["lone", 1][0] == 1 and 0.2 < got["copies", 0][0] < 0.8
    assert all(np.argmax(got[None, i]) == i // 10 for i in range(30) if i % 10 not in (0, 9))
    none = forest.Forest(df.where("ds = 'x'"), ["ds"])
    assert none.predict(df).count() == 0


def test_classifiers(spark):
    """Held-out accuracy on an exclusive-or with noise, by group, through the registry."""
    train, test = spark.createDataFrame(data(600, 4, 1), DDL), spark.createDataFrame(data(300, 4, 2), DDL)
    for name, least in (("RandomForest", 0.8), ("DecisionTree", 0.7)):
        got = classifiers.predict(name, train, test, ["ds"]).groupBy("ds").agg(F.avg((F.col("y") == F.col("y_pred")).cast("int")).alias("a"), F.count("*").alias("n")).collect()
        assert len(got) == 2 and all(r["a"] > least and r["n"] == 300 for r in got), (name, got)


@pytest.mark.parametrize("classes, depth", [(2, None), (3, 4)])
def test_levels_of_a_task_make_the_cuts_of_single_nodes(monkeypatch, classes, depth):
    """Nodes counted or sorted, all of a level at a time: every one has the best cut of its own histogram, with the node's own order of features."""
    rng = np.random.default_rng(8)
    codes, y, w = rng.integers(0, 9, (400, 5)).astype(np.uint8), rng.integers(0, classes, 400), rng.integers(0, 3, 400).astype(float)
    for counted in (0, 64, 1 << 30):
        monkeypatch.setattr(forest, "COUNTED", counted)
        tree = forest.grow(codes, y, w, 77, 0, depth, 2, classes)
        todo, leaves = [(0, np.flatnonzero(w), 77)], 0
        while todo:
            me, rows, key = todo.pop()
            assert tree.value[me].tolist() == np.bincount(y[rows], weights=w[rows], minlength=classes).tolist()
            if tree.feature[me] < 0:
                leaves += 1
                continue
            order = np.random.default_rng(key).permutation(5)
            for at in range(0, 5, 2):
                hist = np.zeros((len(order[at:at + 2]), forest.BINS, classes))
                for j, f in enumerate(order[at:at + 2]):
                    np.add.at(hist[j], (codes[rows, f], y[rows]), w[rows])
                score, j, code = forest.best_cut(hist)
                if score > -np.inf:
                    break
            assert (tree.feature[me], tree.cut[me]) == (order[at + j], code)
            low = codes[rows, tree.feature[me]] <= code
            todo += [(tree.left[me], rows[low], forest._child(key, 0)), (tree.right[me], rows[~low], forest._child(key, 1))]
        assert leaves > 10
