"""Grouped logistic regression: tasks and jobs give the same optimum, that of Spark ML; odd groups."""

import numpy as np
from pyspark.sql import functions as F

from evenkeel.operators import classifiers, logistic

DDL = "ds string, row_id bigint, label int, features array<double>"


def data():
    rng = np.random.default_rng(4)
    rows = []
    for ds, n in (("a", 200), (None, 90)):
        x = rng.normal(size=(n, 3)) * [1, 5, 0.2]
        y = (x @ [1.0, -0.3, 2.0] + rng.normal(size=n) > 0.4).astype(int)
        rows += [(ds, i, int(y[i]), x[i].tolist()) for i in range(n)]
    rows += [("parted", i, int(i > 3), [float(i), 1.0, 0.0]) for i in range(8)]
    return rows + [(c, i, int(c == "ones"), [float(i), 0.0, 1.0]) for c in ("ones", "none") for i in range(4)]


def shares(train, test):
    return {(r["ds"], r["row_id"]): r["p1"] for r in classifiers.predict("LogisticRegression", train, test, ["ds"]).collect()}


def test_all_groups_in_one_fit(spark, monkeypatch):
    rows = data()
    df = spark.createDataFrame(rows, DDL).repartition(5)
    monkeypatch.setattr(classifiers, "_per_group", None)  # no fit a group
    got = shares(df, df.unionByName(spark.createDataFrame([("other", 1, 0, [0.0] * 3)], DDL)))
    assert len(got) == len(rows)  # a group without rows for training predicts nothing
    monkeypatch.setattr(logistic, "LOCAL_ROWS", 10)
    far = shares(df, df)
    assert all(abs(far[k] - v) < 1e-7 for k, v in got.items())
    assert all(got["ones", i] == 1.0 and got["none", i] == 0.0 for i in range(4))
    for ds in ("a", None, "parted"):  # what only the optimum meets
        x, y = np.array([r[3] for r in rows if r[0] == ds]), np.array([r[2] for r in rows if r[0] == ds])
        p = np.array([got[ds, r[1]] for r in rows if r[0] == ds])
        odds = np.log(p / (1 - p)) - x @ (x.T @ (y - p))
        assert abs((y - p).sum()) < 1e-6 and np.ptp(odds) < 1e-4


def test_more_classes_go_to_spark_ml(spark):
    rows = [(None, i, i // 10, [float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, DDL)
    got = classifiers.predict("LogisticRegression", df, df, ["ds"]).groupBy().agg(F.avg((F.col("y") == F.col("y_pred")).cast("int"))).first()[0]
    assert got > 0.8
