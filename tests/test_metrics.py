import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import metrics
from evenkeel.plans import report


def preds(spark, rows):
    return spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in rows], "y int, y_pred int, p1 double")


def test_hand_example(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1), (0, 0, 0.2)]
    m = metrics.evaluate(preds(spark, rows)).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (3, 1, 1, 1)
    assert m["tpr"] == 0.5 and m["fpr"] == 0.25 and m["tnr"] == 0.75 and m["fnr"] == 0.5
    assert math.isclose(m["accuracy"], 4 / 6) and math.isclose(m["recall"], m["accuracy"])
    assert math.isclose(m["precision_macro"], (0.75 + 0.5) / 2) and math.isclose(m["balanced_accuracy"], 0.625)
    assert math.isclose(m["f1_weighted"], 0.75 * 4 / 6 + 0.5 * 2 / 6) and math.isclose(m["g_mean"], math.sqrt(0.375))
    # pairs: 0.9 beats all four, 0.4 beats two, ties one, loses one
    assert math.isclose(m["roc_auc"], (4 + 2.5) / 8)


@pytest.mark.parametrize("rows", [
    [(0, 0, 0.2), (0, 0, 0.3)], [(1, 1, 0.2)], [(0, 1, 0.9), (0, 0, 0.1)], [(1, 0, 0.4), (1, 0, 0.2)]])
def test_one_class_does_not_fail(spark, rows):
    m = metrics.evaluate(preds(spark, rows)).first()
    assert m["roc_auc"] is None and math.isclose(m["recall_weighted"], m["accuracy"])
    labels = {a for a, _, _ in rows} | {b for _, b, _ in rows}
    if labels == {0}:
        assert m["precision_macro"] == 1.0 and m["balanced_accuracy"] == 1.0 and m["tpr"] == 0.0
    if rows[0][0] == 0 and 1 in labels:
        assert m["precision_macro"] == 0.5 and m["balanced_accuracy"] == 0.5


def test_auc_flips_with_the_score_and_matches_pairs(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300) * 0.8 + y * 0.2, 2)
    df = preds(spark, [(a, b > 0.5, b) for a, b in zip(y, p)])
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    auc = metrics.roc_auc(df).first()[0]
    assert math.isclose(auc, want) and math.isclose(metrics.roc_auc(df.withColumn("p1", 1 - F.col("p1"))).first()[0], 1 - auc)
    roc = metrics.roc_points(df).toPandas().sort_values(["fpr", "tpr"])
    assert math.isclose(np.trapezoid(roc["tpr"], roc["fpr"]), auc) and len(roc) == len(set(p)) + 1
    pr = metrics.pr_points(df).toPandas().assign(t=lambda d: d["threshold"].fillna(9)).sort_values("t", ascending=False)
    assert math.isclose(metrics.pr_area(df).first()[0], np.trapezoid(pr["precision"], pr["recall"]))


def test_reports(spark):
    rows = [("d", "m", c, "f1", v, s) for c, a, b in [("kNN", 0.5, 0.6), ("RandomForest", 0.5, 0.6), ("SVM", 0.0, 0.0)]
            for v, s in [("original", a), ("resampled", b)]]
    scores = spark.createDataFrame(rows, "dataset string, method string, classifier string, metric string, variant string, value double")
    changes = report.improvement(scores)
    summary = {r["classifier"]: r for r in report.summary(changes).collect()}
    assert summary["kNN"]["delta_absolute"] == 0.1 and summary["kNN"]["delta_percent"] == 20.0 and summary["SVM"]["delta_percent"] == 0.0
    order = ["RandomForest", "kNN", "SVM"]
    assert report.best_gain(changes, order).first()["classifier"] == "RandomForest"
    assert report.best_gain(changes.filter("classifier = 'SVM'"), order).isEmpty()
    share = report.improved_share(changes, ["dataset", "method"]).first()
    assert (share["improved"], share["total"]) == (2, 3)
    cv = scores.filter("variant = 'resampled'").select("dataset", "method", "classifier", "metric", F.col("value").alias("mean"))
    assert report.best(cv, order).first()["classifier"] == "RandomForest"
    table = {r["classificator"]: r["f1"] for r in report.comparison(cv, ["f1"]).collect()}
    assert table == {"kNN": "0.6000", "RF": "0.6000", "SVM": "0.0000"}
