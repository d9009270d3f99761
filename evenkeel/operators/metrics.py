"""Binary classification metrics as aggregates over a prediction table.

Predictions have ``by..., y, y_pred`` (0/1) and optionally ``p1``, the score of class 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.kernels import equi
from evenkeel.operators.scan import range_buckets, running_sums

METRICS = [
    "tpr", "fpr", "tnr", "fnr", "specificity", "accuracy", "precision", "precision_macro", "precision_weighted",
    "recall", "recall_macro", "recall_weighted", "f1", "f1_macro", "f1_weighted", "balanced_accuracy", "g_mean",
    "roc_auc", "roc_auc_macro", "roc_auc_weighted",
]


def _share(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def score_counts(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., p1, tn, fp, fn, tp) per distinct score. Everything else is computed from these counts,
    so the predictions are read and shuffled once."""
    if "p1" not in preds.columns:
        preds = preds.withColumn("p1", F.lit(None).cast("double"))
    y, p = F.col("y"), F.col("y_pred")
    return preds.groupBy(*by, "p1").agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def confusion(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., tn, fp, fn, tp); defined whatever labels occur."""
    y, p = F.col("y"), F.col("y_pred")
    return preds.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def _scored(counts: DataFrame) -> DataFrame:
    """Positives and negatives per score; rows without a score count for nothing."""
    known = F.col("p1").isNotNull()
    return counts.withColumn("pos", F.when(known, F.col("tp") + F.col("fn")).otherwise(0)).withColumn(
        "neg", F.when(known, F.col("tn") + F.col("fp")).otherwise(0)).drop("tn", "fp", "fn", "tp")


def _ranged(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """The counts per score, written once and cut into ranges of the scores that occur."""
    return range_buckets(score_counts(preds, by), [*by, "p1"])


def _auc(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    ranked = running_sums(_scored(counts), by, ["p1"], F.col("_range"), {"_upto": F.col("pos") + F.col("neg")})
    tie = F.col("pos") + F.col("neg")
    mean_rank = F.col("_upto") - tie + (tie + 1) / 2
    sums = ranked.groupBy(*by).agg(
        F.sum(F.col("pos") * mean_rank).alias("_r"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    area = (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p").cast("double") * F.col("_n"))
    return sums.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0), area).alias("roc_auc"))


def roc_auc(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., roc_auc) by mean ranks; null when one class is missing."""
    return _auc(_ranged(preds, by), by)


def evaluate(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by`` with the confusion counts and every metric. ``precision``, ``recall`` and
    ``f1`` without suffix are the weighted ones; macro averages run over labels
    found in y or y_pred, weights are supports, empty denominators give 0."""
    by = list(by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n1, n0 = tp + fn, tn + fp
    counts = _ranged(preds, by)
    c = counts.groupBy(*by).agg(*[F.sum(n).alias(n) for n in ("tn", "fp", "fn", "tp")])
    c = c.withColumns({
        "tpr": _share(tp, n1), "fpr": _share(fp, n0), "tnr": _share(tn, n0), "fnr": _share(fn, n1),
        "_p1": _share(tp, tp + fp), "_p0": _share(tn, tn + fn),
        "_f1": _share(2 * tp, 2 * tp + fp + fn), "_f0": _share(2 * tn, 2 * tn + fp + fn),
        "_has1": (tp + fn + fp > 0).cast("int"), "_has0": (tn + fp + fn > 0).cast("int"),
    })
    labels = F.col("_has0") + F.col("_has1")

    def macro(zero, one):
        return (F.col(zero) * F.col("_has0") + F.col(one) * F.col("_has1")) / labels

    def weighted(zero, one):
        return (F.col(zero) * n0 + F.col(one) * n1) / (n0 + n1)

    present = (n0 > 0).cast("int") + (n1 > 0).cast("int")
    c = c.withColumns({
        "specificity": F.col("tnr"), "accuracy": (tp + tn) / (n0 + n1),
        "precision": weighted("_p0", "_p1"), "precision_macro": macro("_p0", "_p1"), "precision_weighted": weighted("_p0", "_p1"),
        "recall": weighted("tnr", "tpr"), "recall_macro": macro("tnr", "tpr"), "recall_weighted": weighted("tnr", "tpr"),
        "f1": weighted("_f0", "_f1"), "f1_macro": macro("_f0", "_f1"), "f1_weighted": weighted("_f0", "_f1"),
        "balanced_accuracy": (F.col("tnr") + F.col("tpr")) / present, "g_mean": F.sqrt(F.col("tpr") * F.col("tnr")),
    })
    if "p1" in preds.columns:
        c = equi(c, _auc(counts, by), by, "left")
    else:
        c = c.withColumn("roc_auc", F.lit(None).cast("double"))
    c = c.withColumns({"roc_auc_macro": F.col("roc_auc"), "roc_auc_weighted": F.col("roc_auc")})
    return c.select(*by, "tn", "fp", "fn", "tp", *METRICS)


def fp_rate(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return confusion(preds, by).select(*by, _share(F.col("fp"), F.col("tn") + F.col("fp")).alias("fp_rate"))


def long_form(scores: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """(by..., metric, value)."""
    return scores.unpivot(list(by), list(metrics), "metric", "value")


def _swept(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts at or above every distinct score, highest first."""
    scored = _scored(counts).filter("pos + neg > 0")
    return running_sums(scored, by, [F.col("p1").desc()], -F.col("_range"), {"tp": F.col("pos"), "fp": F.col("neg")})


def roc_points(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, fpr, tpr) per distinct score; the start (0, 0) has a null threshold."""
    by = list(by)
    counts = _ranged(preds, by)
    swept = _swept(counts, by)
    points = swept.select(
        *by, F.col("p1").alias("threshold"), _share(F.col("fp"), F.col("fp_total")).alias("fpr"),
        _share(F.col("tp"), F.col("tp_total")).alias("tpr"))
    starts = counts.groupBy(*by).agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(starts)


def pr_points(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, recall, precision) per distinct score, closed by (0, 1) with a null threshold."""
    by = list(by)
    counts = _ranged(preds, by)
    points = _swept(counts, by).select(
        *by, F.col("p1").alias("threshold"), _share(F.col("tp"), F.col("tp_total")).alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    ends = counts.groupBy(*by).agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return points.unionByName(ends)


def pr_area(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., pr_area): trapezoids between consecutive points. The previous point follows from the
    running counts of the row itself, so no further window is needed."""
    by = list(by)
    before = F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    last = F.when(before > 0, (F.col("tp") - F.col("pos")) / before).otherwise(1.0)
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    strip = _share(F.col("pos"), F.col("tp_total")) * (here + last) / 2
    return _swept(_ranged(preds, by), by).groupBy(*by).agg(F.sum(strip).alias("pr_area"))
