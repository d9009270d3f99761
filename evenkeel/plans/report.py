"""Comparison reports over long score tables.

Scores are ``dataset, method, classifier, [fold | variant], metric, value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.vectors import mean_vector, std_vector

# fixed values: classifier names and their short forms in comparison tables
SHORT_NAMES = {
    "CatBoost": "CB",
    "RandomForest": "RF",
    "SVM": "SVM",
    "kNN": "kNN",
    "LogisticRegression": "LR",
    "DecisionTree": "DT",
    "NaiveBayes": "NB",
}

# fixed values: metrics compared first
PRIORITY_METRICS = [
    "balanced_accuracy",
    "f1_weighted",
    "g_mean",
    "roc_auc_weighted",
    "precision_weighted",
    "recall_weighted",
]

KEYS = ["dataset", "method", "classifier"]


def cv_summary(folds: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """(by..., metric, mean, std): mean and population deviation over folds."""
    return folds.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def improvement(scores: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """(by..., metric, original, resampled, improvement) from rows with ``variant``."""
    wide = scores.groupBy(*by, "metric").pivot("variant", ["original", "resampled"]).agg(F.max("value"))
    return wide.withColumn("improvement", F.col("resampled") - F.col("original"))


def _percent() -> Column:
    return F.when(F.col("original") != 0, F.col("improvement") / F.col("original") * 100).otherwise(0.0)


def _rounded(value: Column, digits: int) -> Column:
    """Nearest multiple, halves to even, on the binary value: what rounding a float gives in NumPy."""
    return F.rint(value * F.lit(10.0**digits)) / F.lit(10.0**digits)


def summary(changes: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Scores and change to 4 decimals, change in percent to 2 (0 from an original of 0)."""
    return changes.select(
        *by, "metric", _rounded(F.col("original"), 4).alias("original"), _rounded(F.col("resampled"), 4).alias("resampled"),
        _rounded(F.col("improvement"), 4).alias("delta_absolute"), _rounded(_percent(), 2).alias("delta_percent"))


def flat_results(changes: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """The summary unrounded, one row per dataset, method, classifier and metric."""
    return changes.select(
        *by, "metric", F.col("original").alias("original_score"), F.col("resampled").alias("resampled_score"),
        "improvement", _percent().alias("improvement_percentage"))


def short_name(classifier: str = "classifier") -> Column:
    names = F.create_map(*[F.lit(v) for pair in SHORT_NAMES.items() for v in pair])
    return F.coalesce(names[F.col(classifier)], F.col(classifier))


def comparison(cv: DataFrame, metrics: Sequence[str] = PRIORITY_METRICS, methods: Sequence[str] = ()) -> DataFrame:
    """dataset, position, method, classificator and one text column of 4 decimals per metric:
    ``Original`` first, then ``methods`` in order, then any others, once per dataset."""
    order = _place(["Original", *methods], "method")
    wide = cv.groupBy("dataset", "method", "classifier").pivot("metric", list(metrics)).agg(F.max("mean"))
    return wide.select(
        "dataset", order.cast("int").alias("position"), "method", short_name().alias("classificator"),
        *[F.format_string("%.4f", F.col(m)).alias(m) for m in metrics])


def _place(values: Sequence[str], col: str) -> Column:
    """1-based place in the list; values that are not listed come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col)), F.lit(0).cast("bigint")), F.lit(len(values) + 1).cast("bigint"))


def best(cv: DataFrame, classifiers: Sequence[str], by: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """(by..., metric, classifier, mean) of the best classifier; the first listed wins ties."""
    order = Window.partitionBy(*by, "metric").orderBy(F.col("mean").desc(), _place(classifiers, "classifier"))
    listed = cv.filter(F.col("classifier").isin(list(classifiers)))
    return listed.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").select(*by, "metric", "classifier", "mean")


def improved_share(changes: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """(by..., improved, total, percent) of metrics that rose; without classifier in ``by``, overall."""
    counts = changes.groupBy(*by).agg(
        F.count_if(F.col("improvement") > 0).alias("improved"), F.count("improvement").alias("total"))
    return counts.filter("total > 0").withColumn("percent", F.col("improved") / F.col("total") * 100)


def best_gain(changes: DataFrame, classifiers: Sequence[str], by: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """(by..., metric, classifier, improvement) of the largest gain, if any; first listed on ties."""
    order = Window.partitionBy(*by, "metric").orderBy(F.col("improvement").desc(), _place(classifiers, "classifier"))
    top = changes.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1 AND improvement > 0")
    return top.select(*by, "metric", "classifier", "improvement")


def project_2d(points: DataFrame) -> tuple[DataFrame, list[float]]:
    """First two principal components of original and synthetic rows, and the explained shares.

    Standardisation and axes are fitted on the original rows alone. Two features are
    passed through. Each axis points to where its largest entry is positive.
    """
    original = points.filter(~F.col("is_synthetic"))
    stats = original.agg(mean_vector("features").alias("m"), std_vector("features", True).alias("s")).first()
    m = F.array(*[F.lit(float(v)) for v in stats["m"]])
    s = F.array(*[F.lit(float(v)) for v in stats["s"]])
    series = F.when(F.col("is_synthetic"), F.lit("synthetic")).otherwise(F.concat(F.lit("class_"), F.col("label").cast("string")))
    base = points.withColumn("series", series)
    if len(stats["m"]) == 2:
        out = base.select("row_id", "series", F.col("features")[0].alias("pc1"), F.col("features")[1].alias("pc2"))
        return out, [1.0, 1.0]
    scaled = F.zip_with(F.zip_with("features", m, lambda x, a: x - a), s, lambda x, b: F.when(b > 0, x / b).otherwise(0.0))
    ready = base.withColumn("_v", array_to_vector(scaled))
    model = PCA(k=2, inputCol="_v", outputCol="_o").fit(ready.filter(~F.col("is_synthetic")))
    axes = model.pc.toArray()
    signs = [1.0 if axes[abs(axes[:, i]).argmax(), i] >= 0 else -1.0 for i in range(2)]
    pcs = vector_to_array("_o")
    out = model.transform(ready).select(
        "row_id", "series", (pcs[0] * F.lit(signs[0])).alias("pc1"), (pcs[1] * F.lit(signs[1])).alias("pc2"))
    return out, [float(v) for v in model.explainedVariance]
