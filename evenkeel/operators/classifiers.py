"""Classifiers as fit-and-predict operators on point frames.

``predict(name, train, test, by)`` gives the test rows with ``y, y_pred, p1``. Nearest neighbours,
Gaussian naive Bayes, forests, trees, boosting, kernel machines and two-class logistic regression handle all ``by`` groups together; Spark ML models are
fitted once per group, several at a time, always from a fresh estimator.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.vectors import mean_vector, std_vector
from evenkeel.operators import logistic
from evenkeel.operators.boosting import Boosting
from evenkeel.operators.forest import Forest
from evenkeel.operators.groups import map_groups
from evenkeel.operators.kernels import equi
from evenkeel.operators.neighbours import Neighbours
from evenkeel.operators.svm import KernelSVM

CLASSIFIERS: dict[str, Callable] = {}


def classifier(name: str):
    def add(fn):
        CLASSIFIERS[name] = fn
        return fn

    return add


def select(names: Sequence[str]) -> dict[str, Callable]:
    """The chosen classifiers, in the registry's order."""
    unknown = [n for n in names if n not in CLASSIFIERS]
    if unknown:
        raise KeyError(f"unknown classifiers {unknown}; known: {', '.join(CLASSIFIERS)}")
    return {n: fn for n, fn in CLASSIFIERS.items() if n in names}


def predict(name: str, train: DataFrame, test: DataFrame, by: Sequence[str] = (), seed: int = 42, **options) -> DataFrame:
    return select([name])[name](train, test, list(by), seed, **options)


def _finish(df: DataFrame, by, p1) -> DataFrame:
    return df.select(*by, "row_id", F.col("label").alias("y"), (p1 > 0.5).cast("int").alias("y_pred"), p1.alias("p1"))


def _per_group(train: DataFrame, test: DataFrame, by, fit) -> DataFrame:
    """One independent fit per group, from a small pool of driver threads."""

    def one(key, part):
        rows = test
        for c in by:
            rows = rows.filter(F.col(c).eqNullSafe(F.lit(key[c])))
        ready = part.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
        model = fit(ready, part)
        held = rows.withColumn("features", array_to_vector("features"))
        scored = model.transform(held)
        p1 = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
        return scored.select(*by, "row_id", F.col("label").alias("y"), F.col("prediction").cast("int").alias("y_pred"), p1.alias("p1"))

    return reduce(DataFrame.unionByName, map_groups(train, by, one))


@classifier("CatBoost")
def boosted_trees(train, test, by, seed, rounds: int = 1000, depth: int = 6, patience: int | None = None):
    """Ordered boosting of oblivious trees: ``rounds`` of them, or with ``patience`` fewer where a held-out loss stops falling."""
    shares = Boosting(train, by, rounds=rounds, depth=depth, patience=patience, seed=seed).predict(test)
    return _finish(test.transform(equi, shares.withColumnRenamed("share", "_p"), [*by, "row_id"]), by, F.col("_p"))


def _forest(train, test, by, **options) -> DataFrame:
    """All groups in one fit; shares of class 1 are the probabilities."""
    model = Forest(train, by, **options)
    one = F.get("shares", F.lit(model.labels.index(1))) if 1 in model.labels else F.lit(0.0)
    scored = test.transform(equi, model.predict(test).select(*by, "row_id", one.alias("_p")), [*by, "row_id"])
    return _finish(scored, by, F.col("_p"))


@classifier("RandomForest")
def random_forest(train, test, by, seed, trees: int = 100, depth: int | None = None):
    """Bootstrapped trees over the square root of the features a node, grown until pure unless ``depth`` is given."""
    return _forest(train, test, by, trees=trees, depth=depth, seed=seed)


@classifier("SVM")
def rbf_svm(train, test, by, seed, landmarks: int = 512, cost: float = 1.0, tol: float = 1e-3):
    """RBF-kernel SVM of all groups in one fit (``operators/svm.py``): classes by the sign of the margin, probabilities by a logistic curve on
    cross-validated margins, so that the two may differ near the border."""
    scored = KernelSVM(train, by, landmarks=landmarks, cost=cost, tol=tol, seed=seed).predict(test)
    full = test.transform(equi, scored, [*by, "row_id"])
    return full.select(*by, "row_id", F.col("label").alias("y"), (F.col("margin") > 0).cast("int").alias("y_pred"), F.col("share").alias("p1"))


@classifier("kNN")
def nearest_neighbours(train, test, by, seed, k: int = 5):
    """Share of positives among the 5 nearest training rows."""
    refs = train.withColumn("nbr_label", F.col("label").cast("int"))
    long = Neighbours(refs, by=by, carry=["nbr_label"], copies=k).knn(test, k, skip_self=False)
    votes = long.groupBy(*by, F.col("q_id").alias("row_id")).agg(F.avg("nbr_label").alias("_p"))
    return _finish(test.transform(equi, votes, [*by, "row_id"]), by, F.col("_p"))


@classifier("LogisticRegression")
def logistic_regression(train, test, by, seed):
    """Ridge penalty of C = 1 in sum-of-losses terms, no standardisation. Several groups of two classes 0 and 1 and at most ``logistic.WIDEST`` features: all in one fit
    (``operators/logistic.py``); a single group and others go to Spark ML, which takes regParam = 1 / rows, one fit a group. Its shares may be some 1e-6 from the optimum."""
    odd = F.coalesce(~F.col("label").isin(0, 1), F.lit(True)) | F.coalesce(F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    counts = train.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), F.max(odd).alias("odd"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high")).collect()  # a row a group
    dims = {r[c] for r in counts for c in ("low", "high")}
    if len(counts) > 1 and len(dims) == 1 and 0 < min(dims) <= logistic.WIDEST and not any(r["odd"] for r in counts):
        scored = logistic.Logistic(train, by, counts, min(dims)).predict(test)
        return scored.select(*by, "row_id", F.col("label").alias("y"), (F.col("share") > 0.5).cast("int").alias("y_pred"), F.col("share").alias("p1"))

    def fit(ready, part):
        return LogisticRegression(maxIter=1000, regParam=1.0 / max(1, part.count()), standardization=False).fit(ready)

    return _per_group(train, test, by, fit)


@classifier("DecisionTree")
def decision_tree(train, test, by, seed, depth: int | None = None):
    """One tree on all rows and features, grown until pure unless ``depth`` is given."""
    return _forest(train, test, by, trees=1, depth=depth, seed=seed, mtry=0, bootstrap=False)


@classifier("NaiveBayes")
def gaussian_bayes(train, test, by, seed):
    """Gaussian naive Bayes in closed form: one aggregate to fit, one expression to score. Variances
    are raised by 1e-9 of the largest feature variance."""
    stats = train.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("n"), mean_vector("features").alias("mu"), std_vector("features", True).alias("sd"))
    whole = train.groupBy(*by).agg(F.array_max(std_vector("features", True)).alias("_top"), F.count(F.lit(1)).alias("_all"))
    fitted = equi(stats, whole, by)
    fitted = fitted.withColumn("var", F.transform("sd", lambda s: s * s + F.col("_top") * F.col("_top") * 1e-9))
    logs = F.aggregate("var", F.lit(0.0), lambda acc, v: acc + F.log(F.lit(2 * math.pi) * v)) * -0.5
    fitted = fitted.withColumn("const", F.log(F.col("n") / F.col("_all")) + logs)
    # one or two rows per group
    sides = fitted.groupBy(*by).agg(*[
        F.max(F.when(F.col("label") == c, F.struct("const", "mu", "var"))).alias(f"c{c}") for c in (0, 1)])
    scored = equi(test, sides, by)

    def loglik(side):
        gaps = F.zip_with(F.zip_with("features", f"{side}.mu", lambda x, m: (x - m) * (x - m)), f"{side}.var", lambda g, v: g / v)
        return F.col(f"{side}.const") - F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v) / 2

    p1 = F.when(F.col("c1").isNull(), 0.0).when(F.col("c0").isNull(), 1.0).otherwise(
        1 / (1 + F.exp(loglik("c0") - loglik("c1"))))
    return _finish(scored.withColumn("_p", p1), by, F.col("_p"))
