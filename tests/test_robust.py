"""Null groups, full results by default, ranges that follow crowded keys, recipe order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.methods import clustered, density, model_based, noise, smote  # noqa: F401
from evenkeel.methods.registry import fit_resample
from evenkeel.operators import metrics, prep
from evenkeel.operators.scan import range_buckets
from evenkeel.plans.recipes import Recipe, prepare


def grouped(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in ("a", None):
        for i in range(24):
            rows.append((g, i, int(i < 6), [float(v) for v in rng.normal(size=2) + (i < 6)]))
    return spark.createDataFrame(rows, "site string, row_id bigint, label int, features array<double>")


@pytest.mark.parametrize("method", ["SMOTE", "ADASYN", "ROSE", "ASMOBD", "SMOTE_D"])
def test_a_null_group_is_a_group(spark, method):
    made = fit_resample(grouped(spark), method, by=["site"], k=3).filter("is_synthetic").groupBy("site").count().collect()
    counts = {r["site"]: r["count"] for r in made}
    assert counts.keys() == {"a", None} and counts[None] > 0
    if method in ("SMOTE", "ROSE"):
        assert counts == {"a": 12, None: 12}


def test_a_null_group_has_its_own_scores(spark):
    rows = [(g, y, int(p > 0.5), p) for g in ("a", None) for y, p in ((0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9))]
    preds = spark.createDataFrame(rows, "g string, y int, y_pred int, p1 double")
    assert {(r["g"], r["roc_auc"]) for r in metrics.evaluate(preds, ["g"]).collect()} == {("a", 1.0), (None, 1.0)}


@pytest.mark.parametrize("method", ["MDO", "Supervised_SMOTE"])
def test_classes_reach_their_size_whatever_the_model_says(spark, method):
    rng = np.random.default_rng(5)
    # the short class lies scattered in the middle of the other one
    rows = [(i, int(i < 8), [float(v) for v in rng.normal(size=3)]) for i in range(80)]
    points = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    made = fit_resample(points, method).filter("is_synthetic")
    assert made.count() == 64 and made.select("row_id").distinct().count() == 64


def test_ranges_follow_crowded_keys(spark):
    names = spark.range(4000).select(F.format_string("Customer#%09d", "id").alias("k"))
    scores = spark.range(4000).select((F.col("id") / 4e7).alias("k"))
    for df in (names, scores):
        sizes = [r["count"] for r in range_buckets(df, ["k"]).groupBy("_range").count().collect()]
        assert max(sizes) <= 2 * 4000 / 8
    codes = prep.levels(names, ["k"]).orderBy("level").select("code").collect()
    assert [r["code"] for r in codes] == list(range(4000))


def test_dropped_columns_count_until_the_encoding(spark):
    rows = [(1, "x", 1.0, "u", 0), (2, "x", 1.0, "v", 0), (3, "y", 2.0, "u", 1), (4, "y", 2.0, "u", 1)]
    df = spark.createDataFrame(rows, "id bigint, kind string, amount double, country string, label int")
    out = prepare(df, Recipe("label", drop=["country"], label_encode=["kind"]), "id")
    assert out.columns == ["id", "kind", "amount", "label"]
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3]  # rows 1 and 2 differ only in the dropped column


def test_repeated_ids_raise(spark):
    rows = [(1, 1, [0.0]), (1, 1, [0.5]), (2, 1, [1.0])] + [(10 + i, 0, [float(i)]) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    with pytest.raises(ValueError, match="unique"):
        fit_resample(df, "SMOTE").count()
    apart = df.withColumn("ds", F.when(F.col("features")[0] == 0.5, "b").otherwise("a"))
    assert fit_resample(apart, "SMOTE", by=["ds"]).filter("is_synthetic AND ds = 'a'").count() == 8


def test_versions_of_writers_at_the_same_time(spark, tmp_path):
    """Every writer has a number and all of its rows."""
    from concurrent.futures import ThreadPoolExecutor

    from evenkeel.sources import datasets

    path = f"{tmp_path}/set"

    def write(n):
        return n, datasets.publish(spark.createDataFrame([(i % 2, float(i)) for i in range(n)], "y int, x double"), path, "y")

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(write, [6, 8, 10, 12]))
    assert sorted(v for _, v in got) == [1, 2, 3, 4]
    assert {r["version"]: r["total_samples"] for r in datasets.versions(spark, path).collect()} == {v: n for n, v in got}
    assert all(datasets.load_version(spark, path, v).count() == n for n, v in got)
