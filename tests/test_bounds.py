"""Loops that must end, and ids and orders that must hold."""

import math

import pytest
from pyspark.sql import functions as F

from evenkeel.methods import density  # noqa: F401
from evenkeel.methods.registry import fit_resample
from evenkeel.operators.quantiles import exact_quantiles
from evenkeel.plans.report import comparison


def points(spark, rows):
    return spark.createDataFrame(rows, "row_id long, label int, features array<double>")


def test_sphere_radius_settles(spark):
    rows = [(0, 1, [0.0]), (1, 1, [5.0]), (2, 0, [0.64]), (3, 0, [-0.82]), (4, 0, [9.0]), (5, 0, [11.0])]
    got = fit_resample(points(spark, rows), "CCR", id="row_id", label="label", features="features", energy=1.0)
    assert 1 <= got.filter("is_synthetic").count() <= 2  # shares are rounded down


@pytest.mark.parametrize("odd", [math.inf, -math.inf, math.nan])
def test_quantiles_with_odd_values(spark, odd):
    df = spark.range(30_000).select(F.when(F.col("id") == 7, F.lit(odd)).otherwise(F.col("id").cast("double")).alias("x"))
    left = sorted(v for v in (odd if i == 7 else float(i) for i in range(30_000)) if v == v)
    want = [left[(len(left) - 1) // 2] * 0.5 + left[len(left) // 2] * 0.5]
    assert exact_quantiles(df, ["x"], [0.5], direct_rows=10)["x"] == want


@pytest.mark.parametrize("names", [(0, 1000, 2000), (-5, 0, 7), (0, 3, 2**31 - 1)])
def test_synthetic_ids_cannot_clash(spark, names):
    rows = [(i, names[0] if i < 12 else names[1 + i % 2], [float(i)]) for i in range(18)]
    from evenkeel.methods import smote  # noqa: F401

    made = fit_resample(points(spark, rows), "SMOTE", id="row_id", label="label", features="features", k=2).collect()
    assert len(made) == 36 and len({r["row_id"] for r in made}) == 36
    assert all(r["row_id"] < 0 for r in made if r["is_synthetic"])


def test_original_comes_first(spark):
    cv = spark.createDataFrame([("d", m, "LogisticRegression", "f1", 0.5) for m in ("SMOTE", "Original")], "dataset string, method string, classifier string, metric string, mean double")
    got = [r["method"] for r in comparison(cv, metrics=["f1"]).orderBy("position").collect()]
    assert got == ["Original", "SMOTE"]
