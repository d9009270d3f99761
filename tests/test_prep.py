import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import donors, neighbours, prep, split
from evenkeel.plans.recipes import RECIPES, prepare
from evenkeel.sources import datasets


def test_dedupe_keeps_the_first_label_and_equal_nulls(spark):
    df = spark.createDataFrame([(3, 1.0, None, 0), (1, 1.0, None, 1), (2, 1.0, 2.0, 0), (4, 1.0, 2.0, 1)], "id long, a double, b double, y int")
    assert sorted((r["id"], r["y"]) for r in prep.dedupe(df, ["a", "b"], "id").collect()) == [(1, 1), (2, 0)]


def test_scalers_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (9.0, 5.0)], "x double, c double")
    std = prep.fit_scale(df, ["x", "c"], "standard").transform(df).toPandas()
    assert math.isclose(std["x"][0], -0.9733285267845753) and (std["c"] == 0).all()
    mm = prep.fit_scale(df, ["x", "c"], "minmax").transform(df).toPandas()
    assert mm["x"].tolist() == [0.0, 0.125, 0.375, 1.0] and (mm["c"] == 0).all()
    with pytest.raises(ValueError):
        prep.fit_scale(df, ["x"], "robust")


def test_outlier_rules(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], "x double, c double")
    assert prep.drop_outliers(df, ["x"], "iqr").count() == 9
    assert prep.drop_outliers(df, ["x", "c"], "zscore").count() == 10  # |z| of 100 is below 3 in ten rows
    assert prep.drop_outliers(df, ["x"], "none").count() == 10
    far = df.unionByName(spark.createDataFrame([(float(v), 1.0) for v in [5] * 20], "x double, c double"))
    assert prep.drop_outliers(far, ["x", "c"], "zscore").agg(F.max("x")).first()[0] == 9.0


def test_modes_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",), ("c",)], "s string")
    assert prep.modes(df, ["s"]) == {"s": "a"}


def test_encoders(spark):
    train = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "b")], "id long, s string")
    new = spark.createDataFrame([(1, "c"), (2, "zz"), (3, "a")], "id long, s string")
    codes = prep.fit_encode(train, ["s"], "label").transform(new)
    assert {r["id"]: r["s"] for r in codes.collect()} == {1: 2, 2: 0, 3: 0}
    flags = prep.fit_encode(train, ["s"], "onehot").transform(new)
    assert flags.columns == ["id", "s_a", "s_b", "s_c"]
    assert {r["id"]: (r["s_a"], r["s_b"], r["s_c"]) for r in flags.collect()} == {1: (0, 0, 1), 2: (0, 0, 0), 3: (1, 0, 0)}


def nan_brute(rows, k, weights):
    x = np.array([[np.nan if v is None else v for v in r] for r in rows])
    out = x.copy()
    for i in range(len(x)):
        for j in np.nonzero(np.isnan(x[i]))[0]:
            cand = []
            for o in range(len(x)):
                both = ~np.isnan(x[i]) & ~np.isnan(x[o])
                if o != i and not np.isnan(x[o, j]) and both.any():
                    cand.append((round(float(np.sqrt(x.shape[1] / both.sum() * ((x[i] - x[o])[both] ** 2).sum())), 9), o))
            cand = sorted(cand)[:k]
            if not cand:
                out[i, j] = np.nanmean(x[:, j])
                continue
            d, v = np.array([c[0] for c in cand]), np.array([x[c[1], j] for c in cand])
            if weights == "uniform":
                out[i, j] = v.mean()
            else:
                out[i, j] = v[d == 0].mean() if (d == 0).any() else (v / d).sum() / (1 / d).sum()
    return out


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_knn_impute_matches_brute_force(spark, weights, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [tuple(None if rng.random() < 0.2 else float(rng.integers(0, 6)) for _ in range(3)) for _ in range(60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a double, b double, c double")
    want = nan_brute(rows, 5, weights)
    real = donors.nearest_donors
    for limits in ({}, {"direct_cells": 0, "rare": 3}, {"direct_cells": 0, "rare": 0, "local_bytes": 0}, {"direct_cells": 0, "rare": 0, "common": 2}):
        monkeypatch.setattr(prep, "nearest_donors", lambda *args: real(*args, **limits))
        got = prep.knn_impute(df, "id", ["a", "b", "c"], 5, weights).orderBy("id").toPandas()[["a", "b", "c"]].to_numpy()
        assert np.allclose(got, want)
    with pytest.raises(ValueError):
        prep.knn_impute(df.limit(9), "id", ["a", "b"])


def test_donors_meet_by_pattern(spark, monkeypatch):
    """Common patterns never meet all pairs, ties, copies and values that cannot be squared included."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 400, (6000, 3)).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:900] = x[900]  # copies
    x[:900, 2] = np.nan
    x[5990:, 0] = [1e200, -1e200, np.inf, 5, 5, 5, 5, 5, np.nan, 7]
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>").repartition(4)
    lacking = df.where("exists(features, v -> isnan(v))")
    met, real = [], neighbours.Neighbours

    def counted(refs, **kw):
        if not kw.get("metric", True):
            met.append(refs.count())
            return real(refs, **kw)
        return real(refs, block_rows=64, stream_queries=0, **kw)

    monkeypatch.setattr(donors, "Neighbours", counted)
    want = donors.nearest_donors(df, lacking, 3, 4)
    got = donors.nearest_donors(df, lacking, 3, 4, direct_cells=0, rare=20, local_bytes=0)
    assert met[0] == 6000 and met[2] < 60  # donors that the rows of common patterns meet one by one
    cols = ["q_id", "pos", "nbr_id", "dist", "value"]
    a, b = (f.select(cols).toPandas().sort_values(cols[:3]).reset_index(drop=True) for f in (got, want))
    assert len(a) > 5000 and np.allclose(a.to_numpy(), b.to_numpy())


def test_pipeline_never_learns_from_new_rows_nor_drops_them(spark):
    train = spark.createDataFrame([(i, float(i), "x" if i % 2 else "y") for i in range(30)] + [(99, 1000.0, "z")], "row_id long, a double, s string")
    model = prep.Prep(["a"], ["s"], "simple", "zscore", "onehot", "minmax").fit(train)
    new = spark.createDataFrame([(1, 58.0, "x"), (2, None, "q")], "row_id long, a double, s string")
    out = {r["row_id"]: r for r in model.transform(new).collect()}
    assert out[1]["a"] == 2.0 and out[1]["s_x"] == 1 and "s_z" not in model.transform(new).columns
    assert math.isclose(out[2]["a"], 15 / 29) and out[2]["s_x"] == out[2]["s_y"] == 0
    for missing in ("drop", "knn", "none"):
        prep.Prep(["a"], [], missing, "iqr", "label", "none").fit(train).transform(new).collect()


def test_splits_are_stratified_and_partition_free(spark):
    df = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    seen = []
    for parts in (1, 4, 16):
        held = split.stratified_holdout(df.repartition(parts))
        assert {r["label"]: r["n"] for r in held.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 36, 1: 4}
        seen.append(sorted(r["row_id"] for r in held.filter("is_test").collect()))
    assert seen[0] == seen[1] == seen[2]
    folds = split.stratified_folds(df).groupBy("fold", "label").count().collect()
    assert {r["count"] for r in folds if r["label"] == 1} == {4} and {r["count"] for r in folds if r["label"] == 0} == {36}


def test_recipe_for_census_like_rows(spark):
    recipe = RECIPES["Adult"]
    rows = [
        (i, " Private" if i % 3 else " ?", " BA", " Tech", " Married", " Wife" if i % 2 else " Own", " White", " Male", float(i), " X",
         " >50K." if i % 5 == 0 else " <=50K") for i in range(40)]
    cols = ["row_id", " workclass", " education", " occupation", " martial-status", " relationship", " race", " sex", " age", " native-country", " class"]
    out = prepare(spark.createDataFrame(rows, cols), recipe, "row_id")
    assert out.columns[-1] == " class" and " native-country" not in out.columns
    pdf = out.toPandas()
    assert set(pdf[" class"]) == {0, 1} and len(pdf) == 40 and not pdf.isnull().any().any()


def test_catalogue_and_versions(spark, tmp_path):
    with pytest.raises(KeyError):
        datasets.dataset("no such data")
    with pytest.raises(ValueError):
        datasets.dataset("Oil")
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(10)], "id long, a double, y int")
    path = str(tmp_path / "v")
    assert datasets.publish(df, path, "y") == 1
    assert datasets.publish(df.limit(6), path, "y", parent=1) == 2
    meta = {r["version"]: r for r in datasets.versions(spark, path).collect()}
    assert meta[2]["parent"] == 1 and meta[1]["total_samples"] == 10 and meta[1]["test_samples"] == 2
    assert datasets.load_version(spark, path).count() == 6 and datasets.load_version(spark, path, 1).count() == 10
    with pytest.raises(ValueError):
        datasets.publish(df, path, "y", parent=7)
    row = datasets.profile(spark.createDataFrame([(0,), (0,), (2,)], "y int"), "y", 0).first()
    assert row["imbalance_ratio"] == float("inf") and row["classes"] == 2
