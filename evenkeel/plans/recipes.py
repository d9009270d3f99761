"""Preparation recipes: raw table -> numeric features and a binary label.

Order: canonical values -> binary label -> dedupe -> rows with too much missing ->
imputation -> outliers -> encoding -> dropped columns -> scaling. The label stays in the row throughout.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators import prep
from evenkeel.operators.runtime import settle


@dataclass(frozen=True)
class Recipe:
    label: str
    label_map: dict | None = None
    positive: Sequence | None = None
    sentinel: str | None = None
    canonical: dict = field(default_factory=dict)
    drop: Sequence[str] = ()
    dedupe: bool = True
    max_missing: float | None = None
    impute: str = "none"  # none, knn (distance weights for numbers, most frequent for text), simple
    outliers: str = "none"
    label_encode: Sequence[str] = ()
    one_hot: Sequence[str] = ()
    scaling: str = "none"
    unscaled: Sequence[str] = ()


# fixed values: how each dataset of the test bench is prepared
RECIPES: dict[str, Recipe] = {
    "Phoneme": Recipe(" Class", max_missing=0.4, impute="knn", outliers="zscore", scaling="minmax"),
    "Adult": Recipe(
        " class", canonical={" >50K.": " >50K", " <=50K.": " <=50K"}, label_map={" <=50K": 0, " >50K": 1}, sentinel=" ?",
        max_missing=0.4, impute="knn", drop=[" native-country"], label_encode=[" workclass", " education", " occupation"],
        one_hot=[" martial-status", " relationship", " race", " sex"], scaling="minmax",
        unscaled=[" workclass", " education", " occupation"]),
    "Haberman": Recipe(" 4", label_map={1: 0, 2: 1}, max_missing=0.35, impute="knn", scaling="minmax"),
    "Ionosphere": Recipe("target", label_map={"b": 0, "g": 1}, scaling="minmax", unscaled=["a01", "a02"]),
    "Forest coverage": Recipe(" class", positive=[1, 2, 3], scaling="minmax"),
    "Mammography": Recipe(" 7", label_map={"'-1'": 0, "'1'": 1}, max_missing=0.35, impute="knn", scaling="minmax"),
    "Oil": Recipe("target", label_map={-1: 0, 1: 1}, max_missing=0.35, scaling="minmax"),
    "Pima diabetes": Recipe("Outcome", max_missing=0.35, scaling="minmax"),
    "Satimage": Recipe("target", label_map={-1: 0, 1: 1}, max_missing=0.35, scaling="minmax"),
    "Abalone": Recipe("target", label_map={-1: 0, 1: 1}),
    "Ecoli": Recipe("target", label_map={-1: 0, 1: 1}),
    "us_crime": Recipe("target", label_map={-1: 0, 1: 1}, dedupe=False),
    "yeast_ml8": Recipe("target", label_map={-1: 0, 1: 1}, dedupe=False),
}


def prepare(df: DataFrame, recipe: Recipe, id: str) -> DataFrame:
    """Apply a recipe to a table with a unique integer ``id``."""
    label = recipe.label
    features = [c for c in df.columns if c not in (id, label)]
    numeric, text = prep.split_columns(df.select(*features))
    # chosen on the raw table: cleaning may change how many values a column has
    continuous = prep.continuous_columns(df, numeric) if recipe.outliers != "none" else []
    if recipe.sentinel is not None:
        df = prep.sentinel_to_null(df, text, recipe.sentinel)
    if recipe.canonical:
        df = prep.canonicalise(df, label, recipe.canonical)
    if recipe.positive is not None:
        df = prep.binarise_members(df, label, recipe.positive)
    elif recipe.label_map is not None:
        df = prep.binarise_map(df, label, recipe.label_map)
    if recipe.dedupe:
        df = prep.dedupe(df, features, id)
    if recipe.max_missing is not None:
        df = prep.keep_mostly_present(df, features, recipe.max_missing)
    if recipe.impute != "none":
        df = settle(df)
        if recipe.impute == "knn":
            gaps = prep.fit_impute(df, (), text)
            df = prep.knn_impute(df, id, numeric, 5, "distance")
            df = gaps.transform(df)
        else:
            df = prep.fit_impute(df, numeric, text).transform(df)
    if recipe.outliers != "none":
        df = settle(df)
        df = prep.drop_outliers(df, continuous, recipe.outliers)
    if recipe.label_encode:
        df = prep.fit_encode(df, recipe.label_encode, "label").transform(df)
    if recipe.one_hot:
        df = prep.dummies(df, recipe.one_hot)
    if recipe.drop:
        df = df.drop(*recipe.drop)
    if recipe.scaling != "none":
        df = settle(df)
        cols = [c for c in df.columns if c not in (id, label)]
        df = prep.selective_scale(df, cols, recipe.unscaled, recipe.scaling)
    rest = [c for c in df.columns if c not in (id, label)]
    return df.select(id, *rest, F.col(label).cast("int").alias(label))
