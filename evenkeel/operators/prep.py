"""Profiling and cleaning: projections, filters, fitted imputers, encoders and scalers.

Fitted state is a handful of numbers per column, or a level table; ``transform`` is a
lazy select (plus a join for level tables and nearest-neighbour donors).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators.donors import nearest_donors
from evenkeel.operators.quantiles import exact_quantiles
from evenkeel.operators.runtime import settle
from evenkeel.operators.scan import range_buckets, running_sums

MAX_LEVELS = 5_000  # of one column

# ---- profiling -----------------------------------------------------------


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names by type; other types are in neither."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return numeric, text


def distinct_ratio(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """One row of distinct non-null values / all rows per column."""
    if approx:
        return df.agg(*[(F.approx_count_distinct(c) / F.count(F.lit(1))).alias(c) for c in cols])
    # one long frame, counted in two map-side combined steps, instead of one distinct plan per column
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
    long = df.select(F.explode(cells).alias("s")).select("s.c", "s.v").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    ratios = long.groupBy().pivot("c", list(cols)).agg(F.count("v") / F.sum("n"))
    return ratios


def continuous_columns(df: DataFrame, cols: Sequence[str], ratio: float = 0.1, extra: Sequence[str] = (), approx: bool = False) -> list[str]:
    """Columns with more than ``ratio`` distinct values per row, then ``extra``."""
    row = distinct_ratio(df, cols, approx).first()
    return [c for c in cols if row[c] is not None and row[c] > ratio] + list(extra)


def missing_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, missing)."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column", "missing")


def value_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, lo, hi), and a last row ``*`` over all columns."""
    stats = df.agg(*[a for c in cols for a in (F.min(F.col(c).cast("double")).alias(f"lo_{c}"), F.max(F.col(c).cast("double")).alias(f"hi_{c}"))])
    each = [F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in cols]
    whole = F.struct(
        F.lit("*").alias("column"), F.array_min(F.array(*[F.col(f"lo_{c}") for c in cols])).alias("lo"),
        F.array_max(F.array(*[F.col(f"hi_{c}") for c in cols])).alias("hi"))
    return stats.select(F.explode(F.array(*each, whole)).alias("s")).select("s.*")


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct()


# ---- row and value cleaning ---------------------------------------------


def sentinel_to_null(df: DataFrame, cols: Sequence[str], sentinel: str) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in cols})


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def canonicalise(df: DataFrame, col: str, mapping: dict) -> DataFrame:
    """Replace listed values, keep the others."""
    return df.withColumn(col, F.coalesce(_lookup(mapping)[F.col(col)], F.col(col)))


def _lookup(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])


def dedupe(df: DataFrame, features: Sequence[str], id: str) -> DataFrame:
    """Keep the row of smallest id among rows with equal features (nulls equal), label and all."""
    same = Window.partitionBy(*features).orderBy(id)
    return df.withColumn("_rn", F.row_number().over(same)).filter("_rn = 1").drop("_rn")


def keep_mostly_present(df: DataFrame, cols: Sequence[str], share: float) -> DataFrame:
    """Rows whose share of nulls among ``cols`` is below ``share``."""
    nulls = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.filter(nulls / F.lit(len(cols)) < share)


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(cols))


def binarise_members(df: DataFrame, label: str, positive: Sequence) -> DataFrame:
    """1 where the label is one of ``positive``, else 0."""
    return df.withColumn(label, F.col(label).isin(list(positive)).cast("int"))


def binarise_map(df: DataFrame, label: str, mapping: dict) -> DataFrame:
    """Labels through a map; unlisted ones become null."""
    return df.withColumn(label, _lookup(mapping)[F.col(label)].cast("int"))


# ---- imputation ----------------------------------------------------------


@dataclass(frozen=True)
class Imputer:
    """Fitted fill values: medians of numeric, most frequent values of categorical columns."""

    values: dict

    def transform(self, df: DataFrame) -> DataFrame:
        known = {c: v for c, v in self.values.items() if v is not None}
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in known.items()}) if known else df


def modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-null value per column as text, ties to the smallest."""
    if not cols:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
    counts = df.select(F.explode(cells).alias("s")).select("s.*").filter("v IS NOT NULL").groupBy("c", "v").agg(
        F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    return {r["c"]: r["v"] for r in best.collect()}  # one row per column


def fit_impute(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> Imputer:
    middle = {c: q[0] for c, q in exact_quantiles(df, numeric, [0.5]).items()}
    return Imputer({**middle, **modes(df, categorical)})


def knn_impute(df: DataFrame, id: str, cols: Sequence[str], k: int | None = None, weights: str = "uniform",
               donors: DataFrame | None = None) -> DataFrame:
    """Fill nulls of ``cols`` from the k nearest rows that have the feature.

    Distance is over the features both rows have, scaled up by features / shared ones.
    ``uniform`` averages; ``distance`` weighs by 1/distance, zero distances taking all.
    Without ``k``: min(5, rows // 10), an error below 10 rows. A value without any donor gets
    the column mean. Rows meet donors pattern by pattern of present features (``operators/donors.py``).
    """
    cols = list(cols)
    pool = df if donors is None else donors
    if k is None:
        k = min(5, pool.count() // 10)
        if k < 1:
            raise ValueError("nearest-neighbour imputation needs at least 10 rows")
    nan = F.lit(float("nan"))
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in cols]).alias("features")
    key = F.col(id).cast("bigint").alias("row_id")
    gaps = F.array_max(F.array(*[F.col(c).isNull().cast("int") for c in cols])) == 1
    best = nearest_donors(pool.select(key, vec), df.filter(gaps).select(key, vec), len(cols), k)
    if weights == "distance":
        exact = F.max((F.col("dist") == 0).cast("int"))
        zero = F.sum(F.when(F.col("dist") == 0, F.col("value"))) / F.sum((F.col("dist") == 0).cast("int"))
        near = F.sum(F.when(F.col("dist") > 0, F.col("value") / F.col("dist"))) / F.sum(F.when(F.col("dist") > 0, 1 / F.col("dist")))
        filled = F.when(exact == 1, zero).otherwise(near)
    elif weights == "uniform":
        filled = F.avg("value")
    else:
        raise ValueError(f"unknown weights {weights!r}")
    means = pool.agg(*[F.avg(c).alias(c) for c in cols]).first()
    wide = best.groupBy("q_id", "pos").agg(filled.alias("v")).groupBy("q_id").agg(
        *[F.max(F.when(F.col("pos") == i, F.col("v"))).alias(f"_f{i}") for i in range(len(cols))])
    joined = df.join(wide, df[id] == wide["q_id"], "left")
    picks = {
        c: F.coalesce(F.col(c).cast("double"), F.col(f"_f{i}"), F.lit(means[c]).cast("double")) for i, c in enumerate(cols)}
    return joined.withColumns(picks).select(*df.columns)


@dataclass(frozen=True)
class KnnImputer:
    """Training rows as donors for later data."""

    donors: DataFrame
    id: str
    cols: list[str]
    k: int | None = None
    weights: str = "uniform"

    def transform(self, df: DataFrame) -> DataFrame:
        return knn_impute(df, self.id, self.cols, self.k, self.weights, self.donors)


# ---- outliers ------------------------------------------------------------


def outlier_limits(df: DataFrame, cols: Sequence[str], how: str) -> dict[str, tuple]:
    """``iqr``: {col: (low, high)} inclusive; ``zscore``: {col: (mean, population sd)}."""
    if how == "iqr":
        found = exact_quantiles(df, cols, [0.25, 0.75])
        return {c: (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])) for c, q in found.items() if q[0] is not None}
    if how == "zscore":
        row = df.agg(*[a for c in cols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}
    raise ValueError(f"unknown outlier rule {how!r}")


def drop_outliers(df: DataFrame, cols: Sequence[str], how: str = "zscore") -> DataFrame:
    """Rows inside the limits on all ``cols``. Columns without spread are skipped under
    ``zscore`` (dividing by zero would drop every row). ``none`` passes everything."""
    if how == "none" or not cols:
        return df
    keep = F.lit(True)
    for c, (a, b) in outlier_limits(df, cols, how).items():
        if how == "iqr":
            keep = keep & (F.col(c) >= F.lit(a)) & (F.col(c) <= F.lit(b))
        elif b:
            keep = keep & (F.abs((F.col(c) - F.lit(a)) / F.lit(b)) < 3)
    return df.filter(keep)


# ---- encoders ------------------------------------------------------------


def levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col, level, code): sorted non-null levels of each column, numbered from 0."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("level")) for c in cols])
    found = df.select(F.explode(cells).alias("s")).select("s.*").filter("level IS NOT NULL").distinct()
    ordered = range_buckets(found, ["col", "level"])
    ranked = running_sums(ordered, ["col"], ["level"], F.col("_range"), {"code": F.lit(1).cast("bigint")})
    return ranked.select("col", "level", (F.col("code") - 1).alias("code"))


@dataclass(frozen=True)
class LabelEncoder:
    table: DataFrame
    cols: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """Codes in place of levels; unseen levels get code 0."""
        for c in self.cols:
            side = self.table.filter(F.col("col") == c).select(F.col("level").alias("_level"), F.col("code").alias("_code"))
            joined = df.join(side, F.col(c).cast("string") == F.col("_level"), "left")
            df = joined.withColumn(c, F.coalesce("_code", F.lit(0).cast("bigint"))).drop("_level", "_code")
        return df


@dataclass(frozen=True)
class OneHotEncoder:
    known: dict[str, list[str]]

    def transform(self, df: DataFrame) -> DataFrame:
        """0/1 columns ``col_level`` after the others; unknown levels are all zeros."""
        flags = {
            f"{c}_{v}": F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0))
            for c, values in self.known.items() for v in values}
        return df.withColumns(flags).drop(*self.known) if flags else df.drop(*self.known)


def fit_encode(df: DataFrame, cols: Sequence[str], how: str = "label", max_levels: int = MAX_LEVELS):
    """One-hot columns are schema, held by the driver: a column with more than ``max_levels`` levels is an error."""
    cols = list(cols)
    if how == "label":
        return LabelEncoder(settle(levels(df, cols)) if cols else df, cols)
    if how == "onehot":
        if not cols:
            return OneHotEncoder({})
        rows = levels(df, cols).filter(F.col("code") <= max_levels).collect()
        wide = [r["col"] for r in rows if r["code"] == max_levels]
        if wide:
            raise ValueError(f"more than {max_levels} levels in {', '.join(wide)}: use label encoding or raise max_levels")
        known = {c: [] for c in cols}
        for r in sorted(rows, key=lambda r: r["code"]):
            known[r["col"]].append(r["level"])
        return OneHotEncoder(known)
    raise ValueError(f"unknown encoding {how!r}")


def dummies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-hot columns of all levels found."""
    return fit_encode(df, cols, "onehot").transform(df)


# ---- scalers -------------------------------------------------------------


@dataclass(frozen=True)
class Scaler:
    """``(x - shift) / size``; 0 where the column has no spread."""

    parts: dict[str, tuple]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, (shift, size) in self.parts.items():
            if shift is None:
                continue
            value = (F.col(c) - F.lit(float(shift))) / F.lit(float(size)) if size else F.col(c) * F.lit(0.0)
            new[c] = value
        return df.withColumns(new) if new else df


def fit_scale(df: DataFrame, cols: Sequence[str], how: str = "minmax") -> Scaler:
    """``standard`` uses the population deviation, ``minmax`` goes to [0, 1]; one aggregate for all columns."""
    cols = list(cols)
    if how == "none" or not cols:
        return Scaler({})
    if how == "standard":
        first, second = F.avg, F.stddev_pop
    elif how == "minmax":
        first, second = F.min, F.max
    else:
        raise ValueError(f"unknown scaling {how!r}")
    row = df.agg(*[a for c in cols for a in (first(F.col(c).cast("double")).alias(f"a_{c}"), second(F.col(c).cast("double")).alias(f"b_{c}"))]).first()
    if how == "standard":
        return Scaler({c: (row[f"a_{c}"], row[f"b_{c}"]) for c in cols})
    return Scaler({c: (row[f"a_{c}"], None if row[f"a_{c}"] is None else row[f"b_{c}"] - row[f"a_{c}"]) for c in cols})


def selective_scale(df: DataFrame, cols: Sequence[str], keep: Sequence[str], how: str = "minmax") -> DataFrame:
    """Scale ``cols`` except ``keep``, which go unscaled to the end."""
    scaled = fit_scale(df, [c for c in cols if c not in keep], how).transform(df)
    return scaled.select(*[c for c in scaled.columns if c not in keep], *keep)


# ---- fit / transform pipeline -------------------------------------------


@dataclass(frozen=True)
class Prep:
    """Missing values -> outliers (while fitting only) -> encoding -> scaling."""

    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    missing: str = "simple"  # none, drop, simple, knn
    outliers: str = "none"  # none, iqr, zscore
    encoding: str = "onehot"  # label, onehot
    scaling: str = "standard"  # none, standard, minmax
    id: str = "row_id"
    k: int | None = None

    def fit(self, df: DataFrame) -> "PrepModel":
        numeric, categorical = list(self.numeric), list(self.categorical)
        steps: list = []
        if self.missing == "drop":
            df = drop_missing(df, [*numeric, *categorical])
        elif self.missing == "simple":
            steps.append(fit_impute(df, numeric, categorical))
        elif self.missing == "knn":
            steps.append(KnnImputer(df, self.id, numeric, self.k))
            steps.append(fit_impute(df, (), categorical))
        elif self.missing != "none":
            raise ValueError(f"unknown handling of missing values {self.missing!r}")
        for step in steps:
            df = step.transform(df)
        kept = drop_outliers(df, numeric, self.outliers)
        if categorical:
            steps.append(fit_encode(kept, categorical, self.encoding))
        steps.append(fit_scale(kept, numeric, self.scaling))
        return PrepModel(self, steps)


@dataclass(frozen=True)
class PrepModel:
    prep: Prep
    steps: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Never drops outliers; fitted values come from the training rows alone."""
        if self.prep.missing == "drop":
            df = drop_missing(df, [*self.prep.numeric, *self.prep.categorical])
        for step in self.steps:
            df = step.transform(df)
        return df
