"""Array-of-double arithmetic as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VEC = "array<double>"


def pack(cols: Sequence[str]) -> Column:
    """Named numeric columns -> one feature array."""
    return F.array(*[F.col(c).cast("double") for c in cols])


def _fold_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _fold_sum(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance, summed left to right."""
    return F.sqrt(_fold_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: a lambda computes anew, for every element, whatever its body names from outside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lerp(a: Column, b: Column, share: Column) -> Column:
    """``a + share * (b - a)``, one share for the whole row."""
    return let(share, lambda s: F.zip_with(a, b, lambda x, y: x + s * (y - x)))


def explode_features(df: DataFrame, vec: str = "features", keep: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """(keep..., pos, val): flat form used for comparison and reports."""
    flat = df.select(*keep, F.posexplode(vec).alias("pos", "val"))
    # + 0.0 folds negative zero into zero
    return flat.withColumn("val", F.round("val", digits) + F.lit(0.0))


def _summary(metric: str, vec, weight=None) -> Column:
    column = array_to_vector(F.col(vec) if isinstance(vec, str) else vec)
    return vector_to_array(getattr(Summarizer, metric)(column, weight))


def mean_vector(vec, weight: Column | None = None) -> Column:
    """Element-wise (weighted) mean, one aggregate whatever the length."""
    return _summary("mean", vec, weight)


def sum_vector(vec) -> Column:
    """Element-wise sum aggregate."""
    return _summary("sum", vec)


def std_vector(vec, population: bool = False) -> Column:
    """Element-wise standard deviation aggregate; 0 for a single row."""
    sample = _summary("std", vec)
    if not population:
        return sample
    n = F.count(F.lit(1))
    return F.transform(sample, lambda s: s * F.sqrt((n - 1) / n))


def dimension(df: DataFrame, vec: str = "features") -> int:
    """Length of the feature array, read from one row."""
    row = df.select(F.size(vec)).first()
    return int(row[0]) if row else 0
