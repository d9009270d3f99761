"""Stratified splits by seeded ranks inside each class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.scan import shuffled_index


def stratified_holdout(df: DataFrame, id: str = "row_id", label: str = "label", frac: float = 0.2, seed: int = 42,
                       by: Sequence[str] = ()) -> DataFrame:
    """Add ``is_test``: the first ceil(frac * n) rows of every class in seeded order."""
    ranked = shuffled_index(df, [*by, label], id, seed, "split", "_rank", "_n")
    return ranked.withColumn("is_test", F.col("_rank") <= F.ceil(F.lit(frac) * F.col("_n"))).drop("_rank", "_n")


def stratified_folds(df: DataFrame, id: str = "row_id", label: str = "label", k: int = 5, seed: int = 42,
                     by: Sequence[str] = ()) -> DataFrame:
    """Add ``fold`` in 0..k-1, dealt out inside every class in seeded order."""
    ranked = shuffled_index(df, [*by, label], id, seed, "fold", "_rank", "_n")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n")


def expand_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """One copy of every row per round ``f``; ``is_val`` where the row's fold is held out."""
    rounds = df.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rounds.withColumn("is_val", F.col("fold") == F.col("f"))
