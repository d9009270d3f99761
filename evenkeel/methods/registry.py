"""Resampling methods by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import blocks
from evenkeel.functions.vectors import dimension
from evenkeel.operators import kernels
from evenkeel.operators.neighbours import Neighbours
from evenkeel.operators.runtime import settle, small_table

METHODS: dict[str, Callable] = {}


def register(*names: str):
    """Add a method under one or more names; ``fn(job)`` gives synthetic rows, or a
    (originals, synthetic) pair when it also changes the originals."""

    def add(fn):
        for name in names:
            METHODS[name] = fn
        return fn

    return add


@dataclass
class Job:
    """What a method needs: the points, who is short of rows, and shared neighbour joins."""

    points: DataFrame
    by: list[str]
    k: int = 5
    seed: int = 42
    strategy: object = "auto"
    options: dict = field(default_factory=dict)
    only: DataFrame | None = None  # restricts the groups that get rows

    @property
    def grp(self) -> list[str]:
        return [*self.by, "label"]

    @property
    def keys(self) -> list[str]:
        return [*self.by, "label", "rep"]

    @cached_property
    def needs(self) -> DataFrame:
        """(by..., label, n, n_needed) of the classes that are short."""
        needs = kernels.targets(self.points, "label", self.strategy, self.by).filter(F.col("n_needed") > 0)
        return small_table(needs if self.only is None else needs.transform(kernels.equi, self.only, self.grp, "left_semi"))

    @cached_property
    def codes(self) -> tuple[int, int]:
        return kernels.label_codes(self.needs)

    @cached_property
    def minority(self) -> DataFrame:
        """Rows of the classes that are short, taken out of the source once."""
        short = self.points.transform(kernels.equi, self.needs.select(*self.grp), self.grp, "left_semi")
        rows = settle(short.select(*self.by, "row_id", "label", "features"))
        twice = rows.groupBy(*self.by, "row_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).collect()
        if twice:  # joins by id would multiply rows
            raise ValueError(f"ids must be unique within {self.by or 'the table'}: {twice[0]['row_id']} occurs {twice[0]['_n']} times in the classes to fill")
        return rows

    @cached_property
    def dim(self) -> int:
        return dimension(self.points)

    @cached_property
    def large(self) -> bool:
        """Whether the rows of the classes that are short, and their lists, are too many to be sent to all tasks."""
        rows = self.needs.agg(F.sum("n")).first()[0] or 0
        return rows * 8 * (self.dim + 4 * self.k) > kernels.HELD_BYTES

    @cached_property
    def slots(self) -> DataFrame:
        return kernels.slots(self.needs, self.grp)

    @cached_property
    def lists(self) -> DataFrame:
        """k nearest rows of the same class, per minority row."""
        return kernels.pack_lists(self.own_long, self.grp)

    @cached_property
    def own_long(self) -> DataFrame:
        """(by..., label, q_id, rank, nbr_id, dist) within the class."""
        return settle(Neighbours(self.minority, by=self.grp, copies=self.k + 1).knn(self.minority, self.k))

    def crowd(self, k: int | None = None) -> DataFrame:
        """(by..., label, row_id, m, kk): how many of the kk nearest rows of all classes differ."""
        k = k or self.k
        refs = self.points.withColumn("nbr_label", F.col("label").cast("int"))
        long = Neighbours(refs, by=self.by, carry=["nbr_label"], copies=k + 1).knn(self.minority, k)
        own = self.minority.select(*self.by, "label", "row_id")
        judged = long.withColumnRenamed("q_id", "row_id").transform(kernels.equi, own, [*self.by, "row_id"])
        differs = F.sum((F.col("nbr_label") != F.col("label")).cast("bigint"))
        return settle(judged.groupBy(*self.grp, "row_id").agg(differs.alias("m"), F.count(F.lit(1)).alias("kk")))

    @cached_property
    def others(self) -> DataFrame:
        """(by..., label, row_id, own_label, features): for every short class, the rows of other classes."""
        short = self.needs.select(*self.grp)
        rows = self.points.withColumnRenamed("label", "own_label")
        return kernels.equi(rows, short, self.by).filter(F.col("own_label") != F.col("label")).select(
            *self.grp, "row_id", "own_label", "features")

    def massed(self, rows: DataFrame, grp) -> DataFrame:
        """Identical vectors as one row with a ``weight``: copies are counted, not met one by one."""
        return rows.groupBy(*grp, "features").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("weight"))

    def within(self, queries: DataFrame, refs: DataFrame, grp, closed: bool) -> DataFrame:
        """(grp..., row_id, inside): rows of ``refs`` in the ball of ``radius`` around each query, itself included."""
        index = Neighbours(self.massed(refs, grp), by=grp, carry=["weight"])
        parts = index.meet(queries, blocks.ball_stats(closed, False), "count bigint, total double",
                           extra=["radius"], reach="radius")
        sums = parts.groupBy(*grp, "q_id").agg(F.sum("count").alias("inside"))
        return sums.withColumnRenamed("q_id", "row_id")

    def base_vec(self, made: DataFrame, how: str = "inner") -> DataFrame:
        return kernels.attach(made, self.minority, self.by, "base_id", how, self.large, x="features")

    def nbr_vec(self, made: DataFrame, how: str = "left") -> DataFrame:
        return kernels.attach(made, self.minority, self.by, "nbr_id", how, self.large, nbr="features")

    def restricted(self, groups: DataFrame) -> "Job":
        """The same job for some of its groups only."""
        return Job(self.points, self.by, self.k, self.seed, self.strategy, self.options, groups)


def fit_resample(
    df: DataFrame, method: str = "SMOTE", id: str = "row_id", label: str = "label", features: str = "features",
    by: Sequence[str] = (), seed: int = 42, k: int = 5, strategy="auto", **options,
) -> DataFrame:
    """Balance ``df``: original rows and synthetic ones.

    Gives ``by..., row_id, label, features, is_synthetic, base_id, nbr_id, rep``. Groups
    of ``by`` (datasets, folds) are resampled apart in the same job. Ids are integers >= 0,
    unique within ``by``; synthetic rows get negative ids.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if method not in METHODS:
        raise KeyError(f"unknown method {method!r}; known: {', '.join(sorted(METHODS))}")
    by = list(by)
    points = df.select(
        *by, F.col(id).cast("bigint").alias("row_id"), F.col(label).cast("int").alias("label"),
        F.col(features).cast("array<double>").alias("features"))
    kernels.targets(points, "label", strategy, by)  # raises early on an unknown strategy
    job = Job(points, by, k, seed, strategy, options)
    made = METHODS[method](job)
    if isinstance(made, tuple):
        points, made = made
    return kernels.union_result(points, made, by, job.codes if made is not None else (0, kernels.LABEL_SPAN))
