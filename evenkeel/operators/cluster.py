"""Clusters inside groups: fitting, assignment, sparsity, allocation.

A *centers* frame is ``grp..., cluster BIGINT, center ARRAY<DOUBLE>``; it holds at most
k rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions import blocks
from evenkeel.operators import kmeans
from evenkeel.operators.kernels import equi
from evenkeel.operators.neighbours import Neighbours


def _wanted(k, key: tuple, n: int) -> int:
    """``k`` is a number, a function of a group's rows, or a number by key."""
    return max(1, min(n, k(n) if callable(k) else k[key] if isinstance(k, dict) else k))


def fit_centers(rows: DataFrame, grp: Sequence[str], k, seed: int, restarts: int = 10, bisecting: bool = False) -> DataFrame:
    """k-means centers per group, the cheapest of ``restarts`` seeded fits; fewer where a group has fewer different rows.

    ``k`` is a number, a function of the group's rows, or a dict by key. All groups are fitted together (``operators/kmeans.py``).
    """
    groups = kmeans.Groups(rows, grp)
    wanted = {g: _wanted(k, groups.keys[g], n) for g, n in groups.sizes.items()}
    if bisecting:
        return groups.table(groups.solve(dict.fromkeys(wanted, 1), seed, 1, lambda measure, starts, _: kmeans.bisect(measure, starts, wanted)))
    return groups.table(groups.solve(wanted, seed, restarts, lambda measure, starts, _: kmeans.best_of(measure, starts)))


def estimate_k(rows: DataFrame, grp: Sequence[str] = (), k_max: int = 20, seed: int = 42) -> dict[tuple, int]:
    """Number of clusters by group key, by X-Means from two k-means++ centers: 1 below two rows, else 2 .. min(k_max, n)."""
    groups = kmeans.Groups(rows, grp)
    top = {g: min(k_max, n) for g, n in groups.sizes.items()}
    found = groups.solve({g: min(2, n) for g, n in groups.sizes.items()}, seed, 1, lambda measure, starts, _: kmeans.xmeans(measure, starts, top))
    return {groups.keys[g]: 1 if n < 2 else max(2, len(found[g])) for g, n in groups.sizes.items()}


def assign(rows: DataFrame, centers: DataFrame, grp: Sequence[str]) -> DataFrame:
    """(grp..., row_id, cluster, dist) with the nearest center of the group, ties to the smaller number."""
    index = Neighbours(centers.withColumn("center", F.col("center").cast("array<double>")), by=grp, id="cluster", vec="center")
    near = index.knn(rows, 1, skip_self=False)
    return near.select(*grp, F.col("q_id").alias("row_id"), F.col("nbr_id").alias("cluster"), "dist")


def sparsity(placed: DataFrame, grp: Sequence[str]) -> DataFrame:
    """(grp..., cluster, size, sparsity): mean distance to the center, 0 below two rows."""
    stats = placed.groupBy(*grp, "cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("dist").alias("_mean"))
    return stats.select(*grp, "cluster", "size", F.when(F.col("size") < 2, 0.0).otherwise(F.col("_mean")).alias("sparsity"))


def stable(stats: DataFrame, grp: Sequence[str], min_size: int = 3, max_ratio: float = 2.0) -> DataFrame:
    """Clusters of ``min_size`` rows whose sparsity is at most ``max_ratio`` times the median
    of those; the least sparse one if none qualifies. At most k rows per group."""
    big = stats.filter(F.col("size") >= min_size)
    whole = Window.partitionBy(*grp)
    marked = big.withColumn("_limit", F.percentile("sparsity", F.lit(0.5)).over(whole) * F.lit(max_ratio))
    marked = marked.withColumn("_in", F.col("sparsity") <= F.col("_limit"))
    marked = marked.withColumn("_any", F.max(F.col("_in").cast("int")).over(whole))
    marked = marked.withColumn("_least", F.row_number().over(Window.partitionBy(*grp).orderBy("sparsity", "cluster")))
    return marked.filter(F.col("_in") | ((F.col("_any") == 0) & (F.col("_least") == 1))).select(*stats.columns)


def allocate(weighted: DataFrame, needs: DataFrame, grp: Sequence[str]) -> DataFrame:
    """Share ``n_needed`` over the clusters of a group in proportion to ``weight``.

    In cluster order each gets the floor of its share, at least 1 while any are left;
    leftovers go one each by falling weight. Gives (grp..., cluster, n_needed, offset);
    the counts add up to n_needed exactly. Windows run over at most k rows per group.
    """
    whole = Window.partitionBy(*grp)
    line = Window.partitionBy(*grp).orderBy("cluster")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    df = weighted.transform(equi, needs.select(*grp, F.col("n_needed").alias("_n")), list(grp))
    df = df.withColumn("_share", F.col("weight") / F.sum("weight").over(whole))
    df = df.withColumn("_want", F.greatest(F.lit(1), F.floor(F.col("_share") * F.col("_n"))).cast("bigint"))
    left = F.greatest(F.lit(0).cast("bigint"), F.col("_n") - F.coalesce(F.sum("_want").over(earlier), F.lit(0)))
    df = df.withColumn("_got", F.least(F.col("_want"), left))
    df = df.withColumn("_spare", F.col("_n") - F.sum("_got").over(whole))
    heavy = Window.partitionBy(*grp).orderBy(F.col("_share").desc(), "cluster")
    df = df.withColumn("n_needed", F.col("_got") + (F.row_number().over(heavy) <= F.col("_spare")).cast("bigint"))
    df = df.withColumn("offset", F.coalesce(F.sum("n_needed").over(earlier), F.lit(0)))
    return df.select(*grp, "cluster", "n_needed", "offset")


def mean_pair_distance(rows: DataFrame, grp: Sequence[str]) -> DataFrame:
    """(grp..., n, mean_dist) over all ordered pairs of different rows of a group."""
    parts = Neighbours(rows, by=grp).meet(rows, blocks.distance_sum(), "total double")
    total = parts.groupBy(*grp).agg(F.sum("total").alias("_t"))
    sizes = rows.groupBy(*grp).agg(F.count(F.lit(1)).alias("n"))
    return sizes.transform(equi, total, list(grp)).select(
        *grp, "n", F.when(F.col("n") > 1, F.col("_t") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("mean_dist"))
