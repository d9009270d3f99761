"""Nearest donors of rows with missing values.

A distance over the features that two rows share is no metric over all rows, but it is one between the rows of one
pattern of present features and the donors of another: there the shared features are the same for every pair. Rows are
therefore split by pattern, and each pair of common patterns is a group of an ordinary pruned nearest-neighbour join on
its shared features. Rows of rare patterns, and rows whose values are too large to be squared, meet the donors in
blocks instead, so that the result is exact whatever the patterns are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions import blocks
from evenkeel.operators.neighbours import Neighbours
from evenkeel.operators.runtime import settle

COMMON = 32  # patterns of either side, those with the most rows, that have groups of their own
RARE_ROWS = 256  # patterns up to here are not worth groups of their own
DIRECT_CELLS = 1 << 28  # distances that are taken without looking at patterns
LARGE = 1e150  # absolute values from here on overflow when squared


def _patterned(rows: DataFrame) -> DataFrame:
    """Rows (row_id, features) with their pattern: 1 for a present feature, 0 for a missing one (NaN); null with a value that is too large."""
    large = F.exists("features", lambda x: ~F.isnan(x) & (F.abs(x) >= LARGE))
    marks = F.concat_ws("", F.transform("features", lambda x: F.when(F.isnan(x), F.lit("0")).otherwise(F.lit("1"))))
    return rows.withColumn("pattern", F.when(~large, marks))


def _common(rows: DataFrame, most: int, rare: int) -> list[str]:
    sizes = rows.where("pattern IS NOT NULL").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rare)
    return [r["pattern"] for r in sizes.orderBy(F.desc("n"), "pattern").limit(most).collect()]


def _meet(pool: DataFrame, lacking: DataFrame, k: int) -> DataFrame:
    """Every row of ``lacking`` with every donor, in blocks."""
    parts = Neighbours(pool.select("row_id", "features"), metric=False).meet(
        lacking.select("row_id", "features"), blocks.donors(k), "pos int, nbr_id bigint, dist double, value double")
    return parts.select("q_id", "pos", "nbr_id", "dist", "value")


def _grouped(pool: DataFrame, lacking: DataFrame, pairs: list[tuple], dim: int, k: int, local_bytes: int | None) -> DataFrame:
    """The pruned join of all pairs of common patterns: (meeting, pattern of the row, pattern of the donor, shared features, features to fill)."""
    spark = pool.sparkSession
    meetings = F.broadcast(spark.createDataFrame(pairs, "meeting int, asks string, gives string, shared array<boolean>, fills array<int>"))  # COMMON squared rows at most
    masked = F.zip_with("features", "shared", lambda x, s: F.when(s, x).otherwise(F.lit(0.0))).alias("features")
    values = [F.get("features", F.lit(i)).alias(f"v{i}") for i in range(dim)]
    refs = settle(pool.join(meetings, pool["pattern"] == F.col("gives")).select("meeting", "row_id", masked, *values))
    asking = settle(lacking.join(meetings, lacking["pattern"] == F.col("asks")).select("meeting", "row_id", masked))
    limit = {} if local_bytes is None else {"local_bytes": local_bytes}
    index = Neighbours(refs, by=["meeting"], carry=[f"v{i}" for i in range(dim)], copies=k + 1, **limit)
    near = index.knn(asking, k).select("meeting", "q_id", "nbr_id", F.array(*[f"v{i}" for i in range(dim)]).alias("v"))
    near = near.join(meetings.select("meeting", "shared", "fills"), "meeting").join(lacking.select(F.col("row_id").alias("q_id"), "features"), "q_id")
    # measured again from the values: a rounded distance cannot be scaled without losing ties between patterns
    gaps = F.zip_with(F.zip_with("features", "v", lambda x, y: (x - y) * (x - y)), "shared", lambda d, s: F.when(s, d).otherwise(F.lit(0.0)))
    total = F.aggregate(gaps, F.lit(0.0), lambda acc, d: acc + d)
    dist = F.round(F.sqrt(F.lit(float(dim)) / F.size(F.filter("shared", lambda s: s)) * total), blocks.DIGITS)
    return near.select("q_id", F.explode("fills").alias("pos"), "nbr_id", dist.alias("dist"), "v").select(
        "q_id", "pos", "nbr_id", "dist", F.get("v", F.col("pos")).alias("value"))


def nearest_donors(pool: DataFrame, lacking: DataFrame, dim: int, k: int, direct_cells: int = DIRECT_CELLS, common: int = COMMON,
                   rare: int = RARE_ROWS, local_bytes: int | None = None) -> DataFrame:
    """(q_id, pos, nbr_id, dist, value): for every missing feature (NaN, at ``pos``) of the rows of ``lacking`` the k nearest rows of ``pool`` that have it.

    Both hold (row_id, features) with ``dim`` features. A row is no donor for its own id; ties go to the smaller id. The limits choose between ways
    to the same result.
    """
    pool, lacking = settle(_patterned(pool)), settle(_patterned(lacking))
    if pool.count() * lacking.count() <= direct_cells:
        found = _meet(pool, lacking, k)
    else:
        asks, gives = _common(lacking, common, rare), _common(pool, common, rare)
        pairs = []
        for a in asks:
            for g in gives:
                shared = [x == y == "1" for x, y in zip(a, g)]
                fills = [i for i, (x, y) in enumerate(zip(a, g)) if x == "0" and y == "1"]
                if any(shared) and fills:
                    pairs.append((len(pairs), a, g, shared, fills))
        asked = F.coalesce(F.col("pattern").isin(asks), F.lit(False))
        given = F.coalesce(F.col("pattern").isin(gives), F.lit(False))
        ways = [(pool, lacking.where(~asked)), (pool.where(~given), lacking.where(asked))]
        parts = [_meet(p, q, k) for p, q in ways if not (p.isEmpty() or q.isEmpty())]
        if pairs:
            parts.append(_grouped(pool, lacking, pairs, dim, k, local_bytes))
        found = reduce(DataFrame.unionByName, parts) if parts else _meet(pool, lacking.limit(0), k)
    order = Window.partitionBy("q_id", "pos").orderBy("dist", "nbr_id")
    return found.withColumn("_rk", F.row_number().over(order)).filter(F.col("_rk") <= k).drop("_rk")
