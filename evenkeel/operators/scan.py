"""Ranks and running sums over whole groups, without one-task windows.

A window partitioned by class sends a class to one task. Here the order key is cut
into buckets by a monotone function of the key; bucket totals (at most ``buckets``
rows per group) give offsets, and the window runs inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.rng import uniform
from evenkeel.operators.runtime import settle, width

BUCKETS = 1 << 16  # rows of the offset table per group, at most


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """Add for each ``name: value`` in ``sums`` the inclusive running sum ``name`` and the
    group total ``name_total``. ``bucket`` must not decrease along ``order``.
    """
    by = list(by)
    tagged = df.withColumn("_bucket", bucket)
    for name, value in sums.items():
        tagged = tagged.withColumn(f"_v_{name}", value)
    totals = tagged.groupBy(*by, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in by],
        F.col("_bucket").alias("_k_bucket"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    match = F.col("_bucket").eqNullSafe(F.col("_k_bucket"))
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = tagged.join(offsets, match)
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for n in sums:
        joined = joined.withColumn(n, F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(inside))
    keep = [c for c in df.columns if c not in sums]
    return joined.select(*keep, *sums, *[f"{n}_total" for n in sums])


def range_buckets(df: DataFrame, order: Sequence[str], name: str = "_range") -> DataFrame:
    """A written copy of ``df`` with ``name``, which never falls along ``order``: bounds are sampled from the
    keys themselves, so buckets hold like numbers of rows wherever the keys crowd."""
    return settle(df.repartitionByRange(width(df.sparkSession), *order).withColumn(name, F.spark_partition_id()))


def shuffled_index(
    df: DataFrame, by: Sequence[str], id: str, seed: int, stream: str, name: str = "idx", count: str = "n"
) -> DataFrame:
    """Dense 1-based position of every row in a seeded random order of its group, and the group size."""
    by = list(by)
    keyed = df.withColumn("_u", uniform(seed, stream, id))
    bucket = F.floor(F.col("_u") * BUCKETS).cast("int")
    ranked = running_sums(keyed, by, ["_u", id], bucket, {name: F.lit(1).cast("bigint")})
    return ranked.withColumnRenamed(f"{name}_total", count).drop("_u")


def expand(df: DataFrame, count: str, name: str, parts: int, chunk: int = 8192) -> DataFrame:
    """Repeat each row ``count`` times, numbered ``name`` = 1..count.

    Two steps, so that one row asked to make a billion copies is spread over tasks
    and never becomes one long array.
    """
    blocks = F.ceil(F.col(count) / F.lit(chunk)).cast("bigint")
    cut = df.filter(F.col(count) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    spread = cut.repartition(parts, F.xxhash64(*cut.columns))
    last = F.least(F.col(count).cast("bigint"), (F.col("_chunk") + 1) * chunk)
    return spread.withColumn(name, F.explode(F.sequence(F.col("_chunk") * chunk + 1, last))).drop("_chunk")
