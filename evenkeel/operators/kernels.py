"""Oversampling kernels: counts, targets, base draws, neighbour draws, union.

A *points* frame has ``by..., row_id, label, features``. ``grp`` is the list of
columns rows are drawn within, normally ``by + [label]``, or with a cluster added.
A *slots* frame has one row per synthetic row to make: ``grp..., rep``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.rng import pick, uniform
from evenkeel.operators.neighbours import Neighbours
from evenkeel.operators.runtime import SMALL_ROWS, small_table, width
from evenkeel.operators.scan import BUCKETS, expand, running_sums, shuffled_index

HELD_BYTES = 8 << 20  # of bases that Spark may gather on the driver to send them to all tasks; its own limit counts compressed bytes
LABEL_SPAN = 1000  # synthetic ids are -(rep * LABEL_SPAN + label) for labels 0..999; other labels get a wider span


def class_counts(points: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, n)."""
    return points.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def targets(points: DataFrame, label: str = "label", strategy="auto", by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, n, n_needed).

    ``auto`` fills every class up to the largest; a float fills up to that share of the
    largest; a dict gives the wanted size per label. Anything else is an error.
    """
    counts = class_counts(points, label, by)
    # the window sees one row per class of a group
    both = counts.withColumn("_top", F.max("n").over(Window.partitionBy(*by)))
    if isinstance(strategy, dict):
        if not strategy:
            raise ValueError("empty sampling strategy")
        wanted = F.create_map(*[F.lit(v) for pair in strategy.items() for v in pair])
        goal = F.coalesce(wanted[F.col(label)], F.col("n"))
    elif isinstance(strategy, float):
        goal = F.floor(F.col("_top") * F.lit(strategy))
    elif strategy == "auto":
        goal = F.col("_top")
    else:
        raise ValueError(f"unknown sampling strategy {strategy!r}")
    need = F.greatest(F.lit(0), goal - F.col("n")).cast("bigint")
    return both.withColumn("n_needed", need).drop("_top")


def equi(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal names, nulls being equal too; without any, ``right`` must be a single row (an overall total)."""
    if not on:
        left, right, on = left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1)), ["_one"]
    renamed = right.withColumnsRenamed({c: f"_k_{c}" for c in on})
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on])
    return left.join(renamed, match, how).drop("_one", *[f"_k_{c}" for c in on])


def apart(side: DataFrame, large: bool | None) -> DataFrame:
    """The right ``side`` of a join by unique ids: shuffled if it is large, sent to all tasks if not, left to Spark if unknown. Without a hint Spark may
    send the left side through the driver: slots are few chunks when it measures them, and many rows when it builds them."""
    return side if large is None else side.hint("shuffle_hash" if large else "broadcast")


def attach(df: DataFrame, points: DataFrame, by: Sequence[str], key: str, how: str = "inner", large: bool | None = None, **columns: str) -> DataFrame:
    """Look up ``columns`` (new name = source column) of the row whose id is ``df[key]``."""
    side = points.select(*by, F.col("row_id").alias(key), *[F.col(src).alias(new) for new, src in columns.items()])
    return equi(df, apart(side, large), [*by, key], how)


def slots(needs: DataFrame, grp: Sequence[str]) -> DataFrame:
    """One row per synthetic row. ``offset`` (optional) shifts the numbering of a group."""
    parts = width(needs.sparkSession)
    cols = [*grp, "n_needed"] + (["offset"] if "offset" in needs.columns else [])
    made = expand(needs.select(*cols), "n_needed", "rep", parts)
    if "offset" in needs.columns:
        made = made.withColumn("rep", F.col("rep") + F.col("offset"))
    return made.select(*grp, "rep")


def draw_uniform(made: DataFrame, bases: DataFrame, grp: Sequence[str], keys: Sequence, seed: int,
                 stream: str = "base", name: str = "base_id") -> DataFrame:
    """Give each slot a row of its group, uniformly with replacement."""
    ids = bases.select(*grp, "row_id")
    placed = shuffled_index(ids, grp, "row_id", seed, "idx").drop("n").withColumnRenamed("row_id", name)
    sizes = small_table(ids.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n")))
    groups, rows = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if rows <= SMALL_ROWS:
        placed = small_table(placed)  # few bases for many slots would be few, hot join keys
    aimed = equi(made, apart(sizes, groups > SMALL_ROWS), grp).withColumn("idx", pick(seed, stream, "_n", *keys) + 1).drop("_n")
    return equi(aimed, apart(placed, rows * 64 > HELD_BYTES), [*grp, "idx"]).drop("idx")


def draw_weighted(weights: DataFrame, needs: DataFrame, grp: Sequence[str], seed: int) -> DataFrame:
    """Bases in proportion to ``weight``: systematic sampling, exactly ``n_needed`` per group.

    Rows stand on a line in seeded random order, each as long as its share of the
    total; one slot per unit, from a seeded start. Gives (grp..., rep, base_id).
    """
    sized = equi(weights.filter(F.col("weight") > 0), needs.select(*grp, "n_needed"), grp)
    keyed = sized.withColumn("_u", uniform(seed, "order", "row_id"))
    run = running_sums(keyed, grp, ["_u", "row_id"], F.floor(F.col("_u") * BUCKETS).cast("int"), {"cum": F.col("weight")})
    start = uniform(seed, "start", *grp)
    scale = F.col("n_needed") / F.col("cum_total")
    upto = F.floor(F.col("cum") * scale + start)
    before = F.floor((F.col("cum") - F.col("weight")) * scale + start)
    counted = run.select(*grp, "row_id", before.cast("bigint").alias("_from"), (upto - before).cast("bigint").alias("_g"))
    rows = expand(counted, "_g", "_j", width(weights.sparkSession))
    return rows.select(*grp, (F.col("_from") + F.col("_j")).alias("rep"), F.col("row_id").alias("base_id"))


def draw_counted(counted: DataFrame, grp: Sequence[str], order: Sequence[str], seed: int) -> DataFrame:
    """Repeat each row ``g`` times, numbering all copies of a group by a dense ``rep``; ``j`` = 1..g."""
    keyed = counted.filter(F.col("g") > 0).withColumn("_u", uniform(seed, "order", order[0]))
    run = running_sums(keyed, grp, ["_u", *order], F.floor(F.col("_u") * BUCKETS).cast("int"), {"_cum": F.col("g").cast("bigint")})
    rows = expand(run.drop("_u", "_cum_total"), "g", "j", width(counted.sparkSession))
    return rows.withColumn("rep", F.col("_cum") - F.col("g") + F.col("j")).drop("_cum")


def neighbour_lists(bases: DataFrame, k: int, grp: Sequence[str], refs: DataFrame | None = None) -> DataFrame:
    """(grp..., row_id, nbrs array<struct<rank, nbr_id, dist>>) within the group; at most k per row."""
    return pack_lists(Neighbours(bases if refs is None else refs, by=grp, copies=k + 1).knn(bases, k), grp)


def pack_lists(long: DataFrame, grp: Sequence[str]) -> DataFrame:
    """One row per query with its neighbours in order; at most k entries each."""
    packed = long.groupBy(*grp, "q_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "nbr_id", "dist"))).alias("nbrs"))
    return packed.withColumnRenamed("q_id", "row_id")


def draw_neighbour(made: DataFrame, lists: DataFrame, by: Sequence[str], keys: Sequence, seed: int, stream: str = "nbr",
                   large: bool | None = None) -> DataFrame:
    """Give each slot one of its base's neighbours, uniformly; null when it has none."""
    side = lists.select(*by, F.col("row_id").alias("base_id"), F.transform("nbrs", lambda s: s["nbr_id"]).alias("_ids"))
    joined = equi(made, apart(side, large), [*by, "base_id"], "left")
    place = (pick(seed, stream, F.size("_ids"), *keys) + 1).cast("int")
    # get() is 0-based and null-safe where the list is missing
    return joined.withColumn("nbr_id", F.get("_ids", place - 1)).drop("_ids")


def as_synthetic(made: DataFrame, by: Sequence[str], features: Column) -> DataFrame:
    """(by..., label, rep, base_id, nbr_id, features)."""
    nbr = F.col("nbr_id") if "nbr_id" in made.columns else F.lit(None).cast("bigint")
    return made.select(*by, "label", "rep", F.col("base_id"), nbr.cast("bigint").alias("nbr_id"), features.alias("features"))


def label_codes(needs: DataFrame) -> tuple[int, int]:
    """The lowest label and the number of codes, so that ids of synthetic rows differ between all labels."""
    low, high = needs.agg(F.min("label"), F.max("label")).first()
    low = min(0, low or 0)
    return low, max(LABEL_SPAN, (high or 0) - low + 1)


def union_result(points: DataFrame, synthetic: DataFrame | None, by: Sequence[str], codes: tuple[int, int] = (0, LABEL_SPAN)) -> DataFrame:
    """Originals and synthetic rows in one frame with provenance; ``codes`` as ``label_codes`` gives them."""
    null = F.lit(None).cast("bigint")
    kept = points.select(
        *by, "row_id", F.col("label").cast("int").alias("label"), "features", F.lit(False).alias("is_synthetic"),
        null.alias("base_id"), null.alias("nbr_id"), null.alias("rep"))
    if synthetic is None:
        return kept
    low, span = codes
    new_id = -(F.col("rep") * F.lit(span).cast("bigint") + F.col("label").cast("bigint") - low)
    made = synthetic.select(
        *by, new_id.cast("bigint").alias("row_id"), F.col("label").cast("int").alias("label"), "features",
        F.lit(True).alias("is_synthetic"), "base_id", "nbr_id", F.col("rep").cast("bigint").alias("rep"))
    return kept.unionByName(made)
