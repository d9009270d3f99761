"""Average-linkage clustering of all groups, cut at a distance.

Clusters join while the mean distance of their rows is at most the cut. A mean within the cut needs a pair within the
cut, so clusters never leave a connected part of the graph that links rows up to the cut: large groups fall into such parts by
one pruned ball join, of which tasks hand on spanning forests (rows with one feature by their gaps in order instead), and every part is agglomerated on its own, exactly and however large it is,
in one task. Equal rows are one point with a weight, and means are compared at ``blocks.DIGITS`` decimals.

Rows of one feature join in order: clusters are then runs of rows, the mean distance of two is that of their means, and no pairs are held. Rows of several features join by
nearest-neighbour chains over sums of distances; above ``local_rows`` distinct rows these lie in a file of the task (8 bytes a pair), of which a step reads or writes one row.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions import blocks
from evenkeel.operators import kernels, scan
from evenkeel.operators.neighbours import Neighbours
from evenkeel.operators.runtime import settle

LOCAL_ROWS = 4096  # distinct rows whose distances one task holds, 128 MiB


def in_order(x: np.ndarray, weight: np.ndarray, cut: float) -> np.ndarray:
    """``chains`` for one feature: neighbours in order join by the smallest distance of their means, ties by the clusters' first rows. Rows without a value stay alone."""
    order = np.argsort(x, kind="stable")
    mean, size, name, start = x[order].astype(float), weight[order].astype(float), order.copy(), np.arange(len(x))

    def gaps() -> np.ndarray:
        with np.errstate(invalid="ignore"):
            gap = np.round(np.diff(mean), blocks.DIGITS)
        return np.where(gap <= cut, gap, np.inf)

    while len(mean) > 1:  # pairs nearer to each other than to any other join whatever the order, all at a time
        gap = gaps()
        go = (gap < np.append(np.inf, gap[:-1])) & (gap < np.append(gap[1:], np.inf))
        if go.sum() * 16 < len(gap):
            break
        first = np.flatnonzero(~np.append(False, go))
        total = np.add.reduceat(size, first)
        mean = np.where(np.append(go, False)[first], np.add.reduceat(mean * size, first) / total, mean[first])
        size, name, start = total, np.minimum.reduceat(name, first), start[first]
    gap, many = gaps().tolist(), len(mean)
    mean, size, name = mean.tolist(), size.tolist(), name.tolist()
    left, right, turn = list(range(-1, many - 1)), list(range(1, many + 1)), [0] * many
    into = list(range(many))

    def pair(i: int, j: int, gap: float) -> tuple:
        return gap, min(name[i], name[j]), max(name[i], name[j]), i, turn[i], j, turn[j]

    heap = [pair(i, i + 1, g) for i, g in enumerate(gap) if g <= cut]
    heapq.heapify(heap)
    while heap:
        _, _, _, i, own, j, other = heapq.heappop(heap)
        if turn[i] != own or turn[j] != other:
            continue
        mean[i] = (mean[i] * size[i] + mean[j] * size[j]) / (size[i] + size[j])
        size[i], name[i], right[i], into[j] = size[i] + size[j], min(name[i], name[j]), right[j], i
        turn[i], turn[j] = turn[i] + 1, -1
        if right[i] < many:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < many and (g := round(mean[b] - mean[a], blocks.DIGITS)) <= cut:
                heapq.heappush(heap, pair(a, b, g))
    for i in range(many):  # a cluster joins an earlier one
        into[i] = into[into[i]]
    out = np.empty(len(x), np.int64)
    out[order] = np.repeat(np.array(name, np.int64)[into], np.diff(np.append(start, len(x)))) if len(x) else 0
    return out


def _pair_sums(x: np.ndarray, weight: np.ndarray, local_rows: int) -> np.ndarray:
    """Weighted distances of all rows, in a file that goes with the array if there are more than ``local_rows``."""
    n = len(x)
    if n <= local_rows:
        sums = np.empty((n, n))
    else:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        with tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) as file:
            sums = np.memmap(file, np.float64, "w+", shape=(n, n))
    for part in blocks.steps(n, n):
        sums[part] = blocks.all_distances(x[part], x) * weight[part, None] * weight
    return sums


def chains(x: np.ndarray, weight: np.ndarray, cut: float, local_rows: int = LOCAL_ROWS) -> np.ndarray:
    """Cluster of every row, named by the position of its first row."""
    if x.shape[1] == 1:
        return in_order(x[:, 0], weight, cut)
    n, weight = len(x), weight.astype(float)
    sums = _pair_sums(x, weight, local_rows)  # of a cluster, in the row of its first row, to every row
    size, into, left = weight.copy(), np.arange(n), np.ones(n, bool)
    stack: list[int] = []
    links: list[float] = []  # from each cluster of the stack to the next; they fall, so chains end
    first = 0
    while True:
        if not stack:
            while first < n and not left[first]:
                first += 1
            if first == n:
                return into
            stack.append(first)
        top = stack[-1]
        mean = np.round(np.bincount(into, weights=sums[top], minlength=n) / (size[top] * size), blocks.DIGITS)
        mean[~left | np.isnan(mean)] = np.inf
        mean[top] = np.inf
        near = int(mean.argmin())
        if links and not mean[near] < links[-1]:
            a, b = sorted(stack[-2:])
            del stack[-2:], links[-2:]
            sums[a] += sums[b]
            size[a] += size[b]
            into[into == b], left[b] = a, False
        elif not mean[near] <= cut:  # and no later merge brings anything closer: this cluster is done
            stack.pop()
            left[top] = False
        else:
            stack.append(near)
            links.append(float(mean[near]))


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a spanning forest of the links between rows and columns."""
    rows, cols = [], []
    new_row, new_col = near.any(axis=1), near.any(axis=0)
    while new_row.any():
        edge = np.array([int(new_row.argmax())])
        new_row[edge] = False
        while len(edge):
            part = near[edge]
            found = np.flatnonzero(part.any(axis=0) & new_col)
            new_col[found] = False
            rows.append(edge[part[:, found].argmax(axis=0)])
            cols.append(found)
            part = near[:, found]
            edge = np.flatnonzero(part.any(axis=1) & new_row)
            new_row[edge] = False
            rows.append(edge)
            cols.append(found[part[edge].argmax(axis=1)] if len(edge) else edge)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, "int64"), np.zeros(0, "int64"))


def links(reach: str):
    """Kernel: (query, reference) links that connect what is within the query's ``reach``, never all pairs."""

    def kernel(qid, q, extra, rid, r, carry):
        who, other = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        for part in blocks.steps(len(q), len(r)):
            i, j = _forest(blocks.all_distances(q[part], r) <= extra[reach][part, None])
            who.append(i + part.start)
            other.append(j)
        i, j = np.concatenate(who), np.concatenate(other)
        return i, {"nbr_id": rid[j]}

    return kernel


def connected(pairs: DataFrame) -> DataFrame:
    """(node, part) of every node in the links (a, b): the smallest node it is connected with. Links shrink as nodes are replaced by their smallest neighbours."""
    edges = settle(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    named = None
    while not edges.isEmpty():
        ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = settle(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")))
        if named is None:
            named = to.withColumnRenamed("to", "part")
        else:
            step = to.select(F.col("node").alias("part"), "to")
            named = settle(named.join(step, "part", "left").select("node", F.coalesce("to", "part").alias("part")))
        moved = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("_a")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b")
        edges = settle(moved.where("_a <> _b").select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("part")) if named is None else named


def runs(points: DataFrame, grp: Sequence[str]) -> DataFrame:
    """Distinct points of one feature (grp..., node, features, cut) with ``part``: in order, a gap above the cut begins a new one. A gap that rounding of distances may
    bring down to the cut begins none."""
    ranged = scan.range_buckets(points.withColumn("_x", F.get("features", F.lit(0))), ["_x"])
    ends = ranged.groupBy(*grp, "_range").agg(F.max("_x").alias("_top"))  # a row a range
    below = ends.withColumn("_below", F.lag("_top").over(Window.partitionBy(*grp).orderBy("_range"))).drop("_top")
    line = Window.partitionBy(*grp, "_range").orderBy("_x")
    gap = F.col("_x") - F.coalesce(F.lag("_x").over(line), "_below")
    near = F.coalesce(gap <= F.col("cut") * (1 + 1e-12) + 10.0 * 10.0**-blocks.DIGITS, F.lit(False))
    marked = ranged.transform(kernels.equi, below, [*grp, "_range"]).withColumn("_new", F.when(near, 0).otherwise(1).cast("bigint"))
    return scan.running_sums(marked, grp, ["_x"], F.col("_range"), {"part": F.col("_new")}).select(*points.columns, "part")


def halved(points: DataFrame, at: Sequence[str], local_rows: int) -> DataFrame:
    """Points (at..., features) with ``piece``: parts above ``local_rows`` are halved until none is. Distinct points always part on their widest feature."""
    dim = int(points.agg(F.max(F.size("features"))).first()[0] or 0)
    points, keys = points.withColumn("piece", F.lit("")), [*at, "piece"]
    while dim:
        ends = [f(F.get("features", F.lit(i))).alias(f"{n}{i}") for i in range(dim) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        large = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ends).where(F.col("n") > local_rows)
        spans = F.array(*[F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(dim)])
        large = settle(large.select(*keys, (F.array_position(spans, F.array_max(spans)) - 1).cast("int").alias("axis"), F.array(*[f"hi{i}" for i in range(dim)]).alias("tops")))
        if large.isEmpty():
            return points
        value = F.get("features", F.col("axis"))
        held = points.transform(kernels.equi, large, keys)
        middle = settle(held.groupBy(*keys).agg(F.percentile_approx(value, 0.5, 1000).alias("middle"), F.first("axis").alias("axis"), F.first("tops").alias("tops")))
        below = F.when(F.col("middle") < F.get("tops", F.col("axis")), value <= F.col("middle")).otherwise(value < F.col("middle"))
        joined = points.transform(kernels.equi, middle, keys, "left")
        points = settle(joined.withColumn("piece", F.when(F.col("axis").isNull(), F.col("piece")).otherwise(
            F.concat("piece", F.when(below, F.lit("0")).otherwise(F.lit("1"))))).drop("middle", "axis", "tops"))
    return points


def average_linkage(points: DataFrame, grp: Sequence[str], cuts: DataFrame, local_rows: int = LOCAL_ROWS, **limits) -> DataFrame:
    """(grp..., row_id, cluster): the cluster of every row, named by its smallest row_id. ``cuts`` holds (grp..., cut); in groups without a cut, or
    with a null one, only equal rows share a cluster. Ties between distances go to rows with smaller ids, but with several features mutual nearest ones join first.
    ``local_rows`` steers cost only."""
    grp = list(grp)
    same = points.groupBy(*grp, "features").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    same = same.transform(kernels.equi, cuts.select(*grp, F.col("cut").cast("double").alias("cut")), grp, "left")
    same = settle(same.withColumns({"cut": F.coalesce("cut", F.lit(0.0)), "node": F.monotonically_increasing_id()}))
    sizes = same.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n"))
    large = settle(same.transform(kernels.equi, sizes.where(F.col("_n") > local_rows).select(*grp), grp, "left_semi"))
    whole = same.transform(kernels.equi, sizes.where(F.col("_n") <= local_rows).select(*grp), grp, "left_semi").withColumn("part", F.lit(-1).cast("bigint"))
    if not large.isEmpty():
        if large.where(~F.size("features").eqNullSafe(1)).isEmpty():
            placed = settle(runs(large, grp))
        else:
            index = Neighbours(large, by=grp, id="node", **limits)
            pairs = index.meet(large, links("cut"), "nbr_id bigint", id="node", extra=["cut"], reach="cut")
            parts = connected(pairs.select(F.col("q_id").alias("a"), F.col("nbr_id").alias("b")))
            placed = settle(large.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")))
        whole = whole.unionByName(placed.select(whole.columns))
    schema = whole.select("node", F.col("rep").alias("cluster")).schema

    def agglomerate(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        rep = table.column("rep").to_numpy()[order]
        x = blocks.matrix(table.column("features"))[order]
        into = chains(x, table.column("weight").to_numpy()[order], float(table.column("cut")[0].as_py()), local_rows)
        return pa.table({"node": table.column("node").take(pa.array(order)), "cluster": pa.array(rep[into])})

    found = whole.groupBy(*grp, "part").applyInArrow(agglomerate, schema)
    named = settle(same.select(*grp, "features", "node").join(found, "node").drop("node"))
    return points.select(*grp, "row_id", "features").transform(kernels.equi, named, [*grp, "features"]).select(*grp, "row_id", "cluster")
