"""Clustering by scattered representatives (CURE) of all groups, in one job.

A cluster is known by up to ``reps`` of its rows, far apart from one another, moved towards its mean; the two clusters with the nearest representatives join
until one cluster per ``rows_each`` rows is left. Equal rows are one point with a weight. Groups of at most ``local_rows`` distinct rows are clustered whole in a task; larger ones
are cut at medians of their widest feature into pieces that fit, each with clusters in proportion to its rows, which do not cross the cuts (ours).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import blocks
from evenkeel.operators import kernels
from evenkeel.operators.linkage import halved
from evenkeel.operators.runtime import settle

LOCAL_ROWS = 1024  # distinct rows that a task clusters
REPS, SHRINK = 5, 0.5


def scattered(x: np.ndarray, mean: np.ndarray, reps: int) -> np.ndarray:
    """Positions of rows far apart: the one farthest from the mean, then always the one farthest from those chosen; ties go to the earlier row."""
    chosen: list[int] = []
    gap = blocks.all_distances(x, mean[None, :])[:, 0]
    for _ in range(min(reps, len(x))):
        far = int(gap.argmax())
        if chosen and gap[far] == 0:
            break
        chosen.append(far)
        own = blocks.all_distances(x, x[far][None, :])[:, 0]
        gap = own if len(chosen) == 1 else np.minimum(gap, own)
    return np.array(chosen)


def agglomerate(x: np.ndarray, weight: np.ndarray, clusters: int, reps: int = REPS, shrink: float = SHRINK) -> np.ndarray:
    """Cluster of every row, named by the position of its first row."""
    n = len(x)
    rows = [np.array([i]) for i in range(n)]
    held = np.repeat(x[:, None, :], reps, axis=1)  # a cluster with fewer representatives repeats its last
    left = np.ones(n, bool)
    d = blocks.all_distances(x, x)
    np.fill_diagonal(d, np.inf)
    near, best = d.argmin(axis=1), d.min(axis=1)
    for _ in range(n - max(1, clusters)):
        a = int(best.argmin())
        b = int(near[a])
        a, b = min(a, b), max(a, b)
        rows[a] = np.sort(np.concatenate([rows[a], rows[b]]))
        left[b] = False
        own, w = x[rows[a]], weight[rows[a]]
        mean = (own * w[:, None]).sum(axis=0) / w.sum()
        far = scattered(own, mean, reps)
        moved = own[far] + shrink * (mean - own[far])
        held[a] = moved[np.minimum(np.arange(reps), len(moved) - 1)]
        others = np.flatnonzero(left & (np.arange(n) != a))
        row = np.full(n, np.inf)
        if len(others):
            gaps = blocks.all_distances(moved, held[others].reshape(-1, x.shape[1]))
            row[others] = gaps.min(axis=0).reshape(-1, reps).min(axis=1)
        d[b], d[:, b], d[a], d[:, a] = np.inf, np.inf, row, row
        best[b] = np.inf
        for i in np.append(np.flatnonzero(left & ((near == a) | (near == b) | (row <= best))), a).tolist():
            near[i] = d[i].argmin()
            best[i] = d[i, near[i]]
    into = np.empty(n, "int64")
    for i in np.flatnonzero(left).tolist():
        into[rows[i]] = i
    return into


def cure(points: DataFrame, grp: Sequence[str], rows_each: int = 10, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(grp..., row_id, cluster): one cluster per ``rows_each`` rows, two at least in a group that is clustered whole (as far as it has two distinct rows); a cluster is named by its smallest
    row_id."""
    grp = list(grp)
    same = settle(points.groupBy(*grp, "features").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    pieces = halved(same, grp, local_rows)
    keys = [*grp, "piece"]
    schema = pieces.select(*grp, "features", F.col("rep").alias("cluster")).schema

    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")
        weight = table.column("weight").to_numpy()[order]
        least = 2 if table.column("piece")[0].as_py() == "" else 1
        into = agglomerate(blocks.matrix(table.column("features"))[order], weight, max(least, int(weight.sum()) // rows_each))
        return table.take(pa.array(order)).select([*grp, "features"]).append_column("cluster", pa.array(rep[order][into]))

    named = settle(pieces.groupBy(*keys).applyInArrow(run, schema))
    return points.select(*grp, "row_id", "features").transform(kernels.equi, named, [*grp, "features"]).select(*grp, "row_id", "cluster")
