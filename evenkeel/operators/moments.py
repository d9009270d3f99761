"""Second moments and principal axes of all groups in one job.

Tasks keep (count, mean, sum of squared differences as a d x d table) per group, merged without loss of digits where means are large against spreads (the pairwise update of Chan, Golub and
LeVeque); partial tables meet in two levels and the axes are found where they meet. What moves is one d x d table a group and task.

Defined results: one row, or equal rows, have variances of zero and the coordinate axes; a null group key is a group of its own; no rows give no groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evenkeel.functions import blocks
from evenkeel.operators.neighbours import group_rows

MEETS = 64  # partial tables of one group meet in so many places first

Moments = tuple[int, np.ndarray, np.ndarray]


def of(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    gaps = x - mean
    return len(x), mean, gaps.T @ gaps


def merged(a: Moments, b: Moments) -> Moments:
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def principal(found: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Axes as rows, widest first, each pointing to where its largest entry is positive; sample variances along them."""
    n, _, squares = found
    values, vectors = np.linalg.eigh(squares / max(1, n - 1))
    values, axes = np.maximum(values[::-1], 0.0), vectors.T[::-1].copy()
    if not values.any():
        return np.eye(len(values)), values
    top = np.abs(axes).argmax(axis=1)
    return axes * np.where(axes[np.arange(len(axes)), top] < 0, -1.0, 1.0)[:, None], values


def _fold(table: pa.Table) -> Moments:
    total = None
    for n, *packed in zip(*(table.column(c).to_pylist() for c in ("n", "mean", "squares"))):
        one = n, *unpacked(*packed)
        total = one if total is None else merged(total, one)
    return total


def unpacked(mean: bytes, squares: bytes) -> tuple[np.ndarray, np.ndarray]:
    mean = np.frombuffer(mean)
    return mean, np.frombuffer(squares).reshape(len(mean), -1)


def gather(rows: DataFrame, grp: Sequence[str], vec: str = "features") -> DataFrame:
    """(grp..., n, mean, squares) of every group, arrays as bytes (``unpacked``)."""
    grp = list(grp)
    keys = [rows.schema[c] for c in grp]
    own = rows.select(*grp, rows[vec].cast("array<double>").alias("_vec"))
    part = T.StructType([*keys, *T.StructType.fromDDL("place int, n long, mean binary, squares binary").fields])

    def packed(key: dict[str, pa.Array], place: int, found: Moments) -> dict:
        n, mean, squares = found
        return {**key, "place": pa.array([place], pa.int32()), "n": pa.array([n], pa.int64()), "mean": pa.array([mean.tobytes()], pa.binary()), "squares": pa.array([squares.tobytes()], pa.binary())}

    def first(table, row: int = 0) -> dict[str, pa.Array]:
        return {c: pa.array([table.column(c)[row].as_py()], table.schema.field(c).type) for c in grp}

    def tally(batches) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            x = blocks.matrix(batch.column("_vec"))
            for key, at in group_rows(batch, grp).items():
                if len(at):
                    found = of(x[at])
                    if key in total:
                        total[key][1] = merged(total[key][1], found)
                    else:
                        total[key] = [first(batch, int(at[0])), found]
        place = TaskContext.get().partitionId() % MEETS
        for key, found in total.values():
            cells = packed(key, place, found)
            yield pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))

    def meet(table: pa.Table) -> pa.Table:
        return pa.table(packed(first(table), table.column("place")[0].as_py(), _fold(table)))

    def all_met(table: pa.Table) -> pa.Table:
        return pa.table(packed(first(table), 0, _fold(table)))

    return own.mapInArrow(tally, part).groupBy(*grp, "place").applyInArrow(meet, part).groupBy(*grp).applyInArrow(all_met, part).drop("place")


def axes(rows: DataFrame, grp: Sequence[str], k: int | None = None, vec: str = "features") -> DataFrame:
    """(grp..., n, mean, axes, variances): the first ``k`` principal axes (all) of every group."""
    found = gather(rows, grp, vec)
    out = T.StructType([*[found.schema[c] for c in grp], *T.StructType.fromDDL("n long, mean array<double>, axes array<array<double>>, variances array<double>").fields])

    def finish(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, ways, values = [], [], []
            for n, *packed in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "squares"))):
                mean, squares = unpacked(*packed)
                way, value = principal((n, mean, squares))
                means.append(mean.tolist())
                ways.append(way[:k].tolist())
                values.append(value[:k].tolist())
            yield pa.RecordBatch.from_arrays([*map(batch.column, [*grp, "n"]), pa.array(means, pa.list_(pa.float64())), pa.array(ways, pa.list_(pa.list_(pa.float64()))), pa.array(values, pa.list_(pa.float64()))],
                                             names=[*grp, "n", "mean", "axes", "variances"])

    return found.mapInArrow(finish, out)
