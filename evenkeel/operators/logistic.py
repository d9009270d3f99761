"""Logistic regression on two classes with a ridge penalty, for all groups of a frame together.

The sum of log losses plus half the squared weights (the offset has no ridge) is strictly convex in the weights; Newton steps, halved while the objective does not fall, end where the next
step would lower it by less than TOL of itself. Groups of at most LOCAL_ROWS rows and LOCAL_BYTES of features are fitted whole in a task, all in one job; larger ones take a step in the same job, tasks sending loss,
gradient and curvature, one small table a group.

Defined results: a group without rows for training predicts nothing; a group of one class gives that class for sure; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import blocks
from evenkeel.functions.vectors import sum_vector
from evenkeel.operators.kernels import equi

LOCAL_ROWS = 1 << 15
LOCAL_BYTES = 16 << 20
WIDEST = 1 << 10  # features whose curvature a task may hold
TOL = 1e-12
PASSES = 200
STEP_ROWS = 1 << 12  # rows that a task measures at a time


def sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature at ``beta`` (offset last) in one row."""
    many = len(beta)
    loss, slope, bend = 0.0, np.zeros(many), np.zeros((many, many))
    for low in range(0, len(x), STEP_ROWS):
        own = np.column_stack([x[low:low + STEP_ROWS], np.ones(len(x[low:low + STEP_ROWS]))])
        z, t = own @ beta, y[low:low + STEP_ROWS]
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
        loss += (np.logaddexp(0.0, z) - t * z).sum()
        slope += own.T @ (p - t)
        bend += own.T @ (own * (p * (1 - p))[:, None])
    return np.concatenate([[loss], slope, bend.ravel()])


class Newton:
    """The state of one fit: ``at`` is where to measure next."""

    def __init__(self, many: int, share: float):
        self.at = np.zeros(many)
        self.at[-1] = np.log(share / (1 - share))
        self.best, self.found, self.step, self.passes = np.inf, self.at, None, 0

    def take(self, stats: np.ndarray) -> bool:
        """Whether the measured place ends the fit; otherwise moves on."""
        many = len(self.at)
        ridge = np.append(np.ones(many - 1), 0.0)
        value = stats[0] + 0.5 * (ridge * self.at**2).sum()
        self.passes += 1
        if self.step is not None and not value <= self.best + 1e-13 * abs(self.best):
            self.step = self.step / 2
            if self.passes >= PASSES or np.abs(self.step).max() <= 1e-14 * max(1.0, np.abs(self.found).max()):
                return True
            self.at = self.found + self.step
            return False
        self.best, self.found = value, self.at
        slope = stats[1:many + 1] + ridge * self.at
        bend = stats[many + 1:].reshape(many, many) + np.diag(ridge)
        self.step = -np.linalg.lstsq(bend, slope, rcond=None)[0]
        if self.passes >= PASSES or -(slope @ self.step) <= TOL * max(1.0, abs(value)):
            self.found = self.at + self.step  # far nearer still, so close to the end
            return True
        self.at = self.found + self.step
        return False


class Logistic:
    """Weights of every group: ``predict`` gives the share of class 1."""

    def __init__(self, train: DataFrame, by: Sequence[str], counts: Sequence, dim: int):
        """``train`` has by..., label (0 or 1), features; ``counts`` are rows of by..., n, ones."""
        self.by, self.spark, self.dim = list(by), train.sparkSession, dim
        keys = {tuple(r[c] for c in self.by): g for g, r in enumerate(counts)}
        self.names = self.spark.createDataFrame([(*k, g) for k, g in keys.items()], T.StructType([*[train.schema[c] for c in self.by], T.StructField("gid", T.IntegerType())])) if keys else None
        self.beta: dict[int, np.ndarray] = {}
        fits, large, rows_of = {}, [], {}
        for g, r in enumerate(counts):
            rows_of[g] = r["n"]
            if 0 < r["ones"] < r["n"]:
                fits[g] = Newton(dim + 1, r["ones"] / r["n"])
                if r["n"] > min(LOCAL_ROWS, LOCAL_BYTES // (8 * dim)):
                    large.append(g)
            else:
                self.beta[g] = np.append(np.zeros(dim), np.inf if r["ones"] else -np.inf)
        if not fits:
            return
        rows = self._numbered(train).select("gid", "label", F.col("features").cast("array<double>").alias("features"))
        small = [g for g in fits if g not in large]
        if small:
            held = {g: fits[g].at[-1] for g in small}

            def whole(table: pa.Table) -> pa.Table:
                gid = table.column("gid")[0].as_py()
                x, y = blocks.matrix(table.column("features")), table.column("label").to_numpy().astype(float)
                fit = Newton(x.shape[1] + 1, 0.5)
                fit.at[-1] = held[gid]
                while not fit.take(sums(x, y, fit.at)):
                    pass
                return pa.table({"gid": pa.array([gid], pa.int32()), "beta": pa.array([fit.found], pa.list_(pa.float64()))})

            own = rows.where(F.col("gid").isin(small))
            self.beta |= {r["gid"]: np.array(r["beta"]) for r in own.groupBy("gid").applyInArrow(whole, "gid int, beta array<double>").collect()}  # a row a group
        going = {g: fits[g] for g in large}
        while going:
            places = self.spark.sparkContext.broadcast({g: fit.at for g, fit in going.items()})

            def task(batches, places=places):
                total: dict[int, np.ndarray] = {}
                for batch in batches:
                    gids, x, y = batch.column("gid").to_numpy(), blocks.matrix(batch.column("features")), batch.column("label").to_numpy().astype(float)
                    for gid in np.unique(gids).tolist():
                        at = np.flatnonzero(gids == gid)
                        total[gid] = total.get(gid, 0) + sums(x[at], y[at], places.value[gid])
                for gid, stats in total.items():
                    yield pa.RecordBatch.from_arrays([pa.array([gid], pa.int32()), pa.array([stats], pa.list_(pa.float64()))], names=["gid", "stats"])

            parts = rows.where(F.col("gid").isin(list(going))).mapInArrow(task, "gid int, stats array<double>")
            for r in parts.groupBy("gid").agg(sum_vector("stats").alias("stats")).collect():  # a row a group
                if going[r["gid"]].take(np.array(r["stats"])):
                    self.beta[r["gid"]] = going.pop(r["gid"]).found
            places.destroy()

    def _numbered(self, rows: DataFrame) -> DataFrame:
        if not self.by:
            return rows.withColumn("gid", F.lit(0))
        return equi(rows, F.broadcast(self.names), self.by)

    def predict(self, rows: DataFrame) -> DataFrame:
        """(by..., row_id, label, share) for the rows of trained groups."""
        cols = [*self.by, "row_id", "label"]
        if not self.beta:
            return rows.where(F.lit(False)).select(*cols, F.lit(0.0).alias("share"))
        own = self._numbered(rows).select(*cols, "gid", F.col("features").cast("array<double>").alias("features"))
        held = self.spark.sparkContext.broadcast(self.beta)
        schema = T.StructType([*[own.schema[c] for c in cols], T.StructField("share", T.DoubleType())])

        def score(batches):
            for batch in batches:
                gids, x = batch.column("gid").to_numpy(), blocks.matrix(batch.column("features"))
                z = np.zeros(len(gids))
                for gid in np.unique(gids).tolist():
                    at, beta = gids == gid, held.value[gid]
                    z[at] = beta[-1] if np.isinf(beta[-1]) else x[at] @ beta[:-1] + beta[-1]
                share = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                share[np.isinf(z)] = z[np.isinf(z)] > 0
                yield pa.RecordBatch.from_arrays([*map(batch.column, cols), pa.array(share)], names=schema.names)

        return own.mapInArrow(score, schema)
