"""Learning vector quantisation of labelled rows, for all groups of a frame together.

A group's codebook has vectors of every class. A row's error is (p - m) / (p + m), with p and m its squared distances to the nearest vector of its own class and of any other (Sato and Yamada's
generalised rule): below zero where the nearest vector has the row's class. A round moves every vector along the weighted mean of its gaps to the rows that it is nearest to: own rows attract with
weight m / (p + m)^2, others repel with p / (p + m)^2, times ``rate``. This goes down the slope of the summed error; a round that does not lower it is taken back and tried again at half the rate, so the error
falls from round to round. Training ends after ``rounds`` rounds, at a fall below FALL a row, or at a rate below SLOWEST.

A group of at most LOCAL rows is trained whole in one task; all larger ones take a round in the same job, where only one sum a vector and task moves. Codebooks travel TABLE_BYTES at a time.

Defined results: a row that lies on vectors of its own and another class has error 0 and no pull; groups of one class keep their codebook; equal distances go to the first vector; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import blocks
from evenkeel.functions.vectors import sum_vector
from evenkeel.operators.kernels import equi
from evenkeel.operators.runtime import settle

LOCAL = 1 << 14  # rows of a group that one task trains on
TABLE_BYTES = 32 << 20  # of codebooks that travel with one job
FALL = 1e-4
SLOWEST = 1e-3

Sums = tuple[float, np.ndarray, np.ndarray]  # error; weight and pull of each vector


def tally(x: np.ndarray, y: np.ndarray, book: np.ndarray, own: np.ndarray) -> Sums:
    error, weight, pull = 0.0, np.zeros(len(book)), np.zeros(book.shape)
    for at in blocks.steps(len(x), len(book)):
        some = x[at]
        gaps = blocks.all_distances(some, book) ** 2
        mine = own[None, :] == y[at][:, None]
        near = [np.where(side, gaps, np.inf).argmin(axis=1) for side in (mine, ~mine)]
        p, m = (gaps[np.arange(len(some)), n] for n in near)
        live = mine.any(axis=1) & ~mine.all(axis=1) & (p + m > 0)
        p, m, some, near = p[live], m[live], some[live], [n[live] for n in near]
        error += ((p - m) / (p + m)).sum()
        for n, w, sign in ((near[0], m / (p + m) ** 2, 1.0), (near[1], p / (p + m) ** 2, -1.0)):
            np.add.at(weight, n, w)
            np.add.at(pull, n, (sign * w)[:, None] * (some - book[n]))
    return error, weight, pull


def descend(measure: Callable[[dict[int, np.ndarray]], Mapping[int, Sums]], books: Mapping[int, np.ndarray], sizes: Mapping[int, int], rounds: int, rate: float) -> dict[int, tuple[np.ndarray, list[float]]]:
    """Codebook and the mean error before and after each round, of every group."""
    best, ways, rates = dict(books), {}, {g: rate for g in books}
    past: dict[int, list[float]] = {g: [] for g in books}
    trial = dict(books)
    while trial:
        found, following = measure(trial), {}
        for g, book in trial.items():
            error, weight, pull = found[g]
            error /= sizes[g]
            if not past[g] or error < past[g][-1]:
                fall = past[g][-1] - error if past[g] else np.inf
                past[g].append(error)
                best[g], ways[g] = book, pull / np.maximum(weight, 1e-300)[:, None]
                if fall <= FALL or len(past[g]) > rounds:
                    continue
            else:
                rates[g] /= 2
                if rates[g] < SLOWEST:
                    continue
            if ways[g].any():
                following[g] = best[g] + rates[g] * ways[g]
        trial = following
    return {g: (best[g], past[g]) for g in books}


def train(points: DataFrame, by: Sequence[str], starts: DataFrame, rounds: int = 50, rate: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(by..., label, cluster, center) from ``starts`` of the same columns, and (by..., round, error) with the mean error from the start on.

    ``points`` has by..., label, features. Starts and codebooks are held by the driver: a few vectors a class."""
    by, spark = list(by), points.sparkSession
    schema = [points.schema[c] for c in by]
    sides = [starts.schema["label"], T.StructField("cluster", T.LongType()), T.StructField("center", T.ArrayType(T.DoubleType()))]
    given: dict[tuple, list] = {}
    for r in starts.collect():  # a few rows a class
        given.setdefault(tuple(r[c] for c in by), []).append(r)
    keys = list(given)
    books = {g: np.array([r["center"] for r in sorted(given[k], key=lambda r: (r["label"], r["cluster"]))], dtype=float) for g, k in enumerate(keys)}
    names = {g: [(r["label"], r["cluster"]) for r in sorted(given[k], key=lambda r: (r["label"], r["cluster"]))] for g, k in enumerate(keys)}
    owns = {g: np.array([label for label, _ in names[g]]) for g in books}
    numbered = points.withColumn("gid", F.lit(0))
    if by:
        table = spark.createDataFrame([(*k, g) for g, k in enumerate(keys)], T.StructType([*schema, T.StructField("gid", T.IntegerType())]))
        numbered = equi(points, table, by)
    rows = settle(numbered.select("gid", F.col("label").cast("long").alias("y"), F.col("features").cast("array<double>").alias("features")))
    sizes = {r["gid"]: r["n"] for r in rows.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a group
    found = {g: (books[g], []) for g in books}  # groups without rows keep theirs
    lots, size = [[]], 0
    for g in sizes:
        if lots[-1] and size + books[g].nbytes > TABLE_BYTES:
            lots.append([])
            size = 0
        lots[-1].append(g)
        size += books[g].nbytes
    for lot in lots:
        small, large = [g for g in lot if sizes[g] <= LOCAL], [g for g in lot if sizes[g] > LOCAL]
        if small:
            found |= _inside(rows.where(F.col("gid").isin(small)), {g: books[g] for g in small}, owns, sizes, rounds, rate)
        if large:
            found |= descend(_spread(rows.where(F.col("gid").isin(large)), owns), {g: books[g] for g in large}, sizes, rounds, rate)
    vectors = [(*keys[g], label, cluster, center) for g, (book, _) in found.items() for (label, cluster), center in zip(names[g], book.tolist())]
    errors = [(*keys[g], i, float(e)) for g, (_, past) in found.items() for i, e in enumerate(past)]
    return (spark.createDataFrame(vectors, T.StructType([*schema, *sides])),
            spark.createDataFrame(errors, T.StructType([*schema, *T.StructType.fromDDL("round int, error double").fields])))


def _inside(rows: DataFrame, books: Mapping[int, np.ndarray], owns, sizes, rounds: int, rate: float) -> dict[int, tuple[np.ndarray, list[float]]]:
    held = rows.sparkSession.sparkContext.broadcast({g: (book, owns[g]) for g, book in books.items()})

    def fit(table: pa.Table) -> pa.Table:
        gid = table.column("gid")[0].as_py()
        book, own = held.value[gid]
        x, y = blocks.matrix(table.column("features")), table.column("y").to_numpy()
        order = np.lexsort((*x.T, y))  # sums do not depend on how rows arrive
        x, y = x[order], y[order]
        book, past = descend(lambda trial: {gid: tally(x, y, trial[gid], own)}, {gid: book}, sizes, rounds, rate)[gid]
        return pa.table({"gid": pa.array([gid], pa.int32()), "book": pa.array([book.tobytes()], pa.binary()), "past": pa.array([past], pa.list_(pa.float64()))})

    out = rows.groupBy("gid").applyInArrow(fit, "gid int, book binary, past array<double>").collect()  # a lot of groups
    return {r["gid"]: (np.frombuffer(r["book"]).reshape(books[r["gid"]].shape), list(r["past"])) for r in out}


def _spread(rows: DataFrame, owns):
    def measure(trial: dict[int, np.ndarray]) -> dict[int, Sums]:
        held = rows.sparkSession.sparkContext.broadcast({g: (book, owns[g]) for g, book in trial.items()})

        def task(batches):
            total: dict[int, Sums] = {}
            for batch in batches:
                gids, x, y = batch.column("gid").to_numpy(), blocks.matrix(batch.column("features")), batch.column("y").to_numpy()
                for gid in np.unique(gids).tolist():
                    at = gids == gid
                    new = tally(x[at], y[at], *held.value[gid])
                    total[gid] = tuple(a + b for a, b in zip(total[gid], new)) if gid in total else new
            for gid, (error, weight, pull) in total.items():
                n = len(weight)
                yield pa.RecordBatch.from_arrays([
                    pa.array([gid] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([error] + [0.0] * (n - 1)), pa.array(weight), pa.array(list(pull), pa.list_(pa.float64()))],
                    names=["gid", "place", "error", "weight", "pull"])

        own = rows.where(F.col("gid").isin(list(trial)))
        sums = own.mapInArrow(task, "gid int, place int, error double, weight double, pull array<double>").groupBy("gid", "place").agg(
            F.sum("error").alias("error"), F.sum("weight").alias("weight"), sum_vector("pull").alias("pull"))
        out = {g: [0.0, np.zeros(len(book)), np.zeros(book.shape)] for g, book in trial.items()}
        for r in sums.collect():  # a row a vector
            error, weight, pull = out[r["gid"]]
            out[r["gid"]][0] = error + r["error"]
            weight[r["place"]], pull[r["place"]] = r["weight"], r["pull"]
        held.destroy()
        return out

    return measure
