"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of partial scores, one per slice of the components. Phase 1 gathers, per query, the best entries of every slice's
list in every block of vectors, each with its partial scores in the other slices of the block, and the smallest partial score of each slice. The k-th
largest of their sums, spread evenly over the slices above their smallest values, is a cutoff that no result can stay under in every slice.
Phase 2 sends the cutoffs to all blocks and collects every entry at or above them; its better lower bounds raise the k-th, and upper
bounds under it drop out. Phase 3 goes back for the exact scores of what remains.

Scale: vectors lie in blocks of BLOCK rows, dealt by hash; queries visit every block, which is the stated work of a query set against all
rows. A task holds one block and streams queries past it. Of equal vectors only the k + 1 smallest ids can be in a result, so no more stay.

Vectors whose integers have a norm of WIDE or more could overflow the sums: every pair with such a vector is scored by unbounded integers instead, block by
block, and the best k of both ways are the result.

Defined results: components become floor(256 x); a score beyond the range of a long is ordered by its true value and returned as the nearest long; vectors that are
null, empty or hold null or non-finite components, and rows with a null id, take no part; rows that repeat an id and its vector count once; rows that share an
id and differ in their vector are queries and candidates of their own, each the other's candidate (the results of such queries share a query_id); only vectors of equal
length are compared; ties go to the smaller id; a query with fewer than k candidates returns them all; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.runtime import settle, width

SCALE = 256
WIDE = float(1 << 30)  # below this norm every partial sum of a product is under 2^60
OFFSET, DIGITS = 1 << 2200, 276  # a score of finite doubles as bytes that sort like it
SLICES = 2  # lists per query; with few of them the even share of the cutoff is strict
BLOCK = 16_384  # vectors that a task holds
EXACT_BLOCK = 2048  # as unbounded integers


def vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which vectors of a list column are present, not empty and finite throughout, and those as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.values
    at = np.asarray(column.offsets)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    bad = np.append(0, np.cumsum(~np.isfinite(values)))  # a null component becomes NaN
    present = ~np.asarray(column.is_null())
    good = present & (at[1:] > at[:-1]) & (bad[at[1:]] == bad[at[:-1]])
    return good, [values[a:b] if g else None for a, b, g in zip(at[:-1], at[1:], good)]


def _ints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The integers of every vector, or the doubles themselves of one that is wide."""
    for batch in batches:
        good, found = vectors(batch.column("vec"))
        found = [x + 0.0 for x in found if x is not None]
        with np.errstate(over="ignore"):
            scaled = [np.floor(SCALE * x) for x in found]
            narrow = [bool(np.linalg.norm(x) < WIDE) for x in scaled]
        own = [x.astype(np.int64) if few else None for x, few in zip(scaled, narrow)]
        raw = [None if few else x for x, few in zip(found, narrow)]
        yield pa.RecordBatch.from_arrays([
            batch.column("id").filter(pa.array(good)), pa.array([hashlib.blake2b((r if x is None else x).tobytes(), digest_size=16).digest() for x, r in zip(own, raw)], pa.binary()),
            pa.array([len(x) for x in found], pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(raw, pa.list_(pa.float64()))], names=["id", "key", "dim", "vec", "raw"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _slices(dim: int) -> list[slice]:
    cuts = [dim * i // SLICES for i in range(SLICES + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products, by floating point where that is exact."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    if int(np.abs(q).max()) * int(np.abs(v).max()) * q.shape[1] < 1 << 53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by dim and block, vectors before queries: each run of queries with its block's keys (``id``) and vectors."""
    place, ids, held, rows = None, [], [], None
    for batch in batches:
        dim, block = batch.column("dim").to_numpy(), batch.column("block").to_numpy()
        query = batch.column("query").to_numpy(zero_copy_only=False)
        change = np.flatnonzero((dim[1:] != dim[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1
        for low, high in zip([0, *change.tolist()], [*change.tolist(), len(dim)]):
            if low == high:
                continue
            if (at := (dim[low], block[low])) != place:
                place, ids, held, rows = at, [], [], None
            own = batch.slice(low, high - low)
            if not query[low]:
                ids.append(own.column("id").to_numpy())
                held.append(_matrix(own.column("vec")))
                rows = None
            elif ids:
                if rows is None:
                    rows = np.concatenate(ids), np.concatenate(held)
                for i in range(0, len(own), 128):
                    yield own.slice(i, 128), *rows


def _gather(k: int):
    """Phase 1: the sums of the k best entries of every slice's list, and under a null id each slice's smallest value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, held in _blocks(batches):
            query, own = part.column("id").to_numpy(), _matrix(part.column("vec"))
            lists = [_product(own[:, cut], held[:, cut]) for cut in _slices(own.shape[1])]
            least = np.stack([x.min(axis=1) for x in lists], axis=1)
            best = np.concatenate([np.argpartition(-x, min(k, len(ids) - 1), axis=1)[:, :k + 1] for x in lists], axis=1)  # one may be the query itself
            who, v = np.repeat(np.arange(len(query)), best.shape[1]), best.ravel()
            good = ids[v] != query[who]
            pairs = np.unique(np.stack([who[good], v[good]]), axis=1)
            # of a query's sums in this block only the k largest can matter
            sums = sum(x[pairs[0], pairs[1]] for x in lists)
            order = np.lexsort((-sums, pairs[0]))
            start = np.searchsorted(pairs[0][order], np.arange(len(query)))
            rank = np.arange(len(order)) - start[pairs[0][order]]
            chosen = order[rank < k]
            i, j = pairs[:, chosen]
            none = [[0] * SLICES] * len(i)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([query[i], query])), pa.array([*ids[j].tolist(), *[None] * len(query)], pa.int64()),
                pa.array([*sums[chosen].tolist(), *[None] * len(query)], pa.int64()), pa.array([*none, *least.tolist()], pa.list_(pa.int64()))], names=["q", "v", "low", "least"])

    return run


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 2: entries at or above the cutoff in some list, with the bounds that follow from the lists that reach it."""
    for part, ids, held in _blocks(batches):
        query, own = part.column("id").to_numpy(), _matrix(part.column("vec"))
        cutoff, least = _matrix(part.column("cutoff")), _matrix(part.column("least"))
        low = high = 0
        seen = np.zeros((len(query), len(ids)), bool)
        for number, cut in enumerate(_slices(own.shape[1])):
            score = _product(own[:, cut], held[:, cut])
            enough = score >= cutoff[:, number, None]
            seen |= enough
            low = low + np.where(enough, score, least[:, number, None])
            high = high + np.where(enough, score, cutoff[:, number, None] - 1)
        seen &= query[:, None] != ids[None, :]
        i, j = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([
            pa.array(query[i]), pa.array(ids[j]), part.column("block").take(pa.array(np.asarray(i, np.int64))), pa.array(low[i, j]), pa.array(high[i, j])], names=["q", "v", "block", "low", "high"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 3: exact scores of the ids that each query still asks this block for."""
    for part, ids, held in _blocks(batches):
        order = np.argsort(ids)
        query, own, asked = part.column("id").to_numpy(), _matrix(part.column("vec")), part.column("asked")
        for i in range(len(query)):
            want = asked[i].values.to_numpy()
            at = order[np.searchsorted(ids, want, sorter=order)]
            score = _product(own[i:i + 1], held[at])[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(want), query[i])), pa.array(want), pa.array(score)], names=["q", "v", "score"])


def _whole(raw: np.ndarray) -> np.ndarray:
    """floor(256 x) as unbounded integers."""
    out = np.empty(raw.shape, object)
    out.ravel()[:] = [int(x) * SCALE if abs(x) >= 2.0 ** 53 else math.floor(x * SCALE) for x in raw.ravel().tolist()]
    return out


def _exact(k: int):
    """The k best of a block for every query, by unbounded integers; scores as bytes. ``own`` is the id to which ties go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, names, held = None, [], []
        for batch in batches:
            for low in range(batch.num_rows):
                row = {c: batch.column(c)[low].as_py() for c in ("dim", "block", "query", "id", "own", "raw")}
                if (at := (row["dim"], row["block"])) != place:
                    place, names, held, whole = at, [], [], None
                if not row["query"]:
                    names.append((row["own"], row["id"]))
                    held.append(row["raw"])
                    continue
                if not held:
                    continue
                if whole is None:
                    whole = _whole(np.array(held))
                scores = (whole @ _whole(np.array([row["raw"]]))[0]).tolist()
                best = heapq.nsmallest(k, ((-s, *name) for s, name in zip(scores, names) if name[1] != row["id"]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["id"]] * len(best), pa.int64()), pa.array([b[2] for b in best], pa.int64()),
                    pa.array([(OFFSET - b[0]).to_bytes(DIGITS, "big") for b in best], pa.binary())], names=["q", "v", "score"])

    return run


def _sortable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [(OFFSET + x).to_bytes(DIGITS, "big") for x in batch.column("score").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("v"), pa.array(scores, pa.binary())], names=["q", "v", "score"])


def _longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [min(max(int.from_bytes(x, "big") - OFFSET, -(1 << 63)), (1 << 63) - 1) for x in batch.column("score").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.int64())], names=["query_id", "rank", "vec_id", "score"])


def _kth(rows: DataFrame, k: int, value: str) -> DataFrame:
    """(q, kth): the k-th largest value of each query, null if there are fewer."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(value)))
    top = rows.select("q", value).withColumn("rank", rank).where(F.col("rank") <= k)
    return top.groupBy("q").agg(F.min(F.when(F.col("rank") == k, F.col(value))).alias("kth"))


def search(rows: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of every query row with all other rows."""
    spark, parts = rows.sparkSession, width(rows.sparkSession)
    source = rows.select(F.col(id).cast("long").alias("own"), F.col(vector).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("own IS NOT NULL")
    found = source.select(F.col("own").alias("id"), "vec").mapInArrow(_ints, "id long, key binary, dim int, vec array<long>, raw array<double>")
    # an id may have several vectors: from here on ``id`` is a number of the pair
    every_row = settle(found.withColumnRenamed("id", "own").dropDuplicates(["own", "key"]).withColumn("id", F.monotonically_increasing_id()))
    clean, names = every_row.where("raw IS NULL"), every_row.select("id", "own")
    asks = source.where("asks").select("own").distinct()
    rank = F.row_number().over(Window.partitionBy("key").orderBy("own", "id"))
    kept = every_row.select("key", "own", "id").withColumn("r", rank).where(F.col("r") <= k + 1).select("id")
    held = clean.join(kept, "id", "left_semi")
    total = held.count()
    count = max(1, -(-total // BLOCK))
    held = settle(held.select("dim", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("block"), "id", "vec"))
    queries = settle(clean.join(asks, "own", "left_semi").select("dim", "id", "vec"))
    places = held.select("dim", "block").distinct()  # at most one row per block and length
    homes = held.withColumn("query", F.lit(False))

    def visit(guests: DataFrame, fn, ddl: str) -> DataFrame:
        both = homes.unionByName(guests.withColumn("query", F.lit(True)), allowMissingColumns=True)
        return both.repartition(parts, "dim", "block").sortWithinPartitions("dim", "block", "query").mapInArrow(fn, ddl)

    every = queries.join(places, "dim")
    first = settle(visit(every, _gather(k), "q long, v long, low long, least array<long>"))
    lists = range(SLICES)
    floors = first.where("v IS NULL").groupBy("q").agg(*[F.min(F.col("least")[i]).alias(f"f{i}") for i in lists])
    lower = first.where("v IS NOT NULL").select("q", "low")
    floor_sum = reduce(lambda a, b: a + b, [F.col(f"f{i}") for i in lists])
    share = F.floor((F.col("kth") - floor_sum) / SLICES).cast("long")
    cutoffs = floors.join(_kth(lower, k, "low"), "q", "left").select(
        F.col("q").alias("id"), F.array(*[F.col(f"f{i}") for i in lists]).alias("least"),
        F.array(*[F.col(f"f{i}") + F.greatest(F.lit(0).cast("long"), F.coalesce(share, F.lit(0).cast("long"))) for i in lists]).alias("cutoff"))
    cutoffs = settle(cutoffs)
    second = settle(visit(every.join(cutoffs, "id"), _collect, "q long, v long, block int, low long, high long"))
    raised = _kth(second, k, "low")
    remain = second.join(raised, "q").where("kth IS NULL OR high >= kth").groupBy("q", "block").agg(F.collect_list("v").alias("asked"))
    third = visit(queries.join(remain.withColumnRenamed("q", "id"), "id"), _resolve, "q long, v long, score long")
    wide = every_row.where("raw IS NOT NULL")
    many = wide.count()
    if many:
        # a block of wide vectors meets all queries, one of the others the wide queries alone
        blocks, others = -(-many // EXACT_BLOCK), max(1, -(-total // EXACT_BLOCK))
        doubles = F.coalesce("raw", F.transform("vec", lambda x: x / F.lit(float(SCALE)))).alias("raw")
        stay = settle(every_row.join(kept, "id", "left_semi").select("dim", "id", "own", F.col("raw").isNotNull().alias("wide"), doubles))
        number = F.when(F.col("wide"), -1 - F.pmod(F.xxhash64("id"), F.lit(blocks))).otherwise(F.pmod(F.xxhash64("id"), F.lit(others)))
        stay = stay.withColumn("block", number.cast("int")).drop("wide").withColumn("query", F.lit(False))
        guests = every_row.join(asks, "own", "left_semi").select("dim", "id", "own", F.col("raw").isNotNull().alias("wide"), doubles)
        guests = guests.join(stay.select("dim", "block").distinct(), "dim").where("wide OR block < 0").drop("wide").withColumn("query", F.lit(True))
        met = stay.unionByName(guests).repartition(parts, "dim", "block").sortWithinPartitions("dim", "block", "query")
        exact = met.mapInArrow(_exact(k), "q long, v long, score binary")
        third = third.mapInArrow(_sortable, "q long, v long, score binary").unionByName(exact)
    named = third.join(names.select(F.col("id").alias("v"), F.col("own").alias("vec_id")), "v")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "v"))
    top = named.withColumn("rank", best).where(F.col("rank") <= k).join(names.select(F.col("id").alias("q"), F.col("own").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")
    return top.mapInArrow(_longs, "query_id long, rank int, vec_id long, score long") if many else top
