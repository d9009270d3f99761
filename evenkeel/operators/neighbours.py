"""Exact nearest-neighbour and ball joins.

References that fit a size bound are sent to every executor and queries stream past
them. Beyond it, a nearest join of few queries sends the queries instead: references are
read once where they lie, and each task keeps the k best of every query. Otherwise
references are cut into blocks of bounded size: Voronoi cells of
sampled pivots, sliced by distance to the pivot. A query meets only blocks that the
triangle inequality (or the cell boundary) cannot rule out. Blocks lie on shelves: a query
travels once to every shelf with an open block, marked with the parts that are open, so
what moves does not depend on the size of blocks. A shelf and its chunk of queries are one
Arrow task of bounded size, and partial results are merged by a window or a sum. A nearest
join meets a shelf in parts, so that the kernel's copies are those of a part.
Pivots steer cost only; every result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import blocks
from evenkeel.operators.runtime import settle, small_table, spread, width

LOCAL_BYTES = 32 << 20
LOCAL_ROWS = 1 << 16  # references that every query meets, at most
SPREAD_ROWS = 1 << 13  # of them from which on queries are dealt to all tasks
CHUNK_ROWS = 2048  # queries that meet a block in one task
SHELF_BYTES = 32 << 20  # of blocks that lie together, and of the queries that meet them in one task
SHELF_ROWS = 1 << 16  # the same, in rows
SHELF_CHUNKS = 8  # tasks that the queries of a shelf are dealt to, before their number bounds them
BOOKS = 62  # parts of a shelf that a query's mask tells apart
TAKE_ROWS = 1 << 15  # rows handed to Spark at a time when a query goes to many cells
PIVOT_BYTES = 16 << 20  # of all pivots together
SPREAD_BYTES = 1 << 30
STREAM_QUERIES = 8192  # this few queries travel to the references; more of them meet blocks
STREAM_WAVES = 8  # tasks per core, at most, that read references for travelling queries
STREAM_ROWS = 1 << 15  # references that travelling queries meet at a time
MEET_BYTES = 4 << 20  # of a shelf that its queries meet at a time in a nearest join: a kernel holds some copies of it


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(),
        T.StringType(): pa.string(), T.ArrayType(T.DoubleType()): pa.list_(pa.float64()),
    }
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema.fields])


def group_rows(table, by: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Row positions of every ``by`` key in an Arrow table or batch."""
    n = table.num_rows
    if not by:
        return {(): np.arange(n)}
    if not n:
        return {}
    code = np.zeros(n, dtype="int64")
    for c in by:
        column = table.column(c)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        found = column.dictionary_encode(null_encoding="encode")
        # folded again per column, so that codes stay below n * levels
        code = np.unique(code * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    groups = np.split(order, np.cumsum(np.bincount(code))[:-1])
    return {tuple(table.column(c)[int(rows[0])].as_py() for c in by): rows for rows in groups}


def _unpack(table, id: str, vec: str, extra: Sequence[str]):
    ids = table.column(id).to_numpy()
    return ids, blocks.matrix(table.column(vec)), {c: table.column(c).to_numpy() for c in extra}


def _emit(table, by, rows, ids, positions, out, schema: pa.Schema):
    data = {}
    for c in by:
        data[c] = table.column(c).take(pa.array(rows[positions]))
    data["q_id"] = ids[positions]
    data.update(out)
    cols = [
        c.combine_chunks() if isinstance(c, pa.ChunkedArray) else _lists(c) if getattr(c, "ndim", 1) == 2 else pa.array(c, type=f.type)
        for f, c in ((f, data[f.name]) for f in schema)
    ]
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def _lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of lists, without an object a row."""
    many, wide = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * wide), pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel()))


def reached(bound: np.ndarray, found: dict[str, np.ndarray], k: int) -> np.ndarray:
    """The bounds of queries, lowered to the distance of the k-th of those found (``pos``, ``rank``, ``dist``)."""
    full = found["rank"] == k
    bound = bound.copy()
    bound[found["pos"][full]] = np.minimum(bound[found["pos"][full]], found["dist"][full])
    return bound


def nearest_of(found: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The k best rows of every query ``pos``, ranked by distance and id."""
    order = np.lexsort((found["nbr_id"], found["dist"], found["pos"]))
    found = {name: values[order] for name, values in found.items()}
    rank = np.arange(len(order)) - np.searchsorted(found["pos"], found["pos"], side="left")
    found["rank"] = rank + 1
    return {name: values[rank < k] for name, values in found.items()}


def _visits(mask: np.ndarray, book: np.ndarray):
    """(query rows, reference rows) that together make every meeting once: by equal masks, or by books where those are fewer."""
    masks, which = np.unique(mask, return_inverse=True)
    books = np.unique(book)
    if len(masks) <= len(books):
        for m, own in enumerate(masks):
            near = np.flatnonzero(own >> book & 1)
            if len(near):
                yield np.flatnonzero(which == m), near
        return
    for b in books:
        rows = np.flatnonzero(mask >> np.int64(b) & 1)
        if len(rows):
            yield rows, np.flatnonzero(book == b)


def meet_shelf(left, right, kernel, extra: Sequence[str], carry: Sequence[str], best: int = 0):
    """Query ids, the query positions and the kernel's columns of queries (``left``) that meet the open books of a shelf (``right``). With
    ``best`` the shelf is met a part of MEET_BYTES at a time, only that many of the nearest a query are kept, and they bound what is looked for in the parts
    that follow. What a kernel marked as ``sums`` gives is added up, so that a query has one row however many books it meets."""
    ids, mat, side = _unpack(left, "q_id", "_qvec", extra)
    mask = left.column("_mask").to_numpy()
    step = max(1, MEET_BYTES // (8 * max(1, mat.shape[1]))) if best else right.num_rows
    bound = left.column("_theta").to_numpy() * (1 + 1e-9) + 1e-7 if "_theta" in left.column_names else np.full(len(ids), np.inf)
    found, added, met = [], {}, np.zeros(len(ids), bool)
    for low in range(0, right.num_rows, step):
        part = right.slice(low, step)
        rid, rmat, held = _unpack(part, "_rid", "_rvec", carry)
        for rows, near in _visits(mask, part.column("_book").to_numpy()):
            if len(near) < len(rid):
                refs = rid[near], rmat[near], {c: v[near] for c, v in held.items()}
            else:
                refs = rid, rmat, held
            own = {c: v[rows] for c, v in side.items()}
            positions, out = kernel(ids[rows], mat[rows], own | {"bound": bound[rows]} if best else own, *refs)
            if getattr(kernel, "sums", False):
                met[rows[positions]] = True
                for name, values in out.items():
                    if name not in added:
                        added[name] = np.zeros((len(ids), *values.shape[1:]), values.dtype)
                    added[name][rows[positions]] += values  # a query occurs once
            else:
                found.append((rows[positions], out))
        if best and found:
            kept = {name: np.concatenate([o[name] for _, o in found]) for name in found[0][1]}
            kept = nearest_of({"pos": np.concatenate([p for p, _ in found]), **kept}, best)
            bound = reached(bound, kept, best)
            found = [(kept.pop("pos"), kept)]
    if added:
        some = np.flatnonzero(met)
        return ids, some, {name: values[some] for name, values in added.items()}
    positions = np.concatenate([p for p, _ in found])
    return ids, positions, {name: np.concatenate([o[name] for _, o in found]) for name in found[0][1]}


class Neighbours:
    """Reference side of a neighbour join, grouped by ``by``.

    ``copies`` keeps only that many smallest ids of identical vectors in the block
    path: enough for a k-nearest join with ``copies > k``, and what stops a hot
    group of copies from meeting itself.
    """

    def __init__(self, refs: DataFrame, by: Sequence[str] = (), id: str = "row_id", vec: str = "features",
                 carry: Sequence[str] = (), copies: int | None = None, local_bytes: int = LOCAL_BYTES,
                 block_rows: int | None = None, metric: bool = True, stream_queries: int = STREAM_QUERIES):
        self.spark = refs.sparkSession
        self.by, self.carry, self.copies = list(by), list(carry), copies
        self.local_bytes, self.stream_queries = local_bytes, stream_queries
        self.metric = metric  # without the triangle inequality there are no pivots and nothing is ruled out
        self.refs = refs.select(*self.by, F.col(id).cast("bigint").alias("_rid"), F.col(vec).alias("_rvec"), *self.carry)
        size = refs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
        self.rows, self.dim = int(size["n"]), int(size["d"] or 0)
        # few features: small blocks, most of which are ruled out; many: larger ones, since little is
        # ruled out and every block a query meets costs a copy of the query. 16 MiB at 64 features.
        self.block_rows = block_rows or min(1 << 15, max(1 << 12, 512 * self.dim))
        self.local = None
        self.blocked = None
        if self.rows <= LOCAL_ROWS and self.rows * (self.dim + 2 + len(self.carry) + len(self.by)) * 8 <= local_bytes:
            table = self.refs.toArrow()
            held = {}
            for key, rows in group_rows(table, self.by).items():
                if not len(rows):
                    continue
                part = table.take(pa.array(rows))
                ids, mat, side = _unpack(part, "_rid", "_rvec", self.carry)
                held[key] = (ids, mat, side)
            self.local = self.spark.sparkContext.broadcast(held)

    # ---- queries -------------------------------------------------------

    def knn(self, queries: DataFrame, k: int, id: str = "row_id", vec: str = "features", skip_self: bool = True) -> DataFrame:
        """(by..., q_id, rank, nbr_id, dist, carry...)."""
        kernel = blocks.nearest(k, skip_self, tuple(self.carry))
        fields = T.StructType.fromDDL("rank bigint, nbr_id bigint, dist double").fields + [
            self.refs.schema[c] for c in self.carry]
        if self.local is not None or not self.rows:
            return self._local(queries, kernel, fields, id, vec, ())
        if self._few(queries):
            return self._streamed_knn(queries, kernel, fields, k, id, vec)
        self._cut()
        return self._blocked_knn(queries, kernel, fields, k, id, vec, skip_self)

    def meet(self, queries: DataFrame, kernel, fields: str, id: str = "row_id", vec: str = "features",
             extra: Sequence[str] = (), reach: str | None = None) -> DataFrame:
        """Partial kernel results per (query, block); ``reach`` names a distance column
        beyond which a query has nothing to find. The caller sums or merges them."""
        parsed = T.StructType.fromDDL(fields).fields
        if self.local is not None or not self.rows:
            return self._local(queries, kernel, parsed, id, vec, extra)
        self._cut()
        q = self._queries(queries, id, vec, extra)
        q = q.withColumn("_theta", F.col(reach) if reach else F.lit(float("inf")))
        return self._meet(self._route(q).drop("_theta"), kernel, parsed, extra)

    # ---- references sent to executors ----------------------------------

    def _queries(self, queries, id, vec, extra):
        return queries.select(*self.by, F.col(id).cast("bigint").alias("q_id"), F.col(vec).alias("_qvec"), *extra)

    def _local(self, queries, kernel, fields, id, vec, extra):
        by, held, extra = self.by, self.local, list(extra)
        q = self._queries(queries, id, vec, extra)
        if self.rows >= SPREAD_ROWS:
            q = spread(q, "q_id")  # a small file of queries is one split, but a long way past many references
        schema = T.StructType([q.schema[c] for c in by] + [T.StructField("q_id", T.LongType())] + list(fields))
        arrow = _arrow_schema(schema)

        def run(batches):
            groups = held.value if held is not None else {}
            for batch in batches:
                for key, rows in group_rows(batch, by).items():
                    if key not in groups or not len(rows):
                        continue
                    part = batch.take(pa.array(rows))
                    ids, mat, side = _unpack(part, "q_id", "_qvec", extra)
                    rid, rmat, carry = groups[key]
                    positions, out = kernel(ids, mat, side, rid, rmat, carry)
                    yield _emit(batch, by, rows, ids, positions, out, arrow)

        return q.mapInArrow(run, schema)

    # ---- queries sent to the references --------------------------------

    def _few(self, queries: DataFrame) -> bool:
        """Whether the queries may travel: few enough, and within the size bound."""
        if not self.stream_queries:
            return False
        n = queries.select(*self.by).limit(self.stream_queries + 1).count()
        return n <= self.stream_queries and n * (self.dim + 2 + len(self.by)) * 8 <= self.local_bytes

    def _streamed_knn(self, queries, kernel, fields, k, id, vec) -> DataFrame:
        by, carry = self.by, list(self.carry)
        q = self._queries(queries, id, vec, ())
        schema = T.StructType([q.schema[c] for c in by] + [T.StructField("q_id", T.LongType())] + list(fields))
        arrow = _arrow_schema(schema)
        table = q.toArrow()
        groups = {}
        for key, rows in group_rows(table, by).items():
            part = table.take(pa.array(rows)).combine_chunks()
            groups[key] = (part, *_unpack(part, "q_id", "_qvec", ())[:2])
        held = self.spark.sparkContext.broadcast(groups)

        def merge(best, found):
            """The k best of each query, of those kept so far and new ones; their ``rank`` is among both."""
            if best is not None:
                found = {name: np.concatenate([best[name], found[name]]) for name in found}
            return nearest_of(found, k)

        def run(batches):
            best: dict[tuple, dict[str, np.ndarray]] = {}

            def meet(waiting):
                met = pa.Table.from_batches(waiting)
                for key, rows in group_rows(met, by).items():
                    if key in held.value:
                        _, ids, mat = held.value[key]
                        rid, rmat, side = _unpack(met.take(pa.array(rows)), "_rid", "_rvec", carry)
                        bound = np.full(len(ids), np.inf)
                        if key in best:
                            bound = reached(bound, best[key], k)
                        positions, out = kernel(ids, mat, {"bound": bound}, rid, rmat, side)
                        best[key] = merge(best.get(key), {"pos": positions, **out})

            waiting, rows = [], 0
            for batch in batches:
                waiting.append(batch)
                rows += batch.num_rows
                if rows >= STREAM_ROWS:
                    meet(waiting)
                    waiting, rows = [], 0
            if rows:
                meet(waiting)
            for key, found in best.items():
                part, ids, _ = held.value[key]
                out = {name: values for name, values in found.items() if name != "pos"}
                yield _emit(part, by, np.arange(len(ids)), ids, found["pos"], out, arrow)

        # every task hands on k rows per query, so a great many small splits are read in fewer tasks
        refs = spread(self.refs).coalesce(STREAM_WAVES * self.spark.sparkContext.defaultParallelism)
        partial = refs.mapInArrow(run, schema)
        order = Window.partitionBy(*by, "q_id").orderBy("dist", "nbr_id")
        return partial.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)

    # ---- references cut into blocks ------------------------------------

    def _cut(self):
        if self.blocked is not None:
            return
        by, cap = self.by, self.block_rows
        refs = self._few_copies() if self.copies else self.refs
        if self.rows * self.dim * 8 <= SPREAD_BYTES:
            refs = refs.repartition(width(self.spark), "_rid")  # a small file may come as one split
        self.pivots = self.spark.sparkContext.broadcast(self._draw_pivots(self.refs) if self.metric else {})
        held = self.pivots

        def assign(batches):
            closest: dict[tuple, blocks.Closest] = {}
            for batch in batches:
                cell, dp = np.full(batch.num_rows, -1, dtype="int32"), np.zeros(batch.num_rows)
                vecs = blocks.matrix(batch.column("_rvec"))
                for key, rows in group_rows(batch, by).items():
                    if key in held.value:
                        if key not in closest:
                            closest[key] = blocks.Closest(held.value[key])
                        cell[rows], dp[rows] = closest[key].of(vecs[rows])
                yield pa.RecordBatch.from_arrays(
                    list(batch.columns) + [pa.array(cell), pa.array(dp)], names=batch.schema.names + ["_cell", "_dp"])

        schema = T.StructType(refs.schema.fields + [T.StructField("_cell", T.IntegerType()), T.StructField("_dp", T.DoubleType())])
        placed = settle(refs.mapInArrow(assign, schema))
        at = [*by, "_cell"]
        cells = settle(placed.groupBy(*at).agg(
            F.min("_dp").alias("_lo"), F.max("_dp").alias("_hi"), F.count(F.lit(1)).alias("_n")))
        slots = F.ceil(F.col("_n") / F.lit(cap))
        share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_dp") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
        sliced = self._join(placed, cells, at).withColumn(
            "_slab", F.least(F.floor(share * slots), slots - 1).cast("bigint")).drop("_lo", "_hi", "_n")
        slabs = sliced.groupBy(*at, "_slab").agg(F.count(F.lit(1)).alias("_n"))
        self.keys = [*at, "_slab", "_salt"]
        self.blocked = settle(self._join(sliced, slabs, [*at, "_slab"]).withColumn(
            "_salt", F.pmod(F.xxhash64("_rid"), F.ceil(F.col("_n") / F.lit(cap)))).drop("_n"))
        # blocks in the order of their cells fill shelves; the window sees one row per block of a group
        stats = self.blocked.groupBy(*self.keys).agg(
            F.min("_dp").alias("_lo"), F.max("_dp").alias("_hi"), F.count(F.lit(1)).alias("_n"))
        line = Window.partitionBy(*by).orderBy("_cell", "_slab", "_salt").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_n").over(line), F.lit(0).cast("bigint"))
        self.shelf_rows = max(cap, min(SHELF_ROWS, SHELF_BYTES // (8 * max(1, self.dim))))
        stats = stats.withColumn("_before", before)
        stats = stats.withColumn("_shelf", F.floor(F.col("_before") / F.lit(self.shelf_rows)).cast("bigint"))
        share = F.pmod("_before", F.lit(self.shelf_rows)) * BOOKS / F.lit(self.shelf_rows)
        self.stats = settle(stats.withColumn("_book", F.floor(share).cast("int")).drop("_before", "_n"))
        known_blocks: dict[tuple, list] = {}
        # one row per block of the groups that have pivots
        for row in self.stats.filter(F.col("_cell") >= 0).collect():
            known_blocks.setdefault(tuple(row[c] for c in by), []).append(
                (row["_cell"], row["_lo"], row["_hi"], row["_shelf"], row["_book"]))
        # one row per pivot, PIVOT_BYTES of vectors at most
        known: dict[tuple, dict[str, np.ndarray]] = {}
        for row in cells.filter(F.col("_cell") >= 0).collect():
            key = tuple(row[c] for c in by)
            size = len(held.value[key])
            entry = known.setdefault(key, {"lo": np.zeros(size), "hi": np.zeros(size), "n": np.zeros(size, dtype="int64")})
            entry["lo"][row["_cell"]], entry["hi"][row["_cell"]], entry["n"][row["_cell"]] = row["_lo"], row["_hi"], row["_n"]
        for key, rows in known_blocks.items():
            entry = known[key]
            for name, values in zip(("cell", "low", "high", "shelf", "book"), zip(*rows)):
                entry[name] = np.array(values)
            order = np.lexsort((entry["book"], entry["shelf"]))
            for name in ("cell", "low", "high", "shelf", "book"):
                entry[name] = entry[name][order]
        self.cells = self.spark.sparkContext.broadcast(known)

    def _few_copies(self) -> DataFrame:
        """At most ``copies`` rows per distinct vector. Whether there are more is told by counting hashes,
        combined before the shuffle; only then do the vectors themselves move."""
        at = [*self.by, "_hash"]
        hashed = self.refs.withColumn("_hash", F.xxhash64("_rvec"))
        top = hashed.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
        if top <= self.copies:
            return self.refs
        # ordered by hash first, so that vectors are compared only within a hash; the rank filter
        # is applied before the shuffle too, so a hot vector sends ``copies`` rows per task
        same = Window.partitionBy(*at, "_rvec").orderBy("_rid")
        ranked = hashed.withColumn("_copy", F.row_number().over(same))
        return ranked.filter(F.col("_copy") <= self.copies).drop("_copy", "_hash")

    def _draw_pivots(self, refs: DataFrame) -> dict[tuple, np.ndarray]:
        """For every group of more than one block, as many pivots as blocks, up to the square root of its rows. Beyond
        PIVOT_BYTES in all, every group gives up the same share; a group left without any is one cell."""
        by, cap = self.by, self.block_rows
        quota = F.least(F.ceil(F.col("_n") / F.lit(cap)), F.ceil(F.sqrt("_n")))
        sizes = refs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cap).withColumn("_quota", quota)
        sizes = small_table(sizes)
        most = PIVOT_BYTES // (8 * max(1, self.dim))
        wanted = sizes.agg(F.sum("_quota")).first()[0] or 0
        if wanted > most:
            sizes = sizes.withColumn("_quota", F.floor(F.col("_quota") * F.lit(most) / F.lit(wanted))).filter("_quota > 0")
        # four times the quota pass the hash, so a window sorts no more than that many rows of a group
        hashed = F.pmod(F.xxhash64("_rid"), F.lit(1 << 30))
        some = self._join(refs, sizes, by).filter(hashed < F.lit(float(1 << 30)) * 4 * F.col("_quota") / F.col("_n"))
        draw = Window.partitionBy(*by).orderBy(hashed, "_rid")
        drawn = some.withColumn("_draw", F.row_number().over(draw)).filter(F.col("_draw") <= F.col("_quota")).select(*by, "_rvec").toArrow()
        return {
            key: np.unique(blocks.matrix(drawn.column("_rvec").take(pa.array(rows))), axis=0)
            for key, rows in group_rows(drawn, by).items() if len(rows)
        }

    def _locate(self, q: DataFrame, k: int | None) -> DataFrame:
        """With ``k``: the home block of every query and a first reach ``_theta`` that surely
        holds k + 1 references. Without: one row per shelf with a block within ``_theta``, bits of
        ``_mask`` naming the books that hold one; a group without pivots has all of its shelves open (-1)."""
        by, pivots, cells, cap = self.by, self.pivots, self.cells, self.block_rows
        added = [T.StructField("_cell", T.IntegerType())]
        if k:
            added += [T.StructField("_slab", T.LongType()), T.StructField("_theta", T.DoubleType())]
        else:
            added = [T.StructField("_shelf", T.LongType()), T.StructField("_mask", T.LongType())]
        schema = T.StructType(q.schema.fields + added)
        names = [f.name for f in schema.fields]

        def place(batches):
            between: dict[tuple, np.ndarray] = {}
            for batch in batches:
                vecs = blocks.matrix(batch.column("_qvec"))
                theta = None if k else batch.column("_theta").to_numpy()
                for key, rows in group_rows(batch, by).items():
                    p = pivots.value.get(key)
                    if p is None:
                        some = batch.take(pa.array(rows))
                        n = len(rows)
                        extra = [np.full(n, -1, dtype="int64"), np.full(n, -1, dtype="int64")]
                        if k:
                            extra = [np.full(n, -1, dtype="int32"), np.zeros(n, dtype="int64"), np.full(n, np.inf)]
                        yield pa.RecordBatch.from_arrays(list(some.columns) + [pa.array(e) for e in extra], names=names)
                        continue
                    stat = cells.value[key]
                    for part in blocks.steps(len(rows), len(p) if k else max(len(p), len(stat["cell"]))):
                        here = rows[part]
                        d = blocks.all_distances(vecs[here], p)
                        filled = np.where(stat["n"] > 0, d, np.inf)
                        home = filled.argmin(axis=1)
                        line = np.arange(len(here))
                        if k:
                            lo, hi, n = stat["lo"][home], stat["hi"][home], stat["n"][home]
                            slots = np.ceil(n / cap)
                            span = np.where(hi > lo, hi - lo, 1.0)
                            slab = np.clip(np.floor((d[line, home] - lo) / span * slots), 0, slots - 1)
                            first = np.where(stat["n"] > k, d + stat["hi"], np.inf).min(axis=1)
                            some = batch.take(pa.array(here))
                            extra = [home.astype("int32"), slab.astype("int64"), first]
                        else:
                            bound = np.maximum(d - stat["hi"], stat["lo"] - d)
                            if len(p) <= 2048:
                                if key not in between:
                                    between[key] = blocks.all_distances(p, p)
                                gaps = between[key][home]
                            else:
                                gaps = blocks.all_distances(p[home], p)
                            gaps[gaps == 0] = np.inf  # the home itself, and pivots that rounding does not tell from it
                            bound = np.maximum(bound, (d**2 - d[line, home][:, None] ** 2) / (2 * gaps))
                            reach = theta[here][:, None] * (1 + 1e-9) + 1e-7
                            open_ = (bound * (1 - 1e-9) - 1e-7 <= theta[here][:, None]) & (stat["n"] > 0)
                            # blocks by shelf and book: the bits of a shelf's open books, summed
                            near = open_[:, stat["cell"]]
                            dist = d[:, stat["cell"]]
                            near &= (dist - stat["high"] <= reach) & (stat["low"] - dist <= reach)
                            part_of = stat["shelf"] * BOOKS + stat["book"]
                            books = np.flatnonzero(np.append(True, part_of[1:] != part_of[:-1]))
                            bits = np.where(np.logical_or.reduceat(near, books, axis=1), np.int64(1) << stat["book"][books].astype(np.int64), 0)
                            shelves = np.flatnonzero(np.append(True, np.diff(stat["shelf"][books]) != 0))
                            masks, names_of = np.add.reduceat(bits, shelves, axis=1), stat["shelf"][books][shelves]
                            i, at_shelf = np.nonzero(masks)
                            for at in range(0, len(i), TAKE_ROWS):
                                ti, tc = i[at : at + TAKE_ROWS], at_shelf[at : at + TAKE_ROWS]
                                some = batch.take(pa.array(here[ti]))
                                extra = [pa.array(names_of[tc].astype("int64")), pa.array(masks[ti, tc])]
                                yield pa.RecordBatch.from_arrays(list(some.columns) + extra, names=names)
                            continue
                        yield pa.RecordBatch.from_arrays(list(some.columns) + [pa.array(e) for e in extra], names=names)

        return q.mapInArrow(place, schema)

    def _route(self, q: DataFrame) -> DataFrame:
        """One row per query and shelf with blocks within its ``_theta``."""
        placed = self._locate(q, None)
        if self.stats.filter(F.col("_cell") < 0).limit(1).count() == 0:
            return placed
        # groups without pivots: all their shelves, with all books
        whole = self.stats.filter(F.col("_cell") < 0).select(*self.by, F.col("_shelf").alias("_all")).distinct()
        every = self._join(placed.filter(F.col("_shelf") < 0), whole, self.by)
        every = every.withColumn("_shelf", F.col("_all")).drop("_all")
        return placed.filter(F.col("_shelf") >= 0).unionByName(every)

    def _pair(self, routed: DataFrame, refs: DataFrame, keys: Sequence[str], few: int, most: int, parts: int):
        """Cogroup query chunks with what lies under ``keys``; both sides are bounded. Queries of a key are dealt to
        ``parts`` chunks, of ``few`` to ``most`` rows."""
        size = F.least(F.lit(most), F.greatest(F.lit(few), F.ceil(F.count(F.lit(1)) / F.lit(parts))))
        load = routed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_chunks"))
        left = self._join(routed, load, keys).withColumn("_chunk", F.pmod(F.xxhash64("q_id"), "_chunks")).drop("_chunks")
        right = self._join(refs, load, keys).withColumn(
            "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1))).drop("_chunks", "_dp")
        at = [*keys, "_chunk"]
        return left.groupBy(*at).cogroup(right.groupBy(*at))

    def _meet(self, routed: DataFrame, kernel, fields, extra, best: int = 0) -> DataFrame:
        """Kernel results of every query with the open books of a shelf; with ``best``, only that many of the nearest a query."""
        by, carry, extra = self.by, self.carry, list(extra)
        schema = T.StructType([routed.schema[c] for c in by] + [T.StructField("q_id", T.LongType())] + list(fields))
        arrow = _arrow_schema(schema)

        def run(left, right):
            if not left.num_rows or not right.num_rows:
                return arrow.empty_table()
            ids, positions, out = meet_shelf(left, right, kernel, extra, carry, best)
            return pa.Table.from_batches([_emit(left, by, np.arange(len(ids)), ids, positions, out, arrow)])

        at = [*by, "_shelf"]
        refs = self._join(self.blocked, self.stats.select(*self.keys, "_shelf", "_book"), self.keys).drop("_cell", "_slab", "_salt")
        chunk = min(SHELF_ROWS, max(CHUNK_ROWS, SHELF_BYTES // (8 * max(1, self.dim))))
        return self._pair(routed, refs, at, CHUNK_ROWS, chunk, SHELF_CHUNKS).applyInArrow(run, schema)

    def _blocked_knn(self, queries, kernel, fields, k, id, vec, skip_self) -> DataFrame:
        by = self.by
        home = self._locate(self._queries(queries, id, vec, ()), k).withColumn("_salt", F.lit(0).cast("bigint"))
        probe = blocks.nearest(k, skip_self)
        kept = [*by, "q_id", "_qvec", "_theta"]
        schema = home.select(*kept).schema

        def bound(left, right):
            out = left.select(kept)
            if left.num_rows and right.num_rows:
                ids, mat, _ = _unpack(left, "q_id", "_qvec", ())
                rid, rmat, _ = _unpack(right, "_rid", "_rvec", ())
                positions, found = probe(ids, mat, {}, rid, rmat, {})
                theta = out.column("_theta").to_numpy().copy()
                full = found["rank"] == k
                theta[positions[full]] = np.minimum(theta[positions[full]], found["dist"][full])
                out = out.set_column(out.schema.get_field_index("_theta"), "_theta", pa.array(theta))
            return out

        # used by both the block loads and the meeting itself
        bounded = settle(self._pair(home, self.blocked, self.keys, CHUNK_ROWS, CHUNK_ROWS, 1).applyInArrow(bound, schema))
        partial = self._meet(self._route(bounded), kernel, fields, (), best=k)
        order = Window.partitionBy(*by, "q_id").orderBy("dist", "nbr_id")
        return partial.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)

    @staticmethod
    def _join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
        """Inner join on null-safe equality, keeping the left key columns."""
        renamed = right.select(*[F.col(c).alias(f"_j_{c}") if c in on else F.col(c) for c in right.columns])
        match = F.lit(True)
        for c in on:
            match = match & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
        return left.join(renamed, match).drop(*[f"_j_{c}" for c in on])
