"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors are rotated by a fixed random orthogonal matrix and split into blocks of SUB components. Cosine >= c means a squared
distance of at most 2 - 2c, so in some block the squared distance is within that block's share of it, in proportion to its
components. Each block is range-joined on a grid with cells CELL radii wide: a vector is at home in its cell and visits each
neighbouring cell (of smaller key) that its radius reaches. A pair that meets is taken up by the first block whose budget it keeps, so the union of the
candidates holds it once, and is verified by its cosine in double precision. Rows of different labels never share a cell.

Scale: equal vectors are one point with a weight. A crowded cell is dealt to several tasks by hash, its visitors go to each; a task holds at most about BLOCK
homes, streams visitors past them, and sends on link counts per vector and a forest of the links, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or id, link with nothing
(a component of their own); rows that repeat an id and its vector are one vector and each get its result; an id with several vectors has a result for
each of them, in rows of their own; vectors of different lengths never link; labels may be of any type that can be compared, those other than whole numbers are told
apart by 64 bits; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.components import Forest, components
from evenkeel.llm.text import mix
from evenkeel.llm.topk import vectors
from evenkeel.operators.runtime import settle, width

COSINE = 0.98
SUB = 8  # components of a block
CELL = 6.0  # width of a grid cell in radii: wider cells mean fewer visits and more pairs
BLOCK = 1024  # vectors of a cell that one task compares with its visitors
SLACK = 1e-5  # relative, on squared distances of the rotated vectors, which are kept in single precision


@cache
def _rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(42).standard_normal((dim, dim)))[0]


def _budgets(dim: int, cosine: float) -> list[tuple[slice, float]]:
    """Blocks and the squared distance that each may spend."""
    whole = (2 - 2 * cosine) * (1 + SLACK) + 1e-9
    return [(slice(a, min(a + SUB, dim)), whole * (min(a + SUB, dim) - a) / dim) for a in range(0, dim, SUB)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of every vector that can link; null for the others."""
    for batch in batches:
        _, found = vectors(batch.column("vec"))
        keys = [hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if x is not None and x.any() else None for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(keys, pa.binary()), batch.column("vec")], names=["id", "label", "key", "vec"])


def _grid(cosine: float):
    """Each vector in its home cell of every block, and in the cells it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                yield from cells(batch.slice(low, 1024))

    def cells(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = vectors(batch.column("vec"))[1]
        sizes = np.array([len(x) for x in found])
        label = batch.column("label").to_numpy().astype(np.int64).view(np.uint64)
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            x = np.stack([found[i] for i in rows])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            turned = (x / np.linalg.norm(x, axis=1, keepdims=True) @ _rotation(dim)).astype(np.float32)
            for number, (cut, budget) in enumerate(_budgets(dim, cosine)):
                wide = CELL * budget ** 0.5
                place = turned[:, cut].astype(np.float64) / wide
                cell = np.floor(place).astype(np.int64)
                down, up = ((place - cell) * wide) ** 2, ((1 - (place - cell)) * wide) ** 2
                odd = np.random.default_rng(number).integers(1, 1 << 62, cell.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                back = ~odd + np.uint64(1)
                sums = (cell.astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64) + mix(label[rows] + np.uint64(dim)) + np.uint64(number)
                who, spent, key = np.arange(len(rows)), np.zeros(len(rows)), sums
                for d in range(cell.shape[1]):
                    more = [(who, spent, key)]
                    for price, move in ((down[:, d], back[d]), (up[:, d], odd[d])):
                        fits = spent + price[who] <= budget
                        more.append((who[fits], spent[fits] + price[who[fits]], key[fits] + move))
                    who, spent, key = (np.concatenate(c) for c in zip(*more))
                key, own = mix(key), mix(sums)
                goes = (key <= own[who])
                who, key = who[goes], key[goes]
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(key == own[who]), pa.array(np.full(len(who), number), pa.int32()),
                    *[batch.column(c).take(pa.array(rows[who])) for c in ("id", "n", "vec")],
                    pa.array(list(turned[who]), pa.list_(pa.float32()))], names=["cell", "home", "part", "id", "n", "vec", "turned"])

    return run


def _meet(cosine: float):
    """Rows sorted by cell and block, homes first: verify the pairs that this block of components takes up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, counts, open_cell = Forest(), {}, [None, None]

        def compare(a, b, part: int, inside: bool) -> None:
            budgets = _budgets(a["unit"].shape[1], cosine)
            for low in range(0, len(b["id"]), 256):
                high = low + 256
                near = distance(a["turned"][:, None], b["turned"][None, low:high], budgets[part])
                i, j = np.nonzero(near)
                j += low
                keep = a["id"][i] != b["id"][j]
                if inside:
                    keep &= a["id"][i] < b["id"][j]
                i, j = i[keep], j[keep]
                for at in range(0, len(i), 1 << 15):
                    x, y = i[at:at + (1 << 15)], j[at:at + (1 << 15)]
                    for earlier in range(part):
                        if len(x):
                            first = ~distance(a["turned"][x], b["turned"][y], budgets[earlier])
                            x, y = x[first], y[first]
                    linked = np.einsum("ij,ij->i", a["unit"][x], b["unit"][y]) >= cosine
                    x, y = x[linked], y[linked]
                    for ids, other, n in ((a["id"][x], y, b["n"]), (b["id"][y], x, a["n"])):
                        for one, more in zip(*_sums(ids, n[other])):
                            counts[one] = counts.get(one, 0) + more
                    forest.add(a["id"][x], b["id"][y])

        for batch in batches:
            cell, block = batch.column("cell").to_numpy(), batch.column("block").to_numpy()
            home = batch.column("home").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1
            for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)]):
                if low == high:
                    continue
                if (key := (int(cell[low]), int(block[low]))) != open_cell[0]:
                    open_cell[0], open_cell[1] = key, None
                for at in range(low, high, 4096):
                    rows = batch.slice(at, min(4096, high - at))
                    x = rows.column("vec").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
                    new = {"id": rows.column("id").to_numpy(), "n": rows.column("n").to_numpy(),
                           "turned": rows.column("turned").flatten().to_numpy().reshape(rows.num_rows, -1), "unit": _unit(x)}
                    part, own = rows.column("part")[0].as_py(), home[at:at + rows.num_rows]
                    inner, guest = ({k: v[m] for k, v in new.items()} for m in (own, ~own))
                    if len(inner["id"]):
                        if open_cell[1] is not None:
                            compare(open_cell[1], inner, part, False)
                        compare(inner, inner, part, True)
                        open_cell[1] = inner if open_cell[1] is None else {k: np.concatenate([open_cell[1][k], inner[k]]) for k in inner}
                    if len(guest["id"]) and open_cell[1] is not None:
                        compare(open_cell[1], guest, part, False)
        a, b = zip(*forest.links) if forest.links else ((), ())
        yield pa.RecordBatch.from_arrays([
            pa.array([*counts, *a], pa.int64()), pa.array([None] * len(counts) + [*b], pa.int64()),
            pa.array([*counts.values(), *[0] * len(a)], pa.int64())], names=["a", "b", "links"])

    def distance(a: np.ndarray, b: np.ndarray, budget: tuple[slice, float]) -> np.ndarray:
        """Within the block's budget? Sums run in a fixed order, so every task decides alike."""
        cut, most = budget
        total = np.float32(0)
        for d in range(cut.start, cut.stop):
            total = total + (a[..., d] - b[..., d]) ** 2
        return total <= most

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _sums(ids: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    own, at = np.unique(ids, return_inverse=True)
    return own.tolist(), np.bincount(at, values, len(own)).astype(np.int64).tolist()


def _label(rows: DataFrame, label: str) -> Column:
    """The label as a whole number: itself, or a hash in which 0.0 and -0.0 are equal; null for a null."""
    kind = rows.schema[label].dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return F.col(label).cast("long")
    own = F.col(label) + F.lit(0.0).cast(kind) if isinstance(kind, T.FractionalType) else F.col(label)
    return F.when(F.col(label).isNotNull(), F.xxhash64(own))


def near_duplicates(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component) for every row."""
    parts = width(rows.sparkSession)
    source = rows.select(F.col(id).cast("long").alias("id"), _label(rows, label).alias("label"), F.col(vector).alias("vec"))
    kind = source.schema["vec"].dataType.simpleString()
    keyed = settle(source.mapInArrow(_keys, f"id long, label long, key binary, vec {kind}"))
    able = keyed.where("key IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL")
    members = able.select("label", "key", "id").distinct()
    copies = members.groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    points = able.join(copies, ["label", "key"]).where("id = rep").dropDuplicates(["label", "key"])
    points = settle(points.select("label", "key", "rep", "n", "vec", F.monotonically_increasing_id().alias("id")))  # a point is a vector: an id may have several
    cells = points.select("label", "id", "n", "vec").repartition(parts, "id").mapInArrow(
        _grid(cosine), f"cell long, home boolean, part int, id long, n long, vec {kind}, turned array<float>")
    crowded = settle(cells.where("home").groupBy("cell").count().where(F.col("count") > BLOCK).select(
        "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = cells.join(crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cols = ["cell", "part", "id", "n", "vec", "turned"]
    stay = dealt.where("home").select(*cols, own.alias("block"), F.lit(True).alias("home"))
    go = dealt.withColumn("last", F.when(F.col("home"), own - 1).otherwise(F.col("blocks") - 1)).where("last >= 0").select(
        *cols, F.explode(F.sequence(F.lit(0), "last")).alias("block"), F.lit(False).alias("home"))
    met = stay.unionByName(go).repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", F.desc("home"))
    found = settle(met.mapInArrow(_meet(cosine), "a long, b long, links long"))
    joined = settle(components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "id"))
    least = joined.join(points.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("first"))
    joined = joined.join(least, "component").select("id", "first")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    about = settle(points.select("label", "key", "id", "rep", "n").join(counts, "id", "left").join(joined, "id", "left").select(
        "label", "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("first", "rep").alias("component")))
    return keyed.select("id", "label", "key").join(about, ["label", "key"], "left").select(
        "id", F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
