"""SimHash near-dedup: segment-popcount embedding and a grid range-join.

A fingerprint bit is 1 if over half the XXH64 values (seed 42) of a text's shingles have it; repeats count. Its 64 bits are cut into
SEGMENTS segments, and a fingerprint becomes the vector of their bit counts. The Manhattan distance of two such vectors
never exceeds the number of differing bits, so fingerprints to be linked lie in grid cells whose distance is at
most ``bits``. The grid cuts every count once (``cuts``): a fingerprint is at home in its cell and visits each smaller cell that is near
enough; the pairs that meet are verified on all bits. ``cuts=(2, 3)`` gives a finer grid (more visits, fewer pairs) for
very many fingerprints; any grid finds every link.

Scale: only distinct fingerprints take part, so a hot group of copies is one point. A cell with more than BLOCK of them is dealt to several
tasks by hash, its visitors go to each. A task holds one block, streams visitors past it and keeps of the links only a
forest, so a dense group never becomes all pairs; components are found by contraction.

Defined results: texts without words have fingerprint zero and link like any other; null texts count as empty; rows
with a null id get a fingerprint and no component; repeated ids share one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.components import Forest, components
from evenkeel.llm.text import texts
from evenkeel.operators.runtime import settle, width

SHINGLE, BITS = 3, 3  # words of a shingle; differing bits of a link
SEGMENTS = 16
CUTS = (2,)  # a count of 0..4 set bits lies below or above each cut
BLOCK = 2048  # fingerprints of a cell that one task compares with its visitors

_PRINTS = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
_VISITS = pa.schema([("cell", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Of one text in UTF-8."""
    words = raw.lower().split()  # bytes: A-Z only, and the word separators of the contract
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.append(0, ends[:n - 1] + 1)
    ends = ends[len(words) - n:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for low in range(0, n, 255):  # a byte counts to 255
        bits = np.unpackbits(hashes[low:low + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _prints(shingle: int, carry: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(raw, shingle) for raw in texts(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64)), *map(batch.column, carry)], names=[*_PRINTS.names, *carry])

    return run


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_prints(shingle), "id long, fp long")


def _counts(fp: np.ndarray) -> np.ndarray:
    """Set bits of each segment."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fp), SEGMENTS, 64 // SEGMENTS).sum(axis=2)


def _grid(bits: int, cuts: tuple[int, ...]):
    """The home cell of each fingerprint and the smaller cells within ``bits`` of it."""
    levels = len(cuts) + 1
    weight = np.array([levels ** i for i in range(SEGMENTS)], np.int64)
    bounds = (0, *cuts, 64 // SEGMENTS + 1)
    moves = [list(zip(dims, shift)) for k in range(1, min(bits, SEGMENTS) + 1) for dims in combinations(range(SEGMENTS), k)
             for shift in product(range(1, levels), repeat=k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for low in range(0, len(fps), 4096):
                fp = fps[low:low + 4096]
                counts = _counts(fp).astype(np.int64)
                level = np.searchsorted(cuts, counts, side="right")
                home = level @ weight
                yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(fp), pa.array(np.ones(len(fp), bool))], schema=_VISITS)
                # moving a count to the s-th other level costs at least the way to that level's nearest bound
                cost, gain = np.full((levels, len(fp), SEGMENTS), 99, np.int8), np.zeros((levels, len(fp), SEGMENTS), np.int64)
                for s in range(1, levels):
                    to = (level + s) % levels
                    least, most = np.array(bounds)[to], np.array(bounds)[to + 1] - 1
                    cost[s] = np.maximum(0, np.maximum(least - counts, counts - most))
                    gain[s] = (to - level) * weight
                cells, who = [], []
                for move in moves:
                    price, shift = (sum(x[s][:, d] for d, s in move) for x in (cost, gain))
                    fits = np.flatnonzero((price <= bits) & (shift < 0))
                    cells.append((home[fits] + shift[fits]))
                    who.append(fits)
                cells, who = np.concatenate(cells), np.concatenate(who)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(fp[who]), pa.array(np.zeros(len(who), bool))], schema=_VISITS)

    return run


def _meet(bits: int):
    """Rows sorted by cell and block, homes first: compare each block's homes with each other and with its visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, open_cell, homes = Forest(), None, np.zeros(0, np.uint64)

        def links(a: np.ndarray, b: np.ndarray, inside: bool) -> None:
            for low in range(0, len(b), 1024):
                part = b[low:low + 1024]
                near = np.bitwise_count(a[:, None] ^ part[None, :]) <= bits
                i, j = np.nonzero(near)
                x, y = a[i], part[j]
                if inside:
                    x, y = x[x < y], y[x < y]
                forest.add(x.view(np.int64), y.view(np.int64))

        for batch in batches:
            cell, block, fp = (batch.column(c).to_numpy() for c in ("cell", "block", "fp"))
            home, fp = batch.column("home").to_numpy(zero_copy_only=False), fp.view(np.uint64)
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1
            for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)]):
                if low == high:
                    continue
                if (key := (int(cell[low]), int(block[low]))) != open_cell:
                    open_cell, homes = key, np.zeros(0, np.uint64)
                new, guests = fp[low:high][home[low:high]], fp[low:high][~home[low:high]]
                if len(new):
                    links(homes, new, False)
                    links(new, new, True)
                    homes = np.concatenate([homes, new])
                if len(homes) and len(guests):
                    links(homes, guests, False)
        if forest.links:
            a, b = zip(*forest.links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(prints: DataFrame, bits: int = BITS, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp``, as many as it takes to join what is linked."""
    parts = width(prints.sparkSession)
    visits = prints.select("fp").repartition(parts, "fp").mapInArrow(_grid(bits, cuts), "cell long, fp long, home boolean")
    crowded = settle(visits.where("home").groupBy("cell").count().where(F.col("count") > BLOCK).select(
        "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = visits.join(crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a home also visits the blocks of its cell before its own; a visitor visits all
    stay = dealt.where("home").select("cell", "fp", own.alias("block"), F.lit(True).alias("home"))
    go = dealt.withColumn("last", F.when(F.col("home"), own - 1).otherwise(F.col("blocks") - 1)).where("last >= 0").select(
        "cell", "fp", F.explode(F.sequence(F.lit(0), "last")).alias("block"), F.lit(False).alias("home"))
    met = stay.unionByName(go).repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", F.desc("home"))
    return met.mapInArrow(_meet(bits), "a long, b long")


def keepers(docs: DataFrame, key: str, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(key, kept) for every row: its ``key`` and that of the row its group keeps: of the smallest id, null ids last, and then the smallest key."""
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.col(key).alias("key"))
    prints = settle(source.mapInArrow(_prints(shingle, ("key",)), f"id long, fp long, key {dict(source.dtypes)['key']}"))
    points = settle(prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first")))
    linked = components(links(points, bits, cuts)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = points.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("kept"))
    of_point = settle(named.select("fp", "root").join(least, "root").select("fp", F.col("kept.key").alias("kept")))
    return prints.join(of_point, "fp").select("key", "kept")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(id, fp, component): the component is the smallest id reachable over links of at most ``bits`` differing bits."""
    prints = settle(fingerprints(docs, id, text, shingle))
    points = settle(prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("first")))
    joined = components(links(points, bits, cuts))
    linked = joined.select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = points.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    of_point = settle(named.select("fp", "root").join(least, "root").select("fp", "component"))
    return prints.join(of_point, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
