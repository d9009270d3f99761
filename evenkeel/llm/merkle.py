"""Merkle manifest of a dataset: one tree a key (a language, say) over its rows, and one tree over the roots of the keys.

A row's leaf is the SHA-256 of its named fields. Within a key, leaves ascend by id; while a key has several nodes, every ``fan`` consecutive
ones (the last run may be shorter, even one) become the digest of their joined digests. The roots of the keys, ordered by key, give the root likewise.

Checkpoint and recompute: only every ``every``-th level is written. An aligned subtree is the fan ** every stored nodes (fewer at the end) under one
node of the next stored level; it is the unit of work, goes to one task and is bounded by construction. A proof is extracted from the top down: each subtree gets one
header row with the path of its own root, computes its missing interior nodes again from its stored nodes, appends their siblings to the path of every node, and
forgets them. Only digests move; the texts are read once. Places within a key come from sampled ranges and an offset table, so a key with most of the rows is no task of its own.

Defined results: a null field is ``-``; a null key is a tree of its own, before all others; keys are compared as text, by their UTF-8 bytes; null ids come first in their key; rows that repeat an
id are leaves of their own, in order of their digests; equal rows are equal leaves with paths of their own; a lone leaf is the root of its key and a lone key's root is the root, each with nothing to prove; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.runtime import settle
from evenkeel.operators.scan import range_buckets, running_sums

FAN = 8
EVERY = 4  # levels from one stored level to the next: subtrees of 4,096 nodes
EMIT = 512  # paths of one Arrow batch, at most

PATH = "array<struct<before: string, after: string>>"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def leaf(fields: dict[str, Column] | Sequence[str]) -> Column:
    """Lowercase hex SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    columns = fields.values() if isinstance(fields, dict) else map(F.col, fields)
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf's level up, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))), 256)


def _hash(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _climb(nodes: list[str], whole: bool, every: int, fan: int) -> list[list[str]]:
    """All levels of an aligned subtree, the stored one first. ``whole``: it is all that its key has, so it ends at one node."""
    levels = [nodes]
    for _ in range(every):
        low = levels[-1]
        if whole and len(low) == 1:
            break
        levels.append([_hash(low[i:i + fan]) for i in range(0, len(low), fan)])
    return levels


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block) regrouped to one batch a subtree, wherever Arrow batches end."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, blocks = batch.column("key"), batch.column("block").to_numpy(zero_copy_only=False)
        codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            here = (keys[low].as_py(), blocks[low])
            if kept and here != last:
                yield pa.concat_batches(kept)
                kept = []
            kept.append(batch.slice(low, high - low))
            last = here
    if kept:
        yield pa.concat_batches(kept)


def _blocked(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / span).cast("long"))


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with their place ``pos`` (from 0) in their key and the key's count ``n``."""
    ranged = range_buckets(rows, ["key", *order])
    placed = running_sums(ranged, ["key"], list(order), F.col("_range"), {"place": F.lit(1).cast("long")})
    return placed.drop("_range").withColumn("pos", F.col("place") - 1).withColumnRenamed("place_total", "n").drop("place")


@dataclass
class Forest:
    """The stored levels of one tree a key: ``tiers[0]`` are the leaves, ``tiers[-1]`` has one root a key."""

    tiers: list[DataFrame]  # (key, pos, n, digest; leaves also row): n nodes of the key on that level
    every: int
    fan: int

    @property
    def roots(self) -> DataFrame:
        return self.tiers[-1].select("key", "digest")

    def paths(self, above: DataFrame) -> DataFrame:
        """(digest, row, path, carry) of every leaf, from the paths of the roots of the keys: ``above`` is (key, path, carry)."""
        every, fan = self.every, self.fan
        kind = dict(above.dtypes)["carry"]
        path = above.select("key", F.lit(0).cast("long").alias("pos"), "path", "carry")
        for depth, tier in enumerate(reversed(self.tiers[:-1]), 2):
            leaves = depth == len(self.tiers)
            row = dict(tier.dtypes)["row"] if leaves else "int"
            headers = path.select("key", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"),
                                  F.lit(None).cast(row).alias("row"), "path", "carry")
            nodes = _blocked(tier, fan ** every).select("key", "block", "pos", "n", "digest", (F.col("row") if leaves else F.lit(None).cast("int")).alias("row"),
                                                        F.lit(None).cast(PATH).alias("path"), F.lit(None).cast(kind).alias("carry"))
            both = headers.unionAll(nodes).repartition("key", "block").sortWithinPartitions("key", "block", "pos")

            def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for tree in _subtrees(batches):
                    own = tree.slice(1)
                    levels = _climb(own.column("digest").to_pylist(), own.column("n")[0].as_py() <= fan ** every, every, fan)
                    up = tree.column("path")[0].as_py()
                    befores, afters = [], []  # by level, of each node
                    for level in levels[:-1]:
                        runs = [level[i - i % fan:i - i % fan + fan] for i in range(len(level))]
                        befores.append(["".join(run[:i % fan]) for i, run in enumerate(runs)])
                        afters.append(["".join(run[i % fan + 1:]) for i, run in enumerate(runs)])
                    tops = [[s["before"] for s in up], [s["after"] for s in up]]
                    long = len(befores) + len(up)
                    for low in range(0, own.num_rows, EMIT):
                        part = own.slice(low, EMIT)
                        some = range(low, low + part.num_rows)
                        flat = [[x for i in some for x in [*(level[i // fan ** j] for j, level in enumerate(side)), *top]] for side, top in zip((befores, afters), tops)]
                        steps = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in flat], fields=list(_STEP))
                        found = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * long, pa.int32()), steps)
                        carry = tree.column("carry").take(pa.array(np.zeros(part.num_rows, np.int64)))
                        yield pa.RecordBatch.from_arrays([*map(part.column, ("key", "pos", "digest", "row")), found, carry], names=["key", "pos", "digest", "row", "path", "carry"])

            path = both.mapInArrow(descend, f"key string, pos long, digest string, row {row}, path {PATH}, carry {kind}")
            if not leaves:
                path = settle(path.select("key", "pos", "path", "carry"))
        if len(self.tiers) == 1:  # lone leaves only
            path = path.join(self.tiers[0].select(F.col("key").alias("own"), "digest", "row"), F.col("key").eqNullSafe(F.col("own")))
        return path.select("digest", "row", "path", "carry")


def forest(rows: DataFrame, order: Sequence[str], every: int = EVERY, fan: int = FAN) -> Forest:
    """The trees over ``rows`` (key, digest, row and the columns of ``order``), each key's leaves in that order."""
    tiers = [settle(_numbered(rows, order).select("key", "pos", "n", "digest", "row"))]
    most = tiers[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        nodes = _blocked(tiers[-1], fan ** every).select("key", "block", "pos", "n", "digest").repartition("key", "block").sortWithinPartitions("key", "block", "pos")

        def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tree in _subtrees(batches):
                n = tree.column("n")[0].as_py()
                root = _climb(tree.column("digest").to_pylist(), n <= fan ** every, every, fan)[-1][0]
                yield pa.RecordBatch.from_arrays([
                    tree.column("key").slice(0, 1), tree.column("block").slice(0, 1), pa.array([-(-n // fan ** every)], pa.int64()), pa.array([root])], names=["key", "pos", "n", "digest"])

        tiers.append(settle(nodes.mapInArrow(climb, "key string, pos long, n long, digest string")))
        most = -(-most // fan ** every)
    return Forest(tiers, every, fan)


@dataclass
class Manifest:
    """The trees of the keys and the tree over their roots."""

    trees: Forest
    top: Forest

    @property
    def root(self) -> DataFrame:
        """(digest): one row, none for an empty table."""
        return self.top.roots.select("digest")

    @property
    def subroots(self) -> DataFrame:
        """(key, digest)."""
        return self.trees.roots

    def proofs(self) -> DataFrame:
        """(row, leaf, subroot, root, path) for every row: ``fold(leaf, path)`` is the root."""
        start = self.top.roots.select("key", F.array().cast(PATH).alias("path"), F.col("digest").alias("carry"))
        keys = settle(self.top.paths(start).select("row.key", "path", F.struct(F.col("digest").alias("subroot"), F.col("carry").alias("root")).alias("carry")))
        return self.trees.paths(keys).select("row", F.col("digest").alias("leaf"), "carry.subroot", "carry.root", "path")


def manifest(rows: DataFrame, id: str, key: str, digest: Column, carry: dict[str, Column] | None = None, every: int = EVERY, fan: int = FAN) -> Manifest:
    """The manifest of ``rows``: ``digest`` is a row's leaf, as ``leaf`` makes it; the proofs' ``row`` has the id and what ``carry`` names."""
    more = [c.alias(name) for name, c in (carry or {}).items()]
    leaves = settle(rows.select(F.col(key).cast("string").alias("key"), F.col(id).alias("id"), digest.alias("digest"), F.struct(F.col(id).alias("id"), *more).alias("row")))
    trees = forest(leaves, ["id", "digest"], every, fan)
    roots = trees.roots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest", F.struct("key").alias("row"))
    return Manifest(trees, forest(roots, ["name"], every, fan))
