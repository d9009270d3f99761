"""Random forests and decision trees for all groups of a frame together, grown level by level until nodes are pure.

Features become codes: up to ``bins`` - 1 cuts a feature, midways between neighbouring values of a group, or between its quantiles where there are more values. Cuts come from at most CUT_ROWS rows of a group
(those with the smallest hashes of their ids); all counts see every row. Bootstrap weights are Poisson(1) draws from (seed, tree, row id) and a node's order of features is drawn from its
path, so a forest does not depend on partitions or on where a node was grown:

* a group of at most LOCAL rows is sent once for every TREES trees, which one task grows whole;
* a larger group starts level by level: one aggregate over (group, tree, node, feature, bin) a level, tasks sending one histogram a node and feature, HIST_BYTES of them at a time,
  and best cuts are found where the sums are; only cuts and class counts of nodes above LOCAL rows reach the driver;
* a node of at most LOCAL rows is gathered and grown in one task to its end.

A split is the best Gini gain over the next ``mtry`` features of the node's order that offer one; leaves give shares of classes, a forest their mean over trees. Depth is
unlimited unless asked for. Trained subtrees are rows of a written table. They travel to the rows to be scored if they have MODEL_BYTES at most, otherwise rows travel to the subtrees,
dealt by id so that no subtree meets all of them in one task.

Defined results: a group without rows for training predicts nothing; a group of one class gives that class; repeated rows count each; a tree whose draws are all zero takes every row once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import blocks
from evenkeel.functions.vectors import sum_vector
from evenkeel.operators.kernels import equi
from evenkeel.operators.runtime import settle, width

LOCAL = 1 << 16  # rows of a node that one task grows
LOCAL_BYTES = 32 << 20  # of their codes
CUT_ROWS = 1 << 14  # rows of a group that its cuts are taken from
TREES = 10  # trees of a small group that one task grows
TASKS = 1 << 10  # that lots of trees are dealt to, at most, or the session's width
HIST_BYTES = 64 << 20  # of histograms that a task holds
TABLE_BYTES = 32 << 20  # of cuts that travel with one job
MODEL_BYTES = 64 << 20  # of subtrees that travel to the rows
SCORED = 1 << 17  # rows that one subtree scores in one task, about, when rows travel
BINS = 256
COUNTED = 64  # rows a node from which on a task counts the codes of its nodes instead of sorting them

_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])
_U = np.uint64


def _mix(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _root(seed: int, tree: int) -> int:
    return int(_mix(np.array([(seed * 1_000_003 + tree + 1) % (1 << 64)], _U))[0])


def _child(key: int, side: int) -> int:
    return int(_mix(np.array([(2 * key + 1 + side) % (1 << 64)], _U))[0])


def draws(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Times that a tree takes each row."""
    mixed = _mix(_mix(ids.astype(np.int64).view(_U)) ^ _U(_root(seed, tree)))
    return np.searchsorted(_POISSON, (mixed >> _U(11)).astype(np.float64) / (1 << 53), side="right").astype(np.float64)


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """At most bins - 1 cuts of each column, midways between neighbours."""
    out = []
    for column in x.T:
        values, counts = np.unique(column, return_counts=True)
        middle = values[:-1] / 2 + values[1:] / 2
        if len(middle) > bins - 1:
            upto = np.cumsum(counts)[:-1]
            middle = middle[np.unique(np.searchsorted(upto, np.arange(1, bins) * len(column) / bins).clip(max=len(middle) - 1))]
        out.append(middle)
    return out


def encode(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """A value's code is the number of cuts below it."""
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def best_cut(hist: np.ndarray) -> tuple[float, int, int]:
    """(score, feature, code) of the best cut over histograms (feature, code, class): rows with codes up to it go left; the score is -inf where nothing parts them."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    right = left[:, -1:] + hist[:, -1:] - left
    low, high = left.sum(axis=2), right.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((low > 0) & (high > 0), (left * left).sum(axis=2) / low + (right * right).sum(axis=2) / high, -np.inf)
    best = int(score.argmax())
    return float(score.flat[best]), best // score.shape[1], best % score.shape[1]


@dataclass
class Tree:
    """Nodes in lists; a row with code[feature] <= cut goes left. ``feature`` is -1 at leaves."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def add(self, counts: np.ndarray) -> int:
        for name, x in (("feature", -1), ("cut", 0), ("left", -1), ("right", -1), ("value", counts)):
            getattr(self, name).append(x)
        return len(self.feature) - 1


def _ordered(node: np.ndarray, code: np.ndarray, nodes: int) -> np.ndarray:
    """Positions by node and code, both small numbers, which sort by counting."""
    first = np.argsort(code, kind="stable")
    return first[np.argsort(node[first].astype(np.uint16 if nodes <= 1 << 16 else np.int64), kind="stable")]


def _cuts(codes: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, some: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_cut`` of many nodes: (score, feature, code) of each over its features ``some``. A row is in ``node``, ``totals`` are the nodes' class counts.
    Nodes with many rows are counted by code, those with few are sorted."""
    nodes, classes = totals.shape
    best, feature, cut = np.full(nodes, -np.inf), np.full(nodes, -1), np.zeros(nodes, np.int64)
    lines, every = np.arange(len(node)), np.arange(nodes)
    parts = [np.where(y == c, w, 0.0) for c in range(classes)]
    counted = len(node) >= COUNTED * nodes
    base = node * (BINS * classes) + y if counted else None
    for j in range(some.shape[1]):
        own = codes[lines, some[node, j]]
        if counted:
            hist = np.bincount(base + own.astype(np.int64) * classes, weights=w, minlength=nodes * BINS * classes).reshape(nodes, BINS, classes)
            left = np.cumsum(hist, axis=1)[:, :-1]
            gain, lows, highs = [0.0, 0.0], 0.0, 0.0
            for c in range(classes):
                low, high = left[:, :, c], totals[:, c, None] - left[:, :, c]
                lows, highs = lows + low, highs + high
                gain = [gain[0] + low * low, gain[1] + high * high]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where((lows > 0) & (highs > 0), gain[0] / lows + gain[1] / highs, -np.inf)
            code = score.argmax(axis=1)
            top = score[every, code]
            better = top > best
            best[better], feature[better], cut[better] = top[better], some[better, j], code[better]
            continue
        order = _ordered(node, own, nodes)
        at, own = node[order], own[order]
        # the last row of every code of a node; the last code of a node parts nothing
        last = np.flatnonzero((at[1:] == at[:-1]) & (own[1:] != own[:-1]))
        if not len(last):
            continue
        ends, owner = np.append(last, len(at) - 1), at[last]
        begin = np.searchsorted(at, owner)
        gain, lows, highs = [0.0, 0.0], 0.0, 0.0
        for c in range(classes):
            upto = np.append(0.0, np.cumsum(parts[c][order]))
            left = upto[last + 1] - upto[begin]
            right = totals[owner, c] - left
            lows, highs = lows + left, highs + right
            gain = [gain[0] + left * left, gain[1] + right * right]
        score = gain[0] / lows + gain[1] / highs
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        top = np.maximum.reduceat(score, starts)
        hits = np.flatnonzero(score == np.repeat(top, np.diff(np.append(starts, len(score)))))
        hits = hits[np.append(True, owner[hits][1:] != owner[hits][:-1])]  # the first of equal ones
        better = hits[score[hits] > best[owner[hits]]]
        mine = owner[better]
        best[mine], feature[mine], cut[mine] = score[better], some[mine, j], own[ends[better]]
    return best, feature, cut


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, key: int, level: int, depth: int | None, mtry: int, classes: int) -> Tree:
    """The subtree below a node of given rows, all nodes of a level at a time."""
    tree, dim = Tree(), codes.shape[1]
    rows = np.flatnonzero(w)
    codes, y, w = codes[rows], y[rows], w[rows]
    node, keys, ids = np.zeros(len(rows), np.int64), np.array([key], _U), np.array([tree.add(np.bincount(y, weights=w, minlength=classes))])
    while len(ids):
        counts = np.bincount(node * classes + y, weights=w, minlength=len(ids) * classes).reshape(-1, classes)
        alive = (counts > 0).sum(axis=1) >= 2
        if level == depth or not alive.any():
            break
        place = np.cumsum(alive) - 1
        stay = alive[node]
        codes, y, w, node = codes[stay], y[stay], w[stay], place[node[stay]]
        counts, keys, ids = counts[alive], keys[alive], ids[alive]
        order = np.array([np.random.default_rng(int(k)).permutation(dim) for k in keys])
        feature, cut, todo = np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, dim, mtry):
            again = np.full(len(ids), -1)
            again[todo] = np.arange(len(todo))
            own = np.flatnonzero(again[node] >= 0) if len(todo) < len(ids) else slice(None)
            score, f, c = _cuts(codes[own], y[own], w[own], again[node[own]], order[todo, at:at + mtry], counts[todo])
            found = score > -np.inf
            feature[todo[found]], cut[todo[found]] = f[found], c[found]
            todo = todo[~found]
            if not len(todo):
                break
        # children are numbered in pairs, the left one first
        split = np.flatnonzero(feature >= 0)
        stay = feature[node] >= 0
        codes, y, w, node = codes[stay], y[stay], w[stay], node[stay]
        side = codes[np.arange(len(node)), feature[node]] > cut[node]
        place = np.full(len(ids), -1)
        place[split] = 2 * np.arange(len(split))
        node = place[node] + side
        sums = np.bincount(node * classes + y, weights=w, minlength=2 * len(split) * classes).reshape(-1, classes)
        made = np.array([tree.add(v) for v in sums], np.int64)
        for me, f, c, low, high in zip(ids[split].tolist(), feature[split].tolist(), cut[split].tolist(), made[::2].tolist(), made[1::2].tolist()):
            tree.feature[me], tree.cut[me], tree.left[me], tree.right[me] = f, c, low, high
        with np.errstate(over="ignore"):
            keys = _mix(_U(2) * np.repeat(keys[split], 2) + _U(1) + np.tile(np.array([0, 1], _U), len(split)))
        ids, level = made, level + 1
    return tree


def route(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The leaf of every row; ``cut`` and ``x`` are both codes or both values."""
    node = np.zeros(len(x), np.int64)
    going = np.flatnonzero(feature[node] >= 0)
    while len(going):
        at = node[going]
        node[going] = np.where(x[going, feature[at]] <= cut[at], left[at], right[at])
        going = going[feature[node[going]] >= 0]
    return node


class Top:
    """The levels of one tree that are grown by aggregates."""

    def __init__(self, counts: np.ndarray, seed: int, tree: int):
        self.tree = Tree()
        self.tree.add(counts)
        self.key, self.level = [_root(seed, tree)], [0]
        self.tried = {0: 0}  # open nodes: features of their order seen so far

    def arrays(self):
        return tuple(np.array(getattr(self.tree, n)) for n in ("feature", "cut", "left", "right"))

    def split(self, node: int, feature: int, code: int, sides: Sequence[np.ndarray]) -> list[int]:
        self.tree.feature[node], self.tree.cut[node] = feature, code
        made = [self.tree.add(counts) for counts in sides]
        self.tree.left[node], self.tree.right[node] = made
        self.key += [_child(self.key[node], 0), _child(self.key[node], 1)]
        self.level += [self.level[node] + 1] * 2
        return made


_PACKED = "gid int, tree int, sub int, feature array<int>, cut array<double>, left array<int>, right array<int>, value array<double>"


def _pack(found: list[tuple[int, int, int, Tree]], cuts: list[np.ndarray]) -> pa.Table:
    def values(tree: Tree) -> list[float]:
        return [float(cuts[f][c]) if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]

    ints, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())
    return pa.table({
        **{n: pa.array([f[i] for f in found], pa.int32()) for i, n in enumerate(("gid", "tree", "sub"))}, "feature": pa.array([t.feature for *_, t in found], ints),
        "cut": pa.array([values(t) for *_, t in found], doubles), "left": pa.array([t.left for *_, t in found], ints), "right": pa.array([t.right for *_, t in found], ints),
        "value": pa.array([np.concatenate([v / max(v.sum(), 1e-300) for v in t.value]) for *_, t in found], doubles)})


class Coded:
    """Labelled rows by group with features as codes: what forests and boosting share."""

    def __init__(self, train: DataFrame, by: Sequence[str], seed: int, bins: int):
        """``train`` has by..., row_id, label, features."""
        self.by, self.seed, self.bins = list(by), seed, min(bins, BINS)
        self.spark, self.schema = train.sparkSession, [train.schema[c] for c in by]
        counts = train.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).collect()  # a row a class and group
        self.labels = sorted({r["label"] for r in counts})
        self.dim = max([1, *(r["d"] or 1 for r in counts)])
        self.sizes: dict[int, int] = {}
        self.keys: dict[tuple, int] = {}
        for r in sorted(counts, key=lambda r: [(r[c] is not None, r[c]) for c in by]):
            gid = self.keys.setdefault(tuple(r[c] for c in by), len(self.keys))
            self.sizes[gid] = self.sizes.get(gid, 0) + r["n"]
        codes = F.create_map(*[F.lit(x) for i, label in enumerate(self.labels) for x in (label, i)]) if self.labels else None
        self.rows = settle(self._numbered(train).select(
            "gid", F.col("row_id").cast("long").alias("row_id"), (codes[F.col("label")] if self.labels else F.lit(0)).alias("y"), "features"))
        self.cuts = self._cuts(self.rows)

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """Rows of trained groups with their number."""
        if not self.by:
            return rows.withColumn("gid", F.lit(0))
        return equi(rows, self.spark.createDataFrame([(*k, g) for k, g in self.keys.items()], T.StructType([*self.schema, T.StructField("gid", T.IntegerType())])), self.by)

    def _cuts(self, rows: DataFrame) -> dict[int, list[np.ndarray]]:
        bins = self.bins

        def one(table: pa.Table) -> pa.Table:
            table = table.sort_by([("hash", "ascending"), ("row_id", "ascending")]).slice(0, CUT_ROWS)
            found = cuts_of(blocks.matrix(table.column("features")), bins)
            return pa.table({"gid": table.column("gid").slice(0, 1).cast(pa.int32()), "cuts": pa.array([[c.tolist() for c in found]], pa.list_(pa.list_(pa.float64())))})

        hashed = rows.select("gid", "row_id", "features", F.pmod(F.xxhash64(F.lit(self.seed), "row_id"), F.lit(1 << 30)).alias("hash"))
        large = {g: 1.5 * CUT_ROWS / n for g, n in self.sizes.items() if n > 1.5 * CUT_ROWS}
        if large:
            share = F.create_map(*[F.lit(x) for pair in large.items() for x in pair])
            hashed = hashed.where(F.col("hash") < F.coalesce(share[F.col("gid")], F.lit(1.0)) * float(1 << 30))
        return {r["gid"]: [np.array(c) for c in r["cuts"]] for r in hashed.groupBy("gid").applyInArrow(one, "gid int, cuts array<array<double>>").collect()}

    def _turns(self) -> Iterator[dict[int, list[np.ndarray]]]:
        """The cuts of some groups after another, TABLE_BYTES at a time."""
        some, size = {}, 0
        for gid, cuts in self.cuts.items():
            own = sum(c.nbytes for c in cuts)
            if some and size + own > TABLE_BYTES:
                yield some
                some, size = {}, 0
            some[gid], size = cuts, size + own
        if some:
            yield some

    def _encoded(self, rows: DataFrame) -> DataFrame:
        """(gid, row_id, y, codes), written."""
        out = None
        for turn in self._turns():
            held = self.spark.sparkContext.broadcast(turn)

            def code(batches, held=held):
                for batch in batches:
                    gids, x = batch.column("gid").to_numpy(), blocks.matrix(batch.column("features"))
                    codes = np.zeros(x.shape, np.uint8)
                    for gid in np.unique(gids).tolist():
                        codes[gids == gid] = encode(x[gids == gid], held.value[gid])
                    flat = pa.array(codes.ravel())
                    yield pa.RecordBatch.from_arrays([
                        *map(batch.column, ("gid", "row_id", "y")), pa.array([bytes(c) for c in codes], pa.binary()) if len(flat) else pa.array([], pa.binary())], names=["gid", "row_id", "y", "codes"])

            part = rows.where(F.col("gid").isin(list(turn))).mapInArrow(code, "gid int, row_id long, y int, codes binary")
            out = part if out is None else out.unionAll(part)
        return settle(out)


class Forest(Coded):
    """A trained forest for every group: ``predict`` gives class shares."""

    def __init__(self, train: DataFrame, by: Sequence[str] = (), trees: int = 100, depth: int | None = None, seed: int = 42, mtry: int | None = None, bootstrap: bool = True, bins: int = BINS):
        """``train`` has by..., row_id, label, features. ``mtry`` defaults to the square root of the features; 0 stands for all."""
        super().__init__(train, by, seed, bins)
        self.trees, self.depth, self.bootstrap = trees, depth, bootstrap
        self.mtry = self.dim if mtry == 0 else min(self.dim, mtry or max(1, int(self.dim ** 0.5)))
        self.local = max(1, min(LOCAL, LOCAL_BYTES // (self.dim + 16)))
        self.tops: dict[tuple[int, int], Top] = {}
        self.subtrees = settle(self._grow(self.rows)) if self.sizes else None

    def _grow(self, rows: DataFrame) -> DataFrame:
        coded = self._encoded(rows)
        trees, depth, seed, mtry, bootstrap, classes, dim = self.trees, self.depth, self.seed, self.mtry, self.bootstrap, len(self.labels), self.dim
        large = [g for g, n in self.sizes.items() if n > self.local]
        held = self.spark.sparkContext.broadcast(self.cuts) if sum(c.nbytes for cuts in self.cuts.values() for c in cuts) <= TABLE_BYTES else None
        cuts_table = None if held else self._cuts_table()
        out = None
        if len(large) < len(self.sizes):
            small = coded.where(~F.col("gid").isin(large)) if large else coded
            chunks = small.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // TREES))))

            def whole(table: pa.Table, cuts: list[np.ndarray]) -> pa.Table:
                gid, chunk = table.column("gid")[0].as_py(), table.column("chunk")[0].as_py()
                ids, y, codes = _rows(table, dim)
                found = []
                for tree in range(chunk * TREES, min(trees, (chunk + 1) * TREES)):
                    w = draws(ids, seed, tree) if bootstrap else np.ones(len(ids))
                    w = w if w.any() else np.ones(len(ids))
                    found.append((gid, tree, 0, grow(codes, y, w, _root(seed, tree), 0, depth, mtry, classes)))
                return _pack(found, cuts)

            # a task for every lot of trees: their rows are few bytes, which would be gathered in few tasks
            lots = max(width(self.spark), min(TASKS, (len(self.sizes) - len(large)) * ((trees - 1) // TREES + 1)))
            out = self._with_cuts(chunks.repartition(lots, "gid", "chunk"), ["gid", "chunk"], whole, held, cuts_table)
        if large:
            self._levels(coded.where(F.col("gid").isin(large)), large)
            tops = self.spark.sparkContext.broadcast({k: (top.arrays(), {n: (top.key[n], top.level[n]) for n in top.tried}) for k, top in self.tops.items()})

            def dealt(batches):
                for batch in batches:
                    gids = batch.column("gid").to_numpy()
                    ids, y, codes = _rows(pa.table(batch), dim)
                    for gid in np.unique(gids).tolist():
                        own = np.flatnonzero(gids == gid)
                        for tree in range(trees):
                            arrays, left_open = tops.value[gid, tree]
                            w = draws(ids[own], seed, tree) if bootstrap else np.ones(len(own))
                            leaf = route(*arrays, codes[own])
                            keep = np.flatnonzero((w > 0) & np.isin(leaf, list(left_open)))
                            if len(keep):
                                at = pa.array(own[keep])
                                yield pa.RecordBatch.from_arrays([
                                    batch.column("gid").take(at), pa.array(np.full(len(keep), tree), pa.int32()), pa.array(leaf[keep], pa.int32()), batch.column("row_id").take(at),
                                    batch.column("y").take(at), pa.array(w[keep]), batch.column("codes").take(at)], names=["gid", "tree", "sub", "row_id", "y", "w", "codes"])

            def below(table: pa.Table, cuts: list[np.ndarray]) -> pa.Table:
                gid, tree, sub = (table.column(n)[0].as_py() for n in ("gid", "tree", "sub"))
                _, y, codes = _rows(table, dim)
                key, level = tops.value[gid, tree][1][sub]
                return _pack([(gid, tree, sub, grow(codes, y, table.column("w").to_numpy(), key, level, depth, mtry, classes))], cuts)

            nodes = coded.where(F.col("gid").isin(large)).mapInArrow(dealt, "gid int, tree int, sub int, row_id long, y int, w double, codes binary")
            part = self._with_cuts(nodes, ["gid", "tree", "sub"], below, held, cuts_table)
            out = part if out is None else out.unionAll(part)
        return out

    def _cuts_table(self) -> DataFrame:
        return settle(self.spark.createDataFrame([(g, [c.tolist() for c in cuts]) for g, cuts in self.cuts.items()], "gid int, cuts array<array<double>>"))

    def _with_cuts(self, rows: DataFrame, keys: list[str], fn, held, table: DataFrame | None) -> DataFrame:
        """``fn(rows, cuts)`` for every group of ``keys``; the cuts are at hand, or come along with the group's rows."""
        if held is not None:
            return rows.groupBy(*keys).applyInArrow(lambda t: fn(t, held.value[t.column("gid")[0].as_py()]), _PACKED)
        rows = settle(rows)
        cuts = rows.select(*[F.col(k).alias(k) for k in keys]).distinct().join(table, "gid").groupBy(*keys)
        return rows.groupBy(*keys).cogroup(cuts).applyInArrow(lambda t, c: fn(t, [np.array(x) for x in c.column("cuts")[0].as_py()]), _PACKED)

    def _levels(self, coded: DataFrame, large: list[int]) -> None:
        """Split all nodes above ``local`` rows, one aggregate a level."""
        trees, seed, bootstrap, classes, dim, mtry = self.trees, self.seed, self.bootstrap, len(self.labels), self.dim, self.mtry

        def totals(batches):
            found: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                gids, ids, y = (batch.column(n).to_numpy() for n in ("gid", "row_id", "y"))
                for gid in np.unique(gids).tolist():
                    own = gids == gid
                    for tree in range(trees):
                        w = draws(ids[own], seed, tree) if bootstrap else np.ones(own.sum())
                        found[gid, tree] = found.get((gid, tree), 0) + np.bincount(y[own], weights=w, minlength=classes)
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in keys], pa.int32()), pa.array([t for _, t in keys], pa.int32()),
                                              pa.array([found[k] for k in keys], pa.list_(pa.float64()))], names=["gid", "tree", "counts"])

        for r in coded.mapInArrow(totals, "gid int, tree int, counts array<double>").groupBy("gid", "tree").agg(sum_vector("counts").alias("counts")).collect():
            self.tops[r["gid"], r["tree"]] = Top(np.array(r["counts"]), seed, r["tree"])

        def waiting(top: Top, node: int) -> bool:
            """The node is to be split by aggregates; closed nodes leave ``tried`` and small ones stay in it for the tasks."""
            counts = top.tree.value[node]
            if (counts > 0).sum() < 2 or top.level[node] == self.depth or top.tried[node] >= dim:
                del top.tried[node]
                return False
            return bool(counts.sum() > self.local)

        todo = [(k, n) for k, top in self.tops.items() for n in list(top.tried) if waiting(top, n)]
        most = max(1, HIST_BYTES // (mtry * BINS * classes * 8))
        while todo:
            again = []
            for low in range(0, len(todo), most):
                wave: dict[tuple[int, int], tuple] = {}
                for k, n in todo[low:low + most]:
                    top = self.tops[k]
                    some = np.random.default_rng(top.key[n]).permutation(dim)[top.tried[n]:top.tried[n] + mtry]
                    wave.setdefault(k, (top.arrays(), []))[1].append((n, some))
                for (gid, tree, node), (feature, code, sides) in self._best(coded, wave).items():
                    top = self.tops[gid, tree]
                    if feature < 0:
                        top.tried[node] += mtry
                        again += [((gid, tree), node)] * waiting(top, node)
                        continue
                    del top.tried[node]
                    for child in top.split(node, feature, code, sides):
                        top.tried[child] = 0
                        again += [((gid, tree), child)] * waiting(top, child)
            todo = again

    def _best(self, coded: DataFrame, wave: dict) -> dict[tuple[int, int, int], tuple]:
        """Best cut of each node of the wave: (feature or -1, code, class counts of both sides)."""
        seed, bootstrap, classes, dim = self.seed, self.bootstrap, len(self.labels), self.dim
        held = self.spark.sparkContext.broadcast(wave)

        def tally(batches):
            found: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                gids = batch.column("gid").to_numpy()
                ids, y, codes = _rows(pa.table(batch), dim)
                for (gid, tree), (arrays, nodes) in held.value.items():
                    own = np.flatnonzero(gids == gid)
                    slot_of = np.full(len(arrays[0]), -1)
                    slot_of[[n for n, _ in nodes]] = np.arange(len(nodes))
                    w = draws(ids[own], seed, tree) if bootstrap else np.ones(len(own))
                    slot = slot_of[route(*arrays, codes[own])]
                    keep = np.flatnonzero((slot >= 0) & (w > 0))
                    if not len(keep):
                        continue
                    slot, rows, w = slot[keep], own[keep], w[keep]
                    wide = max(len(some) for _, some in nodes)
                    features = np.array([[*some, *[-1] * (wide - len(some))] for _, some in nodes])[slot]
                    place = (((slot[:, None] * wide + np.arange(wide)) * BINS) + codes[rows[:, None], features]) * classes + y[rows][:, None]
                    size = len(nodes) * wide * BINS * classes
                    hist = np.bincount(place.ravel(), weights=np.repeat(w, wide), minlength=size)
                    found[gid, tree] = found.get((gid, tree), 0) + hist
            for (gid, tree), hist in found.items():
                nodes = held.value[gid, tree][1]
                hist = hist.reshape(len(nodes), -1, BINS * classes)
                for (node, some), own in zip(nodes, hist):
                    if own.any():
                        m = len(some)
                        yield pa.RecordBatch.from_arrays([
                            *(pa.array(np.full(m, v), pa.int32()) for v in (gid, tree, node)), pa.array(np.arange(m), pa.int32()), pa.array(some, pa.int32()),
                            pa.array(list(own[:m]), pa.list_(pa.float64()))], names=["gid", "tree", "node", "j", "feature", "hist"])

        def judged(batches):
            for batch in batches:
                scores = [best_cut(np.array(h).reshape(1, BINS, classes)) for h in batch.column("hist").to_pylist()]
                sides = []
                for h, (_, _, code) in zip(batch.column("hist").to_pylist(), scores):
                    own = np.array(h).reshape(BINS, classes)
                    sides.append(np.concatenate([own[:code + 1].sum(axis=0), own[code + 1:].sum(axis=0)]))
                yield pa.RecordBatch.from_arrays([
                    *map(batch.column, ("gid", "tree", "node", "j", "feature")), pa.array([s for s, _, _ in scores], pa.float64()), pa.array([c for _, _, c in scores], pa.int32()),
                    pa.array(sides, pa.list_(pa.float64()))], names=["gid", "tree", "node", "j", "feature", "score", "code", "sides"])

        sums = coded.mapInArrow(tally, "gid int, tree int, node int, j int, feature int, hist array<double>").groupBy("gid", "tree", "node", "j", "feature").agg(sum_vector("hist").alias("hist"))
        cut = sums.mapInArrow(judged, "gid int, tree int, node int, j int, feature int, score double, code int, sides array<double>")
        best = cut.groupBy("gid", "tree", "node").agg(F.max_by(F.struct("feature", "score", "code", "sides"), F.struct("score", -F.col("j"))).alias("b"))
        out = {}
        for r in best.collect():  # a row a node
            b = r["b"]
            sides = np.array(b["sides"]).reshape(2, classes)
            out[r["gid"], r["tree"], r["node"]] = (b["feature"] if b["score"] > -np.inf else -1, b["code"], sides)
        held.destroy()
        return out

    def _top_values(self) -> dict[tuple[int, int], tuple]:
        """Top levels with cuts as values, and shares of their closed leaves."""
        out = {}
        for (gid, tree), top in self.tops.items():
            feature, code, left, right = top.arrays()
            cut = np.array([self.cuts[gid][f][c] if f >= 0 else 0.0 for f, c in zip(feature, code)])
            shares = {n: v / v.sum() for n, v in enumerate(top.tree.value) if feature[n] < 0 and n not in top.tried}
            out[gid, tree] = (feature, cut, left, right), shares
        return out

    def predict(self, rows: DataFrame, ids: Sequence[str] = ("row_id",)) -> DataFrame:
        """(by..., ids..., shares array<double>), a share for each of ``labels``, for the rows of trained groups; ``ids`` name a row within its group."""
        own = self._numbered(rows).select("gid", F.struct(*[F.col(c) for c in [*self.by, *ids]]).alias("key"), F.col("features").cast("array<double>").alias("features"))
        if self.subtrees is None:
            none = own.where(F.lit(False))
            return none.select("key.*", F.array().cast("array<double>").alias("shares"))
        sized = self.subtrees.agg(F.sum(F.size("feature") * F.lit(20 + 8 * len(self.labels)))).first()[0] or 0
        scored = self._beside(own) if sized <= MODEL_BYTES else self._dealt(own, ids)
        return scored.select("key.*", "shares")

    def _beside(self, own: DataFrame) -> DataFrame:
        """Subtrees travel to the rows."""
        classes, tops = len(self.labels), self._top_values()
        subs: dict[int, dict[int, dict[int, tuple]]] = {}
        for r in self.subtrees.collect():  # MODEL_BYTES at most
            subs.setdefault(r["gid"], {}).setdefault(r["tree"], {})[r["sub"]] = (
                *(np.array(r[n]) for n in ("feature", "cut", "left", "right")), np.array(r["value"]).reshape(-1, classes))
        held, trees = self.spark.sparkContext.broadcast((tops, subs)), self.trees

        def score(batches):
            tops, subs = held.value
            for batch in batches:
                gids, x = batch.column("gid").to_numpy(), blocks.matrix(batch.column("features"))
                total = np.zeros((len(gids), classes))
                for gid in np.unique(gids).tolist():
                    at = np.flatnonzero(gids == gid)
                    mine = x[at]
                    for tree in range(trees):
                        sub = np.zeros(len(at), np.int64)
                        if (gid, tree) in tops:
                            arrays, shares = tops[gid, tree]
                            sub = route(*arrays, mine)
                            for n in np.unique(sub).tolist():
                                if n in shares:
                                    total[at[sub == n]] += shares[n]
                        for n, (*arrays, value) in subs.get(gid, {}).get(tree, {}).items():
                            here = np.flatnonzero(sub == n)
                            if len(here):
                                total[at[here]] += value[route(*arrays, mine[here])]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(total / trees), pa.list_(pa.float64()))], names=["key", "shares"])

        return own.mapInArrow(score, f"key {dict(own.dtypes)['key']}, shares array<double>")

    def _dealt(self, own: DataFrame, ids: Sequence[str]) -> DataFrame:
        """Rows travel to the subtrees, SCORED of them at a time."""
        own = settle(own)
        classes, trees, kind = len(self.labels), self.trees, dict(own.dtypes)["key"]
        held = self.spark.sparkContext.broadcast(self._top_values())
        lots = max(1, -(-own.count() // SCORED))
        shares = "gid int, tree int, sub int, key " + kind + ", features array<double>, shares array<double>"

        def dealt(batches):
            for batch in batches:
                gids, x = batch.column("gid").to_numpy(), blocks.matrix(batch.column("features"))
                for gid in np.unique(gids).tolist():
                    at = np.flatnonzero(gids == gid)
                    for tree in range(trees):
                        sub, closed = np.zeros(len(at), np.int64), {}
                        if (gid, tree) in held.value:
                            arrays, closed = held.value[gid, tree]
                            sub = route(*arrays, x[at])
                        done = [closed.get(n) for n in sub.tolist()]
                        rows = pa.array(at)
                        yield pa.RecordBatch.from_arrays([
                            batch.column("gid").take(rows), pa.array(np.full(len(at), tree), pa.int32()), pa.array(sub, pa.int32()), batch.column("key").take(rows),
                            batch.column("features").take(rows), pa.array([d if d is None else d.tolist() for d in done], pa.list_(pa.float64()))], names=["gid", "tree", "sub", "key", "features", "shares"])

        routed = own.mapInArrow(dealt, shares)
        closed = routed.where("shares IS NOT NULL").select("key", "shares")
        lot = F.pmod(F.xxhash64("key"), F.lit(lots)).cast("int")
        names = ["feature", "cut", "left", "right", "value"]
        kinds = dict(self.subtrees.dtypes)
        visits = routed.where("shares IS NULL").select("gid", "tree", "sub", lot.alias("lot"), F.lit(1).alias("turn"), "key", "features", *[F.lit(None).cast(kinds[n]).alias(n) for n in names])
        heads = self.subtrees.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).select(
            "gid", "tree", "sub", "lot", F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("key"), F.lit(None).cast("array<double>").alias("features"), *names)
        parts = ["gid", "tree", "sub", "lot"]
        both = heads.unionAll(visits).repartition(*parts).sortWithinPartitions(*parts, "turn")

        def score(batches):
            model = None
            for batch in batches:
                turn = batch.column("turn").to_numpy()
                for low, high in zip([0, *(edges := (np.flatnonzero(np.diff(turn)) + 1).tolist())], [*edges, len(turn)]) if len(turn) else ():
                    part = batch.slice(low, high - low)
                    if turn[low] == 0:  # the last of several heads without visits counts
                        last = part.slice(part.num_rows - 1)
                        model = [np.array(last.column(n)[0].as_py()) for n in names]
                        continue
                    found = model[4].reshape(-1, classes)[route(*model[:4], blocks.matrix(part.column("features")))]
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(list(found), pa.list_(pa.float64()))], names=["key", "shares"])

        every = closed.unionAll(both.mapInArrow(score, f"key {kind}, shares array<double>"))
        return every.groupBy("key").agg(F.transform(sum_vector("shares"), lambda s: s / trees).alias("shares"))


def _rows(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, classes and codes."""
    column = table.column("codes")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    codes = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, dim)
    return table.column("row_id").to_numpy(), table.column("y").to_numpy(), codes
