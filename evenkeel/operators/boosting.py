"""Ordered boosting of oblivious trees on two classes, for all groups of a frame together.

Ordered: a seeded permutation by hash of the row id puts half of a group's rows into the last bucket, half of the rest into the one before, and so on. Model j is trained on the rows of
buckets below j; a row's gradient for choosing splits comes from the model that has not seen its bucket, so no row's class enters the leaf values behind its own gradient (it does help to choose the splits). One tree structure a round serves all models; each
has leaf values of its own, and the model of all rows is the one that predicts.

Oblivious: a level has one split for all its nodes, the one with the best sum of second-order gains (sum of gradients squared over sum of curvatures + ``l2``, both sides, all nodes; ours). Features are codes of at most
``bins`` values (see ``operators/forest.py``).

There are ``rounds`` rounds. With ``patience``, a tenth of the rows by hash is held out of splits and leaves, and a group whose log loss on them has not fallen for that many rounds ends at its best round. (The
ordered loss is no rule for that: as splits are chosen with every row, it goes on falling on pure noise.) A group without held-out rows has all rounds.

A group of at most LOCAL rows and LOCAL_CELLS codes is boosted whole in one task, which keeps only the scores that are read: of a row, those of the model that has not seen it and of the models trained on it, three on average.
Above PARTED rows it counts at each level only the rows on the smaller side of the last cut and takes the other side as what remains of the level before, which may turn ties of gains.
All larger groups take each step in the same job: a job a level, tasks sending gradient histograms HIST_BYTES at a time, and one for the leaves;
rows keep their models' scores in a written table, renewed every RENEW rounds. The driver holds the trees.

Defined results: a group without rows for training predicts nothing; a group of one class has no gradient to speak of and moves towards it; repeated rows count each.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import blocks
from evenkeel.functions.vectors import sum_vector
from evenkeel.operators.forest import Coded, _mix, _root, _rows
from evenkeel.operators.runtime import settle

LOCAL = 1 << 19  # rows of a group that one task boosts
LOCAL_CELLS = 1 << 25  # of its codes
PARTED = 1 << 17  # of them, above which a level counts the smaller side of its last cut only
SURE = 1e-3  # of ``l2``, from which on the rounding of a difference of histograms is nothing beside it
HIST_BYTES = 64 << 20  # of histograms that a task holds
MODEL_BYTES = 32 << 20  # of trees that travel with one job
RENEW = 8  # rounds from one written table of scores to the next
FIRST = 8  # rows of the first bucket, about
FALLS = 1e-5  # a fall of the held-out loss below this is none
HELD = 0.1  # of the rows are held out where there is a patience

Cut = tuple[int, int]  # feature and code


def top_of(n: int) -> int:
    """Buckets are 0 .. top."""
    return max(0, math.ceil(math.log2(max(1, n) / FIRST)))


def _uniform(ids: np.ndarray, seed: int, stream: int) -> np.ndarray:
    mixed = _mix(_mix(ids.astype(np.int64).view(np.uint64)) ^ np.uint64(_root(seed, stream)))
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def buckets(ids: np.ndarray, seed: int, top: int, held: bool = False) -> np.ndarray:
    """The bucket of each row; -1 for those held out."""
    own = np.clip(top + 1 + np.floor(np.log2(_uniform(ids, seed, 1 << 40))), 0, top).astype(np.int64)
    return np.where(_uniform(ids, seed, 1 << 41) < HELD, -1, own) if held else own


def leaves_of(codes: np.ndarray, tree: Sequence[Cut]) -> np.ndarray:
    leaf = np.zeros(len(codes), np.int64)
    for level, (feature, code) in enumerate(tree):
        leaf |= (codes[:, feature] > code).astype(np.int64) << level
    return leaf


def _share(score: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(score, -500, 500)))


def binned(codes: np.ndarray, leaf: np.ndarray, leaves: int, bins: int, gradient: np.ndarray, curvature: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """(gradient and curvature, leaf, feature, code) of rows in leaves; of some ``rows`` only if they are given."""
    dim = codes.shape[1]
    out = np.empty((2, leaves, dim, bins))
    if rows is not None:
        leaf, gradient, curvature = leaf[rows], gradient[rows], curvature[rows]
    base = leaf * bins
    for feature in range(dim):  # one at a time, so that what is added to stays in the cache
        own = codes[:, feature]
        place = base + (own if rows is None else own[rows])
        for i, v in enumerate((gradient, curvature)):
            out[i, :, feature] = np.bincount(place, weights=v, minlength=leaves * bins).reshape(leaves, bins)
    return out


def histogram(codes: np.ndarray, y: np.ndarray, bucket: np.ndarray, score: np.ndarray, tree: Sequence[Cut], bins: int) -> np.ndarray:
    """(gradient and curvature, leaf, feature, code) of rows under the models that have not seen them."""
    if bucket.min(initial=0) < 0:
        codes, y, bucket, score = (v[bucket >= 0] for v in (codes, y, bucket, score))
    p = _share(score[np.arange(len(y)), bucket])
    return binned(codes, leaves_of(codes, tree), 1 << len(tree), bins, y - p, p * (1 - p))


def gains(hist: np.ndarray, l2: float) -> np.ndarray:
    """Summed gain of every (feature, code) over the leaves of a histogram."""
    gradient, curvature = np.cumsum(hist, axis=3)
    out = 0.0
    for g, h in ((gradient[..., -1:] - gradient, curvature[..., -1:] - curvature), (gradient, curvature)):
        h = h + l2
        np.multiply(g, g, out=g)
        out = out + np.divide(g, h, out=g)[..., :-1].sum(axis=0)
    return out


def leaf_sums(codes: np.ndarray, y: np.ndarray, bucket: np.ndarray, score: np.ndarray, tree: Sequence[Cut]) -> np.ndarray:
    """Of each leaf and model, gradient and curvature of the rows it is trained on; then the loss on held-out rows and their number."""
    leaf, many = leaves_of(codes, tree), score.shape[1]
    p = _share(score)
    seen = (bucket[:, None] < np.arange(many)) & (bucket >= 0)[:, None]
    place = (leaf[:, None] * many + np.arange(many)).ravel()
    both = [np.bincount(place, weights=(v * seen).ravel(), minlength=many << len(tree)) for v in (y[:, None] - p, p * (1 - p))]
    out = bucket < 0
    return np.concatenate([*both, held_loss(y[out], p[out, -1])])


def held_loss(y: np.ndarray, p: np.ndarray) -> list[float]:
    """Log loss of held-out rows and their number."""
    own = np.clip(p, 1e-15, 1 - 1e-15)
    return [-np.where(y > 0, np.log(own), np.log(1 - own)).sum(), len(y)]


def boost(measure, tops: Mapping[int, int], rounds: int, depth: int, rate: float, l2: float, patience: int | None) -> dict[int, list[tuple[list[Cut], np.ndarray]]]:
    """Trees (cuts, leaf values) of every group."""
    trees: dict[int, list] = {g: [] for g in tops}
    best = {g: (math.inf, 0) for g in tops}
    going = set(tops)
    for turn in range(rounds):
        grown: dict[int, list[Cut]] = {g: [] for g in going}
        for _ in range(depth):
            for g, cut in measure.cuts(grown).items():
                grown[g].append(cut)
        steps = {}
        for g, sums in measure.leaves(grown).items():
            many = tops[g] + 2
            if not sums[-1] or (loss := sums[-2] / sums[-1]) < best[g][0] - FALLS:
                best[g] = loss if sums[-1] else math.inf, turn
            elif turn - best[g][1] >= patience:
                trees[g] = trees[g][:best[g][1]]
                going.discard(g)
                continue
            gradient, curvature = sums[:-2].reshape(2, -1, many)
            values = rate * gradient / (curvature + l2)
            steps[g] = grown[g], values
            trees[g].append((grown[g], values[:, -1].copy()))
        if not going:
            break
        measure.step(steps)
    return trees


class Inside:
    """One group whose rows are at hand. Scores are held by (row, model), for the models that are read."""

    def __init__(self, gid: int, codes: np.ndarray, y: np.ndarray, bucket: np.ndarray, top: int, l2: float):
        self.gid, self.l2, self.many, self.bins = gid, l2, top + 2, max(2, int(codes.max(initial=0)) + 1)
        self.codes, self.y = np.asfortranarray(codes), y
        models = np.arange(self.many)
        self.row, self.model = np.nonzero(np.where(bucket[:, None] < 0, models == top + 1, models >= bucket[:, None]))
        self.score, own = np.zeros(len(self.row)), bucket[self.row]
        self.unseen, self.seen, self.out = np.flatnonzero(self.model == own), np.flatnonzero((own >= 0) & (self.model > own)), np.flatnonzero(own < 0)
        self.kept = np.flatnonzero(bucket >= 0)  # the rows of ``unseen``
        self.kept_codes = self.codes if len(self.kept) == len(y) else np.asfortranarray(codes[self.kept])
        self.trail = None  # the level before: tree, leaf of each row, histogram, gradient, curvature

    def cuts(self, grown):
        tree = list(grown[self.gid])
        if tree and self.trail and self.trail[0] == tree[:-1] and len(self.kept) > PARTED and self.l2 >= SURE:
            # the last cut parts every leaf: its smaller side is counted, the other is what remains
            _, leaf, hist, gradient, curvature = self.trail
            high = self.kept_codes[:, tree[-1][0]] > tree[-1][1]
            few = 2 * np.count_nonzero(high) <= len(high)
            side = binned(self.kept_codes, leaf, hist.shape[1], self.bins, gradient, curvature, np.flatnonzero(high if few else ~high))
            hist = np.concatenate([hist - side, side] if few else [side, hist - side], axis=1)
            leaf = leaf | high.astype(np.int64) << (len(tree) - 1)
        else:
            p, leaf = _share(self.score[self.unseen]), leaves_of(self.kept_codes, tree)
            gradient, curvature = self.y[self.kept] - p, p * (1 - p)
            hist = binned(self.kept_codes, leaf, 1 << len(tree), self.bins, gradient, curvature)
        self.trail = tree, leaf, hist, gradient, curvature
        gain = gains(hist, self.l2)
        best = int(np.round(gain, 9).argmax())
        return {self.gid: (best // gain.shape[1], best % gain.shape[1])}

    def leaves(self, grown):
        tree = grown[self.gid]
        row, p = self.row[self.seen], _share(self.score[self.seen])
        place = leaves_of(self.codes, tree)[row] * self.many + self.model[self.seen]
        both = [np.bincount(place, weights=v, minlength=self.many << len(tree)) for v in (self.y[row] - p, p * (1 - p))]
        return {self.gid: np.concatenate([*both, held_loss(self.y[self.row[self.out]], _share(self.score[self.out]))])}

    def step(self, steps):
        for tree, values in steps.values():
            self.score += values[leaves_of(self.codes, tree)[self.row], self.model]


class Spread:
    """Groups of a written frame (gid, bucket, y, codes, score)."""

    def __init__(self, frame: DataFrame, dim: int, bins: int, l2: float):
        self.frame, self.dim, self.bins, self.l2, self.pending, self.turns = frame, dim, bins, l2, {}, 0

    def _each(self, specs: Mapping[int, list[Cut]], fn, names: list[str], ddl: str) -> DataFrame:
        """Rows of ``fn(gid, codes, y, bucket, score, tree)`` summed within a task."""
        held, dim = self.frame.sparkSession.sparkContext.broadcast((dict(specs), {g: self.pending.get(g, []) for g in specs})), self.dim

        def task(batches):
            specs, pending = held.value
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                gids = batch.column("gid").to_numpy()
                for gid, (codes, y, bucket, score) in _scored(batch, gids, dim, pending):
                    total[gid] = total.get(gid, 0) + fn(codes, y, bucket, score, specs[gid])
            for gid, sums in total.items():
                for i, row in enumerate(sums.reshape(len(sums), -1) if sums.ndim > 1 else sums[None]):
                    yield pa.RecordBatch.from_arrays([pa.array([gid], pa.int32()), pa.array([i], pa.int32()), pa.array([row], pa.list_(pa.float64()))], names=names)

        own = self.frame.where(F.col("gid").isin(list(specs)))
        return own.mapInArrow(task, ddl).groupBy("gid", "part").agg(sum_vector("sums").alias("sums"))

    def cuts(self, grown):
        out, todo = {}, list(grown)
        most = max(1, HIST_BYTES // max(1, (16 * self.dim * self.bins) << max(map(len, grown.values()), default=0)))
        dim, bins, l2 = self.dim, self.bins, self.l2
        for low in range(0, len(todo), most):
            some = {g: grown[g] for g in todo[low:low + most]}
            sums = self._each(some, lambda *rows: np.moveaxis(histogram(*rows, bins), 1, 0), ["gid", "part", "sums"], "gid int, part int, sums array<double>")

            def judged(batches):
                for batch in batches:
                    found = [gains(np.array(h).reshape(2, 1, dim, bins), l2).ravel() for h in batch.column("sums").to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column("gid"), pa.array(found, pa.list_(pa.float64()))], names=["gid", "gain"])

            for r in sums.mapInArrow(judged, "gid int, gain array<double>").groupBy("gid").agg(sum_vector("gain").alias("gain")).collect():  # a row a group
                best = int(np.round(np.array(r["gain"]), 9).argmax())
                out[r["gid"]] = best // (bins - 1), best % (bins - 1)
        return out

    def leaves(self, grown):
        sums = self._each(grown, leaf_sums, ["gid", "part", "sums"], "gid int, part int, sums array<double>")
        return {r["gid"]: np.array(r["sums"]) for r in sums.collect()}  # a row a group

    def step(self, steps):
        for g, step in steps.items():
            self.pending.setdefault(g, []).append(step)
        self.turns += 1
        if self.turns % RENEW:
            return
        held, dim = self.frame.sparkSession.sparkContext.broadcast(self.pending), self.dim

        def renew(batches):
            for batch in batches:
                gids = batch.column("gid").to_numpy()
                rows = [None] * len(gids)
                for gid, (_, _, _, score) in _scored(batch, gids, dim, held.value):
                    for i, own in zip(np.flatnonzero(gids == gid).tolist(), score):
                        rows[i] = own
                yield pa.RecordBatch.from_arrays([*map(batch.column, ("gid", "row_id", "bucket", "y", "codes")), pa.array(rows, pa.list_(pa.float64()))],
                                                 names=["gid", "row_id", "bucket", "y", "codes", "score"])

        # groups that have stopped are left out
        self.frame = settle(self.frame.where(F.col("gid").isin(list(steps))).mapInArrow(renew, "gid int, row_id long, bucket int, y int, codes binary, score array<double>"))
        self.pending = {}


def _scored(batch: pa.RecordBatch, gids: np.ndarray, dim: int, pending: Mapping[int, list]):
    """(gid, (codes, y, bucket, scores now)) of the groups in a batch."""
    _, y, codes = _rows(pa.table(batch), dim)
    bucket, score = batch.column("bucket").to_numpy(), batch.column("score")
    for gid in np.unique(gids).tolist():
        at = np.flatnonzero(gids == gid)
        own = blocks.matrix(score.take(pa.array(at))).copy()
        for tree, values in pending.get(gid, ()):
            own += values[leaves_of(codes[at], tree)]
        yield gid, (codes[at], y[at], bucket[at].astype(np.int64), own)


class Boosting(Coded):
    """Trained trees of every group: ``predict`` gives the share of class 1."""

    def __init__(self, train: DataFrame, by: Sequence[str] = (), rounds: int = 1000, depth: int = 6, rate: float = 0.03, l2: float = 3.0, patience: int | None = None, seed: int = 42, bins: int = 64):
        """``train`` has by..., row_id, label (1 or another), features."""
        super().__init__(train, by, seed, bins)
        self.trees: dict[int, list[tuple[list[tuple[int, float]], np.ndarray]]] = {}
        if not self.sizes:
            return
        one = self.labels.index(1) if 1 in self.labels else -1
        coded, dim, seed = self._encoded(self.rows), self.dim, self.seed
        tops = {g: top_of(n) for g, n in self.sizes.items()}
        large = [g for g, n in self.sizes.items() if n > min(LOCAL, LOCAL_CELLS // max(1, dim))]
        found = {}
        if len(large) < len(self.sizes):

            def whole(table: pa.Table) -> pa.Table:
                gid = table.column("gid")[0].as_py()
                order = np.argsort(table.column("row_id").to_numpy(), kind="stable")
                ids, y, codes = (v[order] for v in _rows(table, dim))
                made = boost(Inside(gid, codes, (y == one).astype(np.float64), buckets(ids, seed, tops[gid], bool(patience)), tops[gid], l2), {gid: tops[gid]}, rounds, depth, rate, l2, patience)[gid]
                return pa.table({"gid": pa.array([gid] * len(made), pa.int32()), "turn": pa.array(range(len(made)), pa.int32()),
                                 "features": pa.array([[f for f, _ in t] for t, _ in made], pa.list_(pa.int32())), "codes": pa.array([[c for _, c in t] for t, _ in made], pa.list_(pa.int32())),
                                 "leaf": pa.array([v.tolist() for _, v in made], pa.list_(pa.float64()))})

            small = coded.where(~F.col("gid").isin(large)) if large else coded
            rows = small.groupBy("gid").applyInArrow(whole, "gid int, turn int, features array<int>, codes array<int>, leaf array<double>").collect()  # a row a tree
            found = {g: [] for g in self.sizes if g not in large}
            for r in sorted(rows, key=lambda r: (r["gid"], r["turn"])):
                found[r["gid"]].append((list(zip(r["features"], r["codes"])), np.array(r["leaf"])))
        if large:

            def start(batches):
                for batch in batches:
                    gids, ids, y = (batch.column(n).to_numpy() for n in ("gid", "row_id", "y"))
                    bucket = np.zeros(len(gids), np.int32)
                    for gid in np.unique(gids).tolist():
                        bucket[gids == gid] = buckets(ids[gids == gid], seed, tops[gid], bool(patience))
                    yield pa.RecordBatch.from_arrays([
                        batch.column("gid"), batch.column("row_id"), pa.array(bucket), pa.array((y == one).astype(np.int32)), batch.column("codes"),
                        pa.array([[0.0] * (tops[g] + 2) for g in gids.tolist()], pa.list_(pa.float64()))], names=["gid", "row_id", "bucket", "y", "codes", "score"])

            frame = settle(coded.where(F.col("gid").isin(large)).mapInArrow(start, "gid int, row_id long, bucket int, y int, codes binary, score array<double>"))
            found |= boost(Spread(frame, dim, self.bins, l2), {g: tops[g] for g in large}, rounds, depth, rate, l2, patience)
        for g, trees in found.items():
            cuts = self.cuts[g]
            self.trees[g] = [([(f, float(cuts[f][c]) if c < len(cuts[f]) else math.inf) for f, c in tree], values) for tree, values in trees]

    def predict(self, rows: DataFrame, ids: Sequence[str] = ("row_id",)) -> DataFrame:
        """(by..., ids..., share) for the rows of trained groups."""
        own = self._numbered(rows).select("gid", *self.by, *ids, F.col("features").cast("array<double>").alias("features"))
        parts, some, size = [], {}, 0
        for g, trees in self.trees.items():
            bytes_ = sum(v.nbytes + 100 for _, v in trees)
            if some and size + bytes_ > MODEL_BYTES:
                parts.append(some)
                some, size = {}, 0
            some[g], size = trees, size + bytes_
        parts.append(some)
        out = None
        for turn in parts:
            held = self.spark.sparkContext.broadcast(turn)

            def score(batches, held=held):
                for batch in batches:
                    gids, x = batch.column("gid").to_numpy(), blocks.matrix(batch.column("features"))
                    total = np.zeros(len(gids))
                    for gid in np.unique(gids).tolist():
                        at = np.flatnonzero(gids == gid)
                        for tree, values in held.value.get(gid, ()):
                            total[at] += values[leaves_of(x[at], tree)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_share(total))], names=[*batch.schema.names, "share"])

            part = own.where(F.col("gid").isin(list(turn))).mapInArrow(score, ", ".join(f"`{n}` {k}" for n, k in [*own.dtypes, ("share", "double")]))
            out = part if out is None else out.unionAll(part)
        return out.drop("gid", "features")
