"""k-means and X-Means for all groups of a frame together.

The algorithms (``lloyd``, ``best_of``, ``xmeans``, ``bisect``) are written over ``measure(specs)``: for given centers per group, the rows,
squared distances and feature sums of every center. Two ways to measure give the same numbers but for the order of sums:

* groups of at most SMALL rows go to one task each, which has all their rows and runs the whole fit there: one job for all such groups;
* larger groups are measured by one job a round, whatever their number, their restarts and their open clusters: tasks read the written rows, keep one
  accumulator per (group, set, center), and send that; Spark adds them up. Centers travel by broadcast, TABLE_BYTES at most; more of them are measured in turns.
  Tasks also send the rows in doubt, those least nearer to their center than to the next one (DOUBT_BYTES a job, a quarter of the rows at most). Until two centers
  have moved by the smallest lead among the other rows, only rows in doubt can change their center, so these steps are taken without a job, with exact sums.

Seeds are k-means++ (with greedy trials) over a group's rows, or over its SMALL rows with the smallest hashes of their ids if it has more: that sample only places the
seeds, all steps and costs see every row. The driver holds the groups' keys, their centers, and the rows in doubt of one job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import blocks
from evenkeel.functions.vectors import sum_vector
from evenkeel.operators.kernels import equi
from evenkeel.operators.runtime import settle

SMALL = 8192  # rows of a group that one task fits, and of the sample that seeds a larger one
TASK_BYTES = 32 << 20  # of such rows
TABLE_BYTES = 32 << 20  # of centers that travel with one job
DOUBT_BYTES = 16 << 20  # of rows in doubt that one job sends
ROUNDS = 300  # Lloyd steps, at most
MOVED = 1e-9  # a center that moves less, relative to its size, stands
CELLS = 1 << 21  # distances held at a time
FUZZ = 1e-12  # what rounding may do to the difference of two squared distances, relative to the squares they are made of

Stats = list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # of each set: rows, squared distances, and sums (or sums and sums of squares) by center


class Spec:
    """Center sets of one group. With ``parents``, a row first goes to its nearest parent, then to the nearest center that this parent owns; rows of parents
    without centers do not count. ``doubts`` tells of which sets rows in doubt are wanted: the least lead among the rows left out, and the other rows."""

    def __init__(self, sets: list[np.ndarray], parents: np.ndarray | None = None, owner: np.ndarray | None = None, doubts: Sequence[bool] = ()):
        self.sets, self.parents, self.owner = sets, parents, owner
        self.doubts: dict[int, Doubts] = {i: Doubts(s.shape[1]) for i, (s, d) in enumerate(zip(sets, doubts)) if d}

    @property
    def size(self) -> int:
        return sum(s.nbytes for s in self.sets) + (0 if self.parents is None else self.parents.nbytes)

    def blank(self, squares: bool) -> Stats:
        return [(np.zeros(len(s), np.int64), np.zeros(len(s)), np.zeros((len(s), s.shape[1] * (1 + squares)))) for s in self.sets]

    def tally(self, x: np.ndarray, into: Stats, squares: bool, doubts: Mapping[int, Doubts] | None = None, most: int = 0) -> None:
        origin = self.sets[0][0]
        every = np.vstack(self.sets) - origin
        every2 = (every * every).sum(axis=1)
        cuts = np.cumsum([0, *map(len, self.sets)])
        for start in range(0, len(x), step := max(1, CELLS // len(every))):
            rows = x[start:start + step]
            y = rows - origin
            y2 = (y * y).sum(axis=1)
            gaps = every2 - 2.0 * (y @ every.T)
            if self.parents is not None:
                p = self.parents - origin
                gaps = np.where(self.owner[None, :] == ((p * p).sum(axis=1) - 2.0 * (y @ p.T)).argmin(axis=1)[:, None], gaps, np.inf)
            for s, ((n, cost, sums), low, high) in enumerate(zip(into, cuts[:-1], cuts[1:])):
                near = gaps[:, low:high].argmin(axis=1)
                gap = gaps[np.arange(len(rows)), low + near] + y2
                own = np.flatnonzero(np.isfinite(gap))
                if doubts and s in doubts:
                    gaps[np.arange(len(rows)), low + near] = np.inf
                    next_ = gaps[:, low:high].min(axis=1)[own] + y2[own]
                    fuzz = FUZZ * (y2[own] + every2[low:high].max())
                    lead = np.full(len(own), np.inf)
                    some = np.flatnonzero(np.isfinite(next_))
                    lead[some] = (next_ - gap[own] - fuzz)[some] / (np.sqrt(np.maximum(next_, 0.0)) + np.sqrt(np.maximum(gap[own], 0.0)) + 1e-300)[some]
                    doubts[s].add(lead, rows[own], most)
                near, gap = near[own], np.maximum(gap[own], 0.0)
                n += np.bincount(near, minlength=high - low)
                cost += np.bincount(near, weights=gap, minlength=high - low)
                order = np.argsort(near, kind="stable")
                first = np.flatnonzero(np.diff(near[order], prepend=-1))
                if len(first):
                    met, sorted_rows = near[order][first], rows[own[order]]
                    sums[met, :x.shape[1]] += np.add.reduceat(sorted_rows, first)
                    if squares:
                        sums[met, x.shape[1]:] += np.add.reduceat((sorted_rows - origin) ** 2, first)


class Doubts:
    """Rows with the smallest leads of their nearest center over the next one, and ``least``, a lead that no other row is below."""

    def __init__(self, dim: int):
        self.least, self.lead, self.rows, self.seen = math.inf, np.zeros(0), np.zeros((0, dim)), 0

    def add(self, lead: np.ndarray, rows: np.ndarray, most: int) -> None:
        self.seen += len(lead)
        close = np.flatnonzero(lead < self.least)
        if len(close) < len(lead):
            self.least = min(self.least, lead[lead >= self.least].min())
        self.lead, self.rows = np.concatenate([self.lead, lead[close]]), np.concatenate([self.rows, rows[close]])
        self.cut(most)

    def cut(self, most: int) -> None:
        if len(self.lead) > most:
            order = np.argpartition(self.lead, most)
            self.least, kept = min(self.least, self.lead[order[most]]), order[:most]
            self.lead, self.rows = self.lead[kept], self.rows[kept]

    def join(self, least: float, rows: np.ndarray) -> None:
        self.least, self.rows = min(self.least, least), np.concatenate([self.rows, rows])


Measure = Callable[[Mapping[int, Spec], bool], dict[int, Stats]]


def inside(rows: Mapping[int, np.ndarray]) -> Measure:
    """Measure groups whose rows are at hand."""

    def measure(specs, squares=False):
        out = {}
        for gid, spec in specs.items():
            out[gid] = spec.blank(squares)
            spec.doubts = {}  # every step is at hand
            spec.tally(rows[gid], out[gid], squares)
        return out

    return measure


def spread(frame: DataFrame) -> Measure:
    """Measure groups of a written frame (gid, features) by one job, or one for each TABLE_BYTES of centers."""

    parts_of: list[int] = []

    def turn(specs: dict[int, Spec], squares: bool) -> dict[int, Stats]:
        if not parts_of:
            parts_of.append(max(1, frame.rdd.getNumPartitions()))
        wide = sum(spec.sets[s].shape[1] for spec in specs.values() for s in spec.doubts)
        most = DOUBT_BYTES // (8 * max(1, wide) * parts_of[0])  # rows in doubt of a set that a task sends
        held = frame.sparkSession.sparkContext.broadcast(specs)
        names = ["gid", "set", "center", "n", "cost", "sums", "rows"]

        def task(batches):
            found: dict[int, Stats] = {}
            close: dict[int, dict[int, Doubts]] = {}
            for batch in batches:
                gids, x = batch.column("gid").to_numpy(), blocks.matrix(batch.column("features"))
                for gid in np.unique(gids).tolist():
                    if spec := held.value.get(gid):
                        if spec.doubts and gid not in close:
                            close[gid] = {s: Doubts(x.shape[1]) for s in spec.doubts}
                        spec.tally(x[gids == gid], found.setdefault(gid, spec.blank(squares)), squares, close.get(gid), most)
            for gid, sets in close.items():
                for s, own in sets.items():
                    own.cut(own.seen // 4)
                    width = held.value[gid].sets[s].shape[1] * (1 + squares)
                    yield pa.RecordBatch.from_arrays([  # a place below 0, this task's own
                        pa.array([gid], pa.int32()), pa.array([s], pa.int32()), pa.array([-1 - TaskContext.get().partitionId()], pa.int32()), pa.array([0], pa.int64()),
                        pa.array([own.least], pa.float64()), pa.array([[0.0] * width], pa.list_(pa.float64())), pa.array([own.rows.tobytes()], pa.binary())], names=names)
            for gid, stats in found.items():
                for s, (n, cost, sums) in enumerate(stats):
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), gid), pa.int32()), pa.array(np.full(len(at), s), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64()),
                        pa.array(cost[at], pa.float64()), pa.array(list(sums[at]), pa.list_(pa.float64())), pa.nulls(len(at), pa.binary())], names=names)

        own = frame.where(F.col("gid").isin(list(specs)))
        parts = own.mapInArrow(task, "gid int, set int, center int, n long, cost double, sums array<double>, rows binary").groupBy("gid", "set", "center").agg(
            F.sum("n").alias("n"), F.sum("cost").alias("cost"), sum_vector("sums").alias("sums"), F.max("rows").alias("rows"))
        out = {gid: spec.blank(squares) for gid, spec in specs.items()}
        for r in parts.collect():  # a row a center at most, and DOUBT_BYTES of rows
            if r["center"] < 0:
                specs[r["gid"]].doubts[r["set"]].join(r["cost"], np.frombuffer(r["rows"]).reshape(-1, specs[r["gid"]].sets[r["set"]].shape[1]))
                continue
            n, cost, sums = out[r["gid"]][r["set"]]
            n[r["center"]], cost[r["center"]], sums[r["center"]] = r["n"], r["cost"], r["sums"]
        held.destroy()
        return out

    def measure(specs, squares=False):
        out, some, size = {}, {}, 0
        for gid, spec in specs.items():
            if some and size + spec.size > TABLE_BYTES:
                out.update(turn(some, squares))
                some, size = {}, 0
            some[gid], size = spec, size + spec.size
        return out | (turn(some, squares) if some else {})

    return measure


def means(now: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Centers of the rows; one without rows stays where it is."""
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], now)


def stands(old: np.ndarray, new: np.ndarray) -> bool:
    return np.abs(new - old).max() <= MOVED * (1.0 + np.abs(old).max())


def drift(old: np.ndarray, new: np.ndarray) -> float:
    """How far two centers moved together, at most."""
    return float(np.sort(np.sqrt(((new - old) ** 2).sum(axis=1)))[-2:].sum())


def walk(old: np.ndarray, new: np.ndarray, n: np.ndarray, sums: np.ndarray, close: Doubts, limit: int, parents, owner) -> tuple[np.ndarray, int]:
    """Up to ``limit`` further steps of a set that was measured at ``old`` and moved to ``new``, as long as only rows in doubt can change their center: (centers, steps)."""

    def share(centers):
        spec = Spec([centers], parents, owner)
        stats = spec.blank(False)
        spec.tally(close.rows, stats, False)
        return stats[0][0], stats[0][2]

    steps, sure_n, sure = 0, None, None
    while steps < limit and drift(old, new) < close.least:
        if sure is None:
            at_n, at = share(old)
            sure_n, sure = n - at_n, sums - at
        at_n, at = share(new)
        last, new = new, means(new, sure_n + at_n, sure + at)
        steps += 1
        if stands(last, new):
            break
    return new, steps


def lloyd(measure: Measure, starts: Mapping[int, list[np.ndarray]], parents=None, owners=None, rounds: int = ROUNDS) -> dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Lloyd steps for every set of every group until its centers stand: (centers, rows, squared distances) by set. A center without rows stays where it is.
    The last step of a set is always measured on all rows. Rows in doubt are asked for at first, and then whenever a step is below twice the lead last known."""
    now = {(g, s): c for g, sets in starts.items() for s, c in enumerate(sets)}
    last, going, done = {}, list(now), dict.fromkeys(now, 0)
    lead, pace = dict.fromkeys(now, math.inf), dict.fromkeys(now, 0.0)
    while going:
        by_group: dict[int, list[int]] = {}
        for g, s in going:
            by_group.setdefault(g, []).append(s)
        specs = {g: Spec([now[g, s] for s in sets], parents and parents[g], owners and owners[g], [rounds > 2 and pace[g, s] < 2 * lead[g, s] for s in sets]) for g, sets in by_group.items()}
        found = measure(specs)
        going = []
        for g, sets in by_group.items():
            for i, (s, (n, cost, sums)) in enumerate(zip(sets, found[g])):
                old = now[g, s]
                new = means(old, n, sums)
                now[g, s], last[g, s] = new, (n, cost)
                done[g, s] += 1
                if done[g, s] < rounds and not stands(old, new):
                    steps, pace[g, s] = 0, drift(old, new)
                    if i in specs[g].doubts:
                        now[g, s], steps = walk(old, new, n, sums, specs[g].doubts[i], rounds - 1 - done[g, s], specs[g].parents, specs[g].owner)
                        done[g, s], lead[g, s] = done[g, s] + steps, specs[g].doubts[i].least
                    if steps:
                        pace[g, s] = 0.0
                    going.append((g, s))
    return {g: [(now[g, s], *last[g, s]) for s in range(len(sets))] for g, sets in starts.items()}


def best_of(measure: Measure, starts: Mapping[int, list[np.ndarray]]) -> dict[int, np.ndarray]:
    """Centers of the cheapest set of each group, those that have rows; ties go to the earlier set."""
    out = {}
    for g, sets in lloyd(measure, starts).items():
        centers, n, _ = min(sets, key=lambda s: round(float(s[2].sum()), 9))
        out[g] = centers[n > 0]
    return out


def bic(sizes: Sequence[int], spread: float, dim: int) -> float:
    """Bayesian information criterion of spherical clusters (Pelleg & Moore 2000)."""
    n, k = sum(sizes), len(sizes)
    if n <= k:
        return -math.inf
    variance = max(spread / (n - k), 1e-300)
    fit = sum(m * math.log(m) - m * math.log(n) - m * dim / 2 * math.log(2 * math.pi * variance) - (m - k) / 2 for m in sizes if m)
    return fit - (k * (dim + 1)) / 2 * math.log(n)


def halves(measure: Measure, centers: Mapping[int, np.ndarray]) -> dict[int, list[tuple | None]]:
    """2-means inside every cluster of every group, all in the same rounds: per cluster ((rows, cost), (centers, rows, costs)), None where it has no two different
    rows. The halves start one standard deviation to both sides along the widest feature (ours)."""
    found = measure({g: Spec([c]) for g, c in centers.items()}, True)
    starts, parents, owners, whole = {}, {}, {}, {}
    for g, c in centers.items():
        (n, cost, sums), dim = found[g][0], c.shape[1]
        many = np.maximum(n, 1)[:, None]
        mean = np.where(n[:, None] > 0, sums[:, :dim] / many, c)
        variance = np.maximum(sums[:, dim:] / many - (mean - c[0]) ** 2, 0.0)
        widest = variance.argmax(axis=1)
        step = np.zeros_like(c)
        step[np.arange(len(c)), widest] = np.sqrt(variance.max(axis=1))
        open_ = np.flatnonzero((n > 1) & (step.max(axis=1) > 1e-12 * (1.0 + np.abs(c).max())))
        whole[g] = n, cost, open_
        if len(open_):
            starts[g] = [np.stack([mean[open_] - step[open_], mean[open_] + step[open_]], axis=1).reshape(-1, dim)]
            parents[g], owners[g] = c, np.repeat(open_, 2)
    split = lloyd(measure, starts, parents, owners) if starts else {}
    out = {}
    for g in centers:
        n, cost, open_ = whole[g]
        out[g] = [None] * len(n)
        for i, p in enumerate(open_.tolist()):
            c, m, s = (x[2 * i:2 * i + 2] for x in split[g][0])
            if m.min() > 0:
                out[g][p] = (n[p], cost[p]), (c, m, s)
    return out


def xmeans(measure: Measure, starts: Mapping[int, list[np.ndarray]], top: Mapping[int, int]) -> dict[int, np.ndarray]:
    """X-Means (Pelleg & Moore 2000) of every group from given centers: k-means over all, then each cluster is replaced by its halves if their criterion is better, in the clusters'
    order up to ``top`` centers; until no cluster splits."""
    now = best_of(measure, starts)
    growing = dict(now)
    while growing := {g: c for g, c in growing.items() if len(c) < top[g]}:
        wider = {}
        for g, found in halves(measure, growing).items():
            kept, free = [], top[g] - len(found)
            for center, half in zip(growing[g], found):
                better = half and free > 0 and bic(half[1][1].tolist(), float(half[1][2].sum()), len(center)) > bic([int(half[0][0])], float(half[0][1]), len(center))
                kept += list(half[1][0]) if better else [center]
                free -= bool(better)
            if len(kept) > len(found):
                wider[g] = [np.array(kept)]
        growing = best_of(measure, wider) if wider else {}
        now.update(growing)
    return now


def bisect(measure: Measure, starts: Mapping[int, list[np.ndarray]], top: Mapping[int, int]) -> dict[int, np.ndarray]:
    """Bisecting k-means of every group: all clusters are halved in the same rounds, larger ones first where only some may be, up to ``top`` centers."""
    now = {g: sets[0][:1] for g, sets in starts.items()}
    growing = {g: c for g, c in now.items() if top[g] > 1}
    while growing:
        wider = {}
        for g, found in halves(measure, growing).items():
            order = sorted((i for i, h in enumerate(found) if h), key=lambda i: (-found[i][0][0], i))[:top[g] - len(found)]
            if order:
                wider[g] = np.concatenate([found[i][1][0] if i in order else growing[g][i:i + 1] for i in range(len(found))])
        now.update(wider)
        growing = {g: c for g, c in wider.items() if len(c) < top[g]}
    return {g: c[0][0] for g, c in lloyd(measure, {g: [c] for g, c in now.items()}, rounds=1).items()}


def plus_plus(x: np.ndarray, k: int, seed: Sequence[int]) -> np.ndarray:
    """k-means++ seeds with 2 + log k trials each; fewer than k where there are fewer different rows."""
    rng = np.random.default_rng(list(seed))
    chosen = [int(rng.integers(len(x)))]
    gap = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and gap.sum() > 0:
        tries = np.searchsorted(np.cumsum(gap), rng.random(2 + int(math.log(k))) * gap.sum(), side="right").clip(max=len(x) - 1)
        left = [np.minimum(gap, ((x - x[t]) ** 2).sum(axis=1)) for t in tries]
        best = int(np.argmin([g.sum() for g in left]))
        chosen.append(int(tries[best]))
        gap = left[best]
    return x[chosen]


class Groups:
    """The rows of a frame by group, written once: (gid, row_id, features)."""

    def __init__(self, rows: DataFrame, grp: Sequence[str]):
        self.grp, self.schema, self.spark = list(grp), [rows.schema[c] for c in grp], rows.sparkSession
        counts = rows.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("features")).alias("_d"))
        counts = [r for r in (counts.orderBy(*grp) if grp else counts).collect() if r["_n"]]
        self.keys = [tuple(r[c] for c in grp) for r in counts]
        self.sizes = {i: r["_n"] for i, r in enumerate(counts)}
        self.dim = max([1, *(r["_d"] or 1 for r in counts)])
        numbered = rows.withColumn("gid", F.lit(0))
        if grp:
            table = self.spark.createDataFrame([(*k, i) for i, k in enumerate(self.keys)], T.StructType([*self.schema, T.StructField("gid", T.IntegerType())]))
            numbered = equi(rows, table, self.grp)
        self.frame = settle(numbered.select("gid", F.col("row_id").cast("long").alias("row_id"), "features"))

    def solve(self, wanted: Mapping[int, int], seed: int, restarts: int, work) -> dict[int, np.ndarray]:
        """Centers by gid: ``work(measure, starts, wanted)`` where ``wanted`` seeds are placed ``restarts`` times."""
        most = min(SMALL, TASK_BYTES // (8 * self.dim))
        large = [g for g, n in self.sizes.items() if n > most]
        out: dict[int, np.ndarray] = {}

        def starts(gid: int, x: np.ndarray) -> list[np.ndarray]:
            return [plus_plus(x, wanted[gid], (seed, r)) for r in range(restarts if wanted[gid] > 1 else 1)]

        def rows_of(table: pa.Table) -> tuple[int, np.ndarray]:
            order = np.argsort(table.column("row_id").to_numpy(), kind="stable")
            return table.column("gid")[0].as_py(), blocks.matrix(table.column("features"))[order]

        def emit(found: list[tuple[int, int, np.ndarray]]) -> pa.Table:
            return pa.table({"gid": pa.array([g for g, _, c in found for _ in c], pa.int32()), "set": pa.array([s for _, s, c in found for _ in c], pa.int32()),
                             "center": pa.array([row for _, _, c in found for row in c.tolist()], pa.list_(pa.float64())),
                             "place": pa.array([i for _, _, c in found for i in range(len(c))], pa.int32())})

        def gather(frame: DataFrame, fn) -> dict[int, list[np.ndarray]]:
            sets: dict[tuple[int, int], list] = {}
            for r in sorted(frame.groupBy("gid").applyInArrow(fn, "gid int, set int, center array<double>, place int").collect(), key=lambda r: (r["gid"], r["set"], r["place"])):
                sets.setdefault((r["gid"], r["set"]), []).append(r["center"])
            out: dict[int, list[np.ndarray]] = {}
            for (g, _), c in sets.items():
                out.setdefault(g, []).append(np.array(c))
            return out

        def fit(table: pa.Table) -> pa.Table:
            gid, x = rows_of(table)
            return emit([(gid, 0, work(inside({gid: x}), {gid: starts(gid, x)}, wanted)[gid])])

        def seeds(table: pa.Table) -> pa.Table:
            table = table.sort_by([("hash", "ascending"), ("row_id", "ascending")]).slice(0, most)
            gid, x = rows_of(table)
            return emit([(gid, s, c) for s, c in enumerate(starts(gid, x))])

        if len(large) < len(self.sizes):
            out = {g: sets[0] for g, sets in gather(self.frame.where(~F.col("gid").isin(large)) if large else self.frame, fit).items()}
        if large:
            big = self.frame.where(F.col("gid").isin(large))
            share = F.create_map(*[F.lit(x) for g in large for x in (g, min(1.0, 1.5 * most / self.sizes[g]))])
            hashed = big.withColumn("hash", F.xxhash64(F.lit(seed), "row_id"))
            picked = hashed.where(F.pmod("hash", F.lit(1 << 30)) < share[F.col("gid")] * float(1 << 30))
            out |= work(spread(big), gather(picked.withColumn("hash", F.pmod("hash", F.lit(1 << 30))), seeds), wanted)
        return out

    def table(self, centers: Mapping[int, np.ndarray]) -> DataFrame:
        """(grp..., cluster, center)."""
        schema = T.StructType([*self.schema, T.StructField("cluster", T.LongType()), T.StructField("center", T.ArrayType(T.DoubleType()))])
        return self.spark.createDataFrame([(*self.keys[g], i, c) for g in sorted(centers) for i, c in enumerate(centers[g].tolist())], schema)
