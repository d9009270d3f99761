"""Kernel support vector machines with an RBF kernel on two classes, for all groups of a frame together.

Features are Nystroem coordinates: ``landmarks`` distinct rows of a group, those with the smallest seeded hashes, give the kernel's projection on their span. A group with
no more distinct rows than that has the exact kernel. The machine is the usual one: hinge loss times ``cost``, ridge on the weights, gamma = 1 / (features * variance), and an offset whose
own ridge of RIDGE is there only to keep the dual without an equation.

Newton steps run on the hinge rounded to h * log(1 + exp(short / h)), and h falls until the certificate holds. A row's slope on the rounded hinge is a feasible dual variable, so the sums of a step also give
a dual value, and objective - dual bounds the distance to the best objective. A fit ends at a gap of ``tol`` of the objective (or of FLOOR, if that is more) and reports both. The bound is on the
problem in landmark coordinates; the error of the projection itself is not in it.

Probabilities: ``folds`` more machines, each without a fold of rows by hash, score the rows that they have not seen; a logistic curve is fitted on these margins, in steps of 1 / GRID and clipped to
+-REACH, with the two-class targets that Platt proposes.

A group of at most LOCAL rows is fitted whole in one task. All larger groups and their folds take each step in the same job: tasks sum their rows, sums are added in two levels, and the step
is taken where they meet, so that only weights come back. Models are written; a lot of MODEL_BYTES at a time travels to the rows to score.

Defined results: a group of one class gets an offset towards it and no weights; repeated rows count each; a group without rows predicts nothing; equal features (no variance) have gamma 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import blocks
from evenkeel.operators.kernels import equi
from evenkeel.operators.runtime import settle

LOCAL = 1 << 12  # rows of a group that one task fits
MODEL_BYTES = 32 << 20  # of landmarks that travel with one job
STEP_ROWS = 1 << 12  # rows whose kernel is held at a time
MEETS = 128  # partial sums of one fit meet in so many places first
RIDGE = 1e-4  # of the offset
FLOOR = 1e-2  # objectives below this are judged by this
FALL = 0.25  # of the rounding's width from one to the next
SETTLED = 0.5  # a width ends where the gradient's part of the gap is less than this share
FLAT = 1e-9  # rows with less curvature do not turn a step
GRID = 1024
REACH = 32
ALL = -1  # the fold that leaves nothing out


@dataclass(frozen=True)
class Basis:
    """Landmarks of a group and the projection on them."""

    points: np.ndarray
    turn: np.ndarray
    gamma: float

    def kernel(self, x: np.ndarray) -> np.ndarray:
        gaps = (x * x).sum(axis=1)[:, None] + (self.points * self.points).sum(axis=1) - 2 * x @ self.points.T
        return np.exp(-self.gamma * np.maximum(gaps, 0.0))

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of rows, and a one for the offset."""
        return np.column_stack([self.kernel(x) @ self.turn, np.ones(len(x))])


def basis(x: np.ndarray, most: int, gamma: float) -> Basis:
    """From rows in the order of their hashes."""
    first = np.sort(np.unique(x, axis=0, return_index=True)[1])[:most]
    bare = Basis(x[first], np.zeros((len(first), 0)), gamma)
    values, vectors = np.linalg.eigh(bare.kernel(bare.points))
    real = values > 1e-10 * values.max(initial=1.0)
    return replace(bare, turn=vectors[:, real] / np.sqrt(values[real]))


@dataclass(frozen=True)
class State:
    """Where a fit stands: the next point to measure at, and the last one that was good."""

    u: np.ndarray
    h: float
    best: np.ndarray | None = None
    objective: float = math.inf
    dual: float = -math.inf
    base: np.ndarray | None = None
    way: np.ndarray | None = None
    start: float = 0.0
    slope: float = 0.0
    size: float = 1.0
    turn: int = 0

    def done(self, tol: float) -> bool:
        return self.best is not None and self.objective - self.dual <= tol * max(self.objective, FLOOR)


def tally(z: np.ndarray, y: np.ndarray, u: np.ndarray, h: float) -> np.ndarray:
    """Sums over rows: hinge, rounded hinge, dual variables; their pull; the upper triangle of the weighted second moments."""
    short = 1 - y * (z @ u)
    slope = 1 / (1 + np.exp(-np.clip(short / h, -500, 500)))
    weight = slope * (1 - slope)
    on = weight > FLAT
    curve = (z[on] * weight[on, None]).T @ z[on]
    return np.concatenate([
        [np.maximum(short, 0).sum(), (np.maximum(short, 0) + h * np.log1p(np.exp(-np.abs(short) / h))).sum(), slope.sum()], (slope * y) @ z, curve[np.triu_indices(z.shape[1])]])


def step(state: State, sums: np.ndarray, cost: float) -> State:
    """The next state, from sums at ``state.u``."""
    size = len(state.u)
    hinge, rounded, slopes = map(float, sums[:3])
    pull, upper = cost * sums[3:3 + size], sums[3 + size:]
    ridge = np.ones(size)
    ridge[-1] = RIDGE
    own = float(ridge @ state.u**2) / 2
    objective, smooth, dual = own + cost * hinge, own + cost * rounded, cost * slopes - float(pull**2 @ (1 / ridge)) / 2
    better = objective < state.objective
    seen = replace(state, best=state.u if better else state.best, objective=min(objective, state.objective), dual=max(dual, state.dual), turn=state.turn + 1)
    if state.way is not None and smooth > state.start + 1e-4 * state.size * state.slope and state.size > 1e-6:
        # the lowest point of the parabola through what is known
        fall = state.slope * state.size
        cut = min(0.5, max(0.1, -fall / 2 / (smooth - state.start - fall)))
        return replace(seen, u=state.base + cut * state.size * state.way, size=cut * state.size)
    curve = np.zeros((size, size))
    curve[np.triu_indices(size)] = upper
    curve = (curve + np.triu(curve, 1).T) * (cost / state.h) + np.diag(ridge)
    gradient = ridge * state.u - pull
    way = -np.linalg.solve(curve, gradient)
    slope = float(gradient @ way)
    if float(gradient**2 @ (1 / ridge)) / 2 <= SETTLED * (objective - dual):  # the gap is that of the rounding and this
        return replace(seen, u=state.u + way, h=state.h * FALL, way=None)
    return replace(seen, u=state.u + way, base=state.u, way=way, start=smooth, slope=slope, size=1.0)


def without(fold: np.ndarray, which: int) -> np.ndarray:
    return np.ones(len(fold), bool) if which == ALL else fold != which


def logistic(margin: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the share of positives on margins that occur ``n`` times; Newton steps, halved while the loss does not fall."""
    up, down = n[y > 0].sum(), n[y < 0].sum()
    want = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    rows = np.column_stack([margin, np.ones(len(margin))])

    def loss(at: np.ndarray) -> float:
        score = rows @ at
        return float(n @ (np.logaddexp(0, score) - want * score))

    at = np.array([0.0, math.log((up + 1) / (down + 1))])
    now = loss(at)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ at, -500, 500)))
        gradient = rows.T @ (n * (p - want))
        if np.abs(gradient).max() <= 1e-9 * max(1.0, n.sum()):
            break
        way = -np.linalg.solve((rows * (n * p * (1 - p))[:, None]).T @ rows + 1e-12 * max(1.0, n.sum()) * np.eye(2), gradient)
        size = 1.0
        while size > 1e-10 and loss(at + size * way) > now + 1e-4 * size * float(gradient @ way):
            size /= 2
        at = at + size * way
        if now - (now := loss(at)) <= 1e-13 * max(1.0, now):
            break
    return float(at[0]), float(at[1])


def on_grid(margin: np.ndarray) -> np.ndarray:
    return np.clip(np.round(margin * GRID), -REACH * GRID, REACH * GRID).astype(np.int64)


def _flat(column) -> list[np.ndarray]:
    return [np.frombuffer(v, np.float64) for v in column.to_pylist()]


_MODEL = "gid int, points binary, coef binary, offset double, gamma double, objective double, gap double, turns int, slope double, shift double"


def _model(gid: int, base: Basis, state: State, curve: tuple[float, float]) -> dict:
    return {"gid": gid, "points": base.points.tobytes(), "coef": (base.turn @ state.best[:-1]).tobytes(), "offset": float(state.best[-1]), "gamma": base.gamma,
            "objective": state.objective, "gap": state.objective - state.dual, "turns": state.turn, "slope": curve[0], "shift": curve[1]}


_ARROW = pa.schema([("gid", pa.int32()), ("points", pa.binary()), ("coef", pa.binary()), ("offset", pa.float64()), ("gamma", pa.float64()), ("objective", pa.float64()), ("gap", pa.float64()),
                    ("turns", pa.int32()), ("slope", pa.float64()), ("shift", pa.float64())])


class KernelSVM:
    """Fitted machines of every group: ``predict`` gives margins and shares of class 1, ``fits`` objectives and gaps."""

    def __init__(self, train: DataFrame, by: Sequence[str] = (), landmarks: int = 512, cost: float = 1.0, tol: float = 1e-3, folds: int = 5, turns: int = 300, seed: int = 42):
        """``train`` has by..., row_id, label (1 or another), features. A fit that has not met ``tol`` after ``turns`` steps stands, with the gap it has."""
        self.by, self.spark, self.schema = list(by), train.sparkSession, [train.schema[c] for c in by]
        self.landmarks, self.cost, self.tol, self.folds, self.turns = landmarks, cost, tol, folds, turns
        counts = train.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("features")).alias("_d"))
        counts = [r for r in (counts.orderBy(*by) if by else counts).collect() if r["_n"]]  # a row a group
        self.keys, self.sizes = [tuple(r[c] for c in by) for r in counts], {g: r["_n"] for g, r in enumerate(counts)}
        self.dim = max([1, *(r["_d"] or 1 for r in counts)])
        self.models = None
        if not counts:
            return
        rows = settle(self._numbered(train).select(
            "gid", F.col("row_id").cast("long").alias("row_id"), F.when(F.col("label") == 1, 1.0).otherwise(-1.0).alias("y"),
            F.col("features").cast("array<double>").alias("features"),
            F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(1 << 30)).alias("hash"), F.pmod(F.xxhash64(F.lit(seed), F.lit("fold"), "row_id"), F.lit(folds)).cast("int").alias("fold")))
        spread = rows.select("gid", F.explode("features").alias("v")).groupBy("gid").agg(F.var_pop("v").alias("v")).collect()  # a row a group
        self.gammas = {r["gid"]: 1.0 / (self.dim * r["v"]) if r["v"] else 1.0 for r in spread}
        large = [g for g, n in self.sizes.items() if n > LOCAL]
        parts = []
        if len(large) < len(self.sizes):
            parts.append(self._whole(rows.where(~F.col("gid").isin(large)) if large else rows))
        for lot in self._lots(large):
            parts.append(self._stepwise(rows.where(F.col("gid").isin(lot)), lot))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        self.models = settle(out)

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """Rows of trained groups with their number."""
        if not self.by:
            return rows.withColumn("gid", F.lit(0))
        return equi(rows, self.spark.createDataFrame([(*k, g) for g, k in enumerate(self.keys)], T.StructType([*self.schema, T.StructField("gid", T.IntegerType())])), self.by)

    def _lots(self, gids: Sequence[int]) -> Iterator[list[int]]:
        """Groups whose landmarks may travel together."""
        most = max(1, MODEL_BYTES // (8 * self.landmarks * (self.dim + self.landmarks)))
        for low in range(0, len(gids), most):
            yield list(gids[low:low + most])

    def _whole(self, rows: DataFrame) -> DataFrame:
        gammas, most, cost, tol, folds, turns = self.gammas, self.landmarks, self.cost, self.tol, self.folds, self.turns

        def fit(table: pa.Table) -> pa.Table:
            table = table.sort_by([("hash", "ascending"), ("row_id", "ascending")])
            gid, x = table.column("gid")[0].as_py(), blocks.matrix(table.column("features"))
            y, fold = table.column("y").to_numpy(), table.column("fold").to_numpy()
            base = basis(x[:4 * most], most, gammas[gid])
            z = base.lift(x)

            def solve(which: int, state: State) -> State:
                at = without(fold, which)
                own, side = z[at], y[at]
                while state.turn < turns and not state.done(tol):
                    state = step(state, tally(own, side, state.u, state.h), cost)
                return state

            full = solve(ALL, State(np.zeros(z.shape[1]), 1.0))
            unseen = np.zeros(len(y))
            for which in np.unique(fold).tolist():
                state = solve(which, _again(full))
                unseen[fold == which] = z[fold == which] @ state.best
            bins, place = np.unique(np.column_stack([on_grid(unseen), y]), axis=0, return_inverse=True)
            curve = logistic(bins[:, 0] / GRID, bins[:, 1], np.bincount(place.ravel()).astype(np.float64))
            return pa.Table.from_pylist([_model(gid, base, full, curve)], schema=_ARROW)

        return rows.groupBy("gid").applyInArrow(fit, _MODEL)

    def _stepwise(self, rows: DataFrame, gids: Sequence[int]) -> DataFrame:
        """Models of large groups, a job a step."""
        gammas, most = self.gammas, self.landmarks
        share = F.create_map(*[F.lit(v) for g in gids for v in (g, min(1.0, 6.0 * most / self.sizes[g]))])

        def pick(table: pa.Table) -> pa.Table:
            table = table.sort_by([("hash", "ascending"), ("row_id", "ascending")]).slice(0, 4 * most)
            gid = table.column("gid")[0].as_py()
            base = basis(blocks.matrix(table.column("features")), most, gammas[gid])
            return pa.table({"gid": pa.array([gid], pa.int32()), "points": pa.array([base.points.tobytes()], pa.binary()), "turn": pa.array([base.turn.tobytes()], pa.binary())})

        near = rows.where(F.col("hash") < share[F.col("gid")] * float(1 << 30)).groupBy("gid")
        bases = {}
        for r in near.applyInArrow(pick, "gid int, points binary, turn binary").collect():  # a lot of groups
            points = np.frombuffer(r["points"]).reshape(-1, self.dim)
            bases[r["gid"]] = Basis(points, np.frombuffer(r["turn"]).reshape(len(points), -1), gammas[r["gid"]])
        held = self.spark.sparkContext.broadcast(bases)
        states = self._solve(rows, held, {(g, ALL): State(np.zeros(b.turn.shape[1] + 1), 1.0) for g, b in bases.items()})
        states |= self._solve(rows, held, {(g, f): _again(states[g, ALL]) for g in bases for f in range(self.folds)})
        curves = self._curves(rows, held, {key: state.best for key, state in states.items()})
        found = pa.Table.from_pylist([_model(g, bases[g], states[g, ALL], curves[g]) for g in bases], schema=_ARROW)
        return self.spark.createDataFrame(found)

    def _solve(self, rows: DataFrame, held, states: dict[tuple[int, int], State]) -> dict[tuple[int, int], State]:
        cost = self.cost
        while going := {k: s for k, s in states.items() if s.turn < self.turns and not s.done(self.tol)}:
            now = self.spark.sparkContext.broadcast(going)

            def sums(batches):
                total: dict[tuple[int, int], np.ndarray] = {}
                for gid, x, y, fold in _pieces(batches):
                    asked = [k for k in now.value if k[0] == gid]
                    z = held.value[gid].lift(x) if asked else None
                    for key in asked:
                        at, state = without(fold, key[1]), now.value[key]
                        total[key] = total.get(key, 0) + tally(z[at], y[at], state.u, state.h)
                place = TaskContext.get().partitionId() % MEETS
                for (g, f), value in total.items():
                    yield _sums(g, f, place, value)

            def meet(table: pa.Table) -> pa.Table:
                return pa.Table.from_batches([_sums(*(table.column(c)[0].as_py() for c in ("gid", "fold", "place")), sum(_flat(table.column("sums"))))])

            def move(table: pa.Table) -> pa.Table:
                key = table.column("gid")[0].as_py(), table.column("fold")[0].as_py()
                new = step(now.value[key], sum(_flat(table.column("sums"))), cost)
                arrays = {n: pa.array([None if (v := getattr(new, n)) is None else v.tobytes()], pa.binary()) for n in ("u", "best", "base", "way")}
                numbers = {n: pa.array([float(getattr(new, n))]) for n in ("h", "objective", "dual", "start", "slope", "size")}
                return pa.table({"gid": pa.array([key[0]], pa.int32()), "fold": pa.array([key[1]], pa.int32()), "turn": pa.array([new.turn], pa.int32()), **arrays, **numbers})

            own = rows.where(F.col("gid").isin(sorted({g for g, _ in going})))
            ddl = "gid int, fold int, place int, sums binary"
            met = own.select("gid", "y", "features", "fold").mapInArrow(sums, ddl).groupBy("gid", "fold", "place").applyInArrow(meet, ddl)
            moved = met.groupBy("gid", "fold").applyInArrow(
                move, "gid int, fold int, turn int, u binary, best binary, base binary, way binary, h double, objective double, dual double, start double, slope double, size double")
            answers = {(r["gid"], r["fold"]): r for r in moved.collect()}  # a row a fit
            for key, state in going.items():
                if r := answers.get(key):
                    arrays = {n: None if r[n] is None else np.frombuffer(r[n]) for n in ("u", "best", "base", "way")}
                    states[key] = State(**arrays, **{n: r[n] for n in ("h", "objective", "dual", "start", "slope", "size", "turn")})
                else:  # a fold that leaves nothing: no rows, no loss
                    states[key] = replace(state, u=np.zeros(len(state.u)), best=np.zeros(len(state.u)), objective=0.0, dual=0.0)
            now.destroy()
        return states

    def _curves(self, rows: DataFrame, held, weights: dict[tuple[int, int], np.ndarray]) -> dict[int, tuple[float, float]]:
        now = self.spark.sparkContext.broadcast(weights)

        def unseen(batches):
            for gid, x, y, fold in _pieces(batches):
                z, margin = held.value[gid].lift(x), np.zeros(len(y))
                for which in np.unique(fold).tolist():
                    margin[fold == which] = z[fold == which] @ now.value[gid, which]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), gid), pa.int32()), pa.array(on_grid(margin)), pa.array(y)], names=["gid", "bin", "y"])

        def curve(table: pa.Table) -> pa.Table:
            slope, shift = logistic(table.column("bin").to_numpy() / GRID, table.column("y").to_numpy(), table.column("n").to_numpy().astype(np.float64))
            return pa.table({"gid": table.column("gid").slice(0, 1).cast(pa.int32()), "slope": pa.array([slope]), "shift": pa.array([shift])})

        # at most 2 * (2 * REACH * GRID + 1) rows a group
        counted = rows.select("gid", "y", "features", "fold").mapInArrow(unseen, "gid int, bin long, y double").groupBy("gid", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
        return {r["gid"]: (r["slope"], r["shift"]) for r in counted.groupBy("gid").applyInArrow(curve, "gid int, slope double, shift double").collect()}

    def fits(self) -> DataFrame:
        """(by..., rows, objective, gap, turns) of every group; the best objective is at most ``gap`` below."""
        fields = [*self.schema, T.StructField("gid", T.IntegerType()), T.StructField("rows", T.LongType())]
        table = self.spark.createDataFrame([(*k, g, self.sizes[g]) for g, k in enumerate(self.keys)], T.StructType(fields))
        if self.models is None:
            return table.selectExpr(*[f"`{c}`" for c in self.by], "rows", "0D AS objective", "0D AS gap", "0 AS turns")
        return table.join(self.models, "gid").select(*self.by, "rows", "objective", "gap", "turns")

    def predict(self, rows: DataFrame, ids: Sequence[str] = ("row_id",)) -> DataFrame:
        """(by..., ids..., margin, share) for the rows of trained groups."""
        own = self._numbered(rows).select("gid", *self.by, *ids, F.col("features").cast("array<double>").alias("features"))
        ddl, out, dim = ", ".join(f"`{n}` {k}" for n, k in [*own.dtypes, ("margin", "double"), ("share", "double")]), None, self.dim
        for lot in list(self._lots(range(len(self.keys)))) or [[]]:
            models = {} if self.models is None else {r["gid"]: r.asDict() for r in self.models.where(F.col("gid").isin(lot)).collect()}  # a lot of groups
            held = self.spark.sparkContext.broadcast(models)

            def score(batches, held=held):
                for batch in batches:
                    gids, x = batch.column("gid").to_numpy(), blocks.matrix(batch.column("features"))
                    margin, share = np.zeros(len(gids)), np.zeros(len(gids))
                    for gid in np.unique(gids).tolist():
                        m, at = held.value[gid], np.flatnonzero(gids == gid)
                        base = Basis(np.frombuffer(m["points"]).reshape(-1, dim), np.zeros((0, 0)), m["gamma"])
                        for low in range(0, len(at), STEP_ROWS):
                            some = at[low:low + STEP_ROWS]
                            margin[some] = base.kernel(x[some]) @ np.frombuffer(m["coef"]) + m["offset"]
                        share[at] = 1 / (1 + np.exp(-np.clip(m["slope"] * margin[at] + m["shift"], -500, 500)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(margin), pa.array(share)], names=[*batch.schema.names, "margin", "share"])

            part = own.where(F.col("gid").isin(list(models))).mapInArrow(score, ddl)
            out = part if out is None else out.unionAll(part)
        return out.drop("gid", "features")


def _again(full: State) -> State:
    """A start near a finished fit."""
    return State(full.best if full.best is not None else full.u, min(1.0, full.h * 16))


def _pieces(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(gid, features, side, fold) of the rows of each group, STEP_ROWS at a time."""
    for batch in batches:
        gids, x = batch.column("gid").to_numpy(), blocks.matrix(batch.column("features"))
        y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        for gid in np.unique(gids).tolist():
            at = np.flatnonzero(gids == gid)
            for low in range(0, len(at), STEP_ROWS):
                some = at[low:low + STEP_ROWS]
                yield gid, x[some], y[some], fold[some]


def _sums(gid: int, fold: int, place: int, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([gid], pa.int32()), pa.array([fold], pa.int32()), pa.array([place], pa.int32()), pa.array([value.tobytes()], pa.binary())],
                                      names=["gid", "fold", "place", "sums"])
