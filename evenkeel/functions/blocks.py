"""NumPy helpers that run inside Arrow tasks on one query chunk and one reference block.

A kernel gets ``(qid, q, extra, rid, r, carry)`` - ids, row-major matrices and dicts
of side columns - and returns ``(positions of query rows, dict of output columns)``. One marked as ``sums`` gives a
query at most one row, and its columns may be added up over references.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

STEP_CELLS = 1 << 20  # distance cells held at a time
TILE_CELLS = 1 << 17  # the same where several passes go over them
WIDE = 16  # features from which on distances come by a matrix product
PAIR_COST = 24  # times that one pair measured alone costs a cell
PAIRS = 1 << 16  # pairs measured at a time
FEW_ROWS = 1 << 10  # references that a first reach is taken from, at least
MIN_ROWS, MAX_ROWS = 16, 256  # queries that meet references at a time where pairs are ruled out
DIGITS = 9  # distances are compared at this many decimals, ties go to the smaller id


def matrix(column) -> np.ndarray:
    """Arrow list<double> column -> 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def steps(n_left: int, n_right: int):
    size = max(1, STEP_CELLS // max(1, n_right))
    for start in range(0, n_left, size):
        yield slice(start, min(n_left, start + size))


def pair_distance(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Row-wise distance, summed over features from left to right, rounded."""
    total = np.zeros(len(q))
    for c in range(q.shape[1]):
        total += (q[:, c] - r[:, c]) ** 2
    return np.round(np.sqrt(total), DIGITS)


def all_distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``pair_distance`` of every pair. With many features by expanded squares; where their rounding leaves the last
    decimal open, a pair is measured again, so that both ways give the same numbers."""
    if q.shape[1] >= WIDE and len(q) and len(r):
        out, open_ = np.empty((len(q), len(r))), 0
        for part, square, slack in squares(q, r, TILE_CELLS):
            scaled = np.sqrt(square, out=square)
            # half the slack over the distance bounds its error; nothing is sure near zero
            unsure = slack[:, None] / np.maximum(scaled, np.sqrt(slack)[:, None]) * 10.0**DIGITS
            scaled *= 10.0**DIGITS
            whole = np.rint(scaled)
            i, j = np.nonzero(~(np.abs(scaled - whole) + unsure < 0.5))
            open_ += len(i)
            if open_ > (part.stop * len(r)) // 8 + 64:
                break  # values too large for the short way
            np.divide(whole, 10.0**DIGITS, out=out[part])
            i = i + part.start
            out[i, j] = pair_distance(q[i], r[j])
        else:
            return out
    total = np.zeros((len(q), len(r)))
    for c in range(q.shape[1]):
        total += (q[:, c, None] - r[None, :, c]) ** 2
    return np.round(np.sqrt(total), DIGITS)


def squares(q: np.ndarray, r: np.ndarray, cells: int = STEP_CELLS):
    """(query rows, expanded squared distances, bound of their error and of the exact sum's) in steps of ``cells``."""
    centre = r.mean(axis=0)
    a, b = q - centre, r - centre
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    slack = 1.8e-15 * (q.shape[1] + 4) * (a2 + b2.max())
    size = max(1, cells // len(r))
    for low in range(0, len(q), size):
        part = slice(low, min(len(q), low + size))
        square = a[part] @ b.T
        square *= -2.0
        square += a2[part, None]
        square += b2[None, :]
        yield part, np.maximum(square, 0.0, out=square), slack[part]


def close_pairs(q: np.ndarray, r: np.ndarray, reach: np.ndarray, per_reference: bool = False):
    """(query rows, i, j) of the pairs whose distance may be at most ``reach`` (one a query, or one a reference), by steps; pairs beyond it may be among them.

    With many features expanded squares in single precision rule pairs out, a tile at a time, with a slack that covers their rounding; steps that keep too many
    pairs so, or hold values too large, are done in double precision."""
    centre = r.mean(axis=0)
    a, b = q - centre, r - centre
    a2, b2 = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)  # without a copy of all squares
    scale = a2 + b2.max()
    edge = np.square(reach * (1 + 1e-12) + 4 * 10.0**-DIGITS)
    short = q.shape[1] >= WIDE and scale.max(initial=0.0) < 1e30
    rough = [np.column_stack([b, b2]).astype(np.float32)] if short else []  # products with (-2 a, 1) are squares less a2
    exact = None
    rows = int(max(MIN_ROWS, min(MAX_ROWS, STEP_CELLS * 2 // len(r))))
    for low in range(0, len(q), rows):
        part = slice(low, min(len(q), low + rows))
        for kind in (np.float32, np.float64) if short else (np.float64,):
            if kind is np.float64 and exact is None:
                exact = np.column_stack([b, b2])
            side = rough[0] if kind is np.float32 else exact
            slack = (2e-6 if kind is np.float32 else 3.6e-15) * (q.shape[1] + 4) * scale[part]
            own = np.column_stack([-2.0 * a[part], np.ones(part.stop - low)]).astype(kind)
            who, other, many = [], [], 0
            step = max(1, TILE_CELLS * 2 // len(own))
            with np.errstate(over="ignore", invalid="ignore"):
                line = (slack - a2[part]).astype(kind)[:, None] if per_reference else (edge[part] + slack - a2[part]).astype(kind)[:, None]
                for first in range(0, len(r), step):
                    gaps = own @ side[first:first + step].T
                    hit = gaps - edge[first:first + step].astype(kind) <= line if per_reference else gaps <= line
                    found = np.flatnonzero(hit)
                    if len(found):
                        i, j = np.divmod(found, hit.shape[1])
                        who.append(i)
                        other.append(j + first)
                        many += len(found)
                        if kind is np.float32 and many * PAIR_COST > (first + step) * len(own) + 4096 * PAIR_COST:
                            break
                else:
                    break
        i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (who, other))
        order = np.lexsort((j, i)) if len(who) > 1 else slice(None)
        yield part, i[order], j[order]


def measured(q: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``pair_distance`` of pairs, some at a time."""
    if len(i) <= PAIRS:
        return pair_distance(q[i], r[j])
    return np.concatenate([pair_distance(q[i[low:low + PAIRS]], r[j[low:low + PAIRS]]) for low in range(0, len(i), PAIRS)])


def within(q: np.ndarray, r: np.ndarray, radius: np.ndarray):
    """(query rows, i, j, distance) of the pairs whose distance may be at most ``radius`` (a column or a row), by steps;
    the distances are exact, and pairs beyond the radius may be among them."""
    if q.shape[1] < WIDE or not len(r):
        for part in steps(len(q), len(r)):
            d = all_distances(q[part], r)
            i, j = np.nonzero(d <= (radius if len(radius) == 1 else radius[part]))
            yield part, i, j, d[i, j]
        return
    row = len(radius) == 1 and radius.shape[1] == len(r)
    reach = radius[0] if row else np.broadcast_to(radius[:, 0], len(q))
    for part, i, j in close_pairs(q, r, reach, row):
        if len(i) * PAIR_COST > (part.stop - part.start) * len(r):
            yield part, i, j, all_distances(q[part], r)[i, j]
        else:
            yield part, i, j, measured(q[part], r, i, j)


class Closest:
    """The nearest of many points by ``pair_distance``, ties to the first. With few features the points lie in boxes, and a row is measured
    only against those that its nearest box so far does not rule out."""

    LEAF = 128  # points of a box, at most

    def __init__(self, points: np.ndarray):
        self.points, self.boxes = points, []
        if points.shape[1] < WIDE and len(points) > 8 * self.LEAF:
            todo = [np.arange(len(points))]
            while todo:
                own = todo.pop()
                if len(own) <= self.LEAF:
                    self.boxes.append(np.sort(own))
                    continue
                axis = np.ptp(points[own], axis=0).argmax()
                own = own[np.argsort(points[own, axis], kind="stable")]
                todo += [own[: len(own) // 2], own[len(own) // 2 :]]
            self.low = np.array([points[own].min(axis=0) for own in self.boxes])
            self.high = np.array([points[own].max(axis=0) for own in self.boxes])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, distance) of the point nearest to each row."""
        at, near = np.zeros(len(rows), "int64"), np.full(len(rows), np.inf)
        if not self.boxes or not np.isfinite(rows).all():
            for part in steps(len(rows), len(self.points)):
                d = all_distances(rows[part], self.points)
                at[part], near[part] = d.argmin(axis=1), d.min(axis=1)
            return at, near
        for part in steps(len(rows), len(self.boxes)):
            own = rows[part]
            bound = np.zeros((len(own), len(self.boxes)))
            for c in range(own.shape[1]):
                gap = np.maximum(np.maximum(self.low[None, :, c] - own[:, c, None], own[:, c, None] - self.high[None, :, c]), 0.0)
                gap *= gap
                bound += gap
            np.sqrt(bound, out=bound)
            mine, best = np.zeros(len(own), "int64"), np.full(len(own), np.inf)
            home = bound.argmin(axis=1)

            def visit(lines, box):
                some = self.boxes[box]
                d = all_distances(own[lines], self.points[some])
                first = d.argmin(axis=1)
                dist, pos = d[np.arange(len(lines)), first], some[first]
                better = (dist < best[lines]) | ((dist == best[lines]) & (pos < mine[lines]))
                best[lines[better]], mine[lines[better]] = dist[better], pos[better]

            for box in np.unique(home):
                visit(np.flatnonzero(home == box), box)
            bound[np.arange(len(own)), home] = np.inf
            # the bound may be off by its own rounding and that of distances
            open_ = bound * (1 - 1e-12) - 10.0**-DIGITS <= best[:, None]
            for box in np.flatnonzero(open_.any(axis=0)):
                lines = np.flatnonzero(open_[:, box])
                lines = lines[bound[lines, box] * (1 - 1e-12) - 10.0**-DIGITS <= best[lines]]
                if len(lines):
                    visit(lines, box)
            at[part], near[part] = mine, best
        return at, near


def nearest(k: int, skip_self: bool, carry_names=()):
    """Kernel: the k nearest references, by (distance, id); ``extra`` may hold a ``bound`` a query beyond which none is wanted."""

    def kernel(qid, q, extra, rid, r, carry):
        reach = extra["bound"] if "bound" in extra else np.full(len(q), np.inf)
        open_ = np.flatnonzero(np.isinf(reach))
        if len(open_):
            reach = reach.copy()
            reach[open_] = first_reach(q[open_], r, k + (most_equal(rid) if skip_self else 0))
        found_q, found_r, found_d, found_rank = [], [], [], []
        for part, i, j in close_pairs(q, r, reach):
            i = i + part.start
            if skip_self:
                other = qid[i] != rid[j]
                i, j = i[other], j[other]
            d = measured(q, r, i, j)
            real = np.isfinite(d)
            i, j, d = i[real], j[real], d[real]
            order = np.lexsort((rid[j], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.searchsorted(i, i, side="left")
            rank = np.arange(len(i)) - first
            keep = rank < k
            found_q.append(i[keep])
            found_r.append(j[keep])
            found_d.append(d[keep])
            found_rank.append(rank[keep] + 1)
        i, j = np.concatenate(found_q), np.concatenate(found_r)
        out = {"rank": np.concatenate(found_rank), "nbr_id": rid[j], "dist": np.concatenate(found_d)}
        for name in carry_names:
            out[name] = carry[name][j]
        return i, out

    return kernel


def most_equal(ids: np.ndarray) -> int:
    """Times that the most frequent id occurs."""
    return int(np.unique(ids, return_counts=True)[1].max(initial=0))


def first_reach(q: np.ndarray, r: np.ndarray, many: int) -> np.ndarray:
    """A distance within which each query surely has ``many`` references, by a part of them; infinite if there are not so many."""
    some = r[:max(FEW_ROWS, 4 * many, len(r) // 16)]
    if many > len(some):
        return np.full(len(q), np.inf)
    out = np.empty(len(q))
    centre = some.mean(axis=0)
    a, b = q - centre, some - centre
    a2, b2 = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    slack = 1.8e-15 * (q.shape[1] + 4) * (a2 + b2.max())
    for part in steps(len(q), len(some)):
        square = a[part] @ b.T
        square *= -2.0
        square += b2[None, :]
        kth = np.partition(square, many - 1, axis=1)[:, many - 1] + a2[part]
        out[part] = np.sqrt(np.maximum(kth, 0.0) + 2 * slack[part])
    return np.where(np.isnan(out), np.inf, out)


def ball_stats(closed: bool, skip_self: bool):
    """Kernel: weighted count and distance sum of references within each query's ``radius``."""

    def kernel(qid, q, extra, rid, r, carry):
        weight = carry.get("weight")
        count, total = np.zeros(len(q), dtype="int64"), np.zeros(len(q))
        radius = extra["radius"][:, None]
        for part, i, j, d in within(q, r, radius):
            hit = d <= radius[part][i, 0] if closed else d < radius[part][i, 0]
            if skip_self:
                hit &= qid[part][i] != rid[j]
            i, j, d = i[hit], j[hit], d[hit]
            w = np.ones(len(i), dtype="int64") if weight is None else weight[j]
            lines = part.stop - part.start
            count[part] = np.bincount(i, weights=w, minlength=lines)
            total[part] = np.bincount(i, weights=w * d, minlength=lines)
        some = np.nonzero(count)[0]
        return some, {"count": count[some], "total": total[some]}

    kernel.sums = True
    return kernel


def rounded(q: np.ndarray, r: np.ndarray):
    """(query rows, distances) by steps, for sums: as ``all_distances``, but where rounding leaves the last decimal open either neighbour may be given, unless the distance is so small
    that its digits are few."""
    if q.shape[1] < WIDE or not len(q) or not len(r):
        for part in steps(len(q), len(r)):
            yield part, all_distances(q[part], r)
        return
    for part, square, slack in squares(q, r, TILE_CELLS):
        i, j = np.nonzero(~(square > np.square(slack * 10.0**(DIGITS + 2))[:, None]))  # half the slack over the distance is the error
        if len(i) * PAIR_COST > square.size or not slack.max() < 10.0**-DIGITS:
            yield part, all_distances(q[part], r)
            continue
        d = np.sqrt(square, out=square)
        d *= 10.0**DIGITS
        np.rint(d, out=d)
        d *= 10.0**-DIGITS
        if len(i):
            d[i, j] = pair_distance(q[part][i], r[j])
        yield part, d


def inverse_sum(skip_self: bool):
    """Kernel: sum of 1/distance to all references (distance 0 is left out)."""

    def kernel(qid, q, extra, rid, r, carry):
        total = np.zeros(len(q))
        place = np.argsort(rid, kind="stable")
        low, high = (np.searchsorted(rid[place], qid, side=side) for side in ("left", "right"))
        for part, d in rounded(q, r):
            if skip_self:
                for i in np.flatnonzero(high[part] > low[part]):
                    d[i, place[low[part][i]:high[part][i]]] = 0.0
            near = d.min(axis=1, initial=np.inf) <= 0
            with np.errstate(divide="ignore"):
                np.divide(1.0, d, out=d)
            if near.any():
                d[near] = np.where(np.isfinite(d[near]), d[near], 0.0)
            total[part] = d.sum(axis=1)
        return np.arange(len(q)), {"total": total}

    kernel.sums = True
    return kernel


def distance_sum():
    """Kernel: sum of distances to all references."""

    def kernel(qid, q, extra, rid, r, carry):
        total = np.zeros(len(q))
        for part, d in rounded(q, r):
            total[part] = d.sum(axis=1)
        return np.arange(len(q)), {"total": total}

    kernel.sums = True
    return kernel


PRIME = 2147483647  # 2^31 - 1


def ball_pick():
    """Kernel: one reference within ``radius``, the one that minimises (a * id + b) mod PRIME."""

    def kernel(qid, q, extra, rid, r, carry):
        who, key, nbr = [], [], []
        order = np.argsort(rid)  # argmin then settles equal keys by the smaller id
        rid, r = rid[order], r[order]
        residue = rid % PRIME
        radius = extra["radius"][:, None]
        for part, i, j, d in within(q, r, radius):
            open_ = (d <= radius[part][i, 0]) & (extra["own_id"][part][i] != rid[j])
            i, j = i[open_] + part.start, j[open_]
            mixed = (extra["mix_a"][i] * residue[j] + extra["mix_b"][i]) % PRIME
            # pairs come in the order of (query, id), so the first of equal keys has the smaller id
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, dtype="int64")
            least = np.minimum.reduceat(mixed, first) if len(i) else mixed
            hits = np.flatnonzero(mixed == np.repeat(least, np.diff(np.append(first, len(i)))))
            hits = hits[np.flatnonzero(np.append(True, i[hits][1:] != i[hits][:-1]))] if len(i) else hits
            who.append(i[hits])
            key.append(mixed[hits])
            nbr.append(rid[j[hits]])
        return np.concatenate(who), {"mix": np.concatenate(key), "nbr_id": np.concatenate(nbr)}

    return kernel


def push_out():
    """Kernel: summed shift that reference spheres (own ``radius``) give each query inside them."""

    def kernel(qid, q, extra, rid, r, carry):
        shift, hits = np.zeros_like(q), np.zeros(len(q), dtype="int64")
        for part, i, j, d in within(q, r, carry["radius"][None, :]):
            inside = (d < carry["radius"][j]) & (d > 0)
            i, j, d = i[inside], j[inside], d[inside]
            pull = np.zeros((part.stop - part.start, len(r)))
            pull[i, j] = (carry["radius"][j] - d) / d
            shift[part] = pull.sum(axis=1)[:, None] * q[part] - pull @ r
            hits[part] = np.bincount(i, minlength=len(pull))
        some = np.nonzero(hits)[0]
        return some, {"shift": shift[some]}

    kernel.sums = True
    return kernel


def band_counts(bins: int):
    """Kernel: how many references lie in each of ``bins`` equal bands of (lo, hi], and how many at or below lo."""

    def kernel(qid, q, extra, rid, r, carry):
        counts = np.zeros((len(q), bins + 1), dtype="int64")
        for part in steps(len(q), len(r)):
            d = all_distances(q[part], r)
            lo, hi = extra["lo"][part, None], extra["hi"][part, None]
            edge = lo + (hi - lo) * np.arange(bins + 1)[None, :] / bins
            edge[:, -1] = hi[:, 0]
            below = (d <= edge[:, :1]).sum(axis=1)
            i, j = np.nonzero((d > edge[:, :1]) & (d <= edge[:, -1:]))
            ends = np.searchsorted(i, np.arange(len(d) + 1))
            inside = d[i, j]
            for line in range(len(d)):
                band = np.searchsorted(edge[line], inside[ends[line] : ends[line + 1]], side="left")
                counts[part.start + line] = np.bincount(band, minlength=bins + 1)
            counts[part, 0] += below
        return np.arange(len(q)), {"counts": counts.astype("float64")}

    kernel.sums = True
    return kernel


def close_weights(dim: int, cut: float, top: float, square: bool):
    """Kernel: per query, the summed closeness of references (and of squares over ``norm``) within reach.

    Closeness is min(dim / distance, cut) / cut * top. With ``square`` references carry
    their own ``reach`` and ``norm``; otherwise the query's ``reach`` counts.
    """

    def kernel(qid, q, extra, rid, r, carry):
        total = np.zeros(len(q))
        for part in steps(len(q), len(r)):
            d = all_distances(q[part], r)
            inside = d <= (carry["reach"][None, :] if square else extra["reach"][part, None])
            with np.errstate(divide="ignore"):
                close = np.minimum(dim / d, cut) / cut * top
            value = close * close / carry["norm"][None, :] if square else close
            total[part] = np.where(inside, value, 0.0).sum(axis=1)
        return np.arange(len(q)), {"total": total}

    kernel.sums = True
    return kernel


def donors(k: int):
    """Kernel: for every missing (NaN) feature of a query, the k nearest references that have it.

    Distances use the features both rows have, scaled up by features / shared features.
    """

    def kernel(qid, q, extra, rid, r, carry):
        dim = q.shape[1]
        have_r, r0 = ~np.isnan(r), np.nan_to_num(r)
        who, pos, nbr, dist, value = [], [], [], [], []
        for part in steps(len(q), len(r)):
            have_q, q0 = ~np.isnan(q[part]), np.nan_to_num(q[part])
            total, shared = np.zeros((len(q0), len(r))), np.zeros((len(q0), len(r)))
            for c in range(dim):
                both = have_q[:, c, None] & have_r[None, :, c]
                total += np.where(both, (q0[:, c, None] - r0[None, :, c]) ** 2, 0.0)
                shared += both
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(shared > 0, np.round(np.sqrt(dim / shared * total), DIGITS), np.inf)
            d[qid[part, None] == rid[None, :]] = np.inf
            for c in range(dim):
                lines = np.nonzero(~have_q[:, c])[0]
                if not len(lines):
                    continue
                usable = np.where(have_r[None, :, c], d[lines], np.inf)
                width = min(k, len(r))
                limit = np.partition(usable, width - 1, axis=1)[:, width - 1]
                i, j = np.nonzero((usable <= limit[:, None]) & np.isfinite(usable))
                order = np.lexsort((rid[j], usable[i, j], i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
                i, j = i[keep], j[keep]
                who.append(lines[i] + part.start)
                pos.append(np.full(len(i), c, dtype="int32"))
                nbr.append(rid[j])
                dist.append(usable[i, j])
                value.append(r0[j, c])
        if not who:
            who, pos, nbr, dist, value = [np.zeros(0, "int64")], [np.zeros(0, "int32")], [np.zeros(0, "int64")], [np.zeros(0)], [np.zeros(0)]
        return np.concatenate(who), {
            "pos": np.concatenate(pos), "nbr_id": np.concatenate(nbr), "dist": np.concatenate(dist), "value": np.concatenate(value)}

    return kernel
