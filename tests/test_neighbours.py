import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenkeel.functions import blocks
from evenkeel.operators import neighbours
from evenkeel.operators.neighbours import Neighbours


def frame(spark, mat, groups=None):
    groups = [0] * len(mat) if groups is None else groups
    rows = [(int(g), i, [float(v) for v in row]) for i, (g, row) in enumerate(zip(groups, mat))]
    return spark.createDataFrame(rows, "g int, row_id bigint, features array<double>")


def brute(q, r, k, same=None, skip_self=True):
    out = {}
    for i in range(len(q)):
        found = []
        for j in range(len(r)):
            if skip_self and i == j or same is not None and same[i] != same[j]:
                continue
            found.append((round(float(np.sqrt(((q[i] - r[j]) ** 2).sum())), 9), j))
        for rank, (d, j) in enumerate(sorted(found)[:k], 1):
            out[i, rank] = j
    return out


def got(df):
    return {(r["q_id"], r["rank"]): r["nbr_id"] for r in df.collect()}


def cases():
    rng = np.random.default_rng(3)
    smooth = rng.normal(size=(240, 3))
    lattice = rng.integers(0, 4, size=(240, 2)).astype(float)
    hot = np.vstack([np.zeros((90, 3)), rng.normal(size=(150, 3))])
    return {"smooth": smooth, "lattice": lattice, "hot": hot}


@pytest.mark.parametrize("name", ["smooth", "lattice", "hot"])
@pytest.mark.parametrize("local", [True, False])
def test_knn_matches_brute_force(spark, name, local):
    mat = cases()[name]
    df = frame(spark, mat)
    index = Neighbours(df, copies=6, local_bytes=1 << 30 if local else 0, block_rows=16)
    assert (index.local is not None) == local
    assert got(index.knn(df, 5)) == brute(mat, mat, 5)


@pytest.mark.parametrize("local", [True, False])
def test_knn_by_group_with_one_small_group(spark, local):
    mat = cases()["smooth"]
    groups = np.array([0] * 200 + [1] * 37 + [2] * 3)
    df = frame(spark, mat, groups)
    index = Neighbours(df, by=["g"], copies=6, local_bytes=1 << 30 if local else 0, block_rows=16)
    assert got(index.knn(df, 5)) == brute(mat, mat, 5, same=groups)


@pytest.mark.parametrize("local", [True, False])
def test_ball_counts(spark, local):
    mat = cases()["lattice"]
    df = frame(spark, mat).withColumn("radius", F.lit(1.0))
    index = Neighbours(df, local_bytes=1 << 30 if local else 0, block_rows=16)
    parts = index.meet(df, blocks.ball_stats(True, True), "count bigint, total double", extra=["radius"], reach="radius")
    found = {r["q_id"]: r["n"] for r in parts.groupBy("q_id").agg(F.sum("count").alias("n")).collect()}
    d = np.sqrt(((mat[:, None] - mat[None]) ** 2).sum(-1))
    want = {i: int((d[i] <= 1.0).sum() - 1) for i in range(len(mat)) if (d[i] <= 1.0).sum() > 1}
    assert found == want


@pytest.mark.parametrize("name", ["smooth", "lattice", "hot"])
def test_few_queries_travel_to_the_references(spark, name):
    mat = cases()[name]
    groups = [None if i % 3 == 2 else i % 3 for i in range(len(mat))]
    df = spark.createDataFrame(
        [(g, i, [float(v) for v in row], i % 7) for i, (g, row) in enumerate(zip(groups, mat))],
        "g int, row_id bigint, features array<double>, tag int")
    index = Neighbours(df, by=["g"], carry=["tag"], local_bytes=2500)
    near = index.knn(df.filter("row_id < 40"), 5)
    assert index.local is None and index.blocked is None
    wanted = {key: j for key, j in brute(mat, mat, 5, same=groups).items() if key[0] < 40}
    rows = near.collect()
    assert {(r["q_id"], r["rank"]): r["nbr_id"] for r in rows} == wanted
    assert all(r["tag"] == r["nbr_id"] % 7 and r["g"] == groups[r["q_id"]] for r in rows)


def test_pivots_keep_their_bound(spark, monkeypatch):
    mat = cases()["smooth"]
    groups = np.array([0] * 180 + [1] * 57 + [2] * 3)
    df = frame(spark, mat, groups)
    for most, counts in ((1 << 20, {0: 12, 1: 4}), (8 * 3 * 7, {0: 5, 1: 1}), (8 * 3, None)):
        monkeypatch.setattr(neighbours, "PIVOT_BYTES", most)
        index = Neighbours(df, by=["g"], copies=6, local_bytes=0, block_rows=16, stream_queries=0)
        assert got(index.knn(df, 5)) == brute(mat, mat, 5, same=groups)
        if counts:
            assert {key[0]: len(p) for key, p in index.pivots.value.items()} == counts


@pytest.mark.parametrize("name", ["smooth", "lattice", "hot"])
@pytest.mark.parametrize("shelf", [16, 40, 1 << 16])
def test_shelves_lose_no_block(spark, monkeypatch, name, shelf):
    monkeypatch.setattr(neighbours, "SHELF_ROWS", shelf)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 16)
    mat = cases()[name]
    groups = [None if i % 3 == 2 else i % 3 for i in range(len(mat))]
    df = spark.createDataFrame([(g, i, [float(v) for v in row]) for i, (g, row) in enumerate(zip(groups, mat))], "g int, row_id bigint, features array<double>")
    index = Neighbours(df, by=["g"], copies=6, local_bytes=0, block_rows=8, stream_queries=0)
    assert got(index.knn(df, 5)) == brute(mat, mat, 5, same=groups)
    plain = Neighbours(df, by=["g"], local_bytes=0, block_rows=8, metric=False)  # no pivots: all shelves are open
    parts = plain.meet(df.withColumn("radius", F.lit(1.0)), blocks.ball_stats(True, True), "count bigint, total double", extra=["radius"])
    found = {r["q_id"]: r["n"] for r in parts.groupBy("q_id").agg(F.sum("count").alias("n")).collect()}
    d = np.sqrt(((mat[:, None] - mat[None]) ** 2).sum(-1)).round(9)
    want = {i: sum(groups[j] == groups[i] and j != i and d[i, j] <= 1.0 for j in range(len(mat))) for i in range(len(mat))}
    assert found == {i: n for i, n in want.items() if n}


def test_a_query_travels_once_to_a_shelf(spark):
    mat = np.random.default_rng(5).normal(size=(2000, 24))  # little is ruled out
    df = frame(spark, mat)
    index = Neighbours(df, copies=6, local_bytes=0, block_rows=50, stream_queries=0)
    index._cut()
    assert index.stats.count() >= 40
    routed = index._route(index._queries(df, "row_id", "features", ()).withColumn("_theta", F.lit(float("inf"))))
    assert routed.count() == 2000  # one row a block before


def test_queries_of_one_split_meet_many_references_in_all_tasks(spark):
    from evenkeel.operators import neighbours

    refs = spark.range(neighbours.SPREAD_ROWS).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("features"))
    index = neighbours.Neighbours(refs.limit(neighbours.SPREAD_ROWS))
    assert index.knn(refs.coalesce(1), 1).rdd.getNumPartitions() > 1


def test_nearest_of_many_points_in_boxes():
    from evenkeel.functions import blocks

    rng = np.random.default_rng(3)
    points, rows = np.round(rng.normal(size=(2000, 3)) * [1, 100, 0.1], 1), np.round(rng.normal(size=(3000, 3)) * [1, 100, 0.1], 1)
    index = blocks.Closest(points)
    at, near = index.of(rows)
    d = blocks.all_distances(rows, points)
    assert len(index.boxes) > 8 and (at == d.argmin(axis=1)).all() and (near == d.min(axis=1)).all()


def test_slots_and_large_bases_do_not_travel_through_the_driver(spark, monkeypatch):
    from evenkeel.methods import smote  # noqa: F401
    from evenkeel.methods.registry import fit_resample
    from evenkeel.operators import kernels

    points = spark.createDataFrame([(i, int(i % 10 == 0), [float(i % 17), float(i)]) for i in range(400)], "row_id long, label int, features array<double>")

    def sides(df):
        plan = df._jdf.queryExecution().analyzed().toString()
        return plan.count("strategy=shuffle_hash"), plan.count("strategy=broadcast")

    usual = fit_resample(points, "SMOTE")
    monkeypatch.setattr(kernels, "HELD_BYTES", 0)
    large = fit_resample(points, "SMOTE")
    assert sides(usual) == (0, 5) and sides(large) == (4, 1)
    assert sorted(usual.collect(), key=str) == sorted(large.collect(), key=str)


def test_a_shelf_is_met_in_parts(monkeypatch):
    """A nearest join holds a bounded part of a shelf as a matrix, whatever the shelf; the nearest of all parts are kept."""
    rng = np.random.default_rng(5)
    refs, mat = rng.integers(0, 9, size=(500, 3)).astype(float), rng.normal(size=(40, 3))
    left = pa.table({"q_id": np.arange(40), "_qvec": list(mat), "_mask": np.full(40, 7)})
    right = pa.table({"_rid": 1000 + np.arange(500), "_rvec": list(refs), "_book": np.arange(500) % 3, "mark": np.arange(500)})
    seen, kernel = [], blocks.nearest(5, True, ("mark",))

    def watched(qid, q, extra, rid, r, carry):
        seen.append(r.nbytes)
        return kernel(qid, q, extra, rid, r, carry)

    want = kernel(np.arange(40), mat, {}, 1000 + np.arange(500), refs, {"mark": np.arange(500)})
    monkeypatch.setattr(neighbours, "MEET_BYTES", 1500)
    ids, positions, out = neighbours.meet_shelf(left, right, watched, (), ["mark"], best=5)
    assert max(seen) <= 1500 and sum(seen) == refs.nbytes
    assert ids.tolist() == list(range(40)) and positions.tolist() == want[0].tolist()
    for name, values in want[1].items():
        assert out[name].tolist() == values.tolist(), name


def shelf(seed=3, n=300, m=200, dim=20):
    """Queries with masks of all kinds, and a shelf of ten books."""
    rng = np.random.default_rng(seed)
    vec = pa.list_(pa.float64())
    q, r, book = rng.normal(size=(n, dim)), rng.normal(size=(m, dim)), np.sort(rng.integers(0, 10, m))
    mask = rng.integers(1, 1 << 10, n)
    left = pa.table({"q_id": np.arange(n), "_qvec": pa.array(list(q), vec), "_mask": mask, "radius": np.full(n, 5.5), "lo": np.full(n, -1e-9), "hi": np.full(n, 9.0), "_theta": np.full(n, np.inf)})
    right = pa.table({"_rid": np.arange(m), "_rvec": pa.array(list(r), vec), "_book": book.astype(np.int32), "radius": rng.uniform(4, 6, m)})
    return left, right, q, r, (mask[:, None] >> book & 1).astype(bool)


@pytest.mark.parametrize("name", ["ball_stats", "inverse_sum", "push_out", "band_counts"])
def test_sums_of_a_shelf_are_one_row_a_query(name):
    """However many books a query meets, its sums leave the task once, and the task holds them once."""
    left, right, q, r, open_ = shelf()
    kernel = {"ball_stats": lambda: blocks.ball_stats(True, False), "inverse_sum": lambda: blocks.inverse_sum(False), "push_out": blocks.push_out, "band_counts": lambda: blocks.band_counts(8)}[name]()
    ids, at, out = neighbours.meet_shelf(left, right, kernel, ["radius", "lo", "hi"], ["radius"])
    assert len(set(at.tolist())) == len(at) > 250 and len(ids) == 300
    d = np.round(np.sqrt(((q[:, None] - r) ** 2).sum(axis=2)), 9)
    radius = right.column("radius").to_numpy()
    for i, line in enumerate(at):
        near = open_[line]
        if name == "ball_stats":
            assert out["count"][i] == (d[line][near] <= 5.5).sum()
        elif name == "inverse_sum":
            assert np.isclose(out["total"][i], (1 / d[line][near]).sum())
        elif name == "band_counts":
            assert out["counts"][i].sum() == (d[line][near] <= 9.0).sum()
        else:
            hit = near & (d[line] < radius)
            assert np.allclose(out["shift"][i], (((radius - d[line]) / d[line])[hit, None] * (q[line] - r[hit])).sum(axis=0))


def test_what_was_found_bounds_the_rest_of_a_shelf(monkeypatch):
    left, right, q, r, open_ = shelf()
    monkeypatch.setattr(neighbours, "MEET_BYTES", 8 * 20 * 50)
    seen, real = [], blocks.nearest(3, False)

    def watched(qid, q, extra, *rest):
        seen.append(np.isfinite(extra["bound"]).mean())
        return real(qid, q, extra, *rest)

    ids, at, out = neighbours.meet_shelf(left, right, watched, (), (), best=3)
    assert seen[0] == 0 and seen[-1] > 0.9
    d = np.round(np.sqrt(((q[:, None] - r) ** 2).sum(axis=2)), 9)
    want = [(i, j) for i in range(300) for j in sorted(np.flatnonzero(open_[i]), key=lambda j: (d[i, j], j))[:3]]
    assert list(zip(at.tolist(), out["nbr_id"].tolist())) == want


@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e20])
def test_pairs_ruled_out_in_single_precision(scale):
    """Crowds of near copies, ties and values too large for single precision: the nearest are those of plain distances."""
    rng = np.random.default_rng(2)
    r = rng.normal(size=(1500, 24))
    r[:400] = r[0] + rng.normal(size=(400, 24)) * 1e-6
    r[400:600] = np.round(r[400:600])
    r[600:620] = r[599]
    r = r * scale
    q, rid = r[::3].copy(), rng.permutation(5000)[:1500]
    i, out = blocks.nearest(4, True)(rid[::3], q, {}, rid, r, {})
    for line in range(0, 500, 7):
        d = blocks.pair_distance(np.repeat(q[line:line + 1], 1500, axis=0), r)
        want = [j for j in np.lexsort((rid, d)) if rid[j] != rid[3 * line]][:4]
        assert out["nbr_id"][i == line].tolist() == rid[want].tolist()
