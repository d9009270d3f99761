"""Average linkage against brute force, over groups, copies, connected parts and cuts at medians."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import linkage


def brute(rows, cut):
    """Join the two clusters with the smallest mean distance until it exceeds the cut."""
    clusters = [[i] for i in range(len(rows))]
    x = np.array([r[1] for r in rows])
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    while len(clusters) > 1:
        best = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if best[0] > cut + 1e-12:
            break
        clusters[best[1]] += clusters.pop(best[2])
    return {rows[i][0]: min(rows[i][0] for i in c) for c in clusters for i in c}


def groups():
    rng = np.random.default_rng(6)
    out = {}
    for g, cut in ((0, 0.25), (1, 0.35), (None, 0.1)):
        x = rng.normal(size=(70, 2))
        x[5:12] = x[4]
        out[g] = (cut, [(int(i), v.tolist()) for i, v in zip(rng.permutation(70), x)])
    return out


@pytest.mark.parametrize("limits", [{}, {"local_rows": 40}, {"local_rows": 40, "local_bytes": 0, "block_rows": 16}])
def test_average_linkage_matches_brute_force(spark, limits):
    """Small groups whole, and large ones by connected parts (none of which is above the limit here)."""
    data = groups()
    df = spark.createDataFrame([(g, i, v) for g, (_, rows) in data.items() for i, v in rows], "g int, row_id long, features array<double>").repartition(5)
    cuts = spark.createDataFrame([(g, cut) for g, (cut, _) in data.items()], "g int, cut double")
    got = {(r["g"], r["row_id"]): r["cluster"] for r in linkage.average_linkage(df, ["g"], cuts, **limits).collect()}
    want = {(g, i): c for g, (cut, rows) in data.items() for i, c in brute(rows, cut).items()}
    assert got == want and len(set(want.values())) > 20


def test_connected_parts_above_the_limit_are_cut_at_medians(spark):
    df = spark.range(600).select(F.col("id").alias("row_id"), F.array((F.col("id") % 300).cast("double"), F.lit(1.0)).alias("features"))  # a line, every row twice
    got = linkage.average_linkage(df, [], spark.createDataFrame([(1.0,)], "cut double"), local_rows=50).toPandas()
    assert len(got) == 600 and got["row_id"].nunique() == 600
    wide = got.assign(x=got["row_id"] % 300).groupby("cluster")["x"].agg(["min", "max", "nunique"])
    assert (wide["max"] - wide["min"] + 1 == wide["nunique"]).all() and wide["nunique"].between(1, 2).all() and (wide["nunique"] == 2).mean() > 0.8


def test_degenerate(spark):
    df = spark.createDataFrame([(0, 3, [1.0]), (0, 2, [1.0]), (1, 1, [0.0]), (1, 5, [0.5])], "g int, row_id long, features array<double>")
    cuts = spark.createDataFrame([(1, 0.5), (7, 1.0)], "g int, cut double")
    assert sorted(tuple(r) for r in linkage.average_linkage(df, ["g"], cuts).collect()) == [(0, 2, 2), (0, 3, 2), (1, 1, 1), (1, 5, 1)]
    assert linkage.average_linkage(df.limit(0), ["g"], cuts).count() == 0
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)], "a long, b long")
    assert {r["node"]: r["part"] for r in linkage.connected(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_one_feature_meets_no_pairs(spark, monkeypatch):
    """Large groups of one feature fall into parts by their gaps, without a ball join; copies, a null group and a cut of 0 among them."""
    rng = np.random.default_rng(9)
    rows, cuts = [], [("a", 0.3), (None, 0.5), ("zero", 0.0), ("wide", 1.0)]
    for g, _ in cuts:
        x = np.round(rng.uniform(-20, 20, 60), 2)
        x[10:15] = x[9]
        rows += [(g, int(i), [float(v)]) for i, v in zip(rng.permutation(60), x if g != "wide" else np.arange(60) * 2.0 + (np.arange(60) % 3 == 0))]
    df = spark.createDataFrame(rows, "g string, row_id long, features array<double>").repartition(4)
    cut = spark.createDataFrame(cuts, "g string, cut double")
    monkeypatch.setattr(linkage, "Neighbours", None)
    got = {(r["g"], r["row_id"]): r["cluster"] for r in linkage.average_linkage(df, ["g"], cut, local_rows=30).collect()}
    assert got == {(g, i): c for g, c in cuts for i, c in brute([(r[1], r[2]) for r in rows if r[0] == g], c).items()} and len(got) == 240


@pytest.mark.parametrize("dim", [1, 2])
def test_connected_part_above_the_limit_is_whole(spark, dim):
    """One connected part of many times the limit: clusters are those of brute force, wherever a median would lie."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 40 if dim == 1 else 6, (90, dim)).round(3)
    x[20:26] = x[19]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(90), x)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>").repartition(4)
    want = brute(rows, 2.5)
    got = {r["row_id"]: r["cluster"] for r in linkage.average_linkage(df, [], spark.createDataFrame([(2.5,)], "cut double"), local_rows=30).collect()}
    assert got == want and 1 < len(set(want.values())) < 20


def test_order_of_joins_in_one_feature():
    """Ties go to the clusters of smaller first rows; long runs of equal gaps, rows without a value and weights."""
    x, one = np.arange(6.0), np.ones(6)
    assert linkage.in_order(x, one, 1.0).tolist() == [0, 0, 2, 2, 4, 4]
    assert linkage.in_order(x[::-1].copy(), one, 1.0).tolist() == [0, 0, 2, 2, 4, 4]
    assert linkage.in_order(np.array([5.0, np.nan, 5.5, 0.0, np.nan]), np.ones(5), 1.0).tolist() == [0, 1, 0, 3, 4]
    assert linkage.in_order(np.array([0.0, 1.0, 2.2]), np.array([9, 1, 1]), 2.0).tolist() == [0, 0, 2]
    assert linkage.in_order(np.zeros(0), np.zeros(0), 1.0).tolist() == []
