import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions.rng import normal, pick, raw32, uniform
from evenkeel.functions import blocks
from evenkeel.functions.vectors import distance, lerp
from evenkeel.operators import scan
from evenkeel.operators.quantiles import exact_quantiles


def test_draws_follow_the_hash(spark):
    row = spark.range(1).select(raw32(42, "u", F.lit(7)).alias("r"), raw32(42, "x", "id", F.lit("k")).alias("s")).first()
    assert row["r"] == int(hashlib.md5(b"42|u|7").hexdigest()[:8], 16)
    assert row["s"] == int(hashlib.md5(b"42|x|0|k").hexdigest()[:8], 16)


def test_draws_have_the_right_shape(spark):
    stats = spark.range(20000).select(
        uniform(1, "u", "id").alias("u"), normal(1, "z", "id").alias("z"), pick(1, "p", F.lit(7), "id").alias("p")).agg(
        F.avg("u").alias("mu"), F.avg("z").alias("mz"), F.stddev("z").alias("sz"), F.min("p").alias("lo"), F.max("p").alias("hi"),
        F.countDistinct("p").alias("np")).first()
    assert abs(stats["mu"] - 0.5) < 0.01 and abs(stats["mz"]) < 0.03 and abs(stats["sz"] - 1) < 0.03
    assert (stats["lo"], stats["hi"], stats["np"]) == (0, 6, 7)


def test_vector_arithmetic(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(distance(F.col("a"), F.col("b")).alias("d"), lerp(F.col("a"), F.col("b"), F.lit(0.25)).alias("l")).first()
    assert row["d"] == 5.0 and row["l"] == [1.0, 2.25]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_running_sums_match_pandas(spark, parts):
    df = spark.range(500).select(
        (F.col("id") % 3).alias("g"), "id", uniform(5, "v", "id").alias("v")).repartition(parts)
    out = scan.running_sums(df, ["g"], ["v", "id"], F.floor(F.col("v") * 16).cast("int"), {"n": F.lit(1), "s": F.col("v")}).toPandas()
    want = df.toPandas().sort_values(["g", "v", "id"])
    want["n"] = want.groupby("g").cumcount() + 1
    want["s"] = want.groupby("g")["v"].cumsum()
    both = out.merge(want, on="id", suffixes=("", "_w"))
    assert (both["n"] == both["n_w"]).all() and np.allclose(both["s"], both["s_w"])
    assert (both["n_total"] == both.groupby("g")["id"].transform("count")).all()


def test_expand_numbers_every_copy(spark):
    df = spark.createDataFrame([("a", 0), ("b", 5), ("c", 20)], "k string, n int")
    out = scan.expand(df, "n", "rep", 4, chunk=3).groupBy("k").agg(F.count("rep").alias("n"), F.max("rep").alias("m"), F.sum("rep").alias("s"))
    assert {r["k"]: (r["n"], r["m"], r["s"]) for r in out.collect()} == {"b": (5, 5, 15), "c": (20, 20, 210)}


@pytest.mark.parametrize("direct", [10**6, 0])
def test_exact_quantiles(spark, direct, monkeypatch):
    from evenkeel.operators import quantiles

    monkeypatch.setattr(quantiles, "SMALL_ROWS", 50)
    rng = np.random.default_rng(1)
    data = {"a": np.exp(rng.normal(size=3000) * 3), "b": rng.integers(0, 4, 3000).astype(float), "c": np.full(3000, 2.5)}
    rows = [tuple(float(data[c][i]) if i % 7 else None for c in "abc") for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5, 0.9], direct_rows=direct)
    for c in "abc":
        want = np.quantile([r["abc".index(c)] for r in rows if r[0] is not None], [0.25, 0.5, 0.9])
        assert np.allclose(got[c], want, rtol=1e-12)


def test_median_of_an_even_count_is_the_middle(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5, 0.25]) == {"x": [3.0, 1.75]}
    assert exact_quantiles(df.filter("x > 99"), ["x"], [0.5]) == {"x": [None]}
    assert math.isclose(exact_quantiles(df, ["x"], [0.75], direct_rows=0)["x"][0], 5.25)


def test_distances_by_products_are_those_of_pairs():
    rng = np.random.default_rng(7)
    for dim, scale, digits in ((64, 1.0, 12), (24, 1e5, 12), (17, 1.0, 1)):
        q = (rng.normal(size=(60, dim)) * scale).round(digits)
        r = np.vstack([q[:30], (rng.normal(size=(150, dim)) * scale).round(digits)])
        want = np.stack([blocks.pair_distance(np.repeat(q[i : i + 1], len(r), axis=0), r) for i in range(len(q))])
        assert (blocks.all_distances(q, r) == want).all()
        radius = want[:, 40].copy()  # a reference lies on the border
        for closed in (True, False):
            rows, out = blocks.ball_stats(closed, False)(np.arange(60), q, {"radius": radius}, np.arange(180), r, {})
            hit = want <= radius[:, None] if closed else want < radius[:, None]
            assert (out["count"] == hit.sum(axis=1)[rows]).all() and hit.sum() == out["count"].sum()
            assert np.allclose(out["total"], (want * hit).sum(axis=1)[rows])


def test_few_pairs_are_measured_one_by_one(monkeypatch):
    q = np.random.default_rng(8).normal(size=(400, 32))
    asked = []
    whole = blocks.all_distances
    monkeypatch.setattr(blocks, "all_distances", lambda a, b: asked.append(len(a)) or whole(a, b))
    rows, out = blocks.ball_stats(True, False)(np.arange(400), q, {"radius": np.full(400, 0.5)}, np.arange(400), q, {})
    assert len(rows) == 400 and (out["count"] == 1).all() and not asked  # every distance was measured before


def test_a_share_is_computed_once_a_row(spark):
    df = spark.range(20).select(F.array(*[F.lit(0.0)] * 8).alias("a"), F.array(*[F.lit(1.0)] * 8).alias("b"))
    rows = df.select(lerp(F.col("a"), F.col("b"), F.rand(3)).alias("x")).collect()
    assert all(len(set(r["x"])) == 1 for r in rows) and len({r["x"][0] for r in rows}) > 1
    odd = spark.createDataFrame([([1.0, None], None, 0.5), ([1.0], [3.0], None)], "a array<double>, b array<double>, s double")
    assert [r[0] for r in odd.select(lerp(F.col("a"), F.col("b"), F.col("s"))).collect()] == [None, [None]]
