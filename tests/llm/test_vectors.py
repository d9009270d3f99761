"""Vector operators against brute force, with odd vectors, copies and ties."""

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from evenkeel.llm import embedding_dedup, topk
from evenkeel.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, n int, cell int"


def rows(seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(300):
        x = rng.standard_normal(24)
        out.append((i, x, i % 3))
        if i % 10 == 0:
            out += [(1000 + 20 * i + j, x + rng.standard_normal(24) * 0.05, i % 3) for j in range(12)]
    out += [(9000 + i, out[0][1], 0) for i in range(30)]
    odd = [(1, None, 0), (2, [], 0), (3, [0.0] * 24, 0), (4, [math.nan] * 24, 0), (5, [None] * 24, 0), (6, [1.0] * 24, None), (None, [1.0] * 24, 0), (7, [1.0, 2.0], 0)]
    return [(i, [float(np.float32(v)) for v in x], y, 1, 1) for i, x, y in out], [(None if i is None else 20_000 + i, x, y, 1, 1) for i, x, y in odd]


def test_topk(spark):
    good, odd = rows()
    df = spark.createDataFrame(good + odd + good[:5], SCHEMA)
    ints = {i: np.floor(256 * np.array(x)).astype(np.int64) for i, x, *_ in good}
    ints |= {20_003: np.zeros(24, np.int64), 20_006: np.full(24, 256)}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ ints[v]), v) for v in ints if v != q)[:5]
        want += [(q, r + 1, v, -s) for r, (s, v) in enumerate(best)]
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


def test_topk_wide_and_reused(spark):
    """Scores beyond every machine type, ids with several vectors, ties between them; against Python integers."""
    rng = np.random.default_rng(8)
    data = [(50, [1e6, 0.0]), (1, [1e6, 1.0]), (2, [3e5, 2.0]), (3, [2e6, 0.0]), (4, [1e300, -1e300]), (5, [1e300, 1.0]), (6, [-1.7e308, 1.7e308]), (100, [1e200, 3.0]),
            (100, [0.5, 0.25]), (7, [0.25, 1.0]), (7, [4.0, 2.0]), (150, [2.0, 2.0]), (150, [-3.0, 1.0]), (8, [1e6, 1.0]), (8, [1e6, 1.0]), (9, [1.0, 2.0, 3.0])]
    data += [(200 + i, (rng.standard_normal(2) * 10.0 ** rng.integers(-2, 12)).tolist()) for i in range(120)]
    rows = sorted({(i, tuple(x)) for i, x in data})
    whole = {r: [math.floor(Fraction(v) * 256) for v in r[1]] for r in rows}
    want = []
    for q in rows:
        if q[0] % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[v])), v[0]) for v in rows if v != q and len(v[1]) == len(q[1]))[:5]
            want += [(q[0], r + 1, v, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, v) in enumerate(best)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()) == sorted(want)
    some = df.where("vec_id < 4 OR vec_id IN (50, 150)")  # none of these is wide
    assert [r["vec_id"] for r in topk.search(some, F.col("vec_id") == 50).orderBy("rank").collect()] == [3, 1, 2, 150, 150]


def test_embedding_dedup_labels_and_reused_ids(spark):
    """Labels of any type are compared as they are; an id with two vectors has a result for each."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    for kind, x, y in (("double", 0.2, 0.7), ("string", "x", "y"), ("boolean", True, False), ("decimal(3,1)", Decimal("0.2"), Decimal("0.7"))):
        df = spark.createDataFrame([(1, a, x), (2, a, y), (3, a, x), (4, a, None)], f"vec_id long, embedding array<double>, label {kind}")
        assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect()) == [(1, 1, 1), (2, 0, 2), (3, 1, 1), (4, 0, 4)]
    df = spark.createDataFrame([(1, a, 0.0), (2, a, -0.0)], "vec_id long, embedding array<double>, label double")
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect()) == [(1, 1, 1), (2, 1, 1)]
    close = [1.0, 0.05, 0.0]
    rows = [(7, a, 1), (7, b, 1), (5, close, 1), (6, [0.0, 1.0, 0.05], 1), (4, [0.0, 1.0, 0.1], 1), (9, c, 1), (9, [0.0, 0.01, 1.0], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in got) == [(4, 2, 4), (5, 1, 5), (6, 2, 4), (7, 1, 5), (7, 2, 4), (9, 1, 9), (9, 1, 9)]


def test_embedding_dedup(spark):
    good, odd = rows()
    df = spark.createDataFrame(good + odd, SCHEMA)
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x, *_ in good}
    label = {i: y for i, _, y, *_ in good}
    near = {i: [j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.98] for i in unit}
    got = {r["id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(good) + len(odd)
    for i in unit:
        seen, todo = set(), {i}
        while todo:
            seen |= todo
            todo = set().union(*(near[x] for x in todo)) - seen
        assert (got[i]["n_links"], got[i]["component"]) == (len(near[i]), min(seen))
    assert all(got[i]["n_links"] == 0 and got[i]["component"] == i for i, *_ in odd)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (103, None), (104, 104)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
