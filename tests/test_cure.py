"""Clusters by representatives against brute force, copies, groups and pieces."""

import numpy as np
from pyspark.sql import functions as F

from evenkeel.operators import cure


def brute(x, weight, clusters, reps=5, shrink=0.5):
    """Everything measured anew before every join; rounded distances, ties to the earlier clusters."""
    found = [[i] for i in range(len(x))]

    def gap(a, b):
        return round(float(np.sqrt(((a - b) ** 2).sum())), 9)

    def points(c):
        if len(c) == 1:
            return [x[c[0]]]
        mean = sum(x[i] * weight[i] for i in c) / sum(weight[i] for i in c)
        chosen = []
        for _ in range(min(reps, len(c))):
            far = max(c, key=lambda i: (min((gap(x[i], x[j]) for j in chosen), default=gap(x[i], mean)), -i))
            if chosen and min(gap(x[far], x[j]) for j in chosen) == 0:
                break
            chosen.append(far)
        return [x[i] + shrink * (mean - x[i]) for i in chosen]

    while len(found) > clusters:
        held = [points(c) for c in found]
        _, i, j = min((min(gap(a, b) for a in held[i] for b in held[j]), i, j) for i in range(len(found)) for j in range(i + 1, len(found)))
        found[i] = sorted(found[i] + found.pop(j))
    into = np.empty(len(x), "int64")
    for c in found:
        into[c] = c[0]
    return into


def test_agglomerate_matches_brute_force():
    rng = np.random.default_rng(9)
    for n, clusters in ((1, 1), (2, 1), (25, 3), (40, 8)):
        x, weight = rng.normal(size=(n, 2)).round(1), rng.integers(1, 4, n)
        x = np.unique(x, axis=0)
        weight = weight[:len(x)]
        assert (cure.agglomerate(x, weight, clusters) == brute(x, weight, clusters)).all()


def test_groups_copies_and_pieces(spark):
    rng = np.random.default_rng(10)
    rows = []
    for g, n in ((0, 50), (None, 30)):
        x = rng.normal(size=(n, 2)).round(2)
        x[:6] = x[6]
        rows += [(g, int(i), v.tolist()) for i, v in zip(rng.permutation(n), x)]
    df = spark.createDataFrame(rows, "g int, row_id long, features array<double>").repartition(4)
    got = {(r["g"], r["row_id"]): r["cluster"] for r in cure.cure(df, ["g"]).collect()}
    want = {}
    for g in (0, None):
        same = {}
        for _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            same.setdefault(tuple(v), []).append(i)
        ids = list(same.values())
        into = brute(np.array(list(same)), [len(i) for i in ids], max(2, sum(map(len, ids)) // 10))
        want |= {(g, i): ids[c][0] for own, c in zip(ids, into) for i in own}
    assert got == want
    cut = cure.cure(df.where("g = 0"), ["g"], local_rows=12).groupBy("cluster").agg(F.count("*").alias("n")).toPandas()
    assert cut["n"].sum() == 50 and 4 <= len(cut) <= 8
    assert cure.cure(df.limit(0), ["g"]).count() == 0
