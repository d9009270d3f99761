"""Codebooks with attraction and repulsion: falling error, the slope, tasks against jobs, brute force, odd groups."""

import numpy as np
from test_forest import DDL, data

from evenkeel.operators import lvq

STARTS = "ds string, label int, cluster bigint, center array<double>"


def starts(rows, per=3):
    out, seen = [], {}
    for ds, _, label, x in rows:
        i = seen.setdefault((ds, label), 0)
        if i < per:
            out.append((ds, label, i, x))
            seen[ds, label] += 1
    return out


def trained(spark, rows, first, **settings):
    books, errors = lvq.train(spark.createDataFrame(rows, DDL).repartition(3), ["ds"], spark.createDataFrame(first, STARTS), **settings)
    past = {}
    for r in sorted(errors.collect(), key=lambda r: r["round"]):
        past.setdefault(r["ds"], []).append(r["error"])
    return {(r["ds"], r["label"], r["cluster"]): np.array(r["center"]) for r in books.collect()}, past


def brute(rows, book):
    """Mean error and one round's moves, row by row."""
    error, weight, pull = 0.0, {k: 0.0 for k in book}, {k: 0.0 for k in book}
    for _, _, label, x in rows:
        gaps = {k: ((np.array(x) - w) ** 2).sum() for k, w in book.items()}
        own, other = (min((k for k in book if (k[0] == label) == side), key=lambda k: (gaps[k], k)) for side in (True, False))
        p, m = gaps[own], gaps[other]
        if p + m:
            error += (p - m) / (p + m)
            weight[own] += m / (p + m) ** 2
            pull[own] = pull[own] + m / (p + m) ** 2 * (np.array(x) - book[own])
            weight[other] += p / (p + m) ** 2
            pull[other] = pull[other] - p / (p + m) ** 2 * (np.array(x) - book[other])
    return error / len(rows), {k: book[k] + 0.5 * pull[k] / weight[k] if weight[k] else book[k] for k in book}


def test_one_round_as_brute_force(spark):
    rows = data(60, 3)
    first = starts(rows)
    books, past = trained(spark, rows, first, rounds=1)
    for ds in ("a", None):
        own = [r for r in rows if r[0] == ds]
        error, moved = brute(own, {(label, c): np.array(x) for d, label, c, x in first if d == ds})
        assert np.isclose(past[ds][0], error) and len(past[ds]) == 2
        assert np.isclose(past[ds][1], brute(own, moved)[0])
        assert all(np.allclose(books[ds, label, c], v) for (label, c), v in moved.items())


def test_error_falls_and_rows_are_told_apart(spark):
    rows = data(300, 2, seed=3)
    books, past = trained(spark, rows, starts(rows, 8))
    for ds in ("a", None):
        assert len(past[ds]) > 3 and (np.diff(past[ds]) < 0).all()
        keys = [k for k in books if k[0] == ds]
        x = np.array([r[3] for r in rows if r[0] == ds])
        near = np.array([((x - books[k]) ** 2).sum(axis=1) for k in keys]).argmin(axis=0)
        assert np.mean(np.array([keys[i][1] for i in near]) == [r[2] for r in rows if r[0] == ds]) > 0.8


def test_moves_follow_the_slope():
    rng = np.random.default_rng(1)
    x, y, book, own = rng.normal(size=(40, 3)), rng.integers(0, 2, 40), rng.normal(size=(4, 3)), np.array([0, 0, 1, 1])
    pull = lvq.tally(x, y, book, own)[2]
    for i, j in np.ndindex(4, 3):
        step = np.zeros((4, 3))
        step[i, j] = 1e-4
        slope = (lvq.tally(x, y, book + step, own)[0] - lvq.tally(x, y, book - step, own)[0]) / 2e-4
        assert np.isclose(slope, -4 * pull[i, j], atol=1e-3)


def test_tasks_and_jobs_agree(spark, monkeypatch):
    rows = data(80, 3)
    want, errors = trained(spark, rows, starts(rows), rounds=4)
    monkeypatch.setattr(lvq, "LOCAL", 10)
    monkeypatch.setattr(lvq, "TABLE_BYTES", 1)
    got, again = trained(spark, rows, starts(rows), rounds=4)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert all(np.allclose(again[ds], errors[ds]) for ds in errors)


def test_odd_groups(spark):
    rows = [("one", i, 1, [float(i)]) for i in range(5)] + [("on", i, i % 2, [2.0]) for i in range(6)] + [(None, i, i // 4, [float(i)]) for i in range(8)]
    first = [("one", 1, 0, [1.0]), ("on", 0, 0, [2.0]), ("on", 1, 0, [2.0]), (None, 0, 0, [0.0]), (None, 1, 0, [7.0]), ("gone", 0, 0, [1.0])]
    books, past = trained(spark, rows, first)
    assert books["one", 1, 0] == [1.0] and books["on", 0, 0] == books["on", 1, 0] == [2.0] and books["gone", 0, 0] == [1.0]
    assert past["on"] == [0.0] and "gone" not in past and past[None][-1] < past[None][0]
    assert abs(books[None, 0, 0][0] - 1.5) < 1.5
