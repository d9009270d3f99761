"""Kernel machines: against an exact dual solver, whole groups in tasks against a job a step, certificates, shares, odd groups."""

import numpy as np
import pytest
from test_forest import DDL, data

from evenkeel.operators import classifiers, svm


def kernel(a, b, gamma):
    return np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(axis=2))


def exact(x, y, gamma, cost=1.0, turns=100_000):
    """Dual steps on the pair of rows that violates its conditions most, on the full kernel: margins on any rows, and the objective."""
    k = kernel(x, x, gamma)
    alpha, lean = np.zeros(len(y)), y.astype(float).copy()  # lean: minus y times the gradient
    for _ in range(turns):
        up, low = np.where(y > 0, alpha < cost, alpha > 0), np.where(y > 0, alpha > 0, alpha < cost)
        i, j = int(np.where(up, lean, -np.inf).argmax()), int(np.where(low, lean, np.inf).argmin())
        if lean[i] - lean[j] < 1e-9:
            break
        room = min(cost - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost - alpha[j])
        move = min(room, (lean[i] - lean[j]) / max(1e-12, k[i, i] + k[j, j] - 2 * k[i, j]))
        alpha[i] += y[i] * move
        alpha[j] -= y[j] * move
        lean -= move * (k[i] - k[j])
    offset = (lean[i] + lean[j]) / 2
    own = k @ (alpha * y)
    objective = float((alpha * y) @ own) / 2 + cost * np.maximum(0, 1 - y * (own + offset)).sum()
    return lambda z: kernel(z, x, gamma) @ (alpha * y) + offset, objective


def arrays(rows, ds):
    own = [r for r in rows if r[0] == ds]
    return np.array([r[3] for r in own]), np.array([2.0 * r[2] - 1 for r in own])


def found(model, df):
    return {(r["ds"], r["row_id"]): (r["margin"], r["share"]) for r in model.predict(df).collect()}


def close(got, want, atol):
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()), atol=atol)


def test_exact_on_small_groups(spark):
    """Up to ``landmarks`` distinct rows the machine is the exact one: its objective within the gap, margins near."""
    rows, unseen = data(90, 3, seed=7), data(50, 3, seed=8)
    model = svm.KernelSVM(spark.createDataFrame(rows, DDL), ["ds"], tol=1e-6)
    got = found(model, spark.createDataFrame(unseen, DDL))
    fits = {r["ds"]: r for r in model.fits().collect()}
    for ds in ("a", None):
        x, y = arrays(rows, ds)
        margins, objective = exact(x, y, 1 / (3 * x.var()))
        assert 0 <= fits[ds]["gap"] <= 1e-6 * fits[ds]["objective"] and abs(fits[ds]["objective"] - objective) <= 1e-5 * objective
        z, _ = arrays(unseen, ds)
        assert np.allclose([got[ds, i][0] for i in range(50)], margins(z), atol=0.02)


def test_tasks_and_jobs_agree(spark, monkeypatch):
    df = spark.createDataFrame(data(100, 3), DDL).repartition(3)
    unseen = spark.createDataFrame(data(40, 3, seed=6) + [("other", 1, 0, [0.0] * 3)], DDL)
    settings = {"landmarks": 20, "tol": 1e-2}
    want = found(svm.KernelSVM(df, ["ds"], **settings), unseen)
    assert len(want) == 80
    monkeypatch.setattr(svm, "LOCAL", 10)
    monkeypatch.setattr(svm, "STEP_ROWS", 7)
    monkeypatch.setattr(svm, "MEETS", 2)
    close(found(svm.KernelSVM(df, ["ds"], **settings), unseen), want, 1e-6)
    monkeypatch.setattr(svm, "MODEL_BYTES", 1)  # one group at a time
    close(found(svm.KernelSVM(df, ["ds"], **settings), unseen), want, 1e-6)


def test_landmarks_and_accuracy(spark):
    """A tenth of the rows as landmarks decide like the exact machine on nearly all unseen rows."""
    rows, unseen = data(900, 2, seed=1, groups=("a",)), data(600, 2, seed=2, groups=("a",))
    model = svm.KernelSVM(spark.createDataFrame(rows, DDL), ["ds"], landmarks=90)
    got = found(model, spark.createDataFrame(unseen, DDL))
    x, y = arrays(rows, "a")
    z, truth = arrays(unseen, "a")
    want = exact(x, y, 1 / (2 * x.var()))[0](z)
    mine = np.array([got["a", i][0] for i in range(600)])
    assert np.mean((mine > 0) == (want > 0)) > 0.97 and np.mean((mine > 0) == (truth > 0)) > 0.8


@pytest.mark.parametrize("h", [1.0, 0.05])
def test_dual_never_passes_the_objective(h):
    """Weak duality holds at any point, so the gap is a bound however the fit got there."""
    rng = np.random.default_rng(2)
    z, y = np.column_stack([rng.normal(size=(50, 4)), np.ones(50)]), rng.choice([-1.0, 1.0], 50)
    for _ in range(20):
        u = rng.normal(size=5) * 10 ** rng.uniform(-3, 1)
        state = svm.step(svm.State(u, h), svm.tally(z, y, u, h), 1.0)
        assert state.dual <= state.objective + 1e-9


def test_shares_are_honest_on_noise(spark):
    """On labels without a pattern the machine fits its rows, but shares from unseen margins stay near the share of positives."""
    rng = np.random.default_rng(3)
    rows = [("n", i, int(rng.random() < 0.4), rng.normal(size=6).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, DDL)
    got = found(svm.KernelSVM(df, ["ds"]), df)
    shares = np.array([p for _, p in got.values()])
    right = np.mean([(got["n", r[1]][0] > 0) == r[2] for r in rows])
    assert right > 0.65 and abs(np.median(shares) - 0.4) < 0.15 and shares.max() < 0.8


def test_logistic_matches_its_optimum():
    rng = np.random.default_rng(4)
    margin, n = rng.normal(size=40), rng.integers(1, 9, 40).astype(float)
    y = np.where(rng.random(40) < 1 / (1 + np.exp(-2 * margin)), 1.0, -1.0)
    a, b = svm.logistic(margin, y, n)
    up, down = n[y > 0].sum(), n[y < 0].sum()
    want = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    p = 1 / (1 + np.exp(-(a * margin + b)))
    assert abs(n @ (p - want)) < 1e-6 and abs((n * (p - want)) @ margin) < 1e-6


@pytest.mark.parametrize("local", [1, 1 << 12])
def test_odd_groups(spark, monkeypatch, local):
    monkeypatch.setattr(svm, "LOCAL", local)
    rows = [("one", i, 1, [float(i)]) for i in range(5)] + [("copies", i, i % 2, [3.0]) for i in range(8)] + [("lone", 1, 0, [1.0])]
    rows += [(None, i, i // 15, [float(i)]) for i in range(30)] + [("twice", 1, 1, [1.0])] * 3 + [("twice", 2, 0, [-1.0])] * 3
    df = spark.createDataFrame(rows, DDL)
    model = svm.KernelSVM(df, ["ds"])
    got = found(model, df)
    assert len(got) == 46 and all(0 < p < 1 for _, p in got.values())
    assert all(got["one", i][0] > 0.9 for i in range(5)) and got["lone", 1][0] < -0.9
    assert got[None, 0][0] < 0 < got[None, 29][0] and got["twice", 2][0] < 0 < got["twice", 1][0]
    assert all(r["gap"] <= 1e-3 * max(r["objective"], svm.FLOOR) for r in model.fits().collect())
    empty = svm.KernelSVM(df.limit(0), ["ds"])
    assert empty.predict(df).count() == 0 and empty.fits().count() == 0


def test_as_classifier(spark):
    rows = data(120, 3, seed=9)
    df = spark.createDataFrame(rows, DDL)
    out = classifiers.predict("SVM", df, df, ["ds"]).collect()
    assert len(out) == 240 and set(out[0].asDict()) == {"ds", "row_id", "y", "y_pred", "p1"}
    assert np.mean([r["y"] == r["y_pred"] for r in out]) > 0.8
