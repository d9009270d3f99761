"""Principal axes of all groups in one job against NumPy on each group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.methods import model_based  # noqa: F401  (registers the methods)
from evenkeel.methods.registry import fit_resample
from evenkeel.operators import moments

DDL = "ds string, label int, row_id bigint, features array<double>"


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(1)
    out = {}
    for i, (key, n) in enumerate([(("a", 0), 400), (("a", 1), 30), ((None, 0), 50), (("far", 2), 60)]):
        shift = 1e8 if key[0] == "far" else 0.0
        out[key] = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + shift + i
    return out | {("lone", 0): np.array([[1.0, 2, 3, 4]]), ("same", 1): np.full((7, 4), 5.0)}


@pytest.fixture(scope="module")
def frame(spark, groups):
    rows = [(*key, i, x.tolist()) for key, xs in groups.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, DDL).repartition(7)


@pytest.mark.parametrize("meets", [1, 3])
def test_as_numpy(frame, groups, monkeypatch, meets):
    monkeypatch.setattr(moments, "MEETS", meets)
    found = {(r["ds"], r["label"]): r for r in moments.axes(frame, ["ds", "label"]).collect()}
    assert found.keys() == groups.keys()
    for key, x in groups.items():
        r, n = found[key], len(x)
        cov = np.cov(x.T) if n > 1 else np.zeros((4, 4))
        ways, values = np.array(r["axes"]), np.array(r["variances"])
        scale = max(1.0, cov.max())
        assert r["n"] == n and np.allclose(r["mean"], x.mean(axis=0), rtol=1e-12)
        assert np.allclose(ways @ ways.T, np.eye(4), atol=1e-9) and (np.diff(values) <= 1e-9).all()
        assert np.allclose(ways.T @ np.diag(values) @ ways, cov, atol=1e-6 * scale)
        assert all(row[np.abs(row).argmax()] > 0 for row in ways)


def test_no_groups_and_no_rows(spark, frame, groups):
    whole = np.concatenate([groups["a", 0], groups["a", 1]])
    r = moments.axes(frame.where("ds = 'a'"), [], 2).collect()
    assert len(r) == 1 and len(r[0]["axes"]) == 2
    assert np.allclose(r[0]["variances"], np.linalg.eigvalsh(np.cov(whole.T))[::-1][:2])
    assert moments.axes(frame.limit(0), ["ds"]).count() == 0


@pytest.mark.parametrize("method", ["G_SMOTE", "MDO"])
def test_methods_take_all_groups(spark, method):
    """New rows of every (dataset, class) stay on its axes: G_SMOTE moves along the first one, MDO keeps the Mahalanobis distance of the base."""
    rng = np.random.default_rng(2)
    rows = [(ds, int(i >= 40), i, (rng.normal(size=3) * [3, 1, 0.5]).tolist()) for ds in ("a", None) for i in range(55)]
    rows += [("lone", int(i == 9), i, rng.normal(size=3).tolist()) for i in range(10)]
    out = fit_resample(spark.createDataFrame(rows, DDL), method, by=["ds"], k1=1).collect()
    axes = {}
    for ds in ("a", None):
        x = np.array([r[3] for r in rows if r[0] == ds and r[1] == 1])
        values, vectors = np.linalg.eigh(np.cov(x.T))
        axes[ds] = x.mean(axis=0), values, vectors
    base = {(r[0], r[2]): np.array(r[3]) for r in rows}
    made = [r for r in out if r["is_synthetic"]]
    assert sum(r["ds"] == "a" for r in made) == 25 and sum(r["ds"] == "lone" for r in made) == 8
    for r in made:
        old, new = base[r["ds"], r["base_id"]], np.array(r["features"])
        if r["ds"] == "lone":
            assert np.allclose(old, new)
            continue
        mean, values, vectors = axes[r["ds"]]
        if method == "G_SMOTE":
            assert np.allclose((new - old) @ vectors[:, :2], 0, atol=1e-9)
        else:
            assert np.isclose((((new - mean) @ vectors) ** 2 / values).sum(), (((old - mean) @ vectors) ** 2 / values).sum())


@pytest.mark.parametrize("q", [0.1, 2.0])
def test_sensitivity_as_sampled(q):
    """The closed form against many shifts of each row."""
    rng = np.random.default_rng(3)
    x, nodes, out = rng.normal(size=(4, 3)), rng.normal(size=(5, 3)), rng.normal(size=5)
    shifts = rng.uniform(-q, q, size=(200_000, 3))
    for row, got in zip(x, model_based.sensitivity(x, nodes, 0.9, out, q)):
        here = model_based.responses(row[None], nodes, 0.9) @ out
        want = np.mean((model_based.responses(row + shifts, nodes, 0.9) @ out - here) ** 2)
        assert np.isclose(got, want, rtol=0.02)


def test_sso_of_all_groups(spark):
    """Every group reaches its size; new rows lie within the shift of a base; the weights are those of a network fitted on the group alone."""
    rng = np.random.default_rng(4)
    rows = [(ds, int(i >= 30), i, rng.normal(size=2).tolist()) for ds in ("a", None) for i in range(40)]
    both = fit_resample(spark.createDataFrame(rows, DDL), "SSO", by=["ds"], clusters=4, restarts=1).collect()
    alone = fit_resample(spark.createDataFrame([r for r in rows if r[0] == "a"], DDL), "SSO", by=["ds"], clusters=4, restarts=1).collect()
    base = {(r[0], r[2]): np.array(r[3]) for r in rows}
    made = [r for r in both if r["is_synthetic"]]
    assert len(made) == 40 and all(np.abs(np.array(r["features"]) - base[r["ds"], r["base_id"]]).max() <= 0.1 for r in made)
    assert sorted(r["base_id"] for r in made if r["ds"] == "a") == sorted(r["base_id"] for r in alone if r["is_synthetic"])
