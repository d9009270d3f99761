import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.methods import clustered, density, model_based, noise, smote  # noqa: F401
from evenkeel.methods.registry import METHODS, fit_resample, register
from evenkeel.operators import cluster, kernels

PAPER = [m for m in METHODS if m not in ("NoSMOTE", "SMBOND")]


def points(spark, n_min=12, n_maj=40, dim=2, seed=7, by=None):
    rng = np.random.default_rng(seed)
    rows = [(1, rng.normal(0, 1, dim)) for _ in range(n_min)] + [(0, rng.normal(0.8, 1, dim)) for _ in range(n_maj)]
    data = [(i, y, [float(v) for v in x]) for i, (y, x) in enumerate(rows)]
    if by is None:
        return spark.createDataFrame(data, "row_id bigint, label int, features array<double>")
    return spark.createDataFrame([(b, *r) for b in by for r in data], "ds string, row_id bigint, label int, features array<double>")


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_smote_rows_lie_between_base_and_neighbour(spark):
    df = points(spark)
    rows = collect(fit_resample(df, "SMOTE"))
    vec = {r["row_id"]: np.array(r["features"]) for r in rows if not r["is_synthetic"]}
    made = [r for r in rows if r["is_synthetic"]]
    assert len(made) == 28 and all(r["label"] == 1 for r in made) and len({r["row_id"] for r in made}) == 28
    for r in made:
        a, b = vec[r["base_id"]], vec[r["nbr_id"]]
        share = (np.array(r["features"]) - a) @ (b - a) / ((b - a) @ (b - a))
        assert 0 <= share < 1 and np.allclose(a + share * (b - a), r["features"])
    before = {r["row_id"]: r["features"] for r in collect(df)}
    assert {k: list(v) for k, v in vec.items()} == before


@pytest.mark.parametrize("method", ["SMOTE", "ADASYN", "SMOBD"])
def test_result_does_not_depend_on_partitions(spark, method):
    seen = []
    for parts in (1, 4, 16):
        made = collect(fit_resample(points(spark).repartition(parts), method).filter("is_synthetic"))
        seen.append(sorted((r["row_id"], r["base_id"], r["nbr_id"], tuple(round(v, 9) for v in r["features"])) for r in made))
    assert seen[0] == seen[1] == seen[2] and seen[0]


def test_groups_are_resampled_apart(spark):
    both = points(spark, by=["a", "b"])
    rows = collect(fit_resample(both.withColumn("features", F.when(
        F.col("ds") == "b", F.transform("features", lambda v: v + 100)).otherwise(F.col("features"))), "SMOTE", by=["ds"]))
    for ds, shift in (("a", 0), ("b", 100)):
        made = [r for r in rows if r["ds"] == ds and r["is_synthetic"]]
        assert len(made) == 28 and all(abs(r["features"][0] - shift) < 20 for r in made)


@pytest.mark.parametrize("method", PAPER)
def test_every_method_keeps_the_contract(spark, method):
    options = {"restarts": 1} if method in ("KMeans_SMOTE", "AKMeans_SMOTE", "cluster_SMOTE", "LVQ_SMOTE", "MWMOTE", "SSO") else {}
    rows = collect(fit_resample(points(spark, 12, 24), method, **options))
    old, made = [r for r in rows if not r["is_synthetic"]], [r for r in rows if r["is_synthetic"]]
    assert all(r["label"] == 1 and r["row_id"] < 0 and len(r["features"]) == 2 for r in made)
    assert len({r["row_id"] for r in rows}) == len(rows) and len(made) <= 14
    assert all(np.isfinite(r["features"]).all() for r in made)
    if method != "SMOTE_TomekLinks":
        assert len(old) == 36
    if method in ("SMOTE", "distance_SMOTE", "ROSE", "Gaussian_SMOTE", "NDO_sampling", "Random_SMOTE", "SMOBD", "ANS", "SYMPROD", "KMeans_SMOTE"):
        assert len(made) == 12


def test_tiny_classes(spark):
    one = points(spark, 1, 6)
    made = collect(fit_resample(one, "SMOTE").filter("is_synthetic"))
    base = collect(one.filter("label = 1"))[0]["features"]
    assert len(made) == 5 and all(r["features"] == base and r["nbr_id"] is None for r in made)
    two = collect(fit_resample(points(spark, 2, 6), "SMOTE").filter("is_synthetic"))
    assert len(two) == 4 and all({r["base_id"], r["nbr_id"]} == {0, 1} for r in two)
    assert fit_resample(points(spark, 5, 5), "SMOTE").filter("is_synthetic").isEmpty()
    assert fit_resample(points(spark, 0, 5), "SMOTE").count() == 5
    tiny = collect(fit_resample(one, "AKMeans_SMOTE", restarts=1).filter("is_synthetic"))
    assert len(tiny) == 5


def test_copies_and_constant_features(spark):
    rows = [(i, 1, [1.0, 5.0]) for i in range(6)] + [(10 + i, 0, [float(i), 5.0]) for i in range(15)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    for method in ("SMOTE", "ADASYN", "Safe_Level_SMOTE", "SMOTE_D", "ROSE", "SMOBD", "ANS", "CCR", "SYMPROD", "MWMOTE"):
        made = collect(fit_resample(df, method, restarts=1).filter("is_synthetic"))
        assert all(np.isfinite(r["features"]).all() for r in made), method


def test_bad_arguments(spark):
    df = points(spark)
    with pytest.raises(ValueError):
        fit_resample(df, k=0)
    with pytest.raises(ValueError):
        fit_resample(df, strategy="minority")
    with pytest.raises(KeyError):
        fit_resample(df, "NoSuchMethod")


def test_user_method(spark):
    @register("Doubling")
    def doubling(job):
        made = kernels.draw_uniform(job.slots, job.minority, job.grp, job.keys, job.seed)
        return kernels.as_synthetic(job.base_vec(made), job.by, F.col("x"))

    assert fit_resample(points(spark), "Doubling").filter("is_synthetic").count() == 28
    del METHODS["Doubling"]


def test_targets(spark):
    df = points(spark, 3, 10)
    assert {r["label"]: r["n_needed"] for r in kernels.targets(df).collect()} == {0: 0, 1: 7}
    assert {r["label"]: r["n_needed"] for r in kernels.targets(df, strategy=0.5).collect()} == {0: 0, 1: 2}
    assert {r["label"]: r["n_needed"] for r in kernels.targets(df, strategy={1: 4}).collect()} == {0: 0, 1: 1}


def test_allocation_and_stability(spark):
    stats = spark.createDataFrame([(1, 0, 5, 1.0), (1, 1, 4, 2.0), (1, 2, 3, 9.0), (1, 3, 2, 0.1)], "label int, cluster bigint, size bigint, sparsity double")
    good = cluster.stable(stats, ["label"])
    assert sorted(r["cluster"] for r in good.collect()) == [0, 1]  # median 2, limit 4; the pair is too small
    needs = spark.createDataFrame([(1, 10)], "label int, n_needed bigint")
    shares = {r["cluster"]: (r["n_needed"], r["offset"]) for r in cluster.allocate(good.withColumn("weight", 1 / F.col("sparsity")), needs, ["label"]).collect()}
    assert shares == {0: (7, 0), 1: (3, 7)}
    few = spark.createDataFrame([(1, 1)], "label int, n_needed bigint")
    shares = [r["n_needed"] for r in cluster.allocate(good.withColumn("weight", F.lit(1.0)), few, ["label"]).orderBy("cluster").collect()]
    assert shares == [1, 0]


def test_tomek_links(spark):
    rows = [(0, 0, [0.0]), (1, 1, [0.1]), (2, 0, [5.0]), (3, 0, [5.1]), (4, 1, [9.0])]
    df = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    assert sorted(r["row_id"] for r in smote.drop_tomek_links(df).collect()) == [2, 3, 4]


def test_sphere_radius(spark):
    """Energy 1: rows of the other class at 0.2 and 0.5 cost 0.2 + 2 * 0.3 = 0.8, the rest buys 0.2 / 3."""
    rows = [(0, 1, [0.0]), (1, 0, [0.2]), (2, 0, [-0.5]), (3, 0, [9.0]), (4, 0, [9.5])]
    df = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    out = {r["row_id"]: r["features"][0] for r in collect(fit_resample(df, "CCR").filter("NOT is_synthetic"))}
    r = 0.5 + 0.2 / 3
    assert np.allclose([out[1], out[2], out[3]], [r, -r, 9.0])


def test_no_validation_row_is_a_base(spark):
    from evenkeel.operators import split

    folds = split.expand_folds(split.stratified_folds(points(spark), k=3), 3)
    train = folds.filter("NOT is_val").drop("fold").withColumnRenamed("f", "fold").drop("is_val")
    made = collect(fit_resample(train, "SMOTE", by=["fold"]).filter("is_synthetic"))
    own = {(r["row_id"]): r["fold"] for r in collect(split.stratified_folds(points(spark), k=3))}
    assert made and all(own[r["base_id"]] != r["fold"] and own[r["nbr_id"]] != r["fold"] for r in made)


def test_kth_distance(spark):
    rng = np.random.default_rng(2)
    mat = np.vstack([rng.normal(size=(40, 2)), np.zeros((10, 2))])
    refs = spark.createDataFrame([(1, i, [float(v) for v in r]) for i, r in enumerate(mat)], "label int, row_id bigint, features array<double>")
    got = {r["row_id"]: r["reach"] for r in clustered.kth_distance(refs.withColumn("want", F.lit(20)), refs, ["label"]).collect()}
    d = np.sort(np.round(np.sqrt(((mat[:, None] - mat) ** 2).sum(-1)), 9), axis=1)[:, 19]
    assert np.allclose([got[i] for i in range(50)], d, atol=1e-12)


def test_xmeans_finds_separate_clusters(spark):
    rng = np.random.default_rng(5)
    mat = np.vstack([rng.normal(c, 0.05, (20, 2)) for c in (0, 10, 20, 30)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(mat)], "row_id bigint, features array<double>")
    assert cluster.estimate_k(df) == {(): 4}
    assert cluster.estimate_k(df.limit(1)) == {(): 1}
