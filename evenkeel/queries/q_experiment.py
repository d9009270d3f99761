"""Queries for classifiers and experiments on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions.vectors import dot, sum_vector
from evenkeel.methods import clustered, density, model_based, noise, smote  # noqa: F401  (register the methods)
from evenkeel.operators import classifiers as clf
from evenkeel.operators import split
from evenkeel.operators.runtime import settle
from evenkeel.operators.svm import FLOOR, RIDGE, KernelSVM
from evenkeel.plans import experiment, report
from evenkeel.queries.base import PTS, embedding_points, flat, knn, pick, query, table, u, with_
from evenkeel.queries.q_cluster import resample
from evenkeel.queries.q_metrics import evaluated, long_sql, r

# ---- SQL twin of split -> SMOTE -> two classifiers -> metrics -------------


def rank_in_class(stream: str) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {u(stream, 'row_id')}, row_id) AS rk,
  count(*) OVER (PARTITION BY label) AS n FROM pts)"""


FOLDS = [PTS, rank_in_class("fold"),
         "train AS (SELECT f::INT AS f, row_id, label, x FROM r CROSS JOIN range(0, 5) t(f) WHERE (rk - 1) % 5 <> f)",
         "val AS (SELECT ((rk - 1) % 5)::INT AS f, row_id, label, x FROM r)"]
HOLDOUT = [PTS, rank_in_class("split"),
           "train AS (SELECT 0 AS f, row_id, label, x FROM r WHERE rk > ceil(0.2::DOUBLE * n))",
           "val AS (SELECT 0 AS f, row_id, label, x FROM r WHERE rk <= ceil(0.2::DOUBLE * n))"]


def smote_by(keys: str, *first: str) -> list[str]:
    """CTEs from train to ``made``: SMOTE of label 1 within f; ``first`` are literals of group columns before f."""
    k = keys.split()
    return [
        "p AS (SELECT * FROM train WHERE label = 1)",
        "need AS (SELECT f, count(*) FILTER (label = 0) - count(*) FILTER (label = 1) AS g FROM train GROUP BY f)",
        "slots AS (SELECT f, unnest(range(1, g + 1)) AS rep FROM need)", knn("own", "p", "p", 5, by="f"),
        "ownk AS (SELECT f, q_id, count(*) AS kk FROM own GROUP BY f, q_id)",
        f"idx AS (SELECT f, row_id, row_number() OVER (PARTITION BY f ORDER BY {u('idx', 'row_id')}, row_id) AS idx, count(*) OVER (PARTITION BY f) AS n FROM p)",
        f"draw AS (SELECT s.f, s.rep, i.row_id AS base_id FROM slots s JOIN idx i ON i.f = s.f AND i.idx = {pick('base', 'i.n', *first, *[f's.{c}' for c in k], 1, 's.rep')} + 1)",
        f"""paired AS (SELECT d.*, o.nbr_id FROM draw d JOIN ownk k ON k.f = d.f AND k.q_id = d.base_id
  JOIN own o ON o.f = d.f AND o.q_id = d.base_id AND o.rk = {pick('nbr', 'k.kk', *first, *[f'd.{c}' for c in k], 1, 'd.rep')} + 1)""",
        f"""made AS (SELECT f, -(rep * 1000 + 1) AS row_id, 1 AS label, list(b + lam * (n - b) ORDER BY pos) AS x FROM (
  SELECT d.f, d.rep, {u('lam', *first, *[f'd.{c}' for c in k], 1, 'd.rep')} AS lam, pos, a.x[pos + 1] AS b, c.x[pos + 1] AS n FROM paired d
  JOIN p a ON a.f = d.f AND a.row_id = d.base_id JOIN p c ON c.f = d.f AND c.row_id = d.nbr_id CROSS JOIN range(0, 64) t(pos)) GROUP BY f, rep)""",
    ]


KNN_SQL = """near_ AS (SELECT v, f, q_id, y, nl FROM (SELECT t.v, a.f, a.row_id AS q_id, a.label AS y, b.row_id AS nid, b.label AS nl, round(list_distance(a.x, b.x), 9) AS d
  FROM val a JOIN fit b ON a.f = b.f JOIN (SELECT DISTINCT v FROM fit) t ON t.v = b.v) QUALIFY row_number() OVER (PARTITION BY v, f, q_id ORDER BY d, nid) <= 5),
knn_p AS (SELECT v, f, q_id, any_value(y) AS y, avg(nl) AS p1, 'kNN' AS classifier FROM near_ GROUP BY v, f, q_id)"""
NB_SQL = """mom AS (SELECT v, f, label, pos, avg(x[pos + 1]) AS mu, var_pop(x[pos + 1]) AS va, count(*) AS n FROM fit CROSS JOIN range(0, 64) t(pos) GROUP BY ALL),
top AS (SELECT v, f, max(va) AS top, max(n) AS big FROM (SELECT v, f, pos, var_pop(x[pos + 1]) AS va, count(*) AS n FROM fit CROSS JOIN range(0, 64) t(pos) GROUP BY ALL) GROUP BY v, f),
lik AS (SELECT v, f, q_id, y, label, ln(any_value(n) / any_value(big)) + sum(-0.5::DOUBLE * ln(2 * pi() * s2) - pow(xv - mu, 2) / (2 * s2)) AS ll FROM (
  SELECT m.v, m.f, a.row_id AS q_id, a.label AS y, m.label, a.x[m.pos + 1] AS xv, m.mu, m.va + 1e-9::DOUBLE * top AS s2, m.n, top.big FROM val a JOIN mom m ON m.f = a.f
  JOIN top ON top.v = m.v AND top.f = m.f) GROUP BY v, f, q_id, y, label),
nb_p AS (SELECT v, f, q_id, any_value(y) AS y, 1 / (1 + exp(max(ll) FILTER (label = 0) - max(ll) FILTER (label = 1))) AS p1, 'NaiveBayes' AS classifier
  FROM lik GROUP BY v, f, q_id)"""
PRED_SQL = "preds AS (SELECT v AS variant, f AS fold, classifier, q_id AS row_id, y, p1, (p1 > 0.5)::INT AS y_pred FROM (SELECT * FROM knn_p UNION ALL SELECT * FROM nb_p))"

# ---- classifiers ---------------------------------------------------------


def holdout_predictions(name: str):
    def run(spark, sf_dir):
        marked = split.stratified_holdout(embedding_points(spark, sf_dir))
        train, test = marked.filter("NOT is_test").drop("is_test"), marked.filter("is_test").drop("is_test")
        return clf.predict(name, train, test).withColumn("p1", F.round("p1", 6))

    return run


ONLY = "fit AS (SELECT 'original' AS v, * FROM train)"
query("f_knn", f"{with_(*HOLDOUT, ONLY, KNN_SQL)} SELECT q_id AS row_id, y, (p1 > 0.5)::INT AS y_pred, round(p1, 6) AS p1 FROM knn_p")(holdout_predictions("kNN"))
query("f_naive_bayes", f"{with_(*HOLDOUT, ONLY, NB_SQL)} SELECT q_id AS row_id, y, (p1 > 0.5)::INT AS y_pred, round(p1, 6) AS p1 FROM nb_p")(holdout_predictions("NaiveBayes"))


def sane(name: str, spark, sf_dir, least: float):
    """Rows, classes, and whether the predictions are shares that agree with the classes, fit the training rows and are right on more than half of the held-out rows."""
    marked = settle(split.stratified_holdout(embedding_points(spark, sf_dir)))
    every = settle(clf.predict(name, marked.filter("NOT is_test").drop("is_test"), marked.drop("is_test")).join(marked.select("row_id", "is_test"), "row_id"))
    preds, right = every.filter("is_test"), F.avg((F.col("y") == F.col("y_pred")).cast("double"))
    rank = preds.agg((right > 0.5).alias("better_than_coin"))
    fit = every.filter("NOT is_test").agg((right >= least).alias("learns"))
    seen = preds.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.min((F.col("p1").between(0, 1)) & ((F.col("p1") > 0.5).cast("int") == F.col("y_pred"))).alias("agrees"))
    return seen.crossJoin(fit).crossJoin(rank)  # one row each


for key, name, least in [("f_random_forest_fit", "RandomForest", 0.99), ("f_decision_tree_fit", "DecisionTree", 1.0),
                          ("f_boosted_trees_fit", "CatBoost", 0.95)]:
    query(key, f"{with_(*HOLDOUT)} SELECT count(*) AS n, sum(label)::BIGINT AS positives, true AS agrees, true AS learns, true AS better_than_coin FROM val")(
        lambda spark, sf_dir, name=name, least=least: sane(name, spark, sf_dir, least))


@query("f_svm_fit", f"{with_(*HOLDOUT)} SELECT count(*) AS n, sum(label)::BIGINT AS positives, true AS certified, true AS shares, true AS below_majority, true AS better_than_coin FROM val")
def svm_fit(spark, sf_dir):
    """Rows, classes, whether the objective is within a thousandth of the best one by the dual value and, within its gap, no higher than that of the larger class for all rows,
    shares are shares, and the margins are right on more than half of the held-out rows."""
    marked = settle(split.stratified_holdout(embedding_points(spark, sf_dir)))
    model = KernelSVM(marked.filter("NOT is_test"))
    every = settle(model.predict(marked, ["row_id", "label", "is_test"]))
    right, held = F.avg(((F.col("margin") > 0).cast("int") == F.col("label")).cast("double")), F.col("is_test")
    smaller = marked.filter("NOT is_test").agg((2 * F.least(F.sum("label"), F.sum(1 - F.col("label")))).alias("plain"))  # hinge of the rows of the smaller class
    fit = model.fits().crossJoin(smaller).agg(  # one row each
        F.min(F.col("gap") <= 1e-3 * F.greatest("objective", F.lit(FLOOR))).alias("certified"), F.min(F.col("objective") - F.col("gap") <= F.col("plain") + RIDGE / 2).alias("below_majority"))
    seen = every.filter(held).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.min(F.col("share").between(0, 1)).alias("shares"), (right > 0.5).alias("better_than_coin"))
    return seen.crossJoin(fit)  # one row each


@query("f_logistic_regression_fit", f"{with_(*HOLDOUT)} SELECT count(*) AS n, sum(label)::BIGINT AS positives, true AS balanced, true AS stationary, true AS agrees FROM val")
def logistic_fit(spark, sf_dir):
    """Rows, classes, and the conditions that only the optimum meets. With the ridge of C = 1 the weights are the sum of (y - p) x over the training rows, so the log odds
    of any row less that product are the offset, the same for all; and the training residuals sum to zero, as the offset has no ridge."""
    marked = settle(split.stratified_holdout(embedding_points(spark, sf_dir)))
    preds = clf.predict("LogisticRegression", marked.filter("NOT is_test").drop("is_test"), marked.drop("is_test"))
    every = settle(preds.join(marked.select("row_id", "features", "is_test"), "row_id"))
    left = F.col("y") - F.col("p1")
    weights = every.filter("NOT is_test").agg(
        sum_vector(F.transform("features", lambda x: x * left)).alias("w"), (F.abs(F.sum(left)) <= 1e-4 * F.count(F.lit(1))).alias("balanced"))
    odds = F.log(F.col("p1") / (1 - F.col("p1"))) - dot(F.col("w"), F.col("features"))
    held = F.col("is_test")
    return every.crossJoin(F.broadcast(weights)).groupBy("balanced").agg(  # one row of weights
        F.count_if(held).alias("n"), F.sum(F.when(held, F.col("y"))).alias("positives"), (F.stddev_pop(odds) <= 1e-3).alias("stationary"),
        F.min((F.col("p1") > 0.5).cast("int") == F.col("y_pred")).alias("agrees"))


for key, name in [("f_random_forest", "RandomForest"), ("f_logistic_regression", "LogisticRegression"),
                  ("f_decision_tree", "DecisionTree"), ("f_boosted_trees", "CatBoost"), ("f_svm", "SVM")]:
    query(key)(holdout_predictions(name))

# ---- experiments ---------------------------------------------------------

PAIR = ["kNN", "NaiveBayes"]
CV_SQL = with_(*FOLDS, *smote_by("f"),
               "fit AS (SELECT 'x' AS v, f, row_id, label, x FROM train UNION ALL SELECT 'x', f, row_id, label, x FROM made)",
               KNN_SQL, NB_SQL, PRED_SQL, evaluated("classifier, fold"))
WANTED = ", ".join(f'round("{m}", 6) AS "{m}"' for m in report.PRIORITY_METRICS)
SIZES = """(SELECT f AS fold, count(*) AS train_samples FROM fit GROUP BY f) JOIN (SELECT f AS fold, count(*) AS val_samples FROM val GROUP BY f) USING (fold)"""
query("x_cross_validation", f"{CV_SQL} SELECT fold, classifier, train_samples, val_samples, {WANTED} FROM ev JOIN {SIZES} USING (fold)")(
    lambda spark, sf_dir: r(experiment.cross_validate(embedding_points(spark, sf_dir), "SMOTE", PAIR).select(
        "fold", "classifier", "train_samples", "val_samples", *report.PRIORITY_METRICS)))
BASE_SQL = with_(*FOLDS, "fit AS (SELECT 'x' AS v, * FROM train)", KNN_SQL, NB_SQL, PRED_SQL, evaluated("classifier, fold"),
                 long_sql("classifier, fold", report.PRIORITY_METRICS))
query("x_baseline_summary", f"""{BASE_SQL} SELECT 'embeddings' AS dataset, 'Original' AS method, classifier, metric, round(avg(value), 6) AS mean,
  round(stddev_pop(value), 6) AS std FROM long GROUP BY classifier, metric""")(
    lambda spark, sf_dir: r(experiment.summarise(
        experiment.cross_validate(embedding_points(spark, sf_dir), "Original", PAIR), "embeddings", "Original")))
FINAL_SQL = with_(*HOLDOUT, *smote_by(""),
                  """fit AS (SELECT 'original' AS v, f, row_id, label, x FROM train UNION ALL SELECT 'resampled', f, row_id, label, x FROM train
  UNION ALL SELECT 'resampled', f, row_id, label, x FROM made)""",
                  KNN_SQL, NB_SQL, PRED_SQL, evaluated("variant, classifier"), long_sql("variant, classifier", report.PRIORITY_METRICS))
query("x_final_evaluation", f"""{FINAL_SQL} SELECT 'embeddings' AS dataset, 'SMOTE' AS method, classifier, metric,
  round(max(value) FILTER (variant = 'original'), 6) AS original, round(max(value) FILTER (variant = 'resampled'), 6) AS resampled,
  round(max(value) FILTER (variant = 'resampled') - max(value) FILTER (variant = 'original'), 6) AS improvement FROM long GROUP BY classifier, metric""")(
    lambda spark, sf_dir: r(experiment.changes(experiment.final(embedding_points(spark, sf_dir), "SMOTE", PAIR), "embeddings", "SMOTE")))

TRAINING = [PTS.replace("pts AS", "everyone AS", 1), rank_in_class("split").replace("r AS", "ranked AS", 1).replace("FROM pts", "FROM everyone"),
            "pts AS (SELECT row_id, label, x FROM ranked WHERE rk > ceil(0.2::DOUBLE * n))", *FOLDS[1:]]


def training_cv(stage: str, *fit: str) -> str:
    ctes = with_(*TRAINING, *fit, KNN_SQL, NB_SQL, PRED_SQL, evaluated("classifier, fold"), long_sql("classifier, fold", report.PRIORITY_METRICS))
    return f"SELECT '{stage}' AS stage, * FROM ({ctes} SELECT classifier, metric, avg(value) AS value, stddev_pop(value) AS std FROM long GROUP BY classifier, metric)"


ENDS = f"""{FINAL_SQL} SELECT classifier, metric, max(value) FILTER (variant = 'original') AS a, max(value) FILTER (variant = 'resampled') AS b
FROM long GROUP BY classifier, metric"""
query("x_experiment", f"""SELECT 'embeddings' AS dataset, 'SMOTE' AS method, classifier, stage, metric, round(value, 6) AS value, round(std, 6) AS std FROM (
{training_cv('baseline_cv', "fit AS (SELECT 'x' AS v, * FROM train)")}
UNION ALL {training_cv('resampled_cv', *smote_by("f"), "fit AS (SELECT 'x' AS v, f, row_id, label, x FROM train UNION ALL SELECT 'x', f, row_id, label, x FROM made)")}
UNION ALL SELECT stage, classifier, metric, CASE stage WHEN 'original' THEN a WHEN 'resampled' THEN b ELSE b - a END, NULL::DOUBLE
FROM ({ENDS}) CROSS JOIN (VALUES ('original'), ('resampled'), ('improvement')) s(stage))""")(
    lambda spark, sf_dir: r(experiment.run(embedding_points(spark, sf_dir), "embeddings", "SMOTE", PAIR)))


@query("x_akmeans_against_kmeans")
def x_comparison(spark, sf_dir):
    """The two adaptive k-means methods and the unbalanced baseline, five folds, forest, logistic regression and nearest neighbours, as a comparison table."""
    cv = experiment.grid({"embeddings": embedding_points(spark, sf_dir)}, ["AKMeans_SMOTE", "KMeans_SMOTE"])
    return report.comparison(cv, methods=["AKMeans_SMOTE", "KMeans_SMOTE"])


query("o_sso_fit")(resample("SSO"))


@query("x_search_k")
def x_search_k(spark, sf_dir):
    """Adaptive k-means SMOTE with the number of clusters searched by cross-validation."""
    from evenkeel.methods.registry import fit_resample

    return flat(fit_resample(embedding_points(spark, sf_dir), "AKMeans_SMOTE", search_k=True))


def grid_sql() -> str:
    parts = []
    for name, cut in (("left", "[1:32]"), ("right", "[33:64]")):
        fits = {"Original": ["fit AS (SELECT 'x' AS v, * FROM train)"], "SMOTE": [
            *smote_by("f", f"'{name}'"), "fit AS (SELECT 'x' AS v, f, row_id, label, x FROM train UNION ALL SELECT 'x', f, row_id, label, x FROM made)"]}
        for method, fit in fits.items():
            ctes = with_(PTS.replace("embedding::DOUBLE[]", f"(embedding::DOUBLE[]){cut}"), *FOLDS[1:], *fit, KNN_SQL, NB_SQL, PRED_SQL, evaluated("classifier, fold"),
                         long_sql("classifier, fold", report.PRIORITY_METRICS)).replace("range(0, 64)", "range(0, 32)")
            parts.append(f"""SELECT * FROM ({ctes} SELECT '{name}' AS dataset, '{method}' AS method, classifier, metric, round(avg(value), 6) AS mean,
  round(stddev_pop(value), 6) AS std FROM long GROUP BY classifier, metric)""")
    return " UNION ALL ".join(parts)


@query("x_grid", grid_sql())
def x_grid(spark, sf_dir):
    """Both halves of the embeddings as datasets of one plan a method."""
    points = embedding_points(spark, sf_dir)
    halves = {name: points.withColumn("features", F.slice("features", start, 32)) for name, start in (("left", 1), ("right", 33))}
    return r(experiment.grid(halves, ["SMOTE"], PAIR))
