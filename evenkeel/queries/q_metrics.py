"""Queries for metrics, curves and comparison reports on a prediction table derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions.rng import uniform
from evenkeel.methods.registry import fit_resample
from evenkeel.operators import metrics
from evenkeel.operators.runtime import settle, spread
from evenkeel.plans import report
from evenkeel.queries.base import embedding_points, query, table, u, with_
from evenkeel.queries.q_split import LINE_ID, line_id

CLASSIFIERS = ["kNN", "LogisticRegression", "RandomForest"]


def predictions(spark, sf_dir):
    """Per line item and variant a seeded score that leans towards the true label, in 5 folds."""
    y = ((F.col("l_quantity") >= 25) & (F.col("l_discount") >= 0.05)).cast("int")
    # the return flag names the dataset
    base = spread(table(spark, sf_dir, "lineitem")).select(line_id().alias("row_id"), F.col("l_returnflag").alias("dataset"), y.alias("y"))
    names = F.array(*[F.lit(c) for c in CLASSIFIERS])
    methods = F.array(F.lit("AKMeans_SMOTE"), F.lit("KMeans_SMOTE"))
    tagged = base.select(
        "*", F.get(names, F.floor(uniform(42, "clf", "row_id") * 3).cast("int")).alias("classifier"),
        F.get(methods, F.floor(uniform(42, "method", "row_id") * 2).cast("int")).alias("method"),
        F.floor(uniform(42, "cvfold", "row_id") * 5).cast("int").alias("fold"),
        F.explode(F.array(F.lit("original"), F.lit("resampled"))).alias("variant"))
    lean = F.when(F.col("variant") == "original", 0.2).otherwise(0.35)
    p1 = F.round((1 - lean) * uniform(42, "score", "row_id", "variant") + lean * F.col("y"), 3)
    return tagged.withColumn("p1", p1).withColumn("y_pred", (F.col("p1") > 0.5).cast("int"))


PREDS = f"""base_ AS (SELECT {LINE_ID} AS row_id, l_returnflag AS dataset, (l_quantity >= 25 AND l_discount >= 0.05::DOUBLE)::INT AS y FROM lineitem),
tagged AS (SELECT *, ['kNN', 'LogisticRegression', 'RandomForest'][floor({u('clf', 'row_id')} * 3)::INT + 1] AS classifier,
  ['AKMeans_SMOTE', 'KMeans_SMOTE'][floor({u('method', 'row_id')} * 2)::INT + 1] AS method,
  floor({u('cvfold', 'row_id')} * 5)::INT AS fold, variant FROM base_ CROSS JOIN (VALUES ('original'), ('resampled')) v(variant)),
scored AS (SELECT *, round((1 - lean) * {u('score', 'row_id', 'variant')} + lean * y, 3) AS p1 FROM (
  SELECT *, CASE variant WHEN 'original' THEN 0.2::DOUBLE ELSE 0.35::DOUBLE END AS lean FROM tagged)),
preds AS (SELECT *, (p1 > 0.5)::INT AS y_pred FROM scored)"""


def conf(by: str) -> str:
    return f"""conf AS (SELECT {by}, count(*) FILTER (y = 0 AND y_pred = 0) AS tn, count(*) FILTER (y = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (y = 1 AND y_pred = 0) AS fn, count(*) FILTER (y = 1 AND y_pred = 1) AS tp FROM preds GROUP BY {by})"""


def auc(by: str) -> str:
    return f"""rnk AS (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY p1) + (count(*) OVER (PARTITION BY {by}, p1) - 1) / 2 AS r FROM preds),
auc AS (SELECT {by}, (sum(r) FILTER (y = 1) - (sum(y) * (sum(y) + 1)) / 2) / (sum(y) * (count(*) - sum(y))) AS roc_auc FROM rnk GROUP BY {by})"""


def div(a, b):
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END"


def evaluated(by: str) -> str:
    """CTEs up to ``ev`` with every metric."""
    return f"""{conf(by)}, {auc(by)},
r0 AS (SELECT *, {div('tp', 'tp + fn')} AS tpr, {div('fp', 'tn + fp')} AS fpr, {div('tn', 'tn + fp')} AS tnr, {div('fn', 'tp + fn')} AS fnr,
  {div('tp', 'tp + fp')} AS p1_, {div('tn', 'tn + fn')} AS p0_, {div('2 * tp', '2 * tp + fp + fn')} AS f1_, {div('2 * tn', '2 * tn + fp + fn')} AS f0_,
  (tp + fn + fp > 0)::INT AS h1, (tn + fp + fn > 0)::INT AS h0, tp + fn AS n1, tn + fp AS n0 FROM conf),
ev AS (SELECT * EXCLUDE (p1_, p0_, f1_, f0_, h1, h0, n1, n0, roc_auc), tnr AS specificity, (tp + tn) / (n0 + n1) AS accuracy,
  (p0_ * n0 + p1_ * n1) / (n0 + n1) AS "precision", (p0_ * h0 + p1_ * h1) / (h0 + h1) AS precision_macro, (p0_ * n0 + p1_ * n1) / (n0 + n1) AS precision_weighted,
  (tnr * n0 + tpr * n1) / (n0 + n1) AS recall, (tnr * h0 + tpr * h1) / (h0 + h1) AS recall_macro, (tnr * n0 + tpr * n1) / (n0 + n1) AS recall_weighted,
  (f0_ * n0 + f1_ * n1) / (n0 + n1) AS f1, (f0_ * h0 + f1_ * h1) / (h0 + h1) AS f1_macro, (f0_ * n0 + f1_ * n1) / (n0 + n1) AS f1_weighted,
  (tnr + tpr) / ((n0 > 0)::INT + (n1 > 0)::INT) AS balanced_accuracy, sqrt(tpr * tnr) AS g_mean,
  roc_auc, roc_auc AS roc_auc_macro, roc_auc AS roc_auc_weighted FROM r0 JOIN auc USING ({by}))"""


def long_sql(by: str, names=metrics.METRICS) -> str:
    cells = " UNION ALL ".join(f"SELECT {by}, '{m}' AS metric, \"{m}\"::DOUBLE AS value FROM ev" for m in names)
    return f"long AS ({cells})"


FOLD = "classifier, fold"
query("m_confusion", f"{with_(PREDS, conf(FOLD))} SELECT * FROM conf")(
    lambda spark, sf_dir: metrics.confusion(predictions(spark, sf_dir), ["classifier", "fold"]))


def rounded_metrics(df, names):
    return df.withColumns({m: F.round(F.col(m), 6) for m in names})


ROUND = ", ".join(f'round("{m}", 6) AS "{m}"' for m in metrics.METRICS)
query("m_all_metrics", f"{with_(PREDS, evaluated(FOLD))} SELECT {FOLD}, tn, fp, fn, tp, {ROUND} FROM ev")(
    lambda spark, sf_dir: rounded_metrics(metrics.evaluate(predictions(spark, sf_dir), ["classifier", "fold"]), metrics.METRICS))
query("m_overall", f"{with_(PREDS.replace('base_ AS (SELECT', 'base_ AS (SELECT 1 AS one_,'), evaluated('one_'))} SELECT tn, fp, fn, tp, {ROUND} FROM ev")(
    lambda spark, sf_dir: rounded_metrics(metrics.evaluate(predictions(spark, sf_dir)), metrics.METRICS))
query("m_fp_rate", f"{with_(PREDS, evaluated('variant'))} SELECT variant, round(fpr, 6) AS fp_rate FROM ev")(
    lambda spark, sf_dir: metrics.fp_rate(predictions(spark, sf_dir), ["variant"]).withColumn("fp_rate", F.round("fp_rate", 6)))
query("m_long_form", f"{with_(PREDS, evaluated(FOLD), long_sql(FOLD))} SELECT {FOLD}, metric, round(value, 6) AS value FROM long")(
    lambda spark, sf_dir: metrics.long_form(metrics.evaluate(predictions(spark, sf_dir), ["classifier", "fold"]), ["classifier", "fold"]).withColumn(
        "value", F.round("value", 6)))
query("m_roc_auc", f"{with_(PREDS, auc('variant'))} SELECT variant, round(roc_auc, 6) AS roc_auc FROM auc")(
    lambda spark, sf_dir: metrics.roc_auc(predictions(spark, sf_dir), ["variant"]).withColumn("roc_auc", F.round("roc_auc", 6)))

SWEEP = """g AS (SELECT variant, p1, sum(y) AS pos, count(*) - sum(y) AS neg FROM preds GROUP BY 1, 2),
sw AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY variant) AS np, sum(neg) OVER (PARTITION BY variant) AS nn
  FROM g WINDOW w AS (PARTITION BY variant ORDER BY p1 DESC))"""


def curve(df, *cols):
    """The end point has threshold 2, above every score."""
    return df.withColumns({c: F.round(F.coalesce(F.col(c), F.lit(2.0)), 6) for c in ("threshold", *cols)})


query("v_roc_points", f"{with_(PREDS, SWEEP)} SELECT variant, round(p1, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM sw UNION ALL SELECT DISTINCT variant, 2.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM preds")(
    lambda spark, sf_dir: curve(metrics.roc_points(predictions(spark, sf_dir), ["variant"]), "fpr", "tpr"))
query("v_pr_points", f"{with_(PREDS, SWEEP)} SELECT variant, round(p1, 6) AS threshold, round(tp / np, 6) AS recall, round(tp / (tp + fp), 6) AS \"precision\" FROM sw UNION ALL SELECT DISTINCT variant, 2.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM preds")(
    lambda spark, sf_dir: curve(metrics.pr_points(predictions(spark, sf_dir), ["variant"]), "recall", "precision"))
query("v_pr_area", f"""{with_(PREDS, SWEEP)} SELECT variant, round(sum((tp / np - lr) * (tp / (tp + fp) + lp) / 2), 6) AS pr_area FROM (
  SELECT *, lag(tp / np, 1, 0.0::DOUBLE) OVER w AS lr, lag(tp / (tp + fp), 1, 1.0::DOUBLE) OVER w AS lp FROM sw WINDOW w AS (PARTITION BY variant ORDER BY p1 DESC)) GROUP BY variant""")(
    lambda spark, sf_dir: metrics.pr_area(predictions(spark, sf_dir), ["variant"]).withColumn("pr_area", F.round("pr_area", 6)))


@query("v_projection")
def v_projection(spark, sf_dir):
    """Two principal components of original and synthetic embeddings."""
    out, _ = report.project_2d(fit_resample(embedding_points(spark, sf_dir), "SMOTE"))
    return out.withColumns({c: F.round(c, 6) for c in ("pc1", "pc2")})


@query("v_projection_fit", """WITH c AS (SELECT (label = 0)::INT AS one, count(*) AS n FROM embeddings GROUP BY 1),
s AS (SELECT 'class_' || one AS series, n FROM c UNION ALL SELECT 'synthetic', max(n) * 2 - sum(n)::BIGINT FROM c)
SELECT series, n::BIGINT AS n, true AS centered, true AS uncorrelated, true AS falling, true AS explained FROM s WHERE n > 0""")
def v_projection_fit(spark, sf_dir):
    """Rows of each series, and what holds for right axes: on the original rows both scores have mean zero, no correlation, falling variance, and the shares reported."""
    points = embedding_points(spark, sf_dir)
    out, shares = report.project_2d(fit_resample(points, "SMOTE"))
    out = settle(out)
    a, b = F.col("pc1"), F.col("pc2")
    features = points.select(F.posexplode("features").alias("pos", "v")).groupBy("pos").agg(F.var_pop("v").alias("v")).agg(F.count_if(F.col("v") > 0).alias("d"))
    original = out.filter("series <> 'synthetic'").agg(
        ((F.abs(F.avg(a)) <= 1e-9) & (F.abs(F.avg(b)) <= 1e-9)).alias("centered"), (F.abs(F.covar_pop(a, b)) <= 1e-9).alias("uncorrelated"),
        (F.var_pop(a) >= F.var_pop(b)).alias("falling"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    judged = original.crossJoin(features).select(  # one row each
        "centered", "uncorrelated", "falling",
        ((F.abs(F.col("va") / F.col("d") - shares[0]) <= 1e-6) & (F.abs(F.col("vb") / F.col("d") - shares[1]) <= 1e-6)).alias("explained"))
    return out.groupBy("series").agg(F.count(F.lit(1)).alias("n")).crossJoin(judged)


# ---- reports -------------------------------------------------------------

KEYS = "dataset, method, classifier"
CV = ["dataset", "method", "classifier", "fold"]
WANT = report.PRIORITY_METRICS


def fold_scores(spark, sf_dir):
    scores = metrics.evaluate(predictions(spark, sf_dir).filter("variant = 'resampled'"), CV)
    return metrics.long_form(scores, CV, WANT)


def final_changes(spark, sf_dir):
    by = [*report.KEYS, "variant"]
    return report.improvement(metrics.long_form(metrics.evaluate(predictions(spark, sf_dir), by), by, WANT))


RES = PREDS.replace("FROM scored)", "FROM scored WHERE variant = 'resampled')")
CVS = f"{with_(RES, evaluated(KEYS + ', fold'), long_sql(KEYS + ', fold', WANT))}, cvs AS (SELECT {KEYS}, metric, avg(value) AS mean, stddev_pop(value) AS std FROM long GROUP BY ALL)"
CHG = f"""{with_(PREDS, evaluated(KEYS + ', variant'), long_sql(KEYS + ', variant', WANT))}, chg AS (SELECT {KEYS}, metric,
  max(value) FILTER (variant = 'original') AS original, max(value) FILTER (variant = 'resampled') AS resampled,
  max(value) FILTER (variant = 'resampled') - max(value) FILTER (variant = 'original') AS improvement FROM long GROUP BY ALL)"""
PCT = "CASE WHEN original <> 0 THEN improvement / original * 100 ELSE 0 END"


def r(df, digits=6):
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields if f.dataType.typeName() == "double"})


query("r_cv_summary", f"{CVS} SELECT {KEYS}, metric, round(mean, 6) AS mean, round(std, 6) AS std FROM cvs")(
    lambda spark, sf_dir: r(report.cv_summary(fold_scores(spark, sf_dir))))
query("r_improvement", f"{CHG} SELECT {KEYS}, metric, round(original, 6) AS original, round(resampled, 6) AS resampled, round(improvement, 6) AS improvement FROM chg")(
    lambda spark, sf_dir: r(final_changes(spark, sf_dir)))
query("r_summary", f"{CHG} SELECT {KEYS}, metric, round_even(original, 4) AS original, round_even(resampled, 4) AS resampled, round_even(improvement, 4) AS delta_absolute, round_even({PCT}, 2) AS delta_percent FROM chg")(
    lambda spark, sf_dir: report.summary(final_changes(spark, sf_dir)))
query("r_flat_results", f"{CHG} SELECT {KEYS}, metric, round(original, 6) AS original_score, round(resampled, 6) AS resampled_score, round(improvement, 6) AS improvement, round({PCT}, 6) AS improvement_percentage FROM chg")(
    lambda spark, sf_dir: r(report.flat_results(final_changes(spark, sf_dir))))
CMP = ", ".join(f"printf('%.4f', max(mean) FILTER (metric = '{m}')) AS {m}" for m in WANT)
query("r_comparison", f"""{CVS} SELECT dataset, CASE method WHEN 'AKMeans_SMOTE' THEN 2 ELSE 3 END AS position, method,
  CASE classifier WHEN 'kNN' THEN 'kNN' WHEN 'LogisticRegression' THEN 'LR' ELSE 'RF' END AS classificator, {CMP} FROM cvs GROUP BY dataset, method, classifier""")(
    lambda spark, sf_dir: report.comparison(report.cv_summary(fold_scores(spark, sf_dir)), methods=["AKMeans_SMOTE", "KMeans_SMOTE"]))
PLACE = "list_position(['RandomForest', 'LogisticRegression', 'kNN'], classifier)"
ORDER = ["RandomForest", "LogisticRegression", "kNN"]
query("r_best", f"{CVS} SELECT dataset, method, metric, classifier, round(mean, 6) AS mean FROM cvs QUALIFY row_number() OVER (PARTITION BY dataset, method, metric ORDER BY mean DESC, {PLACE}) = 1")(
    lambda spark, sf_dir: r(report.best(report.cv_summary(fold_scores(spark, sf_dir)), ORDER)))
query("r_improved_share", f"{CHG} SELECT {KEYS}, count(*) FILTER (improvement > 0) AS improved, count(*) AS total, round(count(*) FILTER (improvement > 0) / count(*) * 100, 6) AS percent FROM chg GROUP BY {KEYS}")(
    lambda spark, sf_dir: r(report.improved_share(final_changes(spark, sf_dir))))
query("r_overall_share", f"{CHG} SELECT dataset, method, count(*) FILTER (improvement > 0) AS improved, count(*) AS total, round(count(*) FILTER (improvement > 0) / count(*) * 100, 6) AS percent FROM chg GROUP BY dataset, method")(
    lambda spark, sf_dir: r(report.improved_share(final_changes(spark, sf_dir), ["dataset", "method"])))
query("r_best_gain", f"{CHG} SELECT * FROM (SELECT dataset, method, metric, classifier, round(improvement, 6) AS improvement FROM chg QUALIFY row_number() OVER (PARTITION BY dataset, method, metric ORDER BY improvement DESC, {PLACE}) = 1) WHERE improvement > 0")(
    lambda spark, sf_dir: r(report.best_gain(final_changes(spark, sf_dir), ORDER)))
