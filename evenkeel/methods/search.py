"""Choice of the number of clusters by cross-validation (off by default)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators import cluster, kernels, metrics, split
from evenkeel.operators.forest import Forest
from evenkeel.operators.runtime import settle, small_table

TRIAL_ROWS = 100
GIVE_UP = 0.95


def _balanced_accuracy(rows: DataFrame, own: int, folds: int, seed: int) -> float:
    """Mean balanced accuracy of a random forest (50 trees, depth 5) at telling class ``own`` from the rest."""
    marked = split.stratified_folds(rows.withColumn("label", (F.col("label") == own).cast("int")), k=folds, seed=seed)
    spread = settle(split.expand_folds(marked, folds).drop("fold").withColumnRenamed("f", "fold"))
    model = Forest(spread.filter("NOT is_val"), ["fold"], trees=50, depth=5, seed=seed)
    held = spread.filter("is_val").select("fold", "row_id", F.col("label").alias("y"), "features")
    one = F.get("shares", F.lit(model.labels.index(1))) if 1 in model.labels else F.lit(0.0)
    preds = held.join(model.predict(held), ["fold", "row_id"]).select("fold", "y", (one > 0.5).cast("int").alias("y_pred"))
    return float(metrics.evaluate(preds, ["fold"]).agg(F.avg("balanced_accuracy")).first()[0])


def search_k(job, part: DataFrame, initial: int, folds: int = 3) -> int:
    """From ``initial`` down to 2 clusters: make up to 100 rows of the class, keep the number with the best
    cross-validated balanced accuracy, stop once it falls below 95 % of the score without them.
    The new rows carry the label of the class being clustered."""
    from evenkeel.methods.clustered import generate

    n = part.count()
    if initial < 2 or initial > n:
        return max(2, min(initial, n // 2))
    first = part.select(*job.grp).first()
    own = first["label"]
    rows = job.points
    for c in job.by:
        rows = rows.filter(F.col(c).eqNullSafe(F.lit(first[c])))
    rows = settle(rows.select("row_id", "label", "features"))
    base = _balanced_accuracy(rows, own, folds, job.seed)
    trial = job.restricted(part.select(*job.grp).distinct())
    needs = small_table(trial.needs.withColumn("n_needed", F.least(F.col("n"), F.lit(TRIAL_ROWS))))
    best_k, best = initial, float("-inf")
    for k in range(initial, 1, -1):
        centers = cluster.fit_centers(part, job.grp, k, job.seed, job.options.get("restarts", 10))
        members = settle(cluster.assign(part, centers, job.grp).transform(kernels.equi, part, [*job.grp, "row_id"]))
        good = cluster.stable(cluster.sparsity(members, job.grp), job.grp)
        if good.isEmpty():
            continue
        shares = small_table(cluster.allocate(good.withColumn("weight", 1 / (F.col("sparsity") + F.lit(1e-10))), needs, job.grp))
        made = generate(trial, members, shares).select((-F.col("rep")).alias("row_id"), "label", "features")
        score = _balanced_accuracy(rows.unionByName(made), own, folds, job.seed)
        if score > best:
            best_k, best = k, score
        if score < base * GIVE_UP:
            break
    return best_k
