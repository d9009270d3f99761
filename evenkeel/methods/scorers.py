"""Classifier scores used to filter synthetic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.methods.registry import Job
from evenkeel.operators.forest import Forest
from evenkeel.operators.kernels import equi


def forest_scorer(job: Job, made: DataFrame) -> DataFrame:
    """Add ``score``: probability of the row's own class by a random forest (50 trees, depth 5)
    trained on the original, imbalanced rows of its ``by`` group; all groups in one fit."""
    model = Forest(job.points, job.by, trees=50, depth=5, seed=job.seed)
    place = F.create_map(*[F.lit(x) for i, label in enumerate(model.labels) for x in (label, i)])
    shares = model.predict(made, ["label", "rep"]).withColumn("score", F.coalesce(F.get("shares", place[F.col("label")]), F.lit(0.0)))
    return equi(made, shares.drop("shares"), job.keys)
