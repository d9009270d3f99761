"""Methods built on a fitted model: principal axes, Mahalanobis shells, classifier filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import blocks
from evenkeel.functions.rng import normal, uniform
from evenkeel.functions.vectors import dot, lerp, let
from evenkeel.methods.registry import Job, register
from evenkeel.methods.scorers import forest_scorer
from evenkeel.methods.smote import interpolate
from evenkeel.operators import kernels, moments
from evenkeel.operators.cluster import fit_centers
from evenkeel.operators.neighbours import group_rows
from evenkeel.operators.runtime import settle, small_table
from evenkeel.operators.scan import range_buckets, running_sums


@register("G_SMOTE")
def g_smote(job: Job):
    """Sandhan & Choi 2014 (guided; not Geometric SMOTE): the step towards the neighbour is projected
    on the first principal axis v of the class: x + share * ((nbr - x) . v) v. ``axis=``
    (by..., label, axis) replaces the fit."""
    axis = job.options.get("axis")
    if axis is None:
        axis = small_table(moments.axes(job.minority, job.grp, 1).select(*job.grp, F.col("axes")[0].alias("axis")))
    made = kernels.draw_uniform(job.slots, job.minority, job.grp, job.keys, job.seed)
    full = job.nbr_vec(job.base_vec(kernels.draw_neighbour(made, job.lists, job.by, job.keys, job.seed, large=job.large))).transform(kernels.equi, axis, job.grp)
    full = full.withColumn("along", F.coalesce(
        dot(F.zip_with("nbr", "x", lambda y, x: y - x), F.col("axis")), F.lit(0.0)) * uniform(job.seed, "lam", *job.keys))
    return kernels.as_synthetic(full, job.by, let(F.col("along"), lambda a: F.zip_with("x", "axis", lambda x, v: x + a * v)))


@register("MDO")
def mdo(job: Job):
    """Abdi & Hashemi 2016: in the principal axes E of the class, a new row has the base's Mahalanobis
    distance and a uniform direction (ours). Bases have at least ``k1`` (default ceil(k / 2)) own rows
    among the k nearest of all, weighted by that number; where no row of a class has so many, all its rows
    are bases alike (ours). ``frame=`` [(key, mean, axes, variances)] replaces the fit.
    The d x d axes go to the executors; d is the number of features."""
    frame = job.options.get("frame") or [
        (tuple(r[c] for c in job.grp), r["mean"], np.array(r["axes"]).T, r["variances"]) for r in moments.axes(job.minority, job.grp).collect()]  # a row a class
    held = job.points.sparkSession.sparkContext.broadcast({
        key: (np.asarray(mean), np.asarray(axes), np.asarray(var)) for key, mean, axes, var in frame})
    crowd = job.crowd().withColumn("weight", (F.col("kk") - F.col("m")).cast("double"))
    enough = F.col("weight") >= job.options.get("k1", (job.k + 1) // 2)
    richest = small_table(crowd.groupBy(*job.grp).agg(F.max(enough).alias("_any")))
    every = job.minority.select(*job.grp, "row_id").transform(kernels.equi, crowd.select(*job.grp, "row_id", "weight"), [*job.grp, "row_id"], "left")
    fitting = every.transform(kernels.equi, richest, job.grp, "left").withColumn("_any", F.coalesce("_any", F.lit(False)))
    weights = fitting.filter(~F.col("_any") | enough).select(
        *job.grp, "row_id", F.when(F.col("_any"), F.col("weight")).otherwise(1.0).alias("weight"))
    made = job.base_vec(kernels.draw_weighted(weights, job.needs, job.grp, job.seed))
    made = made.withColumn("g", F.transform("x", lambda x, i: normal(job.seed, "z", *job.keys, i)))
    made = made.select(*job.grp, "rep", "base_id", "x", "g")
    grp, schema = job.grp, T.StructType([*[made.schema[c] for c in job.grp], made.schema["rep"], made.schema["base_id"],
                                         T.StructField("features", T.ArrayType(T.DoubleType()))])
    names = [f.name for f in schema.fields]

    def rotate(batches):
        for batch in batches:
            x, g = blocks.matrix(batch.column("x")), blocks.matrix(batch.column("g"))
            out = np.array(x)
            for key, at in group_rows(batch, grp).items():
                mean, axes, var = held.value[key]
                real = var > 1e-12 * var.max(initial=0.0)
                z = (x[at] - mean) @ axes
                shell = (z[:, real] ** 2 / var[real]).sum(axis=1)
                way = np.where(real[None, :], g[at], 0.0)
                length = np.sqrt((way**2).sum(axis=1))
                r = way * np.sqrt(shell[:, None] * np.where(real, var, 0.0)[None, :]) / np.maximum(length, 1e-300)[:, None]  # without spread: the mean, which is the base
                out[at] = r @ axes.T + mean
            cols = [batch.column(n) for n in names[:-1]] + [pa.array(list(out), type=pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return kernels.as_synthetic(made.mapInArrow(rotate, schema), job.by, F.col("features"))


@register("Supervised_SMOTE")
def supervised_smote(job: Job):
    """Hu et al. 2013: SMOTE candidates are kept when a classifier (random forest of 50 trees, depth 5)
    gives their own class at least 0.5; ``rounds`` (3) of new draws make up for the rest, and what is
    still missing then is filled with the candidates of the highest scores below (ours), so classes
    reach their size whatever the classifier says. ``scorer=`` replaces the forest."""
    scorer = job.options.get("scorer") or forest_scorer
    needs = job.needs.select(*job.grp, "n_needed", F.lit(0).cast("bigint").alias("offset"))
    kept, below = None, None
    for _ in range(int(job.options.get("rounds", 3))):
        made = kernels.draw_uniform(kernels.slots(needs, job.grp), job.minority, job.grp, job.keys, job.seed)
        scored = settle(scorer(job, interpolate(job, made)))
        good, poor = scored.filter(F.col("score") >= 0.5).drop("score"), scored.filter("score < 0.5 OR score IS NULL")
        kept = good if kept is None else kept.unionByName(good)
        below = poor if below is None else below.unionByName(poor)
        got = good.groupBy(*job.grp).agg(F.count(F.lit(1)).alias("_got"))
        needs = small_table(needs.transform(kernels.equi, got, job.grp, "left").select(
            *job.grp, (F.col("n_needed") - F.coalesce("_got", F.lit(0))).cast("bigint").alias("n_needed"),
            (F.col("offset") + F.col("n_needed")).alias("offset")).filter(F.col("n_needed") > 0))
        if needs.isEmpty():
            return kept
    score = F.coalesce("score", F.lit(0.0))
    ready = below.transform(kernels.equi, needs.select(*job.grp, "n_needed"), job.grp).withColumn("_gap", 1 - score)
    ordered = range_buckets(ready, [*job.grp, "_gap", "rep"], "_range")
    ranked = running_sums(ordered, job.grp, ["_gap", "rep"], F.col("_range"), {"_place": F.lit(1).cast("bigint")})
    return kept.unionByName(ranked.filter(F.col("_place") <= F.col("n_needed")).select(*kept.columns))


@register("SSO")
def sso(job: Job):
    """Rong et al. 2014: a radial basis network on min(``clusters``, n) k-means centers (20) of a group with a ridge output
    layer (0.01 of each response's variance, ours) scores the class; a row's sensitivity is the expected squared change of its score over uniform shifts in
    +-``q`` (0.1, for scaled features) of every feature, which has a closed form (``sensitivity``). Bases follow sensitivity; a new row is
    the base plus one such shift. Networks of all groups are fitted by the same jobs; they are as small as their centers and travel to the rows."""
    q, by = float(job.options.get("q", 0.1)), job.by
    nodes: dict[tuple, list] = {}
    for r in fit_centers(job.points, by, int(job.options.get("clusters", 20)), job.seed, job.options.get("restarts", 3)).collect():  # a few rows a group
        nodes.setdefault(tuple(r[c] for c in by), []).append((r["cluster"], r["center"]))
    nets = {}
    for key, found in nodes.items():
        centers = np.array([c for _, c in sorted(found)])
        gaps = blocks.all_distances(centers, centers)
        nets[key] = centers, float(gaps[gaps > 0].mean()) if (gaps > 0).any() else 1.0
    labels = sorted({r["label"] for r in job.needs.select("label").distinct().collect()})
    held = job.points.sparkSession.sparkContext.broadcast(nets)
    schema = T.StructType([*[job.points.schema[c] for c in by], T.StructField("_vec", T.ArrayType(T.DoubleType()))])

    def respond(batches):
        for batch in batches:
            x, own, out = blocks.matrix(batch.column("features")), batch.column("label").to_numpy(), [None] * batch.num_rows
            for key, at in group_rows(batch, by).items():
                wanted = own[at][:, None] == np.array(labels)
                for i, row in zip(at.tolist(), np.column_stack([responses(x[at], *held.value[key]), wanted]).tolist()):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*map(batch.column, by), pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    outputs = {}
    for r in moments.gather(job.points.select(*by, "label", "features").mapInArrow(respond, schema), by, "_vec").collect():  # a row a group
        key = tuple(r[c] for c in by)
        many = len(nets[key][0])
        squares = moments.unpacked(r["mean"], r["squares"])[1]
        ridge = 0.01 * np.diag(squares)[:many]
        outputs[key] = np.linalg.lstsq(squares[:many, :many] + np.diag(ridge), squares[:many, many:], rcond=None)[0]
    layer = job.points.sparkSession.sparkContext.broadcast({k: {label: w[:, i] for i, label in enumerate(labels)} for k, w in outputs.items()})
    grp, marks = job.grp, T.StructType([*[job.minority.schema[c] for c in job.grp], T.StructField("row_id", T.LongType()), T.StructField("weight", T.DoubleType())])

    def judge(batches):
        for batch in batches:
            x, weight = blocks.matrix(batch.column("features")), np.zeros(batch.num_rows)
            for key, at in group_rows(batch, grp).items():
                net = key[:len(by)]
                for some in blocks.steps(len(at), x.shape[1] * 64):
                    weight[at[some]] = sensitivity(x[at[some]], *held.value[net], layer.value[net][key[-1]], q)
            yield pa.RecordBatch.from_arrays([*map(batch.column, [*grp, "row_id"]), pa.array(weight)], names=marks.names)

    weights = job.minority.select(*grp, "row_id", "features").mapInArrow(judge, marks)
    made = job.base_vec(kernels.draw_weighted(settle(weights), job.needs, job.grp, job.seed))
    shift = F.transform("x", lambda x, i: x + (uniform(job.seed, "shift", *job.keys, i) * 2 - 1) * q)
    return kernels.as_synthetic(made, job.by, shift)


def responses(x: np.ndarray, nodes: np.ndarray, width: float) -> np.ndarray:
    return np.exp(-(blocks.all_distances(x, nodes) ** 2) / (2 * width**2))


def smeared(x: np.ndarray, center: np.ndarray, scale: float, q: float) -> np.ndarray:
    """Mean of exp(-|x + u - center|^2 / scale) over u uniform in +-q: a product of one integral a feature, by Gauss-Legendre nodes, more of them the wider q is."""
    at, share = np.polynomial.legendre.leggauss(min(64, 6 + int(8 * q / np.sqrt(scale))))
    gaps = (x - center)[:, :, None] + q * at
    return np.exp(np.log(np.maximum(np.exp(-(gaps**2) / scale) @ (share / 2), 1e-300)).sum(axis=1))


def sensitivity(x: np.ndarray, nodes: np.ndarray, width: float, out: np.ndarray, q: float) -> np.ndarray:
    """Mean of (f(x + u) - f(x))^2 over u uniform in +-q, f being the network: products of two responses are Gaussians about the middle of their centers."""
    scale = 2 * width**2
    here = responses(x, nodes, width) @ out
    mean = sum(w * smeared(x, c, scale, q) for w, c in zip(out, nodes))
    square = np.zeros(len(x))
    for j, a in enumerate(nodes):
        for k, b in enumerate(nodes[:j + 1]):
            share = (1 if k == j else 2) * out[j] * out[k] * np.exp(-((a - b) ** 2).sum() / (2 * scale))
            square += share * smeared(x, (a + b) / 2, scale / 2, q)
    return np.maximum(square - 2 * here * mean + here**2, 0.0)
