"""SMOTE and the methods that differ from it only in how bases or neighbours are chosen.

Defaults (k = 5, balance to parity) are this library's. Where a paper leaves room or
a step is simplified, the docstring says "ours".
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions.rng import pick, uniform
from evenkeel.functions.vectors import lerp, mean_vector
from evenkeel.methods.registry import Job, register
from evenkeel.operators import kernels
from evenkeel.operators.runtime import small_table


@register("Original", "NoSMOTE")
def original(job: Job):
    """Baseline: nothing is added."""
    return None


def interpolate(job: Job, made, bases_lists=None):
    """Slots with base_id -> neighbour draw -> one share per row -> synthetic rows."""
    lists = job.lists if bases_lists is None else bases_lists
    paired = kernels.draw_neighbour(made, lists, job.by, job.keys, job.seed, large=job.large)
    full = job.nbr_vec(job.base_vec(paired))
    share = uniform(job.seed, "lam", *job.keys)
    # a base without neighbours (a class of one row) is duplicated
    return kernels.as_synthetic(full, job.by, F.coalesce(lerp(F.col("x"), F.col("nbr"), share), F.col("x")))


@register("SMOTE")
def smote(job: Job):
    """Chawla et al. 2002: uniform base, uniform one of its k nearest rows of the class,
    a point on the segment between them. A class of one row is duplicated."""
    return interpolate(job, kernels.draw_uniform(job.slots, job.minority, job.grp, job.keys, job.seed))


@register("Borderline_SMOTE1")
def borderline(job: Job):
    """Han et al. 2005: bases are minority rows in danger, k/2 <= m < k of whose k nearest
    rows are of other classes. No such row, no new rows (ours)."""
    danger = job.crowd().filter((F.col("m") * 2 >= F.col("kk")) & (F.col("m") < F.col("kk")))
    return interpolate(job, kernels.draw_uniform(job.slots, danger, job.grp, job.keys, job.seed))


@register("ADASYN")
def adasyn(job: Job):
    """He et al. 2008: r = m/k, each row is a base round(r / sum(r) * needed) times. All r = 0
    gives none (ours)."""
    hard = job.crowd().withColumn("r", F.col("m") / F.col("kk"))
    total = hard.groupBy(*job.grp).agg(F.sum("r").alias("_r"))
    sized = hard.transform(kernels.equi, total, job.grp).transform(kernels.equi, job.needs, job.grp).filter(F.col("_r") > 0)
    counted = sized.select(
        *job.grp, F.col("row_id").alias("base_id"),
        F.round(F.col("r") / F.col("_r") * F.col("n_needed")).cast("bigint").alias("g"))
    return interpolate(job, kernels.draw_counted(counted, job.grp, ["base_id"], job.seed).select(*job.keys, "base_id"))


@register("distance_SMOTE")
def distance_smote(job: Job):
    """De la Calleja & Fuentes 2007: towards the mean of the k nearest rows of the class."""
    side = job.minority.select(*job.by, F.col("row_id").alias("nbr_id"), F.col("features").alias("nbr"))
    long = job.own_long.transform(kernels.equi, side, [*job.by, "nbr_id"])
    centre = long.groupBy(*job.by, F.col("q_id").alias("base_id")).agg(
        mean_vector("nbr").alias("c"))
    made = kernels.draw_uniform(job.slots, job.minority, job.grp, job.keys, job.seed)
    full = job.base_vec(made).transform(kernels.equi, centre, [*job.by, "base_id"], "left")
    share = uniform(job.seed, "lam", *job.keys)
    return kernels.as_synthetic(full, job.by, F.coalesce(lerp(F.col("x"), F.col("c"), share), F.col("x")))


@register("Safe_Level_SMOTE")
def safe_level(job: Job):
    """Bunkhumpornpat et al. 2009: safe level = rows of the own class among the k nearest of
    all. The share is drawn per feature, nearer to the safer end; slots whose both ends
    have level 0 are skipped."""
    levels = job.crowd().withColumn("sl", F.col("kk") - F.col("m")).select(*job.by, "row_id", "sl")
    made = kernels.draw_uniform(job.slots, job.minority, job.grp, job.keys, job.seed)
    paired = kernels.draw_neighbour(made, job.lists, job.by, job.keys, job.seed, large=job.large).filter(F.col("nbr_id").isNotNull())
    paired = kernels.attach(paired, levels, job.by, "base_id", large=job.large, sl_x="sl")
    paired = kernels.attach(paired, levels, job.by, "nbr_id", large=job.large, sl_n="sl")
    paired = paired.filter((F.col("sl_x") > 0) | (F.col("sl_n") > 0))
    full = job.nbr_vec(job.base_vec(paired), "inner")
    ratio = F.col("sl_x") / F.nullif(F.col("sl_n"), F.lit(0))
    low = F.when(F.col("sl_n") == 0, 0.0).when(ratio < 1, 1 - ratio).otherwise(0.0)
    high = F.when(F.col("sl_n") == 0, 0.0).when(ratio > 1, 1 / ratio).otherwise(1.0)
    full = full.withColumn("low", low).withColumn("wide", high - low)

    def move(x, i):
        share = F.col("low") + F.col("wide") * uniform(job.seed, "lam", *job.keys, i)
        return x + share * (F.get("nbr", i) - x)

    return kernels.as_synthetic(full, job.by, F.transform("x", move))


@register("MSMOTE")
def msmote(job: Job):
    """Hu et al. 2009: by the k nearest rows of all classes a base is safe (all its own class:
    random neighbour), border (nearest neighbour) or noise (none its own: never a base)."""
    kind = job.crowd().filter(F.col("m") < F.col("kk"))
    made = kernels.draw_uniform(job.slots, kind, job.grp, job.keys, job.seed)
    made = kernels.attach(made, kind, job.by, "base_id", large=job.large, m="m")
    side = job.lists.select(*job.by, F.col("row_id").alias("base_id"), F.transform("nbrs", lambda s: s["nbr_id"]).alias("_ids"))
    joined = made.transform(kernels.equi, side, [*job.by, "base_id"], "left")
    place = F.when(F.col("m") == 0, pick(job.seed, "nbr", F.size("_ids"), *job.keys)).otherwise(F.lit(0)).cast("int")
    full = job.nbr_vec(job.base_vec(joined.withColumn("nbr_id", F.get("_ids", place)).drop("_ids", "m")))
    share = uniform(job.seed, "lam", *job.keys)
    return kernels.as_synthetic(full, job.by, F.coalesce(lerp(F.col("x"), F.col("nbr"), share), F.col("x")))


@register("SL_graph_SMOTE")
def sl_graph(job: Job):
    """Bunkhumpornpat & Subpaiboonkit 2013: left-skewed safe levels take Safe_Level_SMOTE,
    others Borderline_SMOTE1."""
    levels = job.crowd().withColumn("sl", F.col("kk") - F.col("m"))
    shape = levels.groupBy(*job.grp).agg(F.skewness("sl").alias("s"))
    left = job.restricted(shape.filter(F.col("s") < 0).select(*job.grp))
    right = job.restricted(shape.filter(~(F.coalesce("s", F.lit(0.0)) < 0)).select(*job.grp))
    return safe_level(left).unionByName(borderline(right))


@register("Random_SMOTE")
def random_smote(job: Job):
    """Dong & Wang 2011: two random rows of the class give a point t between them, the new
    row lies between the base and t."""
    made = kernels.draw_uniform(job.slots, job.minority, job.grp, job.keys, job.seed)
    made = kernels.draw_uniform(made, job.minority, job.grp, job.keys, job.seed, "y1", "nbr_id")
    made = kernels.draw_uniform(made, job.minority, job.grp, job.keys, job.seed, "y2", "other_id")
    full = job.nbr_vec(job.base_vec(made), "inner")
    full = kernels.attach(full, job.minority, job.by, "other_id", large=job.large, other="features")
    full = full.withColumn("t", lerp(F.col("nbr"), F.col("other"), uniform(job.seed, "lam1", *job.keys)))
    return kernels.as_synthetic(full, job.by, lerp(F.col("x"), F.col("t"), uniform(job.seed, "lam2", *job.keys)))


@register("SMOTE_D")
def smote_d(job: Job):
    """Torres et al. 2016, no randomness: a base's share follows the spread of its k distances,
    a neighbour's its distance; new rows are evenly spaced on each segment."""
    spread = job.own_long.groupBy(*job.grp, "q_id").agg(F.stddev_pop("dist").alias("sd"), F.sum("dist").alias("far"))
    whole = small_table(spread.groupBy(*job.grp).agg(F.sum("sd").alias("_sd")))
    share = spread.transform(kernels.equi, whole, job.grp).transform(kernels.equi, job.needs.select(*job.grp, "n_needed"), job.grp).filter(F.col("_sd") > 0)
    share = share.withColumn("n_i", F.round(F.round(F.col("sd") / F.col("_sd") * F.col("n_needed"), 9)))
    pairs = job.own_long.transform(kernels.equi, share.filter("n_i > 0 and far > 0").select(*job.grp, "q_id", "n_i", "far"), [*job.grp, "q_id"])
    pairs = pairs.select(
        *job.grp, F.col("q_id").alias("base_id"), "rank", "nbr_id",
        F.round(F.round(F.col("dist") / F.col("far") * F.col("n_i"), 9)).cast("bigint").alias("g"))
    made = kernels.draw_counted(pairs, job.grp, ["base_id", "rank"], job.seed)
    full = job.nbr_vec(job.base_vec(made), "inner")
    return kernels.as_synthetic(full, job.by, lerp(F.col("x"), F.col("nbr"), F.col("j") / (F.col("g") + 1)))


@register("SMOTE_TomekLinks")
def smote_tomek(job: Job):
    """Batista et al. 2004: SMOTE, then both rows of every Tomek link (each the other's
    nearest row, labels differing) are removed."""
    from evenkeel.operators.runtime import settle

    full = settle(kernels.union_result(job.points, smote(job), job.by, job.codes))
    kept = drop_tomek_links(full, job.by)
    points = kept.filter(~F.col("is_synthetic")).select(*job.by, "row_id", "label", "features")
    made = kept.filter("is_synthetic").select(*job.by, "label", "rep", "base_id", "nbr_id", "features")
    return points, made


def drop_tomek_links(points, by=()):
    """Remove both rows of every pair that are each other's nearest and differ in label."""
    from evenkeel.operators.neighbours import Neighbours

    by = list(by)
    refs = points.withColumn("nbr_label", F.col("label").cast("int"))
    near = Neighbours(refs, by=by, carry=["nbr_label"], copies=2).knn(points, 1)
    near = near.select(*by, F.col("q_id").alias("a"), F.col("nbr_id").alias("b"), "nbr_label")
    back = near.select(*by, F.col("a").alias("b"), F.col("b").alias("a"), F.col("nbr_label").alias("a_label"))
    links = near.transform(kernels.equi, back, [*by, "a", "b"]).filter(F.col("nbr_label") != F.col("a_label"))
    return points.transform(kernels.equi, links.select(*by, F.col("a").alias("row_id")), [*by, "row_id"], "left_anti")
