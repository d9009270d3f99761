"""Methods that weigh bases by local density: ball counts, weighted draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions import blocks
from evenkeel.functions.rng import normal, raw32, uniform
from evenkeel.functions.vectors import let, lerp, mean_vector, std_vector, sum_vector
from evenkeel.methods.registry import Job, register
from evenkeel.methods.smote import interpolate
from evenkeel.operators import kernels
from evenkeel.operators.neighbours import Neighbours
from evenkeel.operators.runtime import settle, small_table


def _density_factor(job: Job) -> DataFrame:
    """(grp..., row_id, weight) after the noise cut of SMOBD."""
    core = job.own_long.groupBy(*job.grp, F.col("q_id").alias("row_id")).agg(F.max("dist").alias("core"))
    reach = small_table(core.groupBy(*job.grp).agg(F.round(F.avg("core"), 9).alias("radius"), F.min("core").alias("tight")))
    queries = job.minority.transform(kernels.equi, reach, job.grp)
    inside = job.within(queries, job.minority, job.grp, closed=True)
    dens = settle(core.transform(kernels.equi, reach, job.grp).transform(kernels.equi, inside, [*job.grp, "row_id"]).withColumn("dens", F.col("inside") - 1))
    norm = small_table(dens.groupBy(*job.grp).agg(F.max("dens").alias("top"), F.avg("dens").alias("mid")))
    full = dens.transform(kernels.equi, norm, job.grp)
    noise = (F.col("core") > 2 * F.col("radius")) & (F.col("dens") < F.col("mid") / 2)
    closeness = F.when(F.col("core") > 0, F.col("tight") / F.col("core")).otherwise(1.0)
    crowd = F.when(F.col("top") > 0, F.col("dens") / F.col("top")).otherwise(0.0)
    return full.filter(~noise).select(*job.grp, "row_id", (closeness / 2 + crowd / 2).alias("weight"))


@register("SMOBD", "SMBOND")
def smobd(job: Job):
    """Cao & Wang 2011: bases in proportion to half core-distance closeness, half number of
    class rows within the mean core distance; sparse far rows are noise (weights and
    noise cut are ours)."""
    return interpolate(job, kernels.draw_weighted(_density_factor(job), job.needs, job.grp, job.seed))


@register("ASMOBD")
def asmobd(job: Job):
    """Wang et al. 2012: the SMOBD weight times (1 - m/k); rows with m = k are dropped (ours)."""
    crowd = job.crowd().filter(F.col("m") < F.col("kk"))
    factor = _density_factor(job).transform(kernels.equi, crowd, [*job.grp, "row_id"])
    weights = factor.withColumn("weight", F.col("weight") * (1 - F.col("m") / F.col("kk")))
    return interpolate(job, kernels.draw_weighted(weights.select(*job.grp, "row_id", "weight"), job.needs, job.grp, job.seed))


@register("ANS")
def ans(job: Job):
    """Siriseriwan & Sinapiromsaran 2017. d1 = distance to the nearest class row; a row with
    more than C rows of all classes nearer than d1 is an outcast, C being the smallest
    count >= 1 that no row has (at most a quarter of the class). The radius is the largest d1 of
    the rest; neighbours are all class rows within it, drawn without listing them: the one
    that minimises a seeded hash of its id."""
    near = Neighbours(job.minority, by=job.grp, copies=2).knn(job.minority, 1)
    d1 = near.select(*job.grp, F.col("q_id").alias("row_id"), F.col("dist").alias("radius"))
    queries = job.minority.transform(kernels.equi, d1, [*job.grp, "row_id"])
    # no class row is nearer than d1, so whatever is nearer belongs to other classes
    counts = job.within(queries.drop("label"), job.points, job.by, closed=False)
    closer = d1.transform(kernels.equi, counts, [*job.by, "row_id"], "left").withColumn(
        "o", F.when(F.col("radius") > 0, F.coalesce("inside", F.lit(1)) - 1).otherwise(0))
    closer = settle(closer.select(*job.grp, "row_id", "radius", "o"))
    seen = closer.select(*job.grp, "o").distinct()
    steps = seen.unionByName(job.needs.select(*job.grp, F.lit(0).cast("bigint").alias("o"))).distinct()
    follow = seen.select(*job.grp, (F.col("o") - 1).alias("o"))
    gap = steps.transform(kernels.equi, follow, [*job.grp, "o"], "left_anti").groupBy(*job.grp).agg(F.min(F.col("o") + 1).alias("gap"))
    limit = gap.transform(kernels.equi, job.needs, job.grp).select(
        *job.grp, F.least("gap", F.greatest(F.lit(1), F.ceil(F.col("n") / 4))).alias("limit"))
    inner = closer.transform(kernels.equi, limit, job.grp).filter(F.col("o") <= F.col("limit"))
    reach = inner.groupBy(*job.grp).agg(F.max("radius").alias("radius"))
    # every inner row has its nearest class row within the radius, so each can be a base
    made = kernels.draw_uniform(job.slots, inner, job.grp, job.keys, job.seed)
    aimed = job.base_vec(made).transform(kernels.equi, reach, job.grp).select(
        *job.grp, "rep", F.col("base_id").alias("own_id"), F.col("x").alias("features"), "radius",
        (raw32(job.seed, "mixa", *job.keys) % (blocks.PRIME - 1) + 1).alias("mix_a"),
        (raw32(job.seed, "mixb", *job.keys) % blocks.PRIME).alias("mix_b"))
    parts = Neighbours(job.minority, by=job.grp).meet(
        aimed, blocks.ball_pick(), "mix bigint, nbr_id bigint", id="rep",
        extra=["own_id", "radius", "mix_a", "mix_b"], reach="radius")
    best = parts.groupBy(*job.grp, F.col("q_id").alias("rep")).agg(F.min(F.struct("mix", "nbr_id")).alias("best"))
    paired = made.transform(kernels.equi, best, [*job.grp, "rep"]).withColumn("nbr_id", F.col("best.nbr_id")).drop("best")
    full = job.nbr_vec(job.base_vec(paired), "inner")
    share = uniform(job.seed, "lam", *job.keys)
    return kernels.as_synthetic(full, job.by, lerp(F.col("x"), F.col("nbr"), share))


@register("SYMPROD")
def symprod(job: Job):
    """Kunakorntum et al. 2020. Rows with any |z| >= 3 in their class are left out. Closeness
    of a class row to its own class and to the rest, CF = sum of 1/distance, each
    min-max scaled; rows with 1.25 CF_N >= CF_P are left out. Base weight is
    (1 + sum of CF_P over its class neighbours) / (1 + sum of CF_N over its other neighbours),
    the latter scaled over the rows that are such neighbours (ours). A new row is a seeded convex
    combination of the base and its class neighbours. CF needs every distance: work grows
    with class size times table size."""
    calm = settle(_calm(job.minority, job.grp))
    rest = settle(_calm(job.others, [*job.grp, "own_label"]))
    own = _closeness(job, calm, calm, True, "cf_p")
    away = _closeness(job, calm, rest, False, "cf_n")
    both = own.transform(kernels.equi, away, [*job.grp, "row_id"]).filter(~(F.col("cf_n") * 1.25 >= F.col("cf_p")))
    kept = settle(calm.transform(kernels.equi, both.select(*job.grp, "row_id", "cf_p"), [*job.grp, "row_id"]))
    long = settle(Neighbours(kept, by=job.grp, copies=job.k + 1).knn(kept, job.k))
    outer = settle(Neighbours(rest, by=job.grp, copies=job.k + 1).knn(kept, job.k, skip_self=False))
    met = outer.select(*job.grp, F.col("nbr_id").alias("row_id")).distinct()
    met = rest.select(*job.grp, "row_id", "features").transform(kernels.equi, met, [*job.grp, "row_id"])
    met_cf = _closeness(job, met, rest, True, "cf").select(*job.grp, F.col("row_id").alias("nbr_id"), "cf")
    near = long.transform(kernels.equi, kept.select(*job.grp, F.col("row_id").alias("nbr_id"), F.col("cf_p").alias("cf")), [*job.grp, "nbr_id"])
    near = near.groupBy(*job.grp, "q_id").agg(F.sum("cf").alias("up"))
    far = outer.transform(kernels.equi, met_cf, [*job.grp, "nbr_id"]).groupBy(*job.grp, "q_id").agg(F.sum("cf").alias("down"))
    weights = kept.select(*job.grp, F.col("row_id").alias("q_id")).transform(kernels.equi, near, [*job.grp, "q_id"], "left").transform(
        kernels.equi, far, [*job.grp, "q_id"], "left")
    weights = weights.select(
        *job.grp, F.col("q_id").alias("row_id"),
        ((1 + F.coalesce("up", F.lit(0.0))) / (1 + F.coalesce("down", F.lit(0.0)))).alias("weight"))
    made = kernels.draw_weighted(weights, job.needs, job.grp, job.seed)
    parts = long.select(*job.by, F.col("q_id").alias("base_id"), "rank", F.col("nbr_id").alias("part_id"))
    own_part = kept.select(*job.by, F.col("row_id").alias("base_id"), F.lit(0).cast("bigint").alias("rank"), F.col("row_id").alias("part_id"))
    mixed = made.transform(kernels.equi, parts.unionByName(own_part), [*job.by, "base_id"])
    mixed = kernels.attach(mixed, kept, job.by, "part_id", large=job.large, part="features")
    mixed = mixed.withColumn("w", uniform(job.seed, "w", *job.keys, "rank"))
    full = mixed.groupBy(*job.grp, "rep", "base_id").agg(mean_vector("part", F.col("w")).alias("made"))
    return kernels.as_synthetic(full, job.by, F.col("made"))


def _calm(rows: DataFrame, cls) -> DataFrame:
    """Rows without a feature 3 or more standard deviations from the mean of their class."""
    stats = small_table(rows.groupBy(*cls).agg(
        mean_vector("features").alias("_mu"), std_vector("features", population=True).alias("_sd")))
    outside = F.zip_with(
        F.zip_with("features", "_mu", lambda x, m: F.abs(x - m)), "_sd",
        lambda gap, sd: F.when(sd > 0, gap / sd >= 3).otherwise(False))
    return rows.transform(kernels.equi, stats, list(cls)).filter(~F.exists(outside, lambda hit: hit)).drop("_mu", "_sd")


def _closeness(job: Job, queries: DataFrame, refs: DataFrame, same: bool, name: str) -> DataFrame:
    """Sum of 1/distance to all ``refs`` of the group, min-max scaled over the queries."""
    parts = Neighbours(refs, by=job.grp).meet(queries, blocks.inverse_sum(same), "total double")
    total = settle(parts.groupBy(*job.grp, F.col("q_id").alias("row_id")).agg(F.sum("total").alias("cf")))
    span = small_table(total.groupBy(*job.grp).agg(F.min("cf").alias("lo"), F.max("cf").alias("hi")))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("cf") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return total.transform(kernels.equi, span, job.grp).select(*job.grp, "row_id", scaled.alias(name))


@register("CCR")
def ccr(job: Job):
    """Koziarski & Wozniak 2017. A sphere around each row of the class grows until its energy
    (``energy``, 1.0) is used up, each enclosed row of other classes making further
    growth dearer; enclosed rows are pushed to the surface (the only method that
    moves originals); a row gets floor of its share of new rows, in proportion to 1/radius,
    uniform in its sphere.

    The radius solves r + sum(max(0, r - d_j)) = energy: convex and piecewise linear, so
    Newton's method from the right only falls and is exact after finitely many passes, each a ball count of
    the rows whose radius still fell by more than 1e-9.
    """
    energy = float(job.options.get("energy", 1.0))
    index = Neighbours(job.massed(job.others, job.grp), by=job.grp, carry=["weight"])
    moving, spheres = settle(job.minority.withColumn("radius", F.lit(energy))), None
    while True:
        parts = index.meet(moving, blocks.ball_stats(False, False), "count bigint, total double", extra=["radius"], reach="radius")
        sums = parts.groupBy(*job.grp, F.col("q_id").alias("row_id")).agg(F.sum("count").alias("_n"), F.sum("total").alias("_d"))
        n, d = F.coalesce("_n", F.lit(0).cast("bigint")), F.coalesce("_d", F.lit(0.0))
        fallen = F.least(F.col("radius"), (F.lit(energy) + d) / (1 + n))
        step = settle(moving.transform(kernels.equi, sums, [*job.grp, "row_id"], "left").select(
            *job.grp, "row_id", "features", fallen.alias("radius"), (F.col("radius") - fallen > 1e-9).alias("_moved")))
        resting = step.filter("NOT _moved").drop("_moved")
        spheres = resting if spheres is None else spheres.unionByName(resting)
        moving = step.filter("_moved").drop("_moved")
        if moving.isEmpty():
            break

    refs = Neighbours(spheres.withColumn("radius", F.col("radius")), by=job.grp, carry=["radius"])
    probes = job.others.withColumn("energy", F.lit(energy))
    parts = refs.meet(probes, blocks.push_out(), "shift array<double>", reach="energy")
    shift = parts.groupBy(*job.by, F.col("q_id").alias("row_id")).agg(
        sum_vector("shift").alias("shift"))
    moved = job.points.transform(kernels.equi, shift, [*job.by, "row_id"], "left").select(
        *job.by, "row_id", "label",
        F.when(F.col("shift").isNull(), F.col("features")).otherwise(
            F.zip_with("features", "shift", lambda x, s: x + s)).alias("features"))

    whole = small_table(spheres.groupBy(*job.grp).agg(F.sum(1 / F.col("radius")).alias("_inv")))
    share = spheres.transform(kernels.equi, whole, job.grp).transform(kernels.equi, job.needs.select(*job.grp, "n_needed"), job.grp)
    counted = share.select(
        *job.grp, F.col("row_id").alias("base_id"),
        F.floor(1 / F.col("radius") / F.col("_inv") * F.col("n_needed")).cast("bigint").alias("g"))
    made = kernels.draw_counted(counted, job.grp, ["base_id"], job.seed).select(*job.grp, "rep", "base_id")
    full = job.base_vec(made)
    full = kernels.attach(full, spheres, job.by, "base_id", large=job.large, radius="radius")
    way = F.transform("x", lambda x, i: normal(job.seed, "z", *job.keys, i))

    def stepped(way):
        length = F.sqrt(F.aggregate(way, F.lit(0.0), lambda acc, v: acc + v * v))
        step = F.col("radius") * F.pow(uniform(job.seed, "r", *job.keys), F.lit(1.0 / job.dim)) / length
        return let(step, lambda s: F.zip_with("x", way, lambda x, w: x + s * w))

    return moved, kernels.as_synthetic(full, job.by, let(way, stepped))
