"""Methods that add seeded normal noise instead of interpolating."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions.rng import normal, uniform
from evenkeel.functions.vectors import std_vector
from evenkeel.methods.registry import Job, register
from evenkeel.operators import kernels
from evenkeel.operators.runtime import small_table


def _spread(job: Job, population: bool):
    return small_table(job.minority.groupBy(*job.grp).agg(
        std_vector("features", population).alias("sd"), F.count(F.lit(1)).alias("n")))


def _bases(job: Job):
    return job.base_vec(kernels.draw_uniform(job.slots, job.minority, job.grp, job.keys, job.seed))


@register("ROSE")
def rose(job: Job):
    """Menardi & Torelli 2014, smoothed bootstrap: x + N(0, h^2) with
    h_q = (4 / ((d + 2) n))^(1 / (d + 4)) * sd_q (sample sd of the class). Only the short
    class is drawn and originals are kept (ours)."""
    full = _bases(job).transform(kernels.equi, _spread(job, False), job.grp)
    d = job.dim
    width = F.pow(F.lit(4.0) / (F.lit(float(d + 2)) * F.col("n")), F.lit(1.0 / (d + 4)))
    full = full.withColumn("h", width)
    return kernels.as_synthetic(full, job.by, F.transform(
        "x", lambda x, i: x + F.col("h") * F.coalesce(F.get("sd", i), F.lit(0.0)) * normal(job.seed, "z", *job.keys, i)))


@register("NDO_sampling")
def ndo(job: Job):
    """Zhang & Wang 2011: x_q - z * sd_q / sqrt(n), population sd, per feature."""
    full = _bases(job).transform(kernels.equi, _spread(job, True), job.grp)
    return kernels.as_synthetic(full, job.by, F.transform(
        "x", lambda x, i: x - normal(job.seed, "z", *job.keys, i) * F.get("sd", i) / F.sqrt("n")))


@register("Gaussian_SMOTE")
def gaussian_smote(job: Job):
    """Lee et al. 2017: a uniform gap towards the neighbour per feature, then normal noise
    of 0.05 times the segment (0.05 is ours)."""
    made = kernels.draw_uniform(job.slots, job.minority, job.grp, job.keys, job.seed)
    full = job.nbr_vec(job.base_vec(kernels.draw_neighbour(made, job.lists, job.by, job.keys, job.seed, large=job.large)))

    def move(x, i):
        gap = F.coalesce(F.get("nbr", i) - x, F.lit(0.0))
        return x + uniform(job.seed, "lam", *job.keys, i) * gap + F.lit(0.05) * normal(job.seed, "z", *job.keys, i) * F.abs(gap)

    return kernels.as_synthetic(full, job.by, F.transform("x", move))
