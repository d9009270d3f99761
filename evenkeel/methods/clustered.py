"""Methods that cluster first and generate inside clusters.

Every one takes ``centers=`` (``by..., label, cluster, center``; KMeans_SMOTE without
label) to use given clusters; without it they are fitted, all groups together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions import blocks
from evenkeel.functions.rng import pick, uniform
from evenkeel.functions.vectors import distance, lerp, mean_vector, sum_vector
from evenkeel.methods.registry import Job, register
from evenkeel.methods.scorers import forest_scorer
from evenkeel.methods.smote import interpolate, smote
from evenkeel.operators import cluster, cure, kernels, linkage, lvq
from evenkeel.operators.groups import each_group
from evenkeel.operators.neighbours import Neighbours
from evenkeel.operators.runtime import settle, small_table


def _centers(job: Job, k) -> DataFrame:
    given = job.options.get("centers")
    if given is not None:
        return given
    return cluster.fit_centers(job.minority, job.grp, k, job.seed, job.options.get("restarts", 10))


def _members(job: Job, centers: DataFrame) -> DataFrame:
    """(by..., label, row_id, cluster, dist, features)."""
    placed = cluster.assign(job.minority, centers, job.grp)
    return settle(placed.transform(kernels.equi, job.minority, [*job.grp, "row_id"]))


def generate(job: Job, members: DataFrame, needs: DataFrame) -> DataFrame:
    """SMOTE inside each (class, cluster): ``needs`` has n_needed and offset per cluster."""
    grp = [*job.grp, "cluster"]
    made = kernels.draw_uniform(kernels.slots(needs, grp), members, grp, job.keys, job.seed)
    return interpolate(job, made.drop("cluster"), kernels.neighbour_lists(members, job.k, grp))


@register("cluster_SMOTE")
def cluster_smote(job: Job):
    """Cieslak et al. 2006: k-means on the class, a uniform cluster of two rows or more per new
    row, SMOTE inside. min(3, n) clusters (ours)."""
    members = _members(job, _centers(job, 3))
    sizes = members.groupBy(*job.grp, "cluster").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    line = Window.partitionBy(*job.grp).orderBy("cluster")  # at most 3 rows per class
    numbered = sizes.withColumn("_place", F.row_number().over(line)).withColumn(
        "_of", F.count(F.lit(1)).over(Window.partitionBy(*job.grp))).select(*job.grp, "cluster", "_place", "_of")
    many = numbered.select(*job.grp, "_of").distinct()
    chosen = job.slots.transform(kernels.equi, many, job.grp).withColumn("_place", pick(job.seed, "cluster", "_of", *job.keys) + 1).drop("_of")
    chosen = chosen.transform(kernels.equi, numbered.drop("_of"), [*job.grp, "_place"]).drop("_place")
    grp = [*job.grp, "cluster"]
    made = kernels.draw_uniform(chosen, members, grp, job.keys, job.seed)
    return interpolate(job, made.drop("cluster"), kernels.neighbour_lists(members, job.k, grp))


@register("KMeans_SMOTE")
def kmeans_smote(job: Job):
    """Douzas et al. 2018: k-means on all rows; clusters with (others + 1) / (own + 1) < 1 and at least
    two own rows are kept; sparser ones get more: weight = mean own distance^d / own rows.
    max(2, floor(sqrt(n))) clusters, at most ``clusters`` (50, ours); no cluster kept gives plain SMOTE."""
    centers = job.options.get("centers")
    if centers is None:
        centers = cluster.fit_centers(
            job.points, job.by, lambda n: min(job.options.get("clusters", 50), max(2, int(n**0.5))), job.seed, job.options.get("restarts", 10))
    placed = settle(cluster.assign(job.points, centers, job.by).transform(kernels.equi, job.points, [*job.by, "row_id"]))
    counts = placed.groupBy(*job.by, "cluster", "label").agg(F.count(F.lit(1)).alias("_own"))
    all_rows = placed.groupBy(*job.by, "cluster").agg(F.count(F.lit(1)).alias("_all"))
    rich = counts.transform(kernels.equi, all_rows, [*job.by, "cluster"]).transform(kernels.equi, job.needs.select(*job.grp), job.grp, "left_semi")
    rich = rich.filter((F.col("_own") >= 2) & ((F.col("_all") - F.col("_own") + 1) / (F.col("_own") + 1) < 1))
    grp = [*job.grp, "cluster"]
    members = settle(placed.transform(kernels.equi, rich.select(*grp), grp, "left_semi").select(*grp, "row_id", "features"))
    pairs = cluster.mean_pair_distance(members, grp)
    # powers of d overflow, so weights are formed from logarithms relative to the largest
    heavy = pairs.withColumn(
        "_log", F.lit(float(job.dim)) * F.log(F.greatest("mean_dist", F.lit(1e-10))) - F.log(F.col("n")))
    heavy = heavy.withColumn("weight", F.exp(F.col("_log") - F.max("_log").over(Window.partitionBy(*job.grp))))
    shares = small_table(cluster.allocate(heavy.select(*grp, "weight"), job.needs, job.grp))
    done = generate(job, members, shares)
    rest = job.needs.transform(kernels.equi, shares.select(*job.grp).distinct(), job.grp, "left_anti")
    return done.unionByName(smote(job.restricted(rest.select(*job.grp))))


@register("AKMeans_SMOTE")
def akmeans_smote(job: Job):
    """Adaptive k-means SMOTE: X-Means chooses k, k-means clusters the class, clusters that are
    too small or too sparse are left out, denser clusters get more rows, a classifier
    trained on the imbalanced rows filters what was made, and if less than 80 % remains the
    rest is made from the whole class without a filter.

    Options: min_cluster_size 3, max_sparsity_ratio 2.0, k_max 20, cv_folds 3, restarts 10; search_k
    (off) chooses k by cross-validation; ``scorer`` adds the probability of the own class as ``score``.
    """
    opt = job.options
    tiny = job.needs.filter(F.col("n") < 2).select(*job.grp)
    usual = job.restricted(job.needs.filter(F.col("n") >= 2).select(*job.grp))

    numbers = {}
    if opt.get("centers") is None:
        numbers = cluster.estimate_k(usual.minority, job.grp, opt.get("k_max", 20), job.seed)
        if opt.get("search_k"):
            from evenkeel.methods.search import search_k

            for key, part in each_group(usual.minority, job.grp):
                numbers[tuple(key)] = search_k(job, part, numbers[tuple(key)], opt.get("cv_folds", 3))
    members = _members(usual, _centers(usual, numbers))
    stats = cluster.sparsity(members, job.grp)
    good = cluster.stable(stats, job.grp, opt.get("min_cluster_size", 3), opt.get("max_sparsity_ratio", 2.0))
    shares = small_table(cluster.allocate(
        good.withColumn("weight", 1 / (F.col("sparsity") + F.lit(1e-10))), usual.needs, job.grp))
    clustered = shares.select(*job.grp).distinct()
    made = settle(generate(usual, members, shares))
    kept = settle(quality_filter(job, made, opt.get("scorer") or forest_scorer))
    left = kept.groupBy(*job.grp).agg(F.count(F.lit(1)).alias("_kept"))
    short = usual.needs.transform(kernels.equi, clustered, job.grp, "left_semi").transform(kernels.equi, left, job.grp, "left").fillna(0, ["_kept"])
    short = short.filter(F.col("_kept") < F.col("n_needed") * 0.8)
    refill_needs = small_table(short.select(
        *job.grp, (F.col("n_needed") - F.col("_kept")).alias("n_needed"), F.col("n_needed").alias("offset")))
    refill = interpolate(usual, kernels.draw_uniform(
        kernels.slots(refill_needs, job.grp), usual.minority, job.grp, job.keys, job.seed), usual.lists)
    plain = usual.needs.transform(kernels.equi, clustered, job.grp, "left_anti").select(*job.grp).unionByName(tiny)
    return kept.unionByName(refill).unionByName(smote(job.restricted(plain)))


def quality_filter(job: Job, made: DataFrame, scorer) -> DataFrame:
    """Keep rows whose own-class probability is at least a seeded uniform threshold."""
    scored = scorer(job, made)
    return scored.filter(F.col("score") >= uniform(job.seed, "keep", *job.keys)).drop("score")


@register("LVQ_SMOTE")
def lvq_smote(job: Job):
    """Nakamura et al. 2013: a codebook of min(``clusters``, n) vectors (16) of every class, trained by learning vector quantisation over all rows
    (``operators/lvq.py``, ``rounds`` rounds, 50) from k-means centers; each feature of a new row comes from one of the k vectors of its class nearest to the base (ours)."""
    centers = job.options.get("centers")
    if centers is None:
        starts = cluster.fit_centers(job.points, job.grp, job.options.get("clusters", 16), job.seed, job.options.get("restarts", 10))
        book, _ = lvq.train(job.points, job.by, starts.select(*job.grp, "cluster", "center"), int(job.options.get("rounds", 50)))
        centers = book.transform(kernels.equi, job.needs.select(*job.grp), job.grp, "left_semi")
    centers = centers.withColumn("center", F.col("center").cast("array<double>"))
    index = Neighbours(centers, by=job.grp, id="cluster", vec="center")
    near = index.knn(job.minority, job.k, skip_self=False).withColumnRenamed("nbr_id", "cluster")
    codes = near.transform(kernels.equi, centers, [*job.grp, "cluster"]).groupBy(*job.grp, F.col("q_id").alias("base_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "center"))).alias("codes"))  # k entries
    made = kernels.draw_uniform(job.slots, job.minority, job.grp, job.keys, job.seed)
    full = job.base_vec(made).transform(kernels.equi, codes, [*job.grp, "base_id"])

    def borrow(x, i):
        place = pick(job.seed, "code", F.size("codes"), *job.keys, i).cast("int")
        return F.get(F.get("codes", place)["center"], i)

    return kernels.as_synthetic(full, job.by, F.transform("x", borrow))


@register("CURE_SMOTE")
def cure_smote(job: Job):
    """Ma & Fan 2017: CURE clusters of the class, one per ten rows (``operators/cure.py``); those below 3 rows are noise;
    up to 5 representatives per cluster by farthest-point choice, shrunk by half towards the center;
    a new row lies between a random row and a random representative of its cluster."""
    grp = [*job.grp, "cluster"]
    if (centers := job.options.get("centers")) is not None:
        members = _members(job, centers)
    else:
        own = settle(cure.cure(job.minority, job.grp).transform(kernels.equi, job.minority.select(*job.grp, "row_id", "features"), [*job.grp, "row_id"]))
        centers = settle(own.groupBy(*grp).agg(mean_vector("features").alias("center")))
        members = settle(own.transform(kernels.equi, centers, grp).withColumn("dist", F.round(distance(F.col("features"), F.col("center")), blocks.DIGITS)).drop("center"))
    sizes = members.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 3)
    members = settle(members.transform(kernels.equi, sizes.select(*grp), grp, "left_semi").withColumn("_near", F.col("dist")))
    reps = None
    for turn in range(5):
        farthest = members.filter(F.col("_near") > 0).groupBy(*grp).agg(
            F.max_by(F.struct("row_id", "features"), F.struct(F.col("_near"), -F.col("row_id"))).alias("_r"))
        chosen = small_table(farthest.select(
            *grp, F.lit(turn).alias("turn"), F.col("_r.row_id").alias("rep_id"), F.col("_r.features").alias("rep_vec")))
        reps = chosen if reps is None else reps.unionByName(chosen)
        gap = F.round(distance(F.col("features"), F.col("rep_vec")), blocks.DIGITS)
        met = members.transform(kernels.equi, chosen.drop("turn", "rep_id"), grp, "left")
        near = gap if turn == 0 else F.least(F.col("_near"), gap)
        members = settle(met.withColumn("_near", F.coalesce(near, F.lit(0.0))).drop("rep_vec"))
    middle = centers.select(*grp, F.col("center").cast("array<double>").alias("center"))
    shrunk = reps.transform(kernels.equi, middle, grp).withColumn("rep_vec", lerp(F.col("center"), F.col("rep_vec"), F.lit(0.5))).drop("center")
    many = reps.groupBy(*grp).agg(F.count(F.lit(1)).alias("_of"))
    made = kernels.draw_uniform(job.slots, members, job.grp, job.keys, job.seed)
    full = job.base_vec(made)
    full = kernels.attach(full, members, job.by, "base_id", large=job.large, cluster="cluster").transform(kernels.equi, many, grp)
    full = full.withColumn("turn", pick(job.seed, "rep", "_of", *job.keys).cast("int")).transform(kernels.equi, shrunk, [*grp, "turn"])
    full = full.withColumn("nbr_id", F.col("rep_id"))
    share = uniform(job.seed, "lam", *job.keys)
    return kernels.as_synthetic(full, job.by, lerp(F.col("rep_vec"), F.col("x"), share))


@register("MWMOTE")
def mwmote(job: Job):
    """Barua et al. 2014. Class rows with no own row among their 5 nearest are noise; the 3 nearest
    other rows of the rest are the border B; each y in B lends weight to its nearest half of
    the class: closeness C = min(d / distance, 5) / 5 * 2 times C / (sum of C over those rows).
    Bases follow the weights, the partner is a random row of the base's cluster: average linkage over the class, cut at ``spread`` (3) times the mean distance of
    a row that is not noise to its nearest one (``operators/linkage.py``). Rows tied at the half-way distance all count (ours)."""
    sure = job.crowd(5).filter(F.col("m") < F.col("kk"))
    filtered = job.minority.transform(kernels.equi, sure.select(*job.grp, "row_id"), [*job.grp, "row_id"], "left_semi")
    rest = settle(job.others.select(*job.grp, "row_id", "features"))
    outer = Neighbours(rest, by=job.grp, copies=4).knn(filtered, 3, skip_self=False)
    border_ids = outer.select(*job.grp, F.col("nbr_id").alias("row_id")).distinct()
    border = settle(rest.transform(kernels.equi, border_ids, [*job.grp, "row_id"]))
    half = border.transform(kernels.equi, job.needs.select(*job.grp, F.greatest(F.lit(1), F.floor(F.col("n") / 2)).alias("want")), job.grp)
    reach = kth_distance(half, job.minority, job.grp)
    aimed = settle(border.transform(kernels.equi, reach, [*job.grp, "row_id"]))
    index = Neighbours(job.minority, by=job.grp)
    close = blocks.close_weights(job.dim, 5.0, 2.0, False)
    norm = index.meet(aimed, close, "total double", extra=["reach"], reach="reach")
    norm = norm.groupBy(*job.grp, F.col("q_id").alias("row_id")).agg(F.sum("total").alias("norm"))
    lenders = Neighbours(aimed.transform(kernels.equi, norm, [*job.grp, "row_id"]), by=job.grp, carry=["reach", "norm"])
    widest = aimed.groupBy(*job.grp).agg(F.max("reach").alias("widest"))
    parts = lenders.meet(job.minority.transform(kernels.equi, widest, job.grp), blocks.close_weights(job.dim, 5.0, 2.0, True),
                         "total double", reach="widest")
    weights = parts.groupBy(*job.grp, F.col("q_id").alias("row_id")).agg(F.sum("total").alias("weight"))
    made = kernels.draw_weighted(weights, job.needs, job.grp, job.seed)
    if job.options.get("centers") is not None:
        members = _members(job, job.options["centers"])
    else:
        alone = Neighbours(filtered, by=job.grp, copies=2).knn(filtered, 1)
        cuts = settle(alone.groupBy(*job.grp).agg((F.avg("dist") * float(job.options.get("spread", 3.0))).alias("cut")))
        members = settle(linkage.average_linkage(job.minority, job.grp, cuts))
    grp = [*job.grp, "cluster"]
    made = kernels.attach(made, members, job.by, "base_id", large=job.large, cluster="cluster")
    made = kernels.draw_uniform(made, members, grp, job.keys, job.seed, "partner", "nbr_id")
    full = job.nbr_vec(job.base_vec(made), "inner")
    return kernels.as_synthetic(full, job.by, lerp(F.col("x"), F.col("nbr"), uniform(job.seed, "lam", *job.keys)))


def kth_distance(queries: DataFrame, refs: DataFrame, grp, bins: int = 64) -> DataFrame:
    """(grp..., row_id, reach): distance of each query to its ``want``-th nearest reference.

    ``want`` may grow with the data, so nothing is listed: band counts narrow the interval
    that holds the answer until it is below the rounding of distances.
    """
    index = Neighbours(refs, by=grp)
    box = refs.groupBy(*grp).agg(*[
        getattr(F, f)(getattr(F, g)("features")).alias(n) for f, g, n in (("min", "array_min", "_a"), ("max", "array_max", "_b"))])
    own = queries.groupBy(*grp).agg(F.min(F.array_min("features")).alias("_c"), F.max(F.array_max("features")).alias("_d"))
    side = (F.greatest("_b", "_d") - F.least("_a", "_c"))
    state = queries.transform(kernels.equi, box, list(grp)).transform(kernels.equi, own, list(grp)).select(
        *grp, "row_id", "features", "want", F.lit(-1e-9).alias("lo"), (side * F.sqrt(F.size("features")) + 1e-6).alias("hi"))
    state = settle(state)
    step = 0.2 * 10.0**-blocks.DIGITS
    while True:
        parts = index.meet(state, blocks.band_counts(bins), "counts array<double>", extra=["lo", "hi"], reach="hi")
        total = parts.groupBy(*grp, F.col("q_id").alias("row_id")).agg(sum_vector("counts").alias("counts"))
        both = state.transform(kernels.equi, total, [*grp, "row_id"])
        # first band whose running count reaches want; counts[0] holds everything at or below lo
        running = F.aggregate(
            "counts", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("band")),
            lambda acc, c: F.struct(
                (acc["sum"] + c).alias("sum"), (acc["band"] + (acc["sum"] + c < F.col("want")).cast("int")).alias("band")),
            lambda acc: acc["band"])
        span = (F.col("hi") - F.col("lo")) / bins
        narrowed = both.withColumn("_band", running).select(
            *grp, "row_id", "features", "want",
            (F.col("lo") + span * (F.col("_band") - 1)).alias("lo"), (F.col("lo") + span * F.col("_band")).alias("hi"))
        state = settle(narrowed)
        # the interval also stops shrinking at the resolution of doubles
        if state.filter((F.col("hi") - F.col("lo") > step) & (F.col("hi") - F.col("lo") > F.col("hi") * 1e-14)).isEmpty():
            return state.select(*grp, "row_id", F.round(F.col("hi"), blocks.DIGITS).alias("reach"))
