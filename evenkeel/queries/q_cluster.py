"""Queries for cluster operators and clustered or model-based methods.

Iterative fits are not SQL. Twins are given centers, axes and scores that SQL can
compute too; the ``_fit`` queries run the fits and have no twin, but for ``c_kmeans_fit``, ``c_xmeans_fit``, ``o_clustered_fit`` and ``g_principal_axes``,
which return what must hold for any right fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from evenkeel.functions.rng import uniform
from evenkeel.functions.vectors import distance, dot, mean_vector
from evenkeel.methods import clustered, model_based  # noqa: F401  (register the methods)
from evenkeel.methods.registry import fit_resample
from evenkeel.operators import cluster, linkage, lvq, moments
from evenkeel.operators.kernels import equi
from evenkeel.operators.runtime import settle
from evenkeel.queries.base import (
    CROWD, MIN_CTES, NBR, OWN, OWNK, embedding_points, flat, knn, pick, query, resampled, table, u, uniform_draw, with_, z,
)
from evenkeel.queries.q_density import weighted
from evenkeel.queries.q_smote import LAM, LERP, XN, resample


def given_centers(spark, sf_dir, k=5):
    """The k minority rows of smallest id as centers."""
    first = embedding_points(spark, sf_dir).filter("label = 1").orderBy("row_id").limit(k)
    line = Window.partitionBy("label").orderBy("row_id")
    return first.select("label", (F.row_number().over(line) - 1).cast("bigint").alias("cluster"), F.col("features").alias("center"))


def centers_sql(k=5):
    return f"cen AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS cluster, x AS center FROM (SELECT * FROM p ORDER BY row_id LIMIT {k}))"


CLU = """clu AS (SELECT a.row_id, a.x, cluster, round(list_distance(a.x, center), 9) AS dist FROM p a CROSS JOIN cen
  QUALIFY row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_distance(a.x, center), 9), cluster) = 1)"""
SPARSE = "stats AS (SELECT cluster, count(*) AS size, CASE WHEN count(*) < 2 THEN 0 ELSE avg(dist) END::DOUBLE AS sparsity FROM clu GROUP BY cluster)"
STABLE = """stab AS (SELECT * FROM (SELECT *, 2.0::DOUBLE * quantile_cont(sparsity, 0.5) OVER () AS lim FROM stats WHERE size >= 3)
  WHERE sparsity <= lim)"""


def allocate_sql(source: str) -> str:
    """CTE ``share`` from (cluster, weight)."""
    return f"""alloc AS (SELECT *, greatest(0, g - coalesce(sum(want) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room
  FROM (SELECT *, greatest(1, floor(sh * g)) AS want FROM (SELECT cluster, weight / sum(weight) OVER () AS sh, g FROM {source} CROSS JOIN need))),
share AS (SELECT cluster, n_needed::BIGINT AS n_needed,
  coalesce(sum(n_needed) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM (
  SELECT *, least(want, room) + (row_number() OVER (ORDER BY sh DESC, cluster) <= g - sum(least(want, room)) OVER ())::INT AS n_needed FROM alloc))"""


WEIGHT = "wts AS (SELECT cluster, 1 / (sparsity + 1e-10::DOUBLE) AS weight FROM stab)"


def placed(spark, sf_dir):
    points = embedding_points(spark, sf_dir).filter("label = 1")
    return points, cluster.assign(points, given_centers(spark, sf_dir), ["label"])


@query("c_assign_clusters", f"{with_(*MIN_CTES[:2], centers_sql(), CLU)} SELECT 1::INT AS label, row_id, cluster::BIGINT AS cluster, round(dist, 6) AS dist FROM clu")
def c_assign(spark, sf_dir):
    return placed(spark, sf_dir)[1].withColumn("dist", F.round("dist", 6))


@query("c_cluster_sparsity", f"{with_(*MIN_CTES[:2], centers_sql(), CLU, SPARSE)} SELECT 1::INT AS label, cluster::BIGINT AS cluster, size, round(sparsity, 6) AS sparsity FROM stats")
def c_sparsity(spark, sf_dir):
    return cluster.sparsity(placed(spark, sf_dir)[1], ["label"]).withColumn("sparsity", F.round("sparsity", 6))


@query("c_stable_clusters", f"{with_(*MIN_CTES[:2], centers_sql(), CLU, SPARSE, STABLE)} SELECT 1::INT AS label, cluster::BIGINT AS cluster, size, round(sparsity, 6) AS sparsity FROM stab")
def c_stable(spark, sf_dir):
    stats = cluster.sparsity(placed(spark, sf_dir)[1], ["label"])
    return cluster.stable(stats, ["label"]).withColumn("sparsity", F.round("sparsity", 6))


@query("c_allocate", f"{with_(*MIN_CTES[:3], centers_sql(), CLU, SPARSE, STABLE, WEIGHT, allocate_sql('wts'))} SELECT 1::INT AS label, cluster::BIGINT AS cluster, n_needed, off AS \"offset\" FROM share")
def c_allocate(spark, sf_dir):
    from evenkeel.operators import kernels

    stats = cluster.stable(cluster.sparsity(placed(spark, sf_dir)[1], ["label"]), ["label"])
    needs = kernels.targets(embedding_points(spark, sf_dir)).filter("n_needed > 0")
    return cluster.allocate(stats.withColumn("weight", 1 / (F.col("sparsity") + F.lit(1e-10))), needs, ["label"]).withColumn(
        "offset", F.col("offset").cast("bigint"))


# ---- fits: what any right fit has ----------------------------------------


def by_label(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("features"))


@query("c_kmeans_fit", """SELECT label, count(*) AS n_rows, least(5, count(*)) AS clusters, true AS centers_are_means, true AS cheaper_than_first_rows
FROM embeddings GROUP BY label""")
def c_kmeans_fit(spark, sf_dir):
    """Five clusters of every label, ten restarts each, in one job: centers are the means of the rows nearest to them, at a cost below
    that of the label's first five rows as centers."""
    points = by_label(spark, sf_dir)
    centers = cluster.fit_centers(points, ["label"], 5, 42)
    line = Window.partitionBy("label").orderBy("row_id")
    first = points.withColumn("cluster", F.row_number().over(line).cast("bigint")).filter("cluster <= 5").select("label", "cluster", F.col("features").alias("center"))
    cost = cluster.assign(points, first, ["label"]).groupBy("label").agg(F.sum(F.col("dist") ** 2).alias("given"))
    placed = cluster.assign(points, centers, ["label"])
    means = placed.join(points, ["label", "row_id"]).groupBy("label", "cluster").agg(
        mean_vector("features").alias("mean"), F.count(F.lit(1)).alias("n"), F.sum(F.col("dist") ** 2).alias("own"))
    gap = F.array_max(F.zip_with("mean", "center", lambda a, b: F.abs(a - b)))
    return means.join(centers, ["label", "cluster"]).groupBy("label").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("clusters"), (F.max(gap) < 1e-6).alias("centers_are_means"), F.sum("own").alias("own")).join(cost, "label").select(
        "label", "n_rows", "clusters", "centers_are_means", (F.col("own") < F.col("given")).alias("cheaper_than_first_rows"))


@query("c_xmeans_fit", "SELECT label, count(*) AS n_rows, true AS within_limits FROM embeddings GROUP BY label")
def c_xmeans_fit(spark, sf_dir):
    """The number of clusters of every label by X-Means, all labels together."""
    points = by_label(spark, sf_dir)
    found = spark.createDataFrame([(*key, k) for key, k in cluster.estimate_k(points, ["label"]).items()], "label int, k int")
    sizes = points.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.join(found, "label").select("label", "n_rows", F.col("k").between(2, F.least(F.lit(20), "n_rows")).alias("within_limits"))


FITTED = ["AKMeans_SMOTE", "KMeans_SMOTE", "cluster_SMOTE"]


@query("o_clustered_fit", f"""{with_(*MIN_CTES[:3])} SELECT method, (SELECT count(*) FROM pts) AS originals, true AS wanted_size, true AS between_rows
FROM (SELECT unnest({FITTED}) AS method)""")
def o_clustered_fit(spark, sf_dir):
    """The clustered methods with their own fits, ten restarts: originals are all there, classes have the size asked for (adaptive k-means may stay up to a fifth
    short), and every new row lies between two rows of the class."""
    points = embedding_points(spark, sf_dir)
    short = points.agg(F.sum(F.when(F.col("label") == 0, 1).otherwise(-1)).alias("g"))
    out = None
    for method in FITTED:
        rows = settle(fit_resample(points, method))
        own = points.filter("label = 1").select("row_id", "features")
        ends = rows.filter("is_synthetic").select("row_id", "base_id", "nbr_id", F.col("features").alias("x")).join(
            own.select(F.col("row_id").alias("base_id"), F.col("features").alias("a")), "base_id", "left").join(
            own.select(F.col("row_id").alias("nbr_id"), F.col("features").alias("b")), "nbr_id", "left")
        off = F.abs(distance("x", "a") + distance("x", F.coalesce("b", "x")) - F.coalesce(distance("a", "b"), F.lit(0.0)))
        made = ends.agg(F.count(F.lit(1)).alias("made"), F.max(F.coalesce(off, F.lit(1e9))).alias("off"))
        kept = rows.filter("NOT is_synthetic").agg(F.count(F.lit(1)).alias("originals"))
        least = 0.8 if method == "AKMeans_SMOTE" else 1.0
        one = kept.crossJoin(made).crossJoin(short).select(  # one row each
            F.lit(method).alias("method"), "originals", ((F.col("made") <= F.col("g")) & (F.col("made") >= F.col("g") * least)).alias("wanted_size"), (F.col("off") < 1e-6).alias("between_rows"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- generation inside clusters -----------------------------------------

CKNN = knn("cown", "clu", "clu", 5, by="cluster")
CIDX = f"cidx AS (SELECT row_id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY {u('idx', 'row_id')}, row_id) AS idx, count(*) OVER (PARTITION BY cluster) AS n FROM clu)"


def in_cluster(slots: str) -> list[str]:
    """CTEs from slots (rep, cluster) to xn."""
    return [
        CKNN, CIDX, "cownk AS (SELECT q_id, count(*) AS kk FROM cown GROUP BY q_id)",
        f"cdraw AS (SELECT s.*, i.row_id AS base_id FROM {slots} s JOIN cidx i ON i.cluster = s.cluster AND i.idx = {pick('base', 'i.n', 1, 's.rep')} + 1)",
        f"""cpaired AS (SELECT d.*, o.nbr_id FROM cdraw d LEFT JOIN cownk k ON k.q_id = d.base_id
  LEFT JOIN cown o ON o.q_id = d.base_id AND o.rk = {pick('nbr', 'k.kk', 1, 'd.rep')} + 1)""",
        "cxn AS (SELECT d.*, a.x AS bx, b.x AS nx FROM cpaired d JOIN p a ON a.row_id = d.base_id LEFT JOIN p b ON b.row_id = d.nbr_id)",
    ]


CSLOTS = "cslots AS (SELECT cluster, off + unnest(range(1, n_needed + 1)) AS rep FROM share)"


def with_centers(method, k=5, **options):
    def run(spark, sf_dir):
        return flat(fit_resample(embedding_points(spark, sf_dir), method, centers=given_centers(spark, sf_dir, k), **options))

    return run


CLUSTER_SMOTE = [
    centers_sql(3), CLU,
    "csz AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS place, count(*) OVER () AS many FROM (SELECT cluster FROM clu GROUP BY cluster HAVING count(*) > 1))",
    f"pslots AS (SELECT rep, cluster FROM slots s JOIN csz ON place = {pick('cluster', 'many', 1, 's.rep')} + 1)",
    *in_cluster("pslots"),
]
query("o_cluster_smote", resampled([*MIN_CTES, *CLUSTER_SMOTE], "cxn", LERP))(with_centers("cluster_SMOTE", 3))

AKM = [
    centers_sql(), CLU, SPARSE, STABLE, WEIGHT, allocate_sql("wts"), CSLOTS, *in_cluster("cslots"),
    f"kept AS (SELECT rep, base_id, nbr_id, bx, nx FROM cxn s WHERE {u('score', 1, 's.rep')} >= {u('keep', 1, 's.rep')})",
    "short_ AS (SELECT g, (SELECT count(*) FROM kept) AS got FROM need WHERE (SELECT count(*) FROM kept) < 0.8 * g)",
    "rslots AS (SELECT g + unnest(range(1, g - got + 1)) AS rep FROM short_)",
    OWN, OWNK, uniform_draw("p", made="rslots"), NBR, XN,
    "both_ AS (SELECT rep, base_id, nbr_id, bx, nx FROM kept UNION ALL SELECT rep, base_id, nbr_id, bx, nx FROM xn)",
]


def seeded_score(job, made):
    """A score SQL can compute, in place of the forest."""
    return made.withColumn("score", uniform(job.seed, "score", *job.keys))


query("o_akmeans_smote", resampled([*MIN_CTES, *AKM], "both_", LERP))(with_centers("AKMeans_SMOTE", scorer=seeded_score))


def label_means(spark, sf_dir):
    """Mean vector of every embedding label as centers over all rows."""
    means = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    return means.groupBy("label").agg(mean_vector("e").alias("center")).select(F.col("label").cast("bigint").alias("cluster"), "center")


KM = [
    """cen AS (SELECT cluster, list(v ORDER BY pos) AS center FROM (SELECT label AS cluster, pos, avg(embedding[pos + 1]::DOUBLE) AS v
  FROM embeddings CROSS JOIN range(0, 64) r(pos) GROUP BY 1, 2) GROUP BY cluster)""",
    CLU.replace("clu AS (SELECT a.row_id, a.x,", "allclu AS (SELECT a.row_id, a.label, a.x,").replace("FROM p a", "FROM pts a"),
    "rich AS (SELECT cluster FROM allclu GROUP BY cluster HAVING sum(label) >= 2 AND (count(*) - sum(label) + 1) / (sum(label) + 1) < 1)",
    "clu AS (SELECT * FROM allclu WHERE label = 1 AND cluster IN (SELECT cluster FROM rich))",
    """mpd AS (SELECT a.cluster, sum(round(list_distance(a.x, b.x), 9)) / (any_value(n) * (any_value(n) - 1)) AS md, any_value(n) AS n FROM clu a
  JOIN clu b ON a.cluster = b.cluster JOIN (SELECT cluster, count(*) AS n FROM clu GROUP BY cluster) c ON c.cluster = a.cluster GROUP BY a.cluster)""",
    "lw AS (SELECT cluster, 64 * ln(greatest(md, 1e-10)) - ln(n) AS l FROM mpd)",
    "wts AS (SELECT cluster, exp(l - max(l) OVER ()) AS weight FROM lw)",
    allocate_sql("wts"), CSLOTS, *in_cluster("cslots"),
    "fslots AS (SELECT rep FROM slots WHERE (SELECT count(*) FROM share) = 0)",
    OWN, OWNK, uniform_draw("p", made="fslots"), NBR, XN,
    "both_ AS (SELECT rep, base_id, nbr_id, bx, nx FROM cxn UNION ALL SELECT rep, base_id, nbr_id, bx, nx FROM xn)",
]


@query("o_kmeans_smote", resampled([*MIN_CTES, *KM], "both_", LERP))
def o_kmeans(spark, sf_dir):
    return flat(fit_resample(embedding_points(spark, sf_dir), "KMeans_SMOTE", centers=label_means(spark, sf_dir)))


LVQ = [
    centers_sql(16),
    """near_c AS (SELECT a.row_id, center, row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_distance(a.x, center), 9), cluster) AS rk FROM p a CROSS JOIN cen QUALIFY rk <= 5)""",
    "codes AS (SELECT row_id, list(center ORDER BY rk) AS codes FROM near_c GROUP BY row_id)", uniform_draw("p"),
    "xn AS (SELECT d.*, NULL::BIGINT AS nbr_id, codes FROM draw d JOIN codes c ON c.row_id = d.base_id)",
]
query("o_lvq_smote", resampled([*MIN_CTES, *LVQ], "xn", f"s.codes[{pick('code', 'len(s.codes)', 1, 's.rep', 'pos')} + 1][pos + 1]"))(
    with_centers("LVQ_SMOTE", 16))


def cure_sql() -> str:
    ctes = [*MIN_CTES, centers_sql(), CLU.replace("cluster, round", "cluster, center, round"),
            "mem0 AS (SELECT *, dist AS near FROM clu WHERE cluster IN (SELECT cluster FROM clu GROUP BY cluster HAVING count(*) >= 3))"]
    for t in range(5):
        gap = "round(list_distance(m.x, r.rx), 9)"
        ctes.append(f"""rep{t} AS (SELECT cluster, {t} AS turn, row_id AS rep_id, x AS rx, center FROM mem{t} WHERE near > 0
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY near DESC, row_id) = 1)""")
        ctes.append(f"""mem{t + 1} AS (SELECT m.row_id, m.x, m.cluster, m.center,
  coalesce({gap if t == 0 else f'least(m.near, {gap})'}, 0) AS near FROM mem{t} m LEFT JOIN rep{t} r USING (cluster))""")
    ctes += [
        "reps AS (" + " UNION ALL ".join(f"SELECT * FROM rep{t}" for t in range(5)) + ")",
        "many AS (SELECT cluster, count(*) AS many FROM reps GROUP BY cluster)", uniform_draw("mem0"),
        f"""xn AS (SELECT d.rep, d.base_id, r.rep_id AS nbr_id, m.x AS bx, r.rx, r.center FROM draw d JOIN mem0 m ON m.row_id = d.base_id
  JOIN many USING (cluster) JOIN reps r ON r.cluster = m.cluster AND r.turn = {pick('rep', 'many', 1, 'd.rep')})""",
    ]
    rep = "(s.center[pos + 1] + 0.5::DOUBLE * (s.rx[pos + 1] - s.center[pos + 1]))"
    return resampled(ctes, "xn", f"{rep} + {LAM} * (s.bx[pos + 1] - {rep})")


query("o_cure_smote", cure_sql())(with_centers("CURE_SMOTE"))

MW = [
    *CROWD, "sure AS (SELECT p.* FROM p JOIN crowd USING (row_id) WHERE m < kk)", "n0 AS (SELECT * FROM pts WHERE label = 0)",
    knn("bord", "sure", "n0", 3, skip_self=False),
    "border AS (SELECT * FROM n0 WHERE row_id IN (SELECT nbr_id FROM bord))",
    """lend AS (SELECT b.row_id AS y, a.row_id, round(list_distance(a.x, b.x), 9) AS d FROM border b CROSS JOIN p a
  QUALIFY rank() OVER (PARTITION BY b.row_id ORDER BY round(list_distance(a.x, b.x), 9)) <= greatest(1, (SELECT count(*) FROM p) // 2))""",
    "cf AS (SELECT *, CASE WHEN d = 0 THEN 5 ELSE least(64 / d, 5) END / 5 * 2 AS c FROM lend)",
    "wts AS (SELECT row_id, sum(c * c / s) AS weight FROM (SELECT *, sum(c) OVER (PARTITION BY y) AS s FROM cf) GROUP BY row_id)",
    weighted("wts"), centers_sql(), CLU, CIDX,
    f"""xn AS (SELECT d.rep, d.base_id, i.row_id AS nbr_id, a.x AS bx, b.x AS nx FROM draw d JOIN clu a ON a.row_id = d.base_id
  JOIN cidx i ON i.cluster = a.cluster AND i.idx = {pick('partner', 'i.n', 1, 'd.rep')} + 1 JOIN p b ON b.row_id = i.row_id)""",
]
query("o_mwmote", resampled([*MIN_CTES, *MW], "xn", LERP))(with_centers("MWMOTE"))

# ---- model-based ---------------------------------------------------------


def even_axis(spark):
    return spark.createDataFrame([(1, [0.125] * 64)], "label int, axis array<double>")


GS = "dots AS (SELECT rep, sum((nx[pos + 1] - bx[pos + 1]) * 0.125::DOUBLE) AS along FROM xn CROSS JOIN range(0, 64) r(pos) GROUP BY rep)"


@query("o_g_smote", resampled([*MIN_CTES, OWN, OWNK, uniform_draw("p"), NBR, XN, GS, "xnd AS (SELECT xn.*, along FROM xn JOIN dots USING (rep))"],
                              "xnd", f"s.bx[pos + 1] + {LAM} * coalesce(s.along, 0) * 0.125::DOUBLE"))
def o_g_smote(spark, sf_dir):
    return flat(fit_resample(embedding_points(spark, sf_dir), "G_SMOTE", axis=even_axis(spark)))


# a reflection as axes (identity minus 2/d) and variances 0.01 * (j + 1), around the origin
MDOS = [
    *CROWD, "wts AS (SELECT row_id, (kk - m)::DOUBLE AS weight FROM crowd WHERE kk - m >= 1)", weighted("wts"),
    "bse AS (SELECT d.rep, d.base_id, a.x, list_sum(a.x) AS t FROM draw d JOIN p a ON a.row_id = d.base_id)",
    f"comp AS (SELECT rep, pos, x[pos + 1] - t * 2 / 64 AS zc, 0.01::DOUBLE * (pos + 1) AS v, {z('z', 1, 'rep', 'pos')} AS gz FROM bse CROSS JOIN range(0, 64) r(pos))",
    "shell AS (SELECT rep, sum(zc * zc / v) AS a, sqrt(sum(gz * gz)) AS len FROM comp GROUP BY rep)",
    "rr AS (SELECT rep, pos, gz * sqrt(a * v) / len AS r FROM comp JOIN shell USING (rep))",
    "rs AS (SELECT rep, list(r ORDER BY pos) AS r, sum(r) AS t FROM rr GROUP BY rep)",
    "xn AS (SELECT b.rep, b.base_id, NULL::BIGINT AS nbr_id, rs.r, rs.t AS tr FROM bse b JOIN rs USING (rep))",
]


@query("o_mdo", resampled([*MIN_CTES, *MDOS], "xn", "s.r[pos + 1] - s.tr * 2 / 64"))
def o_mdo(spark, sf_dir):
    axes = [[(1.0 if i == j else 0.0) - 2 / 64 for j in range(64)] for i in range(64)]
    frame = [((1,), [0.0] * 64, axes, [0.01 * (j + 1) for j in range(64)])]
    return flat(fit_resample(embedding_points(spark, sf_dir), "MDO", frame=frame, k1=1))


def supervised_sql() -> str:
    ctes, size = [*MIN_CTES, OWN, OWNK], "(SELECT g FROM need)"
    ctes.append("off0 AS (SELECT g AS n, 0 AS off FROM need)")
    for r in range(3):
        ctes += [
            f"s{r} AS (SELECT off + unnest(range(1, n + 1)) AS rep FROM off{r})", uniform_draw("p", f"d{r}", made=f"s{r}"),
            f"good{r} AS (SELECT * FROM d{r} s WHERE {u('score', 1, 's.rep')} >= 0.5)",
            f"off{r + 1} AS (SELECT n - (SELECT count(*) FROM good{r}) AS n, off + n AS off FROM off{r})",
        ]
    poor = " UNION ALL ".join(f"SELECT s.rep, s.base_id, 1 - {u('score', 1, 's.rep')} AS gap FROM d{r} s" for r in range(3))
    ctes.append(f"""fill AS (SELECT rep, base_id FROM ({poor}) WHERE gap > 0.5
  QUALIFY row_number() OVER (ORDER BY gap, rep) <= (SELECT n FROM off3))""")
    made = [f"good{r}" for r in range(3)] + ["fill"]
    ctes += ["draw AS (" + " UNION ALL ".join(f"SELECT rep, base_id FROM {m}" for m in made) + ")", NBR, XN]
    return resampled(ctes, "xn", LERP)


query("o_supervised_smote", supervised_sql())(resample("Supervised_SMOTE", scorer=seeded_score))

# ---- with Spark ML fits, no twins ---------------------------------------

for name, method, options in [
    ("o_akmeans_smote_fit", "AKMeans_SMOTE", {}), ("o_kmeans_smote_fit", "KMeans_SMOTE", {}),
    ("o_cluster_smote_fit", "cluster_SMOTE", {}), ("o_lvq_smote_fit", "LVQ_SMOTE", {}),
    ("o_cure_smote_fit", "CURE_SMOTE", {}), ("o_mwmote_fit", "MWMOTE", {}), ("o_g_smote_fit", "G_SMOTE", {}),
    ("o_mdo_fit", "MDO", {}), ("o_supervised_smote_fit", "Supervised_SMOTE", {}),
]:
    query(name)(resample(method, **options))


def uncorrelated(scores, variances, few: int):
    """Whether the first ``few`` scores have the given variances and no correlation, by Spark's own aggregates."""
    at = [scores[i] for i in range(few)]
    tests = [F.abs(F.var_samp(at[i]) - F.first(variances)[i]) <= 1e-9 for i in range(few)]
    tests += [F.abs(F.covar_samp(at[i], at[j])) <= 1e-9 for i in range(few) for j in range(i)]
    return reduce(lambda a, b: a & b, tests)


@query("g_principal_axes", """SELECT label, any_value(n) AS n, round(sum(v), 6) AS total_variance, true AS orthonormal, true AS falling, true AS uncorrelated FROM (
  SELECT label, pos, count(*) AS n, var_samp(embedding[pos + 1]::DOUBLE) AS v FROM embeddings CROSS JOIN range(0, 64) t(pos) GROUP BY ALL) GROUP BY label""")
def g_principal_axes(spark, sf_dir):
    """Axes of every class of the embeddings by one job, and what must hold for any right ones."""
    points = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("features"))
    found = settle(moments.axes(points, ["label"]))
    scores = points.transform(equi, found.select("label", "axes", "variances"), ["label"]).select(
        "label", "variances", F.transform(F.slice("axes", 1, 4), lambda a: dot(a, F.col("features"))).alias("s"))
    judged = scores.groupBy("label").agg(uncorrelated(F.col("s"), F.col("variances"), 4).alias("uncorrelated"))
    places = F.sequence(F.lit(0), F.lit(63))
    gram = F.forall(places, lambda i: F.forall(places, lambda j: F.abs(dot(F.get("axes", i), F.get("axes", j)) - (i == j).cast("double")) <= 1e-9))
    total = F.aggregate("variances", F.lit(0.0), lambda a, v: a + v)
    falling = F.forall(F.sequence(F.lit(1), F.lit(63)), lambda i: F.get("variances", i) <= F.get("variances", i - 1))
    return found.select("label", "n", F.round(total, 6).alias("total_variance"), gram.alias("orthonormal"), falling.alias("falling")).transform(equi, judged, ["label"])


@query("c_lvq_round", f"""{with_(MIN_CTES[0])},
book AS (SELECT label AS lab, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS cluster, x AS w FROM pts QUALIFY cluster < 2),
near AS (SELECT row_id, label, lab, cluster, round(list_distance(x, w), 9) ^ 2 AS g, x, w FROM pts CROSS JOIN book
  QUALIFY row_number() OVER (PARTITION BY row_id, lab = label ORDER BY g, lab, cluster) = 1),
gaps AS (SELECT row_id, max(g) FILTER (lab = label) AS p, max(g) FILTER (lab <> label) AS m FROM near GROUP BY row_id),
pulls AS (SELECT *, CASE WHEN lab = label THEN m ELSE p END / (p + m) ^ 2 AS wt, CASE WHEN lab = label THEN 1 ELSE -1 END AS sign FROM near JOIN gaps USING (row_id)),
moves AS (SELECT lab, cluster, pos, sum(wt * sign * (x[pos + 1] - w[pos + 1])) / sum(wt) AS move FROM pulls CROSS JOIN range(0, 64) t(pos) GROUP BY ALL)
SELECT lab::INT AS label, cluster, pos::INT AS pos, round(w[pos + 1] + 0.5 * move, 6) + 0.0 AS val, true AS falls FROM book JOIN moves USING (lab, cluster)""")
def c_lvq_round(spark, sf_dir):
    """One round from the two rows of smallest id of each class, and whether it lowered the error."""
    points = embedding_points(spark, sf_dir)
    line = Window.partitionBy("label").orderBy("row_id")
    # the two smallest ids of each class by a rank that is cut before the shuffle
    first = points.select("label", "row_id", (F.row_number().over(line) - 1).cast("bigint").alias("cluster"), F.col("features").alias("center")).filter("cluster < 2")
    book, errors = lvq.train(points, [], first.select("label", "cluster", "center"), rounds=1)
    falls = errors.agg((F.max_by("error", "round") < F.min_by("error", "round")).alias("falls"))
    flat_ = book.select("label", "cluster", F.posexplode("center").alias("pos", "val"))
    return flat_.withColumn("val", F.round("val", 6) + 0.0).crossJoin(falls)  # one row


LINK_CUT = 400.0


@query("c_average_linkage", f"""WITH RECURSIVE p AS (SELECT c_nationkey AS g, c_custkey AS id, c_acctbal::DOUBLE AS x FROM customer),
d AS (SELECT a.g, a.id AS i, b.id AS j, round(abs(a.x - b.x), 9) AS d FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id),
s(step, g, id, c) AS (SELECT 0, g, id, id FROM p UNION ALL SELECT * FROM (
  WITH m AS (SELECT d.g, a.c AS ca, b.c AS cb, avg(d.d) AS m FROM d JOIN s a ON a.g = d.g AND a.id = d.i JOIN s b ON b.g = d.g AND b.id = d.j WHERE a.c < b.c GROUP BY ALL),
  best AS (SELECT * FROM m WHERE m <= {LINK_CUT} QUALIFY row_number() OVER (PARTITION BY g ORDER BY m, ca, cb) = 1)
  SELECT s.step + 1, s.g, s.id, CASE WHEN s.c = best.cb THEN best.ca ELSE s.c END FROM s JOIN best ON best.g = s.g))
SELECT g AS c_nationkey, id AS c_custkey, arg_max(c, step) AS cluster FROM s GROUP BY g, id""")
def c_average_linkage(spark, sf_dir):
    """Customers of every nation by balance: clusters join while their mean distance is at most LINK_CUT."""
    points = table(spark, sf_dir, "customer").select(
        "c_nationkey", F.col("c_custkey").cast("bigint").alias("row_id"), F.array(F.col("c_acctbal").cast("double")).alias("features"))
    cuts = points.select("c_nationkey").distinct().withColumn("cut", F.lit(LINK_CUT))
    return linkage.average_linkage(points, ["c_nationkey"], cuts).select("c_nationkey", F.col("row_id").alias("c_custkey"), "cluster")
