"""Queries for the SMOTE family on the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evenkeel.methods import smote  # noqa: F401  (registers the methods)
from evenkeel.methods.registry import fit_resample
from evenkeel.queries.base import (
    CROWD, MIN_CTES, NBR, OWN, OWNK, embedding_points, flat, knn, pick, query, resampled, table, u, uniform_draw,
)

XN = "xn AS (SELECT d.*, a.x AS bx, b.x AS nx FROM paired d JOIN p a ON a.row_id = d.base_id LEFT JOIN p b ON b.row_id = d.nbr_id)"
LAM = u("lam", 1, "s.rep")
LERP = f"coalesce(s.bx[pos + 1] + {LAM} * (s.nx[pos + 1] - s.bx[pos + 1]), s.bx[pos + 1])"


def resample(method: str, **options):
    def run(spark, sf_dir):
        return flat(fit_resample(embedding_points(spark, sf_dir), method, **options))

    return run


query("o_original", resampled([MIN_CTES[0], "none AS (SELECT 1 AS rep, 1 AS base_id, 1 AS nbr_id WHERE false)"], "none", "0"))(
    resample("Original"))
query("o_smote", resampled([*MIN_CTES, OWN, OWNK, uniform_draw("p"), NBR, XN], "xn", LERP))(resample("SMOTE"))

DANGER = "danger AS (SELECT * FROM crowd WHERE m * 2 >= kk AND m < kk)"
query("o_borderline_smote1", resampled([*MIN_CTES, OWN, OWNK, *CROWD, DANGER, uniform_draw("danger"), NBR, XN], "xn", LERP))(
    resample("Borderline_SMOTE1"))


def counted(name: str, source: str, order: str) -> str:
    """CTE repeating rows of ``source`` (with g) under a dense rep."""
    return f"""{name} AS (SELECT *, before + j AS rep FROM (SELECT *, cum - g AS before, unnest(range(1, g + 1)) AS j FROM (
  SELECT *, sum(g) OVER (ORDER BY {u('order', 'base_id')}, {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM {source} WHERE g > 0)))"""


ADA = [
    "hard AS (SELECT row_id AS base_id, m / kk AS r FROM crowd)",
    "sized AS (SELECT base_id, round(r / sum(r) OVER () * (SELECT g FROM need))::BIGINT AS g FROM hard)",
    counted("draw", "sized", "base_id"),
]
query("o_adasyn", resampled([*MIN_CTES, OWN, OWNK, *CROWD, *ADA, NBR, XN], "xn", LERP))(resample("ADASYN"))

DIST = [
    "mid AS (SELECT o.q_id, t.pos, avg(b.x[t.pos + 1]) AS c FROM own o JOIN p b ON b.row_id = o.nbr_id CROSS JOIN range(0, 64) t(pos) GROUP BY 1, 2)",
    "mids AS (SELECT q_id, list(c ORDER BY pos) AS nx FROM mid GROUP BY q_id)",
    "xn AS (SELECT d.*, NULL::BIGINT AS nbr_id, a.x AS bx, m.nx FROM draw d JOIN p a ON a.row_id = d.base_id LEFT JOIN mids m ON m.q_id = d.base_id)",
]
query("o_distance_smote", resampled([*MIN_CTES, OWN, uniform_draw("p"), *DIST], "xn", LERP))(resample("distance_SMOTE"))

SL = [
    "lev AS (SELECT row_id, kk - m AS sl FROM crowd)",
    """xn AS (SELECT d.*, a.x AS bx, b.x AS nx, la.sl AS sx, lb.sl AS sn,
  CASE WHEN lb.sl = 0 THEN 0.0 WHEN la.sl < lb.sl THEN 1 - la.sl / lb.sl ELSE 0.0 END::DOUBLE AS low,
  CASE WHEN lb.sl = 0 THEN 0.0 WHEN la.sl > lb.sl THEN 1 / (la.sl / lb.sl) ELSE 1.0 END::DOUBLE AS high
  FROM paired d JOIN p a ON a.row_id = d.base_id JOIN p b ON b.row_id = d.nbr_id
  JOIN lev la ON la.row_id = d.base_id JOIN lev lb ON lb.row_id = d.nbr_id WHERE la.sl > 0 OR lb.sl > 0)""",
]
SL_VALUE = f"s.bx[pos + 1] + (low + (high - low) * {u('lam', 1, 's.rep', 'pos')}) * (s.nx[pos + 1] - s.bx[pos + 1])"
query("o_safe_level_smote", resampled([*MIN_CTES, OWN, OWNK, *CROWD, uniform_draw("p"), NBR, *SL], "xn", SL_VALUE))(
    resample("Safe_Level_SMOTE"))

MS = [
    "kind AS (SELECT * FROM crowd WHERE m < kk)",
    uniform_draw("kind"),
    f"""paired AS (SELECT d.*, o.nbr_id FROM draw d JOIN kind c ON c.row_id = d.base_id LEFT JOIN ownk k ON k.q_id = d.base_id
  LEFT JOIN own o ON o.q_id = d.base_id AND o.rk = CASE WHEN c.m = 0 THEN {pick('nbr', 'k.kk', 1, 'd.rep')} + 1 ELSE 1 END)""",
]
query("o_msmote", resampled([*MIN_CTES, OWN, OWNK, *CROWD, *MS, XN], "xn", LERP))(resample("MSMOTE"))

# population skewness by moments; the two branches share the draws that differ only in their bases
SKEW = "skew AS (SELECT sum(pow(sl - mu, 3)) / count(*) AS s FROM (SELECT sl, avg(sl) OVER () AS mu FROM lev))"
SLG = [
    "lev AS (SELECT row_id, kk - m AS sl FROM crowd)", SKEW, DANGER,
    uniform_draw("p", "sdraw"), uniform_draw("danger", "bdraw"),
    "draw AS (SELECT *, 1 AS safe FROM sdraw WHERE (SELECT s FROM skew) < 0 UNION ALL SELECT *, 0 FROM bdraw WHERE NOT coalesce((SELECT s FROM skew) < 0, false))",
    NBR,
    SL[1].replace("la.sl AS sx", "d.safe AS sx").replace("WHERE la.sl > 0 OR lb.sl > 0", "WHERE d.safe = 0 OR la.sl > 0 OR lb.sl > 0"),
]
query("o_sl_graph_smote", resampled([*MIN_CTES, OWN, OWNK, *CROWD, *SLG], "xn", f"CASE WHEN sx = 1 THEN {SL_VALUE} ELSE {LERP} END"))(
    resample("SL_graph_SMOTE"))

RND = [
    uniform_draw("p", "d1"), uniform_draw("p", "d2", "y1", "d1", "nbr_id"), uniform_draw("p", "d3", "y2", "d2", "other_id"),
    "xn AS (SELECT d.*, a.x AS bx, b.x AS nx, c.x AS ox FROM d3 d JOIN p a ON a.row_id = base_id JOIN p b ON b.row_id = nbr_id JOIN p c ON c.row_id = other_id)",
]
T = f"(s.nx[pos + 1] + {u('lam1', 1, 's.rep')} * (s.ox[pos + 1] - s.nx[pos + 1]))"
query("o_random_smote", resampled([*MIN_CTES, *RND], "xn", f"s.bx[pos + 1] + {u('lam2', 1, 's.rep')} * ({T} - s.bx[pos + 1])"))(
    resample("Random_SMOTE"))

SD = [
    "spread AS (SELECT q_id, stddev_pop(dist) AS sd, sum(dist) AS far FROM own GROUP BY q_id)",
    "share AS (SELECT *, round(round(sd / sum(sd) OVER () * (SELECT g FROM need), 9)) AS n_i FROM spread)",
    """pairs AS (SELECT o.q_id AS base_id, o.rk, o.nbr_id, round(round(o.dist / s.far * s.n_i, 9))::BIGINT AS g
  FROM own o JOIN share s USING (q_id) WHERE s.n_i > 0 AND s.far > 0)""",
    counted("paired", "pairs", "base_id, rk"),
    "xn AS (SELECT d.*, a.x AS bx, b.x AS nx FROM paired d JOIN p a ON a.row_id = d.base_id JOIN p b ON b.row_id = d.nbr_id)",
]
query("o_smote_d", resampled([*MIN_CTES, OWN, *SD], "xn", "s.bx[pos + 1] + s.j / (s.g + 1) * (s.nx[pos + 1] - s.bx[pos + 1])"))(
    resample("SMOTE_D"))

TOMEK = [
    *MIN_CTES, OWN, OWNK, uniform_draw("p"), NBR, XN,
    f"made AS (SELECT -(rep * 1000 + 1) AS row_id, rep, base_id, nbr_id, list({LERP} ORDER BY pos) AS x FROM xn s CROSS JOIN range(0, 64) r(pos) GROUP BY ALL)",
    "full_ AS (SELECT row_id, label, x FROM pts UNION ALL SELECT row_id, 1, x FROM made)",
    knn("nn", "full_", "full_", 1, carry="label"),
    """links AS (SELECT a.q_id AS row_id FROM nn a JOIN nn b ON a.nbr_id = b.q_id AND b.nbr_id = a.q_id WHERE a.nbr_label <> b.nbr_label)""",
    "kept AS (SELECT * FROM pts WHERE row_id NOT IN (SELECT row_id FROM links))",
    "madekept AS (SELECT * FROM made WHERE row_id NOT IN (SELECT row_id FROM links))",
]


@query("o_smote_wide_labels", """WITH c AS (SELECT (label * 1000 - 3000)::INT AS label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1)
SELECT label, max(n) OVER () AS n_rows, max(n) OVER () - n AS n_synthetic, 1::BIGINT AS rows_of_an_id FROM c""")
def smote_wide_labels(spark, sf_dir):
    """All classes of the embeddings under labels below 0 and above 999: rows, synthetic rows, most rows that share an id."""
    points = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(
        F.col("vec_id").alias("row_id"), (F.col("label") * 1000 - 3000).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("features"))
    made = fit_resample(points, "SMOTE").withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("row_id")))
    return made.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("is_synthetic").cast("bigint")).alias("n_synthetic"), F.max("times").alias("rows_of_an_id"))


query("o_smote_tomeklinks", resampled(TOMEK, "madekept", "s.x[pos + 1]", originals="kept"))(resample("SMOTE_TomekLinks"))
