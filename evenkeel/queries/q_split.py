"""Queries for splits and the oversampling kernels on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions.rng import normal, uniform
from evenkeel.functions.vectors import pack
from evenkeel.methods.registry import fit_resample
from evenkeel.methods.smote import drop_tomek_links
from evenkeel.operators import kernels, scan, split
from evenkeel.operators.neighbours import Neighbours
from evenkeel.operators.runtime import spread
from evenkeel.queries.base import (
    DIM, LINE_COLS, PTS, embedding_points, flat, knn, pick, query, resampled, table, u, uniform_draw, with_, z,
)


def orders(spark, sf_dir):
    """Orders, urgent ones against the rest."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"))


ORD = "o AS (SELECT o_orderkey AS row_id, (o_orderpriority = '1-URGENT')::INT AS label FROM orders)"


def ranked(stream):
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {u(stream, 'row_id')}, row_id) AS rk,
  count(*) OVER (PARTITION BY label) AS n FROM o)"""


query("e_stratified_holdout", f"{with_(ORD, ranked('split'))} SELECT row_id, label, (rk <= ceil(0.2::DOUBLE * n))::INT AS is_test FROM r")(
    lambda spark, sf_dir: split.stratified_holdout(orders(spark, sf_dir)).withColumn("is_test", F.col("is_test").cast("int")))
query("e_stratified_folds", f"{with_(ORD, ranked('fold'))} SELECT row_id, label, ((rk - 1) % 5)::INT AS fold FROM r")(
    lambda spark, sf_dir: split.stratified_folds(orders(spark, sf_dir)))
query("e_expand_folds", f"{with_(ORD, ranked('fold'))} SELECT row_id, label, ((rk - 1) % 5)::INT AS fold, f::INT AS f, ((rk - 1) % 5 = f)::INT AS is_val FROM r CROSS JOIN range(0, 5) x(f)")(
    lambda spark, sf_dir: split.expand_folds(split.stratified_folds(orders(spark, sf_dir)), 5).withColumn("is_val", F.col("is_val").cast("int")))

# ---- kernels -------------------------------------------------------------

query("k_class_counts", "SELECT lang, toxic AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")(
    lambda spark, sf_dir: kernels.class_counts(
        table(spark, sf_dir, "labels").withColumnRenamed("toxic", "label").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), by=["lang"]))


def priorities(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("label"))


NEED = """SELECT *, {goal} AS n_needed FROM (SELECT o_orderstatus, substr(o_orderpriority, 1, 1)::INT AS label, count(*) AS n FROM orders GROUP BY ALL)"""
query("k_targets_auto", NEED.format(goal="max(n) OVER (PARTITION BY o_orderstatus) - n"))(
    lambda spark, sf_dir: kernels.targets(priorities(spark, sf_dir), by=["o_orderstatus"]))
query("k_targets_share", NEED.format(goal="greatest(0, floor(max(n) OVER (PARTITION BY o_orderstatus) * 0.99::DOUBLE) - n)::BIGINT"))(
    lambda spark, sf_dir: kernels.targets(priorities(spark, sf_dir), strategy=0.99, by=["o_orderstatus"]))
query("k_targets_dict", NEED.format(goal="greatest(0, CASE label WHEN 1 THEN 5000 WHEN 2 THEN 10 ELSE n END - n)::BIGINT"))(
    lambda spark, sf_dir: kernels.targets(priorities(spark, sf_dir), strategy={1: 5000, 2: 10}, by=["o_orderstatus"]))
query("k_dense_index", f"{with_(ORD)} SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {u('idx', 'row_id')}, row_id) AS idx, count(*) OVER (PARTITION BY label) AS n FROM o")(
    lambda spark, sf_dir: scan.shuffled_index(orders(spark, sf_dir), ["label"], "row_id", 42, "idx"))
query("k_seeded_draws", f"SELECT o_orderkey, round({u('u', 'o_orderkey')}, 9) AS u, round({z('n', 'o_orderkey')}, 6) + 0.0::DOUBLE AS z FROM orders")(
    lambda spark, sf_dir: table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(uniform(42, "u", "o_orderkey"), 9).alias("u"), (F.round(normal(42, "n", "o_orderkey"), 6) + F.lit(0.0)).alias("z")))

ALLKNN = "pts AS (SELECT vec_id AS row_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


@query("k_within_class_knn", f"{with_(ALLKNN, knn('o', 'pts', 'pts', 5, by='label'))} SELECT label, q_id, rk AS rank, nbr_id, round(dist, 6) AS dist FROM o")
def k_within_class(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("features"))
    return Neighbours(df, by=["label"], copies=6).knn(df, 5).withColumn("dist", F.round("dist", 6))


BLOCK_SQL = with_(ALLKNN, knn("o", "pts", "pts", 5)) + " SELECT q_id, rk AS rank, nbr_id, round(dist, 6) AS dist FROM o"


@query("k_knn_blocks", BLOCK_SQL)
def k_knn_blocks(spark, sf_dir):
    """Nearest neighbours among all rows through the block path, whatever the size."""
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"))
    return Neighbours(df, copies=6, local_bytes=0, block_rows=128).knn(df, 5).withColumn("dist", F.round("dist", 6))


# ---- the whole kernel by group, and several classes at once --------------


@query("o_smote_multiclass")
def o_multiclass(spark, sf_dir):
    """Quality and toxicity of documents as four classes, filled up to the largest."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("chars"), F.size(F.split("text", r"\s+")).cast("double").alias("words"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"))
    df = table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("row_id"), (F.col("quality") * 2 + F.col("toxic")).alias("label"),
        pack(["chars", "words", "lines"]).alias("features"))
    return flat(fit_resample(df, "SMOTE"))


LINE_ID = """('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * 100)::BIGINT)), 1, 15))::BIGINT"""
LPTS = f"""pts AS (SELECT {LINE_ID} AS row_id, (l_quantity >= 49 AND l_discount >= 0.09::DOUBLE)::INT AS label,
  [l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[] AS x FROM lineitem)"""


def line_id():
    """Line items have no unique column: 60 bits of a hash of the natural key."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
                      F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def line_points(spark, sf_dir):
    """Line items, big discounted ones (under 1 %) against the rest."""
    rare = (F.col("l_quantity") >= 49) & (F.col("l_discount") >= 0.09)
    return spread(table(spark, sf_dir, "lineitem")).select(line_id().alias("row_id"), rare.cast("int").alias("label"), pack(LINE_COLS).alias("features"))


def wide(df):
    """A resampled frame with one column per feature."""
    cols = [F.coalesce(c, F.lit(-1).cast("bigint")).alias(c) for c in ("base_id", "nbr_id", "rep")]
    values = [(F.round(F.col("features")[i], 6) + F.lit(0.0)).alias(f"f{i}") for i in range(4)]
    return df.select("row_id", "label", F.col("is_synthetic").cast("int").alias("is_synthetic"), *cols, *values)


def wide_sql(ctes, source):
    lam = u("lam", 1, "s.rep")
    old = ", ".join(f"round(x[{i + 1}], 6) AS f{i}" for i in range(4))
    new = ", ".join(f"round(coalesce(bx[{i + 1}] + {lam} * (nx[{i + 1}] - bx[{i + 1}]), bx[{i + 1}]), 6) + 0.0::DOUBLE" for i in range(4))
    return f"""{with_(*ctes)}
SELECT row_id, label, 0 AS is_synthetic, -1::BIGINT AS base_id, -1::BIGINT AS nbr_id, -1::BIGINT AS rep, {old} FROM pts
UNION ALL SELECT -(rep * 1000 + 1), 1, 1, base_id, coalesce(nbr_id, -1), rep, {new} FROM {source} s"""


LMIN = [LPTS, "p AS (SELECT * FROM pts WHERE label = 1)",
        "need AS (SELECT count(*) FILTER (label = 0) - count(*) FILTER (label = 1) AS g FROM pts)",
        "slots AS (SELECT unnest(range(1, g + 1)) AS rep FROM need)",
        knn("own", "p", "p", 5), "ownk AS (SELECT q_id, count(*) AS kk FROM own GROUP BY q_id)"]
LNBR = [f"""paired AS (SELECT d.*, o.nbr_id FROM draw d LEFT JOIN ownk k ON k.q_id = d.base_id
  LEFT JOIN own o ON o.q_id = d.base_id AND o.rk = {pick('nbr', 'k.kk', 1, 'd.rep')} + 1)""",
        "xn AS (SELECT d.*, a.x AS bx, b.x AS nx FROM paired d JOIN p a ON a.row_id = d.base_id LEFT JOIN p b ON b.row_id = d.nbr_id)"]
query("o_smote_lineitem", wide_sql([*LMIN, uniform_draw("p"), *LNBR], "xn"))(
    lambda spark, sf_dir: wide(fit_resample(line_points(spark, sf_dir), "SMOTE")))
LCROWD = [knn("near", "p", "pts", 5, carry="label"),
          "danger AS (SELECT q_id AS row_id FROM near GROUP BY q_id HAVING sum((nbr_label <> 1)::INT) * 2 >= count(*) AND sum((nbr_label <> 1)::INT) < count(*))"]
query("o_borderline_lineitem", wide_sql([*LMIN, *LCROWD, uniform_draw("danger"), *LNBR], "xn"))(
    lambda spark, sf_dir: wide(fit_resample(line_points(spark, sf_dir), "Borderline_SMOTE1")))


# ---- by group, with classes of one row ------------------------------------


def doc_points(spark, sf_dir):
    """Labelled documents, toxic against the rest, in one group per source: many classes have one or two rows."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.col("n_chars").cast("double").alias("chars"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("double").alias("spaces"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("double").alias("lines"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("source").alias("f"), F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"), pack(["chars", "spaces", "lines"]).alias("features"))


BY_SOURCE = [
    """pts AS (SELECT source AS f, doc_id AS row_id, toxic AS label, [n_chars, length(text) - length(replace(text, ' ', '')),
  length(text) - length(replace(text, chr(10), ''))]::DOUBLE[] AS x FROM labels JOIN documents USING (doc_id))""",
    "cnt AS (SELECT f, label, count(*) AS n FROM pts GROUP BY f, label)",
    "need AS (SELECT f, label, max(n) OVER (PARTITION BY f) - n AS g FROM cnt)",
    "p AS (SELECT pts.* FROM pts JOIN need USING (f, label) WHERE g > 0)",
    "slots AS (SELECT f, label, unnest(range(1, g + 1)) AS rep FROM need)", knn("own", "p", "p", 5, by="f label"),
    "ownk AS (SELECT f, q_id, count(*) AS kk FROM own GROUP BY f, q_id)",
    f"idx AS (SELECT f, label, row_id, row_number() OVER (PARTITION BY f, label ORDER BY {u('idx', 'row_id')}, row_id) AS idx, count(*) OVER (PARTITION BY f, label) AS n FROM p)",
    f"draw AS (SELECT s.*, i.row_id AS base_id FROM slots s JOIN idx i ON i.f = s.f AND i.label = s.label AND i.idx = {pick('base', 'i.n', 's.f', 's.label', 's.rep')} + 1)",
    f"""paired AS (SELECT d.*, o.nbr_id FROM draw d LEFT JOIN ownk k ON k.f = d.f AND k.q_id = d.base_id
  LEFT JOIN own o ON o.f = d.f AND o.q_id = d.base_id AND o.rk = {pick('nbr', 'k.kk', 'd.f', 'd.label', 'd.rep')} + 1)""",
    "xn AS (SELECT d.*, a.x AS bx, b.x AS nx FROM paired d JOIN p a ON a.row_id = d.base_id LEFT JOIN p b ON b.row_id = d.nbr_id)",
]
SOURCE_SQL = f"""{with_(*BY_SOURCE)}
SELECT f, row_id, label, 0 AS is_synthetic, -1::BIGINT AS base_id, -1::BIGINT AS nbr_id, -1::BIGINT AS rep, pos::INT AS pos, round(x[pos + 1], 6) AS val
FROM pts CROSS JOIN range(0, 3) r(pos) UNION ALL
SELECT f, -(rep * 1000 + label), label, 1, base_id, coalesce(nbr_id, -1), rep, pos::INT,
  round(coalesce(bx[pos + 1] + {u('lam', 's.f', 's.label', 's.rep')} * (nx[pos + 1] - bx[pos + 1]), bx[pos + 1]), 6) + 0.0::DOUBLE FROM xn s CROSS JOIN range(0, 3) r(pos)"""
query("o_smote_by_source", SOURCE_SQL)(
    lambda spark, sf_dir: flat(fit_resample(doc_points(spark, sf_dir), "SMOTE", by=["f"])))

TOMEK_SQL = with_(BY_SOURCE[0], knn("nn", "pts", "pts", 1, by="f", carry="label"),
                  """links AS (SELECT a.f, a.q_id AS row_id FROM nn a JOIN nn b ON a.f = b.f AND a.nbr_id = b.q_id AND b.nbr_id = a.q_id
  WHERE a.nbr_label <> b.nbr_label)""") + " SELECT f, row_id, label FROM pts ANTI JOIN links USING (f, row_id)"
query("k_tomek_links", TOMEK_SQL)(
    lambda spark, sf_dir: drop_tomek_links(doc_points(spark, sf_dir), ["f"]).select("f", "row_id", "label"))
