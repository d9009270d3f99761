"""Queries for sources, sinks and profiling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evenkeel.operators.runtime import shared_dir
from evenkeel.plans import report
from evenkeel.queries.base import query, table
from evenkeel.sources import datasets


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/evenkeel/{uuid.uuid4().hex}/{name}"


@query("d_csv_scan", "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def d_csv_scan(spark, sf_dir):
    """The customer table as CSV, read back through a catalogue entry with inferred types."""
    path = scratch(spark, "customer.csv")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    datasets.locate("customer", path=path)
    df = datasets.load(spark, datasets.dataset("customer"))
    return df.withColumn("c_custkey", F.col("c_custkey").cast("bigint")).withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))


@query("d_target_split", """SELECT p_partkey AS row_id, (p_brand IN ('Brand#1', 'Brand#2'))::INT AS label, pos::INT AS pos,
  round(CASE pos WHEN 0 THEN p_size::DOUBLE ELSE p_retailprice END, 6) AS val FROM part CROSS JOIN range(0, 2) r(pos)""")
def d_target_split(spark, sf_dir):
    """Last column as label, the others as features."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    points = datasets.split_target(df, "p_partkey", positive=["Brand#1", "Brand#2"])
    return points.select("row_id", "label", F.posexplode("features").alias("pos", "val")).withColumn("val", F.round("val", 6))


def profile_sql(name: str, features: int, source: str) -> str:
    return f"""SELECT {name}, sum(n)::BIGINT AS total_samples, {features}::INT AS features, count(*) AS classes,
  string_agg(label || ':' || n, ',' ORDER BY label) AS class_counts,
  CASE WHEN count(*) < max(label) + 1 THEN 'inf' ELSE round(max(n) / min(n), 6)::VARCHAR END AS imbalance_ratio
  FROM (SELECT {name}, label, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY {name}"""


def profile_text(df):
    pairs = F.transform("class_counts", lambda s: F.concat_ws(":", s["label"].cast("string"), s["n"].cast("string")))
    ratio = F.when(F.col("imbalance_ratio") == float("inf"), "inf").otherwise(F.round("imbalance_ratio", 6).cast("string"))
    return df.withColumn("class_counts", F.concat_ws(",", pairs)).withColumn("imbalance_ratio", ratio)


@query("d_profile", profile_sql("source", 1, "(SELECT source, toxic AS label FROM labels JOIN documents USING (doc_id))"))
def d_profile(spark, sf_dir):
    """Class balance of the toxic label per document source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    df = table(spark, sf_dir, "labels").join(docs, "doc_id").select("source", "n_chars", F.col("toxic").alias("label"))
    return profile_text(datasets.profile(df, "label", by=["source"]))


@query("d_profile_embeddings", profile_sql("name", 64, "(SELECT 'embeddings' AS name, label FROM embeddings)"))
def d_profile_embeddings(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("label")
    return profile_text(datasets.profile(df, "label", features=64)).withColumn("name", F.lit("embeddings"))


@query("d_publish", """SELECT 2::INT AS version, 1::INT AS parent, count(*) AS total_samples, 3::INT AS features, count(DISTINCT quality) AS classes,
  (count(*) - ceil(count(*) * 0.2::DOUBLE))::BIGINT AS train_samples, ceil(count(*) * 0.2::DOUBLE)::BIGINT AS test_samples
  FROM labels WHERE toxic = 0""")
def d_publish(spark, sf_dir):
    """Two versions of a dataset, the second a child of the first: its metadata row."""
    path = scratch(spark, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    df = table(spark, sf_dir, "labels").join(docs, "doc_id")
    first = datasets.publish(df, path, "quality")
    datasets.publish(datasets.load_version(spark, path, first).filter("toxic = 0"), path, "quality", parent=first)
    return datasets.versions(spark, path).filter(F.col("version") == 2)


SINK_SQL = "SELECT l_returnflag AS dataset, l_linestatus AS classifier, count(*) AS n, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY ALL"


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("classifier")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("score"))


@query("d_csv_sink", SINK_SQL)
def d_csv_sink(spark, sf_dir):
    path = scratch(spark, "results.csv")
    datasets.write_results_csv(_scores(spark, sf_dir), path)
    return spark.read.option("header", True).schema("dataset string, classifier string, n bigint, score double").csv(path).withColumn(
        "score", F.round("score", 6))


@query("d_json_sink", SINK_SQL)
def d_json_sink(spark, sf_dir):
    path = scratch(spark, "results.json")
    nested = _scores(spark, sf_dir).select("dataset", F.struct("classifier", "n", "score").alias("result"), F.current_timestamp().alias("at"))
    datasets.write_results_json(nested, path)
    back = spark.read.schema("dataset string, result struct<classifier string, n bigint, score double>, at string").json(path)
    return back.select("dataset", "result.classifier", "result.n", F.round("result.score", 6).alias("score"))
