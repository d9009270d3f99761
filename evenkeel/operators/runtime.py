"""Lineage cuts and small driver-side tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_ROWS = 10_000  # class counts, fold summaries and the like may be held by the driver up to here


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets its own."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    chosen = tempfile.mkdtemp(prefix="evenkeel-")
    spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later uses scan the written columns instead of repeating the work, and survive
    the loss of executors without going back to the source.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/evenkeel/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete everything settled by any job under the shared folder: call it when no result is read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/evenkeel")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_table(df: DataFrame) -> DataFrame:
    """A table expected to be tiny, computed once: held by the driver if it is, written otherwise."""
    rows = df.limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        return settle(df)
    return df.sparkSession.createDataFrame(rows, df.schema)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a plain scan with fewer splits than tasks (one small file, one row group) a partition per
    task. Tables of any size are split by their files already and pass unchanged."""
    parts = width(df.sparkSession)
    return df.repartition(parts, *keys) if df.rdd.getNumPartitions() < parts else df
