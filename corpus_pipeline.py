"""A training corpus from ``documents``: drop toxic texts, keep one of near copies, cut repeated passages, pack sequences.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written and read again. All but the
last return the columns of ``documents``; a cut text has a new ``n_chars``. Rows with a null doc_id are never toxic by label or cut.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import packing, simhash, substring_dedup, toxicity
from evenkeel.llm.queries import TOXIC_FROM, fold
from evenkeel.operators.runtime import settle

ORACLE_SQL = None  # a trained classifier, XXH64 and a tokenizer are beyond SQL; tests/llm holds the stages against brute force


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: texts that the classifier rejects go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(4) != 2)
    return toxicity.score(docs, model).where(F.col("score") < TOXIC_FROM).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of rows with texts within three fingerprint bits of one another, over any number of links, one stays: that with the smallest id, null ids
    last, then the smallest hash of the row."""
    rows = docs.withColumn("tie", F.concat(F.hex(F.xxhash64(*docs.columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *docs.columns))))  # 128 bits
    found = settle(simhash.keepers(rows, "tie", shingle=3, bits=3))
    gone = settle(found.where("key <> kept").select(F.col("key").alias("tie")).distinct())
    left = rows.join(gone, "tie", "left_anti")
    again = settle(found.where("key = kept").groupBy(F.col("key").alias("tie")).count().where("count > 1").select("tie"))  # kept rows that are repeated as they are
    if not again.isEmpty():
        left = left.join(again, "tie", "left_anti").unionByName(left.join(again, "tie", "left_semi").dropDuplicates(["tie"]))
    return left.select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: words inside 13-word windows that begin in an earlier document go."""
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return substring_dedup.remove(docs).select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: pieces of at most 2048 tokens in as few sequences as best-fit finds."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
