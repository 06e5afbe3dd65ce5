"""A corpus made ready for training: toxic and poor documents go, of near
copies one stays, strings that repeat are removed, and what is left is packed.

Each stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlens.llm import common, minhash, packing, quality, suffix_dedup, toxicity
from chatterlens.session import settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples near them don't call toxic."""
    common.ship(spark)
    with common.small_batches(spark):
        model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
        kept, _ = settled(toxicity.without_toxic(docs, model), "not-toxic")
    model.destroy()
    common.give_back()
    return kept


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no certified cutoff rejects."""
    verdicts = quality.judge(docs, common.table(spark, sf_dir, "labels"))
    return common.rows_by_key(docs, verdicts.where("NOT kept"), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the least id, of several
    texts under it the one of the least key, of its repeated rows one; documents
    without words or id are in no group and stay."""
    with common.small_batches(spark):
        found = minhash.near_duplicates(docs, shingle=5, percent=80)
    alone = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").isNull()
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("component_key"))
    chosen = found.select("doc_id", "text_key", alone.alias("alone"), (~alone & first).alias("first"))
    kept = common.rows_by_key(docs, chosen.where("first"), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(common.rows_by_key(docs, chosen.where("alone"), "left_semi"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that start anywhere else too."""
    with common.small_batches(spark):
        cut = suffix_dedup.cut_texts(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic), ("quality rules", drop_poor), ("minhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats), ("packing", pack),
]

#: Fitted scores, minima and ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
