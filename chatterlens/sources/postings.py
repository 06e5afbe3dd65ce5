"""A stored inverted index over comment texts.

``postings`` holds one row per term and comment: how often it occurs, the
comment's length, and a few kept columns to filter and sort by. It lies in
folders by a hash of the term, sorted by (term, id) in each file; a large folder
spreads over many files and a query opens the folders of its own terms only. ``terms`` has one row per term and batch with the number of
comments that hold it, ``stats`` one row per batch. A batch is there once its
stats are; a batch that is written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatterlens.functions import scalars as sc
from chatterlens.session import child_names

#: Folders of the index, by a hash of the term.
BUCKETS = 64


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def cut(comments: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``comment_id``, kept columns, ``doc_length``, ``term``, ``tf``. A text's words
    are sorted and its runs counted in place; nothing is shuffled. Comments
    without words have no rows."""
    words = comments.select("comment_id", *keep, F.sort_array(sc.tokens(F.coalesce("text", F.lit("")))).alias("words"))
    sized = words.withColumn("doc_length", F.size("words"))
    positions = F.when(F.col("doc_length") > 0, F.sequence(F.lit(1), F.col("doc_length")))
    runs = sized.withColumn("ends", F.filter(
        positions, lambda i: ~F.get("words", i - 1).eqNullSafe(F.get("words", i))))
    terms = F.transform("ends", lambda end, i: F.struct(
        F.get("words", end - 1).alias("term"), (end - F.coalesce(F.get("ends", i - 1), F.lit(0))).alias("tf")))
    return sc.each(runs, terms, "posting", "comment_id", *keep, "doc_length").select(
        "comment_id", *keep, "doc_length", "posting.*")


def _by_bucket(rows: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by their folder and sorted in it. Adaptive execution splits a
    folder with many rows over tasks and puts small ones together; texts are
    cut up once, since no ranges have to be found by a sample first."""
    return rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *order)


def add(comments: DataFrame, path: str, keep: tuple[str, ...] = (), batch: int = 0) -> None:
    """Index comments that no other batch holds."""
    spark = comments.sparkSession
    rows = cut(comments, keep).withColumn("bucket", bucket_of(F.col("term")))
    _by_bucket(rows, "term", "comment_id").write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path}/postings/batch={batch}")
    written = spark.read.parquet(f"{path}/postings/batch={batch}")
    counted = written.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
    _by_bucket(counted, "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms/batch={batch}")
    known = spark.read.parquet(f"{path}/terms/batch={batch}").agg(F.sum("occurrences").alias("words"))
    comments.agg(F.count("*").alias("docs"), F.count("text").alias("texts")).withColumn("words", F.coalesce(known.scalar(), F.lit(0))).write.mode(
        "overwrite").parquet(f"{path}/stats/batch={batch}")


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Finished batches, by the folders of their stats."""
    return [int(name.removeprefix("batch=")) for name in child_names(spark, f"{path}/stats") if name.startswith("batch=")]


def _of_terms(spark: SparkSession, path: str, name: str, terms: list[str]) -> DataFrame:
    """Rows of the given terms, from their folders."""
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(
        *[f"{path}/{name}/batch={batch}" for batch in _batches(spark, path)])
    return rows.filter(F.col("bucket").isin([bucket_of(F.lit(t)) for t in terms]) & F.col("term").isin(terms))


def hits(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """Postings of the given terms."""
    return _of_terms(spark, path, "postings", terms).drop("bucket", "batch")


def corpus(spark: SparkSession, path: str, terms: list[str]) -> Column:
    """Number of comments, mean length of those with a text, and per term (``df0`` ...) how many
    comments hold it, as a scalar subquery of one row."""
    counts = _of_terms(spark, path, "terms", terms).agg(F.struct(*[
        F.coalesce(F.sum(F.when(F.col("term") == t, F.col("df"))), F.lit(0)).alias(f"df{i}") for i, t in enumerate(terms)
    ]).alias("counts")).scalar()
    stats = spark.read.parquet(f"{path}/stats").agg(
        F.sum("docs").alias("docs"), F.sum("texts").alias("texts"), F.sum("words").alias("words"))
    return stats.withColumn("counts", counts).select(F.struct(
        "docs", (F.col("words") / F.nullif("texts", F.lit(0))).alias("avg_length"), "counts.*").alias("stats")).scalar()
