"""Canonical frames over the Parquet tables of a data folder.

Event times stay ``timestamp_ntz`` as stored; streams cast them, because
watermarks need ``timestamp``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chatterlens import schemas
from chatterlens.functions import labels as lab

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for costly work on a small input. A scan with fewer splits
    than cores is redistributed by id; a large one already has more splits and
    is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _event_sentiment() -> Column:
    return (
        F.when(F.col("event_type").isin("purchase", "signup"), "positive")
        .when(F.col("event_type") == "error", "negative").otherwise("neutral")
    )


def _minutes(number: str) -> Column:
    return F.make_dt_interval(secs=(F.col(number) * 60).cast("decimal(18,6)"))


def as_comments(events: DataFrame) -> DataFrame:
    """Events read as scored comments on programs."""
    kind = F.get_json_object("props", "$.k").cast("int") % 20
    return events.select(
        F.col("event_id").alias("comment_id"),
        F.concat(F.lit("show_"), F.col("user_id") % 10).alias("program_id"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("username"),
        F.col("ts").alias("timestamp"),
        _event_sentiment().alias("sentiment"),
        lab.sentiment_points(_event_sentiment()).alias("sentiment_score"),
        F.least("value", F.lit(100.0)).alias("engagement_score"),
        F.array(
            F.concat(F.lit("et_"), "event_type"), F.concat(F.lit("k_"), kind.cast("string")),
        ).alias("topics"),
    )


def comments(spark: SparkSession, folder: str) -> DataFrame:
    return as_comments(table(spark, folder, "events"))


def comment_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The same comments as a stream; the pattern also matches a table folder."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.parquet(f"{folder}/events.parque[t]")
    return as_comments(events).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read as comments. Those with a ``labels`` row are labeled; very
    short ones count as attempted without a result."""
    documents, known = table(spark, folder, "documents"), table(spark, folder, "labels")
    name = (
        F.when(F.col("toxic") == 1, "tiêu cực").when(F.col("quality") == 1, "tích cực")
        .otherwise("trung lập")
    )
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + _minutes("doc_id")
    label = F.struct(
        F.col("source").alias("entity"), F.lit("Khác").alias("aspect"), F.lit("").alias("opinion"),
        name.alias("sentiment"), F.lit(1.0).alias("confidence"),
    )
    is_labeled = F.col("quality").isNotNull()
    attempted = is_labeled | (F.col("n_chars") < 200)
    return documents.join(known, "doc_id", "left").select(
        F.col("doc_id").alias("comment_id"), F.col("lang").alias("program_id"),
        F.col("source").alias("video_id"), "text", "source",
        created.alias("created_at"),
        F.when(is_labeled, F.array(label)).cast(schemas.LABELS).alias("labels"),
        F.when(attempted, created + F.expr("INTERVAL 1 HOUR")).alias("predicted_at"),
        is_labeled.alias("is_labeled"),
        F.when(is_labeled, lab.english_sentiment(name)).alias("sentiment"),
    )


def timed_texts(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """Documents as comments for searching, without the label join. ``heavy``
    announces costly work per text."""
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + _minutes("doc_id")
    return (spread(rows, "doc_id") if heavy else rows).select(
        F.col("doc_id").alias("comment_id"), F.col("lang").alias("program_id"),
        F.col("source").alias("video_id"), "text", created.alias("timestamp"),
    )


def text_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Documents arriving as unlabeled comments, so many files at a time at most."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/documents.parque[t]")
    return rows.select(
        F.col("doc_id").alias("comment_id"), "text", F.lit(None).cast(schemas.LABELS).alias("labels"),
        F.lit(None).cast("timestamp").alias("predicted_at"),
    )


HEADS = {
    "aspect": (1, 11), "sentiment": (12, 3), "e_start": (15, 12), "e_end": (27, 12),
    "o_start": (39, 12), "o_end": (51, 12),
}


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings cut into the six heads of one prediction slot."""
    values = F.col("embedding").cast("array<double>")
    heads = [F.slice(values, first, size).alias(name) for name, (first, size) in HEADS.items()]
    return table(spark, folder, "embeddings").select("vec_id", "label", *heads)
