"""Time-window rollups kept as mergeable sums and counts.

An average is never stored: partial rows from different batches, files or
streams add up with :func:`merge`, and averages are derived at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatterlens.functions import scalars as sc

PROGRAM_MEASURES = (
    "total_comments", "positive_count", "negative_count", "neutral_count",
    "sentiment_sum", "engagement_sum",
)
COUNT_MEASURES = ("mention_count", "sentiment_sum")


def program_measures() -> list[Column]:
    def of(sentiment: str) -> Column:
        return F.count_if(F.col("sentiment") == sentiment)
    return [
        F.count("*").alias("total_comments"),
        of("positive").alias("positive_count"),
        of("negative").alias("negative_count"),
        of("neutral").alias("neutral_count"),
        F.sum("sentiment_score").alias("sentiment_sum"),
        F.sum("engagement_score").alias("engagement_sum"),
    ]


def _count_measures() -> list[Column]:
    return [F.count("*").alias("mention_count"), F.sum("sentiment_score").alias("sentiment_sum")]


def by_program(comments: DataFrame, width: str = "5 minutes") -> DataFrame:
    keys = [F.col("program_id"), sc.window_start("timestamp", width).alias("window_start")]
    return comments.groupBy(*keys).agg(*program_measures())


def by_topic(comments: DataFrame, width: str = "1 hour") -> DataFrame:
    """One row per program, window and topic; comments without topics drop out."""
    exploded = sc.each(comments, "topics", "topic", "program_id", "timestamp", "sentiment_score")
    start = sc.window_start("timestamp", width).alias("hour_start")
    return exploded.groupBy("program_id", start, "topic").agg(*_count_measures())


def by_sentiment(comments: DataFrame, width: str = "1 minute") -> DataFrame:
    start = sc.window_start("timestamp", width).alias("timestamp_minute")
    return comments.groupBy(start, "sentiment").agg(*_count_measures())


def by_entity(comments: DataFrame, width: str = "1 hour", entities: str = "topics") -> DataFrame:
    exploded = sc.each(comments, entities, "entity", "timestamp", "sentiment_score")
    start = sc.window_start("timestamp", width).alias("timestamp_hour")
    return exploded.groupBy(start, "entity").agg(*_count_measures())


def merge(partials: DataFrame, keys: list[str], measures=PROGRAM_MEASURES) -> DataFrame:
    """Add up partial rows of the same key."""
    return partials.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def with_score(rollup: DataFrame) -> DataFrame:
    """Averages and the engagement-adjusted score of each rollup row."""
    avg_sentiment = F.col("sentiment_sum") / F.col("total_comments")
    avg_engagement = F.col("engagement_sum") / F.col("total_comments")
    return rollup.withColumns({
        "avg_sentiment": avg_sentiment,
        "avg_engagement": avg_engagement,
        "score": sc.engagement_adjusted_score(avg_sentiment, avg_engagement),
    })


def with_average(rollup: DataFrame, name: str = "avg_sentiment") -> DataFrame:
    return rollup.withColumn(name, F.col("sentiment_sum") / F.col("mention_count"))


def program_metrics(comments: DataFrame, width: str = "1 hour") -> DataFrame:
    return with_score(by_program(comments, width))


def timeline(comments: DataFrame, granularity: str | None = None) -> DataFrame:
    """Metrics at a granularity label such as ``minute`` or ``segment``."""
    return program_metrics(comments, sc.granularity_width(granularity))


def program_snapshot(comments: DataFrame) -> DataFrame:
    """Score and counts of each program over everything given."""
    return with_score(comments.groupBy("program_id").agg(*program_measures()))
