"""Data checks and the mapping between the two generations of the schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chatterlens import schemas
from chatterlens.functions.labels import english_sentiment
from chatterlens.functions.scalars import lookup, month_key


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows breaking each rule, one row per rule, in one pass.

    A rule that evaluates to NULL counts as broken.
    """
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.inline(pairs))


def metric_rules() -> dict[str, Column]:
    parts = F.col("positive_count") + F.col("negative_count") + F.col("neutral_count")
    return {
        "score_in_range": F.col("score").between(0, 1),
        "counts_add_up": parts == F.col("total_comments"),
        "counts_not_negative": F.least("positive_count", "negative_count", "neutral_count") >= 0,
        "program_present": F.col("program_id").isNotNull() & (F.col("program_id") != ""),
    }


def comment_rules() -> dict[str, Column]:
    return {
        "comment_id_present": F.col("comment_id").isNotNull(),
        "timestamp_present": F.col("timestamp").isNotNull(),
        "sentiment_known": F.col("sentiment").isin(*schemas.SENTIMENTS),
        "sentiment_score_in_range": F.col("sentiment_score").between(-1, 1),
        "engagement_in_range": F.col("engagement_score").between(0, 100),
    }


def anomaly_rules() -> dict[str, Column]:
    return {
        "metric_known": F.col("metric").isin(*schemas.METRICS),
        "severity_known": F.col("severity").isin(*schemas.SEVERITIES),
    }


def prediction_rules(labels: str = "labels") -> dict[str, Column]:
    """Every quad carries all its fields."""
    def present(field: str):
        return lambda quad: quad[field].isNotNull()
    fields = ("entity", "aspect", "opinion", "sentiment", "confidence")
    return {f"{field}_present": F.forall(labels, present(field)) for field in fields}


def rank_gaps(ranked: DataFrame) -> DataFrame:
    """Whether ranks are exactly 1..n, from three aggregates."""
    ok = (F.min("rank") == 1) & (F.max("rank") == F.count("*")) & (F.count_distinct("rank") == F.count("*"))
    return ranked.agg(F.lit("ranks_complete").alias("rule"), F.when(ok, 0).otherwise(1).alias("violations"))


def all_checks(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def check_limit(limit: int, most: int = 100) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}, got {limit}")
    return limit


# --- schema generations -----------------------------------------------------

def comments_to_v2(v1: DataFrame, show: str | None = None) -> DataFrame:
    """``entity`` becomes ``program_id`` (below the show when given), entities
    become topics, sentiments one English vocabulary, metadata a JSON string."""
    program = F.concat(F.lit(f"{show}/"), "entity") if show else F.col("entity")
    return v1.select(
        "comment_id", program.alias("program_id"), "text", "username", "timestamp",
        english_sentiment("sentiment").alias("sentiment"), "sentiment_score",
        F.col("entities").alias("topics"), F.to_json("metadata").alias("metadata"),
    )


def metrics_to_v2(v1: DataFrame, show: str | None = None) -> DataFrame:
    """Window lengths in minutes become range labels."""
    labels = {minutes: label for label, minutes in schemas.RANGE_MINUTES.items()}
    program = F.concat(F.lit(f"{show}/"), "entity") if show else F.col("entity")
    return v1.select(
        program.alias("program_id"), "timestamp", F.col("eaos_score").alias("score"),
        F.col("comment_count").alias("total_comments"),
        lookup("time_window_minutes", labels).alias("time_range"),
    )


def comments_as_v1(v2: DataFrame) -> DataFrame:
    return v2.select(
        "comment_id", "text", "username", "timestamp", "sentiment", "sentiment_score",
        F.col("topics").alias("entities"), "metadata",
    )


def metrics_as_v1(metrics: DataFrame, width_minutes: int, ts: str = "window_start") -> DataFrame:
    return metrics.select(
        F.col("program_id").alias("entity"), F.col(ts).alias("timestamp"),
        F.col("score").alias("eaos_score"), F.col("avg_sentiment").alias("sentiment_score"),
        F.col("avg_engagement").alias("engagement_score"),
        F.col("total_comments").alias("comment_count"),
        F.lit(width_minutes).alias("time_window_minutes"),
    )


def with_month(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumn("month", month_key(ts))


