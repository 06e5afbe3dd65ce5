"""Joins between comments, predictions, metrics, events and stored tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from chatterlens import schemas
from chatterlens.functions import scalars as sc
from chatterlens.operators import skew


def with_topic_sentiment(trends: DataFrame, entities: DataFrame) -> DataFrame:
    """Average sentiment of the entity named like the topic, 0.0 when unknown."""
    means = entities.select(F.col("entity").alias("topic"), "avg_sentiment")
    return trends.join(means, "topic", "left").withColumn(
        "avg_sentiment", F.coalesce("avg_sentiment", F.lit(0.0)))


def merge_predictions(comments: DataFrame, predictions: DataFrame, stamped_at: Column | datetime) -> DataFrame:
    """Comments with new labels written in. A prediction without quads still
    stamps ``predicted_at``, so the comment is not tried again.

    ``predictions`` has comment_id and labels, one row per comment.
    """
    stamp = stamped_at if isinstance(stamped_at, Column) else F.lit(stamped_at)
    new = predictions.select(
        "comment_id", F.coalesce("labels", F.array().cast(schemas.LABELS)).alias("new_labels"))
    return (
        comments.join(new, "comment_id", "left")
        .withColumns({
            "predicted_at": F.when(F.col("new_labels").isNotNull(), stamp).otherwise(F.col("predicted_at")),
            "labels": F.coalesce("new_labels", "labels"),
        })
        .drop("new_labels")
    )


def not_stored(new: DataFrame, stored: DataFrame, key: str = "comment_id") -> DataFrame:
    """Rows whose id is not stored yet; copies within ``new`` collapse to one."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def restrict_to(df: DataFrame, ids: DataFrame, key: str, bound: int = 10_000) -> DataFrame:
    """Rows whose key is among the ids, without a shuffle of ``df`` for up to ``bound`` ids."""
    return skew.restrict_to(df, ids, key, bound)


def mark_used(training: DataFrame, used_ids: DataFrame, used_at: Column | datetime, key: str = "id") -> DataFrame:
    """Flag and stamp the listed rows; others keep their state."""
    stamp = used_at if isinstance(used_at, Column) else F.lit(used_at)
    listed = used_ids.select(key).distinct().withColumn("listed", F.lit(True))
    hit = F.col("listed").isNotNull()
    return (
        training.join(listed, key, "left")
        .withColumns({
            "is_used_for_training": hit | F.col("is_used_for_training"),
            "used_at": F.when(hit, stamp).otherwise(F.col("used_at")),
        })
        .drop("listed")
    )


# --- comparison -------------------------------------------------------------

def compare(scores: DataFrame, pairs: DataFrame, tie_pct: float = 5.0) -> DataFrame:
    """Difference, winner, summary and advice for each listed pair of programs.

    ``pairs`` has entity_1 and entity_2; ``scores`` one row per program with
    score and total_comments. A program without a score counts as 0.
    """
    def side(n: int) -> DataFrame:
        return scores.select(
            F.col("program_id").alias(f"entity_{n}"), F.col("score").alias(f"score_{n}"),
            F.col("total_comments").alias(f"comments_{n}"),
        )
    both = pairs.join(side(1), "entity_1", "left").join(side(2), "entity_2", "left").fillna(
        0, ["score_1", "score_2", "comments_1", "comments_2"])
    one, two = F.round("score_1", 4), F.round("score_2", 4)
    diff = F.round(one - two, 9)
    pct = F.when(two != 0, F.round(diff / two * 100, 9)).otherwise(F.lit(0.0))
    return (
        both.select(
            "entity_1", "entity_2", one.alias("score_1"), two.alias("score_2"),
            "comments_1", "comments_2", F.round(diff, 4).alias("difference"), pct.alias("pct"),
        )
        .withColumn("winner", F.when(F.abs("pct") < tie_pct, "tie")
                    .when(F.col("difference") > 0, F.col("entity_1")).otherwise(F.col("entity_2")))
        .withColumns({"summary": comparison_summary(), "recommendation": comparison_advice()})
        .withColumn("difference_pct", F.round("pct", 2)).drop("pct")
    )


def comparison_summary() -> Column:
    verdict = (
        F.when(F.col("winner") == "tie", "roughly equal")
        .when(F.col("difference") > 0, "significantly better").otherwise("significantly worse")
    )
    return F.format_string(
        "%s is performing %s than %s (EAOS: %.2f vs %.2f, %.1f%% difference)",
        "entity_1", verdict, "entity_2", "score_1", "score_2", F.abs("pct"),
    )


def comparison_advice() -> Column:
    return F.when(F.col("winner") == "tie", F.format_string(
        "Both %s and %s are performing similarly. Consider featuring both equally.",
        "entity_1", "entity_2",
    )).otherwise(F.format_string(
        "Consider giving more screen time to %s, which is resonating better with viewers.", "winner",
    ))


# --- current against previous, cached against stored ------------------------

def current_with_previous(current: DataFrame, previous: DataFrame, key: str = "topic") -> DataFrame:
    """Counts of two windows side by side; a topic may be in only one of them."""
    cur = current.select(key, F.col("mention_count").alias("current_count"))
    prev = previous.select(key, F.col("mention_count").alias("previous_count"))
    return cur.join(prev, key, "full").fillna(0, ["current_count", "previous_count"])


def cached_or_stored(cached: DataFrame, stored: DataFrame, as_of: Column | datetime, ttl: timedelta | None = None) -> DataFrame:
    """Score per program: a cached row that is still alive, else the stored one."""
    ttl = ttl or timedelta(seconds=schemas.CURRENT_SCORE_TTL_SECONDS)
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    alive = cached.filter(F.col("updated_at") > now - F.lit(ttl)).select(
        "program_id", F.col("score").alias("cached_score"))
    return (
        stored.select("program_id", F.col("score").alias("stored_score")).join(alive, "program_id", "full")
        .select(
            "program_id", F.coalesce("cached_score", "stored_score").alias("score"),
            F.when(F.col("cached_score").isNotNull(), "cache").otherwise("store").alias("origin"),
        )
    )


# --- interval join ----------------------------------------------------------

def around(
    moments: DataFrame, events: DataFrame, reach: timedelta = timedelta(minutes=30),
    key: str = "program_id", ts: str = "timestamp", split: bool = False,
) -> DataFrame:
    """Events of the same program within ``reach`` of each moment.

    Time is cut into slots as wide as ``reach``; each moment is looked up in
    its own slot and both neighbours, which makes the join an equi-join. With
    ``split``, for raw comments as events, slots with a large share of them are
    dealt over several tasks.
    """
    width = int(reach.total_seconds())

    def slot(column: str) -> Column:
        return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / width)
    left = moments.withColumnRenamed(ts, "moment").withColumn(
        "slot", F.explode(F.sequence(slot("moment") - 1, slot("moment") + 1)))
    right = events.withColumnRenamed(ts, "event_time").withColumn("slot", slot("event_time"))
    close = F.col("event_time").between(F.col("moment") - F.lit(reach), F.col("moment") + F.lit(reach))
    met = skew.join(right, left, [key, "slot"]) if split else left.join(right, [key, "slot"])
    columns = [key, *[c for c in (*left.columns, *right.columns) if c not in (key, "slot")]]
    return met.filter(close).select(*columns)
