"""Counts, shares, top lists and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatterlens.functions import labels as lab, scalars as sc


def top(df: DataFrame, measure: str, key: str, limit: int) -> DataFrame:
    """Largest first, equal values by key."""
    return df.orderBy(F.col(measure).desc(), F.col(key).asc()).limit(limit)


def top_per(df: DataFrame, group: list[str], measure: str, key: str, limit: int) -> DataFrame:
    """The top list within each group of an aggregated table."""
    order = Window.partitionBy(*group).orderBy(F.col(measure).desc(), F.col(key).asc())
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("place")


# --- sentiment --------------------------------------------------------------

def sentiment_counts(comments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return comments.groupBy(*by, "sentiment").agg(F.count("*").alias("count"))


def sentiment_shares(comments: DataFrame, by: str = "program_id") -> DataFrame:
    """Counts and percentages of each sentiment per group, one row per group."""
    counts = [F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "negative", "neutral")]
    totals = comments.groupBy(by).agg(*counts, F.count("*").alias("total"))
    return totals.withColumns({
        f"{s}_pct": sc.tidy(sc.percent(s, "total"), 2) for s in ("positive", "negative", "neutral")
    })


# --- entities and topics ----------------------------------------------------

def _mentions(comments: DataFrame, column: str, name: str, distinct: bool, *keep: str) -> DataFrame:
    items = F.array_distinct(column) if distinct else F.col(column)
    return sc.each(comments, items, name, *keep)


def entity_means(comments: DataFrame, column: str = "topics") -> DataFrame:
    """Mentions and mean sentiment of every entity; one named twice in a comment counts twice."""
    return _mentions(comments, column, "entity", False, "sentiment_score").groupBy("entity").agg(
        F.count("*").alias("mention_count"), F.avg("sentiment_score").alias("avg_sentiment"),
    )


def top_entities(comments: DataFrame, limit: int = 10, column: str = "topics") -> DataFrame:
    return top(entity_means(comments, column), "mention_count", "entity", limit)


def entity_doc_counts(comments: DataFrame, limit: int | None = 10, column: str = "topics") -> DataFrame:
    """Comment counts: an entity counts once per comment. Without a limit, all entities."""
    counted = _mentions(comments, column, "entity", True, "sentiment_score").groupBy("entity").agg(
        F.count("*").alias("count"), F.avg("sentiment_score").alias("avg_sentiment"),
    )
    return counted if limit is None else top(counted, "count", "entity", limit)


def topic_distribution(comments: DataFrame, limit: int = 20) -> DataFrame:
    """Top topics of every program with mean sentiment and engagement."""
    kept = ("program_id", "sentiment_score", "engagement_score")
    counted = _mentions(comments, "topics", "topic", True, *kept).groupBy("program_id", "topic").agg(
        F.count("*").alias("count"),
        F.avg("sentiment_score").alias("avg_sentiment"),
        F.avg("engagement_score").alias("avg_engagement"),
    )
    return top_per(counted, ["program_id"], "count", "topic", limit)


def top_topics(aggregates: DataFrame, limit: int = 10) -> DataFrame:
    """Second-level aggregation of topic rollups, per program.

    ``avg_sentiment`` is the plain mean of the window means; the mean weighted
    by mentions is returned next to it.
    """
    summed = aggregates.groupBy("program_id", "topic").agg(
        F.sum("mention_count").alias("count"),
        F.avg(F.col("sentiment_sum") / F.col("mention_count")).alias("avg_sentiment"),
        (F.sum("sentiment_sum") / F.sum("mention_count")).alias("weighted_sentiment"),
    )
    return top_per(summed, ["program_id"], "count", "topic", limit)


def topic_mentions(comments: DataFrame) -> DataFrame:
    return _mentions(comments, "topics", "topic", False).groupBy("topic").agg(F.count("*").alias("mentions"))


def themes(comments: DataFrame, min_mentions: int = 5, size: int | None = None) -> DataFrame:
    """All entities with at least ``min_mentions``, with a tone from the unrounded
    mean; ``size`` keeps the most frequent ones only."""
    common = entity_doc_counts(comments, size)
    avg = F.round("avg_sentiment", 10)
    return common.filter(F.col("count") >= min_mentions).select(
        F.col("entity").alias("name"), "count",
        sc.tidy("avg_sentiment", 3).alias("avg_sentiment"),
        sc.tone(avg).alias("sentiment_label"),
    )


# --- labels -----------------------------------------------------------------

def quads_of(comments: DataFrame, *keep: str) -> DataFrame:
    """One row per label, sentiments in one vocabulary."""
    return sc.each(comments, "labels", "q", *keep).select(
        *keep, "q.entity", "q.aspect", "q.opinion",
        lab.english_sentiment("q.sentiment").alias("sentiment"),
    )


def label_report(quads: DataFrame, limit: int = 10) -> DataFrame:
    """Sentiment, top entity and top aspect counts as (kind, key, count).

    One pass counts the combinations; the three lists come from that small
    table.
    """
    return report_of(quads.groupBy("sentiment", "entity", "aspect").agg(F.count("*").alias("n")), limit)


def report_of(combos: DataFrame, limit: int = 10) -> DataFrame:
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("key"))
        for kind in ("sentiment", "entity", "aspect")
    ])
    counts = (
        combos.select(F.explode(kinds).alias("item"), "n")
        .groupBy("item.kind", "item.key").agg(F.sum("n").alias("count"))
    )
    return top_per(counts, ["kind"], "count", "key", limit)


def negative_aspects(quads: DataFrame, limit: int = 5) -> DataFrame:
    """Aspects most often negative and their share of all labels on the aspect."""
    negative = F.count_if(F.col("sentiment") == "negative")
    counted = quads.groupBy("aspect").agg(
        negative.alias("count"), sc.tidy(sc.percent(negative, F.count("*")), 2).alias("negative_pct"),
    )
    return top(counted.filter(F.col("count") > 0), "count", "aspect", limit)


def distinct_counts(quads: DataFrame) -> DataFrame:
    """Exact numbers of different entities and aspects."""
    return quads.agg(
        F.count_distinct("entity").alias("entities"), F.count_distinct("aspect").alias("aspects"),
    )


def approx_distinct_counts(quads: DataFrame, error: float = 0.02) -> DataFrame:
    return quads.agg(
        F.approx_count_distinct("entity", error).alias("entities"),
        F.approx_count_distinct("aspect", error).alias("aspects"),
    )


def with_comment_sentiment(comments: DataFrame) -> DataFrame:
    """Comment sentiment and score from its labels."""
    name = lab.majority_sentiment(F.coalesce("labels", F.array()))
    return comments.withColumn("sentiment", name).withColumn(
        "sentiment_score", lab.sentiment_points("sentiment"))


def labeling_run_summary(predictions: DataFrame, labels: str = "labels") -> DataFrame:
    found = F.coalesce(F.size(labels), F.lit(0))
    return predictions.agg(
        F.count("*").alias("processed"),
        F.count_if(found > 0).alias("with_predictions"),
        F.count_if(found <= 0).alias("empty_predictions"),
        F.sum(F.greatest(found, F.lit(0))).alias("total_quads"),
    )


# --- stores -----------------------------------------------------------------

def label_counts(comments: DataFrame) -> DataFrame:
    done = lab.has_labels("labels")
    return comments.agg(
        F.count("*").alias("total"), F.count_if(done).alias("labeled"),
        F.count_if(~done).alias("unlabeled"),
    )


def training_stats(training: DataFrame) -> DataFrame:
    used = F.count_if(F.col("is_used_for_training"))
    return training.agg(
        F.count("*").alias("total"), used.alias("used"),
        (F.count("*") - used).alias("unused"),
        sc.tidy(sc.percent(used, F.count("*")), 2).alias("usage_rate"),
    )


def video_counts(comments: DataFrame, limit: int = 10) -> DataFrame:
    """Top videos by comments, with the total over all videos on each row."""
    counts = comments.groupBy("video_id").agg(F.count("*").alias("count"))
    total = comments.agg(F.count("*").alias("total")).scalar()
    return top(counts, "count", "video_id", limit).withColumn("total_comments", total)


def score_range(metrics: DataFrame, by: str = "program_id") -> DataFrame:
    return metrics.groupBy(by).agg(
        sc.tidy(F.min("score"), 4).alias("min_score"), sc.tidy(F.max("score"), 4).alias("max_score"),
    )


def topic_details(matches: DataFrame, samples: int = 5) -> DataFrame:
    """Figures over the matches of one topic search (a bounded page), with samples."""
    def of(sentiment: str) -> Column:
        return F.count_if(F.col("sentiment") == sentiment)
    newest_first = F.sort_array(F.collect_list(F.struct("timestamp", "comment_id", "text")), asc=False)
    shown = F.transform(F.slice(newest_first, 1, samples), lambda c: sc.preview(c["text"]))
    return matches.agg(
        F.count("*").alias("total_mentions"),
        of("positive").alias("positive"), of("negative").alias("negative"), of("neutral").alias("neutral"),
        F.coalesce(sc.tidy(F.avg("sentiment_score"), 3), F.lit(0.0)).alias("avg_sentiment"),
        shown.alias("samples"),
    )
