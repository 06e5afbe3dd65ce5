"""Latest rows, ranks, anomalies, inferred events and trends.

Window frames here run over rollup rows (at most one per program and time
window), never over raw comments.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatterlens.functions import scalars as sc
from chatterlens.operators import filters, metrics as mt

LATEST_COLUMNS = ("score", "positive_count", "negative_count", "neutral_count", "total_comments")


def latest_per_program(
    metrics: DataFrame, programs: list[str] | None = None, ts: str = "window_start",
    columns: tuple[str, ...] = LATEST_COLUMNS,
) -> DataFrame:
    """Newest metric row of each program, by partial aggregation."""
    if programs:
        metrics = metrics.filter(F.col("program_id").isin(programs))
    newest = F.max(F.struct(F.col(ts), *columns)).alias("m")
    return metrics.groupBy("program_id").agg(newest).select("program_id", "m.*")


def unexpired(current: DataFrame, ttl: timedelta, as_of=None, ts: str = "updated_at") -> DataFrame:
    """Current rows whose time to live has not run out."""
    return current.filter(F.col(ts) > sc.moment(current, as_of, ttl, ts))


# --- anomalies --------------------------------------------------------------

ANOMALY_VALUES = {"eaos": "score", "volume": "total_comments", "sentiment": "avg_sentiment"}


def anomalies(
    metrics: DataFrame, *names: str, ts: str = "window_start", min_points: int = 3,
    deviations: float = 2.0,
) -> DataFrame:
    """Points further than ``deviations`` sample standard deviations from the
    mean of their program's series, for the named metrics (default: all)."""
    values = F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(ANOMALY_VALUES[n]).cast("double").alias("value"))
        for n in names or ANOMALY_VALUES
    ]))
    points = metrics.select("program_id", F.col(ts).alias("timestamp"), values)
    series = ["program_id", "metric"]
    baseline = points.groupBy(*series).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("points"),
    )
    far = F.round(F.abs(F.col("value") - F.col("mean")), 9) > F.round(deviations * F.col("sd"), 9)
    pct = F.when(
        F.col("metric") == "sentiment", sc.deviation_pct("sentiment", "value", "mean")
    ).otherwise(sc.deviation_pct("eaos", "value", "mean"))
    expected = F.when(F.col("metric") == "volume", sc.tidy("mean", 1)).otherwise(sc.tidy("mean", 4))
    return (
        points.join(baseline.filter(F.col("points") >= min_points), series)
        .filter(far)
        .select(
            *series, "timestamp", sc.tidy("value", 4).alias("metric_value"),
            expected.alias("expected_value"), sc.tidy(pct, 2).alias("deviation_pct"),
            sc.severity(F.round(pct, 9)).alias("severity"),
        )
    )


def newest_anomalies(found: DataFrame, limit: int = 10) -> DataFrame:
    """Newest anomalies per program and metric plus how many there are in all."""
    series = Window.partitionBy("program_id", "metric")
    return (
        found.withColumns({
            "total_anomalies": F.count("*").over(series),
            "place": F.row_number().over(series.orderBy(F.col("timestamp").desc())),
        })
        .filter(F.col("place") <= limit).drop("place")
    )


# --- inferred events --------------------------------------------------------

def program_events(
    metrics: DataFrame, ts: str = "window_start", spike: float = 1.5, drop: float = 0.8,
    marker_at: datetime | Column | None = None,
) -> DataFrame:
    """Volume spikes and score drops between consecutive points of a program,
    plus one segment marker per program when ``marker_at`` is given."""
    series = Window.partitionBy("program_id").orderBy(ts)
    steps = metrics.select(
        "program_id", F.col(ts).alias("at"), "total_comments", "score",
        F.lag("total_comments").over(series).alias("total_before"),
        F.lag("score").over(series).alias("score_before"),
        F.row_number().over(series).alias("place"),
        (marker_at if isinstance(marker_at, Column) else F.lit(marker_at)).alias("marker_at"),
    )
    spiked = F.col("total_comments") > spike * F.col("total_before")
    dropped = F.round("score", 9) < F.round(drop * F.col("score_before"), 9)

    def event(at: Column, kind: str, text: Column) -> Column:
        return F.struct(at.alias("timestamp"), F.lit(kind).alias("event_type"), text.alias("description"))
    candidates = [
        F.when(spiked, event(F.col("at"), "volume_spike", F.format_string(
            "Sudden increase in viewer engagement (%d comments)", "total_comments"))),
        F.when(dropped, event(F.col("at"), "eaos_drop", F.format_string(
            "EAOS dropped from %.2f to %.2f", sc.tidy("score_before", 2), sc.tidy("score", 2)))),
    ]
    if marker_at is not None:
        first = F.col("place") == 1
        candidates.append(F.when(
            first, event(F.col("marker_at"), "segment", F.lit("Program segment (inferred)"))))
    happened = F.filter(F.array(*candidates), lambda e: e.isNotNull())
    return sc.each(steps, happened, "event", "program_id").select("program_id", "event.*")


def recent_events(events: DataFrame, days: int = 1, limit: int = 50, as_of=None) -> DataFrame:
    """The newest ``limit`` events per program within the last days."""
    newest_day = F.to_date(sc.moment(events, as_of))
    kept = events.filter(F.to_date("timestamp") > F.date_sub(newest_day, days))
    overall = Window.partitionBy("program_id").orderBy(F.col("timestamp").desc(), "event_type")
    return (
        kept.withColumn("place", F.row_number().over(overall)).filter(F.col("place") <= limit)
        .drop("place")
    )


# --- trends -----------------------------------------------------------------

def topic_changes(comments: DataFrame, back: timedelta, as_of=None, by: tuple[str, ...] = ()) -> DataFrame:
    """Mentions of each topic in the current and the preceding window of equal
    length, counted in one pass."""
    start = sc.moment(comments, as_of, back)
    current = F.col("timestamp") >= F.col("start")
    recent = filters.trailing(comments, 2 * back, as_of).withColumn("start", start)
    rows = sc.each(recent, "topics", "topic", *by, "timestamp", "sentiment_score", "start")
    return rows.groupBy(*by, "topic").agg(
        F.count_if(current).alias("current_count"),
        F.count_if(~current).alias("previous_count"),
        F.avg(F.when(current, F.col("sentiment_score"))).alias("avg_sentiment"),
    )


def trend_directions(changes: DataFrame, threshold: float = 1.5) -> DataFrame:
    return changes.withColumn(
        "trend_direction", sc.trend_direction("current_count", "previous_count", threshold))


def trending_topics(
    comments: DataFrame, back: timedelta, limit: int = 10, as_of=None, min_mentions: int = 1,
    threshold: float = 1.5,
) -> DataFrame:
    """Most mentioned topics of the current window with sentiment and direction."""
    changes = topic_changes(comments, back, as_of).filter(F.col("current_count") >= min_mentions)
    busiest = mt.top(changes, "current_count", "topic", limit)
    return trend_directions(busiest, threshold).select(
        "topic", F.col("current_count").alias("count"), "previous_count",
        sc.tidy(F.coalesce("avg_sentiment", F.lit(0.0)), 3).alias("sentiment"), "trend_direction",
    )


def related_topics(comments: DataFrame, trending: DataFrame, limit: int = 5) -> DataFrame:
    """The topics most often named together with each trending topic.

    Spark decides by the size of ``trending`` how to join. A comment with k
    topics makes at most k - 1 rows for each trending one among them.
    """
    named = sc.each(comments, F.array_distinct("topics"), "topic", "topics")
    hits = named.join(trending.select("topic"), "topic")
    others = sc.each(hits, F.array_except("topics", F.array("topic")), "related", "topic")
    counted = others.groupBy("topic", "related").agg(F.count("*").alias("together"))
    best = mt.top_per(counted, ["topic"], "together", "related", limit)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("together")).alias("n"), "related")))
    return best.groupBy("topic").agg(
        F.transform(ordered, lambda r: r["related"]).alias("related_entities"))


def ranked(topics: DataFrame, score: str, limit: int = 10) -> DataFrame:
    """Sorted-set order: score descending, equal scores by topic descending.

    The rank window sees only the ``limit`` rows that survive the top-k.
    """
    order = (F.col(score).desc(), F.col("topic").desc())
    best = topics.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def bar_shares(counts: DataFrame, measure: str, key: str, limit: int = 8) -> DataFrame:
    """Bar length in percent of the longest bar, for the top ``limit`` rows."""
    best = mt.top(counts, measure, key, limit)
    longest = F.max(measure).over(Window.partitionBy())
    return best.withColumn("bar_pct", sc.tidy(sc.percent(measure, longest), 2))


# --- bounded lists ----------------------------------------------------------

def newest_comments(comments: DataFrame, keep: int = 1000, show: int = 20) -> DataFrame:
    """The buffer of the newest ``keep`` comments; ``is_recent`` marks the last ``show``."""
    buffer = filters.newest(comments, keep)
    order = Window.orderBy(F.col("timestamp").desc(), F.col("comment_id").desc())
    return buffer.withColumn("is_recent", F.row_number().over(order) <= show)


def capped_series(points: DataFrame, keep: int = 1000, by: str = "program_id", ts: str = "window_start") -> DataFrame:
    """Newest ``keep`` points of each series."""
    order = Window.partitionBy(by).orderBy(F.col(ts).desc())
    return points.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).drop("place")
