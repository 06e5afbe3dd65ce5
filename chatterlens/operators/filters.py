"""Row filters, pages and projections over comments and training rows."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatterlens.functions import labels as lab, scalars as sc


# --- predicates -------------------------------------------------------------

def in_range(df: DataFrame, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """Inclusive at both ends; an open end is left out."""
    if start is not None:
        df = df.filter(F.col(ts) >= start)
    if end is not None:
        df = df.filter(F.col(ts) <= end)
    return df


def trailing(
    df: DataFrame, back: timedelta, as_of: datetime | Column | None = None, ts: str = "timestamp",
) -> DataFrame:
    """Rows of the last ``back`` before ``as_of`` (default: newest row)."""
    end = None if as_of is None else sc.moment(df, as_of, ts=ts)
    return in_range(df, sc.moment(df, as_of, back, ts), end, ts)


def in_labeled_range(
    df: DataFrame, label: str | None, default_minutes: int = 15, as_of=None, ts: str = "timestamp",
) -> DataFrame:
    """Trailing filter from a range label such as ``15min``."""
    return trailing(df, sc.range_span(label, default_minutes), as_of, ts)


def equal_to(df: DataFrame, **values) -> DataFrame:
    """Equality on any columns; ``None`` means no restriction."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def any_of(df: DataFrame, column: str, values: list[str] | None) -> DataFrame:
    """Array column shares at least one element with ``values``."""
    return df.filter(F.arrays_overlap(column, F.lit(values))) if values else df


def newest(
    df: DataFrame, limit: int | None, skip: int = 0, ts: str = "timestamp", key: str = "comment_id",
) -> DataFrame:
    """A page in descending time, or all rows that follow ``skip``; the key settles equal times."""
    ordered = df.orderBy(F.col(ts).desc(), F.col(key).desc())
    ordered = ordered.offset(skip) if skip else ordered
    return ordered if limit is None else ordered.limit(limit)


# --- labeling backlog -------------------------------------------------------

def backlog(df: DataFrame) -> DataFrame:
    return df.filter(lab.needs_labeling())


def next_to_label(df: DataFrame, limit: int = 5) -> DataFrame:
    return newest(backlog(df).select("comment_id", "text", "created_at"), limit, ts="created_at")


def backlog_due(df: DataFrame, threshold: int = 100) -> DataFrame:
    waiting = F.count_if(lab.needs_labeling())
    return df.agg(waiting.alias("waiting"), (waiting >= threshold).alias("is_due"))


def labeled(df: DataFrame) -> DataFrame:
    return df.filter(lab.has_labels("labels"))


def labeled_page(df: DataFrame, limit: int = 100, skip: int = 0) -> DataFrame:
    return newest(labeled(df), limit, skip, ts="predicted_at")


def with_status(df: DataFrame, comment_id=None) -> DataFrame:
    found = equal_to(df, comment_id=comment_id)
    done = lab.has_labels("labels")
    return found.withColumns({
        "is_labeled": done, "status": F.when(done, "labeled").otherwise("pending"),
    })


# --- other pages ------------------------------------------------------------

def comments_by_video(df: DataFrame, video_id: str | None = None, limit: int = 100, skip: int = 0) -> DataFrame:
    return newest(equal_to(df, video_id=video_id), limit, skip, ts="created_at")


def training_page(df: DataFrame, limit: int | None = 1000, skip: int = 0, unused_only: bool = True) -> DataFrame:
    rows = df.filter(~F.col("is_used_for_training")) if unused_only else df
    return newest(rows, limit, skip, ts="consumed_at", key="id")


def training_projection(df: DataFrame) -> DataFrame:
    return labeled(df).select("text", "labels")


def display_feed(df: DataFrame, limit: int = 50) -> DataFrame:
    """Labeled comments as shown to a viewer."""
    return labeled_page(df, limit).select(
        F.col("comment_id").alias("id"), "text", "labels",
        F.coalesce("predicted_at", "created_at").alias("timestamp"),
        F.concat(F.lit("User ("), F.col("source"), F.lit(")")).alias("username"),
    )


def metric_timeline(
    metrics: DataFrame, program_id: str | None = None, start=None, end=None, ts: str = "timestamp",
) -> DataFrame:
    """Metric points of a range in ascending time, score rounded for reporting."""
    points = in_range(equal_to(metrics, program_id=program_id), start, end, ts)
    return points.withColumn("score", sc.tidy("score", 4)).orderBy("program_id", ts)


def events_on(events: DataFrame, day: date | Column, limit: int = 100) -> DataFrame:
    """Program events of one date from their JSON text: the first ``limit`` stored
    per program, then without those that do not parse.

    ``events`` has program_id, event_time, seq (order of arrival) and payload.
    """
    first = Window.partitionBy("program_id").orderBy("seq")
    head = (
        events.filter(F.to_date("event_time") == day)
        .withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit)
    )
    parsed = F.from_json("payload", "timestamp string, event_type string, description string")
    return (
        head.withColumn("event", parsed)
        .filter(F.col("event.event_type").isNotNull())
        .select("program_id", "seq", "event.event_type", "event.description")
    )


def recent_anomalies(
    anomalies: DataFrame, back: timedelta = timedelta(hours=1), program_id: str | None = None,
    severity: str | None = None, limit: int = 20, as_of=None,
) -> DataFrame:
    recent = trailing(equal_to(anomalies, program_id=program_id, severity=severity), back, as_of)
    return recent.orderBy(F.col("timestamp").desc(), "program_id", "metric").limit(limit)
