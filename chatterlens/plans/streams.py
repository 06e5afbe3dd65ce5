"""Streams over the event table, run to the end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlens import schemas
from chatterlens.functions import scalars as sc
from chatterlens.operators import metrics as mt, rollups
from chatterlens.plans.registry import query, r, score, with_views
from chatterlens.session import scratch
from chatterlens.sources import store, tables
from chatterlens.streaming import pipelines, replay, sinks


def _folders(spark, name):
    base = scratch(spark, name)
    return f"{base}/table", f"{base}/checkpoint"


def _naive(column: str):
    """Event times back without a zone, as stored."""
    return F.col(column).cast("timestamp_ntz").alias(column)


@query("stream_rollup", with_views(f"""
SELECT program_id, time_bucket(INTERVAL 5 MINUTE, "timestamp") AS window_start, count(*) AS total_comments,
       count(*) FILTER (WHERE sentiment = 'positive') AS positive_count, count(*) FILTER (WHERE sentiment = 'negative') AS negative_count,
       count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_count,
       {r(score("avg(sentiment_score)", "avg(engagement_score)"), 4)} AS score
FROM comments GROUP BY 1, 2
""", "comments"))
def stream_rollup(spark, folder):
    path, checkpoint = _folders(spark, "stream-rollup")
    stream = tables.comment_stream(spark, folder)
    sinks.finish(pipelines.roll_up(stream, "program", "5 minutes", path, checkpoint))
    points = rollups.with_score(pipelines.read_rollup(spark, "program", path))
    return points.select(
        "program_id", _naive("window_start"), "total_comments", "positive_count", "negative_count",
        "neutral_count", sc.tidy("score", 4).alias("score"))


ONCE = with_views("""
SELECT program_id, count(DISTINCT comment_id) AS stored FROM comments GROUP BY 1
""", "comments")


@query("stream_dedupe", ONCE)
def stream_dedupe(spark, folder):
    """Every event arrives twice; each id is stored once, however late it comes."""
    path, checkpoint = _folders(spark, "stream-dedupe")
    once = tables.comment_stream(spark, folder).select("comment_id", "program_id", "timestamp")
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    sinks.finish(pipelines.store_new(twice, path, checkpoint))
    return sinks.read_batches(spark, path).groupBy("program_id").agg(F.count("*").alias("stored"))


@query("stream_dedupe_batches", ONCE)
def stream_dedupe_batches(spark, folder):
    """The events arrive in two batches and then, in two more, all of them again."""
    path, checkpoint = _folders(spark, "stream-dedupe")
    source = scratch(spark, "arrivals")
    events = tables.table(spark, folder, "events")
    for _ in range(2):
        events.repartition(2, "event_id").write.mode("append").parquet(f"{source}/events.parquet")
    once = tables.comment_stream(spark, source, files_per_batch=1).select("comment_id", "program_id", "timestamp")
    sinks.finish(pipelines.store_new(once, path, checkpoint))
    return sinks.read_batches(spark, path).groupBy("program_id").agg(F.count("*").alias("stored"))


@query("stream_topic_counts", with_views("""
SELECT topic, count(*) AS mentions FROM (SELECT unnest(topics) AS topic FROM comments) GROUP BY 1
""", "comments"))
def stream_topic_counts(spark, folder):
    path, checkpoint = _folders(spark, "stream-topics")
    counts = pipelines.topic_counts(tables.comment_stream(spark, folder))
    sinks.finish(pipelines.keep_latest(counts, path, checkpoint, "topic"))
    return sinks.latest_values(spark, path, "topic")


@query("stream_snapshot", with_views("""
SELECT program_id, sentiment, count(*) AS "count" FROM comments GROUP BY 1, 2
""", "comments"))
def stream_snapshot(spark, folder):
    path, checkpoint = _folders(spark, "stream-snapshot")
    stream = tables.comment_stream(spark, folder)
    sinks.finish(pipelines.snapshots(stream, path, checkpoint, ("program_id",)))
    return sinks.latest_batch(spark, path)


@query("stream_current_scores", with_views(f"""
SELECT program_id, {r(score("avg(sentiment_score)", "avg(engagement_score)"), 4)} AS score, count(*) AS total_comments
FROM comments GROUP BY 1
""", "comments"))
def stream_current_scores(spark, folder):
    path, checkpoint = _folders(spark, "stream-scores")
    scores = pipelines.current_scores(tables.comment_stream(spark, folder))
    sinks.finish(pipelines.keep_latest(scores, path, checkpoint, "program_id"))
    return sinks.latest_values(spark, path, "program_id").select(
        "program_id", sc.tidy("score", 4).alias("score"), "total_comments")


@query("stream_labels", with_views("""
SELECT sentiment, count(*) AS "count", count(DISTINCT comment_id) AS comments FROM quads GROUP BY 1
""", "quads"))
def stream_labels(spark, folder):
    """Documents arrive unlabeled and are labeled batch by batch."""
    path, checkpoint = _folders(spark, "stream-labels")
    sinks.finish(pipelines.label_stream(tables.text_stream(spark, folder), path, checkpoint))
    return mt.quads_of(sinks.read_batches(spark, path), "comment_id").groupBy("sentiment").agg(
        F.count("*").alias("count"), F.count_distinct("comment_id").alias("comments"))


@query("stream_backlog", """
SELECT lang AS program_id, count(*) FILTER (WHERE doc_id % 5 <= 2) AS labeled,
       count(*) FILTER (WHERE doc_id % 5 > 2) AS waiting
FROM documents GROUP BY 1
""")
def stream_backlog(spark, folder):
    """Documents arrive in five batches; the backlog is due at half of them, so
    the third batch has all up to it labeled, and two batches stay waiting."""
    path, checkpoint = _folders(spark, "stream-backlog")
    source = scratch(spark, "arrivals")
    documents = tables.table(spark, folder, "documents")
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp")
    comments = store.conform(documents.select(
        F.col("doc_id").cast("string").alias("comment_id"), F.col("lang").alias("program_id"), "text",
        moment.alias("timestamp"), moment.alias("created_at"), F.lit(None).cast(schemas.LABELS).alias("labels")), schemas.COMMENT)
    arrivals = replay.in_turns(comments, source, F.col("comment_id").cast("long") % 5, 5)
    sinks.finish(pipelines.label_backlog_stream(arrivals, path, checkpoint, threshold=-(-documents.count() // 2)))
    done = F.col("predicted_at").isNotNull()
    return store.read(spark, path).groupBy("program_id").agg(
        F.count_if(done).alias("labeled"), F.count_if(~done).alias("waiting"))
