"""The stored comment table: append, upsert, clear, and reading back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from chatterlens.functions import scalars as sc
from chatterlens.plans.registry import query, r, with_views
from chatterlens.session import scratch
from chatterlens.sources import store, tables


def _stored(spark, folder, name: str) -> tuple[DataFrame, str]:
    """The comments in a fresh store, and its path."""
    path = scratch(spark, name)
    rows = tables.comments(spark, folder).withColumns({
        "timestamp": F.col("timestamp").cast("timestamp"), "version": F.lit(1),
        "metadata": F.create_map(F.lit("origin"), F.lit("events"), F.lit("user"), F.col("username"))})
    store.append(rows, path, "comments")
    return rows, path


@query("store_read_range", with_views("""
SELECT strftime("timestamp", '%Y%m') AS "month", program_id, count(*) AS "count" FROM comments
WHERE "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1, 2
""", "comments"))
def store_read_range(spark, folder):
    _, path = _stored(spark, folder, "store-read")
    stored = store.read(spark, path)
    recent = store.read(spark, path, start=sc.moment(stored, back=timedelta(days=7)))
    return recent.groupBy("month", "program_id").agg(F.count("*").alias("count"))


@query("store_upsert", with_views(f"""
SELECT program_id, count(*) AS "count", count(*) FILTER (WHERE sentiment = 'negative') AS changed,
       {r("sum(CASE WHEN sentiment = 'negative' THEN 0 ELSE engagement_score END)", 2)} AS engagement
FROM comments GROUP BY 1
""", "comments"))
def store_upsert(spark, folder):
    """Negative comments come again with engagement 0 and a higher version."""
    rows, path = _stored(spark, folder, "store-upsert")
    again = rows.filter(F.col("sentiment") == "negative").withColumns({
        "engagement_score": F.lit(0.0), "version": F.lit(2)})
    store.upsert(again, path, "comments", "comment_id", "version")
    return store.read(spark, path).groupBy("program_id").agg(
        F.count("*").alias("count"), F.count_if(F.col("version") == 2).alias("changed"),
        sc.tidy(F.sum("engagement_score"), 2).alias("engagement"))


@query("store_clear", with_views("""
SELECT program_id, count(*) AS "count" FROM comments WHERE program_id <> 'show_3' GROUP BY 1
""", "comments"))
def store_clear(spark, folder):
    _, path = _stored(spark, folder, "store-clear")
    store.clear(spark, path, "comments", F.col("program_id") == "show_3")
    return store.read(spark, path).groupBy("program_id").agg(F.count("*").alias("count"))
