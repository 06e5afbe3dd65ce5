"""Program scores, sentiment, topics, trends, anomalies and events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from chatterlens.functions import scalars as sc
from chatterlens.operators import checks, filters, joins, metrics as mt, rollups, rules, search, windows
from chatterlens.plans import derived
from chatterlens.plans.registry import query, r, score, with_views
from chatterlens.session import scratch, settled
from chatterlens.sources import rollup_store, store, tables

DAY = timedelta(days=1)
POINT = ("program_id", "window_start", "positive_count", "negative_count", "neutral_count", "total_comments")


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.program_metrics(tables.comments(spark, folder), "1 hour")


def rollup_store_of(spark: SparkSession, folder: str) -> str:
    """The hours of a data folder, stored in two steps; the last hours stay raw."""
    def build(path: str) -> None:
        comments = tables.comments(spark, folder)
        last = comments.agg(F.max("timestamp")).first()[0]
        full = (last or datetime(1970, 1, 2)).replace(minute=0, second=0, microsecond=0)
        for back in (timedelta(days=10), timedelta(hours=6)):
            rollup_store.fold(comments, path, full - back)
    return derived.stored(spark, folder, "rollups", ("events",), build)


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: sc.tidy(n, digits) for n in names})


# --- scores -----------------------------------------------------------------

@query("program_score_now", with_views(f"""
SELECT program_id, window_start, {r("score", 4)} AS score, positive_count, negative_count,
       neutral_count, total_comments
FROM metrics QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY window_start DESC) = 1
""", "metrics"))
def program_score_now(spark, folder):
    latest = rollup_store.latest(tables.comments(spark, folder), rollup_store_of(spark, folder))
    return rounded(latest.select("program_id", "window_start", *windows.LATEST_COLUMNS), 4, "score")


@query("store_metrics_now", with_views(f"""
SELECT program_id, window_start AS "timestamp", {r("score", 4)} AS score, positive_count, negative_count,
       neutral_count, total_comments
FROM metrics QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY window_start DESC) = 1
""", "metrics"))
def store_metrics_now(spark, folder):
    """Hourly scores written to the metrics table and read back by month."""
    path = scratch(spark, "metrics")
    store.append_metrics(rollup_store.hours(tables.comments(spark, folder), rollup_store_of(spark, folder)), path)
    newest = windows.latest_per_program(store.read(spark, path), ts="timestamp")
    return rounded(newest, 4, "score").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("latest_per_program", with_views(f"""
SELECT program_id, window_start, {r("score", 4)} AS score, total_comments
FROM metrics WHERE program_id IN ('show_1', 'show_2', 'show_3')
QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY window_start DESC) = 1
""", "metrics"))
def latest_per_program(spark, folder):
    latest = rollup_store.latest(
        tables.comments(spark, folder), rollup_store_of(spark, folder), ["show_1", "show_2", "show_3"])
    return rounded(latest.select("program_id", "window_start", "score", "total_comments"), 4, "score")


@query("program_score_timeline", with_views(f"""
SELECT program_id, window_start, {r("score", 4)} AS score, positive_count, negative_count,
       neutral_count, total_comments
FROM metrics WHERE window_start >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
""", "metrics"))
def program_score_timeline(spark, folder):
    comments, path = tables.comments(spark, folder), rollup_store_of(spark, folder)
    start = rollup_store.newest(comments, path, timedelta(days=7))
    points = filters.metric_timeline(rollup_store.hours(comments, path), start=start, ts="window_start")
    return points.select(*POINT, "score")


@query("score_range", with_views(f"""
SELECT program_id, {r("min(score)", 4)} AS min_score, {r("max(score)", 4)} AS max_score
FROM metrics GROUP BY 1
""", "metrics"))
def score_range(spark, folder):
    return mt.score_range(hourly(spark, folder))


@query("rollup_5min", with_views(f"""
SELECT program_id, time_bucket(INTERVAL 5 MINUTE, "timestamp") AS window_start,
       count(*) AS total_comments,
       count(*) FILTER (WHERE sentiment = 'positive') AS positive_count,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative_count,
       count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_count,
       {r("avg(sentiment_score)", 4)} AS avg_sentiment, {r("avg(engagement_score)", 4)} AS avg_engagement,
       {r(score("avg(sentiment_score)", "avg(engagement_score)"), 4)} AS score
FROM comments GROUP BY 1, 2
""", "comments"))
def rollup_5min(spark, folder):
    points = rollups.program_metrics(tables.comments(spark, folder), "5 minutes")
    return rounded(points, 4, "avg_sentiment", "avg_engagement", "score").select(
        *POINT, "avg_sentiment", "avg_engagement", "score")


@query("program_snapshot", with_views(f"""
SELECT program_id, {r(score("avg(sentiment_score)", "avg(engagement_score)"), 4)} AS score,
       count(*) FILTER (WHERE sentiment = 'positive') AS positive_count,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative_count,
       count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_count, count(*) AS total_comments
FROM comments GROUP BY 1
""", "comments"))
def program_snapshot(spark, folder):
    return rounded(rollups.program_snapshot(tables.comments(spark, folder)), 4, "score").select(
        "program_id", *windows.LATEST_COLUMNS)


@query("current_score_detail", with_views(f"""
WITH latest AS (
  SELECT program_id, window_start, score, total_comments FROM metrics
  QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY window_start DESC) = 1),
shares AS (
  SELECT program_id, count(*) FILTER (WHERE sentiment = 'positive') * 100.0 / count(*) AS pos,
         count(*) FILTER (WHERE sentiment = 'negative') * 100.0 / count(*) AS neg
  FROM comments WHERE "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1)
SELECT program_id, window_start, {r("score", 4)} AS score, {r("coalesce(pos, 0)", 2)} AS positive_pct,
       {r("coalesce(neg, 0)", 2)} AS negative_pct, total_comments
FROM latest LEFT JOIN shares USING (program_id)
""", "metrics"))
def current_score_detail(spark, folder):
    comments, path = tables.comments(spark, folder), rollup_store_of(spark, folder)
    latest, _ = settled(rollup_store.latest(comments, path), "latest")
    shares = mt.sentiment_shares(filters.in_range(comments, sc.moment(latest, back=DAY, ts="newest")))
    return (
        latest.join(shares, "program_id", "left").fillna(0.0, ["positive_pct", "negative_pct"])
        .select("program_id", "window_start", sc.tidy("score", 4).alias("score"),
                "positive_pct", "negative_pct", "total_comments")
    )


@query("score_with_fallback", with_views(f"""
WITH cached AS (
  SELECT program_id, max("timestamp") AS updated_at,
         {score("avg(sentiment_score)", "avg(engagement_score)")} AS score
  FROM comments WHERE "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1),
stored AS (
  SELECT program_id, score FROM metrics
  QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY window_start DESC) = 1)
SELECT program_id, {r("coalesce(c.score, s.score)", 4)} AS score,
       CASE WHEN c.score IS NOT NULL THEN 'cache' ELSE 'store' END AS origin
FROM stored s FULL JOIN
     (SELECT * FROM cached WHERE updated_at > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR) c
     USING (program_id)
""", "metrics"))
def score_with_fallback(spark, folder):
    comments, path = tables.comments(spark, folder), rollup_store_of(spark, folder)
    stored, _ = settled(rollup_store.latest(comments, path), "latest")
    recent = filters.in_range(comments, sc.moment(stored, back=DAY, ts="newest"))
    cached = rollups.with_score(recent.groupBy("program_id").agg(
        F.max("timestamp").alias("updated_at"), F.count("*").alias("total_comments"),
        F.sum("sentiment_score").alias("sentiment_sum"), F.sum("engagement_score").alias("engagement_sum"),
    ))
    return rounded(joins.cached_or_stored(cached, stored, sc.moment(stored, ts="newest")), 4, "score")


@query("program_comparison", with_views(f"""
WITH latest AS (
  SELECT program_id, {r("score", 4)} AS score, total_comments FROM metrics
  QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY window_start DESC) = 1),
pairs AS (
  SELECT program_id AS entity_1, 'show_' || ((CAST(split_part(program_id, '_', 2) AS INT) + 1) % 10) AS entity_2
  FROM latest),
diffs AS (
  SELECT entity_1, entity_2, coalesce(a.score, 0) AS score_1, coalesce(b.score, 0) AS score_2,
         coalesce(a.total_comments, 0) AS comments_1, coalesce(b.total_comments, 0) AS comments_2,
         round(coalesce(a.score, 0) - coalesce(b.score, 0), 9) AS diff
  FROM pairs LEFT JOIN latest a ON a.program_id = entity_1 LEFT JOIN latest b ON b.program_id = entity_2),
judged AS (
  SELECT *, CASE WHEN score_2 <> 0 THEN round(diff / score_2 * 100, 9) ELSE 0 END AS pct FROM diffs),
won AS (
  SELECT *, CASE WHEN abs(pct) < 5 THEN 'tie' WHEN diff > 0 THEN entity_1 ELSE entity_2 END AS winner,
         CASE WHEN abs(pct) < 5 THEN 'roughly equal' WHEN diff > 0 THEN 'significantly better'
              ELSE 'significantly worse' END AS verdict FROM judged)
SELECT entity_1, entity_2, score_1, score_2, comments_1, comments_2, {r("diff", 4)} AS difference,
       {r("pct", 2)} AS difference_pct, winner,
       printf('%s is performing %s than %s (EAOS: %.2f vs %.2f, %.1f%% difference)', entity_1, verdict,
              entity_2, {r("score_1", 2)}, {r("score_2", 2)}, {r("abs(pct)", 1)}) AS summary,
       CASE WHEN winner = 'tie'
            THEN printf('Both %s and %s are performing similarly. Consider featuring both equally.', entity_1, entity_2)
            ELSE printf('Consider giving more screen time to %s, which is resonating better with viewers.', winner)
       END AS recommendation
FROM won
""", "metrics"))
def program_comparison(spark, folder):
    latest = windows.latest_per_program(hourly(spark, folder))
    number = F.element_at(F.split("program_id", "_"), 2).cast("int")
    pairs = latest.select(
        F.col("program_id").alias("entity_1"),
        F.concat(F.lit("show_"), ((number + 1) % 10).cast("string")).alias("entity_2"))
    return joins.compare(rounded(latest, 4, "score"), pairs)


@query("metric_series_capped", with_views(f"""
SELECT program_id, window_start, {r("score", 4)} AS score
FROM metrics QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY window_start DESC) <= 100
""", "metrics"))
def metric_series_capped(spark, folder):
    capped = windows.capped_series(hourly(spark, folder), keep=100)
    return rounded(capped, 4, "score").select("program_id", "window_start", "score")


# --- sentiment --------------------------------------------------------------

@query("sentiment_distribution", with_views("""
SELECT program_id, sentiment, count(*) AS "count" FROM comments GROUP BY 1, 2
""", "comments"))
def sentiment_distribution(spark, folder):
    return mt.sentiment_counts(tables.comments(spark, folder), ("program_id",))


@query("sentiment_share", with_views(f"""
SELECT program_id, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
       count(*) FILTER (WHERE sentiment = 'neutral') AS neutral, count(*) AS total,
       {r("count(*) FILTER (WHERE sentiment = 'positive') * 100.0 / count(*)", 2)} AS positive_pct,
       {r("count(*) FILTER (WHERE sentiment = 'negative') * 100.0 / count(*)", 2)} AS negative_pct,
       {r("count(*) FILTER (WHERE sentiment = 'neutral') * 100.0 / count(*)", 2)} AS neutral_pct
FROM comments GROUP BY 1
""", "comments"))
def sentiment_share(spark, folder):
    return mt.sentiment_shares(tables.comments(spark, folder))


@query("sentiment_by_minute", with_views(f"""
SELECT date_trunc('minute', "timestamp") AS timestamp_minute, sentiment, count(*) AS mention_count,
       {r("avg(sentiment_score)", 4)} AS avg_sentiment
FROM comments GROUP BY 1, 2
""", "comments"))
def sentiment_by_minute(spark, folder):
    rolled = rollups.with_average(rollups.by_sentiment(tables.comments(spark, folder)))
    return rounded(rolled, 4, "avg_sentiment").drop("sentiment_sum")


# --- entities and topics ----------------------------------------------------

@query("top_entities", with_views(f"""
SELECT entity, count(*) AS mention_count, {r("avg(sentiment_score)", 4)} AS avg_sentiment
FROM (SELECT unnest(topics) AS entity, sentiment_score FROM comments)
GROUP BY 1 ORDER BY mention_count DESC, entity LIMIT 10
""", "comments"))
def top_entities(spark, folder):
    return rounded(mt.top_entities(tables.comments(spark, folder)), 4, "avg_sentiment")


@query("entity_doc_counts", with_views(f"""
SELECT entity, count(*) AS "count", {r("avg(sentiment_score)", 4)} AS avg_sentiment
FROM (SELECT unnest(list_distinct(topics)) AS entity, sentiment_score FROM comments)
GROUP BY 1 ORDER BY "count" DESC, entity LIMIT 10
""", "comments"))
def entity_doc_counts(spark, folder):
    return rounded(mt.entity_doc_counts(tables.comments(spark, folder)), 4, "avg_sentiment")


@query("entity_hourly", with_views(f"""
SELECT date_trunc('hour', "timestamp") AS timestamp_hour, entity, count(*) AS mention_count,
       {r("avg(sentiment_score)", 4)} AS avg_sentiment
FROM (SELECT "timestamp", unnest(topics) AS entity, sentiment_score FROM comments) GROUP BY 1, 2
""", "comments"))
def entity_hourly(spark, folder):
    rolled = rollups.with_average(rollups.by_entity(tables.comments(spark, folder)))
    return rounded(rolled, 4, "avg_sentiment").drop("sentiment_sum")


@query("topic_hourly", with_views(f"""
SELECT program_id, date_trunc('hour', "timestamp") AS hour_start, topic, count(*) AS mention_count,
       {r("avg(sentiment_score)", 4)} AS avg_sentiment
FROM (SELECT program_id, "timestamp", unnest(topics) AS topic, sentiment_score FROM comments) GROUP BY 1, 2, 3
""", "comments"))
def topic_hourly(spark, folder):
    rolled = rollups.with_average(rollups.by_topic(tables.comments(spark, folder)))
    return rounded(rolled, 4, "avg_sentiment").drop("sentiment_sum")


@query("topic_distribution", with_views(f"""
SELECT program_id, topic, count(*) AS "count", {r("avg(sentiment_score)", 4)} AS avg_sentiment,
       {r("avg(engagement_score)", 4)} AS avg_engagement
FROM (SELECT program_id, unnest(list_distinct(topics)) AS topic, sentiment_score, engagement_score FROM comments)
GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY count(*) DESC, topic) <= 20
""", "comments"))
def topic_distribution(spark, folder):
    return rounded(mt.topic_distribution(tables.comments(spark, folder)), 4, "avg_sentiment", "avg_engagement")


@query("top_topics", with_views(f"""
WITH hourly AS (
  SELECT program_id, date_trunc('hour', "timestamp") AS hour_start, topic, count(*) AS n,
         sum(sentiment_score) AS s
  FROM (SELECT program_id, "timestamp", unnest(topics) AS topic, sentiment_score FROM comments) GROUP BY 1, 2, 3)
SELECT program_id, topic, CAST(sum(n) AS BIGINT) AS "count", {r("avg(s / n)", 4)} AS avg_sentiment,
       {r("sum(s) / sum(n)", 4)} AS weighted_sentiment
FROM hourly GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY sum(n) DESC, topic) <= 10
""", "comments"))
def top_topics(spark, folder):
    aggregates = rollups.by_topic(tables.comments(spark, folder))
    return rounded(mt.top_topics(aggregates), 4, "avg_sentiment", "weighted_sentiment")


@query("topic_mentions", with_views("""
SELECT topic, count(*) AS mentions FROM (SELECT unnest(topics) AS topic FROM comments) GROUP BY 1
""", "comments"))
def topic_mentions(spark, folder):
    return mt.topic_mentions(tables.comments(spark, folder))


@query("themes", with_views(f"""
WITH counts AS (
  SELECT entity, count(*) AS n, avg(sentiment_score) AS a
  FROM (SELECT unnest(list_distinct(topics)) AS entity, sentiment_score FROM comments
        WHERE "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY)
  GROUP BY 1)
SELECT entity AS name, n AS "count", {r("a", 3)} AS avg_sentiment,
       CASE WHEN round(a, 10) > 0.2 THEN 'positive' WHEN round(a, 10) < -0.2 THEN 'negative'
            ELSE 'neutral' END AS sentiment_label
FROM counts WHERE n >= 5
""", "comments"))
def themes(spark, folder):
    return mt.themes(filters.trailing(tables.comments(spark, folder), DAY))


# --- trends -----------------------------------------------------------------

CHANGES = """changes AS (
  SELECT topic, count(*) FILTER (WHERE "timestamp" >= m - INTERVAL 1 DAY) AS cur,
         count(*) FILTER (WHERE "timestamp" < m - INTERVAL 1 DAY) AS prev,
         avg(CASE WHEN "timestamp" >= m - INTERVAL 1 DAY THEN sentiment_score END) AS a
  FROM (SELECT "timestamp", sentiment_score, unnest(topics) AS topic, (SELECT max(ts) FROM events) AS m
        FROM comments)
  WHERE "timestamp" >= m - INTERVAL 2 DAY GROUP BY 1)"""
DIRECTION = """CASE WHEN prev = 0 THEN CASE WHEN cur > 10 THEN 'spike' ELSE 'rising' END
            WHEN cur / prev >= 3 THEN 'spike' WHEN cur / prev >= 1.5 THEN 'rising'
            WHEN cur / prev <= 1 / 1.5::DOUBLE THEN 'falling' ELSE 'stable' END"""


@query("trending_topics", with_views(f"""
WITH {CHANGES},
best AS (SELECT * FROM changes WHERE cur >= 1 ORDER BY cur DESC, topic LIMIT 10)
SELECT topic, cur AS "count", prev AS previous_count, {r("coalesce(a, 0)", 3)} AS sentiment,
       {DIRECTION} AS trend_direction
FROM best
""", "comments"))
def trending_topics(spark, folder):
    return windows.trending_topics(tables.comments(spark, folder), DAY)


@query("trend_direction", with_views(f"""
WITH {CHANGES}
SELECT topic, cur AS current_count, prev AS previous_count, {DIRECTION} AS trend_direction FROM changes
""", "comments"))
def trend_direction(spark, folder):
    comments = tables.comments(spark, folder)
    day_ago, end = sc.moment(comments, back=DAY), sc.moment(comments)
    now = mt.topic_mentions(filters.in_range(comments, day_ago, end))
    earlier = filters.in_range(comments, sc.moment(comments, back=2 * DAY)).filter(F.col("timestamp") < day_ago)
    pair = joins.current_with_previous(
        now.withColumnRenamed("mentions", "mention_count"),
        mt.topic_mentions(earlier).withColumnRenamed("mentions", "mention_count"))
    return windows.trend_directions(pair)


@query("trend_rank", with_views(f"""
WITH {CHANGES}
SELECT topic, cur AS current_count, CAST(row_number() OVER (ORDER BY cur DESC, topic DESC) AS INTEGER) AS rank
FROM changes ORDER BY cur DESC, topic DESC LIMIT 10
""", "comments"))
def trend_rank(spark, folder):
    changes = windows.topic_changes(tables.comments(spark, folder), DAY)
    return windows.ranked(changes.select("topic", "current_count"), "current_count")


@query("topic_bar_share", with_views(f"""
WITH counts AS (
  SELECT topic, count(*) AS mentions FROM (SELECT unnest(topics) AS topic FROM comments) GROUP BY 1
  ORDER BY mentions DESC, topic LIMIT 8)
SELECT topic, mentions, {r("mentions * 100.0 / max(mentions) OVER ()", 2)} AS bar_pct FROM counts
""", "comments"))
def topic_bar_share(spark, folder):
    return windows.bar_shares(mt.topic_mentions(tables.comments(spark, folder)), "mentions", "topic")


@query("trend_topic_sentiment", with_views(f"""
WITH {CHANGES},
best AS (SELECT topic, cur FROM changes ORDER BY cur DESC, topic LIMIT 30),
means AS (
  SELECT entity, avg(sentiment_score) AS a FROM (SELECT unnest(topics) AS entity, sentiment_score FROM comments)
  GROUP BY 1)
SELECT topic, cur AS "count", {r("coalesce(a, 0)", 4)} AS avg_sentiment
FROM best LEFT JOIN means ON topic = entity
""", "comments"))
def trend_topic_sentiment(spark, folder):
    comments = tables.comments(spark, folder)
    changes = windows.topic_changes(comments, DAY)
    best = mt.top(changes, "current_count", "topic", 30).select("topic", F.col("current_count").alias("count"))
    return rounded(joins.with_topic_sentiment(best, mt.entity_means(comments)), 4, "avg_sentiment")


@query("related_topics", with_views(f"""
WITH {CHANGES},
best AS (SELECT topic FROM changes WHERE cur >= 1 ORDER BY cur DESC, topic LIMIT 10),
recent AS (
  SELECT list_distinct(topics) AS topics FROM comments
  WHERE "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY),
pairs AS (
  SELECT topic, unnest(list_filter(topics, lambda o: o <> topic)) AS related
  FROM (SELECT topics, unnest(topics) AS topic FROM recent) WHERE topic IN (SELECT topic FROM best)),
counted AS (
  SELECT topic, related, count(*) AS n FROM pairs GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, related) <= 5)
SELECT topic, string_agg(related, ',' ORDER BY n DESC, related) AS related_entities FROM counted GROUP BY 1
""", "comments"))
def related_topics(spark, folder):
    comments = tables.comments(spark, folder)
    best = windows.trending_topics(comments, DAY)
    related = windows.related_topics(filters.trailing(comments, DAY), best)
    return related.withColumn("related_entities", F.array_join("related_entities", ","))


@query("topic_search", with_views("""
SELECT topic, date_trunc('hour', "timestamp") AS "timestamp", count(*) AS mention_count
FROM (SELECT "timestamp", unnest(topics) AS topic FROM comments) WHERE topic = 'et_error'
GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY mention_count DESC, topic, 2 LIMIT 20
""", "comments"))
def topic_search(spark, folder):
    trends = rollups.by_entity(tables.comments(spark, folder)).select(
        F.col("entity").alias("topic"), F.col("timestamp_hour").alias("timestamp"), "mention_count")
    return search.topic_search(trends, "et_error", min_mentions=2)


@query("cached_topic_upsert", with_views("""
WITH stored AS (
  SELECT topic, count(*) AS score FROM (SELECT "timestamp", unnest(topics) AS topic FROM comments)
  WHERE "timestamp" < (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1),
fresh AS (
  SELECT topic, count(*) AS score FROM (SELECT "timestamp", unnest(topics) AS topic FROM comments)
  WHERE "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1)
SELECT 'replace' AS how, topic, coalesce(f.score, s.score) AS score FROM stored s FULL JOIN fresh f USING (topic)
UNION ALL
SELECT 'increment', topic, coalesce(f.score, 0) + coalesce(s.score, 0) FROM stored s FULL JOIN fresh f USING (topic)
""", "comments"))
def cached_topic_upsert(spark, folder):
    comments = tables.comments(spark, folder)
    is_new = F.when(F.col("timestamp") >= sc.moment(comments, back=DAY), F.lit(1)).alias("seq")
    named = sc.each(comments.withColumn("seq", is_new), "topics", "topic", "seq")
    changes = named.groupBy("topic", "seq").agg(F.count("*").alias("score"))
    folded = store.fold_scores(changes, ("topic",))
    ways = F.array(*[F.struct(F.lit(how).alias("how"), F.col(score).alias("score")) for how, score in (
        ("replace", "replaced"), ("increment", "incremented"))])
    return folded.select("topic", F.inline(ways)).select("how", "topic", "score")


# --- anomalies and events ---------------------------------------------------

def anomaly_sql(metric: str) -> str:
    """The anomaly view of one metric."""
    value = {"eaos": "score", "volume": "CAST(total_comments AS DOUBLE)", "sentiment": "avg_sentiment"}[metric]
    digits = {"eaos": 4, "volume": 1, "sentiment": 4}[metric]
    pct = ("abs(value - mean) / (abs(mean) + 0.01) * 100" if metric == "sentiment"
           else "CASE WHEN mean <> 0 THEN (value - mean) / mean * 100 ELSE 0 END")
    return f"""anomalies_{metric} AS (
  SELECT program_id, "timestamp", '{metric}' AS metric, {r("value", 4)} AS metric_value,
         {r("mean", digits)} AS expected_value, {r("pct", 2)} AS deviation_pct,
         CASE WHEN round(abs(pct), 9) >= 50 THEN 'critical' WHEN round(abs(pct), 9) >= 30 THEN 'high'
              WHEN round(abs(pct), 9) >= 15 THEN 'medium' ELSE 'low' END AS severity
  FROM (SELECT *, {pct} AS pct FROM (
    SELECT program_id, window_start AS "timestamp", {value} AS value,
           avg({value}) OVER p AS mean, stddev_samp({value}) OVER p AS sd, count(*) OVER p AS points
    FROM metrics WINDOW p AS (PARTITION BY program_id)))
  WHERE points >= 3 AND round(abs(value - mean), 9) > round(2 * sd, 9))"""


def _newest_sql(metric: str) -> str:
    return with_views(f"""
WITH {anomaly_sql(metric)}
SELECT *, count(*) OVER (PARTITION BY program_id, metric) AS total_anomalies FROM anomalies_{metric}
QUALIFY row_number() OVER (PARTITION BY program_id, metric ORDER BY "timestamp" DESC) <= 10
""", "metrics")


@query("anomalies_eaos", _newest_sql("eaos"))
def anomalies_eaos(spark, folder):
    return windows.newest_anomalies(windows.anomalies(hourly(spark, folder), "eaos"))


@query("anomalies_volume", _newest_sql("volume"))
def anomalies_volume(spark, folder):
    return windows.newest_anomalies(windows.anomalies(hourly(spark, folder), "volume"))


@query("anomalies_sentiment", _newest_sql("sentiment"))
def anomalies_sentiment(spark, folder):
    return windows.newest_anomalies(windows.anomalies(hourly(spark, folder), "sentiment"))


@query("recent_anomalies", with_views(f"""
WITH {anomaly_sql("volume")}
SELECT * FROM anomalies_volume
WHERE severity = 'critical'
  AND "timestamp" >= (SELECT max("timestamp") FROM anomalies_volume WHERE severity = 'critical') - INTERVAL 3 DAY
ORDER BY "timestamp" DESC, program_id LIMIT 20
""", "metrics"))
def recent_anomalies(spark, folder):
    hours = rollup_store.hours(tables.comments(spark, folder), rollup_store_of(spark, folder))
    found, _ = settled(windows.anomalies(hours, "volume"), "anomalies")
    return filters.recent_anomalies(found, timedelta(days=3), severity="critical")


EVENTS_SQL = f"""steps AS (
  SELECT program_id, window_start AS "timestamp", total_comments, score,
         lag(total_comments) OVER p AS total_before, lag(score) OVER p AS score_before
  FROM metrics WINDOW p AS (PARTITION BY program_id ORDER BY window_start)),
inferred AS (
  SELECT program_id, "timestamp", 'volume_spike' AS event_type,
         printf('Sudden increase in viewer engagement (%d comments)', total_comments) AS description
  FROM steps WHERE total_comments > 1.5 * total_before
  UNION ALL
  SELECT program_id, "timestamp", 'eaos_drop',
         printf('EAOS dropped from %.2f to %.2f', {r("score_before", 2)}, {r("score", 2)})
  FROM steps WHERE round(score, 9) < round(0.8 * score_before, 9))"""


@query("program_events", with_views(f"""
WITH {EVENTS_SQL}
SELECT * FROM inferred
UNION ALL
SELECT DISTINCT program_id, (SELECT max(ts) FROM events), 'segment', 'Program segment (inferred)' FROM metrics
""", "metrics"))
def program_events(spark, folder):
    latest = sc.moment(tables.comments(spark, folder))
    return windows.program_events(hourly(spark, folder), marker_at=latest)


@query("recent_events", with_views(f"""
WITH {EVENTS_SQL},
kept AS (
  SELECT * FROM inferred
  WHERE CAST("timestamp" AS DATE) > (SELECT CAST(max("timestamp") AS DATE) FROM inferred) - 3)
SELECT * FROM kept
QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY "timestamp" DESC, event_type) <= 10
""", "metrics"))
def recent_events(spark, folder):
    return windows.recent_events(windows.program_events(hourly(spark, folder)), days=3, limit=10)


@query("anomaly_event_correlation", with_views(f"""
WITH {anomaly_sql("volume")}, {EVENTS_SQL}
SELECT a.program_id, a."timestamp" AS moment, a.severity, i."timestamp" AS event_time, i.event_type
FROM anomalies_volume a JOIN inferred i
  ON i.program_id = a.program_id
 AND i."timestamp" BETWEEN a."timestamp" - INTERVAL 2 HOUR AND a."timestamp" + INTERVAL 2 HOUR
""", "metrics"))
def anomaly_event_correlation(spark, folder):
    points = hourly(spark, folder)
    moments = windows.anomalies(points, "volume").select("program_id", "timestamp", "severity")
    events = windows.program_events(points).select("program_id", "timestamp", "event_type")
    return joins.around(moments, events, timedelta(hours=2))


@query("recommendations", with_views(f"""
WITH {anomaly_sql("eaos")}, {anomaly_sql("volume")}, {anomaly_sql("sentiment")},
found AS (
  SELECT * FROM anomalies_eaos UNION ALL SELECT * FROM anomalies_volume UNION ALL SELECT * FROM anomalies_sentiment),
contexts AS (
  SELECT program_id, "timestamp", metric,
         CASE WHEN metric = 'eaos' AND metric_value < expected_value
              THEN 'EAOS drop' || CASE WHEN severity = 'critical' THEN ' with negative comments' ELSE '' END
              WHEN metric = 'volume' AND metric_value > expected_value THEN 'Volume spike'
              WHEN metric = 'sentiment' AND metric_value < expected_value THEN 'Negative comments about an issue'
              ELSE 'Unusual ' || metric END || ' on ' || program_id AS context FROM found),
rated AS (
  SELECT *, lower(context) AS c FROM contexts)
SELECT program_id, "timestamp", metric, context,
       CASE WHEN c LIKE '%eaos%' AND c LIKE '%drop%' AND c LIKE '%negative%' THEN 0.85
            WHEN c LIKE '%negative%' AND c LIKE '%issue%' THEN 0.82
            WHEN c LIKE '%volume%' AND c LIKE '%spike%' THEN 0.80
            WHEN c LIKE '%eaos%' AND c LIKE '%drop%' THEN 0.75
            WHEN c LIKE '%unusual%' THEN 0.70 ELSE 0.60 END::DOUBLE AS confidence
FROM rated
""", "metrics"))
def recommendations(spark, folder):
    found = windows.anomalies(hourly(spark, folder))
    contexts = found.select("program_id", "timestamp", "metric", rules.anomaly_context().alias("context"))
    return rules.recommend(contexts).drop("recommendation", "reasoning")


# --- comment pages and checks -----------------------------------------------

@query("recent_comments", with_views("""
SELECT comment_id, program_id, "timestamp",
       row_number() OVER (ORDER BY "timestamp" DESC, comment_id DESC) <= 20 AS is_recent
FROM comments ORDER BY "timestamp" DESC, comment_id DESC LIMIT 1000
""", "comments"))
def recent_comments(spark, folder):
    rows = tables.comments(spark, folder).select("comment_id", "program_id", "timestamp")
    return windows.newest_comments(rows)


@query("sample_comments", with_views("""
SELECT comment_id, program_id, "timestamp", username, engagement_score FROM comments
WHERE sentiment = 'negative' AND list_contains(topics, 'k_7')
ORDER BY "timestamp" DESC, comment_id DESC LIMIT 10
""", "comments"))
def sample_comments(spark, folder):
    found = search.sample_comments(tables.comments(spark, folder), "k_7", "negative")
    return found.select("comment_id", "program_id", "timestamp", "username", "engagement_score")


@query("any_topic_filter", with_views("""
SELECT comment_id, program_id, sentiment FROM comments WHERE list_has_any(topics, ['k_3', 'et_signup'])
""", "comments"))
def any_topic_filter(spark, folder):
    found = filters.any_of(tables.comments(spark, folder), "topics", ["k_3", "et_signup"])
    return found.select("comment_id", "program_id", "sentiment")


@query("range_label_filter", with_views("""
SELECT comment_id, program_id, "timestamp" FROM comments
WHERE sentiment = 'neutral' AND "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE
""", "comments"))
def range_label_filter(spark, folder):
    recent = filters.in_labeled_range(tables.comments(spark, folder), "1hour")
    return filters.equal_to(recent, sentiment="neutral").select("comment_id", "program_id", "timestamp")


@query("events_on_date", """
SELECT 'show_' || (user_id % 10) AS program_id, event_id AS seq, event_type, json_extract_string(props, '$.k') AS description
FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'
QUALIFY row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) <= 100
""")
def events_on_date(spark, folder):
    """Program events as JSON text, made from the event rows."""
    payload = F.to_json(F.struct(
        F.col("ts").cast("string").alias("timestamp"), "event_type",
        F.get_json_object("props", "$.k").alias("description")))
    events = tables.table(spark, folder, "events").select(
        F.concat(F.lit("show_"), (F.col("user_id") % 10).cast("string")).alias("program_id"),
        F.col("ts").alias("event_time"), F.col("event_id").alias("seq"), payload.alias("payload"))
    return filters.events_on(events, F.lit("2024-01-15").cast("date"))


@query("semi_filter", with_views("""
SELECT comment_id, program_id FROM comments
WHERE program_id IN (SELECT program_id FROM comments WHERE sentiment = 'negative' GROUP BY 1
                     HAVING count(*) > (SELECT count(*) FROM comments WHERE sentiment = 'negative') / 10)
""", "comments"))
def semi_filter(spark, folder):
    """Comments of the programs with an above-average number of negative ones."""
    comments = tables.comments(spark, folder)
    negative = comments.filter(F.col("sentiment") == "negative")
    total = negative.agg(F.count("*").alias("n")).scalar()
    listed = negative.groupBy("program_id").agg(F.count("*").alias("n")).filter(F.col("n") > total / 10)
    return joins.restrict_to(comments, listed, "program_id").select("comment_id", "program_id")


@query("request_fingerprint", with_views("""
SELECT program_id, 'cache:score:' || md5('score:{"program_id":"' || program_id || '","total":' || count(*) || '}')
       AS request_key
FROM comments GROUP BY 1
""", "comments"))
def request_fingerprint(spark, folder):
    totals = tables.comments(spark, folder).groupBy("program_id").agg(F.count("*").alias("total"))
    return totals.select("program_id", sc.fingerprint("score", "program_id", "total").alias("request_key"))


@query("retention", with_views("""
SELECT strftime("timestamp", '%Y%m') AS "month", program_id, count(*) AS "count" FROM comments
WHERE "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1, 2
""", "comments"))
def retention(spark, folder):
    kept = store.retained(tables.comments(spark, folder), 7)
    return checks.with_month(kept).groupBy("month", "program_id").agg(F.count("*").alias("count"))


@query("v1_to_v2", with_views(f"""
SELECT 'tv/' || program_id AS program_id, window_start AS "timestamp", {r("score", 4)} AS score,
       total_comments, '1hour' AS time_range
FROM metrics
""", "metrics"))
def v1_to_v2(spark, folder):
    v1 = checks.metrics_as_v1(hourly(spark, folder), 60)
    return rounded(checks.metrics_to_v2(v1, "tv"), 4, "score")


@query("quality_checks", with_views("""
SELECT 'metrics' AS "table", 'score_in_range' AS rule, count(*) FILTER (WHERE NOT score BETWEEN 0 AND 1) AS violations FROM metrics
UNION ALL SELECT 'metrics', 'counts_add_up',
  count(*) FILTER (WHERE positive_count + negative_count + neutral_count <> total_comments) FROM metrics
UNION ALL SELECT 'metrics', 'counts_not_negative',
  count(*) FILTER (WHERE least(positive_count, negative_count, neutral_count) < 0) FROM metrics
UNION ALL SELECT 'metrics', 'program_present', count(*) FILTER (WHERE coalesce(program_id, '') = '') FROM metrics
UNION ALL SELECT 'comments', 'comment_id_present', count(*) FILTER (WHERE comment_id IS NULL) FROM comments
UNION ALL SELECT 'comments', 'timestamp_present', count(*) FILTER (WHERE "timestamp" IS NULL) FROM comments
UNION ALL SELECT 'comments', 'sentiment_known',
  count(*) FILTER (WHERE sentiment NOT IN ('positive', 'negative', 'neutral')) FROM comments
UNION ALL SELECT 'comments', 'sentiment_score_in_range', count(*) FILTER (WHERE NOT sentiment_score BETWEEN -1 AND 1) FROM comments
UNION ALL SELECT 'comments', 'engagement_in_range', count(*) FILTER (WHERE NOT engagement_score BETWEEN 0 AND 100) FROM comments
""", "metrics"))
def quality_checks(spark, folder):
    def found(name, rows, rule_set):
        return checks.violations(rows, rule_set).select(F.lit(name).alias("table"), "rule", "violations")
    return checks.all_checks(
        found("metrics", hourly(spark, folder), checks.metric_rules()),
        found("comments", tables.comments(spark, folder), checks.comment_rules()))
