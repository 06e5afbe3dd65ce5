"""Search, the labeling backlog, training rows and conversations."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatterlens.functions import scalars as sc
from chatterlens.operators import filters, joins, labeling, metrics as mt, rules, search, training
from chatterlens.plans import derived
from chatterlens.plans.registry import query, r, with_views
from chatterlens.sources import postings, readers, tables

STAMP = datetime(2024, 6, 1)


def stamp() -> Column:
    return F.lit(f"{STAMP:%Y-%m-%d %H:%M:%S}").cast("timestamp_ntz")


# --- search -----------------------------------------------------------------

@query("search_substring", with_views("""
SELECT comment_id, program_id, video_id, "timestamp" FROM timed WHERE contains(lower(text), 'ich der')
ORDER BY "timestamp" DESC, comment_id DESC LIMIT 100
""", "timed"))
def search_substring(spark, folder):
    hits = search.substring_search(tables.timed_texts(spark, folder), "Ich DER")
    return hits.select("comment_id", "program_id", "video_id", "timestamp")


def scored_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the sentiment of their labels; unlabeled ones are neutral."""
    return mt.with_comment_sentiment(tables.texts(spark, folder)).withColumnRenamed("created_at", "timestamp")


#: What the index keeps of a comment beside its words.
INDEXED = ("program_id", "timestamp", "sentiment")


def text_index(spark: SparkSession, folder: str) -> str:
    """The stored index over all documents."""
    return derived.stored(spark, folder, "text-index", ("documents", "labels"), lambda path: postings.add(
        scored_texts(spark, folder), path, INDEXED))


BM25 = """counted AS (
  SELECT d.doc_id AS comment_id, count(w.token) AS dl, count(*) FILTER (WHERE w.token = 'pour') AS t1,
         count(*) FILTER (WHERE w.token = 'und') AS t2, count(*) FILTER (WHERE w.token = 'the') AS t3
  FROM documents d LEFT JOIN words w ON w.comment_id = d.doc_id GROUP BY 1),
stats AS (
  SELECT count(*) AS docs, avg(dl) AS avg_length, count(*) FILTER (WHERE t1 > 0) AS d1, count(*) FILTER (WHERE t2 > 0) AS d2, count(*) FILTER (WHERE t3 > 0) AS d3
  FROM counted),
scored AS (
  SELECT comment_id,
         ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avg_length))
       + ln(1 + (docs - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * dl / avg_length))
       + ln(1 + (docs - d3 + 0.5) / (d3 + 0.5)) * t3 * 2.2 / (t3 + 1.2 * (0.25 + 0.75 * dl / avg_length)) AS relevance
  FROM counted, stats WHERE t1 + t2 + t3 > 0)"""


@query("search_bm25", with_views(f"""
WITH {BM25} SELECT comment_id, {r("relevance", 6)} AS relevance FROM scored
""", "words"))
def search_bm25(spark, folder):
    hits = search.indexed_search(spark, text_index(spark, folder), "Pour und THE", size=None)
    return hits.select("comment_id", sc.tidy("relevance", 6).alias("relevance"))


@query("search_fulltext", with_views(f"""
WITH {BM25}
SELECT comment_id, program_id, "timestamp", {r("relevance", 6)} AS relevance
FROM scored JOIN timed USING (comment_id) WHERE program_id = 'fr'
ORDER BY "timestamp" DESC, comment_id DESC LIMIT 50
""", "words", "timed"))
def search_fulltext(spark, folder):
    hits = search.indexed_search(
        spark, text_index(spark, folder), "Pour und THE", INDEXED, size=50, program_id="fr")
    return hits.select("comment_id", "program_id", "timestamp", sc.tidy("relevance", 6).alias("relevance"))


@query("search_tool", with_views("""
WITH hits AS (
  SELECT DISTINCT t.comment_id, t.created_at AS "timestamp", coalesce(t.sentiment, 'neutral') AS sentiment
  FROM texts t JOIN words w USING (comment_id)
  WHERE w.token IN ('les', 'die') AND coalesce(t.sentiment, 'neutral') = 'negative'
    AND t.created_at >= (SELECT max(created_at) FROM texts) - INTERVAL 5 HOUR)
SELECT comment_id, "timestamp", sentiment, (SELECT count(*) FROM hits) AS total_found FROM hits
ORDER BY "timestamp" DESC, comment_id DESC LIMIT 20
""", "texts", "words"))
def search_tool(spark, folder):
    start = sc.moment(scored_texts(spark, folder), back=timedelta(hours=5))
    return search.indexed_page(spark, text_index(spark, folder), "les die", sentiment="negative", start=start)


@query("topic_details", with_views(f"""
WITH matches AS (
  SELECT comment_id, text, created_at, coalesce(sentiment, 'neutral') AS sentiment,
         CASE coalesce(sentiment, 'neutral') WHEN 'positive' THEN 0.7 WHEN 'negative' THEN -0.6 ELSE 0 END AS points
  FROM texts WHERE contains(lower(text), 'die')
    AND created_at >= (SELECT max(created_at) FROM texts) - INTERVAL 2 HOUR
  ORDER BY created_at DESC, comment_id DESC LIMIT 20),
previews AS (
  SELECT CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS p, created_at
  FROM matches ORDER BY created_at DESC, comment_id DESC LIMIT 5)
SELECT count(*) AS total_mentions, count(*) FILTER (WHERE sentiment = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
       {r("coalesce(avg(points), 0)", 3)} AS avg_sentiment,
       (SELECT string_agg(p, ' | ' ORDER BY created_at DESC) FROM previews) AS samples
FROM matches
""", "texts"))
def topic_details(spark, folder):
    matches = search.topic_matches(scored_texts(spark, folder), "die", timedelta(hours=2))
    return mt.topic_details(matches).withColumn("samples", F.array_join("samples", " | "))


@query("text_preview", """
SELECT doc_id AS comment_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview
FROM documents
""")
def text_preview(spark, folder):
    return tables.table(spark, folder, "documents").select(
        F.col("doc_id").alias("comment_id"), sc.preview("text").alias("preview"))


# --- backlog ----------------------------------------------------------------

@query("backlog", with_views("""
SELECT comment_id, text, created_at FROM texts WHERE NOT is_labeled AND predicted_at IS NULL
ORDER BY created_at DESC, comment_id DESC LIMIT 5
""", "texts"))
def backlog(spark, folder):
    return filters.next_to_label(tables.texts(spark, folder))


@query("backlog_due", with_views("""
SELECT count(*) FILTER (WHERE NOT is_labeled AND predicted_at IS NULL) AS waiting,
       count(*) FILTER (WHERE NOT is_labeled AND predicted_at IS NULL) >= 100 AS is_due FROM texts
""", "texts"))
def backlog_due(spark, folder):
    return filters.backlog_due(tables.texts(spark, folder))


@query("labeled_page", with_views("""
SELECT comment_id, program_id, predicted_at FROM texts WHERE is_labeled
ORDER BY predicted_at DESC, comment_id DESC LIMIT 50 OFFSET 20
""", "texts"))
def labeled_page(spark, folder):
    page = filters.labeled_page(tables.texts(spark, folder), limit=50, skip=20)
    return page.select("comment_id", "program_id", "predicted_at")


@query("comment_status", with_views("""
SELECT comment_id, is_labeled, CASE WHEN is_labeled THEN 'labeled' ELSE 'pending' END AS status FROM texts
""", "texts"))
def comment_status(spark, folder):
    texts = tables.texts(spark, folder).drop("is_labeled")
    return filters.with_status(texts).select("comment_id", "is_labeled", "status")


@query("label_counts", with_views("""
SELECT count(*) AS total, count(*) FILTER (WHERE is_labeled) AS labeled, count(*) FILTER (WHERE NOT is_labeled) AS unlabeled FROM texts
""", "texts"))
def label_counts(spark, folder):
    return mt.label_counts(tables.texts(spark, folder))


@query("video_counts", """
SELECT source AS video_id, count(*) AS "count", (SELECT count(*) FROM documents) AS total_comments
FROM documents GROUP BY 1 ORDER BY "count" DESC, video_id LIMIT 10
""")
def video_counts(spark, folder):
    return mt.video_counts(tables.timed_texts(spark, folder))


@query("comments_by_video_page", with_views("""
SELECT comment_id, video_id, created_at FROM texts
WHERE video_id = (SELECT min(source) FROM documents)
ORDER BY created_at DESC, comment_id DESC LIMIT 20 OFFSET 5
""", "texts"))
def comments_by_video_page(spark, folder):
    texts = tables.texts(spark, folder)
    first = tables.table(spark, folder, "documents").agg(F.min("source").alias("s")).scalar()
    return filters.comments_by_video(texts, first, limit=20, skip=5).select("comment_id", "video_id", "created_at")


@query("display_feed", with_views("""
SELECT comment_id AS id, predicted_at AS "timestamp", 'User (' || source || ')' AS username
FROM texts WHERE is_labeled ORDER BY predicted_at DESC, comment_id DESC LIMIT 50
""", "texts"))
def display_feed(spark, folder):
    return filters.display_feed(tables.texts(spark, folder)).select("id", "timestamp", "username")


# --- stored comments and predictions ----------------------------------------

@query("store_anti_insert", """
SELECT doc_id AS comment_id, lang AS program_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def store_anti_insert(spark, folder):
    stored = tables.table(spark, folder, "labels").select(F.col("doc_id").alias("comment_id"))
    return joins.not_stored(tables.timed_texts(spark, folder), stored).select("comment_id", "program_id")


@query("merge_predictions", with_views("""
WITH n AS (SELECT comment_id, count(*) AS c FROM quads GROUP BY 1)
SELECT comment_id,
       CAST(CASE WHEN is_labeled THEN 1 WHEN predicted_at IS NULL THEN coalesce(c, 0) END AS INTEGER) AS label_count,
       CASE WHEN NOT is_labeled AND predicted_at IS NULL THEN TIMESTAMP '2024-06-01 00:00:00'
            ELSE predicted_at END AS predicted_at
FROM texts LEFT JOIN n USING (comment_id)
""", "texts", "quads"))
def merge_predictions(spark, folder):
    """The backlog labeled by the lexicon and written back."""
    texts = tables.texts(spark, folder)
    predictions = labeling.with_lexicon_labels(filters.backlog(texts)).select("comment_id", "labels")
    merged = joins.merge_predictions(texts, predictions, stamp())
    return merged.select(
        "comment_id", F.when(F.col("labels").isNotNull(), F.size("labels")).alias("label_count"), "predicted_at")


# --- training rows ----------------------------------------------------------

def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labeled documents as training rows; the English ones have been used."""
    texts = filters.labeled(tables.texts(spark, folder))
    return texts.select(
        F.col("comment_id").alias("id"), "text", "labels", F.col("created_at").alias("consumed_at"),
        (F.col("program_id") == "en").alias("is_used_for_training"),
        F.when(F.col("program_id") == "en", F.col("predicted_at")).alias("used_at"),
    )


@query("training_page", with_views("""
SELECT comment_id AS id, created_at AS consumed_at FROM texts WHERE is_labeled AND program_id <> 'en'
ORDER BY created_at DESC, comment_id DESC LIMIT 100 OFFSET 10
""", "texts"))
def training_page(spark, folder):
    return filters.training_page(training_rows(spark, folder), limit=100, skip=10).select("id", "consumed_at")


@query("training_stats", with_views(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE program_id = 'en') AS used, count(*) FILTER (WHERE program_id <> 'en') AS unused,
       {r("count(*) FILTER (WHERE program_id = 'en') * 100.0 / count(*)", 2)} AS usage_rate
FROM texts WHERE is_labeled
""", "texts"))
def training_stats(spark, folder):
    return mt.training_stats(training_rows(spark, folder))


@query("mark_used", with_views("""
SELECT comment_id AS id, program_id = 'en' OR vi_sentiment = 'tích cực' AS is_used_for_training,
       CASE WHEN vi_sentiment = 'tích cực' THEN TIMESTAMP '2024-06-01 00:00:00'
            WHEN program_id = 'en' THEN predicted_at END AS used_at
FROM texts WHERE is_labeled
""", "texts"))
def mark_used(spark, folder):
    rows = training_rows(spark, folder)
    used = rows.filter(F.exists("labels", lambda q: q["sentiment"] == "tích cực")).select("id")
    return joins.mark_used(rows, used, stamp()).select("id", "is_used_for_training", "used_at")


@query("training_projection", with_views("""
SELECT text, vi_sentiment AS sentiment FROM texts WHERE is_labeled
""", "texts"))
def training_projection(spark, folder):
    return filters.training_projection(tables.texts(spark, folder)).select(
        "text", F.col("labels")[0]["sentiment"].alias("sentiment"))


@query("training_quadruples", with_views("""
SELECT comment_id, source AS entity, 'Khác' AS aspect, '' AS opinion, vi_sentiment AS sentiment
FROM texts WHERE is_labeled
""", "texts"))
def training_quadruples(spark, folder):
    rows = training.quadruples(tables.texts(spark, folder))
    return rows.select("comment_id", F.inline("quadruples"))


@query("quality_gate", with_views("""
SELECT count(*) AS samples, count(*) >= 100 AS passed FROM texts WHERE is_labeled
""", "texts"))
def quality_gate(spark, folder):
    return training.quality(filters.labeled(tables.texts(spark, folder)))


@query("split_counts", """
SELECT lang AS program_id, CASE WHEN doc_id % 100 < 80 THEN 'train' WHEN doc_id % 100 < 90 THEN 'val'
       ELSE 'test' END AS split, count(*) AS "count"
FROM documents GROUP BY 1, 2
""")
def split_counts(spark, folder):
    """Split shares with the row number as bucket, so that any engine agrees."""
    rows = tables.timed_texts(spark, folder)
    split = training.split_name(F.pmod("comment_id", F.lit(100))).alias("split")
    return rows.groupBy("program_id", split).agg(F.count("*").alias("count"))


# --- conversations ----------------------------------------------------------

def _sql_first_match(column: str, table, default: str) -> str:
    cases = []
    for name, words in table:
        test = " OR ".join(f"contains({column}, '{w}')" for w in words)
        cases.append(f"WHEN {test} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '{default}' END"


@query("chat_route", f"""
SELECT conv_id, turn, {_sql_first_match("lower(text)", rules.CHAT_ROUTES, rules.DEFAULT_ROUTE)} AS route
FROM conversations WHERE role = 'user'
""")
def chat_route(spark, folder):
    asked = tables.table(spark, folder, "conversations").filter(F.col("role") == "user")
    return asked.select("conv_id", "turn", rules.chat_route("text").alias("route"))


@query("question_intent", f"""
SELECT conv_id, turn, {_sql_first_match("lower(text)", rules.INTENTS, rules.DEFAULT_INTENT)} AS intent
FROM conversations WHERE role = 'user'
""")
def question_intent(spark, folder):
    asked = tables.table(spark, folder, "conversations").filter(F.col("role") == "user")
    return asked.select("conv_id", "turn", rules.intent("text").alias("intent"))


@query("tool_summary", f"""
SELECT role AS tool, count(*) AS calls, count(*) FILTER (WHERE length(text) <= 200) AS succeeded,
       {r("avg(length(text))", 4)} AS avg_duration_ms
FROM conversations GROUP BY 1
""")
def tool_summary(spark, folder):
    """Turns read as tool runs: the role is the tool, the length its duration."""
    runs = tables.table(spark, folder, "conversations").select(
        F.col("role").alias("tool"), (F.length("text") <= 200).alias("success"),
        F.length("text").cast("double").alias("duration_ms"))
    return rules.tool_summary(runs).withColumn("avg_duration_ms", sc.tidy("avg_duration_ms", 4))


@query("trace_steps", """
SELECT conv_id, turn, role AS step, trim(text) AS description FROM conversations
""")
def trace_steps(spark, folder):
    lines = tables.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("trace"))
    return rules.trace_steps(lines).drop("trace")


@query("fenced_answers", """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN NULL ELSE role END AS intent FROM conversations
""")
def fenced_answers(spark, folder):
    """Turns as answers with their role in fenced JSON; assistant turns answer
    without any."""
    fenced = F.concat(
        F.lit("Thinking.\n```json\n"), F.to_json(F.struct(F.col("role").alias("intent"))), F.lit("\n```\nDone."))
    answers = tables.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", F.lit("no answer")).otherwise(fenced).alias("answer"))
    parsed = rules.parse_answers(answers, "answer", "intent string")
    return parsed.select("conv_id", "turn", F.col("parsed.intent").alias("intent"))


@query("message_round_trip", """
SELECT doc_id AS id, text, lang AS program_id FROM documents WHERE n_chars >= 200
""")
def message_round_trip(spark, folder):
    """Documents as JSON messages and back; those of short texts are cut off and
    end up in quarantine."""
    rows = tables.table(spark, folder, "documents")
    sent = readers.as_messages(rows.select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("program_id"), "n_chars"))
    short = F.get_json_object("value", "$.n_chars").cast("long") < 200
    broken = F.expr("substring(value, 1, length(value) - 1)")
    wire = sent.select(F.when(short, broken).otherwise(F.col("value")).alias("value"))
    return readers.good(readers.parsed(wire, "id bigint, text string, program_id string"))
