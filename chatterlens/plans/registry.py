"""Register of named queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return register


def r(expression: str, digits: int) -> str:
    """SQL for rounding half up on the decimal value, as Spark rounds."""
    return f"CAST(round(CAST({expression} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def score(sentiment: str, engagement: str) -> str:
    return f"greatest(0, least(1, 0.6 * ({sentiment} + 1) / 2 + 0.4 * {engagement} / 100))"


VIEWS = {
    "comments": """
  SELECT event_id AS comment_id, 'show_' || (user_id % 10) AS program_id,
         'user_' || user_id AS username, ts AS "timestamp",
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive'
              WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment,
         CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN 0.7
                   WHEN event_type = 'error' THEN -0.6 ELSE 0.0 END AS DOUBLE) AS sentiment_score,
         least(value, 100.0) AS engagement_score,
         ['et_' || event_type, 'k_' || (CAST(json_extract(props, '$.k') AS INT) % 20)] AS topics
  FROM events""",
    "metrics": f"""
  SELECT program_id, date_trunc('hour', "timestamp") AS window_start,
         count(*) AS total_comments,
         count(*) FILTER (WHERE sentiment = 'positive') AS positive_count,
         count(*) FILTER (WHERE sentiment = 'negative') AS negative_count,
         count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_count,
         avg(sentiment_score) AS avg_sentiment, avg(engagement_score) AS avg_engagement,
         {score("avg(sentiment_score)", "avg(engagement_score)")} AS score
  FROM comments GROUP BY 1, 2""",
    "texts": """
  SELECT d.doc_id AS comment_id, d.lang AS program_id, d.source AS video_id, d.text, d.source,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS created_at,
         l.doc_id IS NOT NULL AS is_labeled,
         CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'tiêu cực'
              WHEN l.quality = 1 THEN 'tích cực' ELSE 'trung lập' END AS vi_sentiment,
         CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'negative'
              WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
         CASE WHEN l.doc_id IS NOT NULL OR d.n_chars < 200
              THEN TIMESTAMP '2024-01-01 01:00:00' + to_minutes(d.doc_id) END AS predicted_at
  FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "timed": """
  SELECT doc_id AS comment_id, lang AS program_id, source AS video_id, text,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS "timestamp"
  FROM documents""",
    "logits": """
  SELECT vec_id, label, e[1:11] AS aspect, e[12:14] AS sentiment, e[15:26] AS e_start,
         e[27:38] AS e_end, e[39:50] AS o_start, e[51:62] AS o_end
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""",
    "heads": """
  SELECT vec_id, label,
         CAST(list_position(aspect, list_max(aspect)) - 1 AS INTEGER) AS aspect_id,
         CAST(list_position(sentiment, list_max(sentiment)) - 1 AS INTEGER) AS sentiment_id,
         CAST(list_position(e_start, list_max(e_start)) - 1 AS INTEGER) AS es,
         CAST(list_position(e_end, list_max(e_end)) - 1 AS INTEGER) AS ee,
         CAST(list_position(o_start, list_max(o_start)) - 1 AS INTEGER) AS os,
         CAST(list_position(o_end, list_max(o_end)) - 1 AS INTEGER) AS oe,
         (1 / list_sum(list_transform(aspect, lambda v: exp(v - list_max(aspect))))
          + 1 / list_sum(list_transform(sentiment, lambda v: exp(v - list_max(sentiment))))) / 2 AS confidence
  FROM logits""",
    "lexicon": """
  SELECT * FROM (VALUES
    ('the', 'host', 'Dàn cast', 'the', 'tích cực'), ('and', 'show', 'Kịch bản', 'and', 'tiêu cực'),
    ('und', 'host', 'Dàn dựng', 'und', 'tiêu cực'), ('die', 'guest', 'Khách mời', 'die', 'tích cực'),
    ('pour', 'show', 'Kịch bản', 'pour', 'trung tính'), ('les', 'guest', 'Khách mời', 'les', 'tích cực'),
    ('que', 'venue', 'Địa điểm', 'que', 'trung lập'), ('para', 'ads', 'Quảng cáo', 'para', 'tiêu cực')
  ) AS lex(phrase, entity, aspect, opinion, vi_sentiment)""",
    "words": """
  SELECT doc_id AS comment_id, lang AS program_id, w.token
  FROM documents, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w(token)
  WHERE w.token <> ''""",
    "quads": """
  SELECT comment_id, program_id, phrase, entity, aspect, opinion, vi_sentiment,
         CASE vi_sentiment WHEN 'tích cực' THEN 'positive' WHEN 'tiêu cực' THEN 'negative'
              ELSE 'neutral' END AS sentiment
  FROM (SELECT DISTINCT comment_id, program_id, token FROM words) JOIN lexicon ON token = phrase""",
}
NEEDS = {
    "metrics": ("comments",), "heads": ("logits",), "quads": ("lexicon", "words"),
}


def with_views(body: str, *views: str) -> str:
    """The query with the named views, and those they need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in order:
            order.append(name)
    for name in views:
        add(name)
    ctes = [f"{name} AS ({VIEWS[name]})" for name in order]
    text = body.strip()
    if text.upper().startswith("WITH "):
        text = text[5:]
        return "WITH " + ",\n".join([*ctes, text])
    return "WITH " + ",\n".join(ctes) + "\n" + text
