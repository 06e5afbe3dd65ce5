"""Declared schemas, allowed values and label vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, I, B, TS = (
    T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LABEL = _struct(entity=S, aspect=S, opinion=S, sentiment=S, confidence=D)
LABELS = T.ArrayType(LABEL)

COMMENT = _struct(
    comment_id=S, program_id=S, video_id=S, text=S, username=S, timestamp=TS, sentiment=S,
    sentiment_score=D, engagement_score=D, topics=T.ArrayType(S), metadata=T.MapType(S, S),
    source=S, created_at=TS, labels=LABELS, predicted_at=TS,
)
TRAINING_ROW = _struct(
    id=S, text=S, labels=LABELS, consumed_at=TS, is_used_for_training=B, used_at=TS,
)
SOURCE_ENTRY = _struct(text=S, labels=LABELS)
SOURCE_FILE = _struct(results=T.ArrayType(SOURCE_ENTRY))
STREAM_MESSAGE = _struct(id=S, text=S, video_id=S, program_id=S, timestamp=TS)

METRIC = _struct(
    program_id=S, timestamp=TS, score=D, positive_count=L, negative_count=L, neutral_count=L,
    total_comments=L,
)
TOPIC_AGGREGATE = _struct(program_id=S, timestamp=TS, topic=S, count=L, avg_sentiment=D)
ANOMALY = _struct(
    program_id=S, timestamp=TS, metric=S, value=D, expected=D, deviation=D, severity=S,
)
TREND = _struct(
    topic=S, timestamp=TS, mention_count=L, time_window_minutes=I, avg_sentiment=D,
    related_entities=T.ArrayType(S),
)
PROGRAM_EVENT = _struct(
    timestamp=TS, event_type=S, description=S, metadata=T.MapType(S, S),
)

# Enumerations, vocabularies and constants of the data model.
SENTIMENTS = ("positive", "negative", "neutral")
METRICS = ("eaos", "volume", "sentiment")
SEVERITIES = ("low", "medium", "high", "critical")
DIRECTIONS = ("rising", "falling", "stable", "spike")
RANGE_MINUTES = {"5min": 5, "15min": 15, "1hour": 60}
GRANULARITY_MINUTES = {"minute": 1, "5min": 5, "segment": 15}
SENTIMENT_SCORES = {"positive": 0.7, "negative": -0.6, "neutral": 0.0}
SENTIMENT_NAMES = {
    "tích cực": "positive",
    "tiêu cực": "negative",
    "trung lập": "neutral",
    "trung tính": "neutral",
}
SENTIMENT_IDS = {"trung tính": 0, "tích cực": 1, "tiêu cực": 2}
ASPECT_IDS = {
    "Khác": 0,
    "Địa điểm": 1,
    "Kịch bản": 2,
    "Dàn dựng": 3,
    "Dàn cast": 4,
    "Khách mời": 5,
    "Khả năng chơi trò chơi": 6,
    "Quảng cáo": 7,
    "Thử thách": 8,
    "Tương tác giữa các thành viên": 9,
    "Tinh thần đồng đội": 10,
}
SENTIMENT_WEIGHT = 0.6
ENGAGEMENT_WEIGHT = 0.4
MAX_QUADS = 4
RETENTION_DAYS = {"comments": 90, "metrics": 30, "trends": 7, "anomalies": 7, "events": 7}
CURRENT_SCORE_TTL_SECONDS = 3600
