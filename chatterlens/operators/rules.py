"""Keyword rules and report sentences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from chatterlens.functions import scalars as sc
from chatterlens.functions.labels import english_sentiment


@dataclass(frozen=True)
class Rule:
    """All groups must match; a group matches if any of its words occurs."""

    groups: tuple[tuple[str, ...], ...]
    confidence: float
    recommendation: str
    reasoning: str
    unless: tuple[str, ...] = ()

    def holds(self, text: Column) -> Column:
        condition = F.lit(True)
        for words in self.groups:
            condition = condition & _mentions(text, words)
        return condition & ~_mentions(text, self.unless) if self.unless else condition


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


# Keywords, confidences and texts of the recommendation rules.
RULES = (
    Rule((("eaos",), ("drop", "decrease"), ("negative",)), 0.85,
         "Investigate negative feedback immediately. Review recent comments to identify specific issues. Consider addressing concerns in next segment.",
         "Significant EAOS drop with negative sentiment indicates viewer dissatisfaction that needs immediate attention."),
    Rule((("eaos",), ("drop", "decrease")), 0.75,
         "Monitor EAOS trend closely. Prepare to pivot content if decline continues. Check for technical issues (audio/video quality).",
         "EAOS decline detected but cause unclear. Proactive monitoring recommended.",
         unless=("negative",)),
    Rule((("volume",), ("spike",)), 0.80,
         "High engagement detected. Extend or repeat this segment type. Capitalize on increased attention.",
         "Sudden volume increase indicates high viewer interest. Opportunity to maximize engagement."),
    Rule((("negative",), ("complaint", "issue")), 0.82,
         "Address viewer concerns directly. Consider on-air acknowledgment or social media response. Document feedback for post-show review.",
         "Multiple negative comments about specific issues require acknowledgment and resolution."),
    Rule((("trend", "popular"),), 0.78,
         "Leverage trending topic momentum. Feature this content more prominently. Prepare related content for next segment.",
         "Trending topics indicate strong viewer interest. Amplifying this content can boost engagement."),
    Rule((("audio", "sound", "video", "quality", "technical"),), 0.90,
         "Check technical setup immediately. Verify audio/video quality. Consider brief pause to fix if issues confirmed.",
         "Technical issues directly impact viewer experience and can quickly lose audience. Immediate action critical."),
    Rule((("anomaly", "unusual"),), 0.70,
         "Investigate anomaly cause. Compare with typical patterns. Check for external factors (competing content, technical issues).",
         "Unusual patterns detected. Understanding root cause important for appropriate response."),
    Rule((), 0.60,
         "Continue monitoring metrics. Current situation appears stable. Maintain current content strategy.",
         "No significant issues detected. Standard monitoring recommended."),
)

# Keywords of question intents and of chat answers, in order of precedence.
INTENTS = (
    ("investigation", ("why", "drop", "increase", "problem", "issue")),
    ("comparison", ("compare", "versus", "vs", "better")),
    ("recommendation", ("should", "recommend", "advice", "what to")),
)
DEFAULT_INTENT = "status_check"
CHAT_ROUTES = (
    ("summary", ("tổng quan", "summary", "tóm tắt")),
    ("sentiment", ("sentiment", "cảm xúc")),
    ("entity", ("entity", "thực thể")),
    ("aspect", ("aspect", "khía cạnh")),
    ("search", ("search", "tìm")),
    ("problem", ("problem", "vấn đề", "issue")),
)
DEFAULT_ROUTE = "help"


def recommend(contexts: DataFrame, text: str = "context") -> DataFrame:
    """The matching rule of highest confidence for each context (earlier rule on a tie)."""
    lowered = F.lower(F.col(text))
    best_first = sorted(RULES, key=lambda rule: -rule.confidence)
    choice = F.lit(None)
    for rule in reversed(best_first):
        advice = F.struct(
            F.lit(rule.recommendation).alias("recommendation"),
            F.lit(rule.confidence).alias("confidence"), F.lit(rule.reasoning).alias("reasoning"),
        )
        choice = F.when(rule.holds(lowered), advice).otherwise(choice)
    return contexts.withColumn("advice", choice).select(*contexts.columns, "advice.*")


def anomaly_context() -> Column:
    """A sentence about an anomaly row, to be matched against the rules."""
    below = F.col("metric_value") < F.col("expected_value")
    above = F.col("metric_value") > F.col("expected_value")
    kind = (
        F.when((F.col("metric") == "eaos") & below, F.concat(
            F.lit("EAOS drop"),
            F.when(F.col("severity") == "critical", " with negative comments").otherwise("")))
        .when((F.col("metric") == "volume") & above, "Volume spike")
        .when((F.col("metric") == "sentiment") & below, "Negative comments about an issue")
        .otherwise(F.concat(F.lit("Unusual "), "metric"))
    )
    return F.concat(kind, F.lit(" on "), "program_id")


def _first_match(text: Column, table, default: str) -> Column:
    choice = F.lit(default)
    for name, words in reversed(table):
        choice = F.when(_mentions(text, words), name).otherwise(choice)
    return choice


def intent(question: sc.Name) -> Column:
    return _first_match(F.lower(sc.as_col(question)), INTENTS, DEFAULT_INTENT)


def chat_route(message: sc.Name) -> Column:
    return _first_match(F.lower(sc.as_col(message)), CHAT_ROUTES, DEFAULT_ROUTE)


def search_phrase(message: sc.Name) -> Column:
    """What follows the last search keyword of a chat message."""
    text = sc.as_col(message)
    tail = F.element_at(F.split(text, "search"), -1)
    return F.trim(F.element_at(F.split(tail, "tìm"), -1))


def fenced_json(text: sc.Name) -> Column:
    """Content of the first fenced block (one marked json first), else the whole text."""
    body = sc.as_col(text)
    marked = F.regexp_extract(body, r"(?s)```json(.*?)(?:```|$)", 1)
    plain = F.regexp_extract(body, r"(?s)```(.*?)(?:```|$)", 1)
    return F.trim(
        F.when(body.contains("```json"), marked).when(body.contains("```"), plain).otherwise(body),
    )


def parse_answers(log: DataFrame, text: str, schema: str) -> DataFrame:
    """JSON held in free text, parsed; ``parsed`` is NULL where it is malformed."""
    return log.withColumn("parsed", F.from_json(fenced_json(text), schema, {"mode": "PERMISSIVE"}))


# --- report sentences -------------------------------------------------------

# The summary paragraph and the sentiment names in it.
SUMMARY = (
    "Tổng quan phân tích %d bình luận:\n\n"
    "Phân bố cảm xúc:\n"
    "tích cực: %.1f%%, tiêu cực: %.1f%%, trung lập: %.1f%%\n\n"
    "Thực thể được nhắc đến nhiều nhất: %s\n"
    "Số khía cạnh khác nhau: %d\n\n"
    "Nhìn chung, người xem đang có phản ứng %s với nội dung."
)
TONES = ("tích cực", "trung lập")


def summary_text(comments: DataFrame, by: str = "program_id") -> DataFrame:
    """One paragraph per program about the labels of its comments.

    Shares are taken over labels; the top entity is the most frequent one, by
    name on a tie. Label combinations are counted in one pass over the
    comments, everything else comes from that small table.
    """
    quads = comments.select(by, F.posexplode_outer("labels").alias("place", "q")).filter(F.col("q").isNotNull())
    combos = quads.groupBy(
        by, english_sentiment("q.sentiment").alias("sentiment"), "q.entity", "q.aspect",
    ).agg(F.count("*").alias("n"), F.count_if(F.col("place") == 0).alias("comments"))
    kinds = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("key"))
        for kind in ("sentiment", "entity", "aspect")
    ]))
    counts = combos.select(by, kinds.alias("item"), "n", "comments").groupBy(by, "item.kind", "item.key").agg(
        F.sum("n").alias("n"), F.sum("comments").alias("comments"))

    def total(measure: str, sentiment: str | None = None) -> Column:
        wanted = F.col("kind") == "sentiment"
        wanted = wanted & (F.col("key") == sentiment) if sentiment else wanted
        return F.coalesce(F.sum(F.when(wanted, F.col(measure))), F.lit(0))
    entity = F.when(F.col("kind") == "entity", F.struct((-F.col("n")).alias("n"), "key"))
    figures = counts.groupBy(by).agg(
        total("n").alias("labels"), total("comments").alias("comments"),
        *[total("n", s).alias(s) for s in ("positive", "negative", "neutral")],
        F.count_if(F.col("kind") == "aspect").alias("aspects"), F.min(entity).alias("best"),
    )
    share = [sc.tidy(sc.percent(s, "labels"), 1) for s in ("positive", "negative", "neutral")]
    tone = F.when(F.col("positive") > F.col("negative"), TONES[0]).otherwise(TONES[1])
    return figures.select(by, F.format_string(
        SUMMARY, "comments", *share, "best.key", "aspects", tone,
    ).alias("summary"))


# --- run logs ---------------------------------------------------------------

def tool_summary(runs: DataFrame) -> DataFrame:
    """Calls, successes and mean duration of each tool."""
    return runs.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_if("success").alias("succeeded"),
        F.avg("duration_ms").alias("avg_duration_ms"),
    )


def trace_steps(log: DataFrame, line: str = "trace") -> DataFrame:
    """``[step] description`` lines as columns; other lines drop out."""
    text = F.col(line)
    before = F.split(text, r"\]", 2)
    return log.filter(text.contains("]")).withColumns({
        "step": F.trim(F.replace(before[0], F.lit("["), F.lit(""))),
        "description": F.trim(before[1]),
    })


def step_counts(log: DataFrame, line: str = "trace") -> DataFrame:
    return trace_steps(log, line).groupBy("step").agg(F.count("*").alias("lines"))
