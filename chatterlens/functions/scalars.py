"""Scalar rules: time, scores, percentages, buckets, text and fingerprints."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from chatterlens import schemas

Name = str | Column


def as_col(value: Name) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def each(df: DataFrame, items: Name, name: str, *keep: str) -> DataFrame:
    """One row per element of a costly array expression.

    The outer generator matters: from an inner one Catalyst infers a size
    filter, pushes it below the projection and so evaluates the array twice.
    """
    return df.select(*keep, F.explode_outer(as_col(items)).alias(name)).filter(F.col(name).isNotNull())


def where_found(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows for which a costly expression is not NULL, with its value; evaluated
    once, where a plain filter would be pushed down as a second copy."""
    return each(df, F.array(value), name, *[c for c in df.columns if c != name])


def tidy(value: Name, digits: int) -> Column:
    """Round for reporting; the inner rounding absorbs summation-order noise."""
    return F.round(F.round(as_col(value), 10), digits)


# --- time -------------------------------------------------------------------

def window_start(ts: Name, width: str) -> Column:
    """Start of the tumbling, epoch-aligned, half-open window holding ``ts``."""
    return F.window(as_col(ts), width)["start"]


def moment(
    df: DataFrame, as_of: datetime | Column | None = None, back: timedelta | None = None,
    ts: str = "timestamp",
) -> Column:
    """``as_of - back``; ``as_of`` defaults to the newest time in ``df``.

    The default is a scalar subquery holding the final bound, so a comparison
    with a stored column still reaches the scan as a plain value.
    """
    if as_of is None:
        newest = F.max(ts)
        return df.agg((newest - F.lit(back) if back else newest).alias("moment")).scalar()
    fixed = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return fixed - F.lit(back) if back else fixed


def lookup(key: Name, table: Mapping, default=None) -> Column:
    """Map lookup with a default on a miss."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    hit = F.create_map(*pairs)[as_col(key)]
    return hit if default is None else F.coalesce(hit, F.lit(default))


def range_span(label: str | None, default_minutes: int = 15) -> timedelta:
    return timedelta(minutes=schemas.RANGE_MINUTES.get(label, default_minutes))


def granularity_width(label: str | None) -> str:
    return f"{schemas.GRANULARITY_MINUTES.get(label, 5)} minutes"


def month_key(ts: Name) -> Column:
    return F.date_format(as_col(ts), "yyyyMM")


def parse_time(text: Name) -> Column:
    return F.try_to_timestamp(as_col(text))


# --- numbers ----------------------------------------------------------------

def ratio(part: Name, whole: Name) -> Column:
    """Division that yields 0 for an empty whole."""
    return F.when(as_col(whole) != 0, as_col(part) / as_col(whole)).otherwise(F.lit(0.0))


def percent(part: Name, whole: Name) -> Column:
    return ratio(part, whole) * 100


def clamp(value: Name, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), as_col(value)))


def engagement_adjusted_score(avg_sentiment: Name, avg_engagement: Name) -> Column:
    """Weighted mean of rescaled sentiment (-1..1) and engagement (0..100), in 0..1."""
    return clamp(
        schemas.SENTIMENT_WEIGHT * (as_col(avg_sentiment) + 1) / 2
        + schemas.ENGAGEMENT_WEIGHT * as_col(avg_engagement) / 100
    )


def deviation_pct(metric: str, value: Name, mean: Name) -> Column:
    x, m = as_col(value), as_col(mean)
    if metric == "sentiment":
        return F.abs(x - m) / (F.abs(m) + 0.01) * 100
    return F.when(m != 0, (x - m) / m * 100).otherwise(F.lit(0.0))


# --- buckets ----------------------------------------------------------------

def trend_direction(current: Name, previous: Name, threshold: float = 1.5) -> Column:
    cur, prev = as_col(current), as_col(previous)
    change = cur / prev
    return (
        F.when(prev == 0, F.when(cur > 10, "spike").otherwise("rising"))
        .when(change >= 2 * threshold, "spike")
        .when(change >= threshold, "rising")
        .when(change <= 1 / threshold, "falling")
        .otherwise("stable")
    )


def severity(pct: Name) -> Column:
    size = F.abs(as_col(pct))
    return (
        F.when(size >= 50, "critical").when(size >= 30, "high")
        .when(size >= 15, "medium").otherwise("low")
    )


def tone(avg_sentiment: Name) -> Column:
    avg = as_col(avg_sentiment)
    return F.when(avg > 0.2, "positive").when(avg < -0.2, "negative").otherwise("neutral")


# --- text -------------------------------------------------------------------

def preview(text: Name, length: int = 100) -> Column:
    body = as_col(text)
    return F.when(
        F.length(body) > length, F.concat(F.substring(body, 1, length), F.lit("..."))
    ).otherwise(body)


def capitalise(text: Name) -> Column:
    body = as_col(text)
    return F.concat(F.upper(F.substring(body, 1, 1)), F.lower(F.substr(body, F.lit(2))))


def tokens(text: Name) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(as_col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def has_token(text: Name, words: list[str]) -> Column:
    """Whether any of the given lower-case words occurs as a token. Stops at the
    first hit, so it is much cheaper than cutting the text up."""
    letter = r"[\p{L}\p{N}]"
    return F.lower(as_col(text)).rlike(rf"(?<!{letter})(?:{'|'.join(words)})(?!{letter})")


def contains_folded(text: Name, needle: str) -> Column:
    return F.lower(as_col(text)).contains(F.lower(F.lit(needle)))


def phrase_start(folded: Column, phrase: Name) -> Column:
    """0-based start of a phrase in a lower-cased text; -1 for an implicit phrase
    (empty or 'null'), -2 when it does not occur."""
    wanted = F.lower(as_col(phrase))
    implicit = wanted.isNull() | wanted.isin("", "null")
    return F.when(implicit, -1).otherwise(
        F.coalesce(F.nullif(F.instr(folded, wanted), F.lit(0)) - 1, F.lit(-2)))


def span_from(start: Column, phrase: Name) -> Column:
    """(start, end) for a position given by :func:`phrase_start`."""
    end = F.when(start >= 0, start + F.length(as_col(phrase))).otherwise(start)
    return F.when(start >= -1, F.struct(start.alias("start"), end.alias("end")))


def find_span(text: Name, phrase: Name) -> Column:
    """(start, end) of the first case-insensitive hit; (-1, -1) when the phrase
    is empty or 'null'; NULL when it does not occur."""
    return span_from(phrase_start(F.lower(as_col(text)), phrase), phrase)


def fingerprint(prefix: str, *columns: Name) -> Column:
    """Stable key of a request: md5 over its JSON-encoded arguments."""
    digest = F.md5(F.concat(F.lit(f"{prefix}:"), F.to_json(F.struct(*[as_col(c) for c in columns]))))
    return F.concat(F.lit(f"cache:{prefix}:"), digest)
