"""Functions over the label array of a comment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chatterlens import schemas
from chatterlens.functions.scalars import Name, as_col, lookup, phrase_start, span_from


def has_labels(labels: Name) -> Column:
    return F.coalesce(F.size(as_col(labels)) > 0, F.lit(False))


def needs_labeling(labels: Name = "labels", predicted_at: Name = "predicted_at") -> Column:
    """No labels and not attempted before."""
    return ~has_labels(labels) & as_col(predicted_at).isNull()


def english_sentiment(sentiment: Name) -> Column:
    """Either neutral spelling, and anything unknown, becomes neutral."""
    known = {**schemas.SENTIMENT_NAMES, **{s: s for s in schemas.SENTIMENTS}}
    return lookup(F.lower(F.trim(as_col(sentiment))), known, "neutral")


def sentiment_id(sentiment: Name) -> Column:
    ids = {**schemas.SENTIMENT_IDS, "trung lập": schemas.SENTIMENT_IDS["trung tính"]}
    return lookup(sentiment, ids, 0)


def aspect_id(aspect: Name) -> Column:
    return lookup(aspect, schemas.ASPECT_IDS, 0)


def aspect_name(number: Name) -> Column:
    return lookup(number, {v: k for k, v in schemas.ASPECT_IDS.items()}, "Khác")


def sentiment_name(number: Name) -> Column:
    return lookup(number, {v: k for k, v in schemas.SENTIMENT_IDS.items()}, "trung tính")


def normalise_labels(labels: Name) -> Column:
    return F.transform(
        as_col(labels), lambda q: q.withField("sentiment", english_sentiment(q["sentiment"]))
    )


def majority_sentiment(labels: Name) -> Column:
    """Positive or negative by majority of labels; a tie or no label is neutral."""
    names = F.transform(as_col(labels), lambda q: english_sentiment(q["sentiment"]))
    balance = F.aggregate(
        names, F.lit(0),
        lambda acc, s: acc + F.when(s == "positive", 1).when(s == "negative", -1).otherwise(0),
    )
    return F.when(balance > 0, "positive").when(balance < 0, "negative").otherwise("neutral")


def sentiment_points(sentiment: Name) -> Column:
    return lookup(sentiment, schemas.SENTIMENT_SCORES, 0.0)


def topics_of(labels: Name, fallback: str = "general") -> Column:
    """Distinct non-empty entities, or the fallback topic when there are none."""
    names = F.array_distinct(F.filter(
        F.transform(as_col(labels), lambda q: q["entity"]), lambda e: e.isNotNull() & (e != "")
    ))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(fallback)))


def align(labels: Name, text: Name, folded: Name | None = None) -> Column:
    """Attach entity and opinion spans; drop labels whose phrases are not in the text.

    Works in stages, so that each phrase is searched once. ``folded`` is the
    lower-cased text when the caller has it as a column.
    """
    low = as_col(folded) if folded is not None else F.lower(as_col(text))
    placed = F.transform(as_col(labels), lambda q: F.struct(
        q.alias("label"), phrase_start(low, q["entity"]).alias("e"),
        phrase_start(low, q["opinion"]).alias("o"),
    ))
    found = F.filter(placed, lambda p: (p["e"] >= -1) & (p["o"] >= -1))
    return F.transform(found, lambda p: F.struct(
        p["label"]["entity"].alias("entity"), span_from(p["e"], p["label"]["entity"]).alias("entity_span"),
        p["label"]["aspect"].alias("aspect"),
        p["label"]["opinion"].alias("opinion"), span_from(p["o"], p["label"]["opinion"]).alias("opinion_span"),
        p["label"]["sentiment"].alias("sentiment"),
    ))


def training_quadruples(labels: Name) -> Column:
    fields = ("entity", "aspect", "opinion", "sentiment")
    return F.transform(as_col(labels), lambda q: F.struct(
        *[F.coalesce(q[f], F.lit("")).alias(f) for f in fields]
    ))


def _words(text: Column) -> Column:
    """Number of whitespace-separated words; leading whitespace is no word."""
    return F.size(F.split(text, r"\s+")) - text.rlike(r"^\s").cast("int")


def _edges(text: Column, span: Column) -> Column:
    """First and last word of a character span, unchecked, plus whether the span
    starts and ends inside words."""
    start, end = span["start"], span["end"]
    part = F.substr(text, start + 1, end - start)
    return F.when(start >= 0, F.struct(
        _words(F.substr(text, F.lit(1), start + 1)).alias("first"), _words(part).alias("words"),
        (~part.rlike(r"^\s")).alias("starts"), (~part.rlike(r"\s$")).alias("ends"),
    ))


def _word_span(edges: Column, max_tokens: int | None) -> tuple[Column, Column]:
    """1-based word numbers of a span. 0 stands for "implicit", "starts between
    words" or beyond the model's positions; a last word that has no number is
    the first word."""
    within = lambda word: F.lit(True) if max_tokens is None else word < max_tokens
    usable = edges.isNotNull() & edges["starts"] & within(edges["first"])
    first = F.when(usable, edges["first"]).otherwise(0)
    last = edges["first"] + edges["words"] - 1
    return first, F.when(usable, F.when(edges["ends"] & within(last), last).otherwise(first)).otherwise(0)


def target_matrix(
    aligned: Name, text: Name, max_quads: int = schemas.MAX_QUADS,
    max_tokens: int | None = None,
) -> Column:
    """First ``max_quads`` aligned labels as rows of six numbers, padded with -1
    rows. ``max_tokens`` is the number of positions of a model that has only so many."""
    body = as_col(text)
    measured = F.transform(F.slice(as_col(aligned), 1, max_quads), lambda q: F.struct(
        _edges(body, q["entity_span"]).alias("e"), _edges(body, q["opinion_span"]).alias("o"),
        aspect_id(q["aspect"]).alias("aspect"), sentiment_id(q["sentiment"]).alias("sentiment"),
    ))
    rows = F.transform(measured, lambda m: F.array(
        *_word_span(m["e"], max_tokens), *_word_span(m["o"], max_tokens), m["aspect"], m["sentiment"]))
    pad = F.array_repeat(F.array_repeat(F.lit(-1), 6), max_quads)
    return F.slice(F.concat(rows, pad), 1, max_quads)
