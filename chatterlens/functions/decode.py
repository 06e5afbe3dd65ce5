"""Turning the six prediction heads of a labeling model into quadruples."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chatterlens.functions.labels import aspect_name, sentiment_name
from chatterlens.functions.scalars import Name, as_col


def argmax(values: Name) -> Column:
    """0-based position of the first maximum."""
    x = as_col(values)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def top_probability(values: Name) -> Column:
    """Softmax probability of the largest entry: 1 / sum(exp(x - max))."""
    x = as_col(values)
    return 1 / F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max(x)))


def confidence(aspect: Name, sentiment: Name) -> Column:
    return (top_probability(aspect) + top_probability(sentiment)) / 2


def span_text(tokens: Name, first: Column, last: Column) -> Column:
    words = F.slice(as_col(tokens), first + 1, last - first + 1)
    return F.trim(F.replace(F.array_join(words, " "), F.lit("_"), F.lit(" ")))


def decode(
    aspect: Name, sentiment: Name, e_start: Name, e_end: Name, o_start: Name, o_end: Name,
    threshold: float = 0.3, tokens: Name | None = None, length: Name | None = None,
) -> Column:
    """One slot as a quadruple, or NULL when its spans or confidence rule it out.

    ``tokens`` adds phrase texts (and drops empty ones); ``length`` bounds the
    span starts when no tokens are given.
    """
    es, ee, os, oe = (argmax(h) for h in (e_start, e_end, o_start, o_end))
    sure = confidence(aspect, sentiment)
    valid = (es <= ee) & (os <= oe) & (es != 0) & (ee != 0) & (sure >= threshold)
    size = F.size(as_col(tokens)) if tokens is not None else (as_col(length) if length is not None else None)
    if size is not None:
        valid = valid & (es < size) & (os < size)
    fields = [
        aspect_name(argmax(aspect)).alias("aspect"),
        sentiment_name(argmax(sentiment)).alias("sentiment"),
        F.round(sure, 3).alias("confidence"),
        es.alias("e_start"), ee.alias("e_end"), os.alias("o_start"), oe.alias("o_end"),
    ]
    if tokens is None:
        return F.when(valid, F.struct(*fields))
    entity, opinion = span_text(tokens, es, ee), span_text(tokens, os, oe)
    fields = [entity.alias("entity"), opinion.alias("opinion"), *fields]
    return F.when(valid & (entity != "") & (opinion != ""), F.struct(*fields))


def decode_slots(slots: Name, threshold: float = 0.3, tokens: Name | None = None) -> Column:
    """All slots of a comment (array of head structs) as an array of quadruples."""
    quads = F.transform(as_col(slots), lambda s: decode(
        s["aspect"], s["sentiment"], s["e_start"], s["e_end"], s["o_start"], s["o_end"],
        threshold, tokens,
    ))
    return F.filter(quads, lambda q: q.isNotNull())
