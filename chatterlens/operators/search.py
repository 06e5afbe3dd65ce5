"""Substring and full-text search, relevance, samples and topic lookup."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatterlens.functions import scalars as sc
from chatterlens.operators import filters
from chatterlens.sources import postings

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query, cut like the texts are."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def substring_matches(comments: DataFrame, query: str | None, start=None, end=None, **equal) -> DataFrame:
    found = filters.in_range(filters.equal_to(comments, **equal), start, end)
    return found.filter(sc.contains_folded("text", query)) if query else found


def substring_search(
    comments: DataFrame, query: str | None, start=None, end=None, limit: int = 100, **equal,
) -> DataFrame:
    """Case-insensitive substring hits, newest first."""
    return filters.newest(substring_matches(comments, query, start, end, **equal), limit)


def text_matches(comments: DataFrame, query: str) -> DataFrame:
    """Comments holding at least one query token; a query without any finds nothing."""
    terms = query_terms(query)
    return comments.filter(sc.has_token("text", terms)) if terms else comments.filter(F.lit(False))


def is_word(word: str):
    return lambda token: token == word


def _term_hits(df: DataFrame, terms: list[str], *keep: str) -> DataFrame:
    """Document length and the occurrences of query terms, texts cut up once."""
    words = df.select(*keep, sc.tokens("text").alias("words"))
    return words.select(
        *keep, F.size("words").alias("doc_length"),
        F.filter("words", lambda w: w.isin(terms)).alias("hits"),
    )


def with_relevance(comments: DataFrame, query: str, corpus: DataFrame | None = None) -> DataFrame:
    """Matching comments with their BM25 score against ``corpus`` (default: all
    of ``comments``). Corpus figures are one aggregated row, read back as a
    scalar subquery; no postings are shuffled."""
    terms = query_terms(query)
    if not terms:
        return comments.filter(F.lit(False)).withColumn("relevance", F.lit(0.0))
    stats = _term_hits(corpus if corpus is not None else comments, terms).agg(F.struct(
        F.count("*").alias("docs"), F.avg("doc_length").alias("avg_length"),
        *[F.count_if(F.array_contains("hits", t)).alias(f"df{i}") for i, t in enumerate(terms)],
    ).alias("stats")).scalar()

    found = _term_hits(text_matches(comments, query), terms, *comments.columns).withColumn("stats", stats)
    score = _bm25([F.size(F.filter("hits", is_word(t))) for t in terms])
    return found.withColumn("relevance", score).drop("doc_length", "hits", "stats")


def _bm25(frequencies: list[Column]) -> Column:
    """Score from each term's occurrences, ``doc_length`` and ``stats`` of the corpus."""
    length_norm = K1 * (1 - B + B * F.col("doc_length") / F.col("stats.avg_length"))
    score = F.lit(0.0)
    for i, tf in enumerate(frequencies):
        df = F.col(f"stats.df{i}")
        idf = F.log(1 + (F.col("stats.docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + length_norm)
    return score


# --- the same over a stored index --------------------------------------------

def indexed_hits(
    spark: SparkSession, path: str, query: str, keep: tuple[str, ...] = (), start=None, end=None, **equal,
) -> DataFrame:
    """Comments with at least one query term, one row each, from the postings of
    these terms: ``comment_id``, the kept columns named, ``doc_length`` and each
    term's occurrences (``tf0`` ...). Filters apply to the postings."""
    terms = query_terms(query)
    rows = filters.in_range(filters.equal_to(postings.hits(spark, path, terms or [""]), **equal), start, end)
    once = [F.max(c).alias(c) for c in (*keep, "doc_length")]
    counts = [F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    return rows.groupBy("comment_id").agg(*once, *counts)


def indexed_relevance(spark: SparkSession, path: str, query: str, hits: DataFrame) -> DataFrame:
    """Rows of :func:`indexed_hits` with their BM25 score against the whole index."""
    terms = query_terms(query)
    scored = hits.withColumn("stats", postings.corpus(spark, path, terms)) if terms else hits.filter(F.lit(False))
    score = _bm25([F.col(f"tf{i}") for i in range(len(terms))]) if terms else F.lit(0.0)
    return scored.withColumn("relevance", score).drop("doc_length", "stats", *[f"tf{i}" for i in range(len(terms))])


def indexed_search(
    spark: SparkSession, path: str, query: str, keep: tuple[str, ...] = ("timestamp",), size: int | None = 100,
    start=None, end=None, **equal,
) -> DataFrame:
    """:func:`text_search` from the index: the newest ``size`` hits (None: all) with relevance."""
    found = indexed_hits(spark, path, query, keep, start, end, **equal)
    page = found if size is None else filters.newest(found, size)
    return indexed_relevance(spark, path, query, page)


def indexed_page(
    spark: SparkSession, path: str, query: str, sentiment: str | None = None, limit: int = 20,
    keep: tuple[str, ...] = ("timestamp", "sentiment"), start=None, end=None,
) -> DataFrame:
    """:func:`search_page` from the index: kept columns and the true number of hits."""
    found = indexed_hits(spark, path, query, keep, start, end, sentiment=sentiment)
    total = found.agg(F.count("*").alias("total")).scalar()
    return filters.newest(found, limit).select("comment_id", *keep, total.alias("total_found"))


def with_comments(page: DataFrame, comments: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """A page's rows with columns of their comments; the page, which is bounded
    by its limit, is sent to the scan of the comments."""
    wanted = comments.select("comment_id", *columns)
    return wanted.join(F.broadcast(page), "comment_id")


def text_search(
    comments: DataFrame, query: str, topics: list[str] | None = None, start=None, end=None,
    size: int = 100, **equal,
) -> DataFrame:
    """Full-text hits with relevance, newest first. Relevance counts the whole
    corpus; filters only choose which hits are returned, and only those are
    scored."""
    kept = filters.any_of(filters.equal_to(comments, **equal), "topics", topics)
    page = filters.newest(text_matches(filters.in_range(kept, start, end), query), size)
    return with_relevance(page, query, comments)


def search_page(
    comments: DataFrame, query: str, time_range: str | None = None, sentiment: str | None = None,
    limit: int = 20, as_of=None,
) -> DataFrame:
    """Result rows of the search tool with the true number of hits on each row."""
    hits = filters.equal_to(text_matches(comments, query), sentiment=sentiment)
    if time_range is not None:
        start = sc.moment(comments, as_of, sc.range_span(time_range, 60))
        hits = filters.in_range(hits, start, sc.moment(comments, as_of))
    total = hits.agg(F.count("*").alias("total")).scalar()
    return filters.newest(hits, limit).select(
        "comment_id", "text", "timestamp", "sentiment",
        F.coalesce("engagement_score", F.lit(0.0)).alias("engagement_score"), "username",
        total.alias("total_found"),
    )


def sample_comments(
    comments: DataFrame, entity: str | None = None, sentiment: str | None = None, size: int = 10,
) -> DataFrame:
    kept = filters.equal_to(comments, sentiment=sentiment)
    return filters.newest(filters.any_of(kept, "topics", [entity] if entity else None), size)


def topic_search(
    trends: DataFrame, topic: str | None = None, time_window: int | None = None,
    min_mentions: int = 0, size: int = 20,
) -> DataFrame:
    """Topics by exact name, window and least mentions, most mentioned first."""
    kept = filters.equal_to(trends, topic=topic, time_window_minutes=time_window)
    kept = kept.filter(F.col("mention_count") >= min_mentions) if min_mentions > 0 else kept
    return kept.orderBy(F.col("mention_count").desc(), "topic", "timestamp").limit(size)


def topic_matches(comments: DataFrame, topic: str, back: timedelta, as_of=None, limit: int = 20) -> DataFrame:
    """The newest comments of a trailing window whose text names the topic."""
    recent = filters.trailing(comments, back, as_of)
    return substring_search(recent, topic, limit=limit)
