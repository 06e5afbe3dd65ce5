"""Phrases whose words keep together, mined in partitions (the SON scheme).

A shard is a bounded run of texts of one language. It is mined completely, by
exact local word numbers, at the support that falls to its share of the
language's words: a phrase that reaches the support globally reaches this in at
least one shard. What the shards find is united, and the candidates are counted
globally: the shards that found one have sent its count, the others, which
hold it too seldom, send theirs in a second pass. A share below one asks for
every phrase, and nothing is left for the second pass.

Shards send packets of phrases and counts, one per bucket of a hash of the
phrase, compressed; the number of buckets grows with the words, so that the
reducers stay small. A phrase has one entry per shard, however often it occurs.

Odd input: null and empty texts have no words, a null lang is ``und``. Repeated
rows count each. A text longer than a shard is cut between pieces. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.llm import textbits
from chatterlens.session import settled

#: Bytes of text in a shard, words in a bucket, languages whose shares are known
#: to the shards (in others every local count passes, which loses nothing).
SHARD = 8_000_000
BUCKET = 1_500_000
KNOWN = 10_000
#: Copies of the counts of single words, by which frequent words are split in joins.
SALTS = 8

PIECE_END = np.zeros(256, dtype=bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~PIECE_END
INSIDE[[0x20, 0x09]] = False
END = re.compile(rb"[.,;:!?\x0A-\x0D]")
PACKETS = "bucket bigint, lang string, words int, frequent boolean, phrases binary, lengths binary, counts binary"
FOUND = "bucket bigint, lang string, words int, phrase string, f bigint"


# --- inside a shard ---------------------------------------------------------

def shards(texts: list[bytes], most: int = SHARD) -> Iterator[list[bytes]]:
    """Runs of at most ``most`` bytes; a longer text is cut after the end of a piece."""
    run, size = [], 0
    for text in texts:
        at = 0
        while at < len(text) or not text:
            rest = text[at:] if at else text
            if len(rest) > most:
                ends = END.search(rest, most - 1)
                rest = rest[: ends.end()] if ends else rest
            at += len(rest)
            if run and size + len(rest) > most:
                yield run
                run, size = [], 0
            run.append(rest)
            size += len(rest) + 1
            if not text:
                break
    if run:
        yield run


class Shard:
    """Words of a run of texts, numbered, and which of them follow each other."""

    def __init__(self, texts: list[bytes]):
        buf, _ = textbits.joined(texts, b"\n")
        buf = textbits.LOWER[buf]
        inside = INSIDE[buf]
        step = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        ends = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(PIECE_END[buf], out=ends[1:])
        self.codes, self.dictionary = textbits.encoded(buf, inside, begin, end)
        self.next_is_near = ends[begin[1:]] == ends[end[:-1]]

    def counted(self) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """Distinct phrases of one, two and three words, as a list of word
        numbers by position, and their counts."""
        codes, width = self.codes, max(len(self.dictionary), 1)
        yield 1, [np.arange(len(self.dictionary))], np.bincount(codes, minlength=len(self.dictionary))
        at = np.flatnonzero(self.next_is_near)
        pair, own, counts = np.unique(codes[at] * width + codes[at + 1], return_inverse=True, return_counts=True)
        yield 2, [pair // width, pair % width], counts
        place = np.full(len(codes), -1, dtype=np.int64)
        place[at] = own
        at = at[:-1][at[1:] == at[:-1] + 1]
        triple, counts = np.unique(place[at] * width + codes[at + 2], return_counts=True)
        first = pair[triple // width]
        yield 3, [first // width, first % width, triple % width], counts


def _packets(shard: Shard, lang: str, buckets: int, least: int, second: bool) -> Iterator[tuple]:
    """The phrases of at least (second pass: below) the local support, by bucket."""
    press = zstandard.ZstdCompressor(level=1).compress
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in shard.dictionary.to_pylist()], dtype=np.uint64)
    for words, places, counts in shard.counted():
        chosen = np.flatnonzero(counts < least if second else counts >= least)
        if not len(chosen):
            continue
        places, counts = [p[chosen] for p in places], counts[chosen]
        mixed = np.zeros(len(chosen), dtype=np.uint64)
        for p in places:
            mixed = textbits.mix(mixed * np.uint64(31) + hashes[p])
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        parts = [shard.dictionary.take(pa.array(p[order])) for p in places]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if words > 1 else parts[0]
        counts = counts[order].astype("<u4")
        for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)]):
            yield (int(bucket[order[a]]), lang, words, not second, *textbits.pressed(joined.slice(a, b - a)), press(counts[a:b].tobytes()))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The shards of a batch, each of one language."""
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
        groups.setdefault(lang, []).append(text)
    for lang in list(groups):
        for run in shards(groups.pop(lang)):
            yield lang, run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(lang, len(Shard(run).codes)) for lang, run in _by_lang(batch)]
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([x[0] for x in found], pa.string()), "n": pa.array([x[1] for x in found], pa.int64())})


def miner(support: int, known: dict[str, int], buckets: int, second: bool):
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        names = [f.split()[0] for f in PACKETS.split(", ")]
        for batch in batches:
            for lang, run in _by_lang(batch):
                shard = Shard(run)
                n = len(shard.codes)
                # No shard of this lang holding `least` means a total below the support.
                least = max(1, -(-support * n // known[lang])) if known.get(lang) else 1
                if not n or (second and least == 1):
                    continue
                rows = _packets(shard, lang, buckets, least, second)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] or [pa.array([], k) for k in kinds], names)
    return mine


# --- across shards ----------------------------------------------------------

def adder(support: int):
    """Of a bucket's packets: the union of locally frequent phrases, and their
    sums over all packets, from ``support`` on."""
    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        press = zstandard.ZstdDecompressor().decompress
        groups: dict[tuple[str, int], list[dict]] = {}
        for row in table.to_pylist():
            groups.setdefault((row["lang"], row["words"]), []).append(row)
        out = []
        for lang, words in list(groups):
            phrases, counts, frequent = [], [], []
            for row in groups.pop((lang, words)):
                count = np.frombuffer(press(row["counts"]), dtype="<u4")
                phrases.append(textbits.unpressed(row["phrases"], row["lengths"]))
                counts.append(count)
                frequent.append(np.full(len(count), row["frequent"]))
            summed = pa.table({
                "phrase": pa.chunked_array(phrases), "f": np.concatenate(counts).astype(np.int64),
                "frequent": np.concatenate(frequent)}).group_by("phrase").aggregate([("f", "sum"), ("frequent", "max")])
            kept = summed.filter(pc.and_(summed["frequent_max"], pc.greater_equal(summed["f_sum"], support)))
            out.append(pa.table({
                "bucket": pa.array([key[0].as_py()] * len(kept), pa.int64()), "lang": pa.array([lang] * len(kept), pa.string()),
                "words": pa.array([words] * len(kept), pa.int32()),
                "phrase": kept["phrase"].combine_chunks().cast(pa.large_string()).cast(pa.string()), "f": kept["f_sum"]}))
        return pa.concat_tables(out)
    return add


def frequent_phrases(docs: DataFrame, support: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """``lang, words, phrase, f`` of all phrases of one to three words with
    f >= support, ``lang, n`` of all languages, and the paths of both."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    totals, counted = settled(
        rows.mapInArrow(_totals, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    known = {r["lang"]: r["n"] for r in totals.orderBy(F.col("n").desc(), "lang").limit(KNOWN).collect()}
    buckets = max(8, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    first = rows.mapInArrow(miner(support, known, buckets, second=False), PACKETS)
    packets = first.unionByName(rows.mapInArrow(miner(support, known, buckets, second=True), PACKETS))
    found, path = settled(packets.groupBy("bucket").applyInArrow(adder(support), FOUND).drop("bucket"), "phrases")
    return found, totals, [counted, path]


def _salt(part: Column, phrase: str) -> Column:
    return F.when(F.instr(part, " ") > 0, 0).otherwise(F.pmod(F.xxhash64(phrase), F.lit(SALTS)).cast("int"))


def scored(found: DataFrame) -> DataFrame:
    """The lowest-scoring cut of every phrase of two or three words. Counts are
    below 10**16; the products are exact decimals."""
    part = F.explode(F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    parts = found.where("words < 3").select("lang", "phrase", "f", part.alias("salt"))
    cuts = found.where("words > 1").select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({
        "left": F.expr("substring_index(phrase, ' ', k)"),
        "right": F.expr("substring_index(phrase, ' ', k - words)")})
    for side in ("left", "right"):
        own = parts.select(
            "lang", F.col("phrase").alias(side), F.col("salt").alias("__salt"), F.col("f").alias(side[0]))
        cuts = cuts.withColumn("__salt", _salt(F.col(side), "phrase")).join(own, ["lang", side, "__salt"]).drop("__salt")
    # The quotient is an integer at most 10**6: divided with a remainder, so nothing is rounded.
    score = F.expr("CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) "
                   "div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))")
    return cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def outside_longer(phrases: DataFrame, percent: int) -> DataFrame:
    """Without the pairs that lie inside a triple of at least ``percent`` of their count."""
    triple = F.split("phrase", " ")
    inner = phrases.where("words = 3").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice(triple, 1, 2), " "), F.array_join(F.slice(triple, 2, 2), " "))).alias("phrase"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return phrases.join(longest, ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")


def mine(docs: DataFrame, support: int = 10, percent: int = 50, keep: int = 2000) -> DataFrame:
    """The ``keep`` best phrases of each language."""
    found, totals, _ = frequent_phrases(docs, support)
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    kept = outside_longer(scored(found), percent).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    return kept.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
