"""How five text filters act on each other, from a sparse document-term matrix.

Texts are cut into words once, in blocks. A block numbers its words with a
dictionary of its own and keeps its documents as compressed sparse rows (CSR).
Its words go to buckets of a hash in compressed packets; a bucket holds every
word at most once per block, so no word is hot, and numbers them globally.
The numbers return to the blocks, whose rewritten rows are the shards of the
matrix: row sums are the words of a text and nonzero counts its distinct words,
which decide two of the filters. The other flags ride along with the rows.
Copies of a text share all flags but the last, so documents collapse to counts
before anything is grouped by text.

Odd input: a null text is empty, a null lang the part ``''``. A null id is
neither smaller nor greater than another, so its row is no repeat. Repeated
rows count each; rows of one id and one text aren't repeats of each other.
Several label rows of one id count as good (toxic) if any is. An empty table
gives no rows. Other columns are not read. Words are compared by their bytes,
texts by their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.llm import textbits
from chatterlens.session import discard, settled

LETTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}
#: Bytes of text in a block (a longer text is a block of its own), bytes of all
#: texts for each bucket of words.
BLOCK = 4_000_000
BUCKET = 32_000_000

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
MARKS = np.zeros(256, dtype=np.int64)
MARKS[list(b"#$%&*|")] = 1
CAPITALS = np.zeros(256, dtype=np.int64)
CAPITALS[65:91] = 1
#: Every byte that begins a code point.
POINTS = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)

ROWS = "doc_ids array<bigint>, parts array<string>, keys array<binary>, marks array<int>"
BLOCKS = f"block bigint, bucket bigint, words binary, lengths binary, {ROWS}, indptr binary, indices binary, counts binary"
SHARDS = f"block bigint, {ROWS}, indptr binary, indices binary, counts binary"
NUMBERS = "block bigint, bucket bigint, ids binary"
VERDICTS = "doc_id bigint, part string, text_key binary, n_words bigint, n_terms bigint, mask int"


# --- the matrix -------------------------------------------------------------

def _per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the flags of each text's bytes (its closing space has none)."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[starts[1:] - 1] - total[starts[:-1]]


def press(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpress(values: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(values), dtype=kind)


def local_csr(texts: list[bytes], buckets: int) -> tuple[dict, list[dict]]:
    """A block's rows over its own words, and these words as one packet per
    bucket. Words are numbered bucket by bucket."""
    buf, starts = textbits.joined(texts)
    begin, end = textbits.words(buf)
    codes, dictionary = textbits.encoded(buf, ~textbits.SPACE[buf], begin, end)
    bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in dictionary.to_pylist()], dtype=np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    dictionary = dictionary.take(pa.array(order))
    packets = [
        dict(zip(("bucket", "words", "lengths"), (k, *textbits.pressed(dictionary.slice(a, b - a)))))
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]

    texts_end = np.searchsorted(begin, starts)
    width = max(len(dictionary), 1)
    row = np.repeat(np.arange(len(texts)), np.diff(texts_end))
    cell, counts = np.unique(row * width + place[codes], return_counts=True)
    indptr = np.searchsorted(cell, np.arange(len(texts) + 1) * width)
    capitals, points = _per_text(CAPITALS[buf], starts), _per_text(POINTS[buf], starts)
    marks = np.where(100 * capitals > MAX_CAPITALS * points, BIT["C"], 0)
    marks += np.where(_per_text(MARKS[buf], starts) > 0, BIT["D"], 0)
    return {
        "indptr": press(indptr.astype("<i8")), "indices": press((cell % width).astype("<i4")),
        "counts": press(counts.astype("<i4")), "marks": marks.astype(np.int32),
        "keys": [hashlib.sha256(t).digest() for t in texts],
    }, packets


def cutter(buckets: int):
    schema = pa.schema([
        ("block", pa.int64()), ("bucket", pa.int64()), ("words", pa.binary()), ("lengths", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.string())), ("keys", pa.list_(pa.binary())),
        ("marks", pa.list_(pa.int32())), ("indptr", pa.binary()), ("indices", pa.binary()), ("counts", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, parts = batch.column("doc_id"), batch.column("part").cast(pa.string())
            for first, texts in textbits.blocks(batch.column("text"), BLOCK):
                rows, packets = local_csr(texts, buckets)
                rows |= {"doc_ids": ids.slice(first, len(texts)), "parts": parts.slice(first, len(texts))}
                found = [{"block": number, **r} for r in (rows, *packets)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.get(f.name) for r in found], f.type) for f in schema], schema=schema)
                number += 1
    return cut


def numberer(buckets: int, words_out: bool):
    """Global numbers of a bucket's words, in order of first appearance by
    block: a packet of numbers for each of words, or the dictionary."""
    def number(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        packets = [textbits.unpressed(w, n) for w, n in zip(table["words"].to_pylist(), table["lengths"].to_pylist())]
        found = pa.concat_arrays(packets).dictionary_encode()
        own = key[0].as_py()
        if words_out:
            ids = np.arange(len(found.dictionary)) * buckets + own
            return pa.table({"term_id": pa.array(ids, pa.int64()), "word": found.dictionary.cast(pa.binary())})
        ids = found.indices.to_numpy(zero_copy_only=False).astype(np.int64) * buckets + own
        at = np.cumsum([0, *(len(p) for p in packets)])
        return pa.table({
            "block": table["block"], "bucket": table["bucket"],
            "ids": pa.array([press(ids[a:b].astype("<i8")) for a, b in zip(at[:-1], at[1:])], pa.binary())})
    return number


def _globally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local columns of a block's rows become global ones."""
    names = [f.split()[0] for f in SHARDS.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            ids = [unpress(p, "<i8") for p in row.column("ids")[0].as_py() or []]
            table = np.concatenate(ids) if ids else np.zeros(0, dtype="<i8")
            out = {name: row.column(name) for name in names}
            out["indices"] = pa.array([press(table[unpress(row.column("indices")[0].as_py(), "<i4")])], pa.binary())
            yield pa.RecordBatch.from_pydict(out)


def matrix(docs: DataFrame, part_col: str = "lang") -> tuple[DataFrame, DataFrame, list[str]]:
    """The CSR shards (``indptr`` and ``indices`` as 64-bit and ``counts`` as
    32-bit little-endian integers, compressed by zstandard, next to what is known
    of their rows), the dictionary (``term_id, word``), which is numbered again
    when it is asked for, and the paths of what was written."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    buckets = max(8, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET)
    blocks, made = settled(rows.mapInArrow(cutter(buckets), BLOCKS), "audit-blocks")
    packets = blocks.where("bucket IS NOT NULL").select("block", "bucket", "words", "lengths").groupBy("bucket")
    tables = packets.applyInArrow(numberer(buckets, words_out=False), NUMBERS).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "ids"))).alias("packets")).select("block", "packets.ids")
    own = blocks.where("bucket IS NULL").drop("bucket", "words", "lengths")
    shards, stored = settled(own.join(tables, "block", "left").mapInArrow(_globally, SHARDS), "audit-shards")
    dictionary = packets.applyInArrow(numberer(buckets, words_out=True), "term_id bigint, word binary")
    return shards, dictionary, [made, stored]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            at, counts = unpress(batch.column("indptr")[i].as_py(), "<i8"), unpress(batch.column("counts")[i].as_py(), "<i4")
            total = np.zeros(len(counts) + 1, dtype=np.int64)
            np.cumsum(counts, out=total[1:])
            words, terms = total[at[1:]] - total[at[:-1]], np.diff(at)
            mask = batch.column("marks")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
            mask = mask + np.where(words < MIN_WORDS, BIT["A"], 0)
            mask += np.where(100 * terms < MIN_DISTINCT * words, BIT["B"], 0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_ids")[i].values, "part": batch.column("parts")[i].values,
                "text_key": batch.column("keys")[i].values, "n_words": pa.array(words, pa.int64()),
                "n_terms": pa.array(terms, pa.int64()), "mask": pa.array(mask, pa.int32()),
            })


def verdicts(shards: DataFrame) -> DataFrame:
    """Per row of the matrix its words, distinct words and failed filters A to D."""
    return shards.select(
        "doc_ids", "parts", "keys", "marks", "indptr", "counts").mapInArrow(_decide, VERDICTS)


# --- the audit --------------------------------------------------------------

def cells(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones per part and set of failed filters."""
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = found.groupBy("text_key", "part", "mask", "doc_id").agg(F.count("*").alias("n")).join(
        marked, "doc_id", "left").fillna(False, ["good", "toxic"])
    alike = rows.groupBy("text_key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("text_key"))
    own = F.col("no_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.inline(F.array(
        F.struct(F.col("mask").alias("failed"), own.alias("docs")),
        F.struct((F.col("mask") + BIT["E"]).alias("failed"), (F.col("n") - own).alias("docs"))))
    return alike.withColumn("least", least).select("part", "good", "toxic", both).groupBy("part", "failed").agg(
        F.sum("docs").alias("docs"), F.sum(F.when(F.col("good"), F.col("docs")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("docs")).otherwise(0)).alias("toxic"))


def _bits(letters: Column) -> Column:
    return sum(F.when(F.instr(letters, c) > 0, bit).otherwise(0) for c, bit in BIT.items())


def report(found: DataFrame) -> DataFrame:
    """All orders of the filters, step by step, from the counts of :func:`cells`."""
    parts = found.groupBy("part").agg(F.collect_list(F.struct("failed", "docs", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(order)) for order in permutations(LETTERS)])
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select(
        "part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    steps = steps.withColumns({
        "own": _bits(F.expr("substring(filter_order, step, 1)")),
        "before": _bits(F.expr("substring(filter_order, 1, step - 1)"))})

    def fails(cell: Column) -> Column:
        return cell["failed"].bitwiseAND(F.col("own")) != 0

    def earlier(cell: Column) -> Column:
        return cell["failed"].bitwiseAND(F.col("before")) != 0

    def total(chosen, value) -> Column:
        return F.aggregate(
            F.filter("cells", chosen), F.lit(0).cast("long"), lambda sum_, c: sum_ + value(c).cast("long"))

    def removed(c):
        return fails(c) & ~earlier(c)
    orders_in_all = F.lit(len(list(permutations(LETTERS))))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(lambda c: ~fails(c) & ~earlier(c), lambda c: c["docs"]).alias("kept"),
        total(removed, lambda c: c["docs"]).alias("removed"),
        total(lambda c: fails(c) & earlier(c), lambda c: c["docs"]).alias("redundant"),
        total(lambda c: c["failed"] == F.col("own"), lambda c: c["docs"]).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["docs"] * (orders_in_all / F.bit_count(c["failed"])).cast("long")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """One row per part, order and step; the matrix is discarded after use."""
    shards, _, paths = matrix(docs, part_col)
    counted, _ = settled(cells(verdicts(shards), labels), "audit-cells")
    for path in paths:
        discard(docs.sparkSession, path)
    return report(counted)
