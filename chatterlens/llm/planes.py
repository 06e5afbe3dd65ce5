"""Token ids in files of compressed bit or byte planes.

Ids are laid out in ascending document order over shards (one per partition of
a range partitioning). A shard is cut into blocks of a fixed number of ids.
Plane p of a block holds bit (or byte) p of all its ids; the planes are
compressed on their own with zstandard. High planes are nearly constant and
shrink to a few bytes.

A stored set is a folder of two Parquet tables. ``blocks`` is the file format's
chunk index and payload: ``shard, block, at`` (ids of the shard before it),
``n_ids, width, planes`` and ``docs``, the pieces of documents in the block as
``(row, doc_id, doc_at, n)``. ``shards`` has ``shard, base, n_ids``: how many
ids all shards before it hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatterlens.llm import bpe, common, textbits

BLOCK = (
    "shard int, block long, at long, n_ids int, width int, planes array<binary>, "
    "docs array<struct<row: long, doc_id: long, doc_at: long, n: int>>"
)
SEGMENT = "shard int, row long, doc_id long, shard_at long, doc_at long, n long, crc long, ids array<int>"
_DOCS = pa.list_(pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("doc_at", pa.int64()), ("n", pa.int32())]))
_BLOCK = pa.schema([
    ("shard", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()),
    ("planes", pa.list_(pa.binary())), ("docs", _DOCS)])
_SEGMENT = pa.schema([
    ("shard", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("shard_at", pa.int64()),
    ("doc_at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.list_(pa.int32()))])


def to_planes(ids: np.ndarray, bits: bool, level: int = 3) -> list[bytes]:
    """Compressed planes of 32-bit ids, lowest first."""
    rows = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if bits:
        # A byte that no id uses has eight empty planes.
        empty = np.zeros(-(-len(ids) // 8), dtype=np.uint8)
        rows = [
            np.packbits(row & np.uint8(1 << bit), bitorder="little") if used else empty
            for row, used in zip(rows, rows.any(axis=1)) for bit in range(8)]
    squeeze = zstandard.ZstdCompressor(level=level)
    return [squeeze.compress(row.tobytes()) for row in rows]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids again; 4 planes are bytes, 32 are bits."""
    open_ = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(open_.decompress(p), dtype=np.uint8) for p in planes]
    if len(rows) == 32:
        raw = np.zeros((n, 4), dtype=np.uint8)
        for byte in range(4):
            value = np.zeros(n, dtype=np.uint8)
            for bit, row in enumerate(rows[8 * byte: 8 * byte + 8]):
                if row.any():
                    value |= np.unpackbits(row, count=n, bitorder="little") << np.uint8(bit)
            raw[:, byte] = value
    else:
        raw = np.ascontiguousarray(np.stack(rows, axis=1))
    return raw.reshape(-1).view("<u4")


def _write_shard(path: str, end_id: int, size: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = bpe.encoder(path), TaskContext.get().partitionId()
        waiting, held, docs, block, row = [], 0, [], 0, 0

        def flush(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal block, docs
            inside, room = [], len(ids)
            rest = []
            for r, doc, doc_at, n in docs:
                take = min(n, room)
                if take:
                    inside.append({"row": r, "doc_id": doc, "doc_at": doc_at, "n": take})
                if n > take:
                    rest.append((r, doc, doc_at + take, n - take))
                room -= take
            docs = rest
            out = pa.RecordBatch.from_pylist([{
                "shard": shard, "block": block, "at": block * size, "n_ids": len(ids), "width": 1 if bits else 8,
                "planes": to_planes(ids, bits), "docs": inside}], schema=_BLOCK)
            block += 1
            return out

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, texts in textbits.blocks(batch.column("text")):
                ids, at = coder.encode(texts)
                full = np.insert(ids, at[1:], np.uint32(end_id))
                for i in range(len(texts)):
                    docs.append((row, names[first + i], 0, int(at[i + 1] - at[i]) + 1))
                    row += 1
                waiting.append(full)
                held += len(full)
                if held >= size:
                    flat = np.concatenate(waiting)
                    for k in range(held // size):
                        yield flush(flat[k * size: (k + 1) * size])
                    waiting, held = [flat[held - held % size:]], held % size
        if held:
            yield flush(np.concatenate(waiting))
    return run


def write(
    docs: DataFrame, folder: str, tokenizer_path: str, block_ids: int = 65_536, bits: bool = True, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode and store all documents in ascending order of their id.

    A null text is empty (the end id alone); null ids come first; rows with the
    same id follow each other in the order of their texts; an empty table
    stores no blocks; other columns are ignored. A task holds one batch and one
    block. A lost task writes its whole shard again.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.text_rows(docs, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("text"), "text")
    with common.small_batches(spark):
        ordered.mapInArrow(_write_shard(tokenizer_path, end_id, block_ids, bits), BLOCK).write.parquet(f"{folder}/blocks")
    totals = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    # One row per shard, so a single ordered window over them stays small.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.select(
        "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), "n_ids",
    ).coalesce(1).write.parquet(f"{folder}/shards")


def _segments(keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids = from_planes(x["planes"], x["n_ids"])
                at, out = 0, []
                for d in x["docs"]:
                    own = ids[at: at + d["n"]]
                    out.append({
                        "shard": x["shard"], "row": d["row"], "doc_id": d["doc_id"], "shard_at": x["at"] + at,
                        "doc_at": d["doc_at"], "n": len(own), "crc": zlib.crc32(own.tobytes()),
                        "ids": own.astype(np.int32) if keep_ids else None})
                    at += d["n"]
                yield pa.RecordBatch.from_pylist(out, schema=_SEGMENT)
    return run


def segments(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """Runs of ids as they lie in the blocks, one row per document and block,
    with ``start`` (ids of all documents before the run)."""
    common.ship(spark)
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "base")
    # One row per shard: bounded by the number of partitions, not by rows.
    return blocks.mapInArrow(_segments(keep_ids), SEGMENT).join(F.broadcast(shards), "shard").withColumn(
        "start", F.col("base") + F.col("shard_at"))


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


def crc_join(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings one after the other, from the crc32 of each
    and the length of the second: a shift by that many zero bytes is linear
    over GF(2)."""
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit; the polynomial of crc32
    bits = 8 * length
    while bits:
        if bits & 1:
            first = _times(step, first)
        step = [_times(step, row) for row in step]
        bits >>= 1
    return first ^ second


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per stored document: ``doc_id, start, n_tokens, ids_crc32``, from the
    files alone, whose blocks are opened once. Checksums are joined in Python
    only for documents that lie in several blocks."""

    @F.udf("long")
    def whole_crc(parts):
        if parts is None:
            return None
        total = None
        for p in sorted(parts, key=lambda p: p["doc_at"]):
            total = p["crc"] if total is None else crc_join(total, p["crc"], 4 * p["n"])
        return total

    parts = F.collect_list(F.struct("doc_at", "n", "crc"))
    rows = segments(spark, folder, keep_ids=False).groupBy("shard", "row").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.first("crc").alias("crc"), parts.alias("parts"))
    several = F.when(F.size("parts") > 1, F.col("parts"))
    return rows.select(
        "doc_id", "start", "n_tokens", F.coalesce(whole_crc(several), F.col("crc")).alias("ids_crc32"))
