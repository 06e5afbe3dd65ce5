"""Packing by bounded-space online best fit.

Every partition keeps a fixed number of open windows. A document is cut into
whole windows first; what remains goes into the open window it fits best. If
it fits none, the fullest one is filled up with its head and emitted, and the
rest opens a window in the freed place. A partition ends by running its open
windows together, which leaves one that is not full; those of all partitions
are merged in the same way by a second, small pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from chatterlens.llm import bpe, common, textbits
from chatterlens.session import settled

#: Leftovers of so many partitions meet in one merging task: at most so many
#: times ``size`` ids, whatever the input's size.
MERGE_WAYS = 256
#: Sequence numbers a partition may give out.
SEQUENCES = 1 << 40

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, ids array<int>, raw binary"
)


class Packer:
    """Open windows of one partition; ``emit`` gets a full window's pieces."""

    def __init__(self, size: int, windows: int, emit: Callable[[list], None]):
        self.size, self.windows, self.emit = size, windows, emit
        self.open: list[list] = []  # of [free, pieces]; a piece is (row, start, ids)

    def add(self, row: tuple, ids: np.ndarray, start: int = 0) -> None:
        at, end = 0, len(ids)
        while end - at >= self.size:
            self.emit([(row, start + at, ids[at: at + self.size])])
            at += self.size
        while at < end:
            need = end - at
            fits = [w for w in self.open if w[0] >= need]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                best = [self.size, []]
                self.open.append(best)
            else:
                best = min(self.open, key=lambda w: w[0])
            take = min(need, best[0])
            best[1].append((row, start + at, ids[at: at + take]))
            best[0] -= take
            at += take
            if not best[0]:
                self.open.remove(best)
                self.emit(best[1])

    def close(self) -> list:
        """Run the open windows together; the pieces of the one not full."""
        left, self.open = self.open, []
        merged, self.windows = [], 1
        for _, pieces in sorted(left, key=lambda w: w[0]):
            for row, start, ids in pieces:
                self.add(row, ids, start)
        for _, pieces in self.open:
            merged += pieces
        self.open = []
        return merged


def _batch(sequences: list[tuple[int, list, bool]], keep_ids: bool, unfinished: bool = False) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(10)]
    for number, pieces in sequences:
        offset, total = 0, sum(len(ids) for _, _, ids in pieces)
        for (doc, tokens), start, ids in pieces:
            raw = ids.astype("<u4").tobytes()
            values = (doc, start, len(ids), zlib.crc32(raw), tokens, None if unfinished else number,
                      offset, total, ids.astype(np.int32) if keep_ids and not unfinished else None,
                      raw if unfinished else None)
            for column, value in zip(columns, values):
                column.append(value)
            offset += len(ids)
    names = [f.split()[0] for f in PIECE.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _pack_texts(path: str, end_id: int, size: int, windows: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, done = bpe.encoder(path, 500_000), []
        number = TaskContext.get().partitionId() * SEQUENCES

        def emit(pieces):
            nonlocal number
            done.append((number, pieces))
            number += 1

        packer = Packer(size, windows, emit)
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for first, texts in textbits.blocks(batch.column("text"), 500_000):
                ids, at = coder.encode(texts)
                for i in range(len(texts)):
                    own = np.append(ids[at[i]: at[i + 1]], np.uint32(end_id))
                    packer.add((docs[first + i], len(own)), own)
                yield _batch(done, keep_ids)
                done.clear()
        left = packer.close()
        if done:
            yield _batch(done, keep_ids)
        if left:
            yield _batch([(0, left)], keep_ids, unfinished=True)
    return run


def _merge(size: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        # Below the numbers of the first pass, which start at zero.
        number = -(TaskContext.get().partitionId() + 1) * SEQUENCES

        def emit(pieces):
            nonlocal number
            done.append((number, pieces))
            number += 1

        packer = Packer(size, 1, emit)
        for batch in batches:
            for x in batch.to_pylist():
                packer.add((x["doc_id"], x["doc_tokens"]), np.frombuffer(x["raw"], dtype="<u4"), x["start"])
            if done:
                yield _batch(done, keep_ids)
                done.clear()
        left = packer.close()
        if left:
            done.append((number, left))
        if done:
            yield _batch(done, keep_ids)
    return run


def pack(
    docs: DataFrame, tokenizer_path: str, size: int = 1024, windows: int = 64, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True,
) -> DataFrame:
    """Pieces of packed sequences.

    Each document is its ids and ``end_id``. One row per piece: ``doc_id,
    start`` (its document's ids before it), ``length, ids_crc32`` (of the ids as
    little-endian unsigned 32-bit words), ``doc_tokens`` (with the end id),
    ``sequence_id, offset`` (place in the sequence, without gaps),
    ``sequence_tokens`` and, with ``keep_ids``, ``ids``. Sequences hold ``size``
    ids but for one per merging task; padding them to ``size`` is left to the
    reader, since it carries nothing.

    A null or empty text is the end id alone; a null id stays null; repeated
    rows are packed each; a text of any length is cut; an empty table gives no
    rows; other columns are ignored. Memory: one batch, the open windows and
    the encoder's store of chunks.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.text_rows(docs, id_col, text_col)
    packed, path = settled(rows.mapInArrow(_pack_texts(tokenizer_path, end_id, size, windows, keep_ids), PIECE), "packed")
    left = packed.where("sequence_id IS NULL")
    tasks = max(1, -(-left.select("raw").where("offset = 0").count() // MERGE_WAYS))
    spread = left.repartition(tasks, "doc_id", "start") if tasks > 1 else left.coalesce(1)
    merged = spread.mapInArrow(_merge(size, keep_ids), PIECE)
    return packed.where("sequence_id IS NOT NULL").unionAll(merged).drop("raw", *([] if keep_ids else ["ids"]))
