"""Removal of repeated byte strings by suffix arrays.

Every window of ``size`` bytes has an anchor, its least hashed string of
``gram`` bytes, and equal windows have equal anchors. Runs of windows with one
anchor are pieces; only pieces whose anchor occurs again can hold a repeated
window, all others drop out. Pieces meet by anchor: equal pieces become one
with a count, and the different pieces of an anchor are written one after the
other into shards, whose suffix and common-prefix arrays are made by external
induced sorting (:mod:`chatterlens.llm.induced`). A window is repeated if its
piece occurs twice or a neighbour in suffix order shares ``size`` bytes with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlens.llm import common, induced, textbits
from chatterlens.session import settled

#: Bytes of pieces that are sorted together; an anchor's pieces never part.
SHARD = 1_500_000
#: Bytes of texts that are cut at a time; about a hundred times as much lies in memory meanwhile.
AT_ONCE = 500_000
#: Low bits of a key that hold the place, so that the leftmost of equal hashes wins.
PLACE = np.uint64(2**24 - 1)
#: From this many different pieces on, an anchor is split by a second anchor.
BUSY = 20_000

PIECE = "k1 long, k2 long, start int, windows int, anchor long, content long"


def anchored(
    buf: np.ndarray, prefix: np.ndarray, first: np.ndarray, last: np.ndarray, size: int, gram: int, seed: int = 0,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, for windows that start in any of the
    ranges ``[first, last]``: range, start, number of windows and anchor."""
    grams = len(buf) - gram + 1
    if grams <= 0 or not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at = np.arange(grams)
    _, down = textbits.powers(len(prefix))
    value = textbits.mix((prefix[gram:] - prefix[:-gram]) * down[:grams] + np.uint64(seed))
    key = (value & ~PLACE) | (at.astype(np.uint64) & PLACE)
    span, width = size - gram + 1, 1
    low = key
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width:])
    inside = np.zeros(len(low) + 1, dtype=np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    change = np.ones(len(low), dtype=bool)
    change[1:] = low[1:] != low[:-1]
    change[first] = True
    stop = np.zeros(len(low) + 1, dtype=bool)
    stop[last + 1] = True
    start = np.flatnonzero(inside & change)
    edge = np.flatnonzero((np.append(change, True) | stop))
    end = edge[np.searchsorted(edge, start, side="right")]
    owner = np.searchsorted(first, start, side="right") - 1
    # Where the least key of the window lies, by its low bits.
    where = start + ((low[start] & PLACE).astype(np.int64) - start & int(PLACE))
    return owner, start, end - start, value[where]


def _cut(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for begin, texts in textbits.blocks(batch.column("text"), AT_ONCE):
                buf, starts = textbits.joined(texts)
                prefix = textbits.prefix_hash(buf)
                first, last = starts[:-1], starts[1:] - 1 - size
                long = np.flatnonzero(last >= first)
                owner, start, n, anchor = anchored(buf, prefix, first[long], last[long], size, gram)
                doc = long[owner]
                whole, end = memoryview(buf), start + n + size - 1
                content = textbits.digests((whole[a:b] for a, b in zip(start.tolist(), end.tolist())), len(start))
                yield pa.RecordBatch.from_arrays([
                    pa.array(k1[begin + doc]), pa.array(k2[begin + doc]), pa.array((start - first[doc]).astype(np.int32)),
                    pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    [f.split()[0] for f in PIECE.split(", ")])
    return run


def _fetch(size: int, gram: int):
    """Bytes of pieces; those of busy anchors cut again by a second anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                text = row.column("text").cast(pa.large_binary())[0].as_py()
                out = [[] for _ in range(6)]
                for p in row.column("pieces")[0].as_py():
                    own = text[p["start"]: p["start"] + p["windows"] + size - 1]
                    parts = [(0, p["windows"], 0)]
                    if p["busy"]:
                        buf = np.frombuffer(own, dtype=np.uint8)
                        _, start, n, second = anchored(
                            buf, textbits.prefix_hash(buf), np.array([0]), np.array([p["windows"] - 1]), size, gram // 2, 77)
                        parts = list(zip(start.tolist(), n.tolist(), second.view(np.int64).tolist()))
                    for at, n, second in parts:
                        for column, value in zip(out, (
                                p["anchor"], second, p["content"], at, p["times"], own[at: at + n + size - 1])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.int64(), pa.binary()])],
                    ["anchor", "second", "content", "at", "times", "bytes"])
    return run


def repeated(pieces: list[bytes], times: list[int], size: int, limit: int = 4_000_000) -> list[np.ndarray]:
    """Starts, within each piece, of windows that start anywhere else too."""
    # Bytes of UTF-8 never are 255, so all symbols still fit a byte; 0 ends a piece.
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", dtype=np.uint8) + np.uint8(1)
    starts = np.cumsum([0, *[len(p) + 1 for p in pieces]])
    found = np.zeros(len(text), dtype=bool)
    last = None
    for places, common_ in induced.suffixes(text, size, limit):
        hit = np.flatnonzero(common_ >= size)
        found[places[hit]] = True
        before = hit[hit > 0] - 1
        found[places[before]] = True
        if len(hit) and hit[0] == 0 and last is not None:
            found[last] = True
        last = places[-1]
    # A prefix in common that passes a piece's end does not count: windows start where they fit.
    return [np.arange(len(p) - size + 1) if t > 1 else np.flatnonzero(found[a: a + max(len(p) - size + 1, 0)])
            for p, t, a in zip(pieces, times, starts.tolist())]


def _sort(size: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, last = [], 0, None

        def result() -> pa.RecordBatch:
            found = repeated([x[4] for x in held], [x[5] for x in held], size)
            out = [[], [], [], []]
            for (anchor, _, content, at, _, _), starts in zip(held, found):
                if not len(starts):
                    continue
                edge = np.flatnonzero(np.diff(starts) > 1)
                for a, b in zip(starts[np.append(0, edge + 1)].tolist(), starts[np.append(edge, len(starts) - 1)].tolist()):
                    for column, value in zip(out, (anchor, content, at + a, at + b + size)):
                        column.append(value)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out], ["anchor", "content", "from", "until"])

        for batch in batches:
            for x in batch.to_pylist():
                key = (x["anchor"], x["second"])
                if total >= shard and key != last:
                    yield result()
                    held, total = [], 0
                held.append((x["anchor"], x["second"], x["content"], x["at"], x["bytes"], x["times"]))
                total += len(x["bytes"])
                last = key
        if held:
            yield result()
    return run


def _remove(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("k1").to_pylist()
            texts = batch.column("text").cast(pa.large_binary())
            spans = batch.column("spans")
            for first in range(0, len(batch), 256):
                out = [[] for _ in range(6)]
                for i in range(first, min(first + 256, len(batch))):
                    text, at, kept, runs = texts[i].as_py(), 0, [], 0
                    reach = -1
                    for s in sorted((s["from"], s["until"]) for s in spans[i].as_py() or []):
                        if s[0] > reach:
                            kept.append(text[at: s[0]])
                            runs += 1
                        reach = at = max(reach, s[1])
                    kept.append(text[at:])
                    whole = b"".join(kept)
                    values = (ids[i] if ids[i] != common.NO_ID else None, len(text), len(text) - len(whole), runs,
                              hashlib.sha256(whole).hexdigest(), whole if keep_bytes else None)
                    for column, value in zip(out, values):
                        column.append(value)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, kinds)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def repeat_spans(
    docs: DataFrame, size: int = 200, gram: int = 64, shard: int = SHARD, busy: int = BUSY,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Byte ranges to remove, per row key: ``k1, k2, spans`` (they may overlap).

    A piece occurs as often as its copies, but is sorted once; anchors with
    more than ``busy`` different pieces are split by a second anchor. A lost
    task sorts its shards again; queues on disk are private to a task and gone
    with it.
    """
    spark = docs.sparkSession
    common.ship(spark)
    keyed = common.keyed(docs, id_col, text_col)
    cut, _ = settled(keyed.mapInArrow(_cut(size, gram), PIECE), "pieces")
    # Written, so that the join below has plain exchanges, whose hot keys are split.
    again, _ = settled(cut.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("n > 1").select(
        "anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    hits, _ = settled(cut.join(again, "anchor"), "hits")
    different = hits.where("mixed").groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("k1", "k2", "start", "windows")).alias("at"))
    different, _ = settled(different.select("anchor", "content", "times", "at.*"), "different")
    crowd = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > busy).select(
        "anchor", F.lit(True).alias("busy"))
    wanted = different.join(crowd, "anchor", "left").groupBy("k1", "k2").agg(F.collect_list(F.struct(
        "start", "windows", "anchor", "content", "times", F.coalesce("busy", F.lit(False)).alias("busy"))).alias("pieces"))
    bytes_ = keyed.join(wanted, ["k1", "k2"]).mapInArrow(
        _fetch(size, gram), "anchor long, second long, content long, at long, times long, bytes binary")
    sorted_ = bytes_.repartition("anchor", "second").sortWithinPartitions("anchor", "second", "content", "at").mapInArrow(
        _sort(size, shard), "anchor long, content long, `from` long, until long")
    verdicts, _ = settled(sorted_, "repeats")
    some = hits.where("mixed").join(verdicts, ["anchor", "content"]).select(
        "k1", "k2", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("until")).alias("until"))
    full = hits.where("NOT mixed").select(
        "k1", "k2", F.col("start").cast("long").alias("from"),
        (F.col("start") + F.col("windows") + size - 1).cast("long").alias("until"))
    return some.unionByName(full).groupBy("k1", "k2").agg(F.collect_set(F.struct("from", "until")).alias("spans"))


def remove_repeats(
    docs: DataFrame, size: int = 200, keep_bytes: bool = True, id_col: str = "doc_id", text_col: str = "text", **settings,
) -> DataFrame:
    """Every text without the bytes covered by a string of ``size`` bytes that
    starts anywhere else in the table, in the same text included.

    One row per row: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed
    runs), ``kept_sha256`` and, with ``keep_bytes``, ``kept`` (the remaining
    bytes, which may end inside a character). Matches never cross texts and are
    judged on the input. Null texts are empty; texts under ``size`` bytes lose
    nothing; a null id stays null; repeated rows repeat each other and lose
    everything from ``size`` bytes on; an empty table gives no rows; other
    columns are ignored.
    """
    keyed = common.keyed(docs, id_col, text_col)
    spans = repeat_spans(docs, size, id_col=id_col, text_col=text_col, **settings)
    done = keyed.join(spans, ["k1", "k2"], "left").select("k1", "text", "spans").mapInArrow(
        _remove(keep_bytes),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if keep_bytes else done.drop("kept")


def cut_texts(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows with all their columns and the text that remains; a character
    that a removed run begins or ends in goes with it."""
    @F.pandas_udf("string")
    def remaining(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, ranges in zip(texts, spans):
            if ranges is None or text is None:
                out.append(text)
                continue
            raw, at, kept = text.encode(), 0, []
            for a, b in sorted((r["from"], r["until"]) for r in ranges):
                kept.append(raw[at:a] if a > at else b"")
                at = max(at, b)
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    spans = repeat_spans(docs, size, id_col=id_col, text_col=text_col, **settings)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = [F.coalesce(F.col(id_col).cast("long"), F.lit(common.NO_ID)), F.xxhash64(text)]
    joined = docs.alias("d").join(spans.alias("s"), (keys[0] == F.col("s.k1")) & (keys[1] == F.col("s.k2")), "left")
    return joined.select(*[
        remaining(F.col(f"d.`{c}`"), F.col("s.spans")).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])
