"""A hidden Markov language model trained on the whole corpus.

Word counts of the training texts come first. The most frequent words are
symbols of their own, all others share one symbol and are told apart by their
unigram share, so the model is a proper distribution over every text and its
size is bounded. Baum-Welch runs over all training texts: each partition
gathers expected counts, Spark adds them up by symbol, and the driver
re-estimates a bounded table. Training texts are cut into words once and
written as symbol numbers, which every round reads. Long texts are cut into
segments for training only; the score is the exact forward likelihood of the
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlens.llm import common, textbits
from chatterlens.session import discard, settled

#: Words that are symbols of the model, with counts at hand in every task; counts of the rest are joined.
SYMBOLS = 1 << 16
SEGMENT = 128
#: Tokens that one call of the recursion works on; a longer text is a call of its own.
TOKENS = 400_000
END = int(textbits.mix(np.array([0xE0D], dtype=np.uint64))[0])


class Lookup:
    """Place of 64-bit keys in a sorted list, by buckets of their top bits;
    ``len(keys)`` where absent."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        top = (keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << bits) + 1))
        self.deepest = int(np.diff(self.first).max()) if len(keys) else 0

    def __call__(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), len(self.keys), dtype=np.int64)
        bucket = (words >> self.shift).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < stop)
        for _ in range(self.deepest):
            here = at[left]
            hit = self.keys[here] == words[left]
            out[left[hit]] = here[hit]
            at[left] += 1
            left = left[~hit]
            left = left[at[left] < stop[left]]
            if not len(left):
                break
        return out


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after every text, and each text's start."""
    words, bounds = textbits.word_hashes(texts)
    return np.insert(words, bounds[1:], np.uint64(END)), bounds + np.arange(len(bounds))


def _count():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def merged() -> pa.RecordBatch:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            sums = np.bincount(back, weights=np.concatenate([c for _, c in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], ["h", "c"])

        for batch in batches:
            for _, texts in textbits.blocks(batch.column("text")):
                held.append(np.unique(_tokens(texts)[0], return_counts=True))
                total += len(held[-1][0])
                if total > 3_000_000:
                    yield merged()
                    held, total = [], 0
        if held:
            yield merged()
    return run


def forward_backward(
    symbols: np.ndarray, sizes: np.ndarray, fresh: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over segments given one after the other (``sizes``):
    state shares of every token, transitions, and states of fresh starts."""
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    long = sizes[order]
    steps, states = int(long[0]), len(start)
    active = np.searchsorted(-long, -np.arange(steps), side="left")
    ahead, scale, seen = [], [], []
    for t in range(steps):
        n = active[t]
        e = emit[symbols[first[:n] + t]]
        a = start[None, :] * e if t == 0 else (ahead[-1][:n] @ move) * e
        c = a.sum(axis=1, keepdims=True)
        a /= c
        ahead.append(a)
        scale.append(c)
        seen.append(e)
    shares = np.empty((len(symbols), states), dtype=np.float32)
    moves = np.zeros((states, states))
    back = np.ones((active[-1], states), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        if t < steps - 1:
            m = active[t + 1]
            v = seen[t + 1] * back / scale[t + 1]
            moves += ahead[t][:m].T @ v
            back = np.concatenate([v @ move.T, np.ones((n - m, states), dtype=np.float32)])
        shares[first[:n] + t] = ahead[t] * back
    starts = (ahead[0] * back)[fresh[order]].sum(axis=0)
    return shares, moves * move, starts


def _symbols(sent):
    """Symbol numbers of every text, with its end, as 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(sent.value)
        for batch in batches:
            for _, texts in textbits.blocks(batch.column("text")):
                words, bounds = _tokens(texts)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), len(texts), [
                    None, pa.py_buffer(4 * bounds), pa.py_buffer(find(words).astype(np.uint32))]).cast(pa.binary())], ["symbols"])
    return run


def _runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of whole texts, about TOKENS at a time, and the texts' lengths."""
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1] // 4
    data = np.frombuffer(data, dtype=np.uint32)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TOKENS, side="right")) - 1)
        yield data[bounds[at]: bounds[stop]].astype(np.int64), np.diff(bounds[at: stop + 1])
        at = stop


def _expect(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        start, move, emit = (m[k].astype(np.float32) for k in ("start", "move", "emit"))
        states, many = len(start), len(m["keys"]) + 1
        sums, moves, starts = np.zeros((states, many)), np.zeros((states, states)), np.zeros(states)
        for batch in batches:
            for symbols, n in _runs(batch.column("symbols")):
                parts = -(-n // SEGMENT)
                doc = np.repeat(np.arange(len(n)), parts)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                sizes = (n // parts)[doc] + (number < (n % parts)[doc])
                shares, x, s = forward_backward(symbols, sizes, number == 0, start, move, emit)
                for k in range(states):
                    sums[k] += np.bincount(symbols, weights=shares[:, k], minlength=many)
                moves += x
                starts += s
        # Symbols, then rows of the transitions, then the starts.
        table = np.concatenate([sums.T, moves, starts[None, :]]).astype(np.float32)
        table[table < 1e-7] = 0
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), *(pa.array(table[some, k]) for k in range(states))], ["row", *(f"s{k}" for k in range(states))])
    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        find, counts = Lookup(m["keys"]), np.append(m["counts"], 0)
        logs = np.log10(counts + 1.0)
        other = len(m["keys"])
        base_log, other_log = np.log10(m["tokens"] + m["types"] + 1.0), m["other_log"]
        for batch in batches:
            at = 0
            while at < len(batch):
                # Many texts at a time, since every step of time is one call for all of them.
                held, symbols, n, base, rest, known, tail, size = at, [], [], [], [], [], [], 0
                for first, texts in textbits.blocks(batch.column("text").slice(at)):
                    if size > 3_000_000:
                        break
                    words, bounds = _tokens(texts)
                    own = find(words).astype(np.int32)
                    far, log, cut = own == other, logs[own], bounds[:-1]
                    symbols.append(own)
                    n.append(np.diff(bounds))
                    base.append(np.add.reduceat(log, cut))
                    rest.append(np.add.reduceat(np.where(far, -other_log, 0.0), cut))
                    known.append(np.add.reduceat((~far).astype(np.int64), cut))
                    tail += [words[a:b][far[a:b]].view(np.int64).tolist() for a, b in zip(bounds[:-1], bounds[1:])]
                    size += len(words)
                    at = held + first + len(texts)
                symbols, n, base, rest, known = map(np.concatenate, (symbols, n, base, rest, known))
                score = forward(symbols, n, m["start"], m["move"], m["emit"]) + rest - base_log * count_other(symbols, n, other)
                yield pa.RecordBatch.from_arrays([
                    batch.column("k1").slice(held, at - held), batch.column("k2").slice(held, at - held), pa.array(n),
                    pa.array(known), pa.array(base - base_log * n), pa.array(score), pa.array(tail, pa.list_(pa.int64()))],
                    ["k1", "k2", "n_tokens", "n_known", "base_score", "score", "tail"])
    return run


def count_other(symbols: np.ndarray, n: np.ndarray, other: int) -> np.ndarray:
    return np.add.reduceat((symbols == other).astype(np.int64), np.cumsum(n) - n)


def forward(symbols: np.ndarray, sizes: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 likelihood of every symbol sequence by scaled forward recursion."""
    order = np.argsort(-sizes, kind="stable")
    first, long = (np.cumsum(sizes) - sizes)[order], sizes[order]
    active = np.searchsorted(-long, -np.arange(int(long[0])), side="left")
    out, a = np.zeros(len(sizes)), None
    for t, n in enumerate(active.tolist()):
        e = emit[symbols[first[:n] + t]]
        a = start * e if t == 0 else (a[:n] @ move) * e
        c = a.sum(axis=1)
        a /= c[:, None]
        out[:n] += np.log10(c)
    result = np.empty(len(sizes))
    result[order] = out
    return result


def train(
    spark: SparkSession, texts: DataFrame, states: int = 8, rounds: int = 5, weight: float = 500.0, seed: int = 11,
) -> tuple[dict, DataFrame]:
    """A model of all ``texts`` and the table of all word counts (``h, c``).

    The model holds at most SYMBOLS counts and SYMBOLS x states emissions.
    Emissions are smoothed towards the unigram shares by ``weight`` tokens.
    """
    counts, _ = settled(texts.mapInArrow(_count(), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "word-counts")
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "h").limit(SYMBOLS).toArrow()
    keys, values = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    share = (values + 1.0) / (tokens + types + 1.0)
    share = np.append(share, max(1.0 - share.sum(), 1e-300))
    make = np.random.Generator(np.random.PCG64(seed))
    # Words lean to states at random; texts then choose the states that suit their words.
    emit = share[:, None] * np.exp(0.5 * make.standard_normal((len(share), states)))
    model = {
        "keys": keys, "counts": values, "tokens": tokens, "types": types,
        "other_log": float(np.log10(share[-1])), "start": np.full(states, 1 / states),
        "move": np.full((states, states), 0.02 / states) + 0.98 * np.eye(states), "emit": emit / emit.sum(axis=0)}
    sent = spark.sparkContext.broadcast(keys)
    numbered, path = settled(texts.mapInArrow(_symbols(sent), "symbols binary"), "symbols")
    sent.unpersist()
    columns = ", ".join(f"s{k} float" for k in range(states))
    sums = [F.sum(F.col(f"s{k}").cast("double")).alias(f"s{k}") for k in range(states)]
    for _ in range(rounds if tokens else 0):
        sent = spark.sparkContext.broadcast(model)
        # At most SYMBOLS + states + 2 rows come back.
        found = numbered.mapInArrow(_expect(sent), f"row long, {columns}").groupBy("row").agg(*sums).toArrow()
        sent.unpersist()
        table = np.zeros((len(share) + states + 1, states))
        table[found.column("row").to_numpy()] = np.stack([found.column(f"s{k}").to_numpy() for k in range(states)], axis=1)
        words, moves, starts = np.split(table, [len(share), len(share) + states])
        emit = words + weight * share[:, None]
        moves += 0.1
        starts = starts[0] + 0.1
        model |= {
            "emit": emit / emit.sum(axis=0), "move": moves / moves.sum(axis=1, keepdims=True),
            "start": starts / starts.sum()}
    discard(spark, path)
    return model, counts


def score(
    docs: DataFrame, is_training: Column | None = None, states: int = 8, rounds: int = 5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``is_training`` is a condition on ``doc_id``. Null texts are empty (one end
    token); a null id is kept and scored; repeated rows train as often as they
    occur and are scored alike; other columns are ignored; an empty table gives
    no rows. Counts of words that are no symbols come by a join.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.keyed(docs, id_col, text_col).withColumn("doc_id", common.real_id())
    training = F.lit(True) if is_training is None else is_training
    model, counts = train(spark, rows.where(training).select("text"), states, rounds)
    sent = spark.sparkContext.broadcast(model)
    scored, _ = settled(rows.select("k1", "k2", "text").mapInArrow(
        _score(sent), "k1 long, k2 long, n_tokens long, n_known long, base_score double, score double, tail array<long>"),
        "scored")
    # Each word's rows are added up per text before the counts are joined.
    tail = scored.where(F.size("tail") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("tail").alias("h"))
    rare = tail.groupBy("k1", "k2", "h").agg(F.count(F.lit(1)).alias("n")).join(counts, "h").groupBy("k1", "k2").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return scored.drop("tail").join(rare, ["k1", "k2"], "left").withColumn("doc_id", common.real_id()).select(
        "doc_id", (~training).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(model["tokens"])).cast("long").alias("train_tokens"),
        (F.col("base_score") + gain).alias("base_score"), (F.col("score") + gain).alias("score"))
