"""Near-duplicate texts: minima of universal hashes, bands, verification on
full sets and connected components.

Texts with the same set of shingles are one class from the start. The classes
of a band's bucket are tied to the least of them, which gives groups of
candidates without writing out pairs. Members of a group meet once, with their
full sets, in units of bounded size; a member is checked against all others of
its unit at once, and a unit hands on only as many confirmed links as its
components need. Alternating large-star and small-star joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlens.llm import common, textbits
from chatterlens.llm.components import components
from chatterlens.session import settled

#: Bytes of sets on one side of a unit of work; a larger group is split into
#: units of two sides each.
UNIT = 24_000_000
SIGNED = "k1 long, k2 long, n_shingles long, s1 long, s2 long, bands array<long>"


def coefficients(minima: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift functions of 32-bit keys: random odd a and random b."""
    make = np.random.Generator(np.random.PCG64(seed))
    a, b = make.integers(0, 2**64, size=(2, minima), dtype=np.uint64)
    return a | np.uint64(1), b


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of every hash function over every set (rows: sets)."""
    out = np.full((len(sets), len(a)), 0xFFFFFFFF, dtype=np.uint32)
    sizes = np.array([len(s) for s in sets])
    some = np.flatnonzero(sizes)
    at = 0
    while at < len(some):
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[some[at:]]), 30_000, side="right")))
        rows = some[at:stop]
        keys = np.concatenate([sets[i] for i in rows]) & np.uint64(0xFFFFFFFF)
        first = np.cumsum(sizes[rows]) - sizes[rows]
        for p in range(len(a)):
            out[rows, p] = np.minimum.reduceat(keys * a[p] + b[p], first) >> np.uint64(32)
        at = stop
    return out


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(bands * rows)
        for batch in batches:
            for first, texts in textbits.blocks(batch.column("text"), 500_000):
                sets = textbits.shingle_hashes(*textbits.word_hashes(texts), size)
                low = minima(sets, a, b)
                keys = np.zeros((len(sets), bands), dtype=np.uint64)
                for r in range(rows):
                    keys = textbits.mix(keys ^ low[:, r::rows].astype(np.uint64)) * np.uint64(textbits.BASE)
                keys = textbits.mix(keys + np.arange(bands, dtype=np.uint64))
                some = np.array([len(s) for s in sets]) > 0
                s1 = np.array([s.sum(dtype=np.uint64) for s in sets]).view(np.int64)
                s2 = np.array([textbits.mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column("k1").slice(first, len(texts)), batch.column("k2").slice(first, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                    pa.array([k.tolist() if full else [] for k, full in zip(keys.view(np.int64), some)], pa.list_(pa.int64())),
                ], ["k1", "k2", "n_shingles", "s1", "s2", "bands"])
    return run


def spanning_links(sets: list[np.ndarray], signatures: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what all links above the threshold join.

    A member is compared with all others at once: those whose signatures agree
    in nearly as many minima as the threshold asks (five standard deviations
    less) are confirmed on full sets, by adding up the postings of its
    shingles. Members are compared until those left all lie in one
    component, so every link is either seen or within a component.
    """
    share = percent / 100
    least = share - 5 * (share * (1 - share) / signatures.shape[1]) ** 0.5
    sizes = np.array([len(s) for s in sets])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(term, kind="stable")
    posting = owner[order]
    first = np.searchsorted(term[order], np.arange(term.max() + 2))
    start = np.cumsum(sizes) - sizes
    comp, done, links = np.arange(len(sets)), np.zeros(len(sets), dtype=bool), []
    while True:
        left = np.flatnonzero(~done)
        names, counts = np.unique(comp[left], return_counts=True)
        if len(names) < 2:
            return links
        outside = left[comp[left] != names[np.argmax(counts)]]
        x = int(left[0]) if not links and not done.any() else int(outside[0])
        done[x] = True
        alike = (signatures == signatures[x]).mean(axis=1) >= least
        alike[x] = False
        if not alike.any():
            continue
        mine = term[start[x]: start[x] + sizes[x]]
        length = first[mine + 1] - first[mine]
        ends = np.cumsum(length)
        places = np.arange(int(ends[-1])) + np.repeat(first[mine] - (ends - length), length)
        both = np.bincount(posting[places], minlength=len(sets))
        near = alike & (100 * both >= percent * (sizes + sizes[x] - both))
        # One link to each component that x touches is enough.
        found, at = np.unique(comp[near], return_index=True)
        rows = np.flatnonzero(near)[at]
        links += [(x, int(y)) for y in rows if comp[y] != comp[x]]
        comp[np.isin(comp, found)] = comp[x]


def _sets(size: int, count: int):
    """Sets and signatures of candidates, one row for each unit of work they belong to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(count)
        for batch in batches:
            cids, groups, blocks = (batch.column(c).to_pylist() for c in ("cid", "group", "blocks"))
            for at, texts in textbits.blocks(batch.column("text"), 500_000):
                out = [[] for _ in range(6)]
                sets = textbits.shingle_hashes(*textbits.word_hashes(texts), size)
                low = minima(sets, a, b).astype(np.uint8)
                for i, own in enumerate(sets, at):
                    mine = cids[i] % blocks[i]
                    raw = own.tobytes()
                    for other in range(blocks[i]):
                        for column, value in zip(out, (groups[i], min(mine, other), max(mine, other), cids[i], raw, low[i - at].tobytes())):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])],
                    ["group", "lo", "hi", "cid", "set", "sig"])
    return run


def _link(percent: int):
    """Spanning links of every unit; rows come sorted by unit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, {}

        def result() -> pa.RecordBatch:
            cids = list(held)
            sets, signatures = zip(*held.values())
            pairs = spanning_links(list(sets), np.stack(signatures), percent)
            return pa.RecordBatch.from_arrays([
                pa.array([cids[x] for x, _ in pairs], pa.int64()), pa.array([cids[y] for _, y in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("group", "lo", "hi"))))
            for key, cid, raw, sig in zip(keys, batch.column("cid").to_pylist(), batch.column("set"), batch.column("sig")):
                if key != unit:
                    if len(held) > 1:
                        yield result()
                    unit, held = key, {}
                held[cid] = np.frombuffer(raw.as_buffer(), dtype=np.uint64), np.frombuffer(sig.as_buffer(), dtype=np.uint8)
        if len(held) > 1:
            yield result()
    return run


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, text_key`` (a hash of the text)``, n_shingles, component_id,
    component_key, kept`` for every row.

    Two texts are linked if ``100 * |intersection| >= percent * |union|`` of
    their sets of ``shingle``-word shingles; a text of fewer words is one
    shingle; one without words has none and no link. ``component_id`` is the
    least id reachable, ``component_key`` the least text key under that id, ``kept``
    marks rows that carry the id.

    Null ids take part in no link and are kept with a null component; repeated
    rows, and different texts under one id, are rows of their own; an empty
    table gives no rows; other columns are ignored. A pair at the threshold
    shares no band with probability ``(1 - (percent/100) ** rows) ** bands``
    (5e-8 for the defaults); nothing is capped.
    """
    spark = docs.sparkSession
    common.ship(spark)
    keyed = common.keyed(docs, id_col, text_col)
    signed, _ = settled(keyed.mapInArrow(_sign(shingle, bands, rows), SIGNED), "signed")
    real = signed.where((F.col("n_shingles") > 0) & (F.col("k1") != common.NO_ID))
    first = F.min_by(F.col("bands"), F.struct("k1", "k2"))
    classes, _ = settled(real.groupBy("s1", "s2", "n_shingles").agg(
        F.min(F.struct("k1", "k2")).alias("key"), first.alias("bands"),
    ).select(
        "s1", "s2", F.col("n_shingles").alias("n"), "key.k1", "key.k2", "bands",
        F.xxhash64("s1", "s2").alias("cid")), "classes")
    place = classes.select("cid", F.posexplode("bands").alias("band", "h")).select(
        "cid", F.xxhash64("band", "h").alias("bucket"))
    hubs, _ = settled(place.groupBy("bucket").agg(
        F.min("cid").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members"), "hubs")
    stars = place.join(hubs, "bucket").where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    groups, _ = settled(components(stars).select(
        F.col("node").alias("cid"), F.col("component").alias("group")).join(classes.drop("bands", "s1", "s2"), "cid"), "groups")
    sizes, _ = settled(groups.groupBy("group").agg(
        F.ceil(8 * F.sum("n") / UNIT).cast("int").alias("blocks")), "group-sizes")
    chosen = groups.join(sizes, "group").select("k1", "k2", "cid", "group", "blocks")
    sets = keyed.join(chosen, ["k1", "k2"]).mapInArrow(
        _sets(shingle, bands * rows), "group long, lo int, hi int, cid long, set binary, sig binary")
    unit = ["group", "lo", "hi"]
    links, _ = settled(sets.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(
        _link(percent), "a long, b long"), "links")
    comp, _ = settled(components(links).select(F.col("node").alias("cid"), F.col("component").alias("comp")), "comp")
    least = comp.join(classes.select("cid", "k1", "k2"), "cid").groupBy("comp").agg(F.min(F.struct("k1", "k2")).alias("least"))
    found = comp.join(least, "comp").select("cid", "least")
    ids = classes.join(found, "cid", "left").select("s1", "s2", F.coalesce("least", F.struct("k1", "k2")).alias("least"))
    result = signed.select("k1", F.col("k2").alias("text_key"), "n_shingles", F.when(
        (F.col("n_shingles") > 0) & (F.col("k1") != common.NO_ID), F.col("s1")).alias("s1"), "s2").join(
        ids, ["s1", "s2"], "left")
    own = common.real_id()
    return result.select(
        own.alias("doc_id"), "text_key", "n_shingles", F.coalesce("least.k1", own).alias("component_id"),
        F.coalesce("least.k2", "text_key").alias("component_key"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
