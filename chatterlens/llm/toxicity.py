"""Toxicity by nearest labelled examples.

Terms are lower-cased words and their first 4, 5 and 6 bytes (word stems).
A bounded sample of labelled texts serves as examples, with all of their terms;
document frequencies of these are counted over all texts. The nearest examples of
either class by TF-IDF cosine are found exactly, with a block-max inverted index.
Terms that no example has cannot be shared and are left out of a text's vector.
Neighbours vote by their cosine, and by what of it comes from terms that are
significantly more frequent in toxic examples (chi-square). A logistic fit on further
labelled texts, which are not examples, turns the votes into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlens.llm import common, textbits
from chatterlens.session import settled

#: Labelled texts of each class that become examples, and as many to calibrate on.
SAMPLE = 2000
STEMS = (4, 5, 6)
#: Neighbours of each class that vote.
NEIGHBOURS = 15
#: Examples in a block of the index, and numbers of the sketch that orders them.
BLOCK, SKETCH = 32, 128
#: Terms of more than one in FREQUENT examples are laid out in blocks.
FREQUENT = 16
#: Blocks opened at first, in shares of those that ``k`` examples fill.
FIRST = 1
#: Texts searched for at a time.
TOGETHER = 128
#: Bytes of texts whose terms are taken at a time; about ten times as much lies in memory meanwhile.
AT_ONCE = 500_000
#: Steps from where a hash's highest bits lead, before halving.
NEAR = 12
#: Sums of single precision may be off by less than this share; what is within it is added up again in double.
SLACK = 1e-3
#: Votes enter the calibration as log(1 + STRETCH * vote).
STRETCH = 50.0
#: Least chi-square (one in a hundred by chance) of a term that tells the classes apart.
TELLING = 6.63

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[c for c in range(256) if c >= 0x80 or chr(c).isalnum()]] = True


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms and the text each belongs to."""
    buf, starts = textbits.joined(texts)
    buf = textbits.LOWER[buf]
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = WORD_BYTE[buf]
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    doc = np.searchsorted(starts, begin, side="right") - 1
    prefix = textbits.prefix_hash(buf)
    found, owner = [textbits.slice_hash(prefix, begin, end)], [doc]
    for size in STEMS:
        some = end - begin > size
        found.append(textbits.slice_hash(prefix, begin[some], begin[some] + size) ^ np.uint64(size))
        owner.append(doc[some])
    return np.concatenate(found), np.concatenate(owner)


def places(features: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes among the sorted distinct ``features``, and which are there.

    Hashes are spread evenly, so a table over their highest bits leads to within
    a few places of each; where many features share these bits, halving goes on.
    """
    if not len(features):
        return np.zeros(len(found), dtype=np.int64), np.zeros(len(found), dtype=bool)
    shift = np.uint64(64 - max(len(features).bit_length(), 1))
    ends = np.cumsum(np.bincount((features >> shift).astype(np.int64), minlength=1 << int(64 - shift)))
    part = (found >> shift).astype(np.int64)
    end = ends[part]
    place = np.where(part > 0, ends[part - 1], 0)
    left = np.flatnonzero(place < end)
    hit = np.zeros(len(found), dtype=bool)
    for _ in range(NEAR):
        there = features[place[left]]
        hit[left[there == found[left]]] = True
        left = left[there < found[left]]
        place[left] += 1
        left = left[place[left] < end[left]]
        if not len(left):
            return place, hit
    place[left] = np.searchsorted(features, found[left])
    inside = left[place[left] < len(features)]
    hit[inside] = features[place[inside]] == found[inside]
    return place, hit


def vectors(texts: list[bytes], features: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the features it has and how often; ``features`` is sorted."""
    found, owner = terms(texts)
    place, hit = places(features, found)
    keys, times = np.unique(owner[hit] * max(len(features), 1) + place[hit], return_counts=True)
    doc, feature = np.divmod(keys, max(len(features), 1))
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(feature[a:b], times[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def similar_first(x: np.ndarray, size: int) -> np.ndarray:
    """An order of rows that puts alike ones next to each other: halves along
    the direction of greatest spread, until a part has at most ``size`` rows."""
    order, parts = [], [np.arange(len(x))]
    while parts:
        part = parts.pop()
        if len(part) <= size:
            order.append(part)
            continue
        centred = x[part] - x[part].mean(axis=0)
        along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
        part = part[np.argsort(along, kind="stable")]
        # The left part is a multiple of the block.
        half = size * (-(-len(part) // size) // 2)
        parts += [part[half:], part[:half]]
    return np.concatenate(order) if order else np.zeros(0, dtype=np.int64)


class Index:
    """Examples as unit TF-IDF vectors in blocks of alike ones of one class.

    Per term it holds the postings. Terms of many examples are also laid out
    block by block, with the greatest weight in every block. These weights, on top
    of what the other terms add up to, bound the cosines in a block; blocks are
    opened by falling bound until none can hold one of the ``k`` best.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, names: np.ndarray, idf: np.ndarray):
        self.idf, self.blocks, self.greatest = idf, None, None
        feature = np.concatenate([np.zeros(0, dtype=np.int32), *(f for f, _ in rows)], dtype=np.int32)
        weight = np.concatenate([np.zeros(0), *(self.unit(*r) for r in rows)])
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f, _ in rows])
        sketch = np.zeros((len(rows), SKETCH))
        np.add.at(sketch, (owner, feature % SKETCH), weight)
        place, spot = 0, np.zeros(len(rows), dtype=np.int64)
        self.classes: list[tuple[int, int]] = []  # Blocks of each class.
        for label in (0, 1):
            own = np.flatnonzero(labels == label)
            own = own[np.argsort(names[own], kind="stable")]
            spot[own[similar_first(sketch[own], BLOCK)]] = place + np.arange(len(own))
            blocks = -(-len(own) // BLOCK)
            self.classes.append((place // BLOCK, place // BLOCK + blocks))
            place += blocks * BLOCK
        # Places of the examples in the blocks, and back; the last block of a class may have room left.
        self.names, self.spot, self.example = names, spot, np.full(place, -1, dtype=np.int64)
        self.example[spot] = np.arange(len(rows))
        order = np.lexsort((spot[owner], feature))
        self.rows, self.weights = spot[owner][order].astype(np.int32), weight[order].astype(np.float32)
        self.begin = np.searchsorted(feature[order], np.arange(len(idf) + 1)).astype(np.int32)
        frequent = np.flatnonzero(np.diff(self.begin) * FREQUENT > len(rows))
        self.frequent = np.full(len(idf), -1, dtype=np.int32)
        self.frequent[frequent] = np.arange(len(frequent))

    def lay_out(self) -> None:
        """The blocks of frequent terms; made where they are used, never sent."""
        terms = np.flatnonzero(self.frequent >= 0)
        posting, at = _ranges(self.begin[terms], self.begin[terms + 1], np.arange(len(terms)))
        row = self.rows[posting]
        self.blocks = np.zeros((len(self.example) // BLOCK, len(terms), BLOCK), dtype=np.float32)
        self.blocks[row // BLOCK, at, row % BLOCK] = self.weights[posting]
        self.greatest = self.blocks.max(axis=2).T.copy()
        self.rows = self.rows.astype(np.int64)

    def unit(self, features: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = (1 + np.log(times)) * self.idf[features]
        return w / np.sqrt((w * w).sum())

    def nearest(self, features: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the ``k`` best examples with a term in common."""
        return self._merged(*self.nearest_by_class([(features, times)], k)[0], k)

    def _merged(self, clean, toxic, k: int) -> tuple[np.ndarray, np.ndarray]:
        found, cosine = (np.concatenate(pair) for pair in zip(clean, toxic))
        order = np.lexsort((self.names[found], -cosine))[:k]
        return found[order], cosine[order]

    def nearest_by_class(
        self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, opened: list[np.ndarray] | None = None,
    ) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Per query and class (0, 1) the numbers and cosines of the ``k`` best
        examples with a term in common; of equal cosines the lesser id.
        ``opened`` is given which query opened which block."""
        if not len(self.rows):
            return [[(np.zeros(0, dtype=np.int64), np.zeros(0))] * 2 for _ in queries]
        if self.blocks is None:
            self.lay_out()
        terms, weights = [], []
        light = np.zeros((len(queries), self.blocks.shape[1]), dtype=np.float32)
        base = np.zeros((len(queries), len(self.example)))
        for i, (features, times) in enumerate(queries):
            q = self.unit(features, times) if len(features) else np.zeros(0)
            term = self.frequent[features]
            dense, rare = term >= 0, features[term < 0]
            terms.append(term[dense])
            weights.append(q[dense])
            light[i, terms[i]] = weights[i]
            posting, part = _ranges(self.begin[rare], self.begin[rare + 1], q[~dense])
            if len(posting):
                base[i] = np.bincount(self.rows[posting], part * self.weights[posting], len(self.example))
        score = base.reshape(len(queries), -1, BLOCK).copy()
        bound = score.max(axis=2) + light @ self.greatest
        floor, todo, step = np.zeros((len(queries), 2)), bound > 0, FIRST * -(-k // BLOCK)
        while todo.any():
            now = np.zeros_like(todo)
            for a, b in self.classes:
                # The best blocks of a class not opened yet.
                best = np.argsort(np.where(todo[:, a:b], -bound[:, a:b], 0), axis=1, kind="stable")[:, :step]
                np.put_along_axis(now[:, a:b], best, True, axis=1)
            now &= todo
            for block in np.flatnonzero(now.any(axis=0)):
                which = np.flatnonzero(now[:, block])
                score[which, block] += light[which] @ self.blocks[block]
            if opened is not None:
                opened.append(now)
            todo &= ~now
            for c, (a, b) in enumerate(self.classes):
                if (b - a) * BLOCK >= k:
                    own = score[:, a:b].reshape(len(queries), -1)
                    floor[:, c] = np.partition(own, -k, axis=1)[:, -k] * (1 - SLACK)
                todo[:, a:b] &= bound[:, a:b] >= floor[:, c, None]
            step = len(self.blocks)
        return [
            [self._exact(base[i], score[i], a, b, floor[i, c], terms[i], weights[i], k) for c, (a, b) in enumerate(self.classes)]
            for i in range(len(queries))]

    def _exact(self, base, score, a, b, floor, term, weight, k) -> tuple[np.ndarray, np.ndarray]:
        """The best of the blocks from ``a`` to ``b``, with cosines in double precision."""
        own = a * BLOCK + np.flatnonzero(score[a:b].ravel() >= max(floor, 1e-30))
        cells = self.blocks[(own // BLOCK)[:, None], term, (own % BLOCK)[:, None]]
        exact = base[own] + (weight * cells).sum(axis=1)
        found = self.example[own]
        order = np.lexsort((self.names[found], -exact))[:k]
        return found[order], exact[order]

    def votes(
        self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, telling: np.ndarray,
    ) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per query what the calibration sees, and the numbers of the ``k``
        nearest. Seen are the votes of either class's neighbours: by cosine, and by
        what of it comes from terms that tell the classes apart (``telling``: their weight)."""
        seen, nearest = np.zeros((len(queries), 4)), []
        for start in range(0, len(queries), TOGETHER):
            some = queries[start:start + TOGETHER]
            for i, (clean, toxic) in enumerate(self.nearest_by_class(some, k), start):
                features, times = queries[i]
                told = telling[features] > 0
                if told.any():
                    weight = self.unit(features, times)[told] * telling[features[told]]
                    posting, part = _ranges(self.begin[features[told]], self.begin[features[told] + 1], weight)
                    shared = np.bincount(self.rows[posting], part * self.weights[posting], len(self.example))
                    seen[i, 2:] = [shared[self.spot[found]].sum() / k for found, _ in (toxic, clean)]
                seen[i, :2] = toxic[1].sum() / k, clean[1].sum() / k
                nearest.append(self._merged(clean, toxic, k)[0])
        return np.log1p(STRETCH * seen), nearest


def _ranges(first: np.ndarray, last: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the given ranges, and each range's value for all of its numbers."""
    count = last.astype(np.int64) - first
    upto = np.cumsum(count)
    return np.repeat(first - upto + count, count) + np.arange(upto[-1] if len(upto) else 0), np.repeat(value, count)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Coefficients (last: intercept) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def chi_square(a: np.ndarray, c: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Of terms in ``a`` of ``pos`` toxic and ``c`` of ``neg`` other texts; 0 if it is not defined."""
    below = float(pos) * neg * (a + c) * (pos + neg - a - c)
    return (a * neg - c * pos) ** 2 * (pos + neg) / np.where(below > 0, below, np.inf)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as slices of one array."""
    flat = pa.concat_arrays([pa.array([], column.type), *column.chunks])
    return np.split(flat.flatten().to_numpy(), flat.offsets.to_numpy()[1:-1] - flat.offsets[0].as_py()) if len(flat) else []


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in textbits.blocks(batch.column("text"), AT_ONCE):
            found, owner = terms(texts)
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(len(texts) + 1))
            lists = [np.unique(found[order[a:b]]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).slice(first, len(texts)) for c in ("doc_id", "role", "toxic", "text")),
                pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "role", "toxic", "text", "terms"])


def _frequencies(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(features) + 1, dtype=np.int64), 0
        for batch in batches:
            for _, texts in textbits.blocks(batch.column("text"), AT_ONCE):
                for found, _ in vectors(texts, features):
                    df[found] += 1
                n += len(texts)
        df[-1] = n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["f", "df"])
    return run


def _probabilities(texts: list[bytes], model: dict) -> tuple[np.ndarray, list[list[int]]]:
    index, b = model["index"], model["coefficients"]
    x, places = index.votes(vectors(texts, model["features"]), model["neighbours"], model["telling"])
    return 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30))), [index.names[p].tolist() for p in places]


def _votes(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first, texts in textbits.blocks(batch.column("text"), AT_ONCE):
                x, _ = model["index"].votes(vectors(texts, model["features"]), model["neighbours"], model["telling"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(first, len(texts)), *(pa.array(x[:, i]) for i in range(4))],
                    ["toxic", "x0", "x1", "x2", "x3"])
    return run


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in textbits.blocks(batch.column("text"), AT_ONCE):
                p, evidence = _probabilities(texts, sent.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), pa.array(p), pa.array(evidence, pa.list_(pa.int64()))],
                    ["doc_id", "score", "evidence"])
    return run


def _drawn(labels: DataFrame, toxic: int, role: int, sample: int) -> DataFrame:
    """At most ``sample`` ids of a class, by a hash of the id; roles are disjoint."""
    mark = F.xxhash64("doc_id", F.lit("draw"))
    return labels.where((F.col("toxic") == toxic) & (F.pmod(mark, F.lit(2)) == role)).orderBy(mark, "doc_id").limit(
        sample).select("doc_id", "toxic", F.lit(role).alias("role"))


def fit(
    docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, sample: int = SAMPLE,
    neighbours: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text",
):
    """The model of :func:`score` and :func:`without_toxic`, sent to all tasks.

    ``labels`` has ``doc_id`` and ``toxic``; ``may_learn`` is a condition on
    ``doc_id``. Null ids are never learned from; of contradicting labels the
    toxic one counts, of several texts under one id the least. Without labels of both classes the model gives every text
    the share of label 1 (0 without any). What travels to tasks and the driver
    are the terms of at most four times ``sample`` texts.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.text_rows(docs, id_col, text_col)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id IS NOT NULL AND toxic IS NOT NULL")
    if may_learn is not None:
        known = known.where(may_learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = [_drawn(known, t, r, sample) for t in (0, 1) for r in (0, 1)]
    # At most four times ``sample`` ids, whatever the tables hold.
    chosen = drawn[0].union(drawn[1]).union(drawn[2]).union(drawn[3])
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min(F.struct("text", "role", "toxic")).alias("one")).select("doc_id", "one.role", "one.toxic", "one.text")
    learned, _ = settled(texts.mapInArrow(
        _terms_of, "doc_id long, role int, toxic int, text string, terms array<long>"), "examples")
    known_terms = learned.where("role = 0").select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c")).toArrow()
    every, a, c = (known_terms.column(x).to_numpy() for x in ("term", "a", "c"))
    order = np.argsort(every.view(np.uint64))
    every, a, c = every.view(np.uint64)[order], a[order].astype(np.float64), c[order].astype(np.float64)
    counted = rows.select("text").mapInArrow(_frequencies(every), "f long, df long").groupBy("f").agg(
        F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(every) + 1)
    df[counted.column("f").to_numpy()] = counted.column("df").to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    small = learned.where("role = 0").select("doc_id", "toxic", "text").mapInArrow(
        _sparse(every), "doc_id long, toxic int, f array<int>, n array<int>").toArrow().sort_by("doc_id")
    sparse = list(zip(*(_lists(small.column(x)) for x in ("f", "n"))))
    toxic, names = (small.column(x).to_numpy().astype(np.int64) for x in ("toxic", "doc_id"))
    pos, neg = toxic.sum(), (1 - toxic).sum()
    chi = chi_square(a, c, pos, neg)
    telling = np.where((chi >= TELLING) & (a * neg > c * pos), np.sqrt(chi), 0).astype(np.float32)
    model = {"index": Index(sparse, toxic, names, idf), "features": every, "neighbours": neighbours, "telling": telling}
    del small, sparse, known_terms, counted, a, c, chi, df, order
    common.give_back()
    sent = spark.sparkContext.broadcast(model)
    seen = learned.where("role = 1").select("toxic", "text").mapInArrow(
        _votes(sent), "toxic int, x0 double, x1 double, x2 double, x3 double").toArrow()
    sent.destroy()
    everything = share.get(0, 0) + share.get(1, 0)
    prior = (share.get(1, 0) + 1e-6) / (everything + 1e-3) if everything else 1e-6
    coefficients = np.array([0.0, 0.0, 0.0, 0.0, np.log(prior / max(1 - prior, 1e-6))])
    y = seen.column("toxic").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        x = np.column_stack([seen.column(f"x{i}").to_numpy() for i in range(4)])
        order = np.lexsort((*x.T, y))  # The sums don't depend on the order of rows.
        x, y = x[order], y[order]
        # Classes weigh as much as they occur among all labels.
        weight = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum())
        coefficients = fit_logistic(x, y, weight / weight.mean())
    return spark.sparkContext.broadcast({**model, "coefficients": coefficients})


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, evidence`` for every row.

    ``score`` is the probability of label 1, ``predicted`` is 1 from 0.5 on,
    ``evidence`` the ids of the nearest examples. Null and empty texts, and
    texts without a term of any example, have no neighbours and get the score of such
    texts; null ids stay null; repeated rows are scored alike; an empty table
    gives no rows; other columns are ignored. There is no shuffle.
    """
    return common.text_rows(docs, id_col, text_col).mapInArrow(
        _score(model), "doc_id long, score double, evidence array<long>").select(
        "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below 0.5."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            keep = []
            for _, texts in textbits.blocks(batch.column(text_col), AT_ONCE):
                keep += (_probabilities(texts, m)[0] < 0.5).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))
        # The worker may stay idle beside the next stages' tasks.
        common.give_back()
    return docs.mapInArrow(run, docs.schema)


def _sparse(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in textbits.blocks(batch.column("text"), AT_ONCE):
                made = vectors(texts, features)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(first, len(texts)) for c in ("doc_id", "toxic")),
                    pa.array([f for f, _ in made], pa.list_(pa.int32())), pa.array([n for _, n in made], pa.list_(pa.int32()))],
                    ["doc_id", "toxic", "f", "n"])
    return run
