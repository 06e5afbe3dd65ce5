"""Exact top-k by inner product, term at a time.

Vectors become blocks of rows once. A pair of a query block and a candidate
block is one unit of work: every dimension is a term whose postings (candidates
with a weight other than zero) are scattered, times the queries' weights, into
dense arrays of scores. A partition selection keeps each query's best of the
block, and the blocks' selections are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.llm import common
from chatterlens.session import settled

BLOCK = "block string, n int, width int, ids binary, weights binary"
HIT = "query_id long, query_row string, vec_id long, score long"


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, rows
            width = max(map(len, rows))
            dense = np.zeros((len(rows), width), dtype="<i8")
            for i, row in enumerate(rows):
                dense[i, : len(row)] = row
            out = pa.RecordBatch.from_pylist([{
                "block": f"{part}-{number}", "n": len(rows), "width": width,
                "ids": np.array(ids, dtype="<i8").tobytes(), "weights": dense.tobytes()}])
            number, ids, rows = number + 1, [], []
            return out.cast(pa.schema([
                ("block", pa.string()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()),
                ("weights", pa.binary())]))

        for batch in batches:
            for name, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(name)
                rows.append(row)
                if len(rows) == size:
                    yield flush()
        if rows:
            yield flush()
    return run


#: Queries and candidates of one strip of scores: 4 MB, and as much for its products.
STRIP = (256, 4096)


def score_type(queries: np.ndarray, candidates: np.ndarray) -> type:
    """The narrower integer type if no sum of products can leave it."""
    width = min(queries.shape[1], candidates.shape[1])
    most = [int(np.abs(m).max(initial=0)) for m in (queries, candidates)]
    return np.int32 if width * most[0] * most[1] < 2**31 and max(most) < 2**31 else np.int64


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, one term (dimension) after the other."""
    kind = score_type(queries, candidates)
    terms = min(queries.shape[1], candidates.shape[1])
    by_term = [np.ascontiguousarray(m[:, :terms].T, dtype=kind) for m in (queries, candidates)]
    used = [[np.flatnonzero(row) for row in m] for m in by_term]
    out = np.zeros((len(queries), len(candidates)), dtype=kind)
    for first in range(0, len(candidates), STRIP[1]):
        there = slice(first, first + STRIP[1])
        strip = out[:, there]
        product = np.empty(strip.shape, dtype=kind)
        for term in range(terms):
            rows, postings = used[0][term], used[1][term]
            if not len(rows) or not len(postings):
                continue
            if 2 * len(rows) > strip.shape[0] and 2 * len(postings) > len(candidates):
                # Nearly all rows hold the term: its zeros cost less than picking the rest.
                np.multiply(by_term[0][term][:, None], by_term[1][term][there], out=product)
                strip += product
            else:
                near = postings[(postings >= first) & (postings < first + STRIP[1])]
                strip[np.ix_(rows, near - first)] += np.multiply.outer(by_term[0][term][rows], by_term[1][term][near])
    return out


def _search(k: int):
    def matrix(x: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(x[f"{prefix}ids"], dtype="<i8")
        return ids, np.frombuffer(x[f"{prefix}weights"], dtype="<i8").reshape(len(ids), x[f"{prefix}width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = batch.slice(r, 1).to_pylist()[0]
                (qids, q), (cids, c) = matrix(x, "q_"), matrix(x, "")
                rows = np.frombuffer(x["q_rows"], dtype="<i8")
                home = x["q_block"] == x["block"]
                # Candidates by id, so that a stable order settles ties.
                order = np.argsort(cids, kind="stable")
                cids, c, place = cids[order], c[order], np.argsort(order, kind="stable")
                found = [[], [], [], []]
                for first in range(0, len(q), STRIP[0]):
                    s = scores(q[first: first + STRIP[0]], c)
                    for i, row in enumerate(s):
                        mine = int(rows[first + i])
                        keep = np.ones(len(row), dtype=bool)
                        if home:
                            keep[place[mine]] = False
                        if len(row) > k + 1:
                            least = np.partition(row, -k - 1)[-k - 1]
                            keep &= row >= least
                        some = np.flatnonzero(keep)
                        some = some[np.argsort(-row[some], kind="stable")][:k]
                        found[0] += [int(qids[first + i])] * len(some)
                        found[1] += [f"{x['q_block']}/{mine}"] * len(some)
                        found[2] += cids[some].tolist()
                        found[3] += row[some].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(found, (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    ["query_id", "query_row", "vec_id", "score"])
    return run


def _pick(condition_modulus: int):
    """Of every block, the rows that are queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids = np.frombuffer(x["ids"], dtype="<i8")
                rows = np.flatnonzero(ids % condition_modulus == 0)
                if not len(rows):
                    continue
                weights = np.frombuffer(x["weights"], dtype="<i8").reshape(len(ids), x["width"])[rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["block"]]), pa.array([x["width"]], pa.int32()), pa.array([ids[rows].tobytes()], pa.binary()),
                    pa.array([weights.tobytes()], pa.binary()), pa.array([rows.astype("<i8").tobytes()], pa.binary())],
                    ["q_block", "q_width", "q_ids", "q_weights", "q_rows"])
    return run


def clean(vectors: Column, scale: float) -> Column:
    """Components as ``floor(scale * x)``; null for a vector that is null or
    holds a null or non-finite component."""
    odd = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vectors, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return F.when(vectors.isNotNull() & ~odd, whole)


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, block: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` best of all other rows for every row whose id is divisible by
    ``every``: ``query_id, rank, vec_id, score``; ties to the smaller id.

    Rows without an id, or whose vector is null or holds a null or non-finite
    component, take no part; a missing component counts as zero; repeated rows
    are rows of their own (a copy of the query is a candidate, the query
    itself isn't); other columns are ignored; an empty table gives no rows. A
    task holds two blocks and a strip of their scores. Pairs of blocks meet by
    a key of both, so every pair is its own unit and none is hot.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), clean(F.col(vector_col), scale).alias("weights"),
    ).where("vec_id IS NOT NULL AND weights IS NOT NULL")
    table, _ = settled(rows.mapInArrow(_blocks(block), BLOCK), "vector-blocks")
    asked = table.mapInArrow(_pick(every), "q_block string, q_width int, q_ids binary, q_weights binary, q_rows binary")
    # The names of the blocks, a few bytes for thousands of rows.
    names = table.agg(F.collect_list("block")).scalar()
    left = table.withColumn("q_block", F.explode(names))
    right = asked.withColumn("block", F.explode(names))
    hits = left.join(right, ["block", "q_block"]).mapInArrow(_search(k), HIT)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
