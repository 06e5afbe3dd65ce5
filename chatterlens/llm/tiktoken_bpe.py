"""Byte-level BPE by tiktoken and a local rank file; decoding of raw bytes.

Long texts are cut before encoding at places that no match of the pattern can
cross: white space after something else. A stretch without such a place stays
whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlens.llm import common

#: From this many characters on a text is encoded in pieces.
LONG_TEXT = 100_000
#: A blank after an ASCII character that is not white space: a match boundary.
SAFE = re.compile(r"(?<=[!-~])(?= )")

ENCODED = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
    ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def load(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_kept: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    if (path, pattern) not in _kept:
        _kept[path, pattern] = load(path, pattern)
    return _kept[path, pattern]


def pieces(text: str, longest: int = LONG_TEXT) -> Iterator[str]:
    """The text in runs of at least ``longest`` characters, each but the last
    ended at the next safe place."""
    at = 0
    while len(text) - at > longest:
        found = SAFE.search(text, at + longest)
        if not found:
            break
        yield text[at: found.start()]
        at = found.start()
    yield text[at:] if at else text


def encode(coder, text: str, longest: int = LONG_TEXT) -> list[int]:
    return [i for piece in pieces(text, longest) for i in coder.encode_ordinary(piece)]


def _run(path: str, pattern: str, longest: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text").cast(pa.large_binary())
            for first in range(0, len(docs), 500):
                counts, kept, digests, decoded = [], [], [], []
                for value in texts.slice(first, 500).to_pylist():
                    ids = encode(coder, value.decode("utf-8", "replace"), longest)
                    counts.append(len(ids))
                    kept.append(ids if keep_ids else None)
                    digests.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(
                        [docs.slice(first, 500).to_pylist(), counts, kept, digests, decoded], _SCHEMA)], schema=_SCHEMA)
    return run


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, longest: int = LONG_TEXT, keep_ids: bool = True,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Ids of every text and digests of them and of their decoded bytes.

    One row per row: ``doc_id, n_tokens, ids`` (with ``keep_ids``),
    ``ids_sha256`` (decimal ids joined by one space) and ``decoded_sha256``. A
    null or empty text has no ids; a null id stays null; repeated rows give a
    row each; other columns are ignored; an empty table gives no rows. There is
    no shuffle: a task holds the batch it works on.
    """
    common.ship(docs.sparkSession)
    rows = common.text_rows(docs, id_col, text_col)
    done = rows.mapInArrow(_run(ranks_path, pattern, longest, keep_ids), ENCODED)
    return done if keep_ids else done.drop("ids")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The frame with ``decoded``, the raw bytes of an id list (null for null)."""
    common.ship(encoded.sparkSession)

    @F.pandas_udf("binary")
    def decoded(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoding(ranks_path, pattern)
        for ids in lists:
            yield ids.map(lambda x: None if x is None else coder.decode_bytes([int(i) for i in x]))
    return encoded.withColumn("decoded", decoded(ids_col))
