"""What the operators share: shipping this package to executors, reading
tables, row keys and the pieces of the registry."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Stands for a null id inside joins and sorts.
NO_ID = -(2**63)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return register


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, as ``--py-files`` would.
    The archive is handed to Spark's own file service; nothing reads it from
    the driver's disk afterwards."""
    context = spark.sparkContext
    if getattr(context, "_chatterlens_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="chatterlens-"), "chatterlens_llm.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder in (top, os.path.join(top, "llm")):
            for name in sorted(os.listdir(folder)):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._chatterlens_shipped = True


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside send their rows to Python in batches of ``rows``: whole
    texts are long, and each batch lies in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Hand memory of dropped Arrow tables and arrays back, between stages of a long job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    # What the C library keeps of freed arrays, where it has a call for that.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty), so that no extra column of
    the input can clash with an operator's own."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows with a key that a second reading of the input gives again:
    ``k1`` the id (NO_ID if null), ``k2`` a hash of the text. Rows that share
    both are copies of one row and share every result."""
    rows = text_rows(docs, id_col, text_col)
    return rows.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), F.xxhash64("text").alias("k2"), "text")


def real_id(key: str = "k1") -> Column:
    return F.when(F.col(key) != NO_ID, F.col(key))


def crc_mod(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def rows_by_key(docs: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose key is (``left_semi``) or
    isn't (``left_anti``) in ``keys``: ``doc_id, text_key``, a hash of the text."""
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    there = keys.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__k1"), F.col("text_key").alias("__k2")).distinct()
    return docs.join(there, (own == F.col("__k1")) & (text == F.col("__k2")), how)
