"""Batch-keyed tables: every micro-batch owns one folder.

A replayed batch overwrites its own folder, so results do not double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from chatterlens.session import child_names, discard

BATCH = "batch_id"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def earlier_batches(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What batches before this one have written; None at the start."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if batch_id == 0 or not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return read_batches(spark, path).filter(F.col(BATCH) < batch_id)


def batch_numbers(spark: SparkSession, path: str, name: str = BATCH) -> list[int]:
    """Numbers of the folders below a table, in order; no file is opened."""
    return sorted(int(n.split("=")[1]) for n in child_names(spark, path) if n.startswith(f"{name}="))


def drop_batches(spark: SparkSession, path: str, before: int, name: str = BATCH) -> None:
    """Remove the folders of batches before the given one."""
    for number in batch_numbers(spark, path, name):
        if number < before:
            discard(spark, f"{path}/{name}={number}")


def _base(path: str) -> str:
    return f"{path.rstrip('/')}-base"


def _latest(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    columns = [c for c in rows.columns if c not in (BATCH, *keys)]
    packed = F.max_by(F.struct(BATCH, *columns), F.col(BATCH)).alias("row")
    return rows.groupBy(*keys).agg(packed).select(*keys, "row.*")


def _with_base(spark: SparkSession, path: str, keys: tuple[str, ...], upto: int | None = None) -> DataFrame | None:
    """The newest row per key of the base and the batches after it."""
    folded = max(batch_numbers(spark, _base(path), "upto"), default=None)
    numbers = [n for n in batch_numbers(spark, path) if (folded is None or n > folded) and (upto is None or n <= upto)]
    parts = [] if folded is None else [spark.read.parquet(f"{_base(path)}/upto={folded}")]
    if numbers:
        fresh = spark.read.option("basePath", path).parquet(*[f"{path}/{BATCH}={n}" for n in numbers])
        parts.append(fresh.withColumn(BATCH, F.col(BATCH).cast("int")))
    if not parts:
        return None
    return _latest(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), keys)


def fold_batches(spark: SparkSession, path: str, keys: tuple[str, ...], upto: int) -> None:
    """One row per key of all batches up to ``upto`` becomes the base. The folders
    it replaces go once it is written; that of ``upto`` stays for a replay."""
    rows = _with_base(spark, path, keys, upto)
    if rows is None or upto in batch_numbers(spark, _base(path), "upto"):
        return
    rows.write.mode("overwrite").parquet(f"{_base(path)}/upto={upto}")
    drop_batches(spark, _base(path), upto, "upto")
    drop_batches(spark, path, upto)


def latest_values(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The newest row per key of an update-mode table: its base and the few batches after it."""
    return _with_base(spark, path, keys).drop(BATCH)


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest batch of a complete-mode table."""
    return spark.read.parquet(f"{path}/{BATCH}={batch_numbers(spark, path)[-1]}")


def start(
    stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str,
    mode: str = "append", every: str | None = None, name: str | None = None,
) -> StreamingQuery:
    """Start a stream; without ``every`` it processes what is there and ends."""
    writer = stream.writeStream.foreachBatch(on_batch).outputMode(mode)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
