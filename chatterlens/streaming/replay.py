"""Replay of a stored table in fixed micro-batches.

Every row has a turn; the turns are written one after the other and read back
as a stream that takes one turn per batch. Which rows a batch holds is so known
before the stream runs, and cycles repeat the turns under rising batch numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatterlens.session import child_names, discard, settled, stored_bytes

#: Stored bytes that a file of a turn has at most, and so what one task writes or reads.
FILE_BYTES = 32 * 2**20


def _data_files(spark: SparkSession, path: str) -> int:
    return sum(name.startswith("part-") for name in child_names(spark, path))


def write_turns(rows: DataFrame, path: str, turn: Column, turns: int, cycles: int = 1, files: int = 1) -> None:
    """Batch ``cycle * turns + t`` gets the rows of turn ``t``, as exactly ``files``
    files: those that its rows don't fill are written empty, so a turn with few
    rows or none is a batch of its own too."""
    spark = rows.sparkSession
    marked = rows.withColumn("_turn", turn.cast("int"))
    for _ in range(cycles):
        for number in range(turns):
            own = marked.filter(F.col("_turn") == number).drop("_turn")
            before = _data_files(spark, path)
            (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(path)
            for _ in range(before + files - _data_files(spark, path)):
                own.limit(0).coalesce(1).write.mode("append").parquet(path)


def stream_turns(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """The turns as a stream, one per batch: files are taken in the order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def in_turns(
    rows: DataFrame, path: str, turn: Column, turns: int, cycles: int = 1, files: int | None = None,
) -> DataFrame:
    """The rows as a stream of turns. They are stored once by as many tasks as
    they come from; by their size a turn then gets as many ``files`` (unless
    given) as all rows need, so that no task holds more however they are dealt."""
    spark = rows.sparkSession
    kept, staged = settled(rows, "turns")
    if files is None:
        files = max(1, -(-stored_bytes(spark, staged) // FILE_BYTES))
    write_turns(kept, path, turn, turns, cycles, files)
    discard(spark, staged)
    return stream_turns(spark, path, rows.schema, files)
