"""Stores that several queries read, built once per session and state of the input files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from chatterlens.session import file_marks, scratch

_built: dict[tuple, str] = {}


def stored(spark: SparkSession, folder: str, name: str, inputs: tuple[str, ...], build: Callable[[str], None]) -> str:
    """Path of the store ``name`` over the tables ``inputs`` of a data folder. It
    is built in the shared folder when the files of these tables are new."""
    marks = file_marks(spark, [f"{folder}/{table}.parquet" for table in inputs])
    key = spark.sparkContext.applicationId, name, folder, marks
    if key not in _built:
        path = scratch(spark, name)
        build(path)
        _built[key] = path
    return _built[key]
