"""Which months of a stored table hold an id.

The index lies beside the table, in folders by a hash of the id, one row per id
and month. Ids that come in open the folders of their own hashes only. An entry
may outlive its row (retention and clearing leave it): it then names a month
too many, which costs a look and changes no result. Entries are written before
the rows they point to, so a job that dies between leaves none out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatterlens.session import child_names, discard, settled

#: Folders of an index, fixed once it is begun. Their numbers may be collected, so this
#: also bounds that list.
BUCKETS = 16
BUCKET, MONTH = "id_bucket", "month"


def folder(path: str) -> str:
    return f"{path.rstrip('/')}-ids"


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(BUCKETS)).cast("int")


def _entries(rows: DataFrame, key: str, *more: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), *more).where("id IS NOT NULL").distinct().withColumn(BUCKET, bucket(F.col("id")))


def known(spark: SparkSession, path: str) -> bool:
    return any(name.startswith(f"{BUCKET}=") for name in child_names(spark, folder(path)))


def record(rows: DataFrame, path: str, key: str) -> None:
    """Add the ids and months of ``rows`` (with a ``month`` column)."""
    _entries(rows, key, MONTH).repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(folder(path))


def _buckets_of(ids: DataFrame, key: str) -> list[int]:
    """At most BUCKETS numbers."""
    return [row[0] for row in ids.where(F.col(key).isNotNull()).select(bucket(F.col(key)).alias("b")).distinct().collect()]


def _schema(ids: DataFrame, key: str, *more: str) -> str:
    """Declared, so that no file is opened to find it."""
    return ", ".join([f"id {ids.schema[key].dataType.simpleString()}", *more, f"{BUCKET} int"])


def entries_of(spark: SparkSession, path: str, ids: DataFrame, key: str) -> DataFrame:
    """``id, month`` of the given ids, from the folders of their hashes."""
    rows = spark.read.schema(_schema(ids, key, f"{MONTH} string")).parquet(folder(path))
    wanted = ids.select(F.col(key).alias("id")).distinct()
    return rows.filter(F.col(BUCKET).isin(_buckets_of(ids, key))).join(wanted, "id", "left_semi").select("id", MONTH)


def compact(spark: SparkSession, path: str) -> None:
    """One file per folder, each entry once; folders are swapped as a whole."""
    rows = spark.read.parquet(folder(path)).distinct()
    whole, staged = settled(rows, "ids")
    whole.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        BUCKET).parquet(folder(path))
    discard(spark, staged)


# --- ids by micro-batch --------------------------------------------------------

def record_batch(rows: DataFrame, path: str, key: str, batch_id: int) -> None:
    """The ids a micro-batch stores; run again, it replaces them."""
    _entries(rows, key).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(
        f"{folder(path)}/batch_id={batch_id}")


def earlier_ids(spark: SparkSession, path: str, ids: DataFrame, key: str, batch_id: int) -> DataFrame | None:
    """Ids in the folders of the given ids' hashes that batches before this one have stored."""
    batches = [n for n in child_names(spark, folder(path)) if n.startswith("batch_id=") and int(n.split("=")[1]) < batch_id]
    if not batches:
        return None
    rows = spark.read.schema(_schema(ids, key, "batch_id int")).option("basePath", folder(path)).parquet(
        *[f"{folder(path)}/{n}" for n in batches])
    return rows.filter(F.col(BUCKET).isin(_buckets_of(ids, key))).select(F.col("id").alias(key))
