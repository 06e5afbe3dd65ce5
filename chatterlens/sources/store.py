"""Monthly partitioned Parquet tables: append, upsert, retention, clearing."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from chatterlens import schemas
from chatterlens.functions import scalars as sc
from chatterlens.operators import filters, joins
from chatterlens.session import discard, settled
from chatterlens.sources import id_index

MONTH = "month"
# Sort keys and bloom-filter columns of the stored tables.
LAYOUT = {
    "comments": (("program_id", "timestamp", "comment_id"), ("program_id", "comment_id")),
    "metrics": (("program_id", "timestamp"), ("program_id",)),
    "aggregates": (("program_id", "timestamp", "topic"), ("program_id", "topic")),
    "anomalies": (("program_id", "timestamp"), ("program_id",)),
    "trends": (("time_window_minutes", "timestamp", "mention_count"), ("topic",)),
}


# The ids by which rows are replaced.
KEYS = {"comments": "comment_id"}


# --- writing ----------------------------------------------------------------

def _laid_out(df: DataFrame, table: str, ts: str) -> DataFrame:
    """Month column, then ranges of (month, sort key): a busy month spreads over
    many tasks and files, each with narrow min/max statistics."""
    keys, _ = LAYOUT[table]
    rows = df.withColumn(MONTH, sc.month_key(ts))
    return rows.repartitionByRange(MONTH, *keys).sortWithinPartitions(MONTH, *keys)


def _writer(df: DataFrame, table: str, mode: str):
    writer = df.write.mode(mode).partitionBy(MONTH)
    for column in LAYOUT[table][1]:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer


def append(df: DataFrame, path: str, table: str, ts: str = "timestamp") -> None:
    """Add rows. Where the table has an index of ids, theirs are added first."""
    key = KEYS.get(table)
    if key in df.columns and id_index.known(df.sparkSession, path):
        id_index.record(df.withColumn(MONTH, sc.month_key(ts)), path, key)
    _writer(_laid_out(df, table, ts), table, "append").parquet(path)


def index_ids(spark: SparkSession, path: str, key: str) -> None:
    """Index the ids of a stored table, if it isn't yet: its only scan of all keys."""
    if exists(spark, path) and not id_index.known(spark, path):
        id_index.record(read(spark, path), path, key)


def insert_new(df: DataFrame, path: str, table: str, ts: str = "timestamp") -> None:
    """Append the rows whose id is not stored yet, one per id; only the index
    folders of these ids are read."""
    spark, key = df.sparkSession, KEYS[table]
    index_ids(spark, path, key)
    fresh = df.dropDuplicates([key])
    if id_index.known(spark, path):
        fresh = joins.not_stored(df, id_index.entries_of(spark, path, df, key).withColumnRenamed("id", key), key)
    staged, place = settled(fresh, "insert")
    id_index.record(staged.withColumn(MONTH, sc.month_key(ts)), path, key)
    _writer(_laid_out(staged, table, ts), table, "append").parquet(path)
    discard(spark, place)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The declared columns; a missing one becomes NULL, a missing array empty."""
    def column(field) -> Column:
        known = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = known.cast(field.dataType)
        empty = isinstance(field.dataType, ArrayType) and field.name != "labels"
        value = F.coalesce(value, F.array().cast(field.dataType)) if empty else value
        return value.alias(field.name)
    return df.select(*[column(f) for f in schema.fields])


def append_comments(df: DataFrame, path: str) -> None:
    append(conform(df, schemas.COMMENT), path, "comments")


def append_metrics(metrics: DataFrame, path: str, ts: str = "window_start") -> None:
    append(conform(metrics.withColumn("timestamp", F.col(ts).cast("timestamp")), schemas.METRIC), path, "metrics")


def append_aggregates(topics: DataFrame, path: str, ts: str = "hour_start") -> None:
    rows = topics.select(
        "program_id", F.col(ts).cast("timestamp").alias("timestamp"), "topic",
        F.col("mention_count").alias("count"),
        (F.col("sentiment_sum") / F.col("mention_count")).alias("avg_sentiment"),
    )
    append(rows, path, "aggregates")


def append_anomalies(found: DataFrame, path: str) -> None:
    rows = found.select(
        "program_id", F.col("timestamp").cast("timestamp"), "metric",
        F.col("metric_value").alias("value"), F.col("expected_value").alias("expected"),
        F.col("deviation_pct").alias("deviation"), "severity",
    )
    append(rows, path, "anomalies")


def stamped_for_training(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "consumed_at": F.current_timestamp(), "is_used_for_training": F.lit(False),
        "used_at": F.lit(None).cast("timestamp"),
    })


def stamped_as_submitted(df: DataFrame, source: str) -> DataFrame:
    return df.withColumns({
        "source": F.lit(source), "created_at": F.current_timestamp(),
        "labels": F.array().cast(schemas.LABELS),
    })


def stamped_as_stored(df: DataFrame) -> DataFrame:
    return df.withColumn("stored_at", F.current_timestamp())


# --- reading ----------------------------------------------------------------

def read(spark: SparkSession, path: str, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """Rows of an inclusive range; the month bounds prune partitions."""
    rows = spark.read.parquet(path)
    rows = rows.withColumn(MONTH, F.col(MONTH).cast("string"))
    if start is not None:
        rows = rows.filter(F.col(MONTH) >= sc.month_key(F.lit(start)))
    if end is not None:
        rows = rows.filter(F.col(MONTH) <= sc.month_key(F.lit(end)))
    return filters.in_range(rows, start, end, ts)


# --- changing ---------------------------------------------------------------

def comparable(value: Column, kind: DataType) -> Column:
    """The value with every map in it, however deep, as its entries sorted by
    key: maps themselves can be neither hashed nor ordered."""
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(
            e["key"].alias("key"), comparable(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda item: comparable(item, kind.elementType))
    if isinstance(kind, StructType):
        fields = [comparable(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns, the same for equal rows whatever the order of their maps."""
    return F.xxhash64(*[comparable(F.col(f.name), f.dataType) for f in df.schema.fields])


def last_wins(df: DataFrame, key: str, version: str) -> DataFrame:
    """The newest version per id, by partial aggregation: many copies of one id
    collapse before the shuffle. Of equal versions the one labeled last wins,
    then the greatest hash of the row."""
    order = [version, *(c for c in ("predicted_at",) if c in df.columns), row_hash(df)]
    packed = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(F.col(key).alias("_key")).agg(packed).select("row.*")


def _months(df: DataFrame) -> list[str]:
    """Distinct months, a list bounded by the time span of the table."""
    return [row[0] for row in df.select(MONTH).distinct().collect()]


def _stored_months(spark: SparkSession, path: str) -> list[str]:
    """Months of a stored table from its folder names; no file is opened."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [status.getPath().getName() for status in found]
    return sorted(n.removeprefix(f"{MONTH}=") for n in names if n.startswith(f"{MONTH}="))


def _drop_months(spark: SparkSession, path: str, months: list[str]) -> None:
    jvm = spark._jvm.org.apache.hadoop.fs
    for month in months:
        folder = jvm.Path(f"{path}/{MONTH}={month}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _replace_months(spark: SparkSession, rows: DataFrame, path: str, table: str, months: list[str]) -> None:
    """Write ``rows`` over the given months. Spark stages the files and swaps
    whole partitions at commit; months left without rows are removed after it.
    The months written are observed during the write, not by a second pass."""
    keys, _ = LAYOUT[table]
    written = Observation()
    out = (
        rows.repartitionByRange(MONTH, *keys).sortWithinPartitions(MONTH, *keys)
        .observe(written, F.collect_set(MONTH).alias("months"))
    )
    _writer(out, table, "overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    _drop_months(spark, path, [m for m in months if m not in set(written.get["months"])])


def upsert(
    new: DataFrame, path: str, table: str, key: str, version: str, ts: str = "timestamp",
) -> None:
    """Insert or replace rows by id, last version wins; only months that hold
    old or new versions of the ids are rewritten. Which these are says the index
    of ids, from the folders of the incoming ids."""
    spark = new.sparkSession
    incoming, staged = settled(last_wins(new.withColumn(MONTH, sc.month_key(ts)), key, version), "upsert")
    index_ids(spark, path, key)
    touched = _months(incoming.select(MONTH).union(id_index.entries_of(spark, path, incoming, key).select(MONTH)))
    id_index.record(incoming, path, key)
    stored = read(spark, path)
    old = stored.filter(F.col(MONTH).isin(touched))
    merged = last_wins(old.unionByName(incoming, allowMissingColumns=True), key, version)
    _replace_months(spark, merged, path, table, touched)
    discard(spark, staged)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def upsert_or_create(
    new: DataFrame, path: str, table: str, key: str, version: str, ts: str = "timestamp",
) -> None:
    if exists(new.sparkSession, path):
        upsert(new, path, table, key, version, ts)
    else:
        append(last_wins(new, key, version), path, table, ts)


def rewrite(changed: DataFrame, path: str, table: str, key: str, ts: str = "timestamp") -> None:
    """Replace stored rows by ``changed`` rows of the same id and time."""
    spark = changed.sparkSession
    rows = changed.drop(MONTH).withColumn(MONTH, sc.month_key(ts))
    touched = _months(rows)
    old = read(spark, path).filter(F.col(MONTH).isin(touched))
    kept = old.join(rows.select(key), key, "left_anti")
    _replace_months(spark, kept.unionByName(rows), path, table, touched)


def expired_months(spark: SparkSession, path: str, before: str) -> list[str]:
    return [m for m in _stored_months(spark, path) if m < before]


def retained(df: DataFrame, keep_days: int, as_of=None, ts: str = "timestamp") -> DataFrame:
    """Rows younger than the retention period."""
    return df.filter(F.col(ts) >= sc.moment(df, as_of, timedelta(days=keep_days), ts))


def apply_retention(spark: SparkSession, path: str, table: str, keep_days: int, as_of, ts: str = "timestamp") -> None:
    """Drop whole old months; rewrite only the month the limit falls into."""
    limit = as_of - timedelta(days=keep_days)
    edge = f"{limit:%Y%m}"
    _drop_months(spark, path, expired_months(spark, path, edge))
    if edge in _stored_months(spark, path):
        border = read(spark, path).filter((F.col(MONTH) == edge) & (F.col(ts) >= limit))
        _replace_months(spark, border, path, table, [edge])


def clear(spark: SparkSession, path: str, table: str, condition: Column) -> int:
    """Delete matching rows by rewriting the months that hold some; returns their number."""
    rows = read(spark, path)
    hits = dict(rows.filter(condition).groupBy(MONTH).count().collect())
    months = list(hits)
    if months:
        kept = rows.filter(F.col(MONTH).isin(months) & ~F.coalesce(condition, F.lit(False)))
        _replace_months(spark, kept, path, table, months)
    return sum(hits.values())


def export_training(training: DataFrame, path: str, limit: int | None = None, unused_only: bool = True) -> None:
    """All rows for training as JSON, or the first page of ``limit`` rows."""
    filters.training_page(training, limit, unused_only=unused_only).write.mode("overwrite").json(path)


# --- sorted sets ------------------------------------------------------------

def replace_scores(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("time_range", "topic")) -> DataFrame:
    """Set the score of each listed member, keep the others. Of several new
    scores for one member the greatest ``seq`` counts."""
    newest = new.groupBy(*keys).agg(F.max_by("score", "seq").alias("new_score"))
    return stored.select(*keys, "score").join(newest, list(keys), "full").select(
        *keys, F.coalesce("new_score", "score").alias("score"))


def increment_scores(stored: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("time_range", "topic")) -> DataFrame:
    """Add to the score of each member, starting at 0."""
    both = stored.select(*keys, "score").unionByName(changes.select(*keys, "score"))
    return both.groupBy(*keys).agg(F.sum("score").alias("score"))


def fold_scores(changes: DataFrame, keys: tuple[str, ...] = ("time_range", "topic")) -> DataFrame:
    """Both ways of writing a sorted set, in one aggregation: ``changes`` holds stored
    members (``seq`` NULL) and new scores. ``replaced`` is the new score of the
    greatest ``seq`` or else the stored one, ``incremented`` the sum of all."""
    fresh = F.col("seq").isNotNull()
    newest = F.max_by(F.when(fresh, F.col("score")), F.when(fresh, F.col("seq")))
    return changes.groupBy(*keys).agg(
        F.coalesce(newest, F.max(F.when(~fresh, F.col("score")))).alias("replaced"), F.sum("score").alias("incremented"))
