"""Streaming jobs. Each takes a stream, a table path and a checkpoint path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from chatterlens.functions import labels as lab, scalars as sc
from chatterlens.operators import filters, joins, labeling, metrics as mt, rollups
from chatterlens.sources import id_index, readers, store
from chatterlens.streaming import sinks


# --- ingest -----------------------------------------------------------------

def ingest(messages: DataFrame, path: str, bad_path: str, checkpoint: str, **run) -> StreamingQuery:
    """Messages into a comment table; unreadable ones go to a table of their own."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = readers.parsed(batch).persist()
        sinks.write_batch(readers.good(rows), path, batch_id)
        sinks.write_batch(readers.quarantined(rows), bad_path, batch_id)
        rows.unpersist()
    return sinks.start(messages, on_batch, checkpoint, **run)


def deduplicated(stream: DataFrame, delay: str = "1 hour", ts: str = "timestamp", key: str = "comment_id") -> DataFrame:
    """First row per id among those arriving within the delay. Rows older than the
    watermark are dropped, so this is not for what :func:`store_new` stores."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def store_new(stream: DataFrame, path: str, checkpoint: str, key: str = "comment_id", **run) -> StreamingQuery:
    """Append only ids no earlier batch has stored, however long ago. Copies within
    a batch are settled too; the stream needs no watermark. A batch reads the
    index folders of its own ids, not the stored table."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        stored = id_index.earlier_ids(batch.sparkSession, path, rows, key, batch_id)
        fresh = rows.dropDuplicates([key]) if stored is None else joins.not_stored(rows, stored, key)
        # The batch's own ids count for later batches only, so a replay finds the same rows.
        sinks.write_batch(fresh, path, batch_id)
        id_index.record_batch(rows, path, key, batch_id)
        rows.unpersist()
    return sinks.start(stream, on_batch, checkpoint, **run)


def of_video(stream: DataFrame, video_id: str) -> DataFrame:
    return filters.equal_to(stream, video_id=video_id)


# --- rollups ----------------------------------------------------------------

ROLLUPS: dict[str, tuple[Callable[[DataFrame, str], DataFrame], tuple[str, ...], tuple[str, ...]]] = {
    "program": (rollups.by_program, ("program_id", "window_start"), rollups.PROGRAM_MEASURES),
    "topic": (rollups.by_topic, ("program_id", "hour_start", "topic"), rollups.COUNT_MEASURES),
    "sentiment": (rollups.by_sentiment, ("timestamp_minute", "sentiment"), rollups.COUNT_MEASURES),
    "entity": (rollups.by_entity, ("timestamp_hour", "entity"), rollups.COUNT_MEASURES),
}


def roll_up(stream: DataFrame, kind: str, width: str, path: str, checkpoint: str, **run) -> StreamingQuery:
    """Partial sums and counts per batch. No row is ever too late: a straggler
    adds a partial row for its window."""
    build, _, _ = ROLLUPS[kind]
    return sinks.start(
        stream, lambda batch, n: sinks.write_batch(build(batch, width), path, n), checkpoint, **run)


def _compacted(spark: SparkSession, base: str | None) -> tuple[DataFrame | None, int]:
    """The newest table below ``base`` and the batch it goes up to; none yet: nothing, 0."""
    if base is None:
        return None, 0
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None, 0
    tables = spark.read.parquet(base)
    upto = tables.agg(F.max("upto")).first()[0]
    return (None, 0) if upto is None else (tables.filter(F.col("upto") == upto).drop("upto"), upto)


def read_rollup(spark: SparkSession, kind: str, path: str, base: str | None = None) -> DataFrame:
    """Merged partials. With a ``base`` from :func:`compact_rollup`, only batches
    from the one recorded there on are added to it."""
    _, keys, measures = ROLLUPS[kind]
    old, since = _compacted(spark, base)
    partials = sinks.read_batches(spark, path).filter(F.col(sinks.BATCH) >= since).drop(sinks.BATCH)
    return rollups.merge(partials if old is None else partials.unionByName(old), list(keys), measures)


def compact_rollup(spark: SparkSession, kind: str, path: str, base: str, upto: int) -> None:
    """Add the batches before ``upto`` to what was compacted before, in a new
    folder ``upto=<number>`` of ``base``, so that reading does not slow down as
    batches pile up. Older folders and merged batches may then be dropped."""
    _, keys, measures = ROLLUPS[kind]
    old, since = _compacted(spark, base)
    fresh = sinks.read_batches(spark, path).filter(
        (F.col(sinks.BATCH) >= since) & (F.col(sinks.BATCH) < upto)).drop(sinks.BATCH)
    whole = fresh if old is None else fresh.unionByName(old)
    rollups.merge(whole, list(keys), measures).write.mode("overwrite").parquet(f"{base}/upto={upto}")


def windowed_rollup(stream: DataFrame, width: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Stateful variant for update or append mode; drops rows older than the watermark."""
    return rollups.by_program(stream.withWatermark("timestamp", delay), width)


def count_late(stream: DataFrame, delay_seconds: int, path: str, checkpoint: str, ts: str = "timestamp", **run) -> StreamingQuery:
    """Per batch: rows, newest time, and rows older than the watermark that the
    batches before it had set."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        before = sinks.earlier_batches(batch.sparkSession, path, batch_id)
        reached = F.lit(None).cast("timestamp") if before is None else (
            before.agg(F.max("newest").alias("newest")).scalar())
        limit = reached - F.make_dt_interval(secs=F.lit(delay_seconds))
        late = F.count_if(F.col(ts) < F.col("watermark"))
        summary = batch.select(ts, limit.alias("watermark")).agg(
            F.count("*").alias("rows"), F.max(ts).alias("newest"), late.alias("late"))
        sinks.write_batch(summary, path, batch_id)
    return sinks.start(stream, on_batch, checkpoint, **run)


# --- running figures --------------------------------------------------------

def topic_counts(stream: DataFrame) -> DataFrame:
    """Running mention totals per topic."""
    return mt.topic_mentions(stream)


def current_scores(stream: DataFrame) -> DataFrame:
    """Running score and counts per program."""
    return rollups.program_snapshot(stream).withColumn("updated_at", F.current_timestamp())


def keep_latest(
    updates: DataFrame, path: str, checkpoint: str, *keys: str, fold_every: int = 10, **run,
) -> StreamingQuery:
    """Changed rows of an aggregation, batch by batch; every ``fold_every`` batches
    they are folded into a base, one row per key, and the old folders go. Read
    with ``latest_values``."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        sinks.write_batch(batch, path, batch_id)
        if keys and batch_id % fold_every == fold_every - 1:
            sinks.fold_batches(batch.sparkSession, path, keys, batch_id)
    return sinks.start(updates, on_batch, checkpoint, mode="update", **run)


def _replaced(result: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Write a whole table per batch; the one before stays until the next, older ones go."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        sinks.write_batch(result(batch), path, batch_id)
        sinks.drop_batches(batch.sparkSession, path, batch_id - 1)
    return on_batch


def snapshots(stream: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = (), **run) -> StreamingQuery:
    """The whole sentiment table after every batch; read with ``latest_batch``."""
    counts = mt.sentiment_counts(stream, by)
    return sinks.start(counts, _replaced(lambda batch: batch, path), checkpoint, mode="complete", **run)


COMBO = ("sentiment", "entity", "aspect")


def label_combos(labeled: DataFrame) -> DataFrame:
    """Running counts of the labels' combinations, for :func:`keep_latest` by COMBO."""
    return mt.quads_of(labeled).groupBy(*COMBO).agg(F.count("*").alias("n"))


def label_report(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """The label report over the combinations kept so far."""
    return mt.report_of(sinks.latest_values(spark, path, *COMBO), limit)


def report_snapshots(labeled: DataFrame, path: str, checkpoint: str, limit: int = 10, **run) -> StreamingQuery:
    """The label report after every batch, over all labels so far. Only changed
    combinations are written for it, beside the reports."""
    counts = f"{path}-combos"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sinks.write_batch(batch, counts, batch_id)
        if batch_id % 10 == 9:
            sinks.fold_batches(spark, counts, COMBO, batch_id)
        _replaced(lambda _: label_report(spark, counts, limit), path)(batch, batch_id)
    return sinks.start(label_combos(labeled), on_batch, checkpoint, mode="update", **run)


# --- labeling ---------------------------------------------------------------

def label_stream(stream: DataFrame, path: str, checkpoint: str, load=None, **run) -> StreamingQuery:
    """Predictions for the comments of each batch that still need labels."""
    load = load or labeling.lexicon_scorer()

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        todo = batch.filter(lab.needs_labeling()).select("comment_id", "text")
        # Scoring is the cost here: the rows of one file are dealt over all tasks.
        tasks = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        todo = todo.repartition(tasks, "comment_id")
        sinks.write_batch(
            labeling.label(todo, load).withColumn("predicted_at", F.current_timestamp()), path, batch_id)
    return sinks.start(stream, on_batch, checkpoint, **run)


def label_when_due(comments: DataFrame, threshold: int = 100, load=None) -> DataFrame | None:
    """Predictions for the whole backlog once it holds ``threshold`` comments."""
    if not filters.backlog_due(comments, threshold).first()["is_due"]:
        return None
    return labeling.label(filters.backlog(comments).select("comment_id", "text"), load)


def label_backlog_stream(
    arrivals: DataFrame, path: str, checkpoint: str, threshold: int = 100, load=None, **run,
) -> StreamingQuery:
    """Collect arrivals in a comment table and label its backlog when it is due.

    Arrivals also go to a waiting table of their own, with the number that need
    labels so far. Only when this reaches the threshold are the waiting rows read,
    settled by id and, if as many are left, labeled and upserted; the comment
    table itself is never scanned. Batches labeled once are dropped with the
    next labeling. A replayed batch does the same again.
    """
    waiting, counts = f"{path}-waiting", f"{path}-waiting-counts"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch.persist()
        store.upsert_or_create(rows, path, "comments", "comment_id", "created_at")
        sinks.write_batch(rows, waiting, batch_id)
        since, before = _waiting_before(spark, counts, batch_id)
        number = before + rows.filter(lab.needs_labeling()).count()
        rows.unpersist()
        if number >= threshold:
            fresh = [n for n in sinks.batch_numbers(spark, waiting) if since < n <= batch_id]
            settled_rows = store.last_wins(
                spark.read.schema(batch.schema).parquet(*[f"{waiting}/{sinks.BATCH}={n}" for n in fresh]),
                "comment_id", "created_at").filter(lab.needs_labeling()).persist()
            number = settled_rows.count()
            if number >= threshold:
                made = labeling.label(settled_rows.select("comment_id", "text"), load)
                labeled = joins.merge_predictions(
                    settled_rows, made.where("error IS NULL").select("comment_id", "labels"), F.current_timestamp())
                store.upsert(labeled.where("predicted_at IS NOT NULL"), path, "comments", "comment_id", "created_at")
                sinks.drop_batches(spark, waiting, since + 1)
                since, number = batch_id, 0
            settled_rows.unpersist()
        sinks.write_batch(spark.createDataFrame([(since, number)], "since int, waiting long"), counts, batch_id)
        sinks.drop_batches(spark, counts, batch_id - 1)
    return sinks.start(arrivals, on_batch, checkpoint, **run)


def _waiting_before(spark: SparkSession, counts: str, batch_id: int) -> tuple[int, int]:
    """The batch up to which all is labeled, and how many comments may wait since."""
    earlier = [n for n in sinks.batch_numbers(spark, counts) if n < batch_id]
    if not earlier:
        return -1, 0
    return tuple(spark.read.parquet(f"{counts}/{sinks.BATCH}={earlier[-1]}").first())


def notify(predictions: DataFrame, path: str, checkpoint: str, previews: int = 3, **run) -> StreamingQuery:
    """One notification row per batch: how many predictions and the newest few."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        labeled = filters.labeled(batch)
        count = labeled.agg(F.count("*").alias("n")).scalar()
        newest = filters.newest(labeled, previews, ts="predicted_at").select(
            F.struct("predicted_at", "comment_id", sc.preview("text").alias("text")).alias("c"))
        row = newest.agg(F.sort_array(F.collect_list("c"), asc=False).alias("recent_comments")).select(
            F.lit("new_predictions").alias("type"), count.alias("count"),
            F.format_string("%d new predictions available", count).alias("message"), "recent_comments",
        )
        sinks.write_batch(row, path, batch_id)
    return sinks.start(predictions, on_batch, checkpoint, **run)


# --- replay -----------------------------------------------------------------

def replay_rate(spark: SparkSession, rows: DataFrame, count: int, per_second: int = 1) -> DataFrame:
    """Endless replay of a table whose ``seq`` runs from 0 to ``count - 1``."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return cyclic(ticks, rows, count)


def cyclic(ticks: DataFrame, rows: DataFrame, count: int) -> DataFrame:
    return ticks.select("timestamp", (F.col("value") % count).alias("seq")).join(rows, "seq").drop("seq")


def replay_files(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
