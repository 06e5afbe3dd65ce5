import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatterlens import schemas
from chatterlens.operators import filters, rollups
from chatterlens.sources import generate, readers, store
from chatterlens.streaming import pipelines, sinks

END = datetime(2024, 3, 10, 12)


@pytest.fixture
def folders(tmp_path):
    return lambda name: (str(tmp_path / name / "table"), str(tmp_path / name / "checkpoint"))


@pytest.fixture
def stream(spark, tmp_path):
    """Generated comments in four files, one per micro-batch."""
    path = str(tmp_path / "source")
    generate.comments(spark, 400, "p", END).repartition(4, "comment_id").write.parquet(path)
    schema = spark.read.parquet(path).schema

    def open_stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    open_stream.batch = spark.read.parquet(path)
    return open_stream


@pytest.mark.parametrize("kind, width", [("program", "5 minutes"), ("topic", "1 hour"), ("sentiment", "1 minute"), ("entity", "1 hour")])
def test_rollups_equal_batch(spark, stream, folders, kind, width):
    path, checkpoint = folders(kind)
    sinks.finish(pipelines.roll_up(stream(), kind, width, path, checkpoint))
    build, keys, measures = pipelines.ROLLUPS[kind]
    count = measures[0]
    got = pipelines.read_rollup(spark, kind, path).select(*keys, count)
    expected = build(stream.batch, width).select(*keys, count)
    assert sinks.read_batches(spark, path).select("batch_id").distinct().count() == 4
    assert got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0


def test_compacted_rollup_reads_the_same(spark, stream, folders):
    path, checkpoint = folders("compact")
    sinks.finish(pipelines.roll_up(stream(), "program", "5 minutes", path, checkpoint))
    pipelines.compact_rollup(spark, "program", path, path + "-base", upto=1)
    pipelines.compact_rollup(spark, "program", path, path + "-base", upto=3)
    whole = pipelines.read_rollup(spark, "program", path).select("window_start", "total_comments")
    again = pipelines.read_rollup(spark, "program", path, path + "-base").select("window_start", "total_comments")
    assert whole.exceptAll(again).count() == again.exceptAll(whole).count() == 0


def test_replayed_batch_does_not_double(spark, stream, folders):
    path, _ = folders("replay")
    for _ in range(2):
        sinks.write_batch(rollups.by_program(stream.batch), path, 0)
    assert pipelines.read_rollup(spark, "program", path).agg(F.sum("total_comments")).first()[0] == 400


def test_stateful_rollup_in_update_mode(spark, stream, folders):
    path, checkpoint = folders("windowed")
    updates = pipelines.windowed_rollup(stream(), "5 minutes", "2 hours")
    sinks.finish(pipelines.keep_latest(updates.withColumn("k", F.concat_ws("|", "program_id", "window_start")), path, checkpoint, "k"))
    total = sinks.latest_values(spark, path, "k").agg(F.sum("total_comments")).first()[0]
    assert total == 400


def test_store_skips_known_ids(spark, stream, folders):
    path, checkpoint = folders("dedupe")
    doubled = stream().select("comment_id", "timestamp").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    sinks.finish(pipelines.store_new(pipelines.deduplicated(doubled), path, checkpoint))
    assert sinks.read_batches(spark, path).count() == 400


def test_store_skips_ids_older_than_the_watermark(spark, stream, folders, tmp_path):
    path, checkpoint = folders("again")
    sinks.finish(pipelines.store_new(stream().select("comment_id", "timestamp"), path, checkpoint))
    stream.batch.limit(10).coalesce(1).write.mode("append").parquet(str(tmp_path / "source"))
    sinks.finish(pipelines.store_new(stream().select("comment_id", "timestamp"), path, checkpoint))
    assert sinks.read_batches(spark, path).count() == 400


def test_dedupe_query_stores_ids_that_come_late(spark, tmp_path, monkeypatch):
    from chatterlens.plans import streams

    source = tmp_path / "late-ids"
    schema = "comment_id string, program_id string, timestamp timestamp"
    for ident, days in (("new", 0), ("next", 0), ("old", 30), ("new", 0), ("old", 30)):
        row = [(ident, "p", END - timedelta(days=days))]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(str(source))
    one_by_one = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    monkeypatch.setattr(streams.tables, "comment_stream", lambda *_: one_by_one.parquet(str(source)))
    assert [tuple(r) for r in streams.stream_dedupe(spark, "").collect()] == [("p", 3)]


def test_late_rows_are_counted(spark, tmp_path, folders):
    source = tmp_path / "late"
    schema = "comment_id string, timestamp timestamp"
    for i, shift in enumerate([0, -30, -200]):
        spark.createDataFrame([(f"{i}", END + timedelta(minutes=shift))], schema).coalesce(1).write.mode("append").parquet(str(source))
    path, checkpoint = folders("late-out")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    sinks.finish(pipelines.count_late(rows, 3600, path, checkpoint))
    totals = sinks.read_batches(spark, path).agg(F.sum("rows"), F.sum("late")).first()
    assert tuple(totals) == (3, 1)


def test_messages_and_quarantine(spark, tmp_path, folders):
    source = tmp_path / "messages"
    source.mkdir()
    lines = [json.dumps({"id": str(i), "text": "t", "video_id": "v" if i % 2 else "w"}) for i in range(6)] + ["{bad"]
    (source / "m.txt").write_text("\n".join(lines), encoding="utf-8")
    messages = spark.readStream.text(str(source))
    path, checkpoint = folders("ingest")
    sinks.finish(pipelines.ingest(messages, path, path + "-bad", checkpoint))
    assert sinks.read_batches(spark, path).count() == 6
    assert [r["raw"] for r in sinks.read_batches(spark, path + "-bad").collect()] == ["{bad"]
    kept, checkpoint = folders("video")
    of_video = pipelines.of_video(readers.good(readers.parsed(messages)), "v")
    sinks.finish(pipelines.store_new(of_video.withColumnRenamed("id", "comment_id"), kept, checkpoint))
    assert sinks.read_batches(spark, kept).count() == 3


def test_running_figures(spark, stream, folders):
    path, checkpoint = folders("topics")
    sinks.finish(pipelines.keep_latest(pipelines.topic_counts(stream()), path, checkpoint))
    assert sinks.latest_values(spark, path, "topic").agg(F.sum("mentions")).first()[0] == 400
    path, checkpoint = folders("scores")
    sinks.finish(pipelines.keep_latest(pipelines.current_scores(stream()), path, checkpoint))
    row = sinks.latest_values(spark, path, "program_id").first()
    expected = rollups.program_snapshot(stream.batch).first()
    assert row["total_comments"] == 400 and abs(row["score"] - expected["score"]) < 1e-9


def test_snapshots(spark, stream, folders):
    path, checkpoint = folders("snapshot")
    sinks.finish(pipelines.snapshots(stream(), path, checkpoint))
    assert sinks.latest_batch(spark, path).agg(F.sum("count")).first()[0] == 400
    path, checkpoint = folders("report")
    sinks.finish(pipelines.report_snapshots(stream(), path, checkpoint))
    report = sinks.latest_batch(spark, path)
    assert report.filter("kind = 'sentiment'").agg(F.sum("count")).first()[0] == 400


def backlog_of(spark, tmp_path, count):
    source = tmp_path / "backlog"
    rows = [(f"c{i}", "the show", None, None, END + timedelta(seconds=i), END) for i in range(count)]
    schema = schemas.COMMENT
    names = ["comment_id", "text", "labels", "predicted_at", "created_at", "timestamp"]
    plain = spark.createDataFrame(rows, "comment_id string, text string, labels string, predicted_at timestamp, created_at timestamp, timestamp timestamp")
    frame = store.conform(plain.withColumn("labels", F.lit(None).cast(schemas.LABELS)).select(*names), schema)
    frame.repartition(2, "comment_id").write.parquet(str(source))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def test_micro_batch_labeling_and_notice(spark, tmp_path, folders):
    path, checkpoint = folders("labels")
    sinks.finish(pipelines.label_stream(backlog_of(spark, tmp_path, 20), path, checkpoint))
    found = sinks.read_batches(spark, path)
    assert found.count() == 20 and found.filter("size(labels) = 1 and error is null").count() == 20
    schema = found.drop("batch_id").schema
    labeled = spark.readStream.schema(schema).parquet(f"{path}/*")
    out, checkpoint = folders("notices")
    sinks.finish(pipelines.notify(labeled, out, checkpoint))
    notice = sinks.read_batches(spark, out).first()
    assert notice["count"] == 20 and notice["message"] == "20 new predictions available"
    assert len(notice["recent_comments"]) == 3


def test_labeling_waits_for_the_threshold(spark, tmp_path, folders):
    path, checkpoint = folders("due")
    sinks.finish(pipelines.label_backlog_stream(backlog_of(spark, tmp_path, 30), path, checkpoint, threshold=25))
    comments = store.read(spark, path)
    assert comments.count() == 30
    assert filters.backlog(comments).count() == 0
    assert pipelines.label_when_due(comments, 1) is None


def test_replay(spark, tmp_path, folders):
    seq = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "seq long, text string")
    source = tmp_path / "ticks"
    spark.range(7).select(F.lit(END).alias("timestamp"), F.col("id").alias("value")).write.parquet(str(source))
    ticks = spark.readStream.schema("timestamp timestamp, value long").parquet(str(source))
    path, checkpoint = folders("cycle")
    cycled = pipelines.cyclic(ticks, seq, 3)
    sinks.finish(sinks.start(cycled, lambda batch, n: sinks.write_batch(batch, path, n), checkpoint))
    counts = {r["text"]: r["count"] for r in sinks.read_batches(spark, path).groupBy("text").count().collect()}
    assert counts == {"t0": 3, "t1": 2, "t2": 2}
    assert pipelines.replay_rate(spark, seq, 3).isStreaming
    (tmp_path / "files").mkdir()
    assert pipelines.replay_files(spark, str(tmp_path / "files"), "text string").isStreaming


def test_running_tables_stay_small(spark, tmp_path, folders):
    """Twenty batches leave as many folders as ten do, and the newest values."""
    source = str(tmp_path / "in")
    schema = "comment_id string, program_id string, sentiment string, topics array<string>"
    for i in range(20):
        rows = [(f"c{i}", f"p{i % 3}", "positive", ["all", f"t{i % 4}"])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    path, checkpoint = folders("topics")
    sinks.finish(pipelines.keep_latest(pipelines.topic_counts(stream()), path, checkpoint, "topic", fold_every=5))
    assert {r["topic"]: r["mentions"] for r in sinks.latest_values(spark, path, "topic").collect()} == {
        "all": 20, "t0": 5, "t1": 5, "t2": 5, "t3": 5}
    assert sinks.batch_numbers(spark, path) == [19] and sinks.batch_numbers(spark, f"{path}-base", "upto") == [19]
    path, checkpoint = folders("snapshot")
    sinks.finish(pipelines.snapshots(stream(), path, checkpoint, ("program_id",)))
    assert sinks.batch_numbers(spark, path)[-2:] == sinks.batch_numbers(spark, path) and len(sinks.batch_numbers(spark, path)) <= 2
    assert sinks.latest_batch(spark, path).agg(F.sum("count")).first()[0] == 20


def test_folding_keeps_the_newest_row_per_key(spark, tmp_path):
    path = str(tmp_path / "running")
    for n in range(7):
        rows = [("a", n, "x"), (f"k{n % 2}", 10 * n, "y")]
        sinks.write_batch(spark.createDataFrame(rows, "k string, v int, z string"), path, n)
        if n in (2, 5):
            sinks.fold_batches(spark, path, ("k",), n)
            sinks.fold_batches(spark, path, ("k",), n)  # Folded again, nothing changes.
        expected = {"a": n, "k0": 10 * (n - n % 2)} | ({"k1": 10 * (n - 1 + n % 2)} if n else {})
        assert {r["k"]: r["v"] for r in sinks.latest_values(spark, path, "k").collect()} == expected
    assert sinks.batch_numbers(spark, path) == [5, 6]


def test_the_backlog_waits_over_several_batches(spark, tmp_path, folders):
    """Labels come when the threshold is reached, ids that came again or were labeled meanwhile count once or not at all."""
    source = str(tmp_path / "in")
    path, checkpoint = folders("due")

    def arrive(ids, stamp, labels=None):
        rows = [(i, "the show", END, END + timedelta(minutes=stamp)) for i in ids]
        frame = spark.createDataFrame(rows, "comment_id string, text string, timestamp timestamp, created_at timestamp")
        made = F.lit(None) if labels is None else F.array(F.struct(*[F.lit(x) for x in ("e", "Khác", "", "tích cực")], F.lit(1.0)))
        store.conform(frame.withColumn("labels", made.cast(schemas.LABELS)), schemas.COMMENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.COMMENT).option("maxFilesPerTrigger", 1).parquet(source)
        sinks.finish(pipelines.label_backlog_stream(stream, path, checkpoint, threshold=4))
        return store.read(spark, path).filter("predicted_at IS NOT NULL").count()
    assert arrive(["a", "b"], 0) == 0
    assert arrive(["a", "b"], 1) == 0  # Four rows, but two comments.
    assert arrive(["c"], 2) == 0
    assert arrive(["c", "x"], 3, labels=True) == 0  # Labeled elsewhere, they no longer wait.
    assert arrive(["d", "e"], 4) == 4
    assert arrive(["f", "g", "h"], 5) == 4
    assert arrive(["i"], 6) == 8
    assert sinks.batch_numbers(spark, f"{path}-waiting")[0] > 0 and len(sinks.batch_numbers(spark, f"{path}-waiting-counts")) <= 2
    assert store.read(spark, path).count() == 10
