"""What the third round of findings asked for."""

from pyspark.sql import functions as F

from chatterlens import session
from chatterlens.sources import postings
from chatterlens.streaming import replay, sinks


def _batches(spark, stream, tmp_path):
    held = []
    sinks.finish(sinks.start(stream, lambda batch, n: held.append(sorted(r["x"] for r in batch.collect())), str(tmp_path / "check")))
    return held


def test_large_turns_are_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "FILE_BYTES", 20_000)
    rows = spark.range(0, 30_000, 1, 5).select(F.col("id").alias("x"))
    stream = replay.in_turns(rows, str(tmp_path / "turns"), F.col("x") % 3, 3)
    assert len(list((tmp_path / "turns").glob("part-*"))) >= 9
    assert _batches(spark, stream, tmp_path) == [list(range(t, 30_000, 3)) for t in range(3)]


def test_turns_with_few_rows_or_none_are_batches(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.col("id").alias("x"))
    turn = F.when(F.col("x") == 0, 0).when(F.col("x") > 1, 2).when(F.col("x").isNull(), 1).otherwise(3)
    stream = replay.in_turns(rows, str(tmp_path / "turns"), turn, 5, cycles=2, files=3)
    once = [[0], [], list(range(2, 40)), [1], []]
    assert _batches(spark, stream, tmp_path) == once * 2


def test_index_is_written_straight_from_the_texts(spark, tmp_path, monkeypatch):
    def no_table(*_):
        raise AssertionError("texts cut up are stored beside the index")
    monkeypatch.setattr(session, "scratch", no_table)
    rows = spark.range(0, 4000, 1, 8).select(
        F.col("id").alias("comment_id"), F.concat(F.lit("the word"), F.col("id").cast("string")).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        postings.add(rows, str(tmp_path / "index"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert postings.hits(spark, str(tmp_path / "index"), ["the"]).count() == 4000
    bucket = spark.range(1).select(postings.bucket_of(F.lit("the"))).first()[0]
    assert len(list((tmp_path / "index" / "postings" / "batch=0" / f"bucket={bucket}").glob("*.parquet"))) > 1
