import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chatterlens import schemas
from chatterlens.operators import checks, labeling, rollups, windows
from chatterlens.sources import generate, readers, store

END = datetime(2024, 3, 10, 12)


def months(path):
    return sorted(p.name.removeprefix("month=") for p in path.iterdir() if p.name.startswith("month="))


def test_json_shapes(spark, tmp_path):
    entry = {"text": "a", "labels": [{"entity": "e", "aspect": "x", "opinion": "o", "sentiment": "tích cực"}]}
    for name, content in {"object": {"results": [entry, entry]}, "array": [entry], "single": entry}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content, ensure_ascii=False, indent=1), encoding="utf-8")
        got = readers.json_document(spark, str(tmp_path / f"{name}.json")).collect()
        assert [r["text"] for r in got] == ["a"] * (2 if name == "object" else 1)
        assert got[0]["labels"][0]["sentiment"] == "tích cực"


def test_json_lines_and_labeling_job(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text('{"id": "1", "text": "the show"}\n\n{"id": "2", "text": "x"}\n', encoding="utf-8")
    assert readers.json_lines(spark, str(source), "id string, text string").count() == 2
    labeling.run_labeling(spark, str(source), str(tmp_path / "out"), "file")
    got = {r["id"]: r["labels"] for r in spark.read.schema("id string, labels array<struct<opinion:string>>").json(str(tmp_path / "out")).collect()}
    assert [q["opinion"] for q in got["1"]] == ["the"] and got["2"] == []
    assert labeling.run_labeling(spark, str(source), mode="memory", limit=1).count() == 1
    assert labeling.run_labeling(spark, str(source), mode="console") is None


def test_messages_round_trip_and_quarantine(spark, tmp_path):
    sent = spark.createDataFrame([("1", "héllo", "v")], "id string, text string, video_id string")
    wire = readers.as_messages(sent, key="id")
    assert wire.columns == ["key", "value"]
    noise = spark.createDataFrame([("{broken",), ("[1]",), ("",)], "value string")
    got = readers.parsed(wire.select("value").unionByName(noise))
    assert [r["text"] for r in readers.good(got).collect()] == ["héllo"]
    assert readers.quarantined(got).count() == 3
    options = readers.topic_read_options("host:1", "t", "latest", 5)
    assert options["startingOffsets"] == "latest" and options["maxOffsetsPerTrigger"] == "5"
    assert readers.topic_write_options("host:1", "t")["kafka.acks"] == "all"
    readers.write_json(sent, str(tmp_path / "j"))
    readers.write_parquet(sent, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == spark.read.json(str(tmp_path / "j")).select(*sent.columns).collect()
    assert len(readers.to_driver(spark.range(10), 3)) == 3
    assert list(readers.to_driver(spark.range(100).repartition(7), 3)["id"]) == [0, 1, 2]
    assert list(readers.to_driver(spark.range(100).repartition(7), 3, F.col("id").desc())["id"]) == [99, 98, 97]


def test_generator_is_repeatable_and_valid(spark):
    made = generate.comments(spark, 500, "show_123", END)
    again = generate.comments(spark, 500, "show_123", END, partitions=3)
    assert made.drop("metadata").exceptAll(again.drop("metadata")).count() == 0
    assert checks.violations(made, checks.comment_rules()).filter("violations > 0").count() == 0
    assert made.filter((F.col("timestamp") > END) | (F.col("timestamp") < END - timedelta(hours=1))).count() == 0
    points = generate.metrics(made)
    assert checks.violations(points, checks.metric_rules()).filter("violations > 0").count() == 0
    assert generate.trending(made).select("time_range").distinct().count() == 3
    assert generate.program_events(spark, "show_123", END).count() == len(generate.EVENTS)


def test_append_layout_and_pruned_read(spark, tmp_path):
    path = tmp_path / "comments"
    long_ago = generate.comments(spark, 50, "p", END - timedelta(days=60)).withColumn("comment_id", F.concat(F.lit("old"), "comment_id"))
    store.append_comments(generate.comments(spark, 50, "p", END).drop("topics"), str(path))
    store.append_comments(long_ago, str(path))
    assert months(path) == ["202401", "202403"]
    recent = store.read(spark, str(path), start=END - timedelta(days=1))
    assert recent.count() == 50 and recent.filter(F.size("topics") == 0).count() == 50
    plan = recent._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "month" in filters and "202403" in filters and "GreaterThanOrEqual(timestamp" in plan


def test_append_metrics_topics_and_anomalies(spark, tmp_path):
    made = generate.comments(spark, 2000, "p", END)
    store.append_metrics(rollups.program_metrics(made, "5 minutes"), str(tmp_path / "m"))
    store.append_aggregates(rollups.by_topic(made), str(tmp_path / "t"))
    points = rollups.program_metrics(made, "1 minute")
    store.append_anomalies(windows.anomalies(points), str(tmp_path / "a"))
    assert [f.name for f in spark.read.parquet(str(tmp_path / "m")).schema][:3] == ["program_id", "timestamp", "score"]
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.sum("count")).first()[0] == 2000
    if (tmp_path / "a").exists() and months(tmp_path / "a"):
        assert checks.violations(spark.read.parquet(str(tmp_path / "a")), checks.anomaly_rules()).agg(F.sum("violations")).first()[0] == 0


def versions(spark, *data):
    return spark.createDataFrame(list(data), "comment_id string, program_id string, timestamp timestamp, text string, version int")


def test_upsert_last_write_wins_across_months(spark, tmp_path):
    path = str(tmp_path / "c")
    jan, mar = datetime(2024, 1, 5), datetime(2024, 3, 5)
    first = versions(spark, ("1", "p", jan, "a", 1), ("2", "p", mar, "b", 1), ("3", "p", datetime(2024, 2, 1), "c", 1))
    store.upsert_or_create(first, path, "comments", "comment_id", "version")
    store.upsert_or_create(
        versions(spark, ("1", "p", mar, "moved", 3), ("1", "p", mar, "stale", 2), ("4", "p", mar, "new", 1), ("2", "p", mar, "older", 0)),
        path, "comments", "comment_id", "version")
    got = {r["comment_id"]: r["text"] for r in store.read(spark, path).collect()}
    assert got == {"1": "moved", "2": "b", "3": "c", "4": "new"}
    assert months(tmp_path / "c") == ["202402", "202403"]


def test_retention_and_clearing(spark, tmp_path):
    path = str(tmp_path / "c")
    data = [(str(i), "p" if i % 2 else "q", END - timedelta(days=i), "t", 1) for i in range(120)]
    store.append(versions(spark, *data), path, "comments")
    assert store.retained(store.read(spark, path), 90).count() == 91
    store.apply_retention(spark, path, "comments", 90, END)
    assert store.read(spark, path).count() == 91 and min(months(tmp_path / "c")) == "202312"
    assert store.clear(spark, path, "comments", F.col("program_id") == "p") == 45
    assert {r[0] for r in store.read(spark, path).select("program_id").distinct().collect()} == {"q"}
    assert store.clear(spark, path, "comments", F.col("program_id") == "none") == 0


def test_stamps_and_export(spark, tmp_path):
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, text string")
    stamped = store.stamped_for_training(rows)
    assert stamped.filter("consumed_at is not null and not is_used_for_training").count() == 2
    assert "stored_at" in store.stamped_as_stored(rows).columns
    assert store.stamped_as_submitted(rows, "web").filter("source = 'web' and size(labels) = 0").count() == 2
    store.export_training(stamped, str(tmp_path / "whole"))
    assert spark.read.json(str(tmp_path / "whole")).count() == stamped.filter("NOT is_used_for_training").count()
    store.export_training(stamped, str(tmp_path / "export"), limit=1)
    assert spark.read.json(str(tmp_path / "export")).count() == 1


def test_conform_fills_missing_columns(spark):
    rows = store.conform(spark.createDataFrame([("1",)], "comment_id string"), schemas.COMMENT)
    row = rows.first()
    assert row["topics"] == [] and row["labels"] is None and row["text"] is None


def test_sorted_set_changes(spark):
    schema = "time_range string, topic string, score double"
    stored = spark.createDataFrame([("5min", "a", 1.0), ("5min", "b", 2.0)], schema)
    new = spark.createDataFrame([("5min", "a", 5.0, 1), ("5min", "a", 7.0, 2), ("1hour", "c", 3.0, 1)], schema + ", seq int")
    keyed = lambda df: {(r["time_range"], r["topic"]): r["score"] for r in df.collect()}
    assert keyed(store.replace_scores(stored, new)) == {("5min", "a"): 7.0, ("5min", "b"): 2.0, ("1hour", "c"): 3.0}
    assert keyed(store.increment_scores(stored, new)) == {("5min", "a"): 13.0, ("5min", "b"): 2.0, ("1hour", "c"): 3.0}


def test_equal_versions_with_maps_are_settled_alike(spark, tmp_path):
    """The declared comment has a map; of equal versions one wins, in any order of rows and entries."""
    def comment(text, meta):
        return spark.createDataFrame([("a", text, meta)], "comment_id string, text string, metadata map<string,string>")
    one = comment("x", {"k": "1", "l": "2"})
    turned = comment("x", {"l": "2", "k": "1"})
    other = comment("y", {"k": "1"})
    assert one.select(store.row_hash(one)).first() == turned.select(store.row_hash(turned)).first()
    nested = spark.createDataFrame([([{"k": 1}], None)], "a array<map<string,int>>, s struct<m:map<string,int>>")
    assert nested.select(store.row_hash(nested)).first()[0] is not None
    path = str(tmp_path / "maps")
    stamp = F.lit(datetime(2024, 5, 1))
    rows = [store.conform(d.withColumns({"timestamp": stamp, "created_at": stamp}), schemas.COMMENT)
            for d in (one, other)]
    winners = {store.last_wins(a.unionByName(b), "comment_id", "created_at").first()["text"]
               for a, b in (rows, rows[::-1])}
    assert len(winners) == 1
    for d in (*rows, *rows[::-1]):
        store.upsert_or_create(d, path, "comments", "comment_id", "created_at")
        assert store.read(spark, path).count() == 1
    assert store.read(spark, path).first()["text"] in winners
