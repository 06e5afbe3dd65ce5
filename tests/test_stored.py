"""Stored helpers of queries: the inverted index, rollups up to a mark, the index of ids."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatterlens import schemas
from chatterlens.functions import scalars as sc
from chatterlens.operators import rollups, search, windows
from chatterlens.sources import id_index, postings, rollup_store, store
from chatterlens.streaming import pipelines, sinks

END = datetime(2024, 3, 10, 12)


def scans(df):
    """Leaf scans of the plan as it ran, without reused ones."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "FileScan" in line or "Scan ExistingRDD" in line]


# --- inverted index -----------------------------------------------------------

TEXTS = [
    "Red fox, red FOX; blue", "blue", "", None, "the fox " * 50, "red-red red", "été 2 fox", "the the the", "nothing here",
]


@pytest.fixture(scope="module")
def comments(spark):
    rows = [(i, t, "show_%d" % (i % 2), END + timedelta(minutes=i % 4), ["positive", "negative"][i % 2]) for i, t in enumerate(TEXTS * 5)]
    return spark.createDataFrame(
        rows, "comment_id long, text string, program_id string, timestamp timestamp_ntz, sentiment string")


@pytest.fixture(scope="module")
def index(spark, comments, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    keep = ("program_id", "timestamp", "sentiment")
    postings.add(comments.filter("comment_id < 20"), path, keep, batch=0)
    postings.add(comments.filter("comment_id >= 20"), path, keep, batch=1)
    postings.add(comments.filter("comment_id >= 20"), path, keep, batch=1)  # A replayed batch replaces itself.
    return path


def test_postings_hold_every_word(spark, comments, index):
    expected = {}
    for row in comments.collect():
        for term in re.findall(r"[^\W_]+", (row["text"] or "").lower()):
            expected[row["comment_id"], term] = expected.get((row["comment_id"], term), 0) + 1
    found = spark.read.parquet(f"{index}/postings")
    assert {(r["comment_id"], r["term"]): r["tf"] for r in found.collect()} == expected
    stats = spark.read.parquet(f"{index}/stats").agg(F.sum("docs"), F.sum("words")).first()
    assert tuple(stats) == (len(TEXTS) * 5, sum(expected.values()))


@pytest.mark.parametrize("query", ["fox", "Red THE", "unknown", "unknown été", "...", "2"])
def test_index_and_texts_give_the_same_hits(spark, comments, index, query):
    direct = {r["comment_id"]: r["relevance"] for r in search.with_relevance(comments, query).collect()}
    found = {r["comment_id"]: r["relevance"] for r in search.indexed_search(spark, index, query, size=None).collect()}
    assert set(found) == set(direct)
    assert all(abs(found[i] - direct[i]) < 1e-12 for i in found)
    page = search.search_page(comments.withColumns({"engagement_score": F.lit(1.0), "username": F.lit("u")}), query, sentiment="negative", limit=3)
    ours = search.indexed_page(spark, index, query, "negative", limit=3)
    assert [(r["comment_id"], r["total_found"]) for r in ours.collect()] == [
        (r["comment_id"], r["total_found"]) for r in page.collect()]


def test_page_from_the_index_with_its_texts(spark, comments, index):
    page = search.indexed_search(spark, index, "fox", ("program_id", "timestamp"), size=4, program_id="show_0")
    direct = search.text_search(comments, "fox", size=4, program_id="show_0")
    assert [r["comment_id"] for r in page.collect()] == [r["comment_id"] for r in direct.collect()]
    texts = {r["comment_id"]: r["text"] for r in search.with_comments(page, comments).collect()}
    assert len(texts) == 4 and all("fox" in t.lower() for t in texts.values())


def test_a_query_opens_the_folders_of_its_terms_only(spark, index):
    hits = postings.hits(spark, index, ["fox", "blue"])
    folders = {r[0] for r in hits.select(F.regexp_extract(F.input_file_name(), "bucket=([0-9]+)", 1)).distinct().collect()}
    wanted = {str(spark.range(1).select(postings.bucket_of(F.lit(t))).first()[0]) for t in ("fox", "blue")}
    assert folders == wanted
    scan, = scans(hits)
    assert re.search(r"PartitionFilters: \[bucket#\d+ (IN|INSET) ", scan)
    # A folder of no term of the query may be broken without harm.
    import glob, os
    other = sorted(d for d in glob.glob(f"{index}/postings/batch=*/bucket=*") if d.rsplit("=", 1)[1] not in wanted)[-1]
    for name in glob.glob(f"{other}/part-*"):
        with open(name, "wb") as out:
            out.write(b"broken")
    for name in glob.glob(f"{other}/.part-*"):
        os.unlink(name)
    assert search.indexed_search(spark, index, "fox blue", size=None).count() > 0


# --- rollups up to a mark -----------------------------------------------------

def spoken(spark, first, count, program="p", step=timedelta(minutes=7)):
    rows = [(f"{program}{first + i}", program, END + step * (first + i), ["positive", "negative", "neutral"][i % 3],
             [0.7, -0.6, 0.0][i % 3], float(i % 50)) for i in range(count)]
    return spark.createDataFrame(
        rows, "comment_id string, program_id string, timestamp timestamp_ntz, sentiment string, sentiment_score double, engagement_score double")


def tidy(df, *columns):
    rows = df.select("program_id", "window_start", "total_comments", "negative_count", F.round("score", 9).alias("score"), *columns).collect()
    return sorted(tuple(r) for r in rows)


def test_rollups_up_to_a_mark(spark, tmp_path):
    path = str(tmp_path / "rollups")
    comments = spoken(spark, 0, 60).unionByName(spoken(spark, 0, 9, "quiet")).unionByName(spoken(spark, 55, 5, "new"))
    direct = rollups.program_metrics(comments, "1 hour")
    assert rollup_store.mark(spark, path) is None
    for upto in (2, 5, 5, 3):
        rollup_store.fold(comments, path, END + timedelta(hours=upto))
        assert rollup_store.mark(spark, path) == rollup_store._seconds(END + timedelta(hours=max(upto, 5 if upto == 3 else upto)))
        assert tidy(rollup_store.hours(comments, path)) == tidy(direct)
        assert tidy(rollup_store.latest(comments, path)) == tidy(
            windows.latest_per_program(direct, columns=("score", "total_comments", "negative_count")))
    assert comments.limit(1).select(rollup_store.newest(comments, path).alias("t")).first()["t"] == comments.agg(F.max("timestamp")).first()[0]
    with pytest.raises(ValueError):
        rollup_store.fold(comments, path, END + timedelta(hours=6, minutes=1))


def test_late_comments_join_folded_hours(spark, tmp_path):
    path = str(tmp_path / "rollups")
    comments = spoken(spark, 0, 60).unionByName(spoken(spark, 0, 9, "quiet"))
    rollup_store.fold(comments, path, END + timedelta(hours=5))
    late = spoken(spark, 3, 8, "quiet", timedelta(minutes=9))
    for _ in range(2):  # Added twice under one name, it counts once.
        rollup_store.add_late(late, path, "monday")
    direct = rollups.program_metrics(comments.unionByName(late), "1 hour")
    assert tidy(rollup_store.hours(comments, path)) == tidy(direct)
    assert tidy(rollup_store.latest(comments, path)) == tidy(
        windows.latest_per_program(direct, columns=("score", "total_comments", "negative_count")))


def test_only_the_raw_tail_is_scanned(spark, tmp_path):
    raw, path = str(tmp_path / "raw"), str(tmp_path / "rollups")
    spoken(spark, 0, 60).write.parquet(raw)
    comments = spark.read.parquet(raw)
    rollup_store.fold(comments, path, END + timedelta(hours=5))
    latest = rollup_store.latest(comments, path)
    latest.collect()
    own = [line for line in scans(latest) if "/raw" in line]
    assert len(own) == 1 and "GreaterThanOrEqual(timestamp," in own[0]


@pytest.mark.parametrize("name", [
    "program_score_now", "latest_per_program", "program_score_timeline", "current_score_detail", "score_with_fallback"])
def test_queries_scan_raw_events_at_most_twice(spark, name):
    import __spark_entry__ as entry
    found = entry.queries()[name](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    # Every scan is described once per (sub)plan; the plan before adaptive changes repeats it.
    raw = {re.sub(r"^\s*\(\d+\)", "", part) for part in plan.split("\n\n")
           if re.match(r"\s*\(\d+\) Scan parquet", part) and re.search(r"[\[ ]ts#", part)}
    assert 1 <= len(raw) <= 2 and all(re.search(r"PushedFilters: \[.*\(ts", part) for part in raw), plan


# --- index of ids --------------------------------------------------------------

def spoil(path, keep):
    """Make every index folder unreadable but those to ``keep``."""
    import glob
    import os
    for folder in glob.glob(f"{path}-ids/**/id_bucket=*", recursive=True):
        if int(folder.rsplit("=", 1)[1]) in keep:
            continue
        for name in glob.glob(f"{folder}/part-*"):
            with open(name, "wb") as out:
                out.write(b"broken")
        for name in glob.glob(f"{folder}/.part-*"):
            os.unlink(name)


def kept(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "comment_id string")
    return {r[0] for r in rows.select(id_index.bucket(F.col("comment_id"))).collect()}


def versions(spark, ids, months, version, text="old"):
    rows = [(i, text, datetime(2024, m, 2), version, {"k": str(version)}) for i, m in zip(ids, months)]
    return spark.createDataFrame(
        rows, "comment_id string, text string, timestamp timestamp, version int, metadata map<string,string>").withColumn(
        "program_id", F.lit("p"))


def test_an_upsert_opens_the_folders_of_its_ids_only(spark, tmp_path):
    path = str(tmp_path / "comments")
    ids = [f"c{i}" for i in range(200)]
    store.append(versions(spark, ids, [1 + i % 4 for i in range(200)], 1), path, "comments")
    store.upsert(versions(spark, ["c0", "new"], [1, 2], 2, "new"), path, "comments", "comment_id", "version")
    assert id_index.known(spark, path)
    moved = ["c1", "c7"]
    spoil(path, kept(spark, moved + ["late"]))
    store.upsert(versions(spark, moved, [4, 4], 3, "moved"), path, "comments", "comment_id", "version")
    store.append(versions(spark, ["late"], [3], 1), path, "comments")
    store.upsert(versions(spark, ["late"], [1], 2, "moved"), path, "comments", "comment_id", "version")
    rows = {r["comment_id"]: (r["text"], r["month"], r["metadata"]) for r in store.read(spark, path).collect()}
    assert len(rows) == 202 and store.read(spark, path).count() == 202
    assert rows["c0"] == ("new", "202401", {"k": "2"}) and rows["new"][0] == "new"
    assert rows["c1"][:2] == rows["c7"][:2] == ("moved", "202404") and rows["late"][:2] == ("moved", "202401")
    assert rows["c2"] == ("old", "202403", {"k": "1"})


def test_inserts_skip_stored_ids(spark, tmp_path):
    path = str(tmp_path / "comments")
    store.insert_new(versions(spark, ["a", "b", "a"], [1, 2, 1], 1), path, "comments")
    spoil(path, kept(spark, ["b", "c"]))
    store.insert_new(versions(spark, ["b", "c", "c"], [3, 3, 3], 2, "second"), path, "comments")
    rows = [(r["comment_id"], r["text"], r["month"]) for r in store.read(spark, path).orderBy("comment_id").collect()]
    assert rows == [("a", "old", "202401"), ("b", "old", "202402"), ("c", "second", "202403")]


def test_compacting_ids_keeps_every_entry(spark, tmp_path):
    path = str(tmp_path / "comments")
    for month in (1, 2, 2):
        id_index.record(versions(spark, ["a", "b", "c"], [month] * 3, 1).withColumn("month", sc.month_key("timestamp")), path, "comment_id")
    id_index.compact(spark, path)
    ids = spark.createDataFrame([("a",), ("x",), (None,)], "comment_id string")
    found = sorted(tuple(r) for r in id_index.entries_of(spark, path, ids, "comment_id").collect())
    assert found == [("a", "202401"), ("a", "202402")]


def test_store_new_reads_ids_of_earlier_batches_only(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "kept", "checkpoint"))
    schema = "comment_id string, n int"
    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        sinks.finish(pipelines.store_new(stream, path, checkpoint))
    run([("a", 1), ("b", 1), ("a", 1)])
    run([("c", 2), ("a", 2)])
    spoil(path, kept(spark, ["b", "d"]))
    run([("b", 3), ("d", 3)])
    found = sorted((r["comment_id"], r["n"]) for r in sinks.read_batches(spark, path).collect())
    assert found == [("a", 1), ("b", 1), ("c", 2), ("d", 3)]
