from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatterlens.operators import checks, filters, joins, labeling, metrics as mt, rollups, rules, search, training, windows

T0 = datetime(2024, 1, 1)
COMMENT = ("comment_id long, program_id string, timestamp timestamp_ntz, sentiment string, sentiment_score double, "
           "engagement_score double, topics array<string>")
SCORES = {"positive": 0.7, "negative": -0.6, "neutral": 0.0}


def comment(number, minutes, sentiment="neutral", topics=("a",), program="p", engagement=50.0):
    return (number, program, T0 + timedelta(minutes=minutes), sentiment, SCORES[sentiment], engagement, list(topics))


def frame(spark, *data):
    return spark.createDataFrame(list(data), COMMENT)


def series(spark, scores, program="p"):
    data = [(program, T0 + timedelta(minutes=5 * i), float(s), 10, 0.1) for i, s in enumerate(scores)]
    return spark.createDataFrame(
        data, "program_id string, window_start timestamp_ntz, score double, total_comments long, avg_sentiment double")


# --- filters ----------------------------------------------------------------

def test_range_is_inclusive_and_trailing(spark):
    df = frame(spark, *[comment(i, i) for i in range(5)])
    ids = lambda d: sorted(r[0] for r in d.select("comment_id").collect())
    assert ids(filters.in_range(df, T0 + timedelta(minutes=1), T0 + timedelta(minutes=3))) == [1, 2, 3]
    assert ids(filters.trailing(df, timedelta(minutes=2))) == [2, 3, 4]
    assert ids(filters.trailing(df, timedelta(minutes=2), as_of=T0 + timedelta(minutes=3))) == [1, 2, 3]
    assert ids(filters.in_labeled_range(df, "5min")) == [0, 1, 2, 3, 4]


def test_pages_and_overlap(spark):
    df = frame(spark, comment(1, 1, topics=("a", "b")), comment(2, 1), comment(3, 0, topics=("c",)))
    ids = lambda d: [r[0] for r in d.select("comment_id").collect()]
    assert ids(filters.newest(df, 2)) == [2, 1]
    assert ids(filters.newest(df, 2, skip=1)) == [1, 3]
    assert ids(filters.any_of(df, "topics", ["b", "c"])) == [1, 3]
    assert ids(filters.any_of(df, "topics", None)) == [1, 2, 3]


def test_events_skip_bad_json_after_the_limit(spark):
    good = '{"timestamp":"t","event_type":"segment_start","description":"d"}'
    data = [("p", T0, 1, good), ("p", T0, 2, "{broken"), ("p", T0, 3, good), ("p", T0 + timedelta(days=1), 4, good)]
    df = spark.createDataFrame(data, "program_id string, event_time timestamp_ntz, seq int, payload string")
    day = F.lit("2024-01-01").cast("date")
    assert [r["seq"] for r in filters.events_on(df, day).collect()] == [1, 3]
    assert [r["seq"] for r in filters.events_on(df, day, limit=2).collect()] == [1]


# --- rollups ----------------------------------------------------------------

def test_partials_add_up_to_the_whole(spark, rows):
    data = [comment(i, i, s) for i, s in enumerate(["positive", "negative", "neutral"] * 7)]
    whole = rollups.by_program(frame(spark, *data))
    parts = rollups.by_program(frame(spark, *data[:9])).unionByName(rollups.by_program(frame(spark, *data[9:])))
    merged = rollups.merge(parts, ["program_id", "window_start"])
    tidy = lambda df: sorted((r["window_start"], r["total_comments"], round(r["sentiment_sum"], 9)) for r in rows(df))
    assert tidy(merged) == tidy(whole)
    scored = rollups.with_score(merged)
    assert {r["violations"] for r in rows(checks.violations(scored, checks.metric_rules()))} == {0}


def test_empty_input(spark):
    empty = frame(spark).limit(0)
    assert rollups.program_metrics(empty).count() == 0
    assert windows.trending_topics(empty, timedelta(days=1)).count() == 0
    assert mt.top_entities(empty).count() == 0


def test_element_and_document_counts_differ(spark, rows):
    df = frame(spark, comment(1, 0, topics=("a", "a")), comment(2, 0, topics=()))
    assert rows(mt.top_entities(df))[0]["mention_count"] == 2
    assert rows(mt.entity_doc_counts(df))[0]["count"] == 1
    assert rollups.by_topic(df).count() == 1


def test_top_topics_means(spark, rows):
    data = [("p", T0, "a", 1, 0.5), ("p", T0 + timedelta(hours=1), "a", 3, 0.0)]
    df = spark.createDataFrame(data, "program_id string, hour_start timestamp_ntz, topic string, mention_count long, sentiment_sum double")
    row = rows(mt.top_topics(df))[0]
    assert (row["count"], row["avg_sentiment"], row["weighted_sentiment"]) == (4, 0.25, 0.125)


def test_label_report_and_stats(spark, rows):
    quads = spark.createDataFrame(
        [("positive", "a", "x"), ("negative", "a", "y"), ("negative", "b", "y")], "sentiment string, entity string, aspect string")
    report = {(r["kind"], r["key"]): r["count"] for r in rows(mt.label_report(quads))}
    assert report[("entity", "a")] == 2 and report[("sentiment", "negative")] == 2 and len(report) == 6
    assert rows(mt.negative_aspects(quads)) == [{"aspect": "y", "count": 2, "negative_pct": 100.0}]
    assert rows(mt.distinct_counts(quads)) == rows(mt.approx_distinct_counts(quads)) == [{"entities": 2, "aspects": 2}]
    empty = spark.createDataFrame([], "is_used_for_training boolean")
    assert rows(mt.training_stats(empty)) == [{"total": 0, "used": 0, "unused": 0, "usage_rate": 0.0}]


# --- windows ----------------------------------------------------------------

@pytest.mark.parametrize("points, expected", [([1, 1, 1, 1, 9], 0), ([1, 1, 1, 1, 1, 9], 1), ([1, 9], 0), ([5] * 8, 0)])
def test_one_outlier_needs_six_points(spark, points, expected):
    assert windows.anomalies(series(spark, points), "eaos").count() == expected


def test_anomaly_fields(spark, rows):
    found = rows(windows.anomalies(series(spark, [1, 1, 1, 1, 1, 9])))
    assert len(found) == 1
    row = found[0]
    assert (row["metric"], row["metric_value"], row["expected_value"]) == ("eaos", 9.0, 2.3333)
    assert (row["deviation_pct"], row["severity"]) == (285.71, "critical")
    assert rows(windows.newest_anomalies(windows.anomalies(series(spark, [1] * 5 + [9]))))[0]["total_anomalies"] == 1
    zero = windows.anomalies(series(spark, [0, 0, 0, 0, 0, 0, 0, -1, 1, 0, 8, -8]), "eaos")
    assert {r["deviation_pct"] for r in rows(zero)} == {0.0}


def test_events_between_points(spark, rows):
    data = [("p", T0, 10, 0.5), ("p", T0 + timedelta(minutes=5), 16, 0.41), ("p", T0 + timedelta(minutes=10), 24, 0.3)]
    df = spark.createDataFrame(data, "program_id string, window_start timestamp_ntz, total_comments long, score double")
    found = rows(windows.program_events(df, marker_at=T0).orderBy("timestamp", "event_type"))
    assert [(r["event_type"], r["description"]) for r in found] == [
        ("segment", "Program segment (inferred)"),
        ("volume_spike", "Sudden increase in viewer engagement (16 comments)"),
        ("eaos_drop", "EAOS dropped from 0.41 to 0.30")]


def test_latest_and_expiry(spark, rows):
    df = series(spark, [0.1, 0.2]).unionByName(series(spark, [0.9], "q"))
    latest = windows.latest_per_program(df, columns=("score",)).orderBy("program_id")
    assert [(r["program_id"], r["score"]) for r in rows(latest)] == [("p", 0.2), ("q", 0.9)]
    current = df.withColumnRenamed("window_start", "updated_at")
    alive = windows.unexpired(current, timedelta(minutes=5), as_of=T0 + timedelta(minutes=8))
    assert [r["score"] for r in rows(alive)] == [0.2]


def test_sorted_set_order(spark, rows):
    df = spark.createDataFrame([("a", 2), ("b", 2), ("c", 5), ("d", 1)], "topic string, n int")
    assert [(r["topic"], r["rank"]) for r in rows(windows.ranked(df, "n", 3))] == [("c", 1), ("b", 2), ("a", 3)]
    gaps = rows(checks.rank_gaps(windows.ranked(df, "n", 3)))
    assert gaps == [{"rule": "ranks_complete", "violations": 0}]
    assert rows(checks.rank_gaps(windows.ranked(df, "n", 3).filter("rank <> 2")))[0]["violations"] == 1


def test_trends_use_both_windows(spark, rows):
    before = [comment(i, 0, topics=("old",)) for i in range(3)]
    now = [comment(10 + i, 60, "positive", ("new", "x")) for i in range(12)]
    df = frame(spark, *before, *now)
    found = {r["topic"]: r for r in rows(windows.trending_topics(df, timedelta(minutes=40)))}
    assert found["new"]["trend_direction"] == "spike" and found["new"]["sentiment"] == 0.7
    assert set(found) == {"new", "x"}
    related = rows(windows.related_topics(df, windows.trending_topics(df, timedelta(minutes=40))))
    assert {r["topic"]: r["related_entities"] for r in related} == {"new": ["x"], "x": ["new"]}


def test_recent_events_limits(spark, rows):
    data = [("p", T0 + timedelta(days=d, minutes=m), "e", "t") for d in range(3) for m in range(4)]
    df = spark.createDataFrame(data, "program_id string, timestamp timestamp_ntz, event_type string, description string")
    kept = rows(windows.recent_events(df, days=2, limit=3))
    assert sorted(r["timestamp"] for r in kept) == [T0 + timedelta(days=2, minutes=m) for m in (1, 2, 3)]


# --- joins ------------------------------------------------------------------

def test_interval_join_matches_brute_force(spark):
    moments = [("p", T0 + timedelta(minutes=17 * i)) for i in range(20)]
    events = [("p", T0 + timedelta(minutes=13 * i)) for i in range(30)] + [("q", T0)]
    schema = "program_id string, timestamp timestamp_ntz"
    got = joins.around(spark.createDataFrame(moments, schema), spark.createDataFrame(events, schema))
    expected = {(m, e) for p, m in moments for k, e in events if p == k and abs(m - e) <= timedelta(minutes=30)}
    pairs = [(r["moment"], r["event_time"]) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def test_comparison(spark, rows):
    scores = spark.createDataFrame([("a", 0.52, 3), ("b", 0.50, 4), ("c", 0.80, 5)], "program_id string, score double, total_comments long")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "a"), ("a", "none")], "entity_1 string, entity_2 string")
    got = {(r["entity_1"], r["entity_2"]): r for r in rows(joins.compare(scores, pairs))}
    assert got["a", "b"]["winner"] == "tie" and got["a", "b"]["difference_pct"] == 4.0
    assert got["a", "c"]["winner"] == "c" and got["c", "a"]["winner"] == "c"
    assert "(EAOS: 0.80 vs 0.52, 53.8% difference)" in got["c", "a"]["summary"]
    assert got["a", "none"]["winner"] == "tie" and got["a", "none"]["score_2"] == 0


def test_cache_expires(spark, rows):
    cached = spark.createDataFrame([("a", 0.1, T0), ("b", 0.2, T0 - timedelta(hours=2))], "program_id string, score double, updated_at timestamp_ntz")
    stored = spark.createDataFrame([("b", 0.9), ("c", 0.8)], "program_id string, score double")
    got = {r["program_id"]: (r["score"], r["origin"]) for r in rows(joins.cached_or_stored(cached, stored, T0))}
    assert got == {"a": (0.1, "cache"), "b": (0.9, "store"), "c": (0.8, "store")}


def test_current_and_previous(spark, rows):
    schema = "topic string, mention_count long"
    got = rows(joins.current_with_previous(spark.createDataFrame([("a", 1)], schema), spark.createDataFrame([("b", 2)], schema)))
    assert sorted((r["topic"], r["current_count"], r["previous_count"]) for r in got) == [("a", 1, 0), ("b", 0, 2)]


def test_not_stored_collapses_copies(spark):
    new = spark.createDataFrame([(1,), (2,), (2,), (3,)], "comment_id int")
    stored = spark.createDataFrame([(3,)], "comment_id int")
    assert sorted(r[0] for r in joins.not_stored(new, stored).collect()) == [1, 2]


# --- search -----------------------------------------------------------------

def texts(spark, *bodies):
    data = [(i, b, T0 + timedelta(minutes=i), "neutral", "u", None) for i, b in enumerate(bodies)]
    return spark.createDataFrame(
        data, "comment_id int, text string, timestamp timestamp_ntz, sentiment string, username string, engagement_score double")


def test_bm25_by_hand(spark, rows):
    import math

    docs = ["red red blue", "blue green", "green", "RED."]
    got = {r["comment_id"]: r["relevance"] for r in rows(search.with_relevance(texts(spark, *docs), "Red blue"))}
    cut = [["red", "red", "blue"], ["blue", "green"], ["green"], ["red"]]
    mean = sum(map(len, cut)) / len(cut)

    def score(words):
        total = 0.0
        for t in ("red", "blue"):
            df, tf = sum(t in d for d in cut), words.count(t)
            idf = math.log(1 + (len(cut) - df + 0.5) / (df + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        return total
    expected = {i: score(d) for i, d in enumerate(cut) if "red" in d or "blue" in d}
    assert got.keys() == expected.keys()
    assert all(abs(got[i] - expected[i]) < 1e-12 for i in expected)


def test_relevance_uses_the_whole_corpus(spark, rows):
    df = texts(spark, "red blue", "red", "green")
    page = rows(search.text_search(df, "red", size=1))
    assert [r["comment_id"] for r in page] == [1]
    full = {r["comment_id"]: r["relevance"] for r in rows(search.with_relevance(df, "red"))}
    assert page[0]["relevance"] == full[1]


def test_search_counts_all_hits(spark, rows):
    df = texts(spark, *["Âm THANH kém"] * 5, "khác")
    assert len(rows(search.substring_search(df, "âm thanh", limit=3))) == 3
    page = rows(search.search_page(df, "thanh", limit=2))
    assert [(r["comment_id"], r["total_found"], r["engagement_score"]) for r in page] == [(4, 5, 0.0), (3, 5, 0.0)]
    assert rows(search.search_page(df, "nothing")) == []


# --- labeling ---------------------------------------------------------------

TEXTS = ["The host and the guest", "nothing here", "", "para que les pour die und and the", "breathe, théâtre"]


def test_three_ways_agree(spark, rows):
    df = texts(spark, *TEXTS)
    inline = rows(labeling.quad_rows(df))
    joined = rows(labeling.lexicon_join(df, labeling.lexicon_frame(spark)))
    scored = rows(mt.quads_of(labeling.label(df), "comment_id"))
    names = lambda found: sorted((r["comment_id"], r["opinion"]) for r in found)
    assert names(inline) == names(joined) == names(scored) == [
        (0, "and"), (0, "the"), *((3, p) for p in ("and", "die", "les", "para", "pour", "que", "the", "und"))]


def test_failing_scorer_marks_only_its_text(spark, rows):
    def load():
        def score(batch):
            if any("bad" in t for t in batch):
                raise ValueError("cannot read")
            return [[{"entity": "e", "aspect": "a", "opinion": "o", "sentiment": "s", "confidence": 0.6}] for _ in batch]
        return score
    found = rows(labeling.label(texts(spark, "fine", "bad", "ok"), load))
    by_id = {r["comment_id"]: r for r in found}
    assert by_id[1]["labels"] == [] and "cannot read" in by_id[1]["error"]
    assert by_id[0]["error"] is None and len(by_id[2]["labels"]) == 1
    assert checks.violations(labeling.label(texts(spark, "fine"), load), checks.prediction_rules()).filter("violations > 0").count() == 0
    strict = labeling.label(texts(spark, "fine"), load, min_confidence=0.7)
    assert rows(strict)[0]["labels"] == []


def test_merge_predictions_stamps_empty_results(spark, rows):
    label = "array<struct<entity:string,aspect:string,opinion:string,sentiment:string,confidence:double>>"
    comments = spark.createDataFrame([(1, None, None), (2, None, None), (3, None, None)], f"comment_id int, labels {label}, predicted_at timestamp")
    found = spark.createDataFrame([(1, [("e", "a", "o", "s", 1.0)]), (2, [])], f"comment_id int, labels {label}")
    got = {r["comment_id"]: r for r in rows(joins.merge_predictions(comments, found, T0))}
    assert len(got[1]["labels"]) == 1 and got[1]["predicted_at"] == T0
    assert got[2]["labels"] == [] and got[2]["predicted_at"] == T0
    assert got[3]["labels"] is None and got[3]["predicted_at"] is None


# --- training ---------------------------------------------------------------

def test_split_is_stable_and_shares_hold(spark, rows):
    df = spark.range(20_000).withColumnRenamed("id", "comment_id")
    counts = {r["split"]: r["count"] for r in rows(training.with_split(df).groupBy("split").count())}
    assert abs(counts["train"] - 16_000) < 400 and abs(counts["val"] - 2_000) < 300
    again = training.with_split(df.repartition(3)).join(training.with_split(df).withColumnRenamed("split", "other"), "comment_id")
    assert again.filter("split <> other").count() == 0
    two = {r["split"] for r in rows(training.with_split(df, shares=training.TWO_WAY).select("split").distinct())}
    assert two == {"train", "val"}


def test_quality_gate(spark):
    with pytest.raises(ValueError, match="99 < 100"):
        training.require_quality(spark.range(99))
    assert training.require_quality(spark.range(100)) == 100


def test_slot_metrics(spark, rows):
    hit, miss, pad = [1, 2, 3, 4, 5, 1], [1, 2, 3, 4, 5, 2], [-1] * 6
    df = spark.createDataFrame([([hit, hit, hit], [hit, miss, pad])], "p array<array<int>>, t array<array<int>>")
    row = rows(training.slot_metrics(df, "p", "t"))[0]
    assert (row["valid"], row["tp"]) == (2, 1) and row["accuracy"] == row["precision"] == row["recall"] == row["f1_score"] == 0.5
    none = rows(training.slot_metrics(df.select("p", F.array(F.lit(pad)).alias("t")), "p", "t"))[0]
    assert none["accuracy"] == 0.0


def test_quad_metrics(spark, rows):
    schema = "comment_id int, aspect string"
    row = rows(training.quad_metrics(
        spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], schema),
        spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], schema), ("comment_id", "aspect")))[0]
    assert (row["tp"], row["fp"], row["fn"], row["precision"]) == (1, 1, 2, 0.5) and abs(row["f1_score"] - 0.4) < 1e-12


def test_best_epoch_with_patience(spark, rows):
    scores = [0.1, 0.5, 0.4, 0.5, 0.3, 0.9]
    df = spark.createDataFrame([("r", i + 1, s) for i, s in enumerate(scores)], "run string, epoch int, f1 double")
    assert rows(training.best_epoch(df, patience=3)) == [{"run": "r", "best_epoch": 2, "best_f1": 0.5, "last_epoch": 5}]
    assert rows(training.best_epoch(df, patience=20))[0]["best_epoch"] == 6


def test_deploy_gate(spark, rows):
    schema = "model string, loss double"
    got = rows(training.deploy_decisions(
        spark.createDataFrame([("a", 14.0), ("b", 14.0), ("c", 16.0)], schema), spark.createDataFrame([("b", 14.0)], schema)))
    assert {r["model"]: r["decision"] for r in got} == {"a": "deployed", "b": "skipped", "c": "skipped"}


def test_classifier_learns(spark):
    data = [(f"rất hay {i}", "positive") for i in range(40)] + [(f"nhàm chán {i}", "negative") for i in range(40)]
    df = spark.createDataFrame(data, "text string, sentiment string")
    model = training.fit_best(df, "sentiment", strengths=(0.01, 0.1))
    result = training.evaluate(model, df, "sentiment")
    assert result["f1"] > 0.95 and result["loss"] < 0.5


# --- rules and reports ------------------------------------------------------

@pytest.mark.parametrize("context, confidence", [
    ("EAOS drop and negative tone", 0.85), ("eaos decrease", 0.75), ("Volume spike", 0.80),
    ("negative complaint", 0.82), ("popular now", 0.78), ("bad audio, eaos drop, negative", 0.90),
    ("an anomaly", 0.70), ("all quiet", 0.60), ("negative eaos drop with an issue", 0.85),
])
def test_recommendations(spark, rows, context, confidence):
    df = spark.createDataFrame([(context,)], "context string")
    assert rows(rules.recommend(df))[0]["confidence"] == confidence


def test_routes_and_intents(spark, rows):
    data = [("Tóm tắt sentiment",), ("CẢM XÚC?",), ("Thực thể nào",), ("khía cạnh",), ("tìm search quà",), ("có vấn đề",), ("hi",)]
    df = spark.createDataFrame(data, "m string").select(rules.chat_route("m").alias("r"), rules.search_phrase("m").alias("s"))
    got = rows(df)
    assert [r["r"] for r in got] == ["summary", "sentiment", "entity", "aspect", "search", "problem", "help"]
    assert got[4]["s"] == "quà"
    data = [("Why compare?",), ("A versus B",), ("what to do",), ("now",)]
    got = rows(spark.createDataFrame(data, "q string").select(rules.intent("q").alias("i")))
    assert [r["i"] for r in got] == ["investigation", "comparison", "recommendation", "status_check"]


def test_fenced_json(spark, rows):
    data = [('x ```json\n{"intent": "a"}\n``` y',), ('``` {"intent": "b"} ```',), (' {"intent": "c"} ',), ("no json",)]
    got = rules.parse_answers(spark.createDataFrame(data, "answer string"), "answer", "intent string")
    assert [r["parsed"] and r["parsed"]["intent"] for r in rows(got)] == ["a", "b", "c", None]


def test_run_log(spark, rows):
    runs = spark.createDataFrame([("t", True, 10.0), ("t", False, 30.0)], "tool string, success boolean, duration_ms double")
    assert rows(rules.tool_summary(runs)) == [{"tool": "t", "calls": 2, "succeeded": 1, "avg_duration_ms": 20.0}]
    log = spark.createDataFrame([("[plan] look at [x] first",), ("[plan] b",), ("no step",)], "trace string")
    steps = rows(rules.trace_steps(log))
    assert [(r["step"], r["description"]) for r in steps] == [("plan", "look at [x] first"), ("plan", "b")]
    assert rows(rules.step_counts(log)) == [{"step": "plan", "lines": 2}]


def test_topic_details_of_nothing(spark, rows):
    df = frame(spark).withColumn("text", F.lit("x")).limit(0)
    row = rows(mt.topic_details(df))[0]
    assert row["total_mentions"] == 0 and row["avg_sentiment"] == 0.0 and row["samples"] == []


# --- checks -----------------------------------------------------------------

def test_violations_are_counted(spark, rows):
    bad = spark.createDataFrame(
        [("", 1.5, 1, 1, 1, 4), (None, None, -1, 0, 1, 0)],
        "program_id string, score double, positive_count int, negative_count int, neutral_count int, total_comments int")
    got = {r["rule"]: r["violations"] for r in rows(checks.violations(bad, checks.metric_rules()))}
    assert got == {"score_in_range": 2, "counts_add_up": 1, "counts_not_negative": 1, "program_present": 2}
    with pytest.raises(ValueError):
        checks.check_limit(101)


def test_schema_generations(spark, rows):
    v1 = spark.createDataFrame(
        [("c", "contestant_1", "t", "u", T0, "trung lập", 0.0, ["x"], {"k": "v"})],
        "comment_id string, entity string, text string, username string, timestamp timestamp, sentiment string, "
        "sentiment_score double, entities array<string>, metadata map<string,string>")
    v2 = rows(checks.comments_to_v2(v1, "show"))[0]
    assert (v2["program_id"], v2["sentiment"], v2["topics"], v2["metadata"]) == ("show/contestant_1", "neutral", ["x"], '{"k":"v"}')
    assert rows(checks.comments_as_v1(checks.comments_to_v2(v1)))[0]["entities"] == ["x"]
    points = spark.createDataFrame([("e", T0, 0.5, 1, m) for m in (5, 15, 60, 7)],
                                   "entity string, timestamp timestamp, eaos_score double, comment_count long, time_window_minutes int")
    assert [r["time_range"] for r in rows(checks.metrics_to_v2(points))] == ["5min", "15min", "1hour", None]
