from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatterlens.functions import decode as dec, labels as lab, scalars as sc

LABEL = "array<struct<entity:string,aspect:string,opinion:string,sentiment:string,confidence:double>>"


def values(spark, data, schema, **columns):
    df = spark.createDataFrame(data, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_trend_direction_edges(spark):
    data = [(10, 0), (11, 0), (30, 10), (15, 10), (10, 15), (11, 15), (10, 10), (0, 5), (29, 10)]
    got = values(spark, data, "c int, p int", d=sc.trend_direction("c", "p"))
    assert [g[0] for g in got] == [
        "rising", "spike", "spike", "rising", "falling", "stable", "stable", "falling", "rising"]


def test_severity_and_tone(spark):
    got = values(spark, [(15.0,), (14.99,), (-30.0,), (50.0,)], "x double", s=sc.severity("x"))
    assert [g[0] for g in got] == ["medium", "low", "high", "critical"]
    got = values(spark, [(0.2,), (0.21,), (-0.2,), (-0.3,)], "x double", t=sc.tone("x"))
    assert [g[0] for g in got] == ["neutral", "positive", "neutral", "negative"]


def test_score_is_clamped_and_weighted(spark):
    got = values(spark, [(0.0, 50.0), (1.0, 200.0), (-1.0, -50.0)], "s double, e double",
                 x=sc.engagement_adjusted_score("s", "e"))
    assert [round(g[0], 6) for g in got] == [0.5, 1.0, 0.0]


def test_deviation_guards(spark):
    data = [(1.0, 0.0), (3.0, 2.0)]
    assert values(spark, data, "x double, m double", v=sc.deviation_pct("volume", "x", "m")) == [(0.0,), (50.0,)]
    got = values(spark, data, "x double, m double", v=sc.deviation_pct("sentiment", "x", "m"))
    assert [round(g[0], 4) for g in got] == [10000.0, 49.7512]


def test_percent_of_nothing(spark):
    assert values(spark, [(0, 0), (1, 4)], "a int, b int", p=sc.percent("a", "b")) == [(0.0,), (25.0,)]


@pytest.mark.parametrize("text, phrase, expected", [
    ("Dàn CAST rất hay", "dàn cast", (0, 8)),
    ("abc", "", (-1, -1)), ("abc", "NULL", (-1, -1)), ("abc", None, (-1, -1)), ("abc", "x", None),
])
def test_find_span(spark, text, phrase, expected):
    got = values(spark, [(text, phrase)], "t string, p string", s=sc.find_span("t", "p"))[0][0]
    assert (tuple(got) if got else None) == expected


def test_preview_and_capitalise(spark):
    got = values(spark, [("a" * 101,), ("b" * 100,)], "t string", p=sc.preview("t"))
    assert got == [("a" * 100 + "...",), ("b" * 100,)]
    assert values(spark, [("tích CỰC xin",)], "t string", c=sc.capitalise("t")) == [("Tích cực xin",)]


def test_tokens_and_has_token_agree(spark):
    data = [("Été, über_alles: the2 the!",), ("",), ("breathe",)]
    got = values(spark, data, "t string", k=sc.tokens("t"), h=sc.has_token("t", ["the", "über"]))
    assert got == [(["été", "über", "alles", "the2", "the"], True), ([], False), (["breathe"], False)]


def test_windows_and_ranges(spark):
    got = values(spark, [(datetime(2024, 1, 1, 10, 7, 30),)], "t timestamp_ntz",
                 five=sc.window_start("t", "5 minutes"), month=sc.month_key("t"))
    assert got == [(datetime(2024, 1, 1, 10, 5), "202401")]
    assert sc.range_span("1hour") == timedelta(hours=1)
    assert sc.range_span("other") == timedelta(minutes=15)
    assert sc.range_span(None, 60) == timedelta(hours=1)
    assert sc.granularity_width("minute") == "1 minutes" and sc.granularity_width("x") == "5 minutes"


def test_parse_time(spark):
    got = values(spark, [("2024-01-01T19:30:00",), ("nonsense",)], "t string", p=sc.parse_time("t"))
    assert got == [(datetime(2024, 1, 1, 19, 30),), (None,)]


def test_fingerprint_depends_on_arguments(spark):
    got = values(spark, [("a", 1), ("a", 2), ("a", 1)], "x string, y int", k=sc.fingerprint("p", "x", "y"))
    assert got[0] == got[2] != got[1] and got[0][0].startswith("cache:p:")


def test_costly_values_are_kept_once(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, v array<int>")
    assert sorted(map(tuple, sc.each(df, "v", "x", "id").collect())) == [(1, 1), (1, 2)]
    kept = sc.where_found(df, "v", F.when(F.size("v") > 0, F.col("v")))
    assert [tuple(r) for r in kept.select("id", "v").collect()] == [(1, [1, 2])]


# --- labels -----------------------------------------------------------------

def q(entity, aspect="Khác", opinion="", sentiment="trung lập"):
    return (entity, aspect, opinion, sentiment, 1.0)


def test_backlog_rule(spark):
    stamp = datetime(2024, 1, 1)
    data = [(1, None, None), (2, [], None), (3, [], stamp), (4, [q("a")], stamp), (5, None, stamp)]
    got = values(spark, data, f"id int, labels {LABEL}, predicted_at timestamp",
                 i=F.col("id"), n=lab.needs_labeling(), h=lab.has_labels("labels"))
    assert got == [(1, True, False), (2, True, False), (3, False, False), (4, False, True), (5, False, False)]


def test_both_neutral_spellings(spark):
    data = [("trung tính",), ("trung lập",), ("Tích cực",), ("tiêu cực",), ("positive",), ("?",), (None,)]
    got = values(spark, data, "s string", e=lab.english_sentiment("s"))
    assert [g[0] for g in got] == ["neutral", "neutral", "positive", "negative", "positive", "neutral", "neutral"]


def test_majority_and_topics(spark):
    pos, neg = q("x", sentiment="tích cực"), q("", sentiment="tiêu cực")
    data = [([pos, pos, neg],), ([pos, neg],), ([neg, neg, pos],), ([],), ([neg],)]
    got = values(spark, data, f"labels {LABEL}", s=lab.majority_sentiment("labels"), t=lab.topics_of("labels"))
    assert got == [("positive", ["x"]), ("neutral", ["x"]), ("negative", ["x"]), ("neutral", ["general"]),
                   ("negative", ["general"])]


def test_ids_fall_back_to_neutral_and_other(spark):
    data = [("Quảng cáo", "tiêu cực"), ("unknown", "unknown"), ("Dàn cast", "trung lập")]
    got = values(spark, data, "a string, s string", a=lab.aspect_id("a"), s=lab.sentiment_id("s"))
    assert got == [(7, 2), (0, 0), (4, 0)]


def test_align_and_targets(spark):
    text = " Dàn cast chơi rất tốt"
    labels = [
        q("Dàn cast", "Dàn cast", "rất tốt", "tích cực"), q("absent", opinion="rất"),
        q("null", "Khác", "chơi", "tiêu cực"), q("cast", opinion="absent"),
    ]
    df = spark.createDataFrame([(text, labels)], f"text string, labels {LABEL}")
    aligned = df.withColumn("labels", lab.align("labels", "text"))
    row = aligned.select("labels", lab.target_matrix("labels", "text").alias("t")).first()
    assert [(x["entity"], tuple(x["entity_span"]), tuple(x["opinion_span"])) for x in row["labels"]] == [
        ("Dàn cast", (1, 9), (15, 22)), ("null", (-1, -1), (10, 14))]
    assert row["t"] == [[1, 2, 4, 5, 4, 1], [0, 0, 3, 3, 0, 2], [-1] * 6, [-1] * 6]


def test_targets_cut_to_four_and_beyond_model(spark):
    text = "w " * 300 + "end"
    df = spark.createDataFrame([(text, [q("end")] * 5)], f"text string, labels {LABEL}")
    model = df.select(lab.target_matrix(lab.align("labels", "text"), "text", max_tokens=256).alias("t")).first()
    assert model["t"] == [[0, 0, 0, 0, 0, 0]] * 4
    whole = df.select(lab.target_matrix(lab.align("labels", "text"), "text").alias("t")).first()
    assert whole["t"] == [[301, 301, 0, 0, 0, 0]] * 4


# --- decoding ---------------------------------------------------------------

HEADS = "aspect array<double>, sentiment array<double>, e_start array<double>, e_end array<double>, " \
        "o_start array<double>, o_end array<double>"


def one_hot(size, at, height=9.0):
    return [height if i == at else 0.0 for i in range(size)]


def slot(aspect=4, sentiment=1, es=1, ee=2, os=3, oe=4, height=9.0):
    return (one_hot(11, aspect, height), one_hot(3, sentiment, height), one_hot(6, es), one_hot(6, ee),
            one_hot(6, os), one_hot(6, oe))


def decoded(spark, data, **options):
    df = spark.createDataFrame(data, HEADS)
    return [r["q"] for r in df.select(dec.decode(
        "aspect", "sentiment", "e_start", "e_end", "o_start", "o_end", **options).alias("q")).collect()]


def test_decode_rules(spark):
    data = [slot(), slot(es=3, ee=2), slot(os=4, oe=3), slot(es=0), slot(ee=0, es=0), slot(height=0.1)]
    got = decoded(spark, data, threshold=0.5)
    assert [g is not None for g in got] == [True, False, False, False, False, False]
    assert (got[0]["aspect"], got[0]["sentiment"], got[0]["confidence"]) == ("Dàn cast", "tích cực", 0.999)


def test_decode_texts(spark):
    words = F.lit(["<s>", "Trấn_Thành", "dẫn", "rất", "hay"])
    got = decoded(spark, [slot(), slot(es=5, ee=5)], tokens=words)
    assert (got[0]["entity"], got[0]["opinion"]) == ("Trấn Thành dẫn", "rất hay")
    assert got[1] is None
    blank = F.lit(["<s>", "_", "_", "x", "y"])
    assert decoded(spark, [slot()], tokens=blank) == [None]


def test_decode_all_slots(spark):
    df = spark.createDataFrame([([slot(), slot(es=0), slot(aspect=7)],)], f"slots array<struct<{HEADS.replace(' array', ':array')}>>")
    quads = df.select(dec.decode_slots("slots", 0.5).alias("q")).first()["q"]
    assert [x["aspect"] for x in quads] == ["Dàn cast", "Quảng cáo"]
