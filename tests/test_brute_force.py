"""Random and skewed inputs against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta
from statistics import mean, stdev

import regex
from pyspark.sql import functions as F

from chatterlens.functions import labels as lab, scalars as sc
from chatterlens.operators import labeling, metrics as mt, rollups, windows
from chatterlens.sources import store

ALPHABET = "abÉéß1_ \t\n.,đĐ"
LABEL = "array<struct<entity:string,aspect:string,opinion:string,sentiment:string,confidence:double>>"
T0 = datetime(2024, 1, 1)


def random_texts(count, seed=7):
    dice = random.Random(seed)
    return ["".join(dice.choices(ALPHABET, k=dice.randint(0, 40))) for _ in range(count)]


def test_tokens_and_spans(spark):
    dice = random.Random(3)
    data = [(t, t[(i := dice.randint(0, max(len(t) - 1, 0))):i + dice.randint(1, 4)].upper() if dice.random() < 0.8 else "zz")
            for t in random_texts(500)]
    df = spark.createDataFrame(data, "t string, p string")
    for r in df.select("t", "p", sc.tokens("t").alias("k"), sc.find_span("t", "p").alias("s"),
                       sc.has_token("t", ["a", "ab", "é"]).alias("h")).collect():
        words = regex.findall(r"[\p{L}\p{N}]+", r["t"].lower())
        assert r["k"] == words
        assert r["h"] == bool({"a", "ab", "é"} & set(words))
        at = r["t"].lower().find(r["p"].lower())
        if r["p"] == "":
            assert tuple(r["s"]) == (-1, -1)
        elif len(r["p"].lower()) == len(r["p"]):
            assert (tuple(r["s"]) if r["s"] else None) == ((at, at + len(r["p"])) if at >= 0 else None)


def test_word_numbers(spark):
    """Word spans by walking over the characters, as the tokens would be laid out."""
    dice = random.Random(5)
    data = []
    for t in random_texts(300, seed=11):
        i = dice.randint(0, max(len(t) - 1, 0))
        phrase = t[i:i + dice.randint(1, 8)]
        data.append((t, [(phrase, "Khác", "null", "trung lập", 1.0)]))
    df = spark.createDataFrame(data, f"t string, labels {LABEL}")
    rows = df.select("t", "labels", lab.target_matrix(lab.align("labels", "t"), "t", 1, 6).alias("m")).collect()
    for r in rows:
        text, phrase = r["t"], r["labels"][0]["entity"]
        start = text.lower().find(phrase.lower())
        spans = [m.span() for m in regex.finditer(r"[^ \t\n]+", text)]
        number = lambda c: next((n for n, (a, b) in enumerate(spans, 1) if a <= c < b and n < 6), 0)
        first, last = (0, 0) if phrase == "" else (number(start), number(start + len(phrase) - 1))
        expected = (first, last or first) if first else (0, 0)
        assert tuple(r["m"][0][:2]) == expected, (text, phrase)


def test_one_program_with_a_third_of_all_comments(spark):
    dice = random.Random(9)
    data = []
    for i in range(6000):
        program = "hot" if i % 3 == 0 else f"p{dice.randint(0, 40)}"
        mood = dice.choice(["positive", "negative", "neutral"])
        score = {"positive": 0.7, "negative": -0.6, "neutral": 0.0}[mood]
        minute = 0 if dice.random() < 0.3 else dice.randint(0, 600)
        data.append((i, program, T0 + timedelta(minutes=minute), mood, score, float(dice.randint(5, 100)),
                     ["common"] + [f"t{dice.randint(0, 5)}"]))
    df = spark.createDataFrame(data, "comment_id long, program_id string, timestamp timestamp_ntz, sentiment string, "
                                     "sentiment_score double, engagement_score double, topics array<string>")
    points = rollups.program_metrics(df, "1 hour")

    counts = Counter((p, t.replace(minute=0)) for _, p, t, *_ in data)
    assert {(r["program_id"], r["window_start"]): r["total_comments"] for r in points.collect()} == counts

    expected = set()
    for program in {p for p, _ in counts}:
        series = {t: n for (p, t), n in counts.items() if p == program}
        if len(series) >= 3:
            m, sd = mean(series.values()), stdev(series.values())
            expected |= {(program, t) for t, n in series.items() if abs(n - m) > 2 * sd}
    found = windows.anomalies(points, "volume").collect()
    assert {(r["program_id"], r["timestamp"]) for r in found} == expected and ("hot", T0) in expected

    topics = Counter((p, x) for _, p, *_, ts in data for x in set(ts))
    got = {(r["program_id"], r["topic"]): r["count"] for r in mt.topic_distribution(df).collect()}
    assert got == topics


def test_many_copies_of_one_id(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("comment_id"),
        F.col("id").alias("version"), F.concat(F.lit("v"), F.col("id")).alias("text"))
    rows = {r["comment_id"]: r["version"] for r in store.last_wins(df, "comment_id", "version").collect()}
    assert len(rows) == 6001 and rows[0] == 8997 and rows[1] == 1


def test_equal_versions_keep_the_labeled_row(spark):
    rows = "SELECT 1 AS comment_id, 5 AS version, {} AS text, {} AS predicted_at"
    stamp = "timestamp '2024-01-01'"
    df = spark.sql(" UNION ALL ".join(
        rows.format(*pair) for pair in [("'z'", "CAST(NULL AS timestamp)"), ("'a'", stamp), ("'b'", "CAST(NULL AS timestamp)")]))
    for parts in (1, 3):
        assert [r["text"] for r in store.last_wins(df.repartition(parts), "comment_id", "version").collect()] == ["a"]


def test_lexicon_of_any_size_and_number_of_hits(spark):
    lexicon = [labeling.Entry(f"w{i}", f"e{i}", "x", f"w{i}", "tích cực") for i in range(1200)]
    df = spark.createDataFrame([("1", " ".join(f"w{i}" for i in range(0, 1200, 100)))], "comment_id string, text string")
    expected = {f"e{i}" for i in range(0, 1200, 100)}
    assert {r["entity"] for r in labeling.quad_rows(df, lexicon).collect()} == expected
    frame = spark.createDataFrame(lexicon)
    assert {r["entity"] for r in labeling.lexicon_join(df, frame).collect()} == expected
    assert labeling.lexicon_join(df, frame, max_quads=4).count() == 4


def test_alike_loaders_share_one_scorer(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as out:
            out.write("x")
        return lambda texts: [[] for _ in texts]

    df = spark.createDataFrame([("1", "a")], "comment_id string, text string").coalesce(1)
    for _ in range(3):
        labeling.label(df, load).collect()
    with open(log) as found:
        loads = len(found.read())
    assert 1 <= loads <= 3
    assert labeling.loader_key(load) == labeling.loader_key(load)
