"""Labels: lexicon quads, reports over them, decoding and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chatterlens.functions import decode as dec, labels as lab, scalars as sc
from chatterlens.operators import labeling, metrics as mt, rules, training
from chatterlens.plans.registry import query, r, with_views
from chatterlens.sources import tables

HEADS = ("aspect", "sentiment", "e_start", "e_end", "o_start", "o_end")
QUADS_SQL = with_views("SELECT comment_id, entity, aspect, opinion, sentiment FROM quads", "quads")


def quads(spark: SparkSession, folder: str) -> DataFrame:
    return labeling.quad_rows(tables.timed_texts(spark, folder, heavy=True), labeling.LEXICON, "program_id")


def labeled_texts(spark: SparkSession, folder: str) -> DataFrame:
    return labeling.with_lexicon_labels(tables.timed_texts(spark, folder, heavy=True))


# --- labeling ---------------------------------------------------------------

@query("lexicon_quads", QUADS_SQL)
def lexicon_quads(spark, folder):
    return quads(spark, folder).drop("program_id")


@query("lexicon_quads_join", QUADS_SQL)
def lexicon_quads_join(spark, folder):
    lexicon = labeling.lexicon_frame(spark)
    found = labeling.lexicon_join(tables.timed_texts(spark, folder, heavy=True), lexicon)
    return found.withColumn("sentiment", lab.english_sentiment("sentiment"))


@query("scorer_quads", QUADS_SQL)
def scorer_quads(spark, folder):
    """The same through the batch scorer in Python workers."""
    scored = labeling.label(tables.timed_texts(spark, folder, heavy=True).select("comment_id", "text"))
    return mt.quads_of(scored, "comment_id")


@query("label_run_summary", with_views("""
WITH n AS (SELECT doc_id, count(q.comment_id) AS c FROM documents LEFT JOIN quads q ON q.comment_id = doc_id GROUP BY 1)
SELECT count(*) AS processed, count(*) FILTER (WHERE c > 0) AS with_predictions, count(*) FILTER (WHERE c = 0) AS empty_predictions,
       CAST(sum(c) AS BIGINT) AS total_quads FROM n
""", "quads"))
def label_run_summary(spark, folder):
    return mt.labeling_run_summary(labeled_texts(spark, folder))


# --- reports ----------------------------------------------------------------

@query("label_report", with_views("""
WITH counts AS (
  SELECT 'sentiment' AS kind, sentiment AS "key", count(*) AS n FROM quads GROUP BY 2
  UNION ALL SELECT 'entity', entity, count(*) FROM quads GROUP BY 2
  UNION ALL SELECT 'aspect', aspect, count(*) FROM quads GROUP BY 2)
SELECT kind, "key", n AS "count" FROM counts QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, "key") <= 10
""", "quads"))
def label_report(spark, folder):
    return mt.label_report(quads(spark, folder))


@query("negative_aspects", with_views(f"""
SELECT aspect, count(*) FILTER (WHERE sentiment = 'negative') AS "count",
       {r("count(*) FILTER (WHERE sentiment = 'negative') * 100.0 / count(*)", 2)} AS negative_pct
FROM quads GROUP BY 1 HAVING count(*) FILTER (WHERE sentiment = 'negative') > 0 ORDER BY 2 DESC, aspect LIMIT 5
""", "quads"))
def negative_aspects(spark, folder):
    return mt.negative_aspects(quads(spark, folder))


@query("comment_sentiment", with_views("""
WITH balance AS (
  SELECT doc_id, coalesce(sum(CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END), 0) AS b
  FROM documents LEFT JOIN quads ON comment_id = doc_id GROUP BY 1)
SELECT doc_id AS comment_id, CASE WHEN b > 0 THEN 'positive' WHEN b < 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
       CAST(CASE WHEN b > 0 THEN 0.7 WHEN b < 0 THEN -0.6 ELSE 0 END AS DOUBLE) AS sentiment_score
FROM balance
""", "quads"))
def comment_sentiment(spark, folder):
    return mt.with_comment_sentiment(labeled_texts(spark, folder)).select(
        "comment_id", "sentiment", "sentiment_score")


@query("summary_text", with_views(f"""
WITH figures AS (
  SELECT program_id, count(*) AS n, count(DISTINCT comment_id) AS comments, count(DISTINCT aspect) AS aspects,
         count(*) FILTER (WHERE sentiment = 'positive') AS pos, count(*) FILTER (WHERE sentiment = 'negative') AS neg,
         count(*) FILTER (WHERE sentiment = 'neutral') AS neu FROM quads GROUP BY 1),
best AS (
  SELECT program_id, entity FROM quads GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY count(*) DESC, entity) = 1)
SELECT program_id, printf(
  'Tổng quan phân tích %d bình luận:' || chr(10) || chr(10) || 'Phân bố cảm xúc:' || chr(10)
  || 'tích cực: %.1f%%, tiêu cực: %.1f%%, trung lập: %.1f%%' || chr(10) || chr(10)
  || 'Thực thể được nhắc đến nhiều nhất: %s' || chr(10) || 'Số khía cạnh khác nhau: %d' || chr(10) || chr(10)
  || 'Nhìn chung, người xem đang có phản ứng %s với nội dung.',
  comments, {r("pos * 100.0 / n", 1)}, {r("neg * 100.0 / n", 1)}, {r("neu * 100.0 / n", 1)}, entity, aspects,
  CASE WHEN pos > neg THEN 'tích cực' ELSE 'trung lập' END) AS summary
FROM figures JOIN best USING (program_id)
""", "quads"))
def summary_text(spark, folder):
    return rules.summary_text(labeled_texts(spark, folder))


@query("distinct_entities", with_views("""
SELECT count(DISTINCT entity) AS entities, count(DISTINCT aspect) AS aspects FROM quads
""", "quads"))
def distinct_entities(spark, folder):
    return mt.distinct_counts(quads(spark, folder))


@query("entity_extract", with_views("""
WITH named AS (SELECT DISTINCT comment_id, entity FROM quads)
SELECT doc_id AS comment_id, coalesce(string_agg(entity, ',' ORDER BY entity), 'general') AS topics
FROM documents LEFT JOIN named ON comment_id = doc_id GROUP BY 1
""", "quads"))
def entity_extract(spark, folder):
    topics = F.array_join(F.array_sort(lab.topics_of("labels")), ",")
    return labeled_texts(spark, folder).select("comment_id", topics.alias("topics"))


@query("normalise_labels", with_views("""
SELECT comment_id, entity, vi_sentiment AS before, sentiment FROM quads
""", "quads"))
def normalise_labels(spark, folder):
    rows = labeled_texts(spark, folder).withColumn("after", lab.normalise_labels("labels"))
    pairs = F.arrays_zip(F.col("labels").alias("b"), F.col("after").alias("a"))
    return sc.each(rows, pairs, "pair", "comment_id").select(
        "comment_id", F.col("pair.b.entity").alias("entity"), F.col("pair.b.sentiment").alias("before"),
        F.col("pair.a.sentiment").alias("sentiment"))


# --- training targets -------------------------------------------------------

def phrase_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Lexicon labels whose entity is the phrase itself, so that it has a span;
    one more label names something that need not occur."""
    phrases = F.transform("labels", lambda q: q.withField("entity", q["opinion"]))
    stray = F.struct(
        F.lit("program_").alias("entity"), F.lit("Khác").alias("aspect"), F.lit("null").alias("opinion"),
        F.lit("trung tính").alias("sentiment"), F.lit(1.0).alias("confidence"))
    rows = labeled_texts(spark, folder)
    return rows.withColumn("labels", F.concat(phrases, F.array(stray)))


ALIGNED_SQL = """wanted AS (
  SELECT comment_id, phrase AS entity, phrase AS opinion, aspect, vi_sentiment, phrase AS ord FROM quads
  UNION ALL SELECT doc_id, 'program_', 'null', 'Khác', 'trung tính', NULL FROM documents),
spans AS (
  SELECT w.*, t.text, position(lower(entity) IN lower(t.text)) - 1 AS es,
         CASE WHEN opinion = 'null' THEN -1 ELSE position(lower(opinion) IN lower(t.text)) - 1 END AS os
  FROM wanted w JOIN timed t USING (comment_id)),
aligned AS (
  SELECT *, es + length(entity) AS ee, CASE WHEN os = -1 THEN -1 ELSE os + length(opinion) END AS oe
  FROM spans WHERE es >= 0 AND (opinion = 'null' OR os >= 0))"""


@query("align_labels", with_views(f"""
WITH {ALIGNED_SQL}
SELECT comment_id, entity, aspect, opinion, vi_sentiment AS sentiment, CAST(es AS INTEGER) AS e_start,
       CAST(ee AS INTEGER) AS e_end, CAST(os AS INTEGER) AS o_start, CAST(oe AS INTEGER) AS o_end FROM aligned
""", "quads", "timed"))
def align_labels(spark, folder):
    rows = sc.each(training.aligned(phrase_labels(spark, folder)), "labels", "label", "comment_id")
    return rows.select("comment_id", "label.*").select(
        "comment_id", "entity", "aspect", "opinion", "sentiment",
        F.col("entity_span.start").alias("e_start"), F.col("entity_span.end").alias("e_end"),
        F.col("opinion_span.start").alias("o_start"), F.col("opinion_span.end").alias("o_end"))


def _word_sql(position: str) -> str:
    upto = f"regexp_split_to_array(substring(text, 1, {position} + 1), '\\s+')"
    words = f"len(list_filter({upto}, lambda w: w <> ''))"
    return (f"CASE WHEN {position} >= 0 AND NOT regexp_matches(substring(text, {position} + 1, 1), '\\s') "
            f"THEN {words} ELSE 0 END")


@query("target_matrix", with_views(f"""
WITH {ALIGNED_SQL},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY ord NULLS LAST) AS place FROM aligned),
placed AS (
  SELECT comment_id, place - 1 AS slot, {_word_sql("es")} AS w1, {_word_sql("(ee - 1)")} AS w2,
         {_word_sql("os")} AS w3, {_word_sql("(oe - 1)")} AS w4,
         CASE aspect WHEN 'Địa điểm' THEN 1 WHEN 'Kịch bản' THEN 2 WHEN 'Dàn dựng' THEN 3 WHEN 'Dàn cast' THEN 4
              WHEN 'Khách mời' THEN 5 WHEN 'Quảng cáo' THEN 7 ELSE 0 END AS a,
         CASE vi_sentiment WHEN 'tích cực' THEN 1 WHEN 'tiêu cực' THEN 2 ELSE 0 END AS s
  FROM numbered WHERE place <= 4),
filled AS (
  SELECT comment_id, slot,
         concat_ws(',', w1, CASE WHEN w1 = 0 THEN 0 WHEN w2 = 0 THEN w1 ELSE w2 END,
                   w3, CASE WHEN w3 = 0 THEN 0 WHEN w4 = 0 THEN w3 ELSE w4 END, a, s) AS target FROM placed),
slots AS (
  SELECT comment_id, slot FROM (SELECT DISTINCT comment_id FROM filled), range(4) AS g(slot))
SELECT comment_id, CAST(slot AS INTEGER) AS slot, coalesce(target, '-1,-1,-1,-1,-1,-1') AS target
FROM slots LEFT JOIN filled USING (comment_id, slot)
""", "quads", "timed"))
def target_matrix(spark, folder):
    rows = training.with_targets(phrase_labels(spark, folder))
    return rows.select("comment_id", F.posexplode_outer("targets").alias("slot", "t")).select(
        "comment_id", "slot", F.array_join(F.col("t").cast("array<string>"), ",").alias("target"))


# --- decoding and evaluation ------------------------------------------------

@query("decode_quads", with_views(f"""
SELECT vec_id,
       ['Khác', 'Địa điểm', 'Kịch bản', 'Dàn dựng', 'Dàn cast', 'Khách mời', 'Khả năng chơi trò chơi', 'Quảng cáo',
        'Thử thách', 'Tương tác giữa các thành viên', 'Tinh thần đồng đội'][aspect_id + 1] AS aspect,
       ['trung tính', 'tích cực', 'tiêu cực'][sentiment_id + 1] AS sentiment,
       {r("confidence", 3)} AS confidence, es AS e_start, ee AS e_end, os AS o_start, oe AS o_end
FROM heads WHERE es <= ee AND os <= oe AND es <> 0 AND ee <> 0 AND confidence >= 0.24
""", "heads"))
def decode_quads(spark, folder):
    rows = sc.where_found(tables.logits(spark, folder), "quad", dec.decode(*HEADS, threshold=0.24))
    return rows.select("vec_id", "quad.*")


@query("quad_eval", with_views(f"""
WITH valid AS (SELECT * FROM heads WHERE es <= ee AND os <= oe),
counts AS (SELECT count(*) AS valid, count(*) FILTER (WHERE sentiment_id = label % 3) AS tp FROM valid)
SELECT valid, tp, {r("tp / valid", 4)} AS accuracy, {r("tp / valid", 4)} AS "precision",
       {r("tp / valid", 4)} AS recall, {r("tp / valid", 4)} AS f1_score FROM counts
""", "heads"))
def quad_eval(spark, folder):
    """Strict slot match: well-formed slots are valid, and the gold sentiment is
    the vector's label modulo three."""
    six = training.head_numbers(*HEADS)
    rows = tables.logits(spark, folder).select(six.alias("p"), "label")
    well_formed = (F.col("p")[0] <= F.col("p")[1]) & (F.col("p")[2] <= F.col("p")[3])
    gold = F.concat(F.slice("p", 1, 5), F.array((F.col("label") % 3).cast("int")))
    target = F.when(well_formed, gold).otherwise(F.array_repeat(F.lit(-1), 6))
    scored = training.slot_metrics(
        rows.select(F.array("p").alias("predicted"), F.array(target).alias("target")), "predicted", "target")
    return scored.withColumns({c: sc.tidy(c, 4) for c in ("accuracy", "precision", "recall", "f1_score")})


@query("quad_set_eval", with_views(f"""
WITH gold AS (
  SELECT DISTINCT comment_id, aspect, sentiment FROM quads),
predicted AS (
  SELECT DISTINCT comment_id, aspect, CASE WHEN sentiment = 'neutral' THEN 'positive' ELSE sentiment END AS sentiment
  FROM quads WHERE entity <> 'ads'),
counts AS (
  SELECT count(*) FILTER (WHERE g.comment_id IS NOT NULL AND p.comment_id IS NOT NULL) AS tp,
         count(*) FILTER (WHERE g.comment_id IS NULL) AS fp, count(*) FILTER (WHERE p.comment_id IS NULL) AS fn
  FROM predicted p FULL JOIN gold g
    ON p.comment_id = g.comment_id AND p.aspect = g.aspect AND p.sentiment = g.sentiment)
SELECT tp, fp, fn, {r("tp / (tp + fp)", 4)} AS "precision", {r("tp / (tp + fn)", 4)} AS recall,
       {r("2 * tp / (2 * tp + fp + fn)", 4)} AS f1_score FROM counts
""", "quads"))
def quad_set_eval(spark, folder):
    """A labeler that knows no advertising and takes neutral for positive,
    measured against the full lexicon."""
    gold = quads(spark, folder)
    guess = F.when(F.col("sentiment") == "neutral", "positive").otherwise(F.col("sentiment"))
    predicted = gold.filter(F.col("entity") != "ads").withColumn("sentiment", guess)
    found = training.quad_metrics(predicted, gold, ("comment_id", "aspect", "sentiment"))
    return found.withColumns({c: sc.tidy(c, 4) for c in ("precision", "recall", "f1_score")})
