"""The dealt operators as queries over the given tables, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlens.llm import collocations, filter_audit, hmm, minhash, packing, pii, planes, quality, suffix_dedup, tiktoken_bpe, topk, toxicity, url_filter
from chatterlens.llm.common import QUERIES, SQL, crc_mod, query, table
from chatterlens.session import scratch

__all__ = ["QUERIES", "SQL"]

URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query("op1_pack_documents")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


@query("op2_token_planes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "planes")
    planes.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return planes.documents(spark, folder)


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


@query("op4_tiktoken_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiktoken_bpe.encode_texts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        keep_ids=False)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(generate_series(1, len(w) - 2),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w
), flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) c ON c.a = n.doc_id
"""


@query("op6_minhash_near_dup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("text_key", "component_key")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


@query("op7_exact_topk", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


@query("op8_hmm_score")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_url_templates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op11_bootstrapped_pii")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.extract(table(spark, sf_dir, "documents")))


OP12_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, words, array_to_string(w[i:i + words - 1], ' ') AS phrase
  FROM (SELECT lang, w, words, unnest(generate_series(1, len(w) - words + 1)) AS i
        FROM w, (SELECT unnest([1, 2, 3]) AS words))
), f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY 1),
c AS (
  SELECT lang, words, phrase, f AS a, unnest(generate_series(1, words - 1)) AS k FROM f WHERE words > 1 AND f >= 10
), cut AS (
  SELECT c.*, x.f AS l, y.f AS r,
         CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[:k], ' ')
         JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')
), s AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[:2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')])
         AS phrase, a FROM s WHERE words = 3
), longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY 1, 2),
kept AS (
  SELECT s.* FROM s LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank,
       phrase, a, l, r, n, score
FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), f AS (
  SELECT doc_id, part, ['A', 'B', 'C', 'D', 'E'] AS names, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1
), cells AS (
  SELECT part, fails, len(list_filter(fails, lambda x: x)) AS k, count(*) AS n,
         count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) a(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b(x),
       (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) d(x),
       (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) e(x)
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, instr('ABCDE', substring(filter_order, step, 1)) AS own,
         list_transform(generate_series(1, step - 1), lambda i: instr('ABCDE', substring(filter_order, i, 1))) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), m AS (
  SELECT part, filter_order, step, n, good, toxic, k, fails[own] AS here,
         len(list_filter(before, lambda i: fails[i])) > 0 AS earlier
  FROM cells, s
)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (WHERE NOT here AND NOT earlier), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (WHERE here AND NOT earlier), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (WHERE here AND earlier), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (WHERE here AND k = 1), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (WHERE here AND NOT earlier), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (WHERE here AND NOT earlier), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // nullif(k, 0)) FILTER (WHERE here), 0) AS BIGINT) AS shapley
FROM m GROUP BY 1, 2, 3
"""


@query("op13_filter_audit", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
