"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Counts per text come first (words, symbols, repeated lines, repeated five-word
windows). Cutoffs on ratios of them are chosen on labelled texts: per stratum
and rule the cutoffs are tested from the mildest to the strictest, each by an
exact binomial test of "more than ``alpha`` of good texts are rejected". The
chain stops at the first test that fails (fixed-sequence testing), and the
level is shared among all chains (Bonferroni), so with probability
``1 - delta`` no stratum loses more than its ``alpha`` of good texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.llm import common
from chatterlens.session import settled

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rules: a ratio of counts, and cutoffs from the mildest to the strictest. A
#: text at or above the cutoff is rejected.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols_per_word": ("try_divide(n_symbols, n_words)", [2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2]),
    "dup_line_share": ("try_divide(n_dup_lines, n_lines)", [0.8, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "repeat_share": ("try_divide(n_repeat_words, n_words)", [0.18, 0.15, 0.12, 0.1, 0.08, 0.05]),
}


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column whose expression is evaluated once however often it is used: a
    generator stands between it and the optimizer's copying."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = None) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text), ``stratum`` and the counts of every text: ``n_words,
    word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` and
    ``base_failed``. All work is inside the row; nothing is shuffled."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    df = common.text_rows(docs, id_col, text_col, stratum.alias("stratum"))
    df = df.withColumn("text_key", F.xxhash64("text"))
    df = _once(df, "word", F.transform(
        F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    n = F.size("word")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    df = _once(df, "line", F.transform(lines, lambda line: F.xxhash64(line, F.lit(1))))
    df = df.select(
        "doc_id", "text_key", "stratum", "word",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("line").cast("long").alias("n_lines"),
        (F.size("line") - F.size(F.array_distinct("line"))).cast("long").alias("n_dup_lines"),
    )
    at = lambda i, k: F.get("word", i + F.lit(k))
    df = _once(df, "win", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>")))
    # Few texts repeat a window; only those are sorted with positions.
    df = _once(df, "sorted", F.when(
        F.size(F.array_distinct("win")) < F.size("win"),
        F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twin = lambda s, j: F.coalesce(F.get("sorted", j - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(
        F.get("sorted", j + 1)["h"] == s["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("sorted", twin), lambda s: s["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"])
    df = df.select(
        "doc_id", "text_key", "stratum", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        covered.alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed in logarithms so that it does not
    underflow; 1 from the mean on, where no test can pass."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        total = F.greatest(term, s["total"]) + F.log1p(F.exp(-F.abs(term - s["total"])))
        return F.struct(term.alias("term"), total.alias("total"))

    total = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.cast("double").alias("term"), first.cast("double").alias("total")),
        step, lambda s: F.exp(s["total"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def thresholds(
    labelled: DataFrame, alpha: float = 0.02, delta: float = 0.1, rules: dict = RULES,
) -> DataFrame:
    """``stratum, rule, cutoff`` certified by the tests; a rule that no cutoff
    passes for is absent. ``labelled`` has the counts and ``good`` (boolean).

    Each rule gets ``alpha / rules`` of a stratum's allowed loss. Texts that
    the base rules reject take no part.
    """
    tests = [(rule, ratio, i, cut) for rule, (ratio, cuts) in rules.items() for i, cut in enumerate(cuts)]
    rejected = [F.count_if(F.col("good") & (F.expr(ratio) >= cut)).alias(f"t{k}")
                for k, (_, ratio, _, cut) in enumerate(tests)]
    caught = [F.count_if(~F.col("good") & (F.expr(ratio) >= cut)).alias(f"b{k}")
              for k, (_, ratio, _, cut) in enumerate(tests)]
    sums = labelled.where("NOT base_failed AND good IS NOT NULL").groupBy("stratum").agg(
        F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("bad"), *rejected, *caught)
    rows = sums.select("stratum", "n", "bad", F.count(F.lit(1)).over(Window.partitionBy()).alias("strata"), F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("place"), F.lit(cut).alias("cutoff"),
                 F.col(f"t{k}").alias("k"), F.col(f"b{k}").alias("caught"))
        for k, (rule, _, i, cut) in enumerate(tests)])).alias("t")).select("stratum", "n", "bad", "strata", "t.*")
    level = F.lit(delta) / (F.col("strata") * len(rules))
    passed = binomial_tail(F.col("k"), F.col("n"), alpha / len(rules)) <= level
    # A cut has to catch bad texts at five times the rate of good ones, else it is no rule.
    useful = F.col("caught") * F.col("n") > 5 * F.col("k") * F.col("bad")
    chain = F.sort_array(F.collect_list(F.struct("place", "cutoff", passed.alias("ok"), useful.alias("useful"))))
    stop = F.array_position(F.transform("chain", lambda c: c["ok"]), False)
    allowed = F.when(stop > 0, F.slice("chain", 1, (stop - 1).cast("int"))).otherwise(F.col("chain"))
    return rows.groupBy("stratum", "rule").agg(chain.alias("chain")).select(
        "stratum", "rule", F.array_min(F.transform(F.filter(allowed, lambda c: c["useful"]), lambda c: c["cutoff"]))
        .alias("cutoff")).where("cutoff IS NOT NULL")


def judge(
    docs: DataFrame, labels: DataFrame, good: str = "quality = 1", stratum_col: str | None = "lang",
    alpha: float = 0.02, delta: float = 0.1, rules: dict = RULES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Counts of every text, ``base_failed`` and ``kept``.

    ``kept`` is false if the base rules fail or a certified rule of the text's
    stratum rejects it. A null text is empty and fails; a null stratum is one
    of its own; a null or unlabelled id takes no part in the tests; repeated
    rows are judged alike; without labels no rule is certified. The counts are
    written once to the shared folder, because the tests and the verdicts read
    them.
    """
    table, _ = settled(counts(docs, id_col, text_col, stratum_col), "quality")
    marks = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.expr(good).alias("good")).groupBy("doc_id").agg(
        F.bool_and("good").alias("good"))
    cuts = thresholds(table.join(marks, "doc_id"), alpha, delta, rules)
    by_stratum = cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    # One row per stratum, so of the size of the strata's list; Spark decides how to join.
    judged = table.join(by_stratum, "stratum", "left")
    fails = [F.coalesce(F.expr(ratio) >= F.try_element_at(
        "cut", F.lit(rule)), F.lit(False)) for rule, (ratio, _) in rules.items()]
    return judged.withColumn("kept", ~F.col("base_failed") & ~reduce(lambda a, b: a | b, fails)).drop("cut")
