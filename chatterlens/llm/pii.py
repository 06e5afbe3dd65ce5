"""Personal data by patterns that known entities teach (bootstrapping).

Four exact formats (email, IPv4, card number with its check digit, phone with a
country code) give the seeds. The words around a seed are lexical patterns: the
two words before it, the one before it, and the words on either side. Other
identifier-like strings, runs of words with digits or @, are the unseen
instances. A pattern's confidence in a kind is the share of its distinct
instances that are known to be of this kind; an instance's score is the
noisy-or over its confident patterns, if its characters fit the kind at all.
Accepted instances count as known in the next round, and in the end wherever
they occur. Everything is DataFrame work: texts are searched by regular
expressions that never go back (linear in the text), positions are running sums
over what lies between matches, and only matches are shuffled. Patterns and
instances that are frequent are split by a salt in joins.

Positions are code points, the end is exclusive. Odd input: a null text is
empty and has no spans; a null id keeps its row; repeated rows share their
result and count once as evidence; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlens.llm.common import keyed, real_id
from chatterlens.session import discard, settled

KINDS = ("email", "ip", "card", "phone")
#: Formats as their contract gives them. A match can only begin where a run of its first
#: characters does (or right after a match), and what a group has taken fits nothing
#: that follows, so possessive groups find the same matches.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
PART = r"0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Words with digits or @, next to each other.
LIKELY = (r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
          r"(?:\x20[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)*+")
#: What an unseen instance of a kind may look like, and how many digits it may have.
SHAPES = {
    "email": (r"^[^@\x20]+@[^@\x20]+$", 0, 10**6),
    "ip": (r"^[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}$", 1, 32),
    "card": (r"^[0-9][0-9\x20-]*$", 12, 19),
    "phone": (r"^[(]?[0-9][0-9().\x20/-]*$", 7, 15),
}

#: Distinct instances a pattern needs, least confidence of a pattern, least score
#: of an instance, rounds, and copies of the small side of a join.
SUPPORT, CONFIDENT, ACCEPTED, ROUNDS, SALTS = 5, 0.75, 0.8, 3, 8
#: Characters around a match that may hold its context.
BEFORE, AFTER = 64, 32


# --- matches and where they are ----------------------------------------------

def _found(kind: str, pattern: str) -> list[Column]:
    """The matches of a text and what lies around them, null without any hope."""
    text = F.col("text")
    hope = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]" if kind in FORMATS else "[0-9@]")
    return [
        F.when(hope, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(f"m_{kind}"),
        F.when(hope, F.split(text, pattern, -1)).alias(f"g_{kind}")]


def _listed(kind: str) -> Column:
    between = F.col(f"g_{kind}")

    def one(match: Column, i: Column) -> Column:
        before, after = F.get(between, i), F.get(between, i + 1)
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("place"), match.alias("match"), F.length(before).alias("gap"),
            F.right(before, F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after"))
    kinds = "array<struct<kind:string,place:int,match:string,gap:int,before:string,after:string>>"
    return F.coalesce(F.transform(f"m_{kind}", one).cast(kinds), F.array().cast(kinds))


def matches(docs: DataFrame) -> DataFrame:
    """Every match of the formats and every likely run, by document and kind:
    ``k1, k2, kind, place, match, gap, before, after``. Rows are keyed by id and
    a hash of the text; copies of a row give copies of its matches."""
    patterns = {**FORMATS, "likely": LIKELY}
    rows = keyed(docs).select("k1", "k2", *[c for kind, p in patterns.items() for c in _found(kind, p)])
    listed = F.concat(*[_listed(kind) for kind in patterns])
    # An outer generator keeps Catalyst from evaluating the list once more in a filter.
    return rows.select("k1", "k2", F.explode_outer(listed).alias("m")).where("m IS NOT NULL").select("k1", "k2", "m.*")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weight(digit: Column, i: Column) -> Column:
        value = digit.cast("int")
        return F.when(i % 2 == 0, value).otherwise(F.when(value > 4, 2 * value - 9).otherwise(2 * value))
    # A string cut at every character, from the last one on; an empty rest is no digit.
    signs = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    return F.aggregate(F.transform(signs, weight), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid() -> Column:
    digits = _digits(F.col("match"))
    return (
        F.when(F.col("kind") == "ip", F.col("match").rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(F.col("kind") == "card", F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False))
        .when(F.col("kind") == "phone", F.length(digits).between(9, 15))
        .otherwise(True))


def located(found: DataFrame) -> DataFrame:
    """Matches with start and end: ``base`` ones, which are valid, and likely
    runs that touch none of them, without quotes and marks at their ends."""
    whole = found.repartition("k1", "k2").dropDuplicates(["k1", "k2", "kind", "place"])
    so_far = Window.partitionBy("k1", "k2", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match").cast("long")
    end = F.sum(F.col("gap") + size).over(so_far)
    placed = whole.withColumns({"end": end, "size": size}).withColumn("start", F.col("end") - F.col("size"))
    placed = placed.where(_valid()).withColumn("base", F.col("kind") != "likely")

    document = Window.partitionBy("k1", "k2")
    own = F.col("base")
    till = F.max(F.when(own, F.col("end"))).over(document.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    since = F.min(F.when(own, F.col("start"))).over(
        document.orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0))
    apart = F.coalesce(till <= F.col("start"), F.lit(True)) & F.coalesce(since >= F.col("end"), F.lit(True))
    kept = placed.withColumn("apart", apart).where("base OR apart")
    head = F.length(F.regexp_extract("match", r"""^["'<\[{]*+""", 0))
    tail = F.length(F.regexp_extract("match", r"""[.,;:!?"'>\]}]++$""", 0))
    return kept.select(
        "k1", "k2", "kind", "base", "before", "after",
        F.when(own, F.col("start")).otherwise(F.col("start") + head).alias("start"),
        F.when(own, F.col("end")).otherwise(F.greatest(F.col("start") + head, F.col("end") - tail)).alias("end"),
        F.when(own, F.col("match")).otherwise(F.regexp_replace(
            "match", r"""^["'<\[{]++|[.,;:!?"'>\]}]++$""", "")).alias("text"))


# --- the graph ---------------------------------------------------------------

def _word(text: Column) -> Column:
    """Lower-cased, without marks at its ends, with one sign for all digits."""
    trimmed = F.regexp_replace(F.lower(text), r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$", "")
    return F.regexp_replace(trimmed, r"\p{N}", "0")


def _contexts() -> Column:
    """Patterns around a match; a missing word is empty. Without a word before
    it a match teaches nothing."""
    before, after = F.split(F.rtrim(F.regexp_replace("before", r"[\x09-\x0D]", " ")), r"\x20+"), F.split(
        F.ltrim(F.regexp_replace("after", r"[\x09-\x0D]", " ")), r"\x20+")
    last = _word(F.element_at(before, -1))
    second = F.when(F.size(before) > 1, _word(F.element_at(before, -2))).otherwise("")
    return F.when(last != "", F.array(
        F.concat(F.lit("2:"), second, F.lit(" "), last), F.concat(F.lit("1:"), last),
        F.concat(F.lit("m:"), last, F.lit(" _ "), _word(F.element_at(after, 1))))).otherwise(F.array().cast("array<string>"))


def _fits() -> Column:
    """Kinds that the characters of an unseen instance allow."""
    size = F.length(_digits(F.col("instance")))
    return F.array_compact(F.array(*[
        F.when(F.col("instance").rlike(shape) & size.between(least, most), F.lit(kind))
        for kind, (shape, least, most) in ((k, SHAPES[k]) for k in KINDS)]))


def edges(events: DataFrame) -> DataFrame:
    """Distinct ``pattern, instance, seed, fits``: the kind of a seed, the
    kinds that an unseen instance may be."""
    made = events.select(
        F.explode(F.array_distinct(_contexts())).alias("pattern"), F.lower("text").alias("instance"),
        F.when(F.col("base"), F.col("kind")).alias("seed")).distinct()
    return made.withColumn("fits", F.when(F.col("seed").isNull(), _fits()).otherwise(F.array().cast("array<string>")))


def _salted(big: DataFrame, small: DataFrame, key: str, spread_by: str, how: str = "inner") -> DataFrame:
    """An equi-join that splits each key of ``big`` into SALTS parts."""
    left = big.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def pattern_scores(graph: DataFrame, known: DataFrame | None) -> DataFrame:
    """``pattern, kind, confidence`` of the confident patterns. Known instances
    (``instance, kind, score``) count by their scores."""
    votes = graph.select("pattern", "instance", F.col("seed").alias("kind"), F.when(
        F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    if known is not None:
        unseen = _salted(graph.where("seed IS NULL"), known, "instance", "pattern", "left")
        votes = votes.where("kind IS NOT NULL").unionByName(unseen.select(
            "pattern", "instance", "kind", F.coalesce("score", F.lit(0.0)).alias("score")))
    sums = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in KINDS]
    counted = votes.groupBy("pattern").agg(F.count("*").alias("total"), *sums)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("hits")) for k in KINDS]))
    return counted.where(F.col("total") >= SUPPORT).select("pattern", "total", kinds.alias("k")).select(
        "pattern", "k.kind", (F.col("k.hits") / (F.col("total") + 1)).alias("confidence")).where(
        F.col("confidence") >= CONFIDENT)


def instance_scores(graph: DataFrame, patterns: DataFrame) -> DataFrame:
    """``instance, kind, score`` of the accepted unseen instances; the kind of
    the highest score, the earlier one of equal ones."""
    unseen = graph.where("seed IS NULL AND size(fits) > 0").select("pattern", "instance", "fits")
    met = _salted(unseen, patterns, "pattern", "instance").where(F.array_contains("fits", F.col("kind")))
    scored = met.groupBy("instance", "kind").agg(
        (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")).where(F.col("score") >= ACCEPTED)
    order = F.struct(F.round("score", 9).alias("score"), (-_number(F.col("kind"))).alias("order"))
    return scored.groupBy("instance").agg(F.max_by(F.struct("kind", "score"), order).alias("best")).select(
        "instance", "best.kind", "best.score")


def _number(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")


def discover(graph: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, str]:
    """Accepted unseen instances after at most ``rounds`` rounds, as a written table."""
    known, path, size = None, None, 0
    for _ in range(rounds):
        found, there = settled(instance_scores(graph, pattern_scores(graph, known)), "pii-known")
        if path:
            discard(graph.sparkSession, path)
        known, path = found, there
        before, size = size, found.count()
        if size == before:
            break
    return known, path


# --- documents ---------------------------------------------------------------

SPANS = "array<struct<order:int,start:bigint,end:bigint,kind:string,text:string,base:boolean,score:double>>"


def extract(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row ``doc_id`` and its ``spans`` by kind and start: kind, start, end,
    text, whether a format found it (``base``), and its score."""
    spark = docs.sparkSession
    events, _ = settled(located(matches(docs)), "pii-matches")
    graph, drawn = settled(edges(events), "pii-graph")
    known, _ = discover(graph, rounds)
    discard(spark, drawn)

    unseen = events.where("NOT base").drop("kind").withColumn("instance", F.lower("text"))
    added = _salted(unseen, known, "instance", "k2")
    spans = events.where("base").withColumn("score", F.lit(1.0)).unionByName(added, allowMissingColumns=True)
    by_row = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct(
        _number(F.col("kind")).alias("order"), "start", "end", "kind", "text", "base", "score"))).alias("spans"))
    rows = keyed(docs).select("k1", "k2")
    return rows.join(by_row, ["k1", "k2"], "left").select(
        real_id().alias("doc_id"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _of(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)
