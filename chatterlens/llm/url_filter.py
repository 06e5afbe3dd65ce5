"""URL filtering by rules and by a path-template tree.

A URL's path is a list of segments. Per host, segments that vary (ids, or names
with many siblings) become wildcards, so that the URLs of a host fold into few
templates. Sibling templates whose share of labelled bad URLs does not differ
significantly are merged. A template is rejected when its share of bad URLs,
smoothed towards that of the branch above it, is high.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlens.llm import common
from chatterlens.session import settled

Rule = tuple[str, str]  # verdict and pattern, "host/path"

#: Copies of the verdict table that rows of a busy host are spread over.
SALTS = 16


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def by_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits: its host or a
    subdomain of it, and a path that starts with its path."""
    name = verdict = F.lit(None).cast("string")
    for kind, pattern in sorted(rules, key=lambda r: len(r[1])):
        own, _, start = pattern.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{start}"))
        name = F.when(fits, F.lit(pattern)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """Segments of a path; those with a digit or of over 32 characters, which
    name one page rather than a part of the site, are already wildcards."""
    return F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > 32), F.lit("*")).otherwise(s))


def templates(
    shapes: DataFrame, fanout: int = 30, least_share: float = 0.05, z: float = 1.96,
    weight: float = 5.0, least_labelled: int = 5, purity: float = 0.8,
) -> DataFrame:
    """Verdict per shape. ``shapes``: ``host, shape`` (segments), ``n`` URLs,
    ``labelled`` and ``bad`` among them. Gives ``host, shape, template,
    smoothed, rejected``.

    Level by level, under a node with more than ``fanout`` different children
    every child below ``least_share`` of the node's URLs becomes a wildcard.
    Then, from the same counts, labelled children whose share of bad URLs does
    not differ (two-sided test, ``z``) from that of their labelled siblings
    become one branch. A branch's share is smoothed towards that of the node
    above it as ``weight`` more URLs, a host's towards that of all labelled URLs;
    so a branch without labels is judged as the node above it. The tree goes down,
    however deep, while a node has ``least_labelled`` labelled URLs; what is below
    one that has fewer is one tail, and a host that has fewer rejects nothing.
    Each level groups and joins the shapes that are still open, never the URLs.
    """
    # The prior is one row; a scalar, not a join.
    prior = shapes.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("prior")).scalar()
    hosts = shapes.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).select(
        "host", ((F.col("b") + weight * prior) / (F.col("l") + weight)).alias("smoothed"),
        (F.col("l") >= least_labelled).alias("open"))
    table, _ = settled(shapes.join(hosts, "host").withColumn("template", F.array().cast("array<string>")), "url-level")
    result = ["host", "shape", "template", "smoothed"]
    tail = F.when(F.size("shape") > 0, F.concat("template", F.array(F.lit("**")))).otherwise(F.col("template"))
    done, level = [table.where("NOT open").withColumn("template", tail).select(*result, F.lit(False).alias("rejected"))], 0
    df = table.where("open")
    node = ["host", "template"]
    while not df.isEmpty():
        # A path that ends here is a child too, never merged with others.
        df = df.withColumn("segment", F.coalesce(F.get("shape", F.lit(level)), F.lit("")))
        child = df.groupBy(*node, "segment").agg(
            F.min("smoothed").alias("above"), F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        total = child.groupBy(*node).agg(
            F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("children"),
            F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
        many = (F.col("children") > fanout) & (F.col("n") < least_share * F.col("all_n"))
        # Two shares: the child's and that of its labelled siblings.
        other_l, other_b = F.col("all_l") - F.col("l"), F.col("all_b") - F.col("b")
        pooled = F.try_divide("all_b", "all_l")
        gap = F.abs(F.try_divide("b", "l") - F.try_divide(other_b, other_l))
        noise = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "l") + F.try_divide(F.lit(1.0), other_l)))
        alike = (F.col("l") > 0) & (other_l > 0) & (gap <= z * noise)
        becomes = F.when(F.col("segment") == "", F.lit("")).when((F.col("segment") == "*") | many, F.lit("*")).when(
            alike, F.lit("{}")).otherwise(F.col("segment"))
        named = child.join(total, node).withColumn("becomes", becomes)
        branch = named.groupBy(*node, "becomes").agg(
            F.min("above").alias("above"), F.sum("l").alias("l"), F.sum("b").alias("b")).select(
            *node, "becomes", ((F.col("b") + weight * F.col("above")) / (F.col("l") + weight)).alias("below"),
            (F.col("l") >= least_labelled).alias("more"))
        moved = named.select(*node, "segment", "becomes").join(branch, [*node, "becomes"])
        ended = F.col("becomes") == ""
        deeper = F.when(ended, F.col("template")).otherwise(F.concat("template", F.array("becomes")))
        table, _ = settled(df.drop("smoothed", "open").join(moved, [*node, "segment"]).select(
            "host", "shape", "n", "labelled", "bad", F.col("below").alias("smoothed"), deeper.alias("template"),
            (~ended & F.col("more")).alias("open")), "url-level")
        level += 1
        tail = F.when(F.size("shape") > level, F.concat("template", F.array(F.lit("**")))).otherwise(F.col("template"))
        done.append(table.where("NOT open").withColumn("template", tail).select(
            *result, (F.col("smoothed") >= purity).alias("rejected")))
        df = table.where("open")
    return reduce(DataFrame.unionByName, done)


def judge(
    pages: DataFrame, rules: list[Rule], bad: Column | None = None, id_col: str = "page_id", url_col: str = "url",
    **settings,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    ``bad`` marks labelled URLs (1 bad, 0 good, null unlabelled); by default
    those that a rule decides. A null URL, or one without ``://``, has an empty
    host and path and is allowed; a null id stays null; repeated rows are
    judged alike and count as often as they occur; an empty table gives no
    rows; other columns are ignored. A busy host is reduced to its shapes by
    partial aggregation before any shuffle, and rows meet the verdicts over
    salted keys.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    host, path = host_path(url)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"),
        *([] if bad is None else [bad.cast("int").alias("bad")]))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    if bad is None:
        rows = rows.withColumn("bad", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    rows = rows.withColumn("shape", segments(F.col("path")))
    shapes = rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    # Read at every level: written once.
    table, _ = settled(shapes, "url-shapes")
    rejected = templates(table, **settings).where("rejected").select(
        "host", "shape", F.lit(True).alias("out"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
    judged = rows.withColumn("salt", salt).join(rejected, ["host", "shape", "salt"], "left")
    method = F.when(F.col("out"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"))
