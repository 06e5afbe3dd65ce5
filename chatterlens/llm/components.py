"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlens.session import discard, settled


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of all its neighbours and itself."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (least node reachable) for every node of ``links``
    (``a, b``); nodes without a link are absent.

    Each round is two grouped joins over the links and is written to the shared
    folder; the number of rounds grows with the logarithm of the nodes. The
    least neighbour is found by partial aggregation, so a star with very many
    links costs one row per task; its join is split by adaptive execution. Null
    ends are dropped; repeated links and loops don't matter.
    """
    now, path = settled(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct(), "links")
    seal = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seal or not sums[0]:
            break
        seal, old = sums, path
        now, path = settled(_small_star(_large_star(now)).distinct(), "links")
        discard(now.sparkSession, old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
