"""Joins whose big side has keys with a large share of all rows.

Such keys are found by a mergeable counter of bounded size, not by a grouping of
all keys. Their rows are dealt over salts, to which the other side's rows of
these keys are copied; all other rows are joined plainly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType, VariantType

#: Items a counter keeps; a key with more than about 3.5 / ITEMS of all rows is never missed.
ITEMS = 10_000
#: Least share of the rows that makes a key heavy; so there are at most 1 / SHARE of them.
SHARE = 0.02


def _key(keys: list[str]) -> Column:
    """The keys as one text; NULL if any of them is."""
    whole = F.to_json(F.struct(*[F.col(k) for k in keys]))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return F.when(known, whole)


def heavy_keys(df: DataFrame, keys: list[str], share: float = SHARE) -> list[str]:
    """Keys (as JSON) with at least ``share`` of the rows, by an approximate count
    that is merged from all tasks. Null keys match nothing and are left out."""
    named = df.select(_key(keys).alias("key")).where("key IS NOT NULL")
    top = F.expr(f"approx_top_k(key, {int(1 / share)}, {ITEMS})")
    total, found = named.agg(F.count("*"), top).first()
    return [row["item"] for row in found or [] if row["count"] >= share * total]


def join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", share: float = SHARE, salts: int | None = None,
) -> DataFrame:
    """``big`` joined with ``small`` (inner, left, left_semi or left_anti), heavy
    keys split over ``salts`` parts by a hash of their other columns (default: 16
    for each shuffle partition, so that these fill evenly)."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join {how} cannot be split on its left side")
    spark = big.sparkSession
    heavy = heavy_keys(big, keys, share)
    if not heavy:
        return big.join(small, keys, how)
    parts = salts or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    is_heavy = F.coalesce(_key(keys).isin(heavy), F.lit(False))
    # A row's salt is its own, so that a task run again deals its rows alike.
    others = [f.name for f in big.schema.fields if f.name not in keys and not isinstance(f.dataType, (MapType, VariantType))]
    salt = F.pmod(F.xxhash64(*others) if others else F.monotonically_increasing_id(), F.lit(parts)).cast("int")
    dealt = big.filter(is_heavy).withColumn("_salt", salt)
    copied = small.filter(is_heavy).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    split = dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
    return big.filter(~is_heavy).join(small, keys, how).unionByName(split)


def restrict_to(df: DataFrame, ids: DataFrame, key: str, bound: int = 10_000, share: float = SHARE) -> DataFrame:
    """Rows whose key is among ``ids``. Up to ``bound`` distinct ids are counted
    and then broadcast, so ``df`` isn't shuffled; more are joined, heavy keys
    by a plain filter on those that are among the ids."""
    wanted = ids.select(key).where(F.col(key).isNotNull()).distinct()
    if wanted.limit(bound + 1).count() <= bound:
        return df.join(F.broadcast(wanted), key, "left_semi")
    heavy = heavy_keys(df, [key], share)
    listed = [r[0] for r in wanted.filter(_key([key]).isin(heavy)).select(_key([key])).collect()] if heavy else []
    is_heavy = F.coalesce(_key([key]).isin(heavy), F.lit(False)) if heavy else F.lit(False)
    kept = df.filter(is_heavy & _key([key]).isin(listed)) if listed else df.filter(F.lit(False))
    return df.filter(~is_heavy).join(wanted, key, "left_semi").unionByName(kept)
