"""Hourly rollups in a store, up to a recorded mark.

``hours/upto=<mark>`` holds the sums and counts of the hours folded in one step,
``latest/upto=<mark>`` the newest hour of every program so far, and
``marks/upto=<mark>``, written last, says that the step is complete; a mark is
the end of its last hour in epoch seconds. A question is answered from these
rows and from the raw comments at or after the mark, which a range filter finds.
A step that is run again replaces itself. Comments that arrive late, for hours
already folded, are added by :func:`add_late` as further partial rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampNTZType

from chatterlens.operators import rollups
from chatterlens.session import child_names

HOUR = 3600
KEYS = ["program_id", "window_start"]


def _seconds(moment: datetime) -> int:
    return int((moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp())


def at(df: DataFrame, seconds: int, ts: str = "timestamp") -> Column:
    """A mark as a value of the column's own type, so that the bound reaches the scan."""
    moment = F.timestamp_seconds(F.lit(seconds))
    return moment.cast("timestamp_ntz") if isinstance(df.schema[ts].dataType, TimestampNTZType) else moment


def mark(spark: SparkSession, path: str) -> int | None:
    """The newest complete mark; only folder names are read."""
    found = [int(n.removeprefix("upto=")) for n in child_names(spark, f"{path}/marks") if n.startswith("upto=")]
    return max(found, default=None)


def _hours(comments: DataFrame) -> DataFrame:
    """Sums and counts per program and hour, and the time of the newest comment."""
    start = F.window("timestamp", "1 hour")["start"].alias("window_start")
    return comments.groupBy("program_id", start).agg(
        *rollups.program_measures(), F.max("timestamp").alias("newest"))


def _merged(partials: DataFrame) -> DataFrame:
    """Partial rows of one hour added up."""
    return partials.groupBy(*KEYS).agg(
        *[F.sum(m).alias(m) for m in rollups.PROGRAM_MEASURES], F.max("newest").alias("newest"))


def _last_hours(hours: DataFrame) -> DataFrame:
    columns = [c for c in hours.columns if c != "program_id"]
    newest = F.max_by(F.struct(*columns), F.col("window_start")).alias("row")
    return hours.groupBy("program_id").agg(newest).select("program_id", "row.*")


def fold(comments: DataFrame, path: str, upto: datetime) -> None:
    """Fold the comments from the mark to ``upto``, a full hour, into the store."""
    spark, end = comments.sparkSession, _seconds(upto)
    if end % HOUR:
        raise ValueError("a mark is a full hour")
    since = mark(spark, path)
    if since is not None and since >= end:
        return
    rows = comments.filter(F.col("timestamp") < at(comments, end))
    rows = rows if since is None else rows.filter(F.col("timestamp") >= at(comments, since))
    _hours(rows).write.mode("overwrite").parquet(f"{path}/hours/upto={end}")
    fresh = spark.read.parquet(f"{path}/hours/upto={end}")
    known = fresh if since is None else fresh.unionByName(spark.read.parquet(f"{path}/latest/upto={since}"))
    _last_hours(known).write.mode("overwrite").parquet(f"{path}/latest/upto={end}")
    spark.range(1).select(F.lit(end).alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/upto={end}")


def add_late(comments: DataFrame, path: str, name: str) -> None:
    """Partial rows of comments older than the mark, under a name of their own;
    the newest hours are settled anew from the rollups of these programs."""
    spark = comments.sparkSession
    since = mark(spark, path)
    _hours(comments.filter(F.col("timestamp") < at(comments, since))).write.mode("overwrite").parquet(f"{path}/late/name={name}")
    late = spark.read.parquet(f"{path}/late/name={name}").select("program_id").distinct()
    folded = stored_hours(spark, path)
    last = spark.read.parquet(f"{path}/latest/upto={since}")
    kept = last.join(late, "program_id", "left_anti")
    again = _last_hours(folded.join(late, "program_id", "left_semi"))
    # The folder is read here, so its new rows are written beside it first.
    kept.unionByName(again).write.mode("overwrite").parquet(f"{path}/staged/upto={since}")
    spark.read.parquet(f"{path}/staged/upto={since}").write.mode("overwrite").parquet(f"{path}/latest/upto={since}")


def stored_hours(spark: SparkSession, path: str) -> DataFrame:
    """Folded hours with what came late added."""
    steps = [f"{path}/hours/{n}" for n in child_names(spark, f"{path}/hours") if int(n.removeprefix("upto=")) <= mark(spark, path)]
    late = [f"{path}/late/{n}" for n in child_names(spark, f"{path}/late")]
    rows = spark.read.parquet(*steps)
    return _merged(rows.unionByName(spark.read.parquet(*late))) if late else rows


def tail(comments: DataFrame, path: str) -> DataFrame:
    """Raw comments at or after the mark."""
    return comments.filter(F.col("timestamp") >= at(comments, mark(comments.sparkSession, path)))


def hours(comments: DataFrame, path: str, start: Column | None = None) -> DataFrame:
    """All hours with averages and score: stored ones and those after the mark."""
    both = stored_hours(comments.sparkSession, path).unionByName(_hours(tail(comments, path)))
    both = both if start is None else both.filter(F.col("window_start") >= start)
    return rollups.with_score(both)


def latest(comments: DataFrame, path: str, programs: list[str] | None = None) -> DataFrame:
    """The newest hour of every program: one stored row each, and the raw tail."""
    spark = comments.sparkSession
    known = spark.read.parquet(f"{path}/latest/upto={mark(spark, path)}")
    both = known.unionByName(_hours(tail(comments, path)))
    both = both.filter(F.col("program_id").isin(programs)) if programs else both
    return rollups.with_score(_last_hours(both))


def newest(comments: DataFrame, path: str, back: timedelta | None = None) -> Column:
    """The time of the newest comment, less ``back``, as a scalar subquery over
    the same rows as :func:`latest`."""
    spark = comments.sparkSession
    known = spark.read.parquet(f"{path}/latest/upto={mark(spark, path)}").select("newest")
    both = known.unionByName(tail(comments, path).select(F.col("timestamp").alias("newest")))
    value = F.max("newest")
    return both.agg((value - F.lit(back) if back else value).alias("moment")).scalar()
