"""Joins with a key that holds half of all rows."""

import statistics

import pytest
from pyspark.sql import functions as F

from chatterlens.operators import joins, skew
from chatterlens.sources import store


@pytest.fixture
def plain_plans(spark):
    """Neither broadcast joins nor adaptive changes."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.fixture
def half_hot(spark):
    key = F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 101 == 3, None).otherwise(
        F.concat(F.lit("k"), F.col("id") % 997))
    return spark.range(0, 40_000, 1, 4).select("id", key.alias("k"))


def test_heavy_keys(half_hot):
    assert skew.heavy_keys(half_hot, ["k"]) == ['{"k":"hot"}']
    assert skew.heavy_keys(half_hot.limit(0), ["k"]) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_joins_equal_plain_ones(spark, half_hot, how, plain_plans):
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), ("none", 4), (None, 5)], "k string, v int")
    plain = half_hot.join(small, ["k"], how)
    split = skew.join(half_hot, small, ["k"], how)
    order = split.columns
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.select(*order).collect()))


def test_no_task_gets_twice_the_median(spark, half_hot, plain_plans):
    small = half_hot.select("k").where("k IS NOT NULL").distinct().withColumn("v", F.lit(1))
    found = skew.join(half_hot, small, ["k"]).withColumn("part", F.spark_partition_id())
    per_task = [r["count"] for r in found.filter("k = 'hot'").groupBy("part").count().collect()]
    assert len(per_task) > 4 and max(per_task) <= 2 * statistics.median(per_task)


@pytest.mark.parametrize("bound", [10_000, 3])
def test_restricting_to_ids(spark, half_hot, bound, plain_plans):
    ids = spark.createDataFrame([("hot",), ("k5",), ("k5",), ("k7",), ("x",), (None,)], "k string")
    found = skew.restrict_to(half_hot, ids, "k", bound)
    assert sorted(r["id"] for r in found.collect()) == sorted(
        r["id"] for r in half_hot.join(ids, "k", "left_semi").collect())
    without_hot = skew.restrict_to(half_hot, ids.where("k <> 'hot'"), "k", bound)
    assert without_hot.filter("k = 'hot'").count() == 0 and without_hot.count() > 0


def test_few_ids_need_no_exchange_of_the_rows(spark, half_hot):
    plan = skew.restrict_to(half_hot, spark.createDataFrame([("hot",)], "k string"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" not in plan.split("BroadcastExchange")[0]


def test_split_interval_join(spark):
    moments = spark.sql("SELECT 'p' AS program_id, timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,id) AS timestamp, id AS m FROM range(5)")
    events = spark.sql("SELECT CASE WHEN id % 50 = 0 THEN 'q' ELSE 'p' END AS program_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id) AS timestamp, id FROM range(2000)")
    plain, split = joins.around(moments, events), joins.around(moments, events, split=True)
    assert split.columns == plain.columns and sorted(split.collect()) == sorted(plain.collect()) and plain.count() > 0


def test_sorted_sets_fold_as_they_are_written(spark):
    stored = spark.createDataFrame([("a", 5), ("b", 2)], "topic string, score long")
    new = spark.createDataFrame([("a", 1, 1), ("a", 7, 2), ("c", 3, 1)], "topic string, score long, seq int")
    folded = {r["topic"]: (r["replaced"], r["incremented"]) for r in store.fold_scores(
        stored.withColumn("seq", F.lit(None).cast("int")).unionByName(new), ("topic",)).collect()}
    replaced = {r["topic"]: r["score"] for r in store.replace_scores(stored, new, ("topic",)).collect()}
    added = {r["topic"]: r["score"] for r in store.increment_scores(stored, new, ("topic",)).collect()}
    assert folded == {t: (replaced[t], added[t]) for t in replaced}
