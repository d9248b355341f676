"""Partitions of equal weight: loads, joins and counts on skewed keys."""

import pytest
from conftest import SF001, rows
from pyspark.sql import functions as F

from cadence.operators import joins, partitioning
from cadence.plans.inspect import plan_text
from cadence.sources.tables import interactions, user_metadata


def skewed(spark, n=24_000):
    """A third of the rows on one key, a tenth without key, some warm keys."""
    i = F.col("id")
    key = (
        F.when(i % 3 == 0, F.lit("hot")).when(i % 10 == 1, F.lit(None)).when(i % 7 == 2, F.concat(F.lit("warm"), (i % 5).cast("string")))
        .otherwise(F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(3000)).cast("string")))
    )
    return spark.range(n).select(i.alias("event_id"), key.alias("user_id"), (i % 50).alias("page"))


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_no_partition_is_over_one_and_a_half_times_the_mean(spark, partitions):
    df = skewed(spark)
    plan = partitioning.plan_partitions(df, "user_id", partitions)
    placed = partitioning.send(df, plan)
    loads = {r["part"]: r["count"] for r in partitioning.partition_loads(placed).collect()}
    assert sum(loads.values()) == df.count() and set(loads) <= set(range(partitions))
    # pieces are dealt by hash: a little more than half a partition
    assert max(loads.values()) <= 1.6 * df.count() / partitions
    where = placed.select("part", F.spark_partition_id().alias("p")).distinct().collect()
    assert all(r["part"] == r["p"] for r in where)
    assert placed.drop("part").exceptAll(df).count() == 0


def test_what_the_driver_sees_follows_the_partitions_not_the_keys(spark):
    many = spark.range(50_000).select(F.col("id").alias("user_id"))
    plan = partitioning.plan_partitions(many, "user_id", 5)
    assert plan.large.count() == 0 and len(plan.item_parts) == 5 * partitioning.ITEMS
    few = spark.range(50_000).select((F.col("id") % 70).alias("user_id"))
    plan = partitioning.plan_partitions(few, "user_id", 5)
    assert plan.large.count() == 70 <= 5 * partitioning.ITEMS


def test_lightest_first_fills_evenly():
    weights = [7, 7, 6, 5, 5, 4, 4, 3, 2, 2, 1]
    part = partitioning.lightest_first(weights, 3)
    loads = [sum(w for w, p in zip(weights, part) if p == q) for q in range(3)]
    assert max(loads) - min(loads) <= 1
    assert partitioning.lightest_first([], 3) == []


def test_balanced_join_equals_the_plain_one(spark):
    df = skewed(spark, 6000)
    users = [("hot", "US"), ("hot", "FR"), ("warm1", "UK"), ("c2", "DE"), (None, "XX"), ("nobody", "YY")]
    dim = spark.createDataFrame(users, "user_id string, country string")
    want = rows(joins.enrich(df, dim, ["country"]))
    assert rows(partitioning.balanced_join(df, dim, ["country"], partitions=6)) == want
    empty = df.limit(0)
    assert partitioning.balanced_join(empty, dim, ["country"], partitions=3).count() == 0
    # a plan of other data gives the same rows
    other = partitioning.plan_partitions(df.where("page < 3"), "user_id", 3)
    assert rows(partitioning.balanced_join(df, dim, ["country"], plan=other)) == want
    # columns named like the helpers' own
    clash = df.select("event_id", "user_id", F.col("page").alias("part"), F.lit(1).alias("k"), F.lit(2).alias("pieces"), F.lit(3).alias("first_item"))
    got = partitioning.balanced_join(clash, dim, ["country"], partitions=4)
    assert rows(got) == rows(joins.enrich(clash, dim, ["country"]))


def test_the_join_needs_no_exchange_of_its_own(spark):
    j = partitioning.balanced_join(interactions(spark, SF001), user_metadata(spark, SF001, ("subscription_type",)))
    plan = plan_text(j, "simple")
    assert plan.count("Exchange shufflepartitionidpassthrough") == 2 and "Exchange hashpartitioning" not in plan


def test_counts_of_different_values(spark):
    df = skewed(spark, 9000)
    want = rows(df.groupBy("user_id").agg(F.count_distinct("page").alias("count")))
    assert rows(partitioning.balanced_count_distinct(df, "user_id", "page", partitioning.plan_partitions(df, "user_id", 7))) == want
