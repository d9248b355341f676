"""Semi-join reduction: same rows as the plain join, fewer of them shuffled."""

import pytest
from conftest import SF001, rows
from pyspark.sql import functions as F

from cadence.operators import joins, semijoin
from cadence.plans.inspect import plan_text
from cadence.sources.tables import interactions, user_metadata


def events_and_users(spark, n=6000):
    i = F.col("id")
    key = F.when(i % 3 == 0, F.lit("hot")).when(i % 11 == 1, F.lit(None)).otherwise(F.concat(F.lit("u"), (i % 500).cast("string")))
    events = spark.range(n).select(i.alias("_word"), key.alias("user_id"), (i % 50).alias("country"))
    users = [("u1", "US"), ("u1", "FR"), ("u4", None), (None, "XX"), ("nobody", "YY"), ("u499", "DE")]
    return events, spark.createDataFrame(users, "user_id string, country string")


@pytest.mark.parametrize("how", ["left_outer", "inner"])
@pytest.mark.parametrize("hot", [False, True])
def test_same_rows_as_the_plain_join(spark, how, hot):
    events, users = events_and_users(spark)
    if hot:
        users = users.union(spark.createDataFrame([("hot", "UK")], users.schema))
    want = events.join(users.select(F.col("user_id").alias("k"), F.col("country").alias("c")), F.col("user_id") == F.col("k"), how).drop("k")
    assert rows(semijoin.reduced_join(events, users, ["country"], how=how).toDF("_word", "user_id", "country", "c")) == rows(want)


@pytest.mark.parametrize("how", ["left_outer", "inner"])
def test_empty_sides(spark, how):
    events, users = events_and_users(spark, 100)
    none = semijoin.reduced_join(events, users.limit(0), ["country"], how=how)
    assert none.count() == (100 if how == "left_outer" else 0)
    assert semijoin.reduced_join(events.limit(0), users, ["country"], how=how).count() == 0


@pytest.mark.parametrize("keys,rate", [(20_000, 0.01), (20_000, 0.1), (3, 0.01)])
def test_holds_every_key_and_keeps_to_its_rate(spark, keys, rate):
    flt = semijoin.build_filter(spark.range(keys).withColumnRenamed("id", "user_id"), "user_id", rate)
    assert semijoin.candidates(spark.range(keys), "id", flt).count() == keys
    passed = semijoin.candidates(spark.range(10**6, 10**6 + 200_000), "id", flt).count()
    assert passed <= 1.25 * rate * 200_000
    assert abs(passed / 200_000 - semijoin.false_positive_rate(keys, flt.n_words, flt.bits)) <= 0.2 * rate + 1e-4
    # candidates and strangers part the rows
    assert semijoin.strangers(spark.range(10**6, 10**6 + 200_000), "id", flt).count() == 200_000 - passed


def test_size_follows_the_keys_and_stops_at_its_bound():
    small, _ = semijoin.geometry(100_000)
    large, _ = semijoin.geometry(1_000_000)
    assert 8 <= large / small <= 12 and large * 64 / 1_000_000 <= 20
    n_words, bits = semijoin.geometry(10**9)
    assert n_words * 8 == semijoin.MAX_BYTES
    assert semijoin.false_positive_rate(10**9, n_words, bits) > semijoin.USELESS
    assert semijoin.geometry(0)[0] == semijoin.BLOCK_WORDS


def test_too_many_keys_for_the_bound_join_without_a_filter(spark):
    events, users = events_and_users(spark, 2000)
    wide = spark.range(50_000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("user_id"), F.lit("ZZ").alias("country"))
    got = semijoin.reduced_join(events, wide, ["country"], max_bytes=4096)
    assert "BroadcastHashJoin" not in plan_text(got)
    assert rows(got.toDF("_word", "user_id", "a", "b")) == rows(joins.enrich(events, wide, ["country"]).toDF("_word", "user_id", "a", "b"))


def test_merged_filters_equal_one_of_all_keys(spark):
    ids = spark.range(9000).withColumnRenamed("id", "user_id")
    parts = [semijoin.build_filter(ids.where(F.col("user_id") % 3 == r), expected_keys=9000) for r in range(3)]
    whole = semijoin.build_filter(ids, expected_keys=9000)
    assert rows(semijoin.merge_filters(*parts).blocks) == rows(whole.blocks)
    with pytest.raises(ValueError, match="geometry"):
        semijoin.merge_filters(parts[0], semijoin.build_filter(ids, expected_keys=90_000))


def test_integers_of_all_widths_meet_and_other_types_are_refused(spark):
    flt = semijoin.build_filter(spark.range(-50, 50).select(F.col("id").cast("int").alias("user_id")))
    assert semijoin.candidates(spark.range(-50, 50), "id", flt).count() == 100
    with pytest.raises(ValueError, match="another type"):
        semijoin.candidates(spark.range(5).select(F.col("id").cast("string").alias("k")), "k", flt)
    with pytest.raises(ValueError, match="hash alike"):
        semijoin.build_filter(spark.range(5).select(F.col("id").cast("double").alias("user_id")))


def test_the_filter_stands_below_the_shuffle_and_thins_it(spark):
    events = interactions(spark, SF001)
    users = user_metadata(spark, SF001, ["subscription_type"]).where("subscription_type = 'BUILDING'")
    plan = plan_text(semijoin.reduced_join(events, users, how="inner"))
    # the plan is printed from the top: join, exchange of the events, probe
    assert plan.index("SortMergeJoin") < plan.index("+- Exchange") < plan.index("LeftSemi")
    flt = semijoin.build_filter(users, "user_id")
    known = {r[0] for r in users.select("user_id").collect()}
    total, kept = events.count(), semijoin.candidates(events, "user_id", flt).count()
    matched = events.where(F.col("user_id").isin(list(known))).count()
    assert matched <= kept <= matched + 0.03 * total < total / 2
