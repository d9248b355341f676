import datetime as dt
import os

import pytest
from conftest import SF001, rows
from pyspark.sql import functions as F

from cadence.operators import joins
from cadence.plans.inspect import count_exchanges, join_kinds, plan_text
from cadence.sources.tables import interactions, user_metadata


def facts(spark, data):
    return spark.createDataFrame(data, "event_id long, user_id string, action_type string")


def dims(spark, data):
    return spark.createDataFrame(data, "user_id string, country string, subscription_type string")


def test_missing_duplicate_and_null_keys(spark):
    f = facts(spark, [(1, "a", "x"), (2, "b", "x"), (3, "z", "x"), (4, None, "x")])
    d = dims(spark, [("a", "US", "free"), ("b", "UK", "basic"), ("b", "UK", "premium")])
    out = rows(joins.enrich(f, d))
    # b duplicated in the dimension -> its event appears twice; z and null -> null attribute
    assert out == sorted(
        [(1, "a", "x", "free"), (2, "b", "x", "basic"), (2, "b", "x", "premium"), (3, "z", "x", None), (4, None, "x", None)],
        key=lambda t: tuple((x is None, str(x)) for x in t),
    )
    assert len(rows(joins.enrich(f, d, dedupe=True))) == 4
    counts = {(r[0], r[1]): r[2] for r in joins.activity_by(f, d).collect()}
    # inner join: null key and unmatched dropped; duplicates multiply
    assert counts == {("US", "free"): 1, ("UK", "basic"): 1, ("UK", "premium"): 1}


def test_strategies_agree_and_plans(spark):
    ev, md = interactions(spark, SF001), user_metadata(spark, SF001)
    base = rows(joins.enrich(ev, md, strategy="merge"))
    for s in ("broadcast", "shuffle_hash", "auto"):
        assert rows(joins.enrich(ev, md, strategy=s)) == base
    assert "SortMergeJoin" in join_kinds(joins.enrich(ev, md, strategy="merge"))
    assert "BroadcastHashJoin" in join_kinds(joins.enrich(ev, md, strategy="broadcast"))
    assert "ShuffledHashJoin" in join_kinds(joins.enrich(ev, md, strategy="shuffle_hash"))


def test_broadcast_over_the_limits_is_an_error(spark):
    from cadence.plans.strategy import BroadcastTooLarge, broadcast_checked, measured_size

    ev, md = interactions(spark, SF001), user_metadata(spark, SF001)
    with pytest.raises(BroadcastTooLarge):
        joins.enrich(ev, md, strategy="broadcast", max_broadcast_bytes=10)
    dim = md.select("user_id", "subscription_type")
    n, b = measured_size(dim)
    assert n == dim.count() and b > 0
    broadcast_checked(dim, max_bytes=b, max_rows=n)
    for limits in (dict(max_bytes=b - 1), dict(max_rows=n - 1)):
        with pytest.raises(BroadcastTooLarge):
            broadcast_checked(dim, **limits)


def test_a_derived_dimension_is_built_once_for_a_broadcast(spark):
    from cadence.plans.strategy import broadcast_checked, is_derived

    md = user_metadata(spark, SF001)
    assert is_derived(md) and not is_derived(user_metadata(spark, SF001, ("subscription_type",)))
    assert not is_derived(broadcast_checked(md))


def test_every_customer_is_in_the_dimension(spark):
    ev = interactions(spark, SF001)
    total = joins.activity_by(ev, user_metadata(spark, SF001)).agg(F.sum("count")).first()[0]
    assert total == ev.count()


def _skewed(spark):
    hot = [(i, "hot", "x") for i in range(900)]
    warm = [(2000 + i, "warm", "x") for i in range(120)]
    cold = [(5000 + i, f"c{i % 30}", "x") for i in range(60)]
    none = [(9000 + i, None, "x") for i in range(400)]
    f = facts(spark, hot + warm + cold + none)
    d = dims(spark, [("hot", "US", "free"), ("warm", "UK", "basic"), ("c2", "DE", "premium"), ("c2", "DE", "free")])
    return f, d


def test_salted_equals_plain_with_hot_and_null_keys(spark):
    f, d = _skewed(spark)
    plain = rows(joins.enrich(f, d))
    for kw in (dict(salt_rows=50), dict(salt_rows=10, hot_min_rows=100), dict()):
        assert rows(joins.enrich(f, d, strategy="salted", **kw)) == plain


def test_salts_follow_the_keys_own_size_and_nulls_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        f, d = _skewed(spark)
        j = joins.enrich(f, d, strategy="salted", salt_rows=50)
        parts = {}
        for r in j.withColumn("p", F.spark_partition_id()).select("user_id", "p").collect():
            parts.setdefault(r["user_id"], []).append(r["p"])
        # 18 salts and 4 partitions: the hot key and the nulls are in all of them
        for key in ("hot", None):
            sizes = [parts[key].count(p) for p in set(parts[key])]
            assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes), key
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_keys_are_bounded_by_the_row_count(spark):
    from cadence.operators.skew import hot_keys

    f, _ = _skewed(spark)
    assert rows(hot_keys(f, "user_id", 100)) == [("hot", 900), ("warm", 120)]
    assert rows(hot_keys(f, "user_id", 0, most=5)) == [("hot", 900)]  # more than a fifth of 1,480 rows


def test_bucketed_join_has_no_exchange_under_the_bucketed_side(spark):
    ev, md = interactions(spark, SF001), user_metadata(spark, SF001)
    j = joins.bucketed_join(ev, md, buckets=4)
    assert rows(j) == rows(joins.enrich(ev, md))
    laid = joins.prepare_layout(ev, "user_id", buckets=4, partition_by=())
    dim = joins.write_bucketed(md.select("user_id", "subscription_type"), "user_id", 4)
    even = laid.bucketed.join(dim.hint("merge"), "user_id", "left")
    assert "SortMergeJoin" in plan_text(even, "simple") and count_exchanges(even) == 0


def test_prepared_layout_prunes_and_stores_hot_and_null_keys_aside(spark):
    from cadence.plans.inspect import partition_filters

    md = user_metadata(spark, SF001)
    ev = interactions(spark, SF001)
    user = F.when(F.col("event_id") % 10 < 3, F.lit(7)).when(F.col("event_id") % 10 < 5, F.lit(None)).otherwise(F.col("user_id"))
    ev = ev.withColumn("user_id", user.cast("bigint"))
    laid = joins.prepare_layout(ev, "user_id", buckets=4, hot_min_rows=500)
    assert {r[0] for r in laid.aside.select("user_id").distinct().collect()} == {7, None}
    assert laid.bucketed.count() + laid.aside.count() == ev.count()
    j = joins.layout_join(laid, md)
    assert rows(j.select(*ev.columns, "subscription_type")) == rows(joins.enrich(ev, md))
    ranged = laid.bucketed.where(F.col("date") == dt.date(2024, 1, 3))
    assert any("date" in f for f in partition_filters(ranged))


def test_at_most_one_file_per_bucket_and_date(spark):
    ev = interactions(spark, SF001).repartition(16)
    laid = joins.prepare_layout(ev, "user_id", buckets=4)
    dates = ev.select("date").distinct().count()
    assert len(laid.bucketed.inputFiles()) <= 4 * dates


def test_scratch_tables_and_folders_are_cleaned(spark):
    from cadence import session

    laid = joins.prepare_layout(interactions(spark, SF001), "user_id", buckets=2)
    table, path = session._scratch_tables[-1], session._scratch_paths[-1]
    assert spark.catalog.tableExists(table) and laid.aside.count() == 0
    session.clean_scratch(spark)
    assert not spark.catalog.tableExists(table) and not os.path.exists(path)


def test_enrich_attribute_also_in_events(spark):
    f = spark.createDataFrame([(1, "a", "XX"), (2, "b", "YY")], "event_id long, user_id string, country string")
    d = dims(spark, [("a", "US", "free")])
    for strategy in ("merge", "broadcast", "salted"):
        out = joins.enrich(f, d, cols=("country",), strategy=strategy, salt_rows=1)
        assert out.columns == ["event_id", "user_id", "country", "country"]
        assert sorted((r[0], r[3]) for r in out.collect()) == [(1, "US"), (2, None)]


def test_auto_bucket_count_follows_the_files_and_the_limit(spark):
    ev = interactions(spark, SF001)
    size = os.path.getsize(f"{SF001}/events.parquet")
    assert joins.auto_buckets(ev) == 1
    assert joins.auto_buckets(ev, bucket_bytes=10_000) == -(-size // 10_000)
    with pytest.raises(ValueError, match="maxBuckets"):
        joins.auto_buckets(ev, bucket_bytes=1)
    with pytest.raises(ValueError, match="no input files"):
        joins.auto_buckets(spark.range(5))


def test_auto_buckets_follow_the_rows_and_not_their_compressed_files(spark, tmp_path):
    wide = F.concat(F.repeat(F.lit("x"), 400), (F.col("id") % 3).cast("string"))
    spark.range(400_000).select((F.col("id") % 1000).alias("user_id"), wide.alias("page_id")).write.parquet(f"{tmp_path}/ev")
    ev = spark.read.parquet(f"{tmp_path}/ev")
    assert joins.auto_buckets(ev) == 1  # the files are small, the rows take about 170 MB
    laid = joins.prepare_layout(ev, "user_id", partition_by=())
    assert laid.buckets == joins.payload_buckets(ev) == 2
    parts = [r["count"] for r in laid.bucketed.groupBy(F.input_file_name()).count().collect()]
    assert sum(parts) == 400_000 and max(parts) < 250_000


def test_buckets_of_a_join_follow_the_larger_side(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins.payload_buckets, "__defaults__", (10_000,))
    spark.range(50).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id")).write.parquet(f"{tmp_path}/ev")
    ev = spark.read.parquet(f"{tmp_path}/ev")
    keys = F.when(F.col("id") % 2 == 0, F.col("id"))  # half of the users have no id
    md = spark.range(2000).select(keys.alias("user_id"), F.col("id").cast("string").alias("subscription_type"))
    seen = []
    real = joins.write_bucketed
    monkeypatch.setattr(joins, "write_bucketed", lambda df, key, n, *a: seen.append((n, df.count())) or real(df, key, n, *a))
    assert rows(joins.bucketed_join(ev, md)) == rows(joins.enrich(ev, md))
    n = joins.payload_buckets(md)
    assert n > 5 > joins.payload_buckets(ev) and seen == [(n, 50), (n, 1000)]


def test_payload_buckets_stay_within_sparks_limit(spark):
    assert joins.payload_buckets(spark.range(0)) == 1
    assert joins.payload_buckets(spark.range(200_000), bucket_payload=1) == 100_000


def test_key_skew_summary_sees_a_hot_key(spark):
    from cadence.operators.skew import key_skew_summary

    ev = interactions(spark, SF001)
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 10 < 3, F.lit(7)).otherwise(F.col("user_id")))
    flat = key_skew_summary(ev, "user_id").first()
    skewed = key_skew_summary(hot, "user_id").first()
    assert flat["rows"] == skewed["rows"] == ev.count()
    assert flat["max_to_median"] < 2 < 20 < skewed["max_to_median"]
    assert 0.3 <= skewed["max_key_share"] <= 0.32


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from cadence.session import _is_local

    on = lambda master: _is_local(SimpleNamespace(sparkContext=SimpleNamespace(master=master)))
    assert on("local[4]") and on("local-cluster[3,2,1024]")
    assert not on("yarn") and not on("spark://host:7077") and not on("k8s://x")
