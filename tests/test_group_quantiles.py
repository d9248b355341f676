"""Percentiles and modes per group against numpy; a hot group is spread."""

import decimal
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import group_quantiles, quality


def table(spark, n=3000):
    rng = random.Random(4)
    rows = [(rng.choice(["a"] * 6 + ["b", "c", "d", None]), rng.choice([None, *range(200)]) if rng.random() < 0.5 else rng.randrange(9)) for _ in range(n)]
    rows += [("lonely", 5), ("nothing", None), ("pair", 1), ("pair", 2)]
    return rows, spark.createDataFrame(rows, "g string, v bigint").repartition(7)


def test_percentiles_and_modes_against_numpy(spark):
    rows, df = table(spark)
    values = {}
    for g, v in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    probs = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {(r["g"], r["p"]): r["value"] for r in group_quantiles.group_percentiles(df, "g", "v", probs).collect()}
    want = {(g, p): float(np.percentile(vs, 100 * p)) for g, vs in values.items() for p in probs}
    assert got == pytest.approx(want)
    modes = {r["g"]: (r["mode"], r["count"]) for r in group_quantiles.group_modes(df, "g", "v").collect()}
    assert modes == {g: min(((v, n) for v, n in Counter(vs).items()), key=lambda x: (-x[1], x[0])) for g, vs in values.items()}
    assert group_quantiles.group_percentiles(df.limit(0), "g", "v", (0.5,)).count() == 0
    with pytest.raises(ValueError):
        group_quantiles.group_percentiles(df, "g", "v", (1.5,))


def test_a_hot_group_lies_in_many_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 97)).alias("g"), F.xxhash64("id").alias("v"))
        hist = group_quantiles.group_histogram(df, "g", "v")
        parts = hist.where("g = 'hot'").groupBy("b").count().collect()
        assert len(parts) >= 3 and max(r["count"] for r in parts) < 0.6 * 18_000
        got = group_quantiles.group_percentiles(df, "g", "v", (0.5,), hist).where("g = 'hot'").first()
        vs = sorted(r["v"] for r in df.where("g = 'hot'").collect())
        assert (got["low"], got["high"]) == (vs[8999], vs[9000])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_large_whole_numbers_and_decimals_stay_exact(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([("a", big), ("a", big), ("a", None), ("b", 3), ("b", 4), ("b", None), (None, 7), (None, None)], "g string, v bigint")
    filled = {(r["g"], r["v"]) for r in quality.impute_by_group(df, "v", "g", how="median").where("imputed").collect()}
    assert filled == {("a", big), ("b", 4), (None, None)}  # a null group matches none, as for the mean
    d = decimal.Decimal
    dec = spark.createDataFrame([("a", d("1.10")), ("a", d("1.13")), ("a", None)], "g string, v decimal(10,2)")
    out = quality.impute_by_group(dec, "v", "g", how="median")
    assert out.schema["v"].dataType == dec.schema["v"].dataType
    assert out.where("imputed").first()["v"] in (d("1.11"), d("1.12"))
    mode = quality.impute_by_group(df, "v", "g", how="mode").where("imputed").collect()
    assert {(r["g"], r["v"]) for r in mode} == {("a", big), ("b", 3), (None, None)}
    with pytest.raises(ValueError):
        quality.impute_by_group(df, "v", "g", how="guess")
