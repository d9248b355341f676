import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import quality
from cadence.operators.quantiles import exact_percentiles


def vals(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, x double")


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_percentiles_match_numpy_with_hot_value(spark, seed):
    rnd = random.Random(seed)
    xs = [float(rnd.randint(0, 5000)) for _ in range(3000)] + [42.0] * 2000 + [None] * 10
    probs = [0, 0.01, 0.1, 0.25, 0.333, 0.5, 0.9, 0.99, 1]
    got = {r["p"]: r["value"] for r in exact_percentiles(vals(spark, xs), "x", probs).collect()}
    arr = np.array([x for x in xs if x is not None])
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(arr, p)), rel=1e-12)


def test_exact_percentiles_empty_and_single(spark):
    assert exact_percentiles(vals(spark, [1.0]).where("false"), "x", [0.5]).count() == 0
    assert exact_percentiles(vals(spark, [7.0]), "x", [0.1, 0.9]).collect()[0]["value"] == 7.0


def test_capped_and_outliers(spark):
    xs = [float(i) for i in range(1, 101)] + [10_000.0]
    df = vals(spark, xs)
    c = {r["id"]: r["x_capped"] for r in quality.capped(df, "x", 0.05, 0.95).collect()}
    lo, hi = np.quantile(xs, 0.05), np.quantile(xs, 0.95)
    assert c[0] == pytest.approx(lo) and c[100] == pytest.approx(hi)
    out = quality.iqr_outliers(df, "x").collect()
    assert [(r["x"], r["outlier"]) for r in out] == [(10_000.0, "high")]


def test_completeness_validity_uniqueness(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 500), (3, "a", None), (3, "a", None)], "k long, s string, v long")
    comp = {r["column"]: (r["rows"], r["nulls"]) for r in quality.completeness(df).collect()}
    assert comp == {"k": (4, 0), "s": (4, 1), "v": (4, 2)}
    val = {r["rule"]: r["violations"] for r in quality.validity(df, {"v_small": F.col("v") < 100, "s_is_a": F.col("s") == "a"}).collect()}
    assert val == {"v_small": 3, "s_is_a": 1}  # null counts as a violation
    u = quality.uniqueness(df, ["k", "s", "v"], "t").first()
    assert (u["rows"], u["distinct_keys"], u["duplicate_keys"], u["duplicate_rows"]) == (4, 3, 1, 1)


def test_orphans_and_accuracy(spark):
    fact = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    dim = spark.createDataFrame([(1,), (3,)], "k long")
    o = quality.orphans(fact, "k", dim, "k", "x").first()
    assert (o["rows"], o["violations"]) == (4, 2)
    a = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "k long, v double")
    t = spark.createDataFrame([(1, 10.0), (2, 21.0)], "k long, tv double")
    r = quality.accuracy(a, t, "k", "v", "tv", "x").first()
    assert (r["rows"], r["missing"], r["mismatches"]) == (3, 1, 1)


def test_quarantine_writes_both_sides_and_impute(spark):
    df = spark.createDataFrame([(1, "g", 5), (2, "g", 500), (3, "h", None), (4, "g", 7)], "id long, grp string, v long")
    rules = {"v_present": F.col("v").isNotNull(), "v_small": F.col("v") < 100}
    path = os.path.join(tempfile.mkdtemp(), "q")
    bad = {r["id"]: r["reasons"] for r in quality.quarantine(df, rules, path).collect()}
    assert bad == {2: "v_small", 3: "v_present;v_small"}
    assert {"is_valid=false", "is_valid=true"} <= set(os.listdir(path))
    imp = {r["id"]: (r["v"], r["imputed"]) for r in quality.impute_by_group(df, "v", "grp", valid=F.col("v") < 100).collect()}
    assert imp == {1: (5, False), 2: (6, True), 3: (None, True), 4: (7, False)}


def test_exact_percentiles_many_buckets(spark):
    rnd = random.Random(3)
    xs = [float(rnd.randint(0, 10**6)) for _ in range(20000)]
    probs = [0.001, 0.3, 0.5, 0.999]
    got = {r["p"]: r["value"] for r in exact_percentiles(vals(spark, xs), "x", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(np.array(xs), p)), rel=1e-12)


def test_reports_on_empty_input(spark):
    empty = spark.createDataFrame([], "k long, s string")
    comp = quality.completeness(empty).collect()
    assert [(r["column"], r["rows"], r["nulls"], r["null_rate"]) for r in comp] == [("k", 0, 0, None), ("s", 0, 0, None)]
    val = quality.validity(empty, {"k_pos": F.col("k") > 0}).first()
    assert (val["rows"], val["violations"], val["violation_rate"]) == (0, 0, None)
    with pytest.raises(ValueError):
        exact_percentiles(empty, "k", [1.5])


def test_percentiles_keep_integers_beyond_double_and_decimals(spark):
    from decimal import Decimal

    from cadence.operators.quantiles import percentile_values

    big = 2**53
    df = spark.createDataFrame([(big + i,) for i in range(1, 8)], "x long")
    assert percentile_values(df, "x", {"lo": 0.0, "m": 0.5, "hi": 1.0}) == {"lo": big + 1, "m": big + 4, "hi": big + 7}
    dec = df.withColumn("x", F.col("x").cast("decimal(30,3)"))
    assert percentile_values(dec, "x", {"m": 0.5}) == {"m": Decimal(big + 4)}
    assert [r["x"] for r in quality.capped(df, "x", 0.5, 0.5, mode="filter").collect()] == [big + 4]


def test_percentiles_over_many_partitions(spark):
    xs = [float(i % 997) for i in range(5000)]
    df = vals(spark, xs).repartition(7)
    probs = [0, 0.2, 0.5, 0.77, 1]
    got = {r["p"]: r["value"] for r in exact_percentiles(df, "x", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(np.array(xs), p)), rel=1e-12)


def test_quarantine_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id long, v long")
    out = quality.quarantine(empty, {"v_present": F.col("v").isNotNull()}, os.path.join(tempfile.mkdtemp(), "q"))
    assert out.count() == 0 and out.columns == ["id", "v", "reasons"]


def test_impute_default_mean_median_mode(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 7), (5, 900), (6, 10), (7, 5)], "id long, v long")
    fill = lambda how, **kw: {r["id"]: r["v"] for r in quality.impute(df, "v", how, valid=F.col("v") < 100, **kw).where("imputed").collect()}
    assert fill("default", value=-1) == {2: -1, 5: -1}
    assert fill("mean") == {2: 7, 5: 7}  # 34 / 5 rounded
    assert fill("median") == {2: 7, 5: 7}
    assert fill("mode") == {2: 5, 5: 5}  # 5 and 7 twice each: the smaller
    none = df.where("id = 2")
    assert quality.impute(none, "v", "median").collect()[0]["v"] is None
    with pytest.raises(ValueError):
        quality.impute(df, "v", "guess")


@pytest.mark.parametrize("kind", ["decimal(12,2)", "double", "string"])
def test_impute_by_group_on_other_types(spark, kind):
    df = spark.createDataFrame([(1, "g", 5), (2, "g", None), (3, "h", 9)], "id long, grp string, v long")
    key = "grp" if kind == "string" else "v"
    df = df.withColumn(key, F.col(key).cast(kind))
    out = {r["id"]: (float(r["v"]), r["imputed"]) for r in quality.impute_by_group(df, "v", "grp").collect()}
    assert out == {1: (5.0, False), 2: (5.0, True), 3: (9.0, False)}


def test_deduplicate_keeps_one_row_per_key(spark):
    data = [(1, "a", 5, "x"), (2, "a", 7, "y"), (3, None, 1, "z"), (4, None, 1, "w"), (5, "b", None, "v"), (5, "b", None, "v")]
    df = spark.createDataFrame(data, "id long, k string, t long, s string")
    first = {r["k"]: (r["id"], r["t"], r["s"]) for r in quality.deduplicate(df, ["k"], ["t"]).collect()}
    last = {r["k"]: (r["id"], r["t"], r["s"]) for r in quality.deduplicate(df, ["k"], ["t"], descending=True).collect()}
    assert first == {"a": (1, 5, "x"), None: (3, 1, "z"), "b": (5, None, "v")}
    assert last == {"a": (2, 7, "y"), None: (4, 1, "w"), "b": (5, None, "v")}
