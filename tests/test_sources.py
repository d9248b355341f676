import datetime as dt
import os
import tempfile

from conftest import SF001, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.plans.inspect import partition_filters, pushed_filters, read_schemas
from cadence.sources import generate, ingest
from cadence.sources.files import read_csv, read_orc, read_parquet, write_csv, write_noop, write_orc, write_parquet
from cadence.sources.schemas import INTERACTIONS
from cadence.sources.tables import interactions


def tmp():
    return tempfile.mkdtemp(prefix="cadence-test-")


def small(spark):
    data = [
        (f"u{i:06d}", dt.datetime(2024, 1, 1 + i % 5, 10, 0, i % 60), "edit", f"p{i}", 100 + i, "5.1.2")
        for i in range(100)
    ]
    df = spark.createDataFrame(data, "user_id string, timestamp timestamp, action_type string, page_id string, duration_ms int, app_version string")
    return df.withColumn("date", F.to_date("timestamp").cast("string"))


def test_headerless_csv_loses_a_row_per_file_when_read_with_header(spark):
    path = os.path.join(tmp(), "t")
    df = small(spark).repartition(4)
    df.write.partitionBy("date").mode("overwrite").csv(path)  # no header, like the reference writer
    n_files = sum(1 for _, _, fs in os.walk(path) for f in fs if f.endswith(".csv"))
    assert read_csv(spark, path, INTERACTIONS, header=False).count() == 100
    assert read_csv(spark, path, INTERACTIONS, header=True).count() == 100 - n_files


def test_csv_round_trip_equals_parquet_round_trip_and_widens_int(spark):
    df = small(spark)
    c, p = os.path.join(tmp(), "c"), os.path.join(tmp(), "p")
    write_csv(df, c, ["date"])
    write_parquet(df, p, ["date"])  # duration_ms written as INT
    a = read_csv(spark, c, INTERACTIONS)
    b = read_parquet(spark, p, INTERACTIONS)  # read as BIGINT, date typed DATE
    assert b.schema["duration_ms"].dataType == T.LongType()
    assert b.schema["date"].dataType == T.DateType()
    assert b.columns[-1] == "date"  # discovered partition column comes last
    cols = [f.name for f in INTERACTIONS.fields]
    assert rows(a.select(cols)) == rows(b.select(cols))
    o = os.path.join(tmp(), "o")
    write_orc(df, o, ["date"])
    assert rows(read_orc(spark, o, INTERACTIONS).select(cols)) == rows(b.select(cols))


def test_partition_pruning_and_pushdown(spark):
    p = os.path.join(tmp(), "p")
    write_parquet(small(spark), p, ["date"])
    df = read_parquet(spark, p, INTERACTIONS)
    q = df.where((F.col("date") >= dt.date(2024, 1, 2)) & (F.col("date") < dt.date(2024, 1, 4))).select("user_id")
    assert any("date" in f for f in partition_filters(q))
    assert q.count() == 40
    ev = interactions(spark, SF001).where(F.col("user_id").isin(7, 42)).select("user_id", "timestamp")
    assert any("In(user_id" in f for f in pushed_filters(ev))
    assert read_schemas(ev) == ["struct<ts:timestamp_ntz,user_id:bigint>"]


def test_noop_sink_runs(spark):
    write_noop(interactions(spark, SF001))


def test_generator_deterministic_and_in_domain(spark):
    a = generate.generate_interactions(spark, 2000, seed=7)
    b = generate.generate_interactions(spark, 2000, seed=7)
    assert rows(a) == rows(b)
    s = a.agg(
        F.min("duration_ms"), F.max("duration_ms"), F.min("timestamp"), F.max("timestamp"), F.count_distinct("action_type")
    ).first()
    assert 100 <= s[0] and s[1] <= 300000
    assert s[2] >= dt.datetime(2024, 1, 1) and s[3] <= dt.datetime(2024, 12, 31)
    assert s[4] == 5
    m = generate.generate_metadata(spark, 2000)
    assert m.select("user_id").distinct().count() < 2000  # drawn with replacement
    assert set(r[0] for r in m.select("subscription_type").distinct().collect()) <= {"free", "basic", "premium", "enterprise"}


def test_corrupt_rows_captured_not_dropped(spark):
    docs = spark.createDataFrame([(1, "one line", "en"), (2, "two\nlines, with \"quotes\"", "en")], "doc_id long, text string, lang string")
    path = os.path.join(tmp(), "docs")
    docs.write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    # the first physical line of document 2 is short: it must not count as good
    bad = {r["status"]: (r["rows"], r["keyed_rows"]) for r in ingest.ingest_report(ingest.read_csv_capturing_errors(spark, path, schema), "doc_id").collect()}
    assert bad == {"ok": (1, 1), "corrupt": (2, 1)}
    good = {r["status"]: r["rows"] for r in ingest.ingest_report(ingest.read_csv_capturing_errors(spark, path, schema, multiline=True), "doc_id").collect()}
    assert good == {"ok": 2}


def test_csv_and_conversion_lose_nothing(spark):
    data = [
        (1, 'a "quoted", b', dt.datetime(2024, 1, 1, 1, 2, 3, 456789), ""),
        (2, "two\nlines \\ and a \\n", None, None),
        (3, "  spaces  ", dt.datetime(1999, 12, 31, 23, 59, 59, 999999), "é"),
        (4, None, dt.datetime(2024, 6, 1), '"'),
    ]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(data, f"id long, t string, ts {kind}, u string")
        back = ingest.csv_parquet_round_trip(df, df.schema, [], multiline=True)
        assert rows(back) == rows(df)
