"""Driver tables and their binding to the product-analytics shapes.

The operators take column names as arguments, so they run on the reference
schema (``user_interactions`` / ``user_metadata``) and on the driver's
TPC-H-like tables alike.  ``interactions`` and ``user_metadata`` here give
the driver tables the reference shape with plain projections, so every
query reads the whole given tables and its work grows with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the interactions shape.

    user_id, timestamp, action_type, page_id (``props.k``), duration_ms
    (``value`` seconds → ms), app_version (derived from the event id),
    date, plus ``event_id`` kept as a stable tie-break.
    """
    ev = load(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        "event_id",
        F.col("user_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("action_type"),
        F.get_json_object("props", "$.k").alias("page_id"),
        F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"),
        F.concat_ws(
            ".",
            (F.pmod(eid, F.lit(3)) + 5).cast("string"),
            F.pmod(F.expr("event_id div 3"), F.lit(10)).cast("string"),
            F.pmod(F.expr("event_id div 30"), F.lit(10)).cast("string"),
        ).alias("app_version"),
        F.to_date("ts").alias("date"),
    )


INTERACTIONS_SQL = """(SELECT event_id, user_id, ts AS "timestamp", event_type AS action_type,
    json_extract_string(props, '$.k') AS page_id,
    CAST(round(value * 1000) AS BIGINT) AS duration_ms,
    CAST(event_id % 3 + 5 AS VARCHAR) || '.' || CAST((event_id // 3) % 10 AS VARCHAR) || '.' ||
      CAST((event_id // 30) % 10 AS VARCHAR) AS app_version,
    CAST(ts AS DATE) AS "date"
  FROM events)"""


def user_metadata(
    spark: SparkSession, sf_dir: str, cols: Sequence[str] = ("join_date", "country", "device_type", "subscription_type")
) -> DataFrame:
    """``customer`` in the metadata shape: every customer is a user.

    user_id = c_custkey, join_date = day of first order (null without one),
    country = n_name, device_type is not in the data (null),
    subscription_type = c_mktsegment.  Only the tables that ``cols`` need are
    read and joined.
    """
    df = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_nationkey", F.col("c_mktsegment").alias("subscription_type")
    )
    if "join_date" in cols:
        first = (
            load(spark, sf_dir, "orders")
            .groupBy(F.col("o_custkey").alias("user_id"))
            .agg(F.to_date(F.min("o_orderdate")).alias("join_date"))
        )
        df = df.join(first, "user_id", "left")
    if "country" in cols:
        nation = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
        df = df.join(nation, df["c_nationkey"] == nation["n_nationkey"], "left")
    if "device_type" in cols:
        df = df.withColumn("device_type", F.lit(None).cast("string"))
    return df.select("user_id", *cols)


METADATA_SQL = """(SELECT c.c_custkey AS user_id, f.join_date, n.n_name AS country,
    CAST(NULL AS VARCHAR) AS device_type, c.c_mktsegment AS subscription_type
  FROM customer c
  LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS join_date FROM orders GROUP BY o_custkey) f
    ON c.c_custkey = f.o_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""
