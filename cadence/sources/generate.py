"""Distributed synthetic data in the product-analytics shape.

Rows are produced from a column of ids (``spark.range(n)`` or ids taken from
an existing table) by integer arithmetic on the id, so generation runs in
parallel on the executors, is reproducible for a given seed, and nothing is
built on the driver.  Every value is a pure function of (id, seed), so the
same rows can be recomputed by any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.hashing import uniform_int
from cadence.sources.schemas import ACTION_TYPES, COUNTRIES, DEVICE_TYPES, SUBSCRIPTION_TYPES

# The generated ranges.
MAX_USER = 1_000_000
MAX_PAGE = 1_000_000
EVENT_START = "2024-01-01 00:00:00"
EVENT_SPAN_SECONDS = 365 * 86400  # 2024-01-01 .. 2024-12-31 00:00:00
JOIN_START = "2021-01-01"
JOIN_SPAN_DAYS = 1460  # 2021-01-01 .. 2024-12-31
DURATION_RANGE = (100, 300_000)
VERSION_MAJOR = (5, 7)


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _ids(spark: SparkSession, n: int | None, ids: DataFrame | None, id_col: str) -> DataFrame:
    if ids is not None:
        return ids.select(F.col(id_col).cast("bigint").alias("id"))
    return spark.range(n)


def generate_interactions(
    spark: SparkSession,
    n: int | None = None,
    seed: int = 0,
    ids: DataFrame | None = None,
    id_col: str = "id",
    hot_user_share: float = 0.0,
) -> DataFrame:
    """``n`` rows (or one per id of ``ids``) in the interactions schema + ``id``.

    ``hot_user_share`` gives that fraction of the rows to one user
    (``u000000``), the "certain user_ids are much more frequent" case the
    skew handling is built for.
    """
    i = F.col("id")
    u = lambda s, lo, hi: uniform_int(i, s, lo, hi, seed)
    start = F.lit(EVENT_START).cast("timestamp_ntz")
    user = F.format_string("u%06d", u(1, 1, MAX_USER))
    if hot_user_share > 0:
        user = F.when(u(9, 0, 999_999) < int(hot_user_share * 1_000_000), F.lit("u000000")).otherwise(user)
    return _ids(spark, n, ids, id_col).select(
        "id",
        user.alias("user_id"),
        (start + F.make_dt_interval(secs=u(2, 0, EVENT_SPAN_SECONDS))).alias("timestamp"),
        _pick(ACTION_TYPES, u(3, 0, len(ACTION_TYPES) - 1)).alias("action_type"),
        F.format_string("p%06d", u(4, 1, MAX_PAGE)).alias("page_id"),
        u(5, *DURATION_RANGE).alias("duration_ms"),
        F.concat_ws(".", u(6, *VERSION_MAJOR).cast("string"), u(7, 0, 9).cast("string"), u(8, 0, 9).cast("string")).alias(
            "app_version"
        ),
    ).withColumn("date", F.to_date("timestamp"))


def generate_metadata(
    spark: SparkSession, n: int | None = None, seed: int = 0, ids: DataFrame | None = None, id_col: str = "id"
) -> DataFrame:
    """``n`` rows (or one per id) in the metadata schema + ``id``.  user_id is
    drawn with replacement, so ids repeat, as in the reference data."""
    i = F.col("id")
    u = lambda s, lo, hi: uniform_int(i, s, lo, hi, seed)
    return _ids(spark, n, ids, id_col).select(
        "id",
        F.format_string("u%06d", u(11, 1, MAX_USER)).alias("user_id"),
        F.date_add(F.lit(JOIN_START).cast("date"), u(12, 0, JOIN_SPAN_DAYS).cast("int")).alias("join_date"),
        _pick(COUNTRIES, u(13, 0, len(COUNTRIES) - 1)).alias("country"),
        _pick(DEVICE_TYPES, u(14, 0, len(DEVICE_TYPES) - 1)).alias("device_type"),
        _pick(SUBSCRIPTION_TYPES, u(15, 0, len(SUBSCRIPTION_TYPES) - 1)).alias("subscription_type"),
    )
