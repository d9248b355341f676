"""

Only wiring lives here: each query binds an operator from ``cadence`` to the
driver's tables (``events`` as user interactions, ``customer`` + ``nation`` +
first ``orders`` as user metadata, ``orders`` as a multi-year activity log)
and each oracle is the same computation written as DuckDB SQL over the raw
tables.  Every query reads whole tables.
"""

from __future__ import annotations

import importlib
import importlib.util
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadence.operators import (  # noqa: E402
    activity,
    freshness,
    insights,
    joins,
    lookup,
    partitioning,
    primitives,
    quality,
    semijoin,
    sessions,
    skew,
    streaks,
    user_bitmaps,
    verify,
)
from cadence.operators.group_quantiles import group_percentiles  # noqa: E402
from cadence.operators.quantiles import exact_percentiles  # noqa: E402
from cadence.session import scratch_path  # noqa: E402
from cadence.sources import generate, ingest  # noqa: E402
from cadence.streaming.sessions import replay_sessions  # noqa: E402
from cadence.sources.tables import INTERACTIONS_SQL, METADATA_SQL, interactions, load, user_metadata  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"

# Parameters of the registered queries (shared by Spark and SQL sides).
YEAR_START, YEAR_END = "2024-01-01", "2025-01-01"
BATCH_CUTS = ("2024-01-08", "2024-01-15", "2024-01-23")  # first days of the later batches
CHECK_RANGES = 64
STREAK_START, STREAK_END = "2024-01-01", "2024-01-31"  # the days that the given events cover
ORDERS_YEAR_START, ORDERS_YEAR_END, ORDERS_N_MONTHS = "1996-01-01", "1997-01-01", 4
ACTIVE_ACTIONS = ("click", "view", "purchase", "signup")
# The timeline of a few named users is the feature itself (the reference's
# spot check of three users); the scan still covers the whole table, with the
# id filter pushed into Parquet.  Top-k reports keep k rows by design.
TIMELINE_USERS = (7, 42, 99)
TOP_K = 20
# Thresholds that the given tables reach, so the salted and aside paths run.
SALT_ROWS, LAYOUT_HOT_ROWS = 4, 12
KNOWN_ACTIONS = ("click", "error", "purchase", "signup", "view")
DURATION_DOMAIN = (100, 300_000)  # the reference's duration_ms range
AS_OF = "2024-02-01"
IMPUTE_DEFAULT = 0
PERCENTILES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)

I = INTERACTIONS_SQL
M = METADATA_SQL


def _sec(x: str) -> str:
    """Whole epoch seconds in DuckDB (what Spark's unix_timestamp gives)."""
    return f"(epoch_us({x}) // 1000000)"


def _orders_activity(spark, d):
    return load(spark, d, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("timestamp"), "o_orderkey"
    )


# ---------------------------------------------------------------- activity
def q_dau_series(spark, d):
    return activity.dau_series(interactions(spark, d), date_col="date")


def q_dau_series_active(spark, d):
    return activity.dau_series(interactions(spark, d), date_col="date", actions=ACTIVE_ACTIONS)


def q_mau_series_active(spark, d):
    return activity.mau_series(interactions(spark, d), actions=ACTIVE_ACTIONS)


def q_streak_days_active(spark, d):
    return activity.streak_days(interactions(spark, d), start=YEAR_START, end=YEAR_END, date_col="date", actions=ACTIVE_ACTIONS)


def q_mau_series(spark, d):
    return activity.mau_series(_orders_activity(spark, d))


def q_mau_series_events(spark, d):
    return activity.mau_series(interactions(spark, d))


def q_active_users_by_grain(spark, d):
    return activity.active_users(interactions(spark, d), grain="hour", actions=ACTIVE_ACTIONS)


def q_users_active_in_n_months(spark, d):
    return activity.users_active_in_n_periods(
        _orders_activity(spark, d), n=ORDERS_N_MONTHS, start=ORDERS_YEAR_START, end=ORDERS_YEAR_END
    )


def q_users_active_in_n_months_window(spark, d):
    return activity.users_active_in_n_periods(
        _orders_activity(spark, d), n=ORDERS_N_MONTHS, start=ORDERS_YEAR_START, end=ORDERS_YEAR_END, method="window"
    )


def q_streak_days(spark, d):
    return activity.streak_days(interactions(spark, d), start=YEAR_START, end=YEAR_END, date_col="date")


def q_longest_streaks(spark, d):
    return streaks.longest_streaks(interactions(spark, d), start=YEAR_START, end=YEAR_END, date_col="date")


def q_full_streak_users(spark, d):
    return streaks.users_with_streak(interactions(spark, d), start=STREAK_START, end=STREAK_END, date_col="date")


def q_trailing_active_users(spark, d):
    """28-day active users from stored daily bitmaps."""
    path = scratch_path(spark, "bitmaps")
    user_bitmaps.add_days(interactions(spark, d), path)
    return user_bitmaps.trailing_actives(user_bitmaps.read_days(spark, path))


def q_user_lookup(spark, d):
    path = scratch_path(spark, "lookup")
    lookup.write_lookup_store(interactions(spark, d), path)
    return lookup.lookup(spark, path, TIMELINE_USERS).orderBy("user_id", "timestamp", "event_id")


def q_daily_user_rollup(spark, d):
    return activity.daily_user_rollup(interactions(spark, d))


def q_user_timeline(spark, d):
    return activity.user_timeline(interactions(spark, d), TIMELINE_USERS, order_by=("timestamp", "event_id"))


# ---------------------------------------------------------------- sessions
def q_sessionize(spark, d):
    return sessions.sessionize(interactions(spark, d), tiebreak=("event_id",))


def q_sessionize_6h(spark, d):
    return sessions.sessionize(interactions(spark, d), gap_seconds=6 * 3600, tiebreak=("event_id",))


def q_sessionize_split(spark, d):
    """The same with ten-minute chunks: most users cross chunk borders."""
    return sessions.sessionize(interactions(spark, d), gap_seconds=6 * 3600, tiebreak=("event_id",), chunk_seconds=600)


def q_sessionize_incremental(spark, d):
    """The same events in four batches, each read once."""
    ev = interactions(spark, d)
    day = F.col("date")
    cuts = [F.lit(c).cast("date") for c in BATCH_CUTS]
    parts = [day.isNull() | (day < cuts[0]), *[(day >= a) & (day < b) for a, b in zip(cuts, cuts[1:])], day >= cuts[-1]]
    return replay_sessions([ev.where(p) for p in parts], gap_seconds=6 * 3600, tiebreak=("event_id",))


def q_session_metrics(spark, d):
    return sessions.session_metrics(interactions(spark, d), tiebreak=("event_id",))


def q_longest_sessions(spark, d):
    return sessions.longest_sessions(interactions(spark, d), k=TOP_K, gap_seconds=6 * 3600, tiebreak=("event_id",))


def q_avg_session_duration(spark, d):
    return sessions.session_averages(interactions(spark, d), tiebreak=("event_id",)).select(
        "sessions", "avg_session_duration_minutes"
    )


def q_avg_actions_per_session(spark, d):
    return sessions.session_averages(interactions(spark, d), tiebreak=("event_id",)).select(
        "sessions", "avg_actions_per_session"
    )


def q_session_actions(spark, d):
    return sessions.session_actions(interactions(spark, d), gap_seconds=6 * 3600, tiebreak=("event_id",))


# ---------------------------------------------------------------- joins
SUBSCRIPTION = ("subscription_type",)


def _enrich(strategy, **kw):
    def q(spark, d):
        return joins.enrich(interactions(spark, d), user_metadata(spark, d, SUBSCRIPTION), strategy=strategy, **kw)

    return q


def q_enrich_partial_dimension(spark, d):
    """A dimension that lacks users (those of one market segment only): the
    unmatched side of the left join."""
    users = user_metadata(spark, d, SUBSCRIPTION).where("subscription_type = 'BUILDING'")
    return joins.enrich(interactions(spark, d), users)


def _reduced(how):
    """The same dimension by a join that only possible partners are shuffled for."""

    def q(spark, d):
        users = user_metadata(spark, d, SUBSCRIPTION).where("subscription_type = 'BUILDING'")
        return semijoin.reduced_join(interactions(spark, d), users, how=how)

    return q


def q_activity_by_dims(spark, d):
    return joins.activity_by(interactions(spark, d), user_metadata(spark, d, ("country", *SUBSCRIPTION)), strategy="merge")


def q_activity_by_dims_broadcast(spark, d):
    users = user_metadata(spark, d, ("country", *SUBSCRIPTION))
    return joins.activity_by(interactions(spark, d), users, strategy="broadcast", cluster_by="country")


def q_count_salted(spark, d):
    return partitioning.balanced_count_distinct(load(spark, d, "orders"), "o_custkey", "o_orderkey")


def q_enrich_balanced(spark, d):
    return partitioning.balanced_join(interactions(spark, d), user_metadata(spark, d, SUBSCRIPTION))


def q_prepartitioned_join(spark, d):
    laid = joins.prepare_layout(interactions(spark, d), "user_id", partition_by=("date",), hot_min_rows=LAYOUT_HOT_ROWS)
    return joins.layout_join(laid, user_metadata(spark, d, SUBSCRIPTION), salt_rows=SALT_ROWS)


def q_bucketed_join(spark, d):
    return joins.bucketed_join(interactions(spark, d), user_metadata(spark, d, SUBSCRIPTION))


# ---------------------------------------------------------------- skew
def q_partition_profile(spark, d):
    return skew.partition_profile(interactions(spark, d))


def q_partition_totals(spark, d):
    """What the profiles of both tables add up to (the ids are physical)."""
    users = user_metadata(spark, d, SUBSCRIPTION)
    return skew.partition_totals(interactions(spark, d), "interactions").unionByName(skew.partition_totals(users, "metadata"))


def q_partition_profile_metadata(spark, d):
    return skew.partition_profile(user_metadata(spark, d, SUBSCRIPTION))


def q_key_skew_summary(spark, d):
    return skew.key_skew_summary(interactions(spark, d), "user_id")


def q_key_frequency(spark, d):
    return skew.key_frequency(load(spark, d, "orders"), "o_custkey", top=TOP_K)


# ---------------------------------------------------------------- insights
def q_retention(spark, d):
    return insights.retention(_orders_activity(spark, d))


def q_popular_actions(spark, d):
    return insights.popular_actions(interactions(spark, d))


def q_subscription_insights(spark, d):
    return insights.subscription_insights(interactions(spark, d), user_metadata(spark, d, SUBSCRIPTION))


def q_activity_by_hour(spark, d):
    return insights.activity_by_hour(interactions(spark, d))


def q_version_usage(spark, d):
    return insights.version_usage(interactions(spark, d))


# ---------------------------------------------------------------- outliers / quality
def q_duration_percentiles(spark, d):
    return exact_percentiles(interactions(spark, d), "duration_ms", PERCENTILES).select("p", "value")


def q_duration_percentiles_by_version(spark, d):
    out = group_percentiles(interactions(spark, d), "app_version", "duration_ms", (0.25, 0.5, 0.9))
    return out.select("app_version", "p", "value")


def q_duration_capped(spark, d):
    return quality.capped(interactions(spark, d).select("event_id", "duration_ms"), "duration_ms", 0.01, 0.99)


def q_duration_trimmed(spark, d):
    return quality.capped(interactions(spark, d).select("event_id", "duration_ms"), "duration_ms", 0.01, 0.99, mode="filter")


def q_duration_outliers(spark, d):
    return quality.iqr_outliers(interactions(spark, d).select("event_id", "user_id", "duration_ms"), "duration_ms")


def _rules():
    c = F.col
    return {
        "user_id_present": c("user_id").isNotNull(),
        "action_type_known": c("action_type").isin(list(KNOWN_ACTIONS)),
        "duration_in_range": c("duration_ms").between(*DURATION_DOMAIN),
        "page_id_numeric": c("page_id").rlike("^[0-9]+$"),
        "app_version_format": c("app_version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"),
        "date_matches_timestamp": c("date") == F.to_date("timestamp"),
    }


_RULES_SQL = {
    "user_id_present": "user_id IS NOT NULL",
    "action_type_known": f"action_type IN {KNOWN_ACTIONS!r}",
    "duration_in_range": f"duration_ms BETWEEN {DURATION_DOMAIN[0]} AND {DURATION_DOMAIN[1]}",
    "page_id_numeric": "regexp_matches(page_id, '^[0-9]+$')",
    "app_version_format": "regexp_matches(app_version, '^[0-9]+\\.[0-9]+\\.[0-9]+$')",
    "date_matches_timestamp": "\"date\" = CAST(\"timestamp\" AS DATE)",
}


def q_dq_completeness(spark, d):
    return quality.completeness(interactions(spark, d))


def q_dq_validity(spark, d):
    return quality.validity(interactions(spark, d), _rules())


def q_dq_uniqueness(spark, d):
    inter = quality.uniqueness(interactions(spark, d), ["user_id", "timestamp", "action_type"], "interactions(user_id,timestamp,action_type)")
    docs = quality.uniqueness(load(spark, d, "documents"), [F.sha2("text", 256)], "documents(text)")
    return inter.unionByName(docs)


def q_dq_consistency(spark, d):
    inter = interactions(spark, d)
    cust, orders = load(spark, d, "customer"), load(spark, d, "orders")
    return (
        quality.rule_check(inter, F.col("date") == F.to_date("timestamp"), "interactions.date = to_date(timestamp)")
        .unionByName(quality.orphans(inter, "user_id", cust, "c_custkey", "interactions.user_id in customer"))
        .unionByName(quality.orphans(orders, "o_custkey", cust, "c_custkey", "orders.o_custkey in customer"))
        .unionByName(quality.orphans(load(spark, d, "lineitem"), "l_orderkey", orders, "o_orderkey", "lineitem.l_orderkey in orders"))
    )


def q_dq_timeliness(spark, d):
    return (
        quality.timeliness(load(spark, d, "events"), "ts", AS_OF, "events")
        .unionByName(quality.timeliness(load(spark, d, "orders"), "o_orderdate", AS_OF, "orders"))
        .unionByName(quality.timeliness(load(spark, d, "lineitem"), "l_shipdate", AS_OF, "lineitem"))
    )


def q_dq_missing_hours(spark, d):
    return freshness.missing_intervals(interactions(spark, d), "timestamp", STREAK_START, STREAK_END, label="action_type", expected=KNOWN_ACTIONS)


def q_dq_arrival_lag(spark, d):
    """Shipping as the arrival of an order's lines, by day of the order."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return freshness.arrival_lag(
        lines.join(orders, "l_orderkey"), "o_orderdate", "l_shipdate", "l_returnflag", allowed_seconds=60 * 86_400, step_seconds=86_400
    )


def q_dq_accuracy(spark, d):
    li = load(spark, d, "lineitem")
    truth = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))).alias("price_from_lines")
    )
    orders = quality.accuracy(load(spark, d, "orders"), truth, "o_orderkey", "o_totalprice", "price_from_lines", "orders.o_totalprice")
    return orders.unionByName(
        quality.value_accuracy(load(spark, d, "documents"), "n_chars", F.length("text"), "documents.n_chars")
    )


def q_quarantine(spark, d):
    return quality.quarantine(interactions(spark, d), _rules(), scratch_path(spark, "quarantine"))


def q_impute(spark, d):
    out = quality.impute_by_group(
        interactions(spark, d), "duration_ms", "action_type", valid=F.col("duration_ms").between(*DURATION_DOMAIN)
    )
    return out.select("event_id", "action_type", "duration_ms", "imputed")


def _impute_group(how):
    def q(spark, d):
        rows = interactions(spark, d).select("event_id", "app_version", "duration_ms")
        return quality.impute_by_group(rows, "duration_ms", "app_version", F.col("duration_ms").between(*DURATION_DOMAIN), how=how)

    return q


def _impute(how, **kw):
    def q(spark, d):
        rows = interactions(spark, d).select("event_id", "duration_ms")
        return quality.impute(rows, "duration_ms", how, valid=F.col("duration_ms").between(*DURATION_DOMAIN), **kw)

    return q


def q_deduplicate(spark, d):
    """The latest event per user and action."""
    rows = interactions(spark, d).select("user_id", "action_type", "timestamp", "event_id", "page_id")
    return quality.deduplicate(rows, ["user_id", "action_type"], ["timestamp", "event_id"], descending=True)


def q_ingest_corrupt_rows(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", "lang")
    path = scratch_path(spark, "docs-csv")
    docs.write.mode("overwrite").option("header", True).csv(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    return ingest.ingest_report(ingest.read_csv_capturing_errors(spark, path, schema, multiline=False), "doc_id")


# ---------------------------------------------------------------- generator / formats
def q_generate_interactions(spark, d):
    return generate.generate_interactions(spark, ids=load(spark, d, "events"), id_col="event_id")


def q_generate_metadata(spark, d):
    return generate.generate_metadata(spark, ids=load(spark, d, "customer"), id_col="c_custkey")


def q_convert_round_trip(spark, d):
    inter = interactions(spark, d)
    return ingest.csv_parquet_round_trip(inter, inter.schema, ["date"]).select(*inter.columns)


def q_convert_multiline(spark, d):
    """Texts with line breaks through CSV: read split by split, not file by file."""
    docs = load(spark, d, "documents")
    return ingest.csv_parquet_round_trip(docs, docs.schema, ["lang"], multiline="parallel").select(*docs.columns)


def q_verify_round_trip(spark, d):
    """CSV to Parquet, and the checksums of the result against the source."""
    inter = interactions(spark, d)
    stored = ingest.csv_parquet_round_trip(inter, inter.schema, ["date"]).select(*inter.columns)
    low, high = verify.key_bounds(inter, stored, "event_id")
    return verify.range_checksums(inter, stored, "event_id", low, high, CHECK_RANGES)


# ---------------------------------------------------------------- primitives
def q_sum_numeric(spark, d):
    out = primitives.sum_numeric(load(spark, d, "lineitem"), "l_returnflag")
    # double sums depend on summation order (partitioning): compare at 4 places
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def q_running_count(spark, d):
    return primitives.running_count(interactions(spark, d), tiebreak=("event_id",)).select(
        "event_id", "event_number", "seconds_since_previous"
    )


def q_running_count_split(spark, d):
    return primitives.running_count(interactions(spark, d), tiebreak=("event_id",), chunk_seconds=600).select(
        "event_id", "event_number", "seconds_since_previous"
    )


def q_duration_band(spark, d):
    return primitives.duration_band(interactions(spark, d)).groupBy("duration_band").agg(F.count(F.lit(1)).alias("events"))


def q_top_users(spark, d):
    per_user = interactions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return primitives.top_k(per_user, "events", TOP_K, ["user_id"])


def q_time_features(spark, d):
    return primitives.time_features(interactions(spark, d))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dau_series": q_dau_series,
    "dau_series_active": q_dau_series_active,
    "mau_series": q_mau_series,
    "mau_series_active": q_mau_series_active,
    "streak_days_active": q_streak_days_active,
    "mau_series_events": q_mau_series_events,
    "active_users_by_grain": q_active_users_by_grain,
    "users_active_in_n_months": q_users_active_in_n_months,
    "users_active_in_n_months_window": q_users_active_in_n_months_window,
    "streak_days": q_streak_days,
    "longest_streaks": q_longest_streaks,
    "full_streak_users": q_full_streak_users,
    "daily_user_rollup": q_daily_user_rollup,
    "user_timeline": q_user_timeline,
    "sessionize": q_sessionize,
    "sessionize_6h": q_sessionize_6h,
    "sessionize_split": q_sessionize_split,
    "session_metrics": q_session_metrics,
    "longest_sessions": q_longest_sessions,
    "avg_session_duration": q_avg_session_duration,
    "avg_actions_per_session": q_avg_actions_per_session,
    "session_actions": q_session_actions,
    "enrich_sort_merge": _enrich("merge"),
    "enrich_broadcast": _enrich("broadcast"),
    "enrich_shuffle_hash": _enrich("shuffle_hash"),
    "enrich_salted": _enrich("salted", salt_rows=SALT_ROWS),
    "enrich_auto": _enrich("auto"),
    "enrich_partial_dimension": q_enrich_partial_dimension,
    "activity_by_dims": q_activity_by_dims,
    "activity_by_dims_broadcast": q_activity_by_dims_broadcast,
    "count_salted": q_count_salted,
    "bucketed_join": q_bucketed_join,
    "prepartitioned_join": q_prepartitioned_join,
    "partition_profile": q_partition_profile,
    "partition_profile_metadata": q_partition_profile_metadata,
    "partition_totals": q_partition_totals,
    "key_frequency": q_key_frequency,
    "key_skew_summary": q_key_skew_summary,
    "retention": q_retention,
    "popular_actions": q_popular_actions,
    "subscription_insights": q_subscription_insights,
    "activity_by_hour": q_activity_by_hour,
    "version_usage": q_version_usage,
    "duration_percentiles": q_duration_percentiles,
    "duration_capped": q_duration_capped,
    "duration_trimmed": q_duration_trimmed,
    "duration_outliers": q_duration_outliers,
    "dq_completeness": q_dq_completeness,
    "dq_validity": q_dq_validity,
    "dq_uniqueness": q_dq_uniqueness,
    "dq_consistency": q_dq_consistency,
    "dq_timeliness": q_dq_timeliness,
    "dq_accuracy": q_dq_accuracy,
    "quarantine": q_quarantine,
    "impute": q_impute,
    "impute_default": _impute("default", value=IMPUTE_DEFAULT),
    "impute_median": _impute("median"),
    "impute_mode": _impute("mode"),
    "deduplicate": q_deduplicate,
    "ingest_corrupt_rows": q_ingest_corrupt_rows,
    "generate_interactions": q_generate_interactions,
    "generate_metadata": q_generate_metadata,
    "convert_round_trip": q_convert_round_trip,
    "sum_numeric": q_sum_numeric,
    "running_count": q_running_count,
    "running_count_split": q_running_count_split,
    "duration_band": q_duration_band,
    "top_users": q_top_users,
    "time_features": q_time_features,
    "enrich_balanced": q_enrich_balanced,
    "duration_percentiles_by_version": q_duration_percentiles_by_version,
    "impute_group_median": _impute_group("median"),
    "impute_group_mode": _impute_group("mode"),
    "convert_multiline": q_convert_multiline,
    "sessionize_incremental": q_sessionize_incremental,
    "trailing_active_users": q_trailing_active_users,
    "user_lookup": q_user_lookup,
    "dq_missing_hours": q_dq_missing_hours,
    "dq_arrival_lag": q_dq_arrival_lag,
    "verify_round_trip": q_verify_round_trip,
    "enrich_reduced": _reduced("left_outer"),
    "join_reduced": _reduced("inner"),
}

# ---------------------------------------------------------------- oracle SQL
# The generator's rule as SQL.
def _sql_uniform(stream: int, lo: int, hi: int, seed: int = 0, idx: str = "id") -> str:
    m = 2147483647
    x = f"(({idx} * 7919 + {stream * 1000003 + seed * 15485863}) % {m})"
    x = f"(({x} % {m}) + 1)"
    for _ in range(3):
        x = f"(({x} * 48271) % {m})"
        x = f"xor({x}, {x} >> 11)"
    return f"({x} % {hi - lo + 1} + {lo})"


def _sql_pick(values: list[str], idx: str) -> str:
    arr = "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return f"{arr}[{idx} + 1]"


def _interactions_sql(source: str, seed: int = 0) -> str:
    u = lambda s, lo, hi: _sql_uniform(s, lo, hi, seed)
    ts = f"(TIMESTAMP '{generate.EVENT_START}' + to_seconds({u(2, 0, generate.EVENT_SPAN_SECONDS)}))"
    return f"""SELECT id, printf('u%06d', {u(1, 1, generate.MAX_USER)}) AS user_id, {ts} AS "timestamp",
      {_sql_pick(generate.ACTION_TYPES, u(3, 0, len(generate.ACTION_TYPES) - 1))} AS action_type,
      printf('p%06d', {u(4, 1, generate.MAX_PAGE)}) AS page_id, {u(5, *generate.DURATION_RANGE)} AS duration_ms,
      CAST({u(6, *generate.VERSION_MAJOR)} AS VARCHAR) || '.' || CAST({u(7, 0, 9)} AS VARCHAR) || '.' || CAST({u(8, 0, 9)} AS VARCHAR) AS app_version,
      CAST({ts} AS DATE) AS "date"
    FROM {source}"""


def _metadata_sql(source: str, seed: int = 0) -> str:
    u = lambda s, lo, hi: _sql_uniform(s, lo, hi, seed)
    return f"""SELECT id, printf('u%06d', {u(11, 1, generate.MAX_USER)}) AS user_id,
      CAST(DATE '{generate.JOIN_START}' + CAST({u(12, 0, generate.JOIN_SPAN_DAYS)} AS INTEGER) AS DATE) AS join_date,
      {_sql_pick(generate.COUNTRIES, u(13, 0, len(generate.COUNTRIES) - 1))} AS country,
      {_sql_pick(generate.DEVICE_TYPES, u(14, 0, len(generate.DEVICE_TYPES) - 1))} AS device_type,
      {_sql_pick(generate.SUBSCRIPTION_TYPES, u(15, 0, len(generate.SUBSCRIPTION_TYPES) - 1))} AS subscription_type
    FROM {source}"""


_ORDERS_ACT = "(SELECT o_custkey AS user_id, o_orderdate AS \"timestamp\", o_orderkey FROM orders)"

_SESSION_WINDOW = 'PARTITION BY user_id ORDER BY "timestamp" ASC NULLS FIRST, event_id ASC NULLS FIRST'


def _sessionized_sql(gap: int) -> str:
    return f"""(SELECT * EXCLUDE (_seq),
        CAST(user_id AS VARCHAR) || '_' || CAST(_seq AS VARCHAR) AS session_id
      FROM (SELECT *, sum(is_new_session) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _seq
        FROM (SELECT * EXCLUDE (_p),
                CAST(CASE WHEN _p IS NOT NULL THEN {_sec('"timestamp"')} - {_sec('_p')} ELSE 0 END AS BIGINT) AS time_diff,
                CAST(CASE WHEN _p IS NOT NULL AND {_sec('"timestamp"')} - {_sec('_p')} > {gap} THEN 1 ELSE 0 END AS INTEGER) AS is_new_session
              FROM (SELECT *, lag("timestamp") OVER (w) AS _p FROM {I} WINDOW w AS ({_SESSION_WINDOW})))
        WINDOW w AS ({_SESSION_WINDOW})))"""


def _session_metrics_sql(gap: int) -> str:
    return f"""SELECT session_id,
        round(({_sec('max("timestamp")')} - {_sec('min("timestamp")')}) / 60, 2) AS session_duration_minutes,
        count(*) AS action_count
      FROM {_sessionized_sql(gap)} GROUP BY session_id"""


def _session_per_sql(gap: int) -> str:
    return f"""(SELECT session_id, {_sec('max("timestamp")')} - {_sec('min("timestamp")')} AS dur, count(*) AS n
      FROM {_sessionized_sql(gap)} GROUP BY session_id)"""


_ENRICH_SQL = f"""SELECT i.*, m.subscription_type FROM {I} i LEFT JOIN {M} m ON i.user_id = m.user_id"""

def _completeness_sql() -> str:
    cols = ["event_id", "user_id", "timestamp", "action_type", "page_id", "duration_ms", "app_version", "date"]
    parts = [
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count("{c}") AS nulls,
            round((count(*) - count("{c}")) / count(*), 6) AS null_rate FROM {I}"""
        for c in cols
    ]
    return " UNION ALL ".join(parts)


def _validity_sql() -> str:
    parts = [
        f"""SELECT '{n}' AS rule, count(*) AS rows,
            CAST(coalesce(sum(CASE WHEN {cond} THEN 0 ELSE 1 END), 0) AS BIGINT) AS violations,
            round(coalesce(sum(CASE WHEN {cond} THEN 0 ELSE 1 END), 0) / count(*), 6) AS violation_rate FROM {I}"""
        for n, cond in _RULES_SQL.items()
    ]
    return " UNION ALL ".join(parts)


def _reasons_sql() -> str:
    parts = ", ".join(f"CASE WHEN NOT coalesce({cond}, false) THEN '{n}' END" for n, cond in _RULES_SQL.items())
    return f"nullif(concat_ws(';', {parts}), '')"


def _uniq_sql(label: str, source: str, key: str) -> str:
    return f"""SELECT '{label}' AS "check", CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys,
        count(*) FILTER (WHERE n > 1) AS duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
      FROM (SELECT {key}, count(*) AS n FROM {source} GROUP BY {key})"""


def _orphan_sql(label: str, fact: str, fk: str, dim: str, dk: str) -> str:
    return f"""SELECT '{label}' AS "check", CAST(count(*) AS BIGINT) AS rows,
        CAST(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.{dk} = f.{fk})) AS BIGINT) AS violations
      FROM {fact} f"""


def _timeliness_sql(label: str, table: str, col: str) -> str:
    lag = f"(date_diff('microsecond', max({col}), TIMESTAMP '{AS_OF}') / 3.6e9)"
    return f"""SELECT '{label}' AS "table", max({col}) AS latest, round({lag}, 6) AS lag_hours, {lag} > 24.0 AS is_stale FROM {table}"""


def _accuracy_sql(label: str, src: str, key: str, value: str, truth: str) -> str:
    off = f"abs(s.{value} - t._t) > 1e-6 * greatest(abs(s.{value}), abs(t._t), 1.0)"
    return f"""SELECT '{label}' AS "check", count(*) AS rows, count(*) FILTER (WHERE t._t IS NULL) AS missing,
        count(*) FILTER (WHERE {off}) AS mismatches, round(count(*) FILTER (WHERE {off}) / count(*), 6) AS mismatch_rate
      FROM {src} s LEFT JOIN {truth} t ON s.{key} = t.{key}"""


_PCT_SQL = ", ".join(f"quantile_cont(duration_ms, {p}) AS q{i}" for i, p in enumerate(PERCENTILES))


def _impute_sql(fill: str, counted: bool = False) -> str:
    valid = f"duration_ms BETWEEN {DURATION_DOMAIN[0]} AND {DURATION_DOMAIN[1]}"
    source = f"(SELECT duration_ms, count(*) AS n FROM {I} GROUP BY 1)" if counted else I
    return f"""SELECT event_id, CASE WHEN {valid} THEN duration_ms
        ELSE CAST((SELECT {fill} FROM {source} WHERE {valid}) AS BIGINT) END AS duration_ms,
        NOT coalesce({valid}, false) AS imputed FROM {I}"""


def _impute_group_sql(fill: str, counted: bool = False) -> str:
    valid = f"duration_ms BETWEEN {DURATION_DOMAIN[0]} AND {DURATION_DOMAIN[1]}"
    source = f"(SELECT app_version, duration_ms, count(*) AS n FROM {I} GROUP BY 1, 2)" if counted else I
    return f"""WITH m AS (SELECT app_version, {fill} AS fill FROM {source} WHERE {valid} GROUP BY 1)
      SELECT i.event_id, i.app_version, CASE WHEN {valid} THEN i.duration_ms ELSE CAST(m.fill AS BIGINT) END AS duration_ms,
        NOT coalesce({valid}, false) AS imputed FROM {I} i LEFT JOIN m ON i.app_version = m.app_version"""


def _streaks_sql(start: str, end: str) -> str:
    """Gaps and islands: one row per user with the longest run of days."""
    return f"""WITH d AS (SELECT DISTINCT user_id, "date" AS day FROM {I}
          WHERE "date" >= DATE '{start}' AND "date" < DATE '{end}' AND user_id IS NOT NULL),
        runs AS (SELECT user_id, min(day) AS first_day, count(*) AS n FROM (SELECT user_id, day,
          day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d) GROUP BY user_id, island)
      SELECT user_id, CAST(sum(n) AS INTEGER) AS active_days, CAST(max(n) AS INTEGER) AS longest_streak,
        arg_min(first_day, {{'n': -n, 'day': first_day}}) AS streak_start,
        max(n) = date_diff('day', DATE '{start}', DATE '{end}') AS full_streak FROM runs GROUP BY user_id"""


_ORACLE: dict[str, str] = {
    "trailing_active_users": f"""WITH d AS (SELECT DISTINCT user_id, "date" AS day FROM {I} WHERE user_id IS NOT NULL AND "date" IS NOT NULL),
        days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
      SELECT days.day AS "date", count(DISTINCT d.user_id) AS trailing_active_users
      FROM days JOIN d ON d.day <= days.day AND d.day > days.day - 28 GROUP BY 1""",
    "dq_missing_hours": f"""WITH slots AS (SELECT unnest(generate_series(TIMESTAMP '{STREAK_START}', TIMESTAMP '{STREAK_END}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h),
        labels AS (SELECT unnest({list(KNOWN_ACTIONS)!r}) AS label UNION SELECT DISTINCT action_type FROM {I} WHERE action_type IS NOT NULL),
        present AS (SELECT DISTINCT action_type AS label, date_trunc('hour', "timestamp") AS h FROM {I}),
        missing AS (SELECT label, h FROM labels, slots WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.label = labels.label AND p.h = slots.h)),
        islands AS (SELECT label, h, h - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY label ORDER BY h) AS island FROM missing)
      SELECT label, min(h) AS gap_start, max(h) + INTERVAL 1 HOUR AS gap_end, count(*) AS slots FROM islands GROUP BY label, island""",
    "dq_arrival_lag": f"""SELECT l_returnflag AS label, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS slot_start, count(*) AS rows,
        min(epoch_us(l_shipdate - o_orderdate) // 1000000) AS min_lag_seconds, max(epoch_us(l_shipdate - o_orderdate) // 1000000) AS max_lag_seconds,
        count(CASE WHEN epoch_us(l_shipdate - o_orderdate) // 1000000 > {60 * 86_400} THEN 1 END) AS late_rows
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "verify_round_trip": f"""WITH b AS (SELECT min(event_id) AS lo, max(event_id) AS hi, CAST(ceil((max(event_id) - min(event_id) + 1) / {CHECK_RANGES}) AS BIGINT) AS w FROM events)
      SELECT (event_id - lo) // w AS range_no, lo + (event_id - lo) // w * w AS low_key, least(lo + (event_id - lo) // w * w + w - 1, hi) AS high_key,
        count(*) AS rows_a, count(*) AS rows_b, true AS equal FROM events, b GROUP BY 1, 2, 3""",
    "longest_streaks": _streaks_sql(YEAR_START, YEAR_END),
    "full_streak_users": f"SELECT count(*) AS users FROM ({_streaks_sql(STREAK_START, STREAK_END)}) WHERE full_streak",
    "enrich_balanced": _ENRICH_SQL,
    "duration_percentiles_by_version": " UNION ALL ".join(
        f"SELECT app_version, CAST({p} AS DOUBLE) AS p, quantile_cont(duration_ms, {p}) AS value FROM {I} WHERE duration_ms IS NOT NULL GROUP BY 1"
        for p in (0.25, 0.5, 0.9)
    ),
    "impute_group_median": _impute_group_sql("round(quantile_cont(duration_ms, 0.5))"),
    "impute_group_mode": _impute_group_sql("(list(duration_ms ORDER BY n DESC, duration_ms))[1]", counted=True),
    "convert_multiline": "SELECT * FROM documents",
    "dau_series": f"""SELECT "date", count(DISTINCT user_id) AS daily_active_users FROM {I} GROUP BY "date" """,
    "dau_series_active": f"""SELECT "date", count(DISTINCT user_id) AS daily_active_users FROM {I}
        WHERE action_type IN {ACTIVE_ACTIONS!r} GROUP BY "date" """,
    "mau_series_active": f"""SELECT CAST(date_trunc('month', "timestamp") AS DATE) AS month,
        count(DISTINCT user_id) AS monthly_active_users FROM {I} WHERE action_type IN {ACTIVE_ACTIONS!r} GROUP BY 1""",
    "mau_series": f"""SELECT CAST(date_trunc('month', "timestamp") AS DATE) AS month,
        count(DISTINCT user_id) AS monthly_active_users FROM {_ORDERS_ACT} GROUP BY 1""",
    "mau_series_events": f"""SELECT CAST(date_trunc('month', "timestamp") AS DATE) AS month,
        count(DISTINCT user_id) AS monthly_active_users FROM {I} GROUP BY 1""",
    "active_users_by_grain": f"""SELECT date_trunc('hour', "timestamp") AS period, count(DISTINCT user_id) AS active_users
        FROM {I} WHERE action_type IN {ACTIVE_ACTIONS!r} GROUP BY 1""",
    "users_active_in_n_months": f"""SELECT count(user_id) AS monthly_active_users FROM (
        SELECT user_id FROM (SELECT DISTINCT user_id, date_trunc('month', "timestamp") AS m FROM {_ORDERS_ACT}
          WHERE "timestamp" >= TIMESTAMP '{ORDERS_YEAR_START}' AND "timestamp" < TIMESTAMP '{ORDERS_YEAR_END}')
        GROUP BY user_id HAVING count(*) >= {ORDERS_N_MONTHS})""",
    "users_active_in_n_months_window": f"""SELECT count(user_id) AS monthly_active_users FROM (
        SELECT user_id FROM (SELECT DISTINCT user_id, date_trunc('month', "timestamp") AS m FROM {_ORDERS_ACT}
          WHERE "timestamp" >= TIMESTAMP '{ORDERS_YEAR_START}' AND "timestamp" < TIMESTAMP '{ORDERS_YEAR_END}')
        GROUP BY user_id HAVING count(*) >= {ORDERS_N_MONTHS})""",
    "streak_days": f"""SELECT CAST(sum(days_diff) AS BIGINT) AS daily_active_users FROM (
        SELECT CAST(coalesce(d - lag(d) OVER (PARTITION BY user_id ORDER BY d), 1) AS INTEGER) AS days_diff
        FROM (SELECT DISTINCT user_id, "date" AS d FROM {I}
              WHERE "date" >= DATE '{YEAR_START}' AND "date" < DATE '{YEAR_END}'))
        WHERE days_diff = 1 GROUP BY days_diff""",
    "streak_days_active": f"""SELECT CAST(sum(days_diff) AS BIGINT) AS daily_active_users FROM (
        SELECT CAST(coalesce(d - lag(d) OVER (PARTITION BY user_id ORDER BY d), 1) AS INTEGER) AS days_diff
        FROM (SELECT DISTINCT user_id, "date" AS d FROM {I}
              WHERE "date" >= DATE '{YEAR_START}' AND "date" < DATE '{YEAR_END}'
                AND action_type IN {ACTIVE_ACTIONS!r}))
        WHERE days_diff = 1 GROUP BY days_diff""",
    "daily_user_rollup": f"""SELECT user_id, "date", count(*) AS events, min("timestamp") AS first_ts,
        max("timestamp") AS last_ts, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM {I} GROUP BY user_id, "date" """,
    "user_timeline": f"""SELECT * FROM {I} WHERE user_id IN {TIMELINE_USERS!r} ORDER BY user_id, "timestamp", event_id""",
    "sessionize": f"SELECT * FROM {_sessionized_sql(1800)}",
    "sessionize_6h": f"SELECT * FROM {_sessionized_sql(6 * 3600)}",
    "sessionize_split": f"SELECT * FROM {_sessionized_sql(6 * 3600)}",
    "session_metrics": _session_metrics_sql(1800) + " ORDER BY session_duration_minutes DESC, session_id",
    "longest_sessions": _session_metrics_sql(6 * 3600) + f" ORDER BY session_duration_minutes DESC, session_id LIMIT {TOP_K}",
    "avg_session_duration": f"""SELECT count(*) AS sessions, round(avg(dur) / 60, 4) AS avg_session_duration_minutes
        FROM {_session_per_sql(1800)}""",
    "avg_actions_per_session": f"""SELECT count(*) AS sessions, round(avg(n), 4) AS avg_actions_per_session
        FROM {_session_per_sql(1800)}""",
    "session_actions": f"""SELECT session_id,
        CAST(row_number() OVER (PARTITION BY session_id ORDER BY "timestamp", event_id) AS BIGINT) AS session_step,
        "timestamp", action_type FROM {_sessionized_sql(6 * 3600)}""",
    "enrich_sort_merge": _ENRICH_SQL,
    "enrich_broadcast": _ENRICH_SQL,
    "enrich_shuffle_hash": _ENRICH_SQL,
    "enrich_salted": _ENRICH_SQL,
    "enrich_auto": _ENRICH_SQL,
    "enrich_partial_dimension": f"""SELECT i.*, m.subscription_type FROM {I} i
        LEFT JOIN {M} m ON i.user_id = m.user_id AND m.subscription_type = 'BUILDING'""",
    "partition_totals": f"""SELECT 'interactions' AS "table", count(*) AS rows FROM {I}
        UNION ALL SELECT 'metadata', count(*) FROM {M}""",
    "activity_by_dims": f"""SELECT m.country, m.subscription_type, count(*) AS count
        FROM {I} i JOIN {M} m ON i.user_id = m.user_id GROUP BY 1, 2""",
    "activity_by_dims_broadcast": f"""SELECT m.country, m.subscription_type, count(*) AS count
        FROM {I} i JOIN {M} m ON i.user_id = m.user_id GROUP BY 1, 2""",
    "count_salted": "SELECT o_custkey, count(DISTINCT o_orderkey) AS count FROM orders GROUP BY o_custkey",
    "bucketed_join": _ENRICH_SQL,
    "prepartitioned_join": _ENRICH_SQL,
    "key_frequency": f"SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey ORDER BY count DESC, o_custkey LIMIT {TOP_K}",
    "key_skew_summary": f"""WITH k AS (SELECT user_id, count(*) AS n FROM {I} GROUP BY user_id)
      SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows, max(n) AS max_key_rows,
        round(max(n) / sum(n), 6) AS max_key_share, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_key_rows,
        round(max(n) / quantile_cont(n, 0.5), 4) AS max_to_median FROM k""",
    "retention": f"""WITH um AS (SELECT DISTINCT user_id, CAST(date_trunc('month', "timestamp") AS DATE) AS m FROM {_ORDERS_ACT}
          WHERE user_id IS NOT NULL AND "timestamp" IS NOT NULL),
        c AS (SELECT user_id, m, min(m) OVER (PARTITION BY user_id) AS cohort_month FROM um),
        g AS (SELECT cohort_month, CAST((year(m) * 12 + month(m)) - (year(cohort_month) * 12 + month(cohort_month)) AS INTEGER) AS months_since,
                count(*) AS active_users FROM c GROUP BY 1, 2)
      SELECT *, max(CASE WHEN months_since = 0 THEN active_users END) OVER (PARTITION BY cohort_month) AS cohort_users,
        round(active_users / max(CASE WHEN months_since = 0 THEN active_users END) OVER (PARTITION BY cohort_month), 6) AS retention
      FROM g""",
    "popular_actions": f"""SELECT action_type, count(*) AS events, count(DISTINCT user_id) AS users FROM {I}
        GROUP BY action_type ORDER BY events DESC, action_type""",
    "subscription_insights": f"""SELECT m.subscription_type, count(*) AS events, count(DISTINCT i.user_id) AS users,
        round(sum(i.duration_ms) / count(i.duration_ms), 4) AS avg_duration_ms
      FROM {I} i JOIN {M} m ON i.user_id = m.user_id GROUP BY 1""",
    "activity_by_hour": f"""SELECT CAST(hour("timestamp") AS INTEGER) AS hour, count(*) AS events, count(DISTINCT user_id) AS users
        FROM {I} GROUP BY 1""",
    "version_usage": f"""SELECT app_version, TRY_CAST(split_part(app_version, '.', 1) AS INTEGER) AS major,
        TRY_CAST(split_part(app_version, '.', 2) AS INTEGER) AS minor, TRY_CAST(split_part(app_version, '.', 3) AS INTEGER) AS patch,
        count(*) AS events, count(DISTINCT user_id) AS users FROM {I} GROUP BY app_version""",
    "duration_percentiles": " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS p, CAST(quantile_cont(duration_ms, {p}) AS DOUBLE) AS value FROM {I}" for p in PERCENTILES
    ),
    "duration_capped": f"""SELECT event_id, duration_ms,
        least(greatest(CAST(duration_ms AS DOUBLE), (SELECT quantile_cont(duration_ms, 0.01) FROM {I})),
              (SELECT quantile_cont(duration_ms, 0.99) FROM {I})) AS duration_ms_capped FROM {I}""",
    "duration_trimmed": f"""SELECT event_id, duration_ms FROM {I}
        WHERE duration_ms BETWEEN (SELECT quantile_cont(duration_ms, 0.01) FROM {I}) AND (SELECT quantile_cont(duration_ms, 0.99) FROM {I})""",
    "duration_outliers": f"""WITH q AS (SELECT quantile_cont(duration_ms, 0.25) AS q1, quantile_cont(duration_ms, 0.75) AS q3 FROM {I})
      SELECT event_id, user_id, duration_ms, CASE WHEN duration_ms < q1 - 1.5 * (q3 - q1) THEN 'low' ELSE 'high' END AS outlier
      FROM {I}, q WHERE duration_ms < q1 - 1.5 * (q3 - q1) OR duration_ms > q3 + 1.5 * (q3 - q1)""",
    "dq_completeness": _completeness_sql(),
    "dq_validity": _validity_sql(),
    "dq_uniqueness": _uniq_sql("interactions(user_id,timestamp,action_type)", I, 'user_id, "timestamp", action_type')
    + " UNION ALL "
    + _uniq_sql("documents(text)", "documents", "sha256(text)"),
    "dq_consistency": " UNION ALL ".join(
        [
            f"""SELECT 'interactions.date = to_date(timestamp)' AS "check", count(*) AS rows,
                CAST(coalesce(sum(CASE WHEN "date" = CAST("timestamp" AS DATE) THEN 0 ELSE 1 END), 0) AS BIGINT) AS violations FROM {I}""",
            _orphan_sql("interactions.user_id in customer", I, "user_id", "customer", "c_custkey"),
            _orphan_sql("orders.o_custkey in customer", "orders", "o_custkey", "customer", "c_custkey"),
            _orphan_sql("lineitem.l_orderkey in orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        ]
    ),
    "dq_timeliness": " UNION ALL ".join(
        [
            _timeliness_sql("events", "events", "ts"),
            _timeliness_sql("orders", "orders", "o_orderdate"),
            _timeliness_sql("lineitem", "lineitem", "l_shipdate"),
        ]
    ),
    "dq_accuracy": _accuracy_sql(
        "orders.o_totalprice", "orders", "o_orderkey", "o_totalprice",
        "(SELECT l_orderkey AS o_orderkey, sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)) AS _t FROM lineitem GROUP BY 1)",
    )
    + " UNION ALL "
    + _accuracy_sql("documents.n_chars", "documents", "doc_id", "n_chars", "(SELECT doc_id, length(text) AS _t FROM documents)"),
    "quarantine": f"SELECT * FROM (SELECT *, {_reasons_sql()} AS reasons FROM {I}) WHERE reasons IS NOT NULL",
    "impute_default": _impute_sql(f"any_value({IMPUTE_DEFAULT})"),
    "impute_median": _impute_sql("round(quantile_cont(duration_ms, 0.5))"),
    "impute_mode": _impute_sql("(list(duration_ms ORDER BY n DESC, duration_ms))[1]", counted=True),
    "deduplicate": f"""SELECT user_id, action_type, "timestamp", event_id, page_id FROM {I}
        QUALIFY row_number() OVER (PARTITION BY user_id, action_type ORDER BY "timestamp" DESC, event_id DESC) = 1""",
    "ingest_corrupt_rows": r"""WITH t AS (SELECT length(text) - length(replace(text, chr(10), '')) AS breaks FROM documents)
        SELECT 'ok' AS status, count(*) AS rows, count(*) AS keyed_rows FROM t WHERE breaks = 0
        UNION ALL SELECT 'corrupt', CAST(sum(breaks + 1) AS BIGINT), count(*) FROM t WHERE breaks > 0""",
    "impute": f"""WITH m AS (SELECT action_type, avg(duration_ms) AS mu FROM {I}
          WHERE duration_ms IS NOT NULL AND duration_ms BETWEEN {DURATION_DOMAIN[0]} AND {DURATION_DOMAIN[1]} GROUP BY 1)
      SELECT i.event_id, i.action_type,
        CASE WHEN i.duration_ms IS NOT NULL AND i.duration_ms BETWEEN {DURATION_DOMAIN[0]} AND {DURATION_DOMAIN[1]}
             THEN i.duration_ms ELSE CAST(round(m.mu) AS BIGINT) END AS duration_ms,
        NOT coalesce(i.duration_ms IS NOT NULL AND i.duration_ms BETWEEN {DURATION_DOMAIN[0]} AND {DURATION_DOMAIN[1]}, false) AS imputed
      FROM {I} i LEFT JOIN m ON i.action_type = m.action_type""",
    "generate_interactions": _interactions_sql("(SELECT event_id AS id FROM events)"),
    "generate_metadata": _metadata_sql("(SELECT c_custkey AS id FROM customer)"),
    "convert_round_trip": f"SELECT * FROM {I}",
    "sum_numeric": """SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS sum_l_orderkey,
        CAST(sum(l_partkey) AS BIGINT) AS sum_l_partkey, CAST(sum(l_suppkey) AS BIGINT) AS sum_l_suppkey,
        CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber, round(sum(l_quantity), 4) AS sum_l_quantity,
        round(sum(l_extendedprice), 4) AS sum_l_extendedprice, round(sum(l_discount), 4) AS sum_l_discount,
        round(sum(l_tax), 4) AS sum_l_tax
      FROM lineitem GROUP BY l_returnflag""",
    **dict.fromkeys(("running_count", "running_count_split"), f"""SELECT event_id,
        row_number() OVER w AS event_number,
        CASE WHEN row_number() OVER w > 1 THEN
          CASE WHEN lag("timestamp") OVER w IS NOT NULL THEN {_sec('"timestamp"')} - {_sec('lag("timestamp") OVER w')} ELSE 0 END
        END AS seconds_since_previous
      FROM {I} WINDOW w AS ({_SESSION_WINDOW})"""),
    "duration_band": f"""SELECT coalesce(CASE WHEN duration_ms < 10000 THEN 'short' WHEN duration_ms < 60000 THEN 'medium'
        WHEN duration_ms IS NOT NULL THEN 'long' END, 'unknown') AS duration_band, count(*) AS events FROM {I} GROUP BY 1""",
    "top_users": f"""SELECT user_id, count(*) AS events FROM {I} GROUP BY user_id ORDER BY events DESC, user_id LIMIT {TOP_K}""",
    "time_features": f"""SELECT event_id, CAST(month("timestamp") AS INTEGER) AS month, CAST("timestamp" AS DATE) AS day,
        CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day_text,
        CAST(date_diff('day', CAST(date_trunc('year', CAST("timestamp" AS DATE)) AS DATE), CAST("timestamp" AS DATE)) AS INTEGER) AS day_of_year0,
        {_sec('"timestamp"')} AS epoch_seconds,
        round(({_sec('"timestamp"')} % 86400) / 60, 2) AS minute_of_day,
        CAST(user_id AS VARCHAR) || '@' || CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS user_day,
        (hour("timestamp") >= 9 AND hour("timestamp") < 17) AS office_hours
      FROM {I}""",
}
_ORACLE["sessionize_incremental"] = _ORACLE["sessionize_6h"]
_ORACLE["enrich_reduced"] = _ORACLE["enrich_partial_dimension"]
_ORACLE["join_reduced"] = f"""SELECT i.*, m.subscription_type FROM {I} i
    JOIN {M} m ON i.user_id = m.user_id AND m.subscription_type = 'BUILDING'"""
_ORACLE["user_lookup"] = _ORACLE["user_timeline"]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: per-session metrics over the sf0.001 interactions."""
    return q_session_metrics(spark, SMOKE_DIR)


def _llm() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the optional ``cadence.llm`` subpackage and its
    pipeline; empty where these are not installed."""
    found, sql = {}, {}
    if importlib.util.find_spec("cadence.llm") and importlib.util.find_spec("cadence.llm.queries"):
        module = importlib.import_module("cadence.llm.queries")
        found |= module.QUERIES
        sql |= module.ORACLES
        if importlib.util.find_spec("corpus_pipeline") is not None:
            pipeline = importlib.import_module("corpus_pipeline")
            found["pipeline"] = pipeline.run
            if pipeline.ORACLE_SQL is not None:
                sql["pipeline"] = pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_llm()[0]}


def oracle_sql() -> dict[str, str]:
    return {**_ORACLE, **_llm()[1]}
