"""Run a job on tables in the reference schema.

    python -m cadence <job> --interactions PATH [--metadata PATH]
                      [--format parquet|csv|orc] [--start D --end D]
                      [--out PATH | --show N]

Tables are read with the explicit ``user_interactions`` / ``user_metadata``
schemas (partition columns discovered from ``date=`` / ``country=``
folders).  The result is written as Parquet to ``--out`` or its first rows
are printed.  ``--list`` prints the jobs.
"""

from __future__ import annotations

import argparse
import sys

from cadence.session import build_session, clean_scratch, shuffle_partitions_for


# Validity rules of the interactions table, used by the quality jobs.
def _rules(a):
    from pyspark.sql import functions as F

    return {
        "user_id_present": F.col("user_id").isNotNull(),
        "timestamp_present": F.col("timestamp").isNotNull(),
        "duration_in_range": F.col("duration_ms").between(a.min_duration, a.max_duration),
        "app_version_format": F.col("app_version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"),
        "date_matches_timestamp": F.col("date") == F.to_date("timestamp"),
    }


def _jobs():
    from pyspark.sql import functions as F

    from cadence.operators import activity, insights, joins, partitioning, quality, sessions, skew, streaks
    from cadence.session import scratch_path
    from cadence.sources import generate
    from cadence.sources.files import convert
    from cadence.sources.schemas import INTERACTIONS

    def year(a):
        return dict(start=a.start, end=a.end, date_col="date", actions=a.actions)

    def consistency(a, ev, md):
        rule = quality.rule_check(ev, F.col("date") == F.to_date("timestamp"), "date = to_date(timestamp)")
        return rule.unionByName(quality.orphans(ev, "user_id", md, "user_id", "user_id in metadata")) if md is not None else rule

    def impute(a, ev, md):
        if a.how.startswith("group_"):
            return quality.impute_by_group(ev, "duration_ms", "action_type", how=a.how.removeprefix("group_"))
        return quality.impute(ev, "duration_ms", a.how, value=a.value)

    return {
        "dau": lambda a, ev, md: activity.dau_series(ev, **year(a)),
        "mau": lambda a, ev, md: activity.mau_series(ev, **year(a)),
        "active_users": lambda a, ev, md: activity.active_users(ev, grain=a.grain, **year(a)),
        "users_active_all_months": lambda a, ev, md: activity.users_active_in_n_periods(ev, n=a.n, **year(a)),
        "streak_days": lambda a, ev, md: activity.streak_days(ev, **year(a)),
        "longest_streaks": lambda a, ev, md: streaks.longest_streaks(ev, **year(a)),
        "full_streak_users": lambda a, ev, md: streaks.users_with_streak(ev, **year(a)),
        "daily_user_rollup": lambda a, ev, md: activity.daily_user_rollup(ev),
        "sessionize": lambda a, ev, md: sessions.sessionize(ev, gap_seconds=a.gap),
        "session_metrics": lambda a, ev, md: sessions.session_metrics(ev, gap_seconds=a.gap),
        "session_averages": lambda a, ev, md: sessions.session_averages(ev, gap_seconds=a.gap),
        "session_actions": lambda a, ev, md: sessions.session_actions(ev, gap_seconds=a.gap),
        "enrich": lambda a, ev, md: partitioning.balanced_join(ev, md) if a.strategy == "balanced" else joins.enrich(ev, md, strategy=a.strategy),
        "activity_by_country_subscription": lambda a, ev, md: joins.activity_by(ev, md, strategy=a.strategy),
        "key_frequency": lambda a, ev, md: skew.key_frequency(ev, "user_id", top=a.top),
        "key_skew": lambda a, ev, md: skew.key_skew_summary(ev, "user_id"),
        "partition_profile": lambda a, ev, md: skew.partition_profile(ev),
        "partition_profile_metadata": lambda a, ev, md: skew.partition_profile(md),
        "retention": lambda a, ev, md: insights.retention(ev),
        "popular_actions": lambda a, ev, md: insights.popular_actions(ev),
        "subscription_insights": lambda a, ev, md: insights.subscription_insights(ev, md),
        "activity_by_hour": lambda a, ev, md: insights.activity_by_hour(ev),
        "version_usage": lambda a, ev, md: insights.version_usage(ev),
        "duration_outliers": lambda a, ev, md: quality.iqr_outliers(ev, "duration_ms"),
        "duration_capped": lambda a, ev, md: quality.capped(ev, "duration_ms"),
        "completeness": lambda a, ev, md: quality.completeness(ev),
        "validity": lambda a, ev, md: quality.validity(ev, _rules(a)),
        "uniqueness": lambda a, ev, md: quality.uniqueness(ev, ["user_id", "timestamp", "action_type"], "user_id,timestamp,action_type"),
        "consistency": consistency,
        "timeliness": lambda a, ev, md: quality.timeliness(ev, "timestamp", a.end, "interactions"),
        "quarantine": lambda a, ev, md: quality.quarantine(ev, _rules(a), a.path or scratch_path(ev.sparkSession, "quarantine")),
        "impute": impute,
        "deduplicate": lambda a, ev, md: quality.deduplicate(ev, ["user_id", "timestamp", "action_type"], ["page_id"]),
        "generate_interactions": lambda a, spark: generate.generate_interactions(spark, a.rows, seed=a.seed),
        "generate_metadata": lambda a, spark: generate.generate_metadata(spark, a.rows, seed=a.seed),
        "convert": lambda a, spark: convert(spark, a.interactions, a.path, INTERACTIONS, ["date"]),
    }


# Jobs that take no tables: they are called with the session alone.
SESSION_JOBS = ("generate_interactions", "generate_metadata", "convert")
NEED_METADATA = ("enrich", "activity_by_country_subscription", "subscription_insights", "partition_profile_metadata")


def _read(spark, path, schema, fmt):
    from cadence.sources.files import read_csv, read_orc, read_parquet

    return {"parquet": read_parquet, "csv": read_csv, "orc": read_orc}[fmt](spark, path, schema)


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="python -m cadence", description=__doc__.split("\n\n")[0])
    p.add_argument("job", nargs="?")
    p.add_argument("--list", action="store_true")
    p.add_argument("--interactions")
    p.add_argument("--metadata")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "orc"])
    p.add_argument("--start", default="2024-01-01")
    p.add_argument("--end", default="2025-01-01")
    p.add_argument("--n", type=int, default=12, help="periods for users_active_all_months")
    p.add_argument("--gap", type=int, default=1800, help="session inactivity gap, seconds")
    p.add_argument("--strategy", default="auto", help="join strategy: auto, broadcast, merge, shuffle_hash, salted, balanced (enrich)")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--grain", default="day", choices=["hour", "day", "week", "month", "quarter", "year"], help="period of active_users")
    p.add_argument("--actions", nargs="+", help="action types that count as activity (default: all)")
    p.add_argument("--how", default="group_mean", choices=["group_mean", "group_median", "group_mode", "default", "mean", "median", "mode"], help="fill of impute")
    p.add_argument("--value", type=int, default=0, help="default value of impute")
    p.add_argument("--min-duration", type=int, default=100)
    p.add_argument("--max-duration", type=int, default=300_000)
    p.add_argument("--rows", type=int, default=1_000_000, help="rows to generate")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--path", help="folder that quarantine or convert writes to")
    p.add_argument("--out")
    p.add_argument("--show", type=int, default=20)
    p.add_argument("--master")
    a = p.parse_args(argv)
    jobs = _jobs()
    if a.list or not a.job:
        print("\n".join(sorted(jobs)))
        return 0
    if a.job not in jobs:
        p.error(f"need a job from --list (got {a.job!r})")
    if not a.interactions and not a.job.startswith("generate_"):
        p.error(f"{a.job} needs --interactions")
    if a.job in NEED_METADATA and not a.metadata:
        p.error(f"{a.job} needs --metadata")
    if a.job == "convert" and not a.path:
        p.error("convert needs --path")
    from cadence.plans.strategy import input_bytes
    from cadence.sources.schemas import INTERACTIONS, METADATA

    spark = build_session(master=a.master, app_name=f"cadence-{a.job}")
    if a.job in SESSION_JOBS:
        out = jobs[a.job](a, spark)
    else:
        ev = _read(spark, a.interactions, INTERACTIONS, a.format)
        md = _read(spark, a.metadata, METADATA, a.format) if a.metadata else None
        # AQE merges small partitions but adds none: start from the input's size
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions_for(input_bytes(ev) or 0, least)))
        out = jobs[a.job](a, ev, md)
    if a.out:
        out.write.mode("overwrite").parquet(a.out)
    else:
        out.show(a.show, truncate=False)
    clean_scratch(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
