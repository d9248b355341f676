"""Data quality: the six dimensions, quarantine, imputation, outliers.

Each check is one distributed pass producing a small report DataFrame.
Rates are null (not an error under ANSI mode) on empty input.
Rules are ``name -> Column`` conditions that are *true for a good row*; a
row whose condition is false or null violates the rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.operators._common import bound_literal
from cadence.operators.group_quantiles import group_modes, group_percentiles
from cadence.operators.quantiles import percentile_values
from cadence.plans.lineage import cut_lineage


def _violates(cond: Column) -> Column:
    return F.when(cond, F.lit(0)).otherwise(F.lit(1))


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, rows, nulls, null_rate)`` — one scan, one row per column."""
    columns = list(columns or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[(F.count(F.lit(1)) - F.count(F.col(c))).alias(f"_n{i}") for i, c in enumerate(columns)]
    )
    stacked = wide.select(
        "_rows",
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("nulls")) for i, c in enumerate(columns)])).alias("s"),
    )
    return stacked.select(
        F.col("s.column").alias("column"),
        F.col("_rows").alias("rows"),
        F.col("s.nulls").alias("nulls"),
        F.round(F.try_divide(F.col("s.nulls"), F.col("_rows")), 6).alias("null_rate"),
    )


def validity(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``(rule, rows, violations, violation_rate)`` — one scan for all rules."""
    names = list(rules)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(_violates(rules[n])).alias(f"_v{i}") for i, n in enumerate(names)])
    stacked = wide.select(
        "_rows",
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_v{i}").alias("v")) for i, n in enumerate(names)])).alias("s"),
    )
    return stacked.select(
        F.col("s.rule").alias("rule"),
        F.col("_rows").alias("rows"),
        F.coalesce(F.col("s.v"), F.lit(0)).cast("bigint").alias("violations"),
        F.round(F.try_divide(F.coalesce(F.col("s.v"), F.lit(0)), F.col("_rows")), 6).alias("violation_rate"),
    )


def uniqueness(df: DataFrame, key: Sequence[Column | str], label: str) -> DataFrame:
    """``(check, rows, distinct_keys, duplicate_keys, duplicate_rows)``.

    Counts per key are combined map-side, so a key repeated a billion times
    ships one partial count per map task.  ``duplicate_rows`` = rows beyond
    the first of each key.
    """
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.lit(label).alias("check"),
        F.sum("_n").cast("bigint").alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("duplicate_keys"),
        F.sum(F.col("_n") - 1).cast("bigint").alias("duplicate_rows"),
    )


def orphans(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str, label: str) -> DataFrame:
    """``(check, rows, violations)``: fact rows whose key has no dimension row.

    Fact rows are first counted per key (one row per key crosses the join),
    then anti-joined to the dimension's distinct keys.  Null keys count as
    orphans.
    """
    per_key = fact.groupBy(F.col(fact_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    keys = dim.select(F.col(dim_key).alias("_k"), F.lit(True).alias("_found")).distinct()
    j = per_key.join(keys, "_k", "left")
    return j.agg(
        F.lit(label).alias("check"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_found").isNull(), F.col("_n"))), F.lit(0)).cast("bigint").alias("violations"),
    )


def rule_check(df: DataFrame, cond: Column, label: str) -> DataFrame:
    """``(check, rows, violations)`` for a single row-level consistency rule."""
    return df.agg(
        F.lit(label).alias("check"),
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(_violates(cond)), F.lit(0)).cast("bigint").alias("violations"),
    )


def timeliness(df: DataFrame, ts: str, as_of, label: str, max_lag_hours: float = 24.0) -> DataFrame:
    """``(table, latest, lag_hours, is_stale)`` against an as-of time."""
    ref = bound_literal(df, ts, as_of)
    latest = df.agg(F.max(ts).alias("latest"))
    # wall-clock difference for TIMESTAMP_NTZ (no session time zone, no DST)
    lag = F.timestamp_diff("MICROSECOND", F.col("latest"), ref) / 3.6e9
    return latest.select(
        F.lit(label).alias("table"),
        "latest",
        F.round(lag, 6).alias("lag_hours"),
        (lag > F.lit(max_lag_hours)).alias("is_stale"),
    )


def accuracy(
    df: DataFrame, truth: DataFrame, key: str, value: str, truth_value: str, label: str, rel_tol: float = 1e-6
) -> DataFrame:
    """``(check, rows, missing, mismatches, mismatch_rate)``: values compared
    with a truth table on ``key``; ``missing`` = no truth row for the key."""
    t = truth.select(F.col(key), F.col(truth_value).alias("_t"))
    j = df.select(key, value).join(t, key, "left")
    off = F.abs(F.col(value) - F.col("_t")) > F.lit(rel_tol) * F.greatest(F.abs(F.col(value)), F.abs(F.col("_t")), F.lit(1.0))
    return j.agg(
        F.lit(label).alias("check"),
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("_t").isNull(), 1)).alias("missing"),
        F.count(F.when(off, 1)).alias("mismatches"),
        F.round(F.try_divide(F.count(F.when(off, 1)), F.count(F.lit(1))), 6).alias("mismatch_rate"),
    )


def with_reasons(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``reasons``: the violated rule names joined by ``;`` (null when valid)."""
    parts = [F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]
    reasons = F.concat_ws(";", *parts)
    return df.withColumn("reasons", F.when(reasons != "", reasons))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows + ``reasons``)."""
    tagged = with_reasons(df, rules)
    return tagged.where(F.col("reasons").isNull()).drop("reasons"), tagged.where(F.col("reasons").isNotNull())


def quarantine(df: DataFrame, rules: Mapping[str, Column], path: str, fmt: str = "parquet") -> DataFrame:
    """Write valid and invalid rows to separate folders for audit
    (``is_valid=true`` / ``is_valid=false`` under ``path``) in one tagging pass,
    and return a reader of the quarantined rows."""
    tagged = with_reasons(df, rules).withColumn("is_valid", F.col("reasons").isNull())
    tagged.write.mode("overwrite").format(fmt).partitionBy("is_valid").save(path)
    # read with the known schema: an empty result has no files to infer one from
    base = df.sparkSession.read.format(fmt).schema(tagged.schema).load(path)
    return base.where(~F.col("is_valid")).drop("is_valid")


def value_accuracy(df: DataFrame, value: str, truth: Column, label: str, rel_tol: float = 1e-6) -> DataFrame:
    """``accuracy`` against a truth that the row itself holds (no join)."""
    t = F.col("_t")
    off = F.abs(F.col(value) - t) > F.lit(rel_tol) * F.greatest(F.abs(F.col(value)), F.abs(t), F.lit(1.0))
    return df.select(value, truth.alias("_t")).agg(
        F.lit(label).alias("check"),
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(t.isNull(), 1)).alias("missing"),
        F.count(F.when(off, 1)).alias("mismatches"),
        F.round(F.try_divide(F.count(F.when(off, 1)), F.count(F.lit(1))), 6).alias("mismatch_rate"),
    )


def deduplicate(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], descending: bool = False) -> DataFrame:
    """One row per ``keys`` (nulls are equal): the first by ``order_by``, or the
    last with ``descending``.  A grouped minimum, combined map-side, so a key
    repeated a billion times ships one row per task; the remaining columns
    break ties, so the result is the same on every run."""
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    packed = F.struct(*[F.col(f"`{c}`") for c in [*order_by, *rest]])
    best = df.groupBy(*keys).agg((F.max if descending else F.min)(packed).alias("_row"))
    return best.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def _fill(df: DataFrame, col: str, out_col: str, good: Column, fill: Column, extra: Sequence[str] = ()) -> DataFrame:
    keep = F.col("_good")
    out = df.withColumn(out_col, F.when(keep, F.col(col)).otherwise(fill))
    return out.withColumn("imputed", ~keep).drop("_good", *extra)


def impute(
    df: DataFrame, col: str, how: str, value=None, valid: Column | None = None, out_col: str | None = None
) -> DataFrame:
    """Replace null (or invalid) ``col`` values by ``value`` (``"default"``),
    or by the ``"mean"``, the exact ``"median"`` or the ``"mode"`` (smallest of
    the most frequent) of the valid ones; adds ``imputed`` (boolean).

    The fill is one scalar of a distributed job.  Integral and decimal columns
    keep their type; means and medians are rounded to it."""
    good = F.col(col).isNotNull() & (valid if valid is not None else F.lit(True))
    rows = df.where(good)
    if how == "default":
        fill = value
    elif how == "mean":
        fill = rows.agg(F.avg(col)).first()[0]
    elif how == "median":
        fill = percentile_values(rows, col, {"m": 0.5})["m"]
    elif how == "mode":
        top = rows.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), F.col(col)).first()
        fill = top[0] if top else None
    else:
        raise ValueError("how must be default, mean, median or mode")
    kind = df.schema[col].dataType
    lit = F.lit(fill)
    if isinstance(kind, (T.IntegralType, T.DecimalType)) and isinstance(fill, float):
        lit = F.round(lit, getattr(kind, "scale", 0))
    return _fill(df.withColumn("_good", good), col, out_col or col, good, lit.cast(kind))


def impute_by_group(
    df: DataFrame,
    col: str,
    group: str,
    valid: Column | None = None,
    out_col: str | None = None,
    integral: bool = True,
    how: str = "mean",
) -> DataFrame:
    """Replace null (or invalid) ``col`` values by the mean, the exact
    ``"median"`` or the ``"mode"`` (smallest of the most frequent) of the valid
    ones in the same ``group``; adds ``imputed`` (boolean).  The groups' values
    are written once as a table, whose true size then lets Spark choose how to
    join them back.

    Medians and modes come from a histogram that no group gathers in one task
    (``group_quantiles``) and keep the column's type; a median between two
    values is rounded to it (whole numbers, decimals)."""
    good = F.col(col).isNotNull() & (valid if valid is not None else F.lit(True))
    if how in ("median", "mode"):
        kind = df.schema[col].dataType
        slim = df.where(good).select(F.col(f"`{group}`").alias("g0"), F.col(f"`{col}`").alias("v0"))
        if how == "mode":
            fills = group_modes(slim, "g0", "v0").select(F.col("g0").alias("_g"), F.col("mode").alias("_fill"))
        else:
            between = F.col("value")
            if isinstance(kind, (T.IntegralType, T.DecimalType)):
                between = F.round(between, getattr(kind, "scale", 0))
            middle = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between.cast(kind))
            fills = group_percentiles(slim, "g0", "v0", [0.5]).select(F.col("g0").alias("_g"), middle.alias("_fill"))
        fills = cut_lineage(fills, "table")
        j = df.withColumn("_good", good).join(fills, F.col(f"`{group}`") == F.col("_g"), "left")
        return _fill(j, col, out_col or col, good, F.col("_fill"), ("_g", "_fill"))
    if how != "mean":
        raise ValueError("how must be mean, median or mode")
    means = df.where(good).groupBy(F.col(group).alias("_g")).agg(F.avg(col).alias("_mean"))
    means = cut_lineage(means, "table")
    fill = F.round("_mean").cast("bigint") if integral else F.col("_mean")
    j = df.withColumn("_good", good).join(means, F.col(f"`{group}`") == F.col("_g"), "left")
    return _fill(j, col, out_col or col, good, fill, ("_g", "_mean"))


def capped(
    df: DataFrame, col: str, lower: float = 0.01, upper: float = 0.99, out_col: str | None = None, mode: str = "cap"
) -> DataFrame:
    """Handle long tails of ``col`` with its exact ``lower``/``upper``
    percentiles (two scalars from a distributed job, then literals).

    ``mode="cap"`` winsorizes into ``out_col`` (default ``<col>_capped``);
    ``mode="filter"`` keeps only the rows inside the bounds."""
    b = percentile_values(df, col, {"lo": lower, "hi": upper})
    if mode == "filter":
        return df.where(F.col(col).between(F.lit(b["lo"]), F.lit(b["hi"])))
    lo, hi = F.lit(b["lo"]).cast("double"), F.lit(b["hi"]).cast("double")
    if mode != "cap":
        raise ValueError("mode must be 'cap' or 'filter'")
    out_col = out_col or f"{col}_capped"
    return df.withColumn(out_col, F.least(F.greatest(F.col(col).cast("double"), lo), hi))


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Rows outside the Tukey fences ``[q1 - k·iqr, q3 + k·iqr]`` with
    ``outlier`` = 'low' | 'high'.  The quartiles are exact (two scalars)."""
    q = percentile_values(df, col, {"q1": 0.25, "q3": 0.75})
    if q["q1"] is None:
        return df.withColumn("outlier", F.lit(None).cast("string")).limit(0)
    q1, q3 = float(q["q1"]), float(q["q3"])
    low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    kind = F.when(F.col(col) < F.lit(low), "low").when(F.col(col) > F.lit(high), "high")
    return df.withColumn("outlier", kind).where(F.col("outlier").isNotNull())
