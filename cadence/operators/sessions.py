"""Inactivity-gap sessions and their metrics.

A user's event starts a new session when it comes more than ``gap_seconds``
(whole epoch seconds, strict ``>``) after the user's previous event.  The
session number is the running count of such starts, from 0; events with
equal timestamps always share a session; a null timestamp sorts first and
joins session 0; a null user is a user like any other here, and gives a null
session id.

Scale design
------------
The natural plan, one window per user over the raw events, puts a busy user
(or all anonymous events) in one task.  Sessions depend on the *seconds* in
which a user was active only, so the events are first counted per (user,
second), combined map-side: a burst is one row.  These rows are cut into
chunks of ``chunk_seconds`` per user, for every user alike, so a window
partition holds at most ``chunk_seconds`` rows however many events there are.
A summary per (user, chunk) — first and last second, local starts, events —
carries the session counter and the gap across chunk borders (a distributed
prefix sum; per user one row per chunk with events).  Nothing is measured
beforehand, collected, or treated differently above some size.

Session metrics and averages are sums over the (user, second) rows.  Row-level
results join the rows back on (user, second), a key that spreads a busy user
over all tasks; the first event of a second is the one with the least
timestamp and tie-break, found by a grouped minimum, not by sorting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions import epoch_seconds
from cadence.plans.lineage import cut_lineage

CHUNK_SECONDS = 86_400
_NULL_CHUNK = -(2**62)  # chunk of null timestamps: sorts before every real chunk
_PLAIN = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def session_seconds(
    seconds: DataFrame, user: str, gap_seconds: int, chunk_seconds: int = CHUNK_SECONDS, keep: Sequence[str] = ("_n",)
) -> DataFrame:
    """For rows (user, ``_sec``, ``_n`` events): ``_diff`` (seconds since the
    user's previous active second, else 0), ``_flag`` (starts a session),
    ``_seq`` (session number) and ``_base`` (events of the session before);
    ``keep`` names the columns of ``seconds`` that the caller will use."""
    chunk = F.coalesce(F.floor(F.col("_sec") / chunk_seconds), F.lit(_NULL_CHUNK)).cast("bigint")
    w = Window.partitionBy(user, "_c").orderBy("_sec")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        seconds.withColumn("_c", chunk)
        .withColumn("_d", (F.col("_sec") - F.lag("_sec").over(w)).cast("bigint"))
        .withColumn("_f", F.when(F.col("_d") > gap_seconds, 1).otherwise(0))
        .withColumn("_starts", F.sum("_f").over(so_far))
        .withColumn("_before", F.sum("_n").over(so_far) - F.col("_n"))
        .withColumn("_start", F.max(F.when(F.col("_f") == 1, F.col("_before"))).over(so_far))
    )
    wc = Window.partitionBy(user).orderBy("_c")
    earlier = wc.rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        local.groupBy(user, "_c")
        .agg(
            F.min("_sec").alias("_first"),
            F.max("_sec").alias("_last"),
            F.sum("_f").alias("_k"),
            F.sum("_n").alias("_events"),
            F.max("_start").alias("_lstart"),
            sum((F.sum(c) if c == "_n" else F.count(c) for c in keep), F.lit(1)).alias("_all"),
        )
        # always true; it keeps the same columns of the (user, second) rows in
        # this branch as in the other, so that Spark reuses their exchange
        # instead of building the rows a second time from the events
        .where("_all > 0")
        .withColumn("_cd", F.coalesce(F.col("_first") - F.lag("_last").over(wc), F.lit(0)).cast("bigint"))
        .withColumn("_cf", F.when(F.col("_cd") > gap_seconds, 1).otherwise(0))
        .withColumn("_cseq", F.coalesce(F.sum(F.col("_cf") + F.col("_k")).over(earlier), F.lit(0)) + F.col("_cf"))
        .withColumn("_cbefore", F.coalesce(F.sum("_events").over(earlier), F.lit(0)))
    )
    # events before the last session start up to and including this chunk
    start_here = F.greatest(F.col("_cbefore") + F.col("_lstart"), F.when(F.col("_cf") == 1, F.col("_cbefore")))
    chunks = chunks.withColumn("_carry", F.coalesce(F.max(start_here).over(earlier), F.lit(0)))
    chunks = chunks.select(F.col(user).alias("_u"), F.col("_c").alias("_uc"), "_cd", "_cf", "_cseq", "_cbefore", "_carry")
    joined = local.join(chunks, local[user].eqNullSafe(chunks["_u"]) & (local["_c"] == chunks["_uc"]))
    first = F.col("_d").isNull()  # of its chunk
    start = F.coalesce(F.col("_cbefore") + F.col("_start"), F.when(F.col("_cf") == 1, F.col("_cbefore")), F.col("_carry"))
    return joined.select(
        user,
        "_sec",
        *keep,
        F.when(first, F.col("_cd")).otherwise(F.col("_d")).alias("_diff"),
        F.when(first, F.col("_cf")).otherwise(F.col("_f")).cast("int").alias("_flag"),
        (F.col("_cseq") + F.col("_starts")).cast("bigint").alias("_seq"),
        (F.col("_cbefore") + F.col("_before") - start).cast("bigint").alias("_base"),
    )


def _active_seconds(df: DataFrame, user: str, ts: str) -> DataFrame:
    return df.select(user, epoch_seconds(ts).alias("_sec")).groupBy(user, "_sec").agg(F.count(F.lit(1)).alias("_n"))


def _first_events(rows: DataFrame, user: str, ts: str, tie: Column, plain: bool) -> DataFrame:
    """(user, ``_sec``, ``_n``, ``_t0``, ``_tie0``): events of each active
    second, and the timestamp and tie-break of its first event."""
    if plain:  # two hash aggregates
        per_ts = rows.groupBy(user, "_sec", F.col(ts).alias("_t")).agg(F.count(F.lit(1)).alias("_m"), F.min(tie).alias("_tie"))
        return per_ts.groupBy(user, "_sec").agg(
            F.sum("_m").cast("bigint").alias("_n"), F.min("_t").alias("_t0"), F.min_by("_tie", "_t").alias("_tie0")
        )
    low = rows.groupBy(user, "_sec").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col(ts).alias("t"), tie.alias("k"))).alias("_low"))
    return low.select(user, "_sec", "_n", F.col("_low.t").alias("_t0"), F.col("_low.k").alias("_tie0"))


def session_core(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "timestamp",
    gap_seconds: int = 1800,
    tiebreak: Sequence[str] = (),
    chunk_seconds: int = CHUNK_SECONDS,
    with_step: bool = False,
    cut: str | None = None,
) -> DataFrame:
    """Input columns + ``time_diff`` (BIGINT), ``is_new_session`` (INT),
    ``session_seq`` (BIGINT) and, with ``with_step``, ``session_step``
    (1-based position of the event inside its session).

    Events of one second are ordered by timestamp and ``tiebreak`` (without
    one, by a hash of the row); rows equal in all of these carry equal values.

    ``cut`` materializes the input first (``"cache"``, ``"checkpoint"`` or
    ``"table"``, see ``plans.lineage``): worth it when the input is an
    expensive plan, since it is read twice.
    """
    df = cut_lineage(df, cut)
    cols = df.columns
    ties = list(tiebreak)
    plain = not ties or (len(ties) == 1 and isinstance(df.schema[ties[0]].dataType, _PLAIN))
    rows = df.withColumn("_sec", epoch_seconds(ts))
    if not ties:
        rows = rows.withColumn("_k", F.xxhash64(*[F.col(f"`{c}`") for c in cols]))
    elif len(ties) == 1:
        rows = rows.withColumn("_k", F.col(ties[0]))
    else:
        rows = rows.withColumn("_k", F.struct(*ties))
    firsts = _first_events(rows, user, ts, F.col("_k"), plain)
    keep = ("_t0", "_tie0", "_n") if with_step else ("_t0", "_tie0")
    numbered = session_seconds(firsts, user, gap_seconds, chunk_seconds, keep).select(
        F.col(user).alias("_u"), F.col("_sec").alias("_us"), "_diff", "_flag", "_seq", "_base", "_t0", "_tie0"
    )
    j = rows.join(numbered, rows[user].eqNullSafe(numbered["_u"]) & rows["_sec"].eqNullSafe(numbered["_us"]))
    first = F.col(ts).eqNullSafe(F.col("_t0")) & F.col("_k").eqNullSafe(F.col("_tie0"))
    out = [
        *[rows[c] for c in cols],
        F.when(first, F.col("_diff")).otherwise(F.lit(0)).cast("bigint").alias("time_diff"),
        F.when(first, F.col("_flag")).otherwise(F.lit(0)).cast("int").alias("is_new_session"),
        F.col("_seq").alias("session_seq"),
    ]
    if with_step:
        inside = Window.partitionBy(rows[user], rows["_sec"]).orderBy(F.col(ts).asc_nulls_first(), F.col("_k").asc_nulls_first())
        out.append((F.col("_base") + F.row_number().over(inside)).cast("bigint").alias("session_step"))
    return j.select(*out)


def _session_id(user: str, seq: str = "session_seq"):
    return F.concat(F.col(user).cast("string"), F.lit("_"), F.col(seq).cast("string"))


def sessionize(df: DataFrame, user: str = "user_id", ts: str = "timestamp", gap_seconds: int = 1800, **kw) -> DataFrame:
    """Input columns + ``time_diff``, ``is_new_session``, ``session_id`` (``user_seq``)."""
    core = session_core(df, user=user, ts=ts, gap_seconds=gap_seconds, **kw)
    return core.withColumn("session_id", _session_id(user)).drop("session_seq")


def _sessions(df: DataFrame, user: str, ts: str, gap_seconds: int, chunk_seconds: int = CHUNK_SECONDS, cut: str | None = None, **_) -> DataFrame:
    """(user, ``_seq``, ``_dur`` seconds, ``_events``) per session."""
    numbered = session_seconds(_active_seconds(cut_lineage(df, cut), user, ts), user, gap_seconds, chunk_seconds)
    # all null-user events are one group: their session id is null
    seq = F.when(F.col(user).isNotNull(), F.col("_seq"))
    return (
        numbered.select(user, seq.alias("_seq"), "_sec", "_n")
        .groupBy(user, "_seq")
        .agg((F.max("_sec") - F.min("_sec")).alias("_dur"), F.sum("_n").cast("bigint").alias("_events"))
    )


def session_metrics(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "timestamp",
    gap_seconds: int = 1800,
    order: bool = True,
    **kw,
) -> DataFrame:
    """``(session_id, session_duration_minutes, action_count)``, longest first.

    Grouped by (user, session number); the id string is built after the
    aggregate.  All null-user events form one group (their id is null).
    """
    agg = _sessions(df, user, ts, gap_seconds, **kw).select(
        _session_id(user, "_seq").alias("session_id"),
        F.round(F.col("_dur") / 60, 2).alias("session_duration_minutes"),
        F.col("_events").alias("action_count"),
    )
    if order:
        agg = agg.orderBy(F.col("session_duration_minutes").desc_nulls_last(), F.col("session_id"))
    return agg


def longest_sessions(df: DataFrame, k: int = 20, **kw) -> DataFrame:
    """Top-k sessions by duration (ties by id): the reference's ``show()`` of the
    sorted metrics, planned as TakeOrderedAndProject (no global sort)."""
    return session_metrics(df, order=True, **kw).limit(k)


def session_averages(df: DataFrame, user: str = "user_id", ts: str = "timestamp", gap_seconds: int = 1800, **kw) -> DataFrame:
    """One row: ``sessions``, ``avg_session_duration_minutes``, ``avg_actions_per_session``.

    Averages whole seconds and counts, then rounds once (4 places).
    """
    per = _sessions(df.where(F.col(user).isNotNull()), user, ts, gap_seconds, **kw)
    return per.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.round(F.avg("_dur") / 60, 4).alias("avg_session_duration_minutes"),
        F.round(F.avg("_events"), 4).alias("avg_actions_per_session"),
    )


def session_actions(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "timestamp",
    action: str = "action_type",
    gap_seconds: int = 1800,
    **kw,
) -> DataFrame:
    """The actions of every session in order, one row per action:
    ``(session_id, session_step, timestamp, action_type)``.

    Row form on purpose: a session of a bot can be arbitrarily long, and a
    list-valued column would make it one giant row in one task.
    """
    core = session_core(df, user=user, ts=ts, gap_seconds=gap_seconds, with_step=True, **kw)
    return core.select(_session_id(user).alias("session_id"), "session_step", F.col(ts), F.col(action))
