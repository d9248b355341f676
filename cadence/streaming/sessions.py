"""Sessions from batches of new events, with the ids of the whole history.

State is one row per user: the time of the last event and the number of the last
session.  A batch is sessionized by the batch operator together with one marker
row per user, which stands for all the user's earlier events; session numbers then
go on from the state's.  Older events are never read again, and a busy user is
spread over tasks as in the batch operator.

The law is the batch one: whole seconds, strict gap, running numbers from 0, null
timestamps in session 0.  Over batches in time order (events of one second may be
dealt to several) the union of the results equals one run over all events.  An
event from before the second of its user's last known one comes too late for its
number: it is returned apart and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadence.functions import epoch_seconds
from cadence.operators.sessions import session_core
from cadence.plans.lineage import cut_lineage


class SessionStep(NamedTuple):
    """Result of one batch."""

    rows: DataFrame  # the batch with time_diff, is_new_session, session_id
    state: DataFrame  # user, last_ts, session_seq
    late: DataFrame  # events that came after their session was numbered


def advance_sessions(
    state: DataFrame | None,
    batch: DataFrame,
    user: str = "user_id",
    ts: str = "timestamp",
    gap_seconds: int = 1800,
    tiebreak: Sequence[str] = (),
    **kw,
) -> SessionStep:
    """Sessionize ``batch`` after what ``state`` knows (None: nothing yet)."""
    columns = [F.col(f"`{c}`") for c in batch.columns]
    if state is None:
        state = batch.select(F.col(user).alias("u"), F.col(ts).alias("last_ts"), F.lit(0).cast("bigint").alias("session_seq")).limit(0)
    # the state of the batch's users only
    known = state.join(batch.select(F.col(user).alias("bu")).distinct(), F.col("u").eqNullSafe(F.col("bu")), "left_semi")
    known = cut_lineage(known, "table")
    tagged = batch.join(known, F.col(user).eqNullSafe(F.col("u")), "left")
    is_late = F.coalesce(epoch_seconds(F.col(ts)) < epoch_seconds(F.col("last_ts")), F.lit(False))
    late, fresh = tagged.where(is_late).select(*columns), tagged.where(~is_late).select(*columns, F.lit(False).alias("_marker"))
    stands = {user: F.col("u"), ts: F.col("last_ts")}
    kinds = {f.name: f.dataType for f in batch.schema.fields}
    markers = known.select(*[stands.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in batch.columns], F.lit(True).alias("_marker"))
    core = session_core(fresh.unionByName(markers), user, ts, gap_seconds, tiebreak, **kw).where("NOT _marker").drop("_marker")
    numbered = core.join(known.select("u", F.col("session_seq").alias("_from")), F.col(user).eqNullSafe(F.col("u")), "left")
    seq = F.when(F.col(ts).isNull(), 0).otherwise(F.coalesce("_from", F.lit(0)) + F.col("session_seq")).cast("bigint")
    numbered = cut_lineage(numbered.select(*columns, "time_diff", "is_new_session", seq.alias("session_seq")), "table")
    seen = numbered.groupBy(F.col(user).alias("u")).agg(F.max(ts).alias("last_ts"), F.max("session_seq").alias("session_seq"))
    after = state.unionByName(seen).groupBy("u").agg(F.max("last_ts").alias("last_ts"), F.max("session_seq").alias("session_seq"))
    session_id = F.concat(F.col(user).cast("string"), F.lit("_"), F.col("session_seq").cast("string"))
    return SessionStep(numbered.withColumn("session_id", session_id).drop("session_seq"), cut_lineage(after, "table"), late)


def replay_sessions(batches: Iterable[DataFrame], **kw) -> DataFrame:
    """The sessionized rows of all batches, one after the other."""
    state, out = None, []
    for batch in batches:
        step = advance_sessions(state, batch, **kw)
        state = step.state
        out.append(step.rows)
    return reduce(DataFrame.unionByName, out)


def run_sessions_available_now(events: DataFrame, path: str, checkpoint: str, **kw) -> StreamingQuery:
    """Sessionize everything new of a streaming DataFrame, then stop.

    Each micro-batch writes ``rows``, ``late`` and ``state`` under
    ``path/<kind>/batch=<id>``, overwriting what a failed attempt of the same
    batch has left, and reads only the state of the batch before it."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{path}/state/batch={number - 1}") if number else None
        step = advance_sessions(state, cut_lineage(batch, "table"), **kw)
        for kind, df in (("rows", step.rows), ("late", step.late), ("state", step.state)):
            df.write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")

    q = events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
