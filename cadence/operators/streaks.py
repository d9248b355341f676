"""Longest daily streaks: run lengths on bit words, no window per user.

A user's active days are bits of a few BIGINT words, set map-side (one shuffle
by user, a fixed-size buffer per user whatever the user's volume).  And-ing a
bit set with itself shifted by 1, 2, 4, ... days marks the days on which a run
of at least 2, 4, 8, ... active days begins; shifts carry across word borders.
Going down these marks, the longest run is put together power by power, so a
year takes nine steps up and nine down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.operators.activity import _WORD, _bit_words, _index_range, _restrict

_FULL = (1 << _WORD) - 1  # a word with all its days


def _shifted(words: Column, by: Column, count: int) -> Column:
    """The bit set ``words`` moved ``by`` days toward its first day."""
    skip, bits = F.floor(by / _WORD).cast("int"), F.pmod(by, F.lit(_WORD)).cast("int")

    def moved(i: Column) -> Column:
        here = F.coalesce(F.get(words, (i + skip).cast("int")), F.lit(0))
        after = F.coalesce(F.get(words, (i + skip + 1).cast("int")), F.lit(0))
        low = F.call_function("shiftright", here, bits)
        high = F.call_function("shiftleft", after, (F.lit(_WORD) - bits).cast("int")).bitwiseAND(F.lit(_FULL))
        return F.when(bits == 0, here).otherwise(low.bitwiseOR(high))

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), moved)


def _both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def _longest_run(words: Column, count: int, days: int) -> Column:
    """Struct of ``n``, the longest run of set bits, and ``runs``, the bits at
    which one of that length begins.  Both loops are folds inside one
    expression, so no step is worked out twice by a later projection."""
    levels = max(1, days.bit_length())

    def doubled(marks: Column, k: Column) -> Column:
        last = F.element_at(marks, -1)
        return F.concat(marks, F.array(_both(last, _shifted(last, k, count))))

    # marks[k]: bits at which a run of at least 2^k begins
    steps = F.array(*[F.lit(1 << k) for k in range(levels - 1)]).cast("array<int>")
    marks = F.aggregate(steps, F.array(words), doubled)

    def longer(best: Column, k: Column) -> Column:
        found = _both(best.runs, _shifted(F.element_at(best.marks, k + 1), best.n, count))
        grown = F.struct((best.n + F.call_function("shiftleft", F.lit(1), k)).alias("n"), found.alias("runs"), best.marks.alias("marks"))
        return F.element_at(F.transform(F.array(grown), lambda g: F.when(F.exists(g.runs, lambda w: w != 0), g).otherwise(best)), 1)

    start = F.struct(F.lit(0).alias("n"), F.array(*[F.lit(_FULL)] * count).alias("runs"), marks.alias("marks"))
    return F.aggregate(F.array(*[F.lit(k) for k in reversed(range(levels))]), start, longer)


def longest_streaks(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "timestamp",
    start="2024-01-01",
    end="2025-01-01",
    date_col: str | None = None,
    actions: Sequence[str] | None = None,
    action_col: str = "action_type",
) -> DataFrame:
    """``(user, active_days, longest_streak, streak_start, full_streak)`` per
    user active in the closed range: the number of active days, the length and
    first day of the longest run of consecutive active days (the earliest of
    equals), and whether it fills the range.  Null users and null days do not
    count."""
    df = _restrict(df, ts, start, end, date_col, action_col, actions)
    span = _index_range(start, end, "day")
    if span is None or span[1] <= span[0]:
        raise ValueError("longest_streaks needs a closed range of days")
    first, days = span[0], span[1] - span[0]
    day = F.col(date_col) if date_col else F.to_date(ts)
    words = _bit_words(F.unix_date(day), first, first + days - 1)
    count = len(words)
    per_user = df.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("u")).agg(F.array(*words).alias("r0"))
    per_user = per_user.withColumn("best", _longest_run(F.col("r0"), count, days))
    at = F.array_position(F.transform("best.runs", lambda w: w != 0), F.lit(True)).cast("int") - 1
    word = F.get("best.runs", at)
    bit = F.bit_count(word.bitwiseAND(-word) - 1)  # zeros below the lowest bit
    active = F.aggregate("r0", F.lit(0), lambda a, w: a + F.bit_count(w))
    return per_user.where(active > 0).select(
        F.col("u").alias(user),
        active.alias("active_days"),
        F.col("best.n").alias("longest_streak"),
        F.date_from_unix_date((F.lit(first) + at * _WORD + bit).cast("int")).alias("streak_start"),
        (F.col("best.n") == days).alias("full_streak"),
    )


def users_with_streak(df: DataFrame, days: int | None = None, value_name: str = "users", **kw) -> DataFrame:
    """Number of users with a streak of at least ``days`` in the range (default:
    the whole range, a streak that was never broken).  One row."""
    streaks = longest_streaks(df, **kw)
    keep = F.col("full_streak") if days is None else F.col("longest_streak") >= days
    return streaks.where(keep).agg(F.count(F.lit(1)).alias(value_name))
