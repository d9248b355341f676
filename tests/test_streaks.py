"""Longest streaks against gaps and islands in plain Python."""

import datetime as dt
import random

import pytest

from cadence.operators import streaks

DAY0 = dt.date(2024, 1, 1)


def islands(days, first, n):
    days, best, i = sorted(d for d in days if first <= d < first + n), (0, 0), 0
    if not days:
        return None
    while i < len(days):
        j = i
        while j + 1 < len(days) and days[j + 1] == days[j] + 1:
            j += 1
        best = max(best, (j - i + 1, -days[i]))
        i = j + 1
    return len(days), best[0], DAY0 + dt.timedelta(days=-best[1]), best[0] == n


@pytest.fixture(scope="module")
def activity(spark):
    rng = random.Random(1)
    days = {u: {d for d in range(366) if rng.random() < rng_p} for u, rng_p in enumerate([0.0, 0.02, 0.5, 0.9, 0.97, 1.0] * 12)}
    days[500] = set(range(62, 64)) | set(range(100, 200))  # across a word border
    days[501] = set(range(0, 366)) - {63}
    days[502] = {62, 63, 125, 126}
    rows = [(u, dt.datetime.combine(DAY0 + dt.timedelta(days=d), dt.time(d % 24))) for u, ds in days.items() for d in ds for _ in range(1 + d % 2)]
    rows += [(None, dt.datetime(2024, 1, 5)), (2, None), (2, dt.datetime(2025, 1, 1)), (2, dt.datetime(2023, 12, 31))]
    return days, spark.createDataFrame(rows, "user_id bigint, timestamp timestamp_ntz")


@pytest.mark.parametrize("start,end", [("2024-01-01", "2025-01-01"), ("2024-03-03", "2024-05-05"), ("2024-02-02", "2024-02-03"), ("2024-01-01", "2024-03-04")])
def test_streaks_equal_gaps_and_islands(activity, start, end):
    days, df = activity
    first = (dt.date.fromisoformat(start) - DAY0).days
    n = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days
    want = {u: got for u, ds in days.items() if (got := islands(ds, first, n))}
    got = streaks.longest_streaks(df, start=start, end=end)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    full = streaks.users_with_streak(df, start=start, end=end).first()["users"]
    assert full == sum(v[3] for v in want.values())


def test_bounds_and_empty(activity):
    _, df = activity
    assert streaks.longest_streaks(df.limit(0)).count() == 0
    assert streaks.users_with_streak(df, days=100).first()["users"] >= 13
    with pytest.raises(ValueError):
        streaks.longest_streaks(df, start="2024-01-01", end="2024-01-01")
