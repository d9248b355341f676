"""Property tests: streak days and exact percentiles against direct Python."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cadence.operators import activity
from cadence.operators.quantiles import exact_percentiles

D0 = dt.date(2024, 1, 1)
rows = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", None]), st.one_of(st.none(), st.integers(min_value=0, max_value=12))),
    min_size=1,
    max_size=40,
)


def lag_rule(data):
    """The reference's rule: per user, days in order (null first); a row
    counts when its difference to the previous day is 1 or unknown."""
    total = 0
    for u in {u for u, _ in data}:
        days = sorted({d for uu, d in data if uu == u}, key=lambda d: (d is not None, d or 0))
        prev, first = None, True
        for d in days:
            diff = None if (first or prev is None or d is None) else d - prev
            total += 1 if diff in (None, 1) else 0
            prev, first = d, False
    return total


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows)
def test_streak_days_matches_lag_rule(spark, data):
    df = spark.createDataFrame(
        [(u, None if d is None else D0 + dt.timedelta(days=d)) for u, d in data], "user_id string, date date"
    )
    got = activity.streak_days(df, start=None, end=None, date_col="date").collect()
    assert got[0][0] == lag_rule(data)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    xs=st.lists(st.one_of(st.none(), st.integers(min_value=-50, max_value=50)), min_size=1, max_size=60),
    probs=st.lists(st.floats(min_value=0, max_value=1), min_size=1, max_size=4),
)
def test_exact_percentiles_match_numpy(spark, xs, probs):
    df = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "id long, x double")
    got = {r["p"]: r["value"] for r in exact_percentiles(df, "x", probs).collect()}
    vals = np.array([x for x in xs if x is not None], dtype=float)
    if len(vals) == 0:
        assert got == {}
        return
    for p in probs:
        assert got[float(p)] == pytest.approx(float(np.quantile(vals, p)), rel=1e-9, abs=1e-9)
