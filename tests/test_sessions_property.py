"""Property test: the chunked session plan equals a direct Python
computation, on random data with ties and null timestamps."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cadence.operators import sessions

T0 = dt.datetime(2024, 5, 1)

event = st.tuples(
    st.sampled_from(["a", "b", "c", None]),
    st.one_of(st.none(), st.integers(min_value=0, max_value=20_000)),
)


def brute_force(data, gap):
    """Session number and step per event id, straight from the definition."""
    out = {}
    by_user = {}
    for eid, (u, s) in enumerate(data):
        by_user.setdefault(u, []).append((eid, s))
    for u, evs in by_user.items():
        evs.sort(key=lambda e: (e[1] is not None, e[1] if e[1] is not None else 0, e[0]))
        seq, step, prev = 0, 0, None
        for i, (eid, s) in enumerate(evs):
            diff = s - prev if (i > 0 and prev is not None and s is not None) else 0
            if i > 0 and diff > gap:
                seq, step = seq + 1, 0
            step += 1
            out[eid] = (None if u is None else f"{u}_{seq}", step, diff)
            prev = s
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(event, min_size=1, max_size=40),
    gap=st.sampled_from([0, 60, 1800]),
    chunk=st.sampled_from([1, 7, 300, 5000]),
)
def test_chunked_sessions_match_definition(spark, data, gap, chunk):
    rows = [(i, u, None if s is None else T0 + dt.timedelta(seconds=s)) for i, (u, s) in enumerate(data)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, timestamp timestamp")
    kw = dict(gap_seconds=gap, tiebreak=("event_id",), with_step=True)
    got = sessions.session_core(df, chunk_seconds=chunk, **kw).collect()
    want = brute_force(data, gap)
    for r in got:
        sid = None if r["user_id"] is None else f"{r['user_id']}_{r['session_seq']}"
        assert (sid, r["session_step"], r["time_diff"]) == want[r["event_id"]], (r, want[r["event_id"]])
