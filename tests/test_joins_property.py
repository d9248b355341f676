"""Property test: a salted join equals the plain join for any threshold, salt
size and dimension with duplicates and missing keys."""

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cadence.operators import joins

keys = st.sampled_from(["a", "b", "c", "d", None])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    fact=st.lists(keys, min_size=1, max_size=60),
    dim=st.lists(st.tuples(st.sampled_from(["a", "b", "c", "e"]), st.sampled_from(["free", "basic"])), max_size=8),
    hot=st.integers(min_value=0, max_value=20),
    salt_rows=st.integers(min_value=1, max_value=9),
)
def test_salted_join_equals_plain(spark, fact, dim, hot, salt_rows):
    f = spark.createDataFrame([(i, k) for i, k in enumerate(fact)], "event_id long, user_id string")
    d = spark.createDataFrame(dim, "user_id string, subscription_type string")
    plain = rows(joins.enrich(f, d))
    assert rows(joins.enrich(f, d, strategy="salted", hot_min_rows=hot, salt_rows=salt_rows)) == plain
