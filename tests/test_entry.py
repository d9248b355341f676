import os
import sys

from conftest import ROOT, SF0001

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402

# Queries without a SQL twin, and why.
NO_ORACLE = {
    "partition_profile": "physical partition ids have no SQL meaning; partition_totals has the sums",
    "partition_profile_metadata": "as above",
}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["session_id", "session_duration_minutes", "action_count"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_a_reason():
    assert set(E._QUERIES) - set(E._ORACLE) == set(NO_ORACLE)
    assert set(E.oracle_sql()) <= set(E.queries())


def test_partition_profile_adds_up(spark):
    from cadence.sources.tables import interactions

    prof = E._QUERIES["partition_profile"](spark, SF0001).collect()
    assert sum(r["count"] for r in prof) == interactions(spark, SF0001).count()


def test_all_queries_match_oracle_at_sf0001(spark):
    from oracle_check import compare

    bad = [(s, n, d) for s, n, d in compare(spark, SF0001, list(E._QUERIES)) if s not in ("OK", "ROWS")]
    assert not bad, bad


def test_count_equals_collected_rows_for_every_query(spark):
    """The driver may count or collect; pruning must not change or break either."""
    bad = []
    for name, q in E._QUERIES.items():
        df = q(spark, SF0001)
        c, r = df.count(), len(df.collect())
        if c != r:
            bad.append((name, c, r))
    assert not bad, bad
