"""Plan guards over every registered query."""

import re

import pytest
from conftest import SF0001

import __spark_entry__ as E
from cadence.plans.inspect import plan_text

FORBIDDEN = {
    "CartesianProduct": "cross join",
    "BroadcastNestedLoopJoin": "non-equi / cross join",
    "BatchEvalPython": "row-at-a-time Python UDF",
    "ArrowEvalPython": "Python UDF",
    "FlatMapGroupsInPandas": "Python group function",
    "MapInPandas": "Python partition function",
}


@pytest.mark.parametrize("name", sorted(E._QUERIES))
def test_no_cross_joins_or_python_in_plan(spark, name):
    df = E._QUERIES[name](spark, SF0001)
    txt = plan_text(df, "simple")
    found = [f"{op} ({why})" for op, why in FORBIDDEN.items() if op in txt]
    assert not found, found


def test_scans_read_only_needed_columns(spark):
    """Queries that need few columns must not read whole rows."""
    narrow = {
        "dau_series": {"ts", "user_id"},
        "key_frequency": {"o_custkey"},
        "count_salted": {"o_custkey", "o_orderkey"},
        "activity_by_hour": {"ts", "user_id"},
        "top_users": {"user_id"},
        "duration_band": {"value"},
    }
    for name, cols in narrow.items():
        txt = plan_text(E._QUERIES[name](spark, SF0001), "simple")
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", txt)
        read = {f.split(":")[0] for s in schemas for f in s.split(",")}
        assert read == cols, (name, read)
