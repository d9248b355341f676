"""Registered results must not depend on the session time zone."""

import pytest
from conftest import SF0001, rows

import __spark_entry__ as E

# physical partition ids are not values
SKIP = {"partition_profile", "partition_profile_metadata"}


@pytest.mark.parametrize("name", sorted(set(E._QUERIES) - SKIP))
def test_same_result_in_other_time_zones(spark, name):
    q = E._QUERIES[name]
    base = rows(q(spark, SF0001))
    try:
        for tz in ("America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert rows(q(spark, SF0001)) == base, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
