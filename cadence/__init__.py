"""cadence — product-analytics operators on Spark DataFrames.

Every operator is a function from DataFrame(s) to a DataFrame, built from
Spark's own DataFrame/SQL machinery so Catalyst can prune, push down and
plan it.  Sub-packages:

* ``sources``   readers, writers, driver-table bindings, data generator
* ``functions`` column-expression helpers (time, hashing, versions)
* ``operators`` the analytics jobs (activity, sessions, joins, skew, quality)
* ``plans``     plan inspection, join-strategy and lineage helpers
* ``streaming`` incremental variants of the batch jobs
"""

from cadence.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
