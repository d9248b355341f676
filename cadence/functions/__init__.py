"""Column-expression helpers.  All return ``pyspark.sql.Column`` built from
built-in functions, so they stay inside whole-stage codegen."""

from cadence.functions.timecols import (
    days_between,
    epoch_seconds,
    period_start,
    whole_second_gap,
)
from cadence.functions.hashing import lehmer, det_salt, uniform_int
from cadence.functions.versions import version_part

__all__ = [
    "days_between",
    "epoch_seconds",
    "period_start",
    "whole_second_gap",
    "lehmer",
    "det_salt",
    "uniform_int",
    "version_part",
]
