"""App-version strings ``major.minor.patch``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions.util import as_col

_PARTS = {"major": 1, "minor": 2, "patch": 3}


def version_part(version, part: str) -> Column:
    """Numeric part of a dotted version; null when missing or non-numeric."""
    idx = _PARTS[part]
    return F.try_element_at(F.split(as_col(version), r"\."), F.lit(idx)).try_cast("int")
