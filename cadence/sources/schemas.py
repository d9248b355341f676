"""Explicit schemas of the two product-analytics tables.

Readers always pass a schema (no inference).  Partition columns (``date``,
``country``) are discovered from ``col=value`` directory names and typed by
the schema; Spark moves them to the end, so always select by name.
"""

from pyspark.sql import types as T

INTERACTIONS = T.StructType(
    [
        T.StructField("user_id", T.StringType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("action_type", T.StringType(), True),
        T.StructField("page_id", T.StringType(), True),
        T.StructField("duration_ms", T.LongType(), True),
        T.StructField("app_version", T.StringType(), True),
        T.StructField("date", T.DateType(), True),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("user_id", T.StringType(), True),
        T.StructField("join_date", T.DateType(), True),
        T.StructField("country", T.StringType(), True),
        T.StructField("device_type", T.StringType(), True),
        T.StructField("subscription_type", T.StringType(), True),
    ]
)

# The value domains of the generated tables.
ACTION_TYPES = ["page_view", "edit", "create", "delete", "share"]
COUNTRIES = ["US", "UK", "CA", "AU", "DE", "FR", "JP", "IN", "BR", "MX"]
DEVICE_TYPES = ["iPhone", "iPad", "Android Phone", "Android Tablet", "Windows", "Mac"]
SUBSCRIPTION_TYPES = ["free", "basic", "premium", "enterprise"]
