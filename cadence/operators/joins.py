"""Fact-to-dimension joins with an explicit strategy, and dimensional counts.

* ``enrich``          left-outer lookup of dimension attributes (sort-merge,
                      checked broadcast, shuffle-hash, salted, or auto)
* ``activity_by``     events counted by dimension attributes (inner join)
* ``prepare_layout`` / ``layout_join`` / ``bucketed_join``  co-located join
                      without a shuffle

The dimension here (user metadata) is *not* assumed unique per key: a
duplicated key duplicates the fact rows it matches, as a join does.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.skew import hot_keys
from cadence.plans.strategy import DEFAULT_BROADCAST_BYTES, apply_strategy, input_bytes, measured_size
from cadence.session import scratch_path, scratch_table

SALT_ROWS = 1_000_000


def _salted_join(fact: DataFrame, dim: DataFrame, key: str, cols: Sequence[str], salt_rows: int, hot_min_rows: int) -> DataFrame:
    """Left-outer lookup with the rows of hot keys spread over as many salts
    as the key's own size asks for, and the hot keys' dimension rows repeated
    once per salt.  Null keys match nothing and are spread by the row's hash."""
    hot = hot_keys(fact, key, hot_min_rows).select(
        F.col(key).alias("_hk"), F.greatest(F.lit(2), F.ceil(F.col("n") / salt_rows)).cast("bigint").alias("_ns")
    )
    salts = F.broadcast(hot)  # bounded by construction, see skew.hot_keys
    row_hash = F.xxhash64(*[fact[c] for c in fact.columns])
    spread = (
        F.when(fact[key].isNull(), row_hash)
        .when(F.col("_ns").isNotNull(), F.pmod(row_hash, F.col("_ns")))
        .otherwise(F.lit(0))
    )
    fact_s = fact.join(salts, fact[key] == F.col("_hk"), "left").withColumn("_salt", spread.cast("bigint"))
    fact_s = fact_s.select(*[F.col(f"`{c}`") for c in fact.columns], "_salt")
    # dimension attributes travel under private names, so an attribute that
    # the events also carry cannot make the output ambiguous
    dim_t = dim.select(F.col(key).alias("_dk"), *[F.col(c).alias(f"_d{i}") for i, c in enumerate(cols)])
    all_salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_ns") - 1, F.lit(0)))
    dim_s = dim_t.join(salts, F.col("_dk") == F.col("_hk"), "left").withColumn("_dsalt", F.explode(all_salts)).drop("_hk", "_ns")
    j = fact_s.join(dim_s.hint("merge"), (fact_s[key] == F.col("_dk")) & (F.col("_salt") == F.col("_dsalt")), "left_outer")
    return j.select(*[F.col(f"`{c}`") for c in fact.columns], *[F.col(f"_d{i}").alias(c) for i, c in enumerate(cols)])


def enrich(
    events: DataFrame,
    users: DataFrame,
    cols: Sequence[str] = ("subscription_type",),
    key: str = "user_id",
    strategy: str = "merge",
    dedupe: bool = False,
    max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
    salt_rows: int = SALT_ROWS,
    hot_min_rows: int | None = None,
) -> DataFrame:
    """All event columns + ``cols`` from ``users``; unmatched events get nulls.

    ``dedupe`` keeps one dimension row per key, the least in ``cols``, for
    dimensions known to carry accidental duplicates.

    ``strategy="salted"``: keys with more than ``hot_min_rows`` events (default
    ``salt_rows``) get one salt per ``salt_rows`` of their events, so a key
    holding a third of the data spreads over as many reducers as it needs.
    """
    dim = users.select(key, *cols)
    if dedupe:
        packed = F.struct(*[F.col(c) for c in cols])
        dim = dim.groupBy(key).agg(F.min(packed).alias("_first")).select(key, *[F.col(f"_first.{c}").alias(c) for c in cols])
    if strategy == "salted":
        return _salted_join(events, dim, key, cols, salt_rows, salt_rows if hot_min_rows is None else hot_min_rows)
    dim_h = apply_strategy(dim, strategy, max_broadcast_bytes)
    j = events.join(dim_h, events[key] == dim_h[key], "left_outer")
    return j.select(*[events[c] for c in events.columns], *[dim_h[c] for c in cols])


def activity_by(
    events: DataFrame,
    users: DataFrame,
    dims: Sequence[str] = ("country", "subscription_type"),
    key: str = "user_id",
    strategy: str = "auto",
    cluster_by: str | None = None,
    max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
    count_name: str = "count",
) -> DataFrame:
    """Event counts per dimension attributes: ``(*dims, count)``; inner join,
    so events without a dimension row (and null keys) are not counted.

    The events are first counted per key (partial aggregation runs map-side),
    so the join sees one row per user instead of one per event and a very busy
    user costs one row; the per-key counts are then multiplied through the
    join — the same number a row-level join gives.  ``cluster_by``
    hash-distributes the (small) result by that column.
    """
    dim_h = apply_strategy(users.select(key, *dims), strategy, max_broadcast_bytes)
    fact = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    out = fact.join(dim_h, key, "inner").groupBy(*dims).agg(F.sum("_n").cast("bigint").alias(count_name))
    return out.repartition(cluster_by) if cluster_by else out


BUCKET_BYTES = 1 << 30  # most bytes of fact files per bucket for buckets="auto"
BUCKET_PAYLOAD = 128 << 20  # target payload of a bucket's rows, which one task sorts
HOT_BUCKETS = 2  # a key with this many buckets' worth of rows is stored aside


def auto_buckets(fact: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """One bucket per ``bucket_bytes`` of the files ``fact`` reads.  Raises
    when it reads no files, or needs more buckets than Spark allows: then the
    bucket size (or the layout) is for the caller to choose."""
    size = input_bytes(fact)
    if size is None:
        raise ValueError("no input files to size buckets from; pass buckets=")
    n = max(1, -(-size // bucket_bytes))
    most = int(fact.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    if n > most:
        raise ValueError(f"{n} buckets of {bucket_bytes} bytes are over spark.sql.sources.bucketing.maxBuckets = {most}")
    return n


def payload_buckets(df: DataFrame, bucket_payload: int = BUCKET_PAYLOAD) -> int:
    """One bucket per ``bucket_payload`` bytes of the rows of ``df``, measured:
    a task sorts a bucket's rows as they are, however small their files.  At
    most as many as Spark allows; from there on buckets grow."""
    _, size = measured_size(df)
    most = int(df.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return max(1, min(most, -(-size // bucket_payload)))


def write_bucketed(df: DataFrame, key: str, buckets: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """Store ``df`` as a table bucketed and sorted by ``key`` in the shared
    folder, and return a reader of it.  The rows are dealt by the bucket's own
    hash first, so a task writes one bucket: at most one file per bucket and
    partition value.  The table is dropped by ``session.clean_scratch``."""
    spark = df.sparkSession
    path = scratch_path(spark, "bucketed")
    table = scratch_table(spark, "bkt")
    w = df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
    w = w.bucketBy(buckets, key).sortBy(key)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(table)
    return spark.table(table)


class Layout(NamedTuple):
    """Events stored for joins on a key: bucketed, and hot keys aside."""

    bucketed: DataFrame
    aside: DataFrame
    buckets: int
    key: str


def prepare_layout(
    events: DataFrame,
    key: str = "user_id",
    buckets: int | str = "auto",
    partition_by: Sequence[str] = ("date",),
    hot_min_rows: int | None = None,
) -> Layout:
    """Preprocessing for downstream joins and date-range jobs: store the
    events partitioned by ``partition_by`` (partition pruning for ranges) and
    bucketed + sorted by ``key`` inside each partition (joins on ``key`` need
    no shuffle); ``buckets="auto"`` takes one per 128 MiB of row payload, at
    least one per GiB of files.  Rows of keys larger than ``HOT_BUCKETS`` even buckets (or
    ``hot_min_rows``), and rows without key, would fill one bucket; they are
    stored aside, unbucketed, and joined salted."""
    n = max(auto_buckets(events), payload_buckets(events)) if buckets == "auto" else int(buckets)
    limit = hot_min_rows if hot_min_rows is not None else HOT_BUCKETS * (events.count() // n + 1)
    hot = F.broadcast(hot_keys(events, key, limit).select(F.col(key).alias("_hk")))
    tagged = events.join(hot, events[key] == F.col("_hk"), "left")
    is_aside = F.col("_hk").isNotNull() | F.col(key).isNull()
    columns = [F.col(f"`{c}`") for c in events.columns]
    bucketed = write_bucketed(tagged.where(~is_aside).select(*columns), key, n, partition_by)
    path = scratch_path(events.sparkSession, "aside")
    w = tagged.where(is_aside).select(*columns).write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    aside = events.sparkSession.read.schema(bucketed.schema).parquet(path)
    return Layout(bucketed, aside, n, key)


def layout_join(layout: Layout, users: DataFrame, cols: Sequence[str] = ("subscription_type",), salt_rows: int = SALT_ROWS) -> DataFrame:
    """``enrich`` of events stored by ``prepare_layout`` with a dimension
    bucketed the same way: matching buckets are joined in place."""
    key, laid_out = layout.key, layout.bucketed
    dim = users.select(key, *cols).where(F.col(key).isNotNull())  # null keys match nothing, and would fill one bucket
    dim = write_bucketed(dim, key, layout.buckets)
    j = laid_out.join(dim.hint("merge"), laid_out[key] == dim[key], "left_outer")
    even = j.select(*[laid_out[c] for c in laid_out.columns], *[dim[c] for c in cols])
    return even.unionByName(_salted_join(layout.aside, users.select(key, *cols), key, cols, salt_rows, salt_rows))


def bucketed_join(
    events: DataFrame,
    users: DataFrame,
    cols: Sequence[str] = ("subscription_type",),
    key: str = "user_id",
    buckets: int | str = "auto",
) -> DataFrame:
    """``enrich`` over bucketed copies of both sides (same bucket count,
    ``"auto"`` = what the larger side's payload asks for): the sort-merge join
    reads matching buckets directly, with no exchange on either side."""
    if buckets == "auto":
        buckets = max(auto_buckets(events), payload_buckets(events), payload_buckets(users.select(key, *cols)))
    return layout_join(prepare_layout(events, key, buckets, partition_by=()), users, cols).select(
        *[F.col(f"`{c}`") for c in events.columns], *cols
    )
