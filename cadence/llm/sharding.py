"""Weighted rendezvous hashing of record keys into shards, with dense slots.

Native DataFrame operations only.  Every (key, shard) pair has a stable hash
in (0, 1); a key goes to the shard with the largest ``-weight / ln(hash)``.
The key and the shards decide alone, so a new shard takes rows only into
itself and each shard's share follows its weight.

Slots number a shard's rows 0, 1, 2, ... in the order of a second hash of the
key.  One window per shard would put a shard in one task, so a shard is cut
into ranges of that hash: rows are numbered inside a range, and the counts of
earlier ranges (a few numbers per range) are added.  The number of ranges
follows the row count and never changes a slot.

Edge cases: a null text has no bytes and CRC 0; a null key hashes as the word
null; rows that repeat a key go to one shard and get their own slots, ordered
by size and CRC; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm._common import group_count, hash52, text_or_empty, unit_interval

ROWS_PER_RANGE = 100_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard that wins ``key``; ties go to the lower index."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    scored = F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda s: F.struct(
            (-F.element_at(w, s + 1) / F.log(unit_interval(hash52(key, s)))).alias("score"), (-s).alias("minus")
        ),
    )
    return (-F.array_max(scored)["minus"]).cast("int")


def shard_rows(
    docs: DataFrame,
    weights: Sequence[float],
    key_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    grown_weights: Sequence[float] | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Key, ``size`` (text bytes plus ``overhead``), ``text_crc32``, ``shard``,
    ``slot``, and ``grown_shard``: the shard under ``grown_weights`` (by
    default one more shard of the last weight)."""
    spark = docs.sparkSession
    grown = list(grown_weights) if grown_weights is not None else [*weights, weights[-1]]
    per_shard = docs.count() / len(weights)
    ranges = max(1, -(-group_count(per_shard * len(weights), rows_per_range, spark) // len(weights)))
    key, text = F.col(key_col), text_or_empty(text_col)
    rows = (
        docs.select(
            key.alias("key"),
            (F.octet_length(text).cast("bigint") + F.lit(overhead)).alias("size"),
            F.crc32(text).alias("crc"),
            rendezvous(key, weights).alias("shard"),
            rendezvous(key, grown).alias("grown_shard"),
            hash52(key, "slot").alias("place"),
        )
        .withColumn("range", F.shiftright(F.shiftright("place", 20) * F.lit(ranges), 32))
        .repartition("shard", "range")
    )
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "range")
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.count("key") + F.max("size") + F.max("crc") + F.max("place") + F.max("grown_shard")).alias("all"),
        )
        # always true; it keeps all columns in this branch, so that both
        # branches read one exchange and the texts are hashed once
        .where("all >= 0")
        .select(F.col("shard").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "range").orderBy("place", "key", "size", "crc")
    numbered = rows.withColumn("i", F.row_number().over(inside))
    # null-safe, so that no not-null filter evaluates the hashes once more
    same = F.col("shard").eqNullSafe(F.col("s")) & F.col("range").eqNullSafe(F.col("r"))
    return numbered.join(starts, same).select(
        F.col("key").alias(key_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("start") + F.col("i") - 1).alias("slot"),
        "grown_shard",
    )
