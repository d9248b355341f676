"""Partitions of equal weight for skewed keys.

Hash partitioning gives a partition whatever its keys weigh.  Here keys are
weighed once (rows per key, combined map-side) and assigned by weight:

* a key above ``1 / ITEMS`` of an even partition is an item of its own, cut into
  pieces of at most ``PIECE`` of an even partition; there can be at most
  ``ITEMS`` such keys per partition, whatever the table holds;
* all other keys are dealt by hash into ``ITEMS`` cells per partition, items too;
* items go longest first into the lightest partition.

With items of at most half an even partition no partition gets more than 1.5
times the mean.  What the driver sees is the items, a number that follows the
partitions and not the keys.  Rows then carry their partition's number and
``repartitionById`` sends them there; Spark knows that two tables sent by the
same numbers are co-located, so a join needs no further exchange.

A piece holds the rows of a key whose hash (of all columns, or of ``by``) falls
into it: rows that repeat in all these columns cannot be parted.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.plans.lineage import cut_lineage

ITEMS = 16
PIECE = 0.5


class KeyPlan(NamedTuple):
    """Where the rows of each key go."""

    key: str
    partitions: int
    cells: int
    large: DataFrame  # key, pieces, first item: at most ITEMS * partitions rows
    item_parts: tuple[int, ...]  # partition of each cell, then of each piece


def lightest_first(weights: Sequence[int], partitions: int) -> list[int]:
    """A partition per item: the heaviest item first into the lightest partition."""
    heap = [(0, p) for p in range(partitions)]
    part = [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        load, p = heap[0]
        part[i] = p
        heapq.heapreplace(heap, (load + weights[i], p))
    return part


def _cell(key: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(cells))


def plan_partitions(df: DataFrame, key: str, partitions: int | None = None) -> KeyPlan:
    """Weigh the keys of ``df`` (a null key is a key) and assign them to
    ``partitions`` (default: ``spark.sql.shuffle.partitions``)."""
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = ITEMS * partitions
    weights = cut_lineage(df.groupBy(F.col(f"`{key}`").alias("k")).agg(F.count(F.lit(1)).alias("n")), "table")
    total = weights.agg(F.sum("n")).first()[0] or 0
    even = max(1.0, total / partitions)
    is_large = F.col("n") > even / ITEMS
    found = weights.where(is_large).orderBy(F.col("n").desc(), "k").collect()  # at most ITEMS * partitions of them
    small = weights.where(~is_large).groupBy(_cell(F.col("k"), cells).alias("c")).agg(F.sum("n").alias("n"))
    items = [0] * cells
    for r in small.collect():
        items[r["c"]] = r["n"]
    large = []
    for k, n in found:
        pieces = max(1, -int(-n // (PIECE * even)))
        large.append((k, pieces, len(items)))
        items += [-(-n // pieces)] * pieces
    kind = weights.schema["k"].dataType.simpleString()
    table = spark.createDataFrame(large, f"k {kind}, pieces int, first_item int")
    return KeyPlan(key, partitions, cells, table, tuple(lightest_first(items, partitions)))


def _names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def _item_parts(plan: KeyPlan) -> Column:
    """The items' partitions as one constant array (folded when planning)."""
    return F.expr(f"cast(split('{','.join(map(str, plan.item_parts))}', ',') AS array<int>)")


def _with_large(df: DataFrame, plan: KeyPlan, key: Column, names: Sequence[str]) -> DataFrame:
    k, pieces, first = names
    large = F.broadcast(plan.large.select(F.col("k").alias(k), F.col("pieces").alias(pieces), F.col("first_item").alias(first)))
    return df.join(large, key.eqNullSafe(F.col(k)) & F.col(pieces).isNotNull(), "left")


def send(df: DataFrame, plan: KeyPlan, by: Sequence[str] | None = None, part: str = "part") -> DataFrame:
    """``df`` with ``part``, its rows in the partition of that number.  The rows
    of a cut key are dealt to its pieces by the hash of ``by`` (default: all
    columns): with the columns of a distinct count, equal values stay together."""
    names = _names(df, "k", "pieces", "first_item")
    _, pieces, first = names
    mixed = F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in (by or df.columns)])
    item = F.when(F.col(pieces).isNotNull(), F.col(first) + F.pmod(mixed, F.col(pieces))).otherwise(_cell(F.col(f"`{plan.key}`"), plan.cells))
    placed = _with_large(df, plan, F.col(f"`{plan.key}`"), names)
    placed = placed.select(*[F.col(f"`{c}`") for c in df.columns], F.element_at(_item_parts(plan), (item + 1).cast("int")).alias(part))
    return placed.repartitionById(plan.partitions, F.col(part))


def send_lookup(dim: DataFrame, plan: KeyPlan, part: str = "part") -> DataFrame:
    """``dim`` with ``part``: each row once in every partition that holds rows
    of its key."""
    names = _names(dim, "k", "pieces", "first_item")
    _, pieces, first = names
    parts = _item_parts(plan)
    cell = F.element_at(parts, (_cell(F.col(f"`{plan.key}`"), plan.cells) + 1).cast("int"))
    all_parts = F.when(F.col(pieces).isNotNull(), F.array_distinct(F.slice(parts, F.col(first) + 1, F.col(pieces)))).otherwise(F.array(cell))
    placed = _with_large(dim, plan, F.col(f"`{plan.key}`"), names)
    placed = placed.select(*[F.col(f"`{c}`") for c in dim.columns], F.explode(all_parts).alias(part))
    return placed.repartitionById(plan.partitions, F.col(part))


def balanced_join(
    events: DataFrame,
    users: DataFrame,
    cols: Sequence[str] = ("subscription_type",),
    key: str = "user_id",
    plan: KeyPlan | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Left-outer lookup like ``joins.enrich`` over partitions of equal weight:
    one exchange per side, none in the join.  A ``plan`` made before (of a table
    with the same keys) can be given; its weights then only steer the balance."""
    plan = plan or plan_partitions(events, key, partitions)
    (part,) = _names(events, "part")
    fact = send(events, plan, part=part)
    slim = users.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_d{i}") for i, c in enumerate(cols)])
    dim = send_lookup(slim, plan._replace(key="_k"), part="_part")
    j = fact.join(dim.hint("merge"), (F.col(f"`{key}`") == F.col("_k")) & (F.col(f"`{part}`") == F.col("_part")), "left_outer")
    return j.select(*[fact[f"`{c}`"] for c in events.columns], *[F.col(f"_d{i}").alias(c) for i, c in enumerate(cols)])


def balanced_count_distinct(df: DataFrame, key: str, value: str, plan: KeyPlan | None = None, count_name: str = "count") -> DataFrame:
    """Different non-null ``value`` per ``key``: counted where the rows lie,
    the pieces of a cut key (which share no value) added up."""
    plan = plan or plan_partitions(df, key)
    slim = df.select(F.col(f"`{key}`").alias("k0"), F.col(f"`{value}`").alias("v0"))
    placed = send(slim, plan._replace(key="k0"), by=["v0"])
    pieces = placed.groupBy("part", "k0").agg(F.count_distinct("v0").alias("n"))
    return pieces.groupBy(F.col("k0").alias(key)).agg(F.sum("n").cast("bigint").alias(count_name))


def partition_loads(placed: DataFrame, part: str = "part") -> DataFrame:
    """``(part, count)`` of rows that ``send`` has placed."""
    return placed.groupBy(part).agg(F.count(F.lit(1)).alias("count"))
