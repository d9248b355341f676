"""Semi-join reduction: fact rows without a partner are found before the shuffle.

Where a dimension lacks most keys (one subscription, one country), a sort-merge
join ships every event only to drop it, or to give it nulls.  Here the
dimension's keys become a Bloom filter, and only events that it lets through are
shuffled; the rest are dropped (inner) or get their nulls where they lie
(left outer).  The join decides afterwards, so the filter never changes a result.

The filter is a table of 64-bit words, stored as blocks of 4 KB.  A key sets ``k``
bits of one word, so a row's probe is one lookup in a broadcast hash join and one
``AND``, all inside generated code.  Words are merged by ``bit_or``: map-side while
building, and between filters of the same geometry (``merge_filters``), so that a
day's new keys can be added without reading the old ones.

The broadcast is bounded by construction: 8 bytes a word, as many words as the
number of keys and the asked rate of false positives need, ``max_bytes`` at most.
More keys than that give a fuller filter; one that would let through over half of
the foreign keys isn't built, and the join runs without it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.plans.lineage import cut_lineage
from cadence.plans.strategy import apply_strategy, is_derived

BLOCK_WORDS = 512
FALSE_POSITIVES = 0.01
MAX_BYTES = 64 * 1024 * 1024
USELESS = 0.5  # a filter with more false positives than this isn't worth its probe
_MOST_BITS = 8
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_PLAIN = (*_INTEGERS, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


class KeyFilter(NamedTuple):
    """``(block, words)`` rows, and what a probe has to know."""

    blocks: DataFrame
    n_words: int
    bits: int
    dtype: T.DataType


def false_positive_rate(keys: int, n_words: int, bits: int) -> float:
    """Share of foreign keys that a filter of ``keys`` keys lets through: the
    number of keys in a word is Poisson, each has set ``bits`` of its 64 bits."""
    load = keys / n_words
    reach = 12 * math.sqrt(load) + 20  # nothing to speak of lies beyond
    rate = 0.0
    for c in range(max(0, int(load - reach)), int(load + reach)):
        weight = math.exp(c * math.log(load) - load - math.lgamma(c + 1)) if load > 0 else float(c == 0)
        rate += weight * (1 - (63 / 64) ** (bits * c)) ** bits
    return rate


def geometry(keys: int, false_positives: float = FALSE_POSITIVES, max_bytes: int = MAX_BYTES) -> tuple[int, int]:
    """``(n_words, bits)`` of the smallest filter, in whole blocks, that meets the
    rate, or the best one of ``max_bytes``."""
    most = max(1, max_bytes // (8 * BLOCK_WORDS))
    blocks = min(most, max(1, keys // (64 * BLOCK_WORDS)))  # a word of more than 64 keys is full
    while True:
        n_words = blocks * BLOCK_WORDS
        rates = [false_positive_rate(keys, n_words, b) for b in range(1, _MOST_BITS + 1)]
        best = min(rates)
        if best <= false_positives or blocks == most:
            # the fewest bits that do: every bit costs each probed row a shift
            return n_words, 1 + next(i for i, r in enumerate(rates) if r <= max(best, false_positives))
        blocks = min(most, max(blocks + 1, blocks * 9 // 8))


def _hashed_type(dtype: T.DataType) -> T.DataType:
    if not isinstance(dtype, _PLAIN):
        raise ValueError(f"no key filter on {dtype.simpleString()}: equal values must hash alike")
    return T.LongType() if isinstance(dtype, _INTEGERS) else dtype


def _probe(key: Column, dtype: T.DataType, n_words: int, bits: int) -> tuple[Column, Column]:
    """The word of a key and its bits there."""
    value = key.cast(dtype)
    spots = F.xxhash64(value, F.lit(1))
    mask = F.lit(0).cast("bigint")
    for i in range(bits):
        spot = F.shiftright(spots, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), spot))
    return F.pmod(F.xxhash64(value), F.lit(n_words).cast("bigint")), mask


def _in_blocks(words: DataFrame, n_words: int) -> DataFrame:
    """``(word, mask)`` rows as dense blocks; every word is there, set or not."""
    every = words.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    merged = words.unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    entry = F.struct(F.col("word"), F.col("mask"))
    grouped = merged.groupBy(F.shiftright("word", int(math.log2(BLOCK_WORDS))).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return cut_lineage(grouped.select("block", F.col("entries.mask").alias("words")), "table")


def build_filter(
    dim: DataFrame,
    key: str = "user_id",
    false_positives: float = FALSE_POSITIVES,
    max_bytes: int = MAX_BYTES,
    expected_keys: int | None = None,
) -> KeyFilter:
    """The filter of ``dim``'s keys (nulls match nothing and set nothing).
    ``expected_keys`` fixes the geometry for filters that are to be merged;
    otherwise the different keys are counted."""
    column = F.col(f"`{key}`")
    dtype = _hashed_type(dim.select(column).schema[0].dataType)
    keys = dim.select(column.alias("key")).where("key IS NOT NULL")
    n = expected_keys if expected_keys is not None else keys.agg(F.count_distinct("key")).first()[0]
    n_words, bits = geometry(n, false_positives, max_bytes)
    word, mask = _probe(F.col("key"), dtype, n_words, bits)
    return KeyFilter(_in_blocks(keys.select(word.alias("word"), mask.alias("mask")), n_words), n_words, bits, dtype)


def merge_filters(*filters: KeyFilter) -> KeyFilter:
    """The filter of all keys of ``filters``, which share one geometry."""
    first = filters[0]
    if any(f[1:] != first[1:] for f in filters):
        raise ValueError("filters of different geometry can't be merged: build them with the same expected_keys")
    parts = [f.blocks.select("block", F.posexplode("words").alias("at", "mask")) for f in filters]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    words = rows.select((F.col("block") * BLOCK_WORDS + F.col("at")).alias("word"), "mask")
    return first._replace(blocks=_in_blocks(words, first.n_words))


def _new_name(name: str, taken: Sequence[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _split(df: DataFrame, key: str, flt: KeyFilter, how: str) -> DataFrame:
    column = df[f"`{key}`"]
    if _hashed_type(df.select(column).schema[0].dataType) != flt.dtype:
        raise ValueError(f"the filter holds {flt.dtype.simpleString()} keys, {key} is of another type")
    word, mask = _probe(column, flt.dtype, flt.n_words, flt.bits)
    w, m = _new_name("_word", df.columns), _new_name("_mask", df.columns)
    probed = df.select("*", word.alias(w), mask.alias(m))  # hashed once per row
    at = F.col(w).bitwiseAND(F.lit(BLOCK_WORDS - 1)).cast("int")
    lacking = F.bitwise_not(F.get(flt.blocks["words"], at)).bitwiseAND(F.col(m))
    block = F.shiftright(F.col(w), int(math.log2(BLOCK_WORDS)))
    may_hold = (block == flt.blocks["block"]) & probed[f"`{key}`"].isNotNull() & (lacking == 0)
    # 8 bytes a word, n_words bounded by geometry()
    return probed.join(F.broadcast(flt.blocks), may_hold, how).drop(w, m)


def candidates(df: DataFrame, key: str, flt: KeyFilter) -> DataFrame:
    """Rows whose key the filter may hold: all that it does, few others."""
    return _split(df, key, flt, "left_semi")


def strangers(df: DataFrame, key: str, flt: KeyFilter) -> DataFrame:
    """Rows whose key the filter surely doesn't hold, null keys included."""
    return _split(df, key, flt, "left_anti")


def reduced_join(
    events: DataFrame,
    users: DataFrame,
    cols: Sequence[str] = ("subscription_type",),
    key: str = "user_id",
    how: str = "left_outer",
    strategy: str = "merge",
    false_positives: float = FALSE_POSITIVES,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``joins.enrich`` (or its inner form) for dimensions that lack many keys:
    only events that the filter lets through reach the join.  The outer form reads
    ``events`` twice, which is cheaper than to shuffle them; they should come from
    files.  Building the DataFrame counts the keys and writes the filter."""
    if how not in ("left_outer", "inner"):
        raise ValueError("how must be left_outer or inner")
    dim = users.select(key, *cols)
    if is_derived(dim):
        dim = cut_lineage(dim, "table")
    keys = dim.agg(F.count_distinct(F.col(f"`{key}`"))).first()[0]
    useful = false_positive_rate(keys, *geometry(keys, false_positives, max_bytes)) <= USELESS
    flt = build_filter(dim, key, false_positives, max_bytes, keys) if useful else None
    fact = candidates(events, key, flt) if flt else events
    dim_h = apply_strategy(dim, strategy)
    joined = fact.join(dim_h, fact[f"`{key}`"] == dim_h[f"`{key}`"], how)
    out = joined.select(*[fact[f"`{c}`"] for c in events.columns], *[dim_h[f"`{c}`"] for c in cols])
    if how == "inner" or flt is None:
        return out
    nulls = [F.lit(None).cast(dim.schema[c].dataType).alias(c) for c in cols]
    return out.union(strangers(events, key, flt).select(*[F.col(f"`{c}`") for c in events.columns], *nulls))
