"""URL rules by a Bloom filter cascade: exact membership without joins.

Native DataFrame operations only.  A url's candidate keys are its host and
parent domains, each with those beginnings of the path that are as long as some
rule's path.  A rule fits a url exactly if its key is one of the candidates, so
judging a url asks for each candidate whether it is listed.

A cascade answers that.  Its first level is a Bloom filter of the listed keys.
The second holds the keys of the corpus that are not listed but pass the first;
the third holds the listed keys that pass the second, and so on, until a level
lets nothing wrong through.  A key is asked level by level: the first level that
does not hold it decides.  Over the key universe it was built for (all candidate
keys of all urls, and the listed keys) the answer is exact.  There is one
cascade for the keys to allow and one for those to block.

A level is a table of bit words: set positions are combined map-side with
``bit_or``, words are gathered into chunks and the chunks into one row, which the
judging scan reads as a scalar subquery.  Its size follows from the rules, not
from the corpus: the first level has at most ``1.44 * MOST_HASHES`` bits a listed key, and
the first levels' rate makes later ones hold few keys of the corpus.  A level
beyond ``max_filter_bytes`` raises.

Edge cases: a url that is null or has no ``://`` has an empty host and path; a
host may be empty; rules without host or path text match nothing; rules that
repeat count once, and where a key is both allowed and blocked it is blocked;
of the rules that fit, the longest text wins, then the longer host; without a
fitting rule the verdict is ``allow``, as no listed key covers the url; rows that
repeat an id are judged by their own url; an empty table gives no rows; extra
columns are ignored.  A url has (labels of the longest rule host) x (different
lengths of rule paths) candidates at most.  Hosts and paths of any length are compared only by their
last labels and first characters, as many as the longest rule has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.plans.lineage import cut_lineage

RULES = "host string, path string, verdict string"
LATER_RATE = 0.5
MOST_HASHES = 10
LEVELS = 64
CHUNK = 4096  # words that one row gathers
MAX_FILTER_BYTES = 256 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty where there are none."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Level(NamedTuple):
    """One Bloom filter: its 64-bit words in chunks (one row), and its shape.
    All bits of a key lie in one word."""

    words: DataFrame
    size: int
    hashes: int
    seed: int


def _place(key: str, size: int, hashes: int, seed: int) -> tuple[str, str]:
    """SQL of a key's word and its bits in there (six bits of a hash choose one)."""
    bits = [f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, {seed}), {6 * j}) & 63 AS int))" for j in range(hashes)]
    return f"pmod(xxhash64({seed}, {key}), {size}L)", " | ".join(bits)


def build_level(keys: DataFrame, n: int, rate: float, seed: int, max_filter_bytes: int = MAX_FILTER_BYTES) -> Level:
    """A Bloom filter of the ``n`` keys (column ``key``) for a rate of about
    ``rate`` false positives."""
    hashes = min(MOST_HASHES, max(1, round(math.log2(1 / rate))))
    size = math.ceil(max(1, n) * hashes / math.log(2) / 64)
    if size * 8 > max_filter_bytes:
        raise ValueError(f"a level of {size * 8} bytes is over max_filter_bytes = {max_filter_bytes}")
    word, mask = map(F.expr, _place("key", size, hashes, seed))
    # every word, set or not, so that a word's place in its chunk is its number
    every = keys.sparkSession.range(size).select(F.col("id").alias("w"), F.expr("0L").alias("word"))
    words = keys.select(word.alias("w"), mask.alias("word")).union(every).groupBy("w").agg(F.bit_or("word").alias("word"))
    gathered = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("w", value))), lambda s: s[value])
    chunks = words.groupBy(F.floor(F.col("w") / CHUNK).alias("c")).agg(gathered("word").alias("chunk")).withColumnRenamed("c", "w")
    return Level(cut_lineage(chunks.agg(gathered("chunk").alias("words")), "table"), size, hashes, seed)


def holds(level: Level, key: str) -> Column:
    """Whether all bits of ``key`` (SQL of a string) are set."""
    at, mask = _place(key, level.size, level.hashes, level.seed)
    chunk = F.element_at(level.words.scalar(), F.expr(f"cast({at} div {CHUNK} + 1 AS int)"))
    word = F.element_at(chunk, F.expr(f"cast({at} % {CHUNK} + 1 AS int)"))
    mask = F.expr(mask)
    return word.bitwiseAND(mask) == mask


class Cascade(NamedTuple):
    levels: Sequence[Level]

    def lists(self, key: str) -> Column:
        """Whether ``key`` (SQL of a string) is listed; exact for keys of the universe."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            verdict = F.when(~holds(self.levels[i], key), F.lit(i % 2 == 1)).otherwise(verdict)
        return verdict


def build_cascade(listed: DataFrame, universe: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES, seed: int = 0) -> Cascade:
    """Cascade of the ``listed`` keys over ``universe`` (both: column ``key``,
    different values).  Only keys that pass a level by mistake go on to the
    next, so what is written and joined here shrinks level by level."""
    inside, n = listed, listed.count()
    if not n:
        return Cascade([])
    others = universe.count()
    rate = min(LATER_RATE, math.sqrt(0.5) * n / max(1, others))
    levels: list[Level] = []
    wrong = universe
    while n:
        if len(levels) == LEVELS:
            raise RuntimeError(f"no exact cascade in {LEVELS} levels")
        level = build_level(inside, n, rate, seed + len(levels), max_filter_bytes)
        levels.append(level)
        passed = wrong.filter(holds(level, "key"))
        if len(levels) == 1:
            passed = passed.join(listed, "key", "left_anti")
        # what this level lets through by mistake is what the next one holds
        inside, wrong = cut_lineage(passed, "table"), inside
        n, rate = inside.count(), LATER_RATE
    return Cascade(levels)


def _suffixes(host: Column, labels: int) -> Column:
    """The host's last 1 to ``labels`` labels, as many as it has."""
    parts = F.split(host, r"\.")
    counts = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels)))
    return F.transform(counts, lambda j: F.array_join(F.slice(parts, -j, j), "."))


def _prefixes(path: Column, lengths: Sequence[int]) -> Column:
    cut = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    return F.filter(cut, lambda p: p.isNotNull())


def candidate_keys(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """Array of (``size``, ``host_size``, ``key``): what rules could fit."""
    return F.flatten(
        F.transform(
            _suffixes(host, labels),
            lambda h: F.transform(
                _prefixes(path, lengths),
                lambda p: F.struct(
                    (F.length(h) + F.length(p)).alias("size"), F.length(h).alias("host_size"), F.concat(h, p).alias("key")
                ),
            ),
        )
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """Id, ``host``, ``path``, ``rule`` (the longest that fits, or null) and
    ``verdict`` per row.  ``rules`` has ``host``, ``path`` and ``verdict``."""
    host, path = url_parts(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    known = rules.filter("host != '' AND path != '' AND verdict IN ('allow', 'block')").select(
        "host", "path", F.concat("host", "path").alias("key"), (F.col("verdict") == "block").alias("block")
    )
    known = cut_lineage(known.groupBy("key", "host", "path").agg(F.max("block").alias("block")), "table")
    shape = known.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")
    ).first()
    out = [F.col("id").alias(id_col), "host", "path"]
    if shape["labels"] is None:
        return rows.select(*out, F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    labels, lengths = shape["labels"], shape["lengths"]
    # the complete universe: candidates of the different hosts and path heads
    heads = rows.select(F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, labels), ".").alias("tail"), F.substring("path", 1, lengths[-1]).alias("path"))
    heads = heads.distinct().select(F.array_join(F.reverse(F.split("tail", r"\.")), ".").alias("host"), "path")
    keys = heads.select(F.explode(candidate_keys(F.col("host"), F.col("path"), labels, lengths).key).alias("key"))
    listed = known.select("key")
    universe = cut_lineage(keys.union(listed).distinct(), "table")
    blocked, allowed = (
        build_cascade(known.filter(kind).select("key"), universe, max_filter_bytes, seed)
        for kind, seed in ((F.col("block"), 0), (~F.col("block"), 1000))
    )
    judged = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    # one column a candidate: a scalar subquery can't stand in a lambda
    kind = "struct<size:int,host_size:int,key:string,block:boolean>"
    best = F.lit(None).cast(kind)
    for i in range(labels * len(lengths)):
        c = f"get(keys, {i})"
        block = blocked.lists(f"{c}.key")
        found = F.struct(F.expr(f"{c}.size"), F.expr(f"{c}.host_size"), F.expr(f"{c}.key"), block)
        best = F.greatest(best, F.when(F.expr(f"{c} IS NOT NULL") & (block | allowed.lists(f"{c}.key")), found.cast(kind)))
    judged = judged.withColumn("best", best)
    return judged.select(*out, F.col("best.key").alias("rule"), F.when(F.col("best.block"), "block").otherwise("allow").alias("verdict"))
