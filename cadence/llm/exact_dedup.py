"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the
groups, keep the smallest id.

Native DataFrame operations only.  The first pass groups by (hash, normalised
text): the text itself is part of the grouping key, so equality is decided on
bytes, and copies collapse map-side before anything is shuffled (a text that
fills a third of the table is one row per task).  It leaves one small row per
hash: the smallest id, the group's size and how many different texts share the
hash.  The second pass joins that back on the 16-byte hash; texts do not move
again.  Hashes with several texts (a collision) are resolved by a join on the
text for those hashes alone.

Edge cases: a null text counts as empty; an empty table gives no rows; rows
that repeat a doc_id are the same document and share its flag; a row without
doc_id is kept only if no row of its group has one.  Extra columns are ignored
by ``exact_groups`` and carried by ``exact_dedup``, whatever their names; a text
of any length is one value of a row and a grouping key, never split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm._common import SPACE_CLASS, free_names, named, text_or_empty
from cadence.plans.lineage import cut_lineage


def normalise_space(col: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(col), SPACE_CLASS + "+", " ")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _with_group(
    docs: DataFrame, id_col: str, text_col: str, normalise: Callable, digest: Callable[[Column], Column], names: list[str]
) -> DataFrame:
    """``docs`` with the id that stays and the size of the row's group, under
    the first two of ``names`` (all are columns that ``docs`` doesn't have)."""
    keep, size, h, gh, t = names
    text = normalise(named(docs, text_col))
    rows = docs.select(named(docs, id_col).alias("id"), digest(text).alias("h"), text.alias("t"))
    texts = rows.groupBy("h", "t").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size"))
    by_hash = cut_lineage(
        texts.groupBy("h").agg(
            F.min("keep").alias("keep"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_texts")
        ),
        "table",
    )
    tagged = docs.withColumn(h, digest(text))
    single = by_hash.filter("n_texts = 1").select(F.col("h").alias(gh), F.col("keep").alias(keep), F.col("size").alias(size))
    # null-safe, so that no not-null filter normalises and hashes the text once more
    out = tagged.join(single, F.col(h).eqNullSafe(F.col(gh))).drop(gh)
    collided = by_hash.filter("n_texts > 1").select("h")
    if not collided.isEmpty():
        exact = (
            texts.join(collided, "h", "left_semi")
            .select(F.col("h").alias(h), F.col("t").alias(t), F.col("keep").alias(keep), F.col("size").alias(size))
        )
        out = out.unionByName(tagged.withColumn(t, text).join(exact, [h, t]).drop(t).select(out.columns))
    return out


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable = normalise_space,
    digest: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept`` and the
    SHA-256 of the normalised text."""
    slim = docs.select(named(docs, id_col).alias("id"), named(docs, text_col).alias("text"))
    slim = slim.withColumn("sha", F.sha2(normalise("text"), 256))
    grouped = _with_group(slim, "id", "text", normalise, digest, ["keep", "size", "h", "gh", "t"])
    return grouped.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable = normalise_space,
    digest: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they came."""
    names = free_names(docs, "keep", "size", "h", "gh", "t")
    grouped = _with_group(docs, id_col, text_col, normalise, digest, names)
    return grouped.filter(named(docs, id_col).eqNullSafe(F.col(names[0]))).select(*[F.col(f"`{c}`") for c in docs.columns])
