"""Near duplicates by circulant MinHash, banding and exact Jaccard checks.

1.  Every text becomes its set of distinct 5-word shingles (64-bit hashes), a
    circulant MinHash signature, one key per band, and a digest of the set.
    Texts with one digest are one vertex (the smallest doc_id), so copies cost
    one row whatever their number.
2.  Vertices that share a band key are candidates.  A key's members are tied
    to its smallest vertex only; the components of these ties are candidate
    clusters, a superset of every true component that banding can see.
3.  Links are decided on full sets inside clusters.  Small clusters are
    bundled, many to a task.  A large cluster is dealt at random into blocks
    of bounded size; each block compares its own members and a few leaders of
    the cluster that visit every block.  What is linked by then needs no more
    comparison: members outside the cluster's largest linked part are compared
    with all blocks (block against block, links decided in place; only pairs
    of linked parts leave a task).
4.  The components of the confirmed links give the result.

With 50 bands of 5 coordinates a pair at similarity 0.75 is missed with
probability 1.3e-6, at 0.8 with 3e-9.

Edge cases: a text with fewer words than the width is one shingle; a null,
empty or wordless text has an empty set and links with nothing; rows that
repeat a doc_id are one document when links are drawn; a row without doc_id links with nothing and
has a null component; an empty table gives no rows; extra columns are ignored
by ``near_duplicates`` and carried by ``near_dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm import textkernels as tk
from cadence.llm._common import free_names, named
from cadence.llm.components import connected_components
from cadence.plans.lineage import cut_lineage

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 50, 5
BLOCK_DOCS = 256
BLOCK_SHINGLES = 400_000
LEADERS = 16


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tk.text_blocks(batches, 1):
            sets = tk.shingle_sets(*tk.text_bytes(block.column(1)), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), bands), np.int64)
            if full:
                keys[full] = tk.band_keys(tk.circulant_minhash([sets[i] for i in full], bands * rows), bands)
            offsets = pa.array(np.arange(0, keys.size + 1, bands), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                ],
                ["id", "n", "digest", "bands"],
            )

    return run


def link_matrix(left: list[np.ndarray], right: list[np.ndarray], percent: int, tile: int = 4096) -> np.ndarray:
    """Which sets of two lists reach the similarity, on full sets."""
    n, m = len(left), len(right)
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(n + m), [len(s) for s in (*left, *right)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, bool)
    column = np.cumsum(fresh) - 1
    counts = np.bincount(column)
    shared = counts[column] > 1 if len(flat) else fresh
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    common = np.zeros((n, m), np.float64)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, tile):
        s, e = np.searchsorted(column, [begin, begin + tile])
        dense = np.zeros((n + m, tile), np.float32)
        dense[owner[s:e], column[s:e] - begin] = 1
        common += dense[:n] @ dense[n:].T
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return (100 * common >= percent * (sizes - common)) & (common > 0)


def linked_parts(sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """Indices of the sets, by component of their links; lone sets left out."""
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [[0, 1]] if common and 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common) else []
    links = link_matrix(sets, sets, percent)
    left, parts = np.ones(len(sets), bool), []
    for i in range(len(sets)):
        if left[i]:
            left[i] = False
            part, frontier = [i], [i]
            while frontier:
                near = np.flatnonzero(links[frontier.pop()] & left)
                left[near] = False
                part += near.tolist()
                frontier += near.tolist()
            if len(part) > 1:
                parts.append(part)
    return parts


def _verify(width: int, percent: int):
    """Inside each cluster of a task's group, every linked vertex with the
    smallest one of its part; ``whole``: the group holds the whole cluster."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("id", "ascending")])
        sets = tk.shingle_sets(*tk.text_bytes(table["text"]), width)
        ids, clusters = table["id"].to_numpy(), table["cluster"].to_numpy()
        borders = np.flatnonzero(np.concatenate([[True], clusters[1:] != clusters[:-1], [True]]))
        src, dst = [], []
        for s, e in zip(borders[:-1], borders[1:]):
            if e - s > 1:
                for part in linked_parts(sets[s:e], percent):
                    names = ids[s + np.array(part)]
                    src.append(names), dst.append(np.full(len(names), names.min()))
        src, dst = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (src, dst))
        whole = np.full(len(src), table["g2"][0].as_py() < 0)
        return pa.table({"src": src, "dst": dst, "whole": whole})

    return run


def _verify_across(width: int, percent: int):
    """Parts that are linked between the two sides of a block pair."""

    def run(table: pa.Table) -> pa.Table:
        sets = tk.shingle_sets(*tk.text_bytes(table["text"]), width)
        side, part = table["side"].to_numpy(), table["part"].to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found: set[tuple[int, int]] = set()
        if len(a) and len(b):
            links = link_matrix([sets[i] for i in a], [sets[i] for i in b], percent)
            for x in range(len(a)):
                found.update((int(part[a[x]]), int(p)) for p in np.unique(part[b[links[x]]]))
        pairs = sorted(p for p in found if p[0] != p[1])
        return pa.table({"src": pa.array([p[0] for p in pairs], pa.int64()), "dst": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def confirmed_components(
    texts: DataFrame, members: DataFrame, width: int, percent: int, block_docs: int, block_shingles: int
) -> DataFrame:
    """``id`` and ``component`` of the links between ``members`` (id, cluster,
    n) of a cluster, for linked ids at least; ``texts`` has id and text."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    sizes = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("docs") / block_docs, F.col("shingles") / block_shingles)))
    sizes = cut_lineage(sizes, "table")  # a plain scan: Spark can split the join on a large cluster
    members = cut_lineage(members.join(sizes, "cluster"), "table")
    docs, shingles, most = members.agg(F.count(F.lit(1)), F.sum("n"), F.max("blocks")).first()
    bundles = max(1, int(max(docs / block_docs, (shingles or 0) / block_shingles)))
    # the one time that all texts move; from here on it is the members' alone
    texts = cut_lineage(texts.join(members.hint("merge"), "id"), "table")
    columns = ["id", "cluster", "text", "g1", "g2"]
    small = (
        texts.filter("blocks = 1")
        .withColumn("g1", F.pmod(F.xxhash64("cluster"), F.lit(bundles)))
        .withColumn("g2", F.lit(-1).cast("bigint"))
        .select(columns)
    )
    home = F.pmod(F.xxhash64("id"), F.col("blocks"))
    crowd = texts.filter("blocks > 1").withColumn("g1", F.col("cluster"))
    dealt = crowd.withColumn("g2", home).select(columns)
    leaders = (
        crowd.filter(F.pmod(F.xxhash64("id", F.lit("leader")), F.col("docs")) < LEADERS)
        .withColumn("g2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .filter(F.col("g2") != home)
        .select(columns)
    )
    first = cut_lineage(
        small.union(dealt)
        .union(leaders)
        .groupBy("g1", "g2")
        .applyInArrow(_verify(width, percent), "src bigint, dst bigint, whole boolean"),
        "table",
    )
    large = members.filter("blocks > 1")
    result = first.filter("whole").select(F.col("src").alias("id"), F.col("dst").alias("component"))
    if (most or 0) <= 1:
        return result
    parts = connected_components(first.filter("NOT whole")).withColumnRenamed("component", "part")
    parted = large.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    weights = parted.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("k"))
    largest = weights.groupBy("cluster").agg(F.max(F.struct("k", "part")).alias("top"))
    parted = cut_lineage(
        parted.join(largest, "cluster").select(
            "id", "cluster", "n", "blocks", "part", (F.col("part") != F.col("top.part")).alias("apart")
        ),
        "table",
    )
    apart = parted.filter("apart")
    spread = apart.groupBy("cluster").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / block_docs, F.sum("n") / block_shingles)).alias("rows")
    )
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    one = (
        apart.join(spread, "cluster")
        .withColumn("g2", F.pmod(F.xxhash64("id", F.lit("row")), F.col("rows")))
        .withColumn("g3", each(F.col("blocks")))
        .select("id", "cluster", "part", "g2", "g3", F.lit(0).alias("side"))
    )
    other = (
        parted.join(spread, "cluster")
        .withColumn("g3", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("g2", each(F.col("rows")))
        .select("id", "cluster", "part", "g2", "g3", F.lit(1).alias("side"))
    )
    across = (
        crowd.select("id", "text").join(one.union(other).hint("merge"), "id")
        .groupBy("cluster", "g2", "g3")
        .applyInArrow(_verify_across(width, percent), "src bigint, dst bigint")
    )
    joined = connected_components(across).withColumnRenamed("id", "part")
    return result.union(
        parted.join(joined, "part", "left").select("id", F.coalesce("component", "part").alias("component"))
    )


def _components(
    docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int, block_docs: int, block_shingles: int
) -> DataFrame:
    """One row per row of ``docs``: id, n (set size), component (null id: null)."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = cut_lineage(
        slim.mapInArrow(_signatures(width, bands, rows), "id bigint, n bigint, digest binary, bands array<bigint>"), "table"
    )
    usable = sig.filter("n > 0 AND id IS NOT NULL")
    vertices = cut_lineage(usable.groupBy("digest").agg(F.min("id").alias("vertex")), "table")
    keys = usable.join(vertices.select(F.col("vertex").alias("id")).distinct(), "id", "left_semi").select(
        "id", F.explode("bands").alias("key")
    )
    shared = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    shared = cut_lineage(shared, "table")  # a plain scan: Spark can split the join on a frequent key
    ties = keys.join(shared, "key").filter("id > first").select(F.col("id").alias("src"), F.col("first").alias("dst"))
    clusters = connected_components(ties).withColumnRenamed("component", "cluster")
    members = clusters.join(usable.groupBy("id").agg(F.max("n").alias("n")), "id")
    linked = confirmed_components(slim, members, width, percent, block_docs, block_shingles)
    final = vertices.join(linked.withColumnRenamed("id", "vertex"), "vertex", "left").select(
        "digest", F.coalesce("component", "vertex").alias("component")
    )
    return sig.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(
        final, "digest", "left"
    ).select("id", "n", F.coalesce("component", "id").alias("component"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    block_docs: int = BLOCK_DOCS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Id, ``n_shingles``, ``component_id`` (smallest id reachable by links)
    and ``kept`` (the component's representative) per document."""
    found = _components(docs, id_col, text_col, width, percent, bands, rows, block_docs, block_shingles)
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the documents that another one of their group stands
    for; rows without id stay.  All columns as they came."""
    found = near_duplicates(docs, id_col, text_col, **params)
    (drop_id,) = free_names(docs, "drop_id")
    drop = found.filter(~F.col("kept") & named(found, id_col).isNotNull()).select(named(found, id_col).alias(drop_id)).distinct()
    return docs.join(drop, named(docs, id_col) == F.col(drop_id), "left_anti")
