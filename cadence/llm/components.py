"""Connected components of a link table.

Edges point from a larger to a smaller id.  A round has two steps.  (1) Edges
are dealt by their larger end into bundles of bounded size; a bundle joins
what is connected inside it and points every vertex at the smallest of its
part, so a vertex with several smaller neighbours ties these together.
(2) Every edge moves on to the smallest neighbour of the vertex it points at.
A round is written to the shared folder (short lineage: a lost executor costs
one round at most); rounds end when nothing changes, and then every vertex
points at the smallest id of its component.

A bundle's edges to one vertex travel as one row, so a vertex that a third of
all others point at is one row per bundle in the join of step (2).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cadence.plans.lineage import cut_lineage

EDGES_PER_BUNDLE = 20_000
LEAST_BUNDLES = 16


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different vertices of the edges (u, v), and for each the smallest
    vertex connected with it (minimum over neighbours, with path halving)."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, label[a], label[b])
        np.minimum.at(new, label[b], label[a])
        new = new[new]
        new = new[new[label]]
        if (new == label).all():
            return names, names[label]
        label = new


STARS = "v bigint, us array<bigint>"


def _contract(table: pa.Table) -> pa.Table:
    """A bundle's vertices (``us``) by the smallest vertex of their part."""
    names, least = smallest_reachable(table["u"].to_numpy(), table["v"].to_numpy())
    keep = names != least
    order = np.argsort(least[keep], kind="stable")
    u, v = names[keep][order], least[keep][order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
    offsets = pa.array(np.append(first, len(v)), pa.int32())
    return pa.table({"v": pa.array(v[first], pa.int64()), "us": pa.ListArray.from_arrays(offsets, pa.array(u, pa.int64()))})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every vertex that
    has an edge.  Null ends, loops, repeats and either direction are fine."""

    def contracted(links: DataFrame, bundles: int) -> tuple[DataFrame, tuple]:
        stars = (
            links.withColumn("bundle", F.pmod(F.xxhash64("u"), F.lit(bundles)))
            .groupBy("bundle")
            .applyInArrow(lambda t: _contract(t), STARS)
        )
        seen = Observation()
        digest = F.sum(F.xxhash64("v", "us").cast("decimal(38,0)"))
        out = cut_lineage(stars.observe(seen, F.sum(F.size("us")).alias("n"), digest.alias("digest")), "table")
        return out, (seen.get["n"] or 0, seen.get["digest"])

    links = edges.filter(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    links = cut_lineage(links, "table")
    bundles = max(LEAST_BUNDLES, links.count() // EDGES_PER_BUNDLE)
    stars, seen = contracted(links, bundles)
    while seen[0]:
        onward = stars.select(F.explode("us").alias("u"), "v").groupBy("u").agg(F.min("v").alias("onward"))
        # an edge that moves on leaves the tie between its old and new end to
        # the edge (v, onward), which is in the table itself
        moved = stars.join(onward, F.col("v") == F.col("u"), "left").select(
            F.explode("us").alias("u"), F.coalesce("onward", "v").alias("v")
        )
        last = seen
        stars, seen = contracted(moved, bundles)
        if seen == last:
            break
    tips = stars.select(F.explode("us").alias("id"), F.col("v").alias("component"))
    return tips.union(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
