"""Near-duplicate vectors by NN-descent.

1.  Vectors are normalised in double precision; equal vectors are one vertex
    (the smallest id) with a number of copies.
2.  Start lists: random hyperplanes cut the vectors into small cells, several
    times; each vertex keeps its ``k`` best of the cells it fell into.
3.  NN-descent: the neighbours (in both directions) of a vertex are compared
    with each other, as far as one of the two came in last round; whatever
    beats the end of a list enters it.  Rounds stop when few lists change.
4.  Edges at or above the threshold are confirmed in double precision; their
    components are the result.  A list whose worst entry still reaches the
    threshold is saturated.  Saturated vertices get further lists, of the
    ``k`` best outside their component, by the same search; links found this
    way join components, and the search is repeated until it finds none, so
    no list that is left is saturated.  Inside a component saturated vertices
    are compared exactly, in blocks.
5.  Audit: a sample of vertices is compared with all vertices.  A vertex's
    recall is the share of its links that was found; the audit is the lowest
    mean over the linked vertices of a size class (``SIZES``).  While it is
    below ``goal``, new cells and rounds are added; if it stays below,
    ``near_vectors`` raises.  The audit is returned.

The number of cuts follows the table: so many that two vectors at the threshold
share a cell with probability ``goal``, whatever the number of cells.

All comparisons work on groups of bounded size: cells and the neighbour lists
of popular vertices are split at random, saturated components are cut into
blocks; only lists, link counts or confirmed edges leave a task.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without id, link with nothing; vectors of different
length are not compared; rows that repeat an id count as vectors of their own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.components import connected_components
from cadence.plans.lineage import cut_lineage

THRESHOLD = 0.9
K = 8
CELL = 192
CUTS = 6
ROUNDS = 4
BLOCK = 512
MEMBERS = 64
AUDIT = 400
SIZES = (8, 64, 512)  # upper limits of the audit's size classes
SAMPLE = 2048  # vertices that the audit compares in one pass
GOAL = 0.97
MARGIN = 1e-4  # lists are kept in single precision; what is this near is confirmed in double

EDGES = "u bigint, v bigint, sim float, fresh boolean"


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, dimension, digest and unit vector (bytes of doubles); the last
    three null where the vector links with nothing."""
    for batch in batches:
        dims, digests, units = [], [], []
        for value in batch.column(1):
            v = np.array(value.values.to_numpy(zero_copy_only=False), np.float64) if value.is_valid else np.empty(0)
            size = np.abs(v).max() if len(v) else 0.0
            ok = bool(np.isfinite(size) and size > 0)
            if ok:
                v = v / size
                v = (v / np.sqrt(v @ v) + 0.0).tobytes()
            dims.append(len(v) // 8 if ok else None)
            digests.append(hashlib.blake2b(v, digest_size=16).digest() if ok else None)
            units.append(v if ok else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(units, pa.binary())],
            ["id", "dim", "digest", "unit"],
        )


def _matrix(column, kind=np.float64) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1) if values else np.empty((0, 1), kind)


def _cells(seed: int, cuts: int, bits: int):
    """One row per vector and cut: the cell by the signs at random planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                dims = part.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    rows = part.filter(pa.array(dims == dim))
                    x = _matrix(rows.column(2))
                    for cut in range(cuts):
                        planes = np.random.default_rng([seed, cut, dim]).standard_normal((dim, bits))
                        code = ((x @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [
                                rows.column(0),
                                pa.array(np.full(len(x), cut), pa.int32()),
                                pa.array(code * 4096 + dim, pa.int64()),
                                pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()),
                                rows.column(3),
                                rows.column(4),
                            ],
                            ["id", "cut", "cell", "unit", "own", "open"],
                        )

    return run


def _edge_table(u, v, sim) -> pa.Table:
    u, v, sim = (np.concatenate(x) if len(x) else np.empty(0) for x in (u, v, sim))
    return pa.table(
        {
            "u": pa.array(u.astype(np.int64)),
            "v": pa.array(v.astype(np.int64)),
            "sim": pa.array(sim.astype(np.float32)),
            "fresh": pa.array(np.ones(len(u), bool)),
        }
    )


def _best_in_cell(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, x = table["id"].to_numpy(), _matrix(table["unit"], np.float32)
        own, seek = table["own"].to_numpy(), np.flatnonzero(table["open"].to_numpy())
        if len(ids) < 2:
            return _edge_table([], [], [])
        keep = min(k, len(ids) - 1)
        u, v, s = [], [], []
        for at in range(0, len(seek), BLOCK):
            rows = seek[at : at + BLOCK]
            sims = x[rows] @ x.T
            sims[own[rows][:, None] == own[None, :]] = -2
            best = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
            near = np.take_along_axis(sims, best, 1).ravel()
            u.append(np.repeat(ids[rows], keep)[near > -2])
            v.append(ids[best.ravel()][near > -2])
            s.append(near[near > -2])
        return _edge_table(u, v, s)

    return run


def _top_lists(k: int):
    """The ``k`` best different neighbours of each vertex in a bundle; an edge
    that was there before is not fresh."""

    def run(table: pa.Table) -> pa.Table:
        u, v, sim = (table[c].to_numpy() for c in ("u", "v", "sim"))
        fresh = table["fresh"].to_numpy()
        order = np.lexsort((fresh, v, u))
        u, v, sim, fresh = u[order], v[order], sim[order], fresh[order]
        first = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
        u, v, sim, fresh = u[first], v[first], sim[first], fresh[first]
        order = np.lexsort((v, -sim, u))
        u, v, sim, fresh = u[order], v[order], sim[order], fresh[order]
        begin = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        place = np.arange(len(u)) - np.repeat(begin, np.diff(np.append(begin, len(u))))
        keep = place < k
        return pa.table({"u": u[keep], "v": v[keep], "sim": sim[keep], "fresh": fresh[keep]})

    return run


def _compare_neighbours(table: pa.Table, k: int) -> pa.Table:
    """Neighbours of one vertex (``pivot``, ``part``) compared with each other;
    of all pivots of the bundle together, the ``k`` best for each vertex."""
    table = table.sort_by([("pivot", "ascending"), ("part", "ascending")])
    pivot, part, ids = table["pivot"].to_numpy(), table["part"].to_numpy(), table["id"].to_numpy()
    fresh, floor = table["fresh"].to_numpy(), table["floor"].to_numpy()
    group, seek = table["own"].to_numpy(), table["open"].to_numpy()
    units = table["unit"].to_pylist()
    begin = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (part[1:] != part[:-1])]))
    us, vs, ss = [], [], []
    for s, e in zip(begin.tolist(), np.append(begin[1:], len(ids)).tolist()):
        if e - s < 2 or not fresh[s:e].any():
            continue
        x = np.frombuffer(b"".join(units[s:e]), np.float32).reshape(e - s, -1)
        sims = x @ x.T
        own, new, side = ids[s:e], fresh[s:e], group[s:e]
        good = (sims > floor[s:e, None]) & (new[:, None] | new[None, :]) & (side[:, None] != side[None, :]) & seek[s:e, None]
        a, b = np.nonzero(good)
        us.append(own[a]), vs.append(own[b]), ss.append(sims[a, b])
    found = _edge_table(us, vs, ss)
    return _top_lists(k)(found) if found.num_rows else found


def _bundled(edges: DataFrame, bundles: int, k: int) -> DataFrame:
    return (
        edges.withColumn("bundle", F.pmod(F.xxhash64("u"), F.lit(bundles)))
        .groupBy("bundle")
        .applyInArrow(_top_lists(k), EDGES)
    )


def cell_bits(n: int, cell: int) -> int:
    return max(0, min(40, int(np.ceil(np.log2(max(1, n / (cell / 2)))))))


def cuts_for(n: int, cell: int, threshold: float, goal: float) -> int:
    """Cuts after which two vectors at the threshold have shared a cell with
    probability ``goal``."""
    together = (1 - np.arccos(min(1.0, max(-1.0, threshold))) / np.pi) ** cell_bits(n, cell)
    if together >= goal:
        return 1
    return int(np.ceil(np.log(1 - min(goal, 1 - 1e-9)) / np.log(1 - together)))


def start_lists(vectors: DataFrame, n: int, k: int, cell: int, cuts: int, seed: int, bundles: int) -> DataFrame:
    bits = cell_bits(n, cell)
    placed = vectors.select("id", "dim", "unit", "own", "open").mapInArrow(
        _cells(seed, cuts, bits), "id bigint, cut int, cell bigint, unit binary, own bigint, open boolean"
    )
    placed = cut_lineage(placed, "table")
    counts = placed.groupBy("cut", "cell").agg(F.ceil(F.count(F.lit(1)) / cell).alias("parts"))
    # one column for the group: rows dealt by (cut, cell) would count as grouped
    # and leave all parts of a crowded cell in one task
    part = F.concat_ws(":", "cut", "cell", F.pmod(F.xxhash64("id", "cut"), F.col("parts")))
    split = placed.join(counts, ["cut", "cell"]).select("id", "unit", "own", "open", part.alias("part"))
    best = split.groupBy("part").applyInArrow(_best_in_cell(k), EDGES)
    return _bundled(best, bundles, k)


def descent_round(lists: DataFrame, vectors: DataFrame, k: int, bundles: int, seed: int, paths: DataFrame | None = None) -> DataFrame:
    """Lists after one neighbours-of-neighbours comparison; ``paths`` are
    further edges whose ends count as neighbours."""
    floors = lists.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
    ways = lists if paths is None else lists.union(paths.withColumn("fresh", F.lit(False)))
    both = ways.select(F.col("u").alias("pivot"), F.col("v").alias("id"), "fresh").union(
        ways.select(F.col("v").alias("pivot"), F.col("u").alias("id"), "fresh")
    )
    both = both.groupBy("pivot", "id").agg(F.max("fresh").alias("fresh"))
    parts = both.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    members = both.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("id", "pivot", F.lit(seed)), F.col("parts")))
    single = vectors.join(floors, F.col("id") == F.col("u"), "left").select(
        "id", "single", "own", "open", F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor")
    )
    found = (
        members.join(single, "id")
        .select(
            "pivot", "part", "id", "fresh", "floor", "own", "open", F.col("single").alias("unit"),
            F.pmod(F.xxhash64("pivot", "part"), F.lit(bundles)).alias("bundle"),
        )
        .groupBy("bundle")
        .applyInArrow(lambda t: _compare_neighbours(t, k), EDGES)
    )
    return _bundled(lists.withColumn("fresh", F.lit(False)).union(found), bundles, k)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the cosine in double precision to rows with both unit vectors."""
    for batch in batches:
        cosine = np.empty(batch.num_rows)
        sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):  # pairs of one dimension at a time
            at = np.flatnonzero(sizes == size)
            some = batch.take(pa.array(at))
            cosine[at] = np.einsum("ij,ij->i", _matrix(some.column(2)), _matrix(some.column(3)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(cosine)], ["u", "v", "cosine"]
        )


def _block_counts(threshold: float):
    """Copies linked across a block pair: for each saturated vertex all of
    them, for each other vertex those that are saturated."""

    def run(table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["id"].to_numpy()
        copies, full = table["copies"].to_numpy(), table["saturated"].to_numpy()
        x = _matrix(table["unit"])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        linked = (x[a] @ x[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
        ours = linked @ copies[b]
        theirs = (copies[a] @ linked) * ~full[b]
        return pa.table(
            {"id": np.concatenate([ids[a], ids[b]]).astype(np.int64), "n": np.concatenate([ours, theirs]).astype(np.int64)}
        )

    return run


def _audit_counts(sample: np.ndarray, dim: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sample), np.int64)
        for batch in batches:
            rows = batch.filter(pa.array(batch.column(0).to_numpy() == dim))
            if rows.num_rows:
                total += (sample @ _matrix(rows.column(1)).T >= threshold) @ rows.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sample)), pa.int32()), pa.array(total)], ["i", "n"])

    return run


def _confirmed(vectors: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """The list entries at or above the threshold in double precision."""
    near = lists.filter(F.col("sim") >= threshold - MARGIN).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = vectors.select(F.col("id").alias("u"), F.col("unit").alias("x"))
    right = vectors.select(F.col("id").alias("v"), F.col("unit").alias("y"))
    return cut_lineage(
        near.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(_exact, "u bigint, v bigint, cosine double")
        .filter(F.col("cosine") >= threshold).select("u", "v"),
        "table",
    )


def _known(vectors: DataFrame, lists: DataFrame, edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """id, copies, component and whether the vertex's list is saturated."""
    parts = connected_components(edges, "u", "v")
    full = lists.groupBy("u").agg((F.count(F.lit(1)) >= k).alias("full"), F.min("sim").alias("worst"))
    full = full.filter(F.col("full") & (F.col("worst") >= threshold - MARGIN)).select(F.col("u").alias("id"), F.lit(True).alias("saturated"))
    return cut_lineage(
        vectors.select("id", "copies").join(parts, "id", "left").join(full, "id", "left").select(
            "id", "copies", F.coalesce("component", "id").alias("component"), F.coalesce("saturated", F.lit(False)).alias("saturated")
        ),
        "table",
    )


def _links(vectors: DataFrame, edges: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """vertex id, component and number of linked vectors other than its copies."""
    # links between vertices with open lists, from the confirmed edges
    ends = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    flags = known.select(F.col("id").alias("v"), F.col("copies").alias("c"), F.col("saturated").alias("sat_v"))
    own = known.select(F.col("id").alias("u"), F.col("saturated").alias("sat_u"))
    listed = ends.join(flags, "v").join(own, "u").filter("NOT sat_u AND NOT sat_v").groupBy(F.col("u").alias("id")).agg(F.sum("c").alias("n"))
    # saturated vertices against their whole component, in blocks
    sizes = known.groupBy("component").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("cols"), F.ceil(F.sum(F.col("saturated").cast("int")) / BLOCK).alias("rows")
    ).filter("rows > 0")
    crowd = known.join(cut_lineage(sizes, "table"), "component")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    row_block = F.pmod(F.xxhash64("id", F.lit("row")), F.col("rows"))
    col_block = F.pmod(F.xxhash64("id"), F.col("cols"))
    ours = crowd.filter("saturated").withColumn("g1", row_block).withColumn("g2", each(F.col("cols"))).withColumn("side", F.lit(0))
    theirs = crowd.withColumn("g2", col_block).withColumn("g1", each(F.col("rows"))).withColumn("side", F.lit(1))
    columns = ["component", "g1", "g2", "side", "id", "copies", "saturated"]
    blocks = ours.select(columns).union(theirs.select(columns)).join(vectors.select("id", "unit"), "id")
    counted = blocks.groupBy("component", "g1", "g2").applyInArrow(_block_counts(threshold), "id bigint, n bigint")
    links = counted.union(listed.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    return cut_lineage(
        known.join(links, "id", "left").select("id", "component", "copies", F.coalesce("n", F.lit(0)).alias("n")), "table"
    )


def _size_class(size):
    return sum((F.when(size > limit, 1).otherwise(0) for limit in SIZES), F.when(size > 1, 1).otherwise(0))


def _recall(vectors: DataFrame, links: DataFrame, lists: DataFrame, audit: int, threshold: float) -> float:
    """Lowest mean recall of a size class' linked vertices.

    The sample has ``audit`` vertices of each class of found components, as many
    of the vertices without a found link, and the ``audit`` unlinked ones whose
    best list entry comes nearest to the threshold (grade -1), where a miss is
    likeliest; its size does not follow the table's.  A vertex counts in the
    class of its component or of its links, whichever is larger, with the inverse
    of its share in the sample.  Where no sampled unlinked vertex has a link, at
    most 3 / ``audit`` of the unlinked ones have one, with 95 % confidence.
    """
    sizes = links.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    graded = links.join(sizes, "component").select("id", "size", F.col("n").alias("found"), _size_class(F.col("size")).alias("grade"))
    best = lists.groupBy("u").agg(F.max("sim").alias("best"))
    close = graded.filter("grade = 0").join(best, F.col("id") == F.col("u")).orderBy(F.col("best").desc(), "id").limit(audit)
    close = close.select("id", F.lit(True).alias("close"))
    graded = graded.join(close, "id", "left").withColumn("grade", F.when(F.col("close"), -1).otherwise(F.col("grade"))).drop("close")
    graded = cut_lineage(graded, "table")
    counts = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}
    share = {g: min(1.0, audit / m) for g, m in counts.items()}
    fraction = F.create_map(*[F.lit(x) for g in share for x in (g, float(share[g]))]) if share else F.create_map()
    order = F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(1 << 40)) / float(1 << 40)
    picked = graded.filter(order < F.element_at(fraction, F.col("grade"))) if share else graded
    turns = max(1, int(np.ceil(sum(share[g] * counts[g] for g in counts) / SAMPLE)))
    picked = picked.withColumn("turn", F.pmod(F.xxhash64("id", F.lit("turn")), F.lit(turns)))
    picked = cut_lineage(picked.join(vectors.select("id", "dim", "unit", "copies"), "id"), "table")
    weight, hits = {}, {}
    for dim, turn in sorted(map(tuple, picked.select("dim", "turn").distinct().collect())):
        some = picked.filter((F.col("dim") == dim) & (F.col("turn") == turn)).collect()
        sample = np.frombuffer(b"".join(r["unit"] for r in some), np.float64).reshape(len(some), dim)
        per = vectors.select("dim", "unit", "copies").mapInArrow(_audit_counts(sample, dim, threshold), "i int, n bigint")
        total = {r["i"]: r["n"] for r in per.groupBy("i").agg(F.sum("n").alias("n")).collect()}
        for i, r in enumerate(some):
            true = total[i] - r["copies"]  # itself and its copies
            if true > 0:
                size = max(r["size"], true + 1)
                grade = 1 + sum(size > limit for limit in SIZES)
                weight[grade] = weight.get(grade, 0.0) + 1 / share[r["grade"]]
                hits[grade] = hits.get(grade, 0.0) + min(r["found"], true) / true / share[r["grade"]]
    return min((hits[g] / weight[g] for g in weight), default=1.0)


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    k: int = K,
    cell: int = CELL,
    cuts: int = CUTS,
    rounds: int = ROUNDS,
    audit: int = AUDIT,
    goal: float = GOAL,
    attempts: int = 4,
    seed: int = 11,
) -> DataFrame:
    """Id, ``n_links``, ``component_id``, ``kept`` and ``audited_recall`` per row.

    ``cuts``, ``rounds`` and ``attempts`` are the least limits; all three grow
    with the table.  Raises if the audit stays below ``goal``."""
    spark = vectors.sparkSession
    rows = cut_lineage(
        vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).mapInArrow(
            _unit_rows, "id bigint, dim int, digest binary, unit binary"
        ),
        "table",
    )
    usable = rows.filter("digest IS NOT NULL AND id IS NOT NULL")
    groups = cut_lineage(usable.groupBy("digest").agg(F.min("id").alias("vertex"), F.count(F.lit(1)).alias("copies")), "table")
    chosen = usable.join(groups.select(F.col("vertex").alias("id"), "digest", "copies"), ["id", "digest"]).dropDuplicates(["id", "digest"])
    vertices = cut_lineage(chosen.select("id", "dim", "unit", "copies").mapInArrow(_single, "id bigint, dim int, unit binary, copies bigint, single binary"), "table")
    n = vertices.count()
    bundles = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, n // 2000)
    cuts = max(cuts, cuts_for(n, cell, threshold, goal))
    rounds = max(rounds, cell_bits(n, cell))
    attempts = max(attempts, cell_bits(n, cell))

    def searched(found: DataFrame | None, who: DataFrame, many: int, seed: int, paths: DataFrame | None = None) -> DataFrame:
        """Lists of the open ones of ``who`` from new cells and rounds."""
        started = start_lists(who, n, k, cell, cuts, seed, bundles)
        lists = cut_lineage(started if found is None else _bundled(found.union(started), bundles, k), "table")
        for r in range(rounds):
            lists = cut_lineage(descent_round(lists, who, k, bundles, seed + 1000 + r, paths), "table")
            if lists.filter("fresh").count() <= 0.01 * k * many:
                break
        return lists

    everyone = vertices.withColumn("own", F.col("id")).withColumn("open", F.lit(True))
    lists, recall, links, across = None, 1.0, None, None
    for attempt in range(attempts):
        at = seed + 100_000 * attempt
        lists = searched(lists, everyone, n, at)
        edges = _confirmed(vertices, lists, threshold)
        edges = edges if across is None else edges.union(across).distinct()
        while True:
            known = _known(vertices, lists, edges, k, threshold)
            full = known.filter("saturated").count()
            if not full or known.select("component").distinct().count() == 1:
                break
            at += 2000
            sides = known.select("id", F.col("component").alias("own"), F.col("saturated").alias("open"))
            who = cut_lineage(vertices.join(sides, "id"), "table")
            new = _confirmed(vertices, searched(None, who, full, at, lists), threshold)
            if new.isEmpty():
                break
            across = new if across is None else across.union(new)
            edges = cut_lineage(edges.union(new).distinct(), "table")
        links = _links(vertices, edges, known, threshold)
        recall = _recall(vertices, links, lists, audit, threshold)
        if recall >= goal:
            break
    if recall < goal:
        raise RuntimeError(f"audited recall {recall:.4f} is below {goal} after {attempts} attempts")
    result = groups.join(links.select(F.col("id").alias("vertex"), "component", "n"), "vertex").select(
        "digest", "component", (F.col("n") + F.col("copies") - 1).alias("n")
    )
    return rows.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(result, "digest", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"),
        F.lit(float(recall)).alias("audited_recall"),
    )


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the unit vector in single precision."""
    for batch in batches:
        single = [np.frombuffer(x, np.float64).astype(np.float32).tobytes() for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single, pa.binary())], [*batch.schema.names, "single"])
