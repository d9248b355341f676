"""Embedding whitening by shifted CholeskyQR.

Every entry ``c`` of a vector becomes the whole number ``floor(scale * c) +
offset``, so sums over all rows are exact.  With ``n`` rows and their sums, the
rows are centred exactly and orthogonalised without ever being gathered:

1.  A pass over the rows adds up the Gram matrix of the centred rows, part by
    part; its Cholesky factor R1 (of the matrix plus a small shift, so that it
    exists for badly conditioned rows too) is found on the driver.
2.  The next passes push every row through triangular solves with the factors
    found so far and add up the Gram matrix of the results.  Its factor joins
    the others until the results are orthonormal.
3.  R, the product of the factors, has the singular values and right singular
    vectors of the centred rows: ``s ** 2 / n`` are the covariance's
    eigenvalues ``e``, the vectors its components.  The left singular vectors
    of R turn the orthonormal rows into whitened ones.
4.  One more pass measures the covariance of the whitened rows.

What the driver holds is d x d for vectors of length d.  A task sends a matrix
row by row; rows are added in two levels of groups, by slots and then by
position, so no group grows with more than the number of tasks over ``SLOTS``.

Edge cases: rows whose vector is null, empty, or holds null or non-finite
entries are left out; entries beyond ``LIMIT`` after scaling count as
``LIMIT``; vectors of different length are whitened apart, each length on its
own rows; rows that repeat an id, and rows without one, are rows of their own;
directions without spread (eigenvalue below ``LEAST`` of the largest) are no
components, so equal rows, or a single one, give no output; a deviation too
large for a long is null; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.plans.lineage import cut_lineage

SCALE, OFFSET = 64, 1_000_000
LIMIT = 2.0**52
COMPONENTS = 32
LEAST = 1e-18  # of the largest eigenvalue: below, a direction is rounding noise
PASSES = 6
ORTHONORMAL = 1e-12
SLOTS = 64
ROWS = 4096  # per step inside a task

PARTS = "dim int, i int, slot int, part int, row binary"


def _whole_numbers(scale: float, offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            ends = np.cumsum(lengths)
            keep = (lengths > 0) & (bad[ends] == bad[ends - lengths])
            x = values[np.repeat(keep, lengths)]
            x = np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype(np.int64) + offset
            offsets = np.concatenate([[0], np.cumsum(lengths[keep])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x))],
                ["id", "x"],
            )

    return run


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of a batch by vector length, in steps of ``ROWS``."""
    lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        same = batch.filter(pa.array(lengths == dim))
        for at in range(0, same.num_rows, ROWS):
            part = same.slice(at, ROWS)
            yield dim, part, part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _totals(table: DataFrame, matrix: Callable[[int, np.ndarray], np.ndarray], kind: type) -> dict[int, np.ndarray]:
    """Per vector length the sum over all rows' steps of ``matrix(dim, x)``."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _by_length(batch):
                m = matrix(dim, x)
                sums[dim] = sums[dim] + m if dim in sums else m
        task = TaskContext.get().partitionId()
        for dim, m in sums.items():
            columns = [np.full(len(m), dim), np.arange(len(m)), np.full(len(m), task % SLOTS), np.full(len(m), task)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int32()) for c in columns), pa.array([r.tobytes() for r in m], pa.binary())],
                ["dim", "i", "slot", "part", "row"],
            )

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("slot", "ascending"), ("part", "ascending")])  # one order of summation
        total = sum(np.frombuffer(r, kind) for r in rows["row"].to_pylist())
        return rows.slice(0, 1).set_column(4, "row", pa.array([total.tobytes()], pa.binary()))

    sums = table.mapInArrow(parts, PARTS)
    sums = sums.groupBy("dim", "i", "slot").applyInArrow(lambda t: add(t), PARTS)
    sums = sums.groupBy("dim", "i").applyInArrow(lambda t: add(t), PARTS)
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in sums.collect():
        found.setdefault(r["dim"], {})[r["i"]] = np.frombuffer(r["row"], kind)
    return {dim: np.array([rows[i] for i in range(len(rows))]) for dim, rows in found.items()}


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact in long arithmetic."""
    return np.int64(n) * x - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows minus their mean, from the exact difference while it fits a long."""
    rough = x.astype(np.float64) - sums / n
    if np.abs(rough).max(initial=0.0) * n < 2.0**62:
        return deviations(x, n, sums) / n
    return rough


def triangular_solve(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``y @ inv(r)`` for an upper triangular ``r``, column by column."""
    out = np.empty_like(y)
    for j in range(y.shape[1]):
        out[:, j] = (y[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def cholesky_factor(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper triangular R with ``R.T @ R = gram`` (plus a shift where asked
    for or needed)."""
    d = len(gram)
    unit = 11 * d * (d + 1) * 2.0**-53 * np.trace(gram) / d
    shift = unit if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = 100 * shift if shift else unit


def squared_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Per row the sum of ``(n * x - sums) ** 2``: exact, null beyond a long."""
    top = (np.abs(x.astype(np.float64) - sums / n).max(initial=0.0) * n + 1) ** 2 * x.shape[1]
    if top < 2.0**62:
        d = deviations(x, n, sums)
        return pa.array(np.einsum("ij,ij->i", d, d), pa.int64())
    whole = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
    return pa.array([w if w < 2**63 else None for w in whole], pa.int64())


class Whitening:
    """What the tasks need for one vector length."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums
        self.factors: list[np.ndarray] = []
        self.turn = self.explained = self.error = None

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        y = centred(x, self.n, self.sums)
        for r in self.factors:
            y = triangular_solve(y, r)
        return y

    def finish(self, components: int) -> None:
        """Components from the composed factor: ``turn`` takes orthonormal
        rows to whitened ones; the largest entry of a component is positive."""
        r = np.eye(len(self.sums))
        for f in self.factors:
            r = f @ r
        u, s, v = np.linalg.svd(r)
        keep = (s**2 > LEAST * s[0] ** 2) & (np.arange(len(s)) < components) & (s > 0)
        sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])
        self.turn = (u * sign)[:, keep] * np.sqrt(self.n)
        self.explained = (s**2 / (s**2).sum())[keep] if s[0] > 0 else s[keep]


def fit(rows: DataFrame, components: int) -> dict[int, Whitening]:
    """Factors, components and the measured error per vector length, from the
    whole table of ``_whole_numbers``."""
    counted = _totals(rows, lambda dim, x: np.append(x.sum(axis=0), len(x))[None, :], np.int64)
    models = {dim: Whitening(int(t[0, -1]), t[0, :-1]) for dim, t in counted.items()}
    open_ = dict(models)
    for step in range(PASSES):
        held = dict(open_)
        grams = _totals(rows, lambda dim, x: (y := held[dim].orthogonal(x)).T @ y if dim in held else np.zeros((1, 1)), np.float64) if held else {}
        for dim, model in held.items():
            gram = grams[dim]
            if not np.trace(gram) or (step and np.abs(gram - np.eye(dim)).max() < ORTHONORMAL):
                del open_[dim]
            else:
                model.factors.append(cholesky_factor(gram, shifted=step == 0))
    for dim, model in models.items():
        if model.factors:
            model.finish(components)
    spread = {dim: m for dim, m in models.items() if m.factors}
    if spread:
        def moments(dim: int, x: np.ndarray) -> np.ndarray:
            if dim not in spread:
                return np.zeros((1, 1))
            w = spread[dim].orthogonal(x) @ spread[dim].turn
            return np.vstack([w.T @ w, w.sum(axis=0)])

        for dim, m in _totals(rows, moments, np.float64).items():
            if dim in spread:
                model, mean = spread[dim], m[-1] / spread[dim].n
                covariance = m[:-1] / model.n - np.outer(mean, mean)
                model.error = float(np.abs(covariance - np.eye(len(covariance))).max(initial=0.0))
    return spread


def _whitened(models: dict[int, Whitening]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, x in _by_length(batch):
                if dim not in models:
                    continue
                m = models[dim]
                w = m.orthogonal(x) @ m.turn
                rows, k = w.shape
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each),
                        pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                        pa.array(np.full(rows * k, m.n), pa.int64()),
                        squared_deviation(x, m.n, m.sums).take(each),
                        pa.array(w.ravel()),
                        pa.array(np.tile(m.explained, rows)),
                        pa.array(np.full(rows * k, m.error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    scale: float = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """Id, ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error`` per row and component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    slim = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = cut_lineage(slim.mapInArrow(_whole_numbers(scale, offset), f"id {kind}, x array<bigint>"), "table")
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_whitened(fit(rows, components)), schema).withColumnRenamed("id", id_col)
