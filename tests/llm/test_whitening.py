"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest
from llm_support import SF, shipped  # noqa: F401

from cadence.llm import queries, whitening


def dense(vectors, components=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return ((n * x - sums) ** 2).sum(axis=1), c @ v / np.sqrt(e), e / ((c**2).sum() / n)


def compare(got, ids, vectors, components=32):
    deviation, want, share = dense(vectors, components)
    k = want.shape[1]
    assert len(got) == len(ids) * k
    got = got.sort_values(["vec_id", "component"])
    order = np.argsort(ids)
    w = got.whitened.to_numpy().reshape(len(ids), k)
    want = want[order]
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < 1e-6
    assert got.deviation.tolist() == np.repeat(deviation[order], k).tolist()
    assert got.explained.tolist() == pytest.approx(np.tile(share, len(ids)).tolist(), rel=1e-9)
    assert set(got.n) == {len(ids)} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    return w


def test_query_against_the_dense_form(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = queries.op13_embedding_whitening(spark, SF).toPandas()
    w = compare(got, v.vec_id.to_numpy(), v.embedding.tolist())
    assert np.abs(w.T @ w / len(w) - np.eye(32)).max() < 1e-9


@pytest.mark.parametrize("spread", [1e0, 1e-4])
def test_badly_conditioned_rows(spark, spread):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((400, 6)) * 1000
    v[:, 5] = v[:, 0] + spread * v[:, 1] + rng.standard_normal(400) * 0.1
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas()
    compare(got, np.arange(400), v.tolist())


def test_edge_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(3).tolist()) for i in range(30)]
    flat = [(100 + i, [*rng.standard_normal(2).tolist(), 7.0, 0.0]) for i in range(20)]  # two directions without spread
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 2.0]), (204, [float("inf"), 0.0, 1.0]), (205, [1.0])]
    again = [good[0], (None, good[1][1])]
    rows = [(i, v, "x", 1) for i, v in good + flat + odd + again]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x string, component int").repartition(5)
    out = whitening.whiten(df).toPandas()
    assert set(out.vec_id.dropna()) == {i for i, _ in good + flat}  # (205: a single row of its length has no spread)
    three = out[out.vec_id.isna() | (out.vec_id < 100)]
    assert set(three.n) == {32} and len(three) == 32 * 3
    four = out[out.vec_id >= 100]
    assert set(four.n) == {20} and set(four.component) == {1, 2}
    x = np.floor(64 * np.array([v for _, v in flat])) + 1_000_000
    w = four.sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(20, 2)
    assert np.abs(w.T @ w / 20 - np.eye(2)).max() < 1e-9 and len(x) == 20
    assert whitening.whiten(df.filter("vec_id = 205")).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(same).count() == 0


def test_huge_entries_and_deviations(spark):
    rows = [(i, [float(10.0 ** (2 * i)), 1.0 * i]) for i in range(12)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas()
    x = [[int(min(64 * v, whitening.LIMIT)) + 1_000_000 for v in vec] for _, vec in rows]
    sums = [sum(c) for c in zip(*x)]
    for i, row in enumerate(x):
        exact = sum((len(x) * a - s) ** 2 for a, s in zip(row, sums))
        got = set(out[out.vec_id == i].deviation.tolist())
        assert got == {exact} if exact < 2**63 else all(np.isnan(g) for g in got)


def test_triangular_solve_and_shifted_factor():
    rng = np.random.default_rng(3)
    r = np.triu(rng.standard_normal((5, 5))) + 5 * np.eye(5)
    y = rng.standard_normal((7, 5))
    assert np.allclose(whitening.triangular_solve(y, r) @ r, y)
    singular = np.ones((4, 4))
    f = whitening.cholesky_factor(singular, shifted=False)
    assert np.allclose(f.T @ f, singular, atol=1e-9) and np.allclose(f, np.triu(f))
