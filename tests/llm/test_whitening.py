import numpy as np
import pytest

from shelfwright.llm import whitening as W
from shelfwright.llm.queries import registry

D = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, k long, w double, n long, sums string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, "v", 2, 3.0, 4, "s") for i, v in zip(ids, vectors)], SCHEMA)


def brute(vectors, k=32):
    x = np.floor(np.array(vectors, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = x * n - s
    v = (z / n).T @ (z / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, (z ** 2).sum(axis=1), (z / n) @ u / np.sqrt(e), e / np.trace(v)


def compare(rows, vectors, ids, k):
    n, deviation, whitened, explained = brute(vectors, k)
    assert len(rows) == len(ids) * whitened.shape[1]
    at = {i: j for j, i in enumerate(ids)}
    got = np.zeros(whitened.shape)
    for r in rows:
        j = at[r.vec_id]
        got[j, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[j]
        assert abs(r.explained - explained[r.component - 1]) <= 1e-10 * explained[r.component - 1]
        assert r.identity_error <= 1e-9
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - whitened * signs).max() < 1e-6
    cov = np.cov(got.T, bias=True).reshape(got.shape[1], -1)
    assert np.abs(cov - np.eye(len(cov))).max() < 1e-9


def test_query_equals_dense_solver(spark):
    data = spark.read.parquet(f"{D}/embeddings.parquet").collect()
    rows = registry()["op11_whitening"](spark, D).collect()
    good = [r for r in data if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    compare(rows, [r.embedding for r in good], [r.vec_id for r in good], 32)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((40, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    rows = W.whiten(table(spark, good + bad)).collect()
    assert {r.vec_id for r in rows} == set(range(40))
    compare(rows, good, range(40), 3)
    # repeated rows and null ids count
    rows = W.whiten(table(spark, good + good[:5], [*range(39), None, 0, 0, 0, 0, 0]), components=2).collect()
    assert len(rows) == 90 and sum(r.vec_id is None for r in rows) == 2 and rows[0].n == 45


def test_no_spread_and_empty(spark):
    assert W.whiten(table(spark, [])).columns == [c.split()[0] for c in W.OUTPUT.split(", ")]
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, [None, [float("nan")]])).count() == 0
    assert W.whiten(table(spark, [[1.0, 2.0]] * 5)).count() == 0  # every eigenvalue is zero
    rows = W.whiten(table(spark, [[k / 7, 3.0] for k in range(9)])).collect()
    assert len(rows) == 9 and {r.component for r in rows} == {1} and rows[0].explained == 1.0
    with pytest.raises(Exception, match="in size"):
        W.whiten(table(spark, [[1e30, 1.0], [1.0, 2.0]])).collect()


def test_wide_values_stay_exact(spark):
    """Products that no double holds."""
    rng = np.random.default_rng(2)
    x = (rng.integers(-2 ** 29, 2 ** 29, (30, 2)) / 64).astype(np.float32)
    rows = W.whiten(table(spark, x.tolist())).collect()
    v = np.floor(x.astype(float) * 64).astype(np.int64).astype(object) + 1_000_000
    z = v * 30 - v.sum(axis=0)
    want = {i: int((r ** 2).sum()) for i, r in enumerate(z)}
    assert {r.vec_id: r.deviation for r in rows} == {i: w if w < 2 ** 63 else None for i, w in want.items()}


@pytest.mark.parametrize("spectrum", [
    [9.0, 5, 3, 1], [4.0] * 5, [7.0] * 3 + [7 - 1e-13] * 2 + [2.0] * 4, [1e6, 1.0, 1e-6], [3.0, 3, 0, 0, 0],
    [10.0] + [1 + k * 1e-9 for k in range(40)], list(2.0 ** -np.arange(45))])
def test_slicing(spectrum):
    rng, d = np.random.default_rng(3), len(spectrum)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    m = q @ np.diag(spectrum) @ q.T
    m = (m + m.T) / 2
    found = W.leading_components(m, 32)
    want = np.linalg.eigvalsh(m)[::-1]
    positive = (want > 8 * d * np.finfo(float).eps * np.trace(m))[:32].sum()
    assert len(found) == positive
    assert np.abs([e for e, _ in found] - want[:positive]).max() < 1e-13 * np.trace(m)
    u = np.array([v for _, v in found])
    assert np.abs(u @ u.T - np.eye(len(u))).max() < 1e-12
    assert max(np.linalg.norm(m @ v - e * v) for e, v in found) < 1e-12 * np.trace(m)


def test_inertia():
    rng = np.random.default_rng(4)
    for _ in range(60):
        d = int(rng.integers(1, 12))
        a = rng.integers(-3, 4, (d, d)).astype(float)
        a = a + a.T
        np.fill_diagonal(a, 0)  # zero diagonals need 2x2 pivots
        w = np.linalg.eigvalsh(a)
        for s in rng.uniform(-8, 8, 5):
            assert W.above(a, s) == (w > s).sum()
