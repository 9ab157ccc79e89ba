"""Whitening against numpy's eigenvectors and exact integers."""
from __future__ import annotations

import math

import numpy as np
import pytest

from plumbline.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, id string, v int, w string, component string, n string"


def check(got: list, data: list[tuple], k: int = 8) -> None:
    """``got`` against a plain computation over the rows (id, vector) of ``data``."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in data], object)
    n, sums = len(x), x.sum(axis=0)
    y = (x - np.array([s // n for s in sums], object)).astype(float) - np.array([float(s % n) / n for s in sums])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(k, int((values > 1e-11 * values[0]).sum()))
    assert len(got) == n * rank
    dev = ((x * n - sums) ** 2).sum(axis=1)
    by = {c: sorted(((r.id if r.id is not None else -1), int(r.deviation), r.whitened) for r in got if r.component == c) for c in range(1, rank + 1)}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-4
    for c in range(rank):
        explained = {r.explained for r in got if r.component == c + 1}
        assert len(explained) == 1 and abs(explained.pop() - values[c] / np.trace(v)) <= 1e-10
        want = y @ vectors[:, c] / np.sqrt(values[c])
        rows = sorted(((i if i is not None else -1), int(d), w) for (i, _), d, w in zip(data, dev, want))
        assert [r[:2] for r in by[c + 1]] == [r[:2] for r in rows]
        a, b = np.array([r[2] for r in by[c + 1]]), np.array([r[2] for r in rows])
        alone = min((abs(values[c] - values[o]) for o in range(len(values)) if o != c), default=1.0) > 1e-6 * values[0]
        if alone:
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) <= 1e-6


def data_of(rng, n: int, dim: int) -> list[tuple]:
    mix = rng.standard_normal((dim, dim)) * np.geomspace(1, 0.05, dim)[:, None]
    return [(i, [float(c) for c in row]) for i, row in enumerate(rng.standard_normal((n, dim)) @ mix + 0.3)]


def frame(spark, data):
    return spark.createDataFrame([(i, v, "x", 1, "w", "c", "n") for i, v in data], SCHEMA)


def test_against_numpy(spark):
    data = data_of(np.random.default_rng(1), 300, 20)
    odd = [(None, data[0][1]), (7, data[7][1]), (400, None), (401, [None] + [1.0] * 19), (402, [float("nan")] * 20), (403, [float("inf")] * 20), (404, []), (405, [1.0, 2.0])]
    df = frame(spark, data + odd).repartition(5)
    check(whitening.whiten(df).collect(), data + odd[:2])


@pytest.mark.parametrize("n, dim", [(1, 4), (2, 4), (5, 12), (30, 1), (30, 3)])
def test_small(spark, n, dim):
    data = data_of(np.random.default_rng(n + dim), n, dim)
    got = whitening.whiten(frame(spark, data)).collect()
    if n == 1:
        assert got == []
    else:
        check(got, data)


def test_without_variance(spark):
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.5])] * 3)).collect() == []
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []


def test_equal_eigenvalues(spark):
    data = [(2 * i + s, [float(sign) if j == i else 0.0 for j in range(12)]) for i in range(12) for s, sign in enumerate((1, -1))]
    got = whitening.whiten(frame(spark, data)).collect()
    check(got, data)
    assert got[0].identity_error < 1e-9


def test_huge_entries(spark):
    """Sums and squares beyond 64 bits stay exact; entries beyond the bound count as the bound."""
    data = [(i, [i * 1e7, float(i % 3), 1e300 if i == 5 else 0.0]) for i in range(9)]
    got = whitening.whiten(frame(spark, data)).collect()
    bound = [(i, [min(c, 2.0**30) for c in v]) for i, v in data]
    check(got, bound)


def test_slices():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    values = np.sort(np.concatenate([rng.random(30), [2.0] * 20, 3 + rng.random(10)]))[::-1]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    diagonal, beside = whitening.tridiagonal(v)
    assert np.allclose(whitening.nth_largest(diagonal, beside, np.arange(1, 61)), values, atol=1e-12)
    shifts = np.array([-1.0, 0.5, 1.5, 2.5, 3.5, 5.0])
    assert list(whitening.above(diagonal, beside, shifts)) == [(values > s).sum() for s in shifts]
    cut = whitening.slices(v, 40)
    assert [c for *_, c in cut][0] == 30 and sum(c for *_, c in cut) >= 40


def test_many_components(spark):
    """Several intervals at once, one of them with a cluster that cannot be parted."""
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    values = np.sort(np.concatenate([rng.random(50), [2.0] * 5, 3 + rng.random(25)]))[::-1]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got, vectors = whitening.eigenpairs(spark, v, 50)
    assert np.allclose(got, values[:50], atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(50), atol=1e-9)
    assert np.abs(v @ vectors - vectors * got).max() < 1e-11


def test_query(spark):
    root = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op12_whitening"](spark, root).withColumnRenamed("vec_id", "id").collect()
    data = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{root}/embeddings.parquet").collect()]
    check(rows, data)
