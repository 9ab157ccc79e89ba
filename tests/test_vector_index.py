"""Exact vector search against brute force."""
from __future__ import annotations

import numpy as np
import pytest

from plumbline.operators import vector_index
from plumbline.operators.vector_index import indexed_top_k


def brute(rows, queries, k):
    def unit(v):
        if v is None or len(v) != 6 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return np.zeros(6)
        return np.array(v, dtype=float) / np.linalg.norm(v)

    keys = [r[0] for r in rows]
    m = np.array([unit(v) for _, v in rows]).reshape(-1, 6)
    out = {}
    for q, v in queries:
        s = m @ unit(v)
        best = sorted(range(len(rows)), key=lambda i: (-round(s[i], 9), keys[i]))[:k]
        out[q] = [(keys[i], pytest.approx(s[i], abs=1e-12)) for i in best]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append((r.k, r.score))
    return out


def clustered(rng, n, groups):
    at = rng.normal(size=(groups, 6))
    return [[float(x) for x in at[i % groups] + rng.normal(size=6) / 50] for i in range(n)]


ODD = [None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0], []]


@pytest.mark.parametrize("k", [1, 7])
def test_equals_brute_force(spark, monkeypatch, k):
    """A hot group of copies that fills many tiles, vectors without a direction, ties, text keys, a clashing column."""
    for name, v in (("TILE", 16), ("BLOCK", 8), ("TILES_TOGETHER", 2)):
        monkeypatch.setattr(vector_index, name, v)
    rng = np.random.default_rng(6)
    vecs = clustered(rng, 900, 30) + [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * 400 + ODD
    rows = [(f"v{i:05}", v) for i, v in enumerate(vecs)]
    queries = [(i, vecs[i]) for i in range(0, len(vecs), 20)] + [(10_000 + i, v) for i, v in enumerate(ODD)] + [(20_000, [-1.0, -2.0, -3.0, -4.0, -5.0, -6.0])]
    v = spark.createDataFrame([(*r, 1.0) for r in rows], "k string, v array<double>, cell double")
    q = spark.createDataFrame(queries, "q long, w array<double>")
    assert answers(indexed_top_k(v, "k", "v", q, "q", "w", k)) == brute(rows, queries, k)


def test_scores_few_pairs_of_clustered_vectors(spark, monkeypatch):
    """The share of pairs that is scored falls as clusters grow in number."""
    monkeypatch.setattr(vector_index, "TILE", 32)
    rng, share = np.random.default_rng(7), []
    for n in (500, 4000):
        vecs = clustered(rng, n, n // 25)
        v = spark.createDataFrame(list(enumerate(vecs)), "k long, v array<double>")
        pairs = spark.sparkContext.accumulator(0)
        q = v.where("k % 50 = 0").selectExpr("k as q", "v as w")
        got = answers(indexed_top_k(v, "k", "v", q, "q", "w", 5, scored=pairs))
        assert got == brute(list(enumerate(vecs)), [(i, vecs[i]) for i in range(0, n, 50)], 5)
        share.append(pairs.value / (n * n / 50))
    assert share[1] < share[0] < 0.5 and share[1] < 0.15


def test_a_bad_fit_and_small_tables(spark):
    rng = np.random.default_rng(8)
    vecs = clustered(rng, 300, 3)
    rows = list(enumerate(vecs))
    v, q = spark.createDataFrame(rows, "k long, v array<double>"), spark.createDataFrame([(5, vecs[5]), (5, vecs[5])], "q long, w array<double>")
    assert answers(indexed_top_k(v, "k", "v", q.limit(1), "q", "w", 4, sample=2)) == brute(rows, [(5, vecs[5])], 4)
    assert indexed_top_k(v, "k", "v", q, "q", "w", 4).count() == 8
    assert answers(indexed_top_k(v.where("k < 2"), "k", "v", q.limit(1), "q", "w", 4)) == brute(rows[:2], [(5, vecs[5])], 4)
    assert indexed_top_k(v.limit(0), "k", "v", q, "q", "w", 4).isEmpty()
    assert indexed_top_k(v, "k", "v", q.limit(0), "q", "w", 4).isEmpty()


def test_scores_below_need_are_not_sorted(monkeypatch):
    """The k best of a row that reach what it needs, as a full sort finds them; rows with k at most are not sorted."""
    rng, sorted_rows, sort = np.random.default_rng(9), [], np.argsort
    s = np.round(rng.uniform(size=(40, 300)), 2)
    need = np.where(np.arange(40) < 4, -2.0, np.sort(s, axis=1)[:, -3])
    best = sort(-np.round(s, 9), axis=1, kind="stable")[:, :8]
    want = sorted((i, j) for i in range(40) for j in best[i] if s[i, j] >= need[i])
    few = sum((s >= need[:, None]).sum(axis=1) <= 8)
    monkeypatch.setattr(np, "argsort", lambda a, **x: (sorted_rows.append(len(a)), sort(a, **x))[1])
    assert sorted(zip(*vector_index._leading(s, need, 8))) == want
    assert sum(sorted_rows) == 40 - few <= 12
