"""Whitening against numpy's eigenvectors, and its edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from flowscope.llm.whitening import jacobi_columns, pivoted_cholesky, principal, whitened

SHAPE = "vec_id long, embedding array<float>"


def ours(spark, rows, shape=SHAPE, **options):
    return [r.asDict() for r in whitened(spark.createDataFrame(rows, shape), **options).collect()]


def test_equals_numpy(spark):
    rng = np.random.default_rng(7)
    made = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + rng.normal(size=6)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(902, [math.nan] * 6), (903, [math.inf] * 6), (904, [1.0]), (905, []), (5, made[5].tolist())]
    used = np.vstack([made, made[5:6]]).astype(float)
    x = np.floor(64 * used).astype(int) + 1_000_000
    n = len(x)
    z = (n * x - x.sum(0)) / n
    v = z.T @ z / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = ours(spark, rows, components=4)
    assert len(got) == n * 4
    ids = [*range(300), 5]
    for k in range(4):
        own = sorted((r for r in got if r["component"] == k + 1), key=lambda r: (r["vec_id"], r["whitened"]))
        expected = z @ vectors[:, k] / math.sqrt(values[k])
        by_id = sorted(zip(ids, range(n), strict=True))
        theirs = np.array([expected[i] for _, i in by_id])
        mine = np.array([r["whitened"] for r in own])
        sign = np.sign(mine @ theirs)
        assert np.abs(mine - sign * theirs).max() < 1e-9
        assert [int(r["deviation"]) for r in own] == [int(((n * x[i] - x.sum(0)) ** 2).sum()) for _, i in by_id]
        for r in own:
            assert r["n"] == n and abs(r["explained"] / (values[k] / v.trace()) - 1) < 1e-9
            assert 0 <= r["identity_error"] < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 2.0])], [(1, [0.5, 2.0])] * 3, [(1, None), (2, [math.nan])]])
def test_nothing_to_whiten(spark, rows):
    assert ours(spark, rows) == []


def test_components_end_at_the_rank(spark):
    got = ours(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)])
    assert {r["component"] for r in got} == {1}
    assert all(abs(r["explained"] - 1) < 1e-12 and r["identity_error"] < 1e-9 for r in got)


@pytest.mark.parametrize("large", [1e12, 3e38])
def test_large_entries_stay_exact(spark, large):
    rows = [(1, [large, 1.0]), (2, [-large, 2.0]), (3, [1e12, 3.0])]
    got = ours(spark, rows)
    assert len({r["vec_id"] for r in got}) == 3
    first = [64 * int(np.float32(v[0])) + 1_000_000 for _, v in rows]
    first = [max(-(2**63), min(2**63 - 1, x)) for x in first]
    second = [64 + 10**6, 128 + 10**6, 192 + 10**6]
    for r in got:
        i = r["vec_id"] - 1
        exact = sum((3 * c[i] - sum(c)) ** 2 for c in (first, second))
        assert r["deviation"] == (exact if exact < 10**38 else None)


def test_clashing_columns(spark):
    shape = "vec_id long, embedding array<double>, n long, component int, i int, whitened double"
    assert len(ours(spark, [(i, [float(i % 3), float(i % 5)], 1, 1, 1, 1.0) for i in range(9)], shape)) == 18


def test_factor_and_rotation():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(7, 5))
    m = a @ a.T  # rank 5
    factor, order = pivoted_cholesky(m)
    assert factor.shape == (7, 5)
    assert np.allclose(factor @ factor.T, m[np.ix_(order, order)])
    turned = jacobi_columns(factor)
    gram = turned.T @ turned
    assert np.allclose(gram, np.diag(gram.diagonal()))
    vectors, values = principal(m)
    assert np.allclose(vectors * values @ vectors.T, m)
    same = principal(2 * np.eye(3))  # equal eigenvalues
    assert np.allclose(same[1], 2) and np.allclose(same[0] @ same[0].T, np.eye(3))
