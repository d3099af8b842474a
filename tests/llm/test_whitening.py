"""Whitening against exact arithmetic and an independent eigensolver."""

from fractions import Fraction

import numpy as np
import pytest

from shelfscope.llm import whitening


def plain(vectors, scale=256, components=4):
    """n, sums, covariance and its leading eigenpairs by a dense solver."""
    x = sorted({tuple(int(np.floor(scale * float(c))) for c in v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    cov = centred.T @ centred / n
    e, c = np.linalg.eigh(cov)
    return n, sums, cov, e[::-1][:components], c[:, ::-1][:, :components]


def check(df, rows, dim):
    got = whitening.whitened(df).collect()
    usable = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    n, sums, cov, e, c = plain([v for _, v in usable])
    here = [r for r in got if r.n == n]
    assert len(here) == len(usable) * min(4, dim)
    for k in range(min(4, dim)):
        ours = sorted((r for r in here if r.component == k + 1), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.whitened))
        x = {(i, tuple(v)): np.floor(256 * np.array(v, dtype=float)) for i, v in usable}
        want = [(i, sum((n * int(a) - s) ** 2 for a, s in zip(x[i, tuple(v)], sums, strict=True)), float((x[i, tuple(v)] - np.array(sums) / n) @ c[:, k] / np.sqrt(e[k]))) for i, v in usable]
        sign = np.sign(sum(a.whitened * b for a in ours for i, _, b in want if i == a.vec_id and i is not None))
        assert {(r.vec_id, r.deviation) for r in ours} == {(i, d) for i, d, _ in want}
        ours, want = sorted((str(r.vec_id), r.whitened) for r in ours), sorted((str(i), sign * w) for i, _, w in want)
        assert [a for a, _ in ours] == [a for a, _ in want] and np.allclose([b for _, b in ours], [b for _, b in want], atol=1e-8)
        assert all(abs(r.explained - e[k] / np.trace(cov)) < 1e-10 and 0 <= r.identity_error < 1e-8 for r in here if r.component == k + 1)
    return got


def test_factor_and_rotation():
    r = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 2), (5, 3), (16, 16), (33, 20), (64, 64), (7, 0)):
        half = r.normal(size=(d, rank)) * np.exp(r.normal(size=(d, 1)))
        v = half @ half.T
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v, rtol=0, atol=1e-11 * max(1, np.trace(v)))
        e, c = whitening.one_sided_jacobi(factor)
        assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9, atol=1e-12 * max(1, np.trace(v)))
        assert np.allclose(c.T @ c, np.eye(rank), atol=1e-10) and np.allclose(c * e @ c.T, v, rtol=0, atol=1e-10 * max(1, np.trace(v)))


def test_sums_are_exact():
    r = np.random.default_rng(2)
    for most in (3, 2**20, 2**40, 2**62):
        z = r.integers(-most, most, (50, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j], strict=True)) for j in range(4)] for i in range(4)]
        assert whitening.exact_products(z).tolist() == want and whitening.exact_sum(z).tolist() == [sum(map(int, z[:, j])) for j in range(4)]
        assert whitening.deviations(z, 3, [1, 2, 3, 4]) == [s if (s := sum((3 * int(a) - b) ** 2 for a, b in zip(row, (1, 2, 3, 4), strict=True))) < 2**63 else None for row in z]


SCHEMA = "vec_id long, embedding array<double>, whitened double, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, "x") for i, v in rows], SCHEMA)


def test_equals_a_dense_solver(spark):
    r = np.random.default_rng(3)
    mix = r.normal(size=(6, 6)) * np.array([3, 2, 1, 0.5, 0.2, 0.1])
    rows = [(i, (r.normal(size=6) @ mix + 1).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(7, rows[8][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("-inf")] + [0.0] * 5)]
    other = [(3000 + i, r.normal(size=2).tolist()) for i in range(20)]
    df = frame(spark, rows + other)
    got = check(df, rows, 6)
    assert [r for r in got if r.vec_id == 2000 or r.vec_id == 2003] == []
    assert {r.component for r in got if r.vec_id == 3001} == {1, 2}
    check(frame(spark, other), other, 2)
    again = whitening.whitened(df.repartition(7)).collect()
    key = lambda r: (r.vec_id is None, r.vec_id, r.component, r.whitened)
    assert [(a.vec_id, a.deviation) for a in sorted(again, key=key)] == [(a.vec_id, a.deviation) for a in sorted(got, key=key)]
    assert whitening.whitened(df.limit(0)).count() == 0


@pytest.mark.parametrize("vectors", [[[1.0, 2.0, 3.0, 4.0, 5.0]] * 3, [[1.0] * 5, [2.0] * 5], [[]], [[float(i), 1e30] for i in range(3)]], ids=["one", "a line", "none", "huge"])
def test_few_directions(spark, vectors):
    got = whitening.whitened(frame(spark, list(enumerate(vectors)))).collect()
    dim = len(vectors[0])
    assert len(got) == len(vectors) * min(4, dim)
    spread = len({tuple(v) for v in vectors}) > 1
    for r in got:
        assert (r.whitened is not None) == (spread and r.component == 1)
        if spread:
            assert r.explained == pytest.approx(float(r.component == 1)) and r.identity_error < 1e-8
        else:
            assert r.explained is None and r.identity_error is None
