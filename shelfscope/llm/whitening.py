"""Whitening of embeddings: exact scatter, pivoted Cholesky, one-sided Jacobi on the triangular factor.

Distinct integer vectors are the fit list. Tasks add up their sums, and then the products of their centred vectors, as exact
integers, so the covariance doesn't depend on how rows are dealt to tasks. What is factored is one matrix for each length of
vectors, in one task; the leading components go to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, materialize

#: Exact sums travel as high * 2**60 + low, which no number of rows brings out of 38 digits.
_LOW = 2**60
_SUMS = "dim int, i int, j int, high decimal(38,0), low decimal(38,0)"
_EPS = np.finfo(float).eps
#: Passes over all pairs of columns at most; a few are enough.
SWEEPS = 60


def integer_vector(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each component as long; null if the vector is null or holds a null, NaN or infinite component."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(vector.isNotNull() & ~F.exists(x, bad), F.transform(x, lambda c: F.floor(c * scale).cast("long")))


def _by_length(vectors: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors as a matrix of int64) for each length of a batch."""
    sizes = vectors.map(len).to_numpy(dtype=np.int64)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, np.array(vectors.iloc[at].tolist(), dtype=np.int64).reshape(len(at), dim)


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of columns as Python integers."""
    small = len(x) == 0 or np.abs(x.astype(float)).max(initial=0) * len(x) < 2.0**62
    return x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)


def exact_products(z: np.ndarray) -> np.ndarray:
    """z' z as Python integers; in doubles where all sums of products are integers that doubles hold."""
    most = np.abs(z.astype(float)).max(initial=0)
    if most * most * max(len(z), 1) < 2.0**52:
        f = z.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    whole = z.astype(object)
    return whole.T @ whole


def _parted(dim: int, entries: list[tuple[int, int, int]]) -> pd.DataFrame:
    return pd.DataFrame({
        "dim": dim, "i": [e[0] for e in entries], "j": [e[1] for e in entries],
        "high": [Decimal(int(e[2]) // _LOW) for e in entries], "low": [Decimal(int(e[2]) % _LOW) for e in entries],
    })


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The number of vectors (i = j = -1) and the sum of each component (i = -1) of a task."""
    held: dict[int, list] = {}
    for batch in batches:
        for dim, _, x in _by_length(batch["x"]):
            n, s = held.get(dim, (0, np.zeros(dim, dtype=object)))
            held[dim] = [n + len(x), s + exact_sum(x)]
    for dim, (n, s) in held.items():
        yield _parted(dim, [(-1, -1, n), *((-1, j, v) for j, v in enumerate(s))])


def _scatter(batches: Iterator[pd.DataFrame], middle: dict[int, list[int]]) -> Iterator[pd.DataFrame]:
    """Sums of z_i z_j (j <= i) and of z_j (i = -1) of a task, for z = x - middle, the integers next to the mean."""
    held: dict[int, list] = {}
    for batch in batches:
        for dim, _, x in _by_length(batch["x"]):
            c = np.array(middle[dim], dtype=object)
            wide = max(np.abs(x.astype(float)).max(initial=0), max(map(abs, middle[dim]), default=0)) >= 2**61
            z = x.astype(object) - c if wide else x - c.astype(np.int64)
            products, s = held.get(dim, (np.zeros((dim, dim), dtype=object), np.zeros(dim, dtype=object)))
            held[dim] = [products + exact_products(z), s + exact_sum(z)]
    for dim, (products, s) in held.items():
        yield _parted(dim, [(-1, -1, 0), *((-1, j, v) for j, v in enumerate(s)), *((i, j, products[i, j]) for i in range(dim) for j in range(i + 1))])


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (d x r) with L L' = v for a positive semidefinite v of rank r; rows stand in the order of v, pivots fall."""
    d = len(v)
    rest, factor, done = v.diagonal().copy(), np.zeros((d, d)), np.zeros(d, dtype=bool)
    stop = d * _EPS * rest.max(initial=0)
    for k in range(d):
        p = int(np.argmax(np.where(done, -1.0, rest)))
        if done[p] or rest[p] <= stop:
            return factor[:, :k]
        column = v[:, p] - factor[:, :k] @ factor[p, :k]
        column[done] = 0
        factor[:, k] = column / np.sqrt(rest[p])
        factor[p, k] = np.sqrt(rest[p])
        rest = rest - factor[:, k] ** 2
        done[p] = True
    return factor


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of factor @ factor', by falling eigenvalue: columns are rotated until all are orthogonal.

    Pairs are dealt as in a tournament, so that half of the columns are rotated against the other half at once.
    """
    d, r = factor.shape
    u = np.concatenate([factor, np.zeros((d, r % 2))], axis=1)
    order, half = np.arange(u.shape[1]), u.shape[1] // 2
    for _ in range(SWEEPS):
        turned = False
        for _ in range(max(len(order) - 1, 0)):
            p, q = order[:half], order[half:][::-1]
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            need = np.abs(ab) > d * _EPS * np.sqrt(aa * bb)
            if need.any():
                turned = True
                zeta = (bb - aa) / (2 * np.where(need, ab, 1))
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = np.where(need, 1 / np.hypot(1, t), 1.0)
                s = np.where(need, c * t, 0.0)
                u[:, p], u[:, q] = c * a - s * b, s * a + c * b
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    norms = np.sqrt((u * u).sum(axis=0))
    place = np.argsort(-norms, kind="stable")[:r]
    return norms[place] ** 2, u[:, place] / norms[place]


def _fitted(rows: pd.DataFrame, known: dict[int, tuple[int, list[int]]], most: int) -> pd.DataFrame:
    """The leading components of one length of vectors: dim, component, e, explained, direction. The largest entry is positive."""
    dim = int(rows["dim"].iloc[0])
    n = known[dim][0]
    value = {(i, j): int(h) * _LOW + int(low) for i, j, h, low in zip(rows["i"], rows["j"], rows["high"], rows["low"], strict=True)}
    v = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i + 1):  # an integer by an integer is rounded once
            v[i, j] = v[j, i] = (n * value[i, j] - value[-1, i] * value[-1, j]) / (n * n)
    trace = sum(n * value[i, i] - value[-1, i] ** 2 for i in range(dim)) / (n * n)
    e, c = one_sided_jacobi(pivoted_cholesky(v))
    out = []
    for k in range(min(most, len(e))):
        direction = c[:, k] * (1 if c[np.argmax(np.abs(c[:, k])), k] > 0 else -1)
        out.append((dim, k + 1, float(e[k]), float(e[k] / trace), direction.tolist()))
    return pd.DataFrame(out, columns=["dim", "component", "e", "explained", "direction"])


def whitened(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row with a usable vector and each leading component.

    Entries become x = floor(scale * c). The fit list is each distinct x once: n of them with sums S, and their covariance (divisor
    n) gives components by falling eigenvalue e. deviation is the sum of (n * x - S)^2, whitened the projection of x - S / n over
    sqrt(e), explained e over the trace, identity_error the largest entry of the covariance of whitened over the fit list, less the
    identity.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out; null ids stay; rows that repeat each give their
    rows. Vectors of different lengths are fits of their own; a vector of fewer entries than components has one for each entry.
    Where less than that many directions vary (one distinct vector, say), whitened is null for the rest and explained 0, or null if
    nothing varies at all; identity_error is null if no component varies. A deviation beyond 64 bits is null. An empty table gives
    an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    points = rows.select(F.col(id_col).alias("vec_id"), integer_vector(F.col(vector_col), scale).alias("x")).where(F.col("x").isNotNull())
    fit = materialize(points.select("x").distinct(), "fit-list")

    def added(parts: DataFrame) -> DataFrame:
        return parts.groupBy("dim", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))

    # one number for each component of each length of vectors
    known: dict[int, tuple[int, list[int]]] = {}
    got = {(r.dim, r.j): int(r.high) * _LOW + int(r.low) for r in added(fit.mapInPandas(_sums, _SUMS)).collect()}
    for dim in sorted({d for d, _ in got}):
        known[dim] = got[dim, -1], [got[dim, j] for j in range(dim)]
    middle = {dim: [(2 * s + n) // (2 * n) for s in sums] for dim, (n, sums) in known.items()}

    products = added(fit.mapInPandas(lambda it: _scatter(it, middle), _SUMS))
    leading = products.groupBy("dim").applyInPandas(lambda g: _fitted(g, known, components), "dim int, component int, e double, explained double, direction array<double>").collect()
    model = {}
    for dim, (n, sums) in known.items():
        own = sorted((r for r in leading if r.dim == dim), key=lambda r: r.component)
        direction = np.array([r.direction for r in own], dtype=float).reshape(len(own), dim)
        model[dim] = n, sums, np.array([s / n for s in sums]), direction.T / np.sqrt([r.e for r in own]) if own else np.zeros((dim, 0)), [r.explained for r in own]
    shared = spark.sparkContext.broadcast(model)  # a few vectors for each length

    @F.pandas_udf("deviation long, w array<double>")
    def projected(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            far, w = np.full(len(vectors), None, dtype=object), np.full(len(vectors), None, dtype=object)
            for dim, at, x in _by_length(vectors):
                n, sums, mean, onto, _ = shared.value[dim]
                far[at] = deviations(x, n, sums)
                w[at] = list((x - mean) @ onto)
            yield pd.DataFrame({"deviation": pd.array(far, dtype="Int64"), "w": w})

    # how far the covariance of what comes out is from the identity, over the fit list
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    listed = fit.select(F.size("x").alias("dim"), projected("x")["w"].alias("w"))
    covariance = lambda i, j: F.abs(F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))) - F.lit(float(i == j)))
    errors = listed.groupBy("dim").agg(F.array_max(F.array(*(covariance(i, j) for i, j in pairs))).alias("identity_error")).collect()
    error = {r.dim: r.identity_error for r in errors}
    for_each = [(dim, k + 1, m[0], m[4][k] if k < len(m[4]) else (0.0 if m[4] else None), error[dim]) for dim, m in model.items() for k in range(min(components, dim))]
    small = spark.createDataFrame(for_each, "dim int, component int, n long, explained double, identity_error double")

    out = points.withColumn("p", projected("x")).select("vec_id", F.size("x").alias("dim"), F.col("p.deviation").alias("deviation"), F.col("p.w").alias("w"))
    out = out.join(F.broadcast(small), "dim").select("vec_id", "component", "n", "deviation", F.get("w", F.col("component") - 1).alias("whitened"), "explained", "identity_error")
    out = materialize(out, "whitened")
    drop_table(fit)
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n * x - S)^2 of each row, exact; None where it leaves 64 bits."""
    most = n * np.abs(x.astype(float)).max(initial=0) + max(map(abs, sums), default=0)
    if most * most * max(x.shape[1], 1) < 2.0**62:
        y = n * x - np.array(sums, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - np.array(sums, dtype=object)
    return [int(s) if s < 2**63 else None for s in (y * y).sum(axis=1)]
