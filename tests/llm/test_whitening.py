"""Whitening against exact fractions, and its eigenvectors against known ones."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from tideline.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def exact(rows):
    """n, S, V (fractions) over the distinct integer vectors of the usable rows, and these rows."""
    used = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = {x for _, x in used}
    n, dims = len(fit), len(next(iter(fit)))
    sums = [sum(x[k] for x in fit) for k in range(dims)]
    d = [[Fraction(x[k]) - Fraction(sums[k], n) for k in range(dims)] for x in fit]
    return n, sums, [[sum(r[a] * r[b] for r in d) / n for b in range(dims)] for a in range(dims)], used


def rows_of(rng, n, dims, scale=1.0):
    base = rng.normal(0, 1, (n, dims)) @ rng.normal(0, scale, (dims, dims)) + 40
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    rows += [(1000, rows[0][1]), (0, rows[0][1]), (None, rows[3][1]), (5, None), (6, [None] + rows[1][1][1:]), (7, [float("nan")] + rows[1][1][1:]), (8, [math.inf] + rows[2][1][1:]), (1009, [c + 1e-9 for c in rows[4][1]])]
    return rows


def test_all_columns_match_exact_fractions(spark):
    rng = np.random.default_rng(3)
    rows = rows_of(rng, 300, 7)
    out = whitening.op12_whitening(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(5)).collect()
    n, sums, cov, used = exact(rows)
    assert len(out) == 4 * len(used) and {r.n for r in out} == {n} and sorted((r.vec_id is None, r.vec_id) for r in out if r.component == 2) == sorted((i is None, i) for i, _ in used)
    want = np.array([[float(c) for c in r] for r in cov])
    values, vectors = np.linalg.eigh(want)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {i: x for i, x in used}
    for k in range(4):
        own = [r for r in out if r.component == k + 1]
        assert {r.explained for r in own} == {own[0].explained} and math.isclose(own[0].explained, values[k] / values.sum(), rel_tol=1e-12)
        plain = {i: (np.array(x, float) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k]) for i, x in by.items()}
        sign = 1 if own[0].whitened * plain[own[0].vec_id] > 0 else -1
        assert max(abs(r.whitened - sign * plain[r.vec_id]) for r in own) < 1e-11
        assert all(r.deviation == sum((n * v - s) ** 2 for v, s in zip(by[r.vec_id], sums, strict=True)) for r in own)
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-12


def test_the_covariance_keeps_twice_the_digits_of_a_double(spark):
    rng = np.random.default_rng(4)
    for scale, shift in ((1.0, 0.0), (1.0, 2.0**40), (1e-2, 1e3)):
        rows = [(k, [float(c) for c in v * [1, 1e5, 1e-2] + shift]) for k, v in enumerate(rng.normal(0, scale, (2500, 3)))]
        n, sums, cov, _ = exact(rows)
        df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
        distinct = whitening.usable(df).select("v").mapInArrow(lambda it: whitening._keys(it, 3), "x binary").distinct()
        got_n, got_sums, high, low = whitening.covariance(distinct, 3)
        assert (got_n, got_sums) == (n, sums)
        for a in range(3):
            for b in range(3):
                gap = abs(Fraction(high[a, b]) + Fraction(low[a, b]) - cov[a][b])
                assert gap <= Fraction(1, 2**80) * Fraction(math.sqrt(cov[a][a] * cov[b][b])), (scale, shift, a, b, float(gap))


def test_close_eigenvalues_keep_their_vectors():
    u = [Fraction(k * k % 7 + 1) for k in range(1, 13)]
    norm = sum(v * v for v in u)
    axes = [[Fraction(int(a == b)) - 2 * u[a] * u[b] / norm for b in range(12)] for a in range(12)]
    values = [Fraction(1), 1 - Fraction(1, 10**9), 1 - Fraction(3, 10**9), Fraction(1, 2), *(Fraction(1, 2**k) for k in range(2, 10))]
    cov = [[sum(values[k] * axes[k][a] * axes[k][b] for k in range(12)) for b in range(12)] for a in range(12)]
    high = np.array([[float(c) for c in r] for r in cov])
    low = np.array([[float(c - Fraction(h)) for c, h in zip(r, g, strict=True)] for r, g in zip(cov, high, strict=True)])
    got, vectors = whitening.eigen(high, low, 4)
    for k in range(4):
        want = np.array([float(c) for c in axes[k]])
        assert abs(got[k] - float(values[k])) < 4e-16 and min(abs(vectors[k] - want).max(), abs(vectors[k] + want).max()) < 1e-15
    plain = np.linalg.eigh(high)[1][:, ::-1].T
    assert min(abs(plain[0] - [float(c) for c in axes[0]]).max(), abs(plain[0] + [float(c) for c in axes[0]]).max()) > 1e-10


def test_slices_lose_nothing():
    rng = np.random.default_rng(5)
    high, low = whitening.two_sum(rng.normal(0, 100, (1024, 5)), rng.normal(0, 1e-15, (1024, 5)))
    total, rest = whitening.outer(high, low)
    d = [[Fraction(a) + Fraction(b) for a, b in zip(r, s, strict=True)] for r, s in zip(high.tolist(), low.tolist(), strict=True)]
    want = sum(r[1] * r[3] for r in d)
    assert abs(Fraction(total[1, 3]) + Fraction(rest[1, 3]) - want) < Fraction(1, 2**80) * 10000 * 1024


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.001])]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.op12_whitening(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA))
    assert out.count() == 0 and len(out.columns) == 7


def test_odd_tables(spark):
    # Other lengths, a constant dimension, fewer than four components, huge entries, clashing columns.
    rows = [(k, [float(k), 2.0 * k * k, 5.0], 0) for k in range(20)] + [(50, [1.0], 0), (51, [1.0, 2.0], 0), (52, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as component", "3 as v")
    out = whitening.op12_whitening(df).collect()
    assert len(out) == 40 and {r.component for r in out} == {1, 2} and {r.n for r in out} == {20} and all(r.identity_error < 1e-10 for r in out)
    huge = [(k, [1e300 * (-1) ** k, 1e15 * k, float(k)], 0) for k in range(10)]
    out = whitening.op12_whitening(spark.createDataFrame(huge, SCHEMA)).collect()
    assert out and {r.deviation for r in out} == {None} and all(math.isfinite(r.whitened) for r in out)
    assert whitening.integers(np.array([1e300, -1e300, 2.0**54, -(2.0**55), 0.5, -0.001])).tolist() == [2**63 - 1, -(2**63), 2**62, -(2**63), 128, -1]
