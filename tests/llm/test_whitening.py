"""Whitening against exact arithmetic and numpy's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from threadloom.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def plain(vectors, k=4):
    """Whitened vectors up to sign, shares, and exact deviations."""
    x = np.floor(np.asarray(vectors, dtype=np.float64) * 256)
    fit = np.unique(x, axis=0)
    values, turn = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, turn = values[::-1], turn[:, ::-1]
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    deviations = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return (x - fit.mean(axis=0)) @ turn[:, :k] / np.sqrt(values[:k]), values / values.sum(), deviations, n


def table(rows, k):
    found = np.full((len({r.vec_id for r in rows}), k), np.nan)
    for r in rows:
        found[r.vec_id, r.component - 1] = r.whitened
    return found


def test_whole_table(spark):
    rows = queries.QUERIES["op12_whitening"](spark, SF).collect()
    given = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    expected, shares, deviations, n = plain([r.embedding for r in given])
    place = {r.vec_id: i for i, r in enumerate(given)}
    got = np.full(expected.shape, np.nan)
    for r in rows:
        i = place[r.vec_id]
        got[i, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviations[i])
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
    assert len(rows) == 4 * len(given)
    signs = np.sign((got * expected).sum(axis=0))
    assert np.allclose(got, expected * signs, atol=1e-9)


@pytest.mark.parametrize("d", [1, 2, 3, 7, 13])
def test_characteristic_polynomial(d):
    rng = np.random.default_rng(d)
    matrix = rng.integers(-50, 50, (d, d))
    matrix[rng.random((d, d)) < 0.5] = 0  # zero pivots
    p = whitening.primes(200)
    found = whitening.polynomial_modulo(np.stack([matrix % q for q in p]), np.array(p))
    got = whitening.remainders(p, found.tolist())
    for t in range(-d, d + 1):
        rows = [[Fraction(int(i == j) * t - int(matrix[i, j])) for j in range(d)] for i in range(d)]
        assert sum(c * t**i for i, c in enumerate(got)) == determinant(rows)


def determinant(rows):
    result = Fraction(1)
    for k in range(len(rows)):
        pivot = next((i for i in range(k, len(rows)) if rows[i][k]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != k:
            rows[k], rows[pivot], result = rows[pivot], rows[k], -result
        result *= rows[k][k]
        for i in range(k + 1, len(rows)):
            factor = rows[i][k] / rows[k][k]
            rows[i] = [a - factor * b for a, b in zip(rows[i], rows[k], strict=True)]
    return result


def test_roots_of_a_known_polynomial():
    roots = [0, 0, 3, 3, 7, 1000000007, 1000000008]
    coefficients = [1]
    for r in roots:
        shifted = [0, *coefficients]
        coefficients = [a - r * b for a, b in zip(shifted, [*coefficients, 0], strict=True)]
    assert [whitening.roots_above(coefficients, t) for t in (-1, 0, 3, 6, 7, 1000000007)] == [7, 5, 3, 3, 2, 1]
    found = whitening.largest_roots(coefficients, 7)
    assert [(n / 2**s, m) for n, s, m in found] == [(1000000008, 1), (1000000007, 1), (7, 1), (3, 2)]
    assert whitening.largest_roots(coefficients, 1)[0][2] == 1
    exact = whitening.largest_roots([-2, 0, 1][:0] or [2, -4, 1], 2)  # 2 + sqrt 2 and 2 - sqrt 2
    assert [n / 2**s for n, s, _ in exact] == pytest.approx([2 + math.sqrt(2), 2 - math.sqrt(2)], rel=1e-15)


def test_multiple_eigenvalue(spark):
    points = [(i, [float(s) * (i // 2 == d) for d in range(3)]) for i in range(6) for s in [(-1) ** i]]
    rows = whitening.whiten(spark.createDataFrame(points, "vec_id long, embedding array<float>")).collect()
    found = table(rows, 3)
    assert {r.component for r in rows} == {1, 2, 3} and rows[0].identity_error < 1e-12
    assert np.allclose(found.T @ found / 6, np.eye(3))
    assert all(r.explained == pytest.approx(1 / 3) for r in rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        None, [], [1.0], [nan, 1.0, 2.0], [inf, 0.0, 0.0], [None, 1.0, 2.0], [1e30, 0.0, 0.0],
        [0.5, -0.25, 1.0], [0.5, -0.25, 1.0], [0.0, 0.0, 0.0], [-0.001, 2.0, 3.0], [4.0, 1.0, -7.0], [4.0, 1.01, -7.0],
    ]
    rows = [(None if i == 12 else i, v, "x", 1.0) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, x double")
    got = whitening.whiten(frame).collect()
    kept = vectors[7:]
    expected, shares, deviations, n = plain(kept, 3)
    assert n == 5 and sorted({r.vec_id for r in got}, key=str) == [10, 11, 7, 8, 9, None]
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(by) == 18
    for c in (1, 2, 3):
        own = np.array([by[None if i == 12 else i, c].whitened for i in range(7, 13)])
        assert np.allclose(own, expected[:, c - 1], atol=1e-6) or np.allclose(own, -expected[:, c - 1], atol=1e-6)
        assert by[7, c].explained == pytest.approx(shares[c - 1], rel=1e-6)
    assert [by[None if i == 12 else i, 1].deviation for i in range(7, 13)] == deviations
    assert whitening.whiten(frame.limit(0)).collect() == []
    assert whitening.whiten(frame.filter("vec_id in (7, 8)")).collect() == []  # one distinct vector
    assert {r.component for r in whitening.whiten(frame.filter("vec_id in (7, 9)")).collect()} == {1}


def test_large_entries_are_exact(spark):
    vectors = [[2.0**40, 1.0], [-(2.0**40), 3.0], [5.0, 2.0**41]]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = whitening.whiten(frame).collect()
    assert {r.deviation for r in got} == {None} and got[0].identity_error < 1e-9
    x = [[int(256 * c) for c in v] for v in vectors]
    found = whitening.scatter(frame.select(whitening.integers(frame["embedding"]).alias("x")), 2)
    sums = [sum(v[i] for v in x) for i in range(2)]
    assert found.sums == tuple(sums)
    assert found.matrix == tuple(
        tuple(3 * sum(v[i] * v[j] for v in x) - sums[i] * sums[j] for j in range(2)) for i in range(2)
    )
