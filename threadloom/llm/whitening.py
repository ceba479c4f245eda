"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become integers ``x = floor(scale * c)``. The fit list is each distinct x vector once: ``n``
vectors with sums ``S``. ``M = n * sum(x x') - S S'`` is an integer matrix, ``n * n`` times their
covariance, and is added up exactly: tasks give products of their vectors, which Spark sums per cell.

The characteristic polynomial of M is computed modulo primes of 31 bits, as many as its largest
coefficient needs, in parallel: Hessenberg reduction and a recurrence, both modulo each prime. The
Chinese remainder theorem then gives the integer coefficients. All roots are real, so Descartes' rule
of signs counts those above any point exactly, multiple ones included, and bisection isolates the
largest. Each component comes from inverse iteration with M less its eigenvalue, in decimals long
enough to tell any two isolated roots apart; a multiple root has as many orthonormal components.

The driver holds one matrix and one polynomial, whose size is the square of the vectors' length and
does not grow with the rows.

Defined results: vectors that are null, empty, of another length than most (ties: the longest), or
that hold null or non-finite entries or entries outside the range of longs take no part, nor are they
in the result. Rows that repeat are transformed each and fitted once; a null id is kept. Only positive
eigenvalues have components, so that fewer than ``k`` are returned if the vectors span less, and none
for a single vector or an empty table. A ``deviation`` that no long holds is null. Components of one
multiple eigenvalue are any orthonormal ones of its space, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import materialise

K = 4
SCALE = 256
#: Bits of an eigenvalue behind those of the largest; nearer roots count as one multiple root.
PRECISION_BITS = 192
#: Decimal digits of the inverse iteration.
DIGITS = 110
#: Primes reduced by one task.
PRIMES_AT_ONCE = 8
#: Rows multiplied at once.
ROWS = 1 << 14

_HALF = 1 << 62
_LONGS = "9223372036854774784"


# Exact sums


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Whether every entry is finite and becomes a long."""
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) <= F.lit(_LONGS).cast("double"), F.lit(False)))
    return F.coalesce(fits & (F.size(vector) > 0), F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The exact product of integer matrices, as floats if these are exact, else as Python's integers."""
    largest = max(abs(int(left.min())), int(left.max())) * max(abs(int(right.min())), int(right.max()))
    if largest * left.shape[1] < 1 << 53:
        return left.astype(np.float64) @ right.astype(np.float64)
    return left.astype(object) @ right.astype(object)


def _sums(dim: int):
    """Cells ``i, j`` of the summed products of the vectors; row -1 has their sums, cell (-1, -1) their number.

    A sum is given as two decimals, multiples of 2**62 and the rest, whose own sums stay exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((dim + 1, dim + 1), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column("x").slice(at, ROWS), dim)
                full = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
                product = _product(full.T, full)
                cells += np.array([[int(v) for v in row] for row in product], dtype=object)
        i, j = np.triu_indices(dim + 1)
        values = [divmod(v, _HALF) for v in cells[i, j].tolist()]
        high, low = ([Decimal(v[part]) for v in values] for part in (0, 1))
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(j), pa.array(high, kind), pa.array(low, kind)],
            ["i", "j", "high", "low"],
        )

    return run


@dataclass(frozen=True)
class Scatter:
    """Number and sums of the distinct vectors, and ``n`` times their centred products."""

    n: int
    sums: tuple[int, ...]
    matrix: tuple[tuple[int, ...], ...]

    @property
    def trace(self) -> int:
        return sum(self.matrix[i][i] for i in range(len(self.sums)))


def scatter(vectors: DataFrame, dim: int) -> Scatter:
    """Exact sums over rows of ``x``; one row per cell comes to the driver."""
    parts = vectors.select("x").mapInArrow(
        _sums(dim), "i long, j long, high decimal(38,0), low decimal(38,0)"
    )
    sums = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    cells = np.zeros((dim + 1, dim + 1), dtype=object)
    for row in sums.collect():
        cells[row.i, row.j] = cells[row.j, row.i] = int(row.high) * _HALF + int(row.low)
    n, total = cells[dim, dim], cells[dim, :dim]
    centred = n * cells[:dim, :dim] - np.outer(total, total)
    return Scatter(n, tuple(total.tolist()), tuple(map(tuple, centred.tolist())))


# Characteristic polynomial


def _is_prime(p: int) -> bool:
    return p % 2 == 1 and all(p % q for q in range(3, isqrt(p) + 1, 2))


def primes(bits: int) -> list[int]:
    """Primes below 2**31, the largest first, whose product has more than ``bits`` bits."""
    found, product, p = [], 1, 1 << 31
    while product.bit_length() <= bits:
        p -= 1
        if _is_prime(p):
            found.append(p)
            product *= p
    return found


def _power(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    result, base, exponent = np.ones_like(base), base % p, exponent.copy()
    while exponent.any():
        result = np.where(exponent & 1, result * base % p, result)
        base, exponent = base * base % p, exponent >> 1
    return result


def hessenberg(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Matrices ``h[prime]`` reduced to Hessenberg form by similar ones, modulo each prime.

    A column's first entry below the diagonal that isn't zero becomes its pivot, which clears the
    entries below; the inverse steps on the columns keep the matrix similar.
    """
    h, each, mod = h.copy(), np.arange(len(p)), p[:, None, None]
    d = h.shape[1]
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(h[:, k + 1 :, k] != 0, axis=1)
        for axis in (0, 1):
            view = h if axis == 0 else h.swapaxes(1, 2)
            other = view[each, pivot].copy()
            view[each, pivot] = view[:, k + 1]
            view[:, k + 1] = other
        factor = h[:, k + 2 :, k] * _power(h[:, k + 1, k], p - 2, p)[:, None] % p[:, None]
        h[:, k + 2 :] = (h[:, k + 2 :] - factor[:, :, None] * h[:, None, k + 1] % mod) % mod
        moved = (h[:, :, k + 2 :] * factor[:, None, :] % mod).sum(axis=2) % p[:, None]
        h[:, :, k + 1] = (h[:, :, k + 1] + moved) % p[:, None]
    return h


def polynomial_modulo(matrix: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients, constant first, of det(t - matrix) modulo each prime."""
    h, d = hessenberg(matrix, p), matrix.shape[1]
    mod = p[:, None]
    leading = np.zeros((d + 1, len(p), d + 1), dtype=np.int64)
    leading[0, :, 0] = 1
    for k in range(1, d + 1):
        grown = np.roll(leading[k - 1], 1, axis=1)
        grown = (grown - h[:, k - 1, k - 1, None] * leading[k - 1]) % mod
        below = np.ones(len(p), dtype=np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            grown = (grown - (h[:, i - 1, k - 1] * below % p)[:, None] * leading[i - 1] % mod) % mod
        leading[k] = grown
    return leading[d]


def _residues(matrix: tuple[tuple[int, ...], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(matrix, dtype=object)
        for batch in batches:
            asked = batch.column("p").to_numpy()
            for at in range(0, len(asked), PRIMES_AT_ONCE):
                p = asked[at : at + PRIMES_AT_ONCE]
                reduced = np.stack([(whole % int(q)).astype(np.int64) for q in p])
                found = polynomial_modulo(reduced, p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p), pa.array(list(found), pa.list_(pa.int64()))], ["p", "residues"]
                )

    return run


def remainders(p: list[int], residues: list[list[int]]) -> list[int]:
    """The integers of least size with these residues, one per column."""
    product = 1
    for q in p:
        product *= q
    result = [0] * len(residues[0])
    for q, row in zip(p, residues, strict=True):
        other = product // q
        unit = other * pow(other, -1, q)
        result = [r + unit * v for r, v in zip(result, row, strict=True)]
    result = [r % product for r in result]
    return [r - product if 2 * r > product else r for r in result]


def characteristic_polynomial(spark, found: Scatter) -> list[int]:
    """Integer coefficients, constant first.

    M has no negative eigenvalue, so no coefficient is larger than ``(1 + trace / d) ** d``.
    """
    d = len(found.sums)
    asked = primes(d * (1 + found.trace // d + 1).bit_length() + 2)
    tasks = -(-len(asked) // PRIMES_AT_ONCE)
    rows = spark.createDataFrame([(q,) for q in asked], "p long").repartition(tasks)
    parts = rows.mapInArrow(_residues(found.matrix), "p long, residues array<long>").collect()
    return remainders([r.p for r in parts], [r.residues for r in parts])


# Roots


def roots_above(coefficients: list[int], point: int) -> int:
    """How many roots are larger, by Descartes' rule of signs on the shifted polynomial.

    Exact, with multiplicities, for polynomials that have real roots only.
    """
    shifted = list(coefficients)
    if point:
        for i in range(len(shifted) - 1):
            for j in range(len(shifted) - 2, i - 1, -1):
                shifted[j] += point * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(coefficients: list[int], point: int) -> int:
    value = 0
    for c in reversed(coefficients):
        value = value * point + c
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], k: int, bits: int = PRECISION_BITS) -> list[tuple[int, int, int]]:
    """``(numerator, shift, multiplicity)`` of the largest positive roots, ``numerator / 2**shift``.

    Enough roots for ``k``, counted with multiplicity. Each lies within one unit of its numerator.
    """
    d = len(coefficients) - 1
    # No root is larger than the sum of all, which no root below zero makes smaller.
    largest = max(0, -coefficients[d - 1])
    shift = max(0, bits - largest.bit_length())
    scaled = [c << shift * (d - i) for i, c in enumerate(coefficients)]
    todo, found = [(0, largest << shift, 0, roots_above(scaled, 0))], []
    while todo and sum(m for _, _, m in found) < k:
        low, high, above, upto = todo.pop()
        if above == upto:
            continue
        if high - low <= 1:
            found.append((high, shift, upto - above))
        elif upto - above == 1:
            found.append((_refined(scaled, low, high), shift, 1))
        else:
            middle = (low + high) // 2
            count = roots_above(scaled, middle)
            todo += [(low, middle, count, upto), (middle, high, above, count)]
    return found


def _refined(scaled: list[int], low: int, high: int) -> int:
    """The only root in ``(low, high]``, a simple one, by its change of sign."""
    at_high = _sign(scaled, high)
    if not at_high:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        sign = _sign(scaled, middle)
        if not sign:
            return middle
        if sign == at_high:
            high = middle
        else:
            low = middle
    return high


# Components


def _solver(matrix: np.ndarray, tiny: Decimal):
    """Solves ``matrix y = b`` by elimination with row pivots; a pivot of zero becomes ``tiny``."""
    a, d = matrix.copy(), len(matrix)
    steps = []
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        a[[k, pivot]] = a[[pivot, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        factor = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k:] -= np.outer(factor, a[k, k:])
        steps.append((pivot, factor))

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for k, (pivot, factor) in enumerate(steps):
            y[[k, pivot]] = y[[pivot, k]]
            y[k + 1 :] -= factor * y[k]
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] - a[k, k + 1 :].dot(y[k + 1 :])) / a[k, k]
        return y

    return solve


def _orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
    result: list[np.ndarray] = []
    for v in vectors:
        for _ in range(2):
            for u in result:
                v = v - u * u.dot(v)
            v = v / v.dot(v).sqrt()
        result.append(v)
    return result


def components(found: Scatter, roots: list[tuple[int, int, int]], k: int) -> list[tuple[float, list[float]]]:
    """Eigenvalue of the covariance and unit vector of each of the ``k`` first components."""
    d = len(found.sums)
    result: list[tuple[float, list[float]]] = []
    with localcontext() as context:
        context.prec = DIGITS
        matrix = np.array([[Decimal(v) for v in row] for row in found.matrix], dtype=object)
        tiny = Decimal(found.trace).scaleb(3 - DIGITS)
        for numerator, shift, multiplicity in roots:
            value = Decimal(numerator) / Decimal(1 << shift)
            solve = _solver(matrix - np.diag([value] * d), tiny)
            # Fixed starts without a pattern that a component might be orthogonal to.
            starts = np.random.Generator(np.random.PCG64(17)).integers(1, 1000, (multiplicity, d))
            vectors = [np.array([Decimal(int(v)) for v in row], dtype=object) for row in starts]
            for _ in range(3):
                vectors = _orthonormal([solve(v) for v in vectors])
            eigenvalue = float(value / found.n / found.n)
            result += [(eigenvalue, [float(x) for x in v]) for v in vectors]
    return result[:k]


# Transformed rows


def _whitened(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return (x - mean) @ turn


def _moments(mean: np.ndarray, turn: np.ndarray):
    """Per batch: number, sums and products of the whitened vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = turn.shape[1]
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = _whitened(_matrix(batch.column("x"), len(mean)), mean, turn)
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i, j, total.ravel())], ["i", "j", "v"])

    return run


def _identity_error(vectors: DataFrame, mean: np.ndarray, turn: np.ndarray) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    k = turn.shape[1]
    parts = vectors.select("x").mapInArrow(_moments(mean, turn), "i long, j long, v double")
    total = np.zeros((k + 1, k + 1))
    for row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[row.i, row.j] = row.v
    n, sums = total[k, k], total[k, :k]
    covariance = total[:k, :k] / n - np.outer(sums / n, sums / n)
    return float(np.abs(covariance - np.eye(k)).max())


def _transformed(found: Scatter, turn: np.ndarray):
    mean = np.array([float(Decimal(s) / found.n) for s in found.sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = turn.shape[1]
        for batch in batches:
            w = _whitened(_matrix(batch.column("x"), len(mean)), mean, turn)
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * k)
            lists = pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("deviation"), lists], ["vec_id", "deviation", "w"]
            )

    return run


def _deviation(found: Scatter) -> Column:
    """The sum of ``(n * x - S) ** 2`` over all dimensions, ``n * n`` times the squared distance to the mean.

    In decimals of 38 digits; null if these or a long can't hold it.
    """
    n, sums = F.lit(found.n).cast("decimal(19,0)"), F.lit([str(s) for s in found.sums])
    away = F.zip_with("x", sums, lambda x, s: (n * x.cast("decimal(19,0)") - s.cast("decimal(38,0)")).cast("decimal(38,0)"))
    # A difference whose square no long holds makes the whole sum null.
    bounded = F.transform(away, lambda v: F.when(F.abs(v) < (1 << 32), v.cast("long")))
    total = F.aggregate(
        F.transform(bounded, lambda v: v.cast("decimal(19,0)") * v), F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v).cast("decimal(38,0)")
    )
    return F.when(total <= F.lit((1 << 63) - 1).cast("decimal(19,0)"), total.cast("long"))


def whiten(
    embeddings: DataFrame,
    k: int = K,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Per usable row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``explained`` is the component's share of the variance; ``identity_error`` is one value.
    """
    spark = embeddings.sparkSession
    vector = F.col(vector_col)
    kept = embeddings.filter(usable(vector, scale)).select(
        F.col(id_col).alias("vec_id"), integers(vector, scale).alias("x")
    )
    sizes = kept.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("rows"))
    common = sizes.orderBy(F.desc("rows"), F.desc("dim")).first()
    kind = embeddings.schema[id_col].dataType.simpleString()
    result = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], result)
    kept = kept.filter(F.size("x") == common.dim)
    vectors = materialise(kept.select("x").distinct(), "vectors")
    found = scatter(vectors, common.dim)
    if not found.trace:
        return spark.createDataFrame([], result)
    roots = largest_roots(characteristic_polynomial(spark, found), k)
    parts = components(found, roots, k)
    turn = np.array([v for _, v in parts]).T / np.sqrt([e for e, _ in parts])
    mean = np.array([float(Decimal(s) / found.n) for s in found.sums])
    error = _identity_error(vectors, mean, turn)
    trace = float(Decimal(found.trace) / found.n / found.n)
    explained = F.lit([e / trace for e, _ in parts])
    rows = kept.select("vec_id", _deviation(found).alias("deviation"), "x").mapInArrow(
        _transformed(found, turn), f"vec_id {kind}, deviation long, w array<double>"
    )
    each = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
