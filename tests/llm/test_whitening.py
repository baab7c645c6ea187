import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from scorecraft.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n long, component int, whitened double"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], SCHEMA).repartition(parts)


def integer_rows(rows):
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    lengths = Counter(len(v) for _, v in sound)
    dim = max(lengths, key=lambda n: (lengths[n], n))
    return [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in sound if len(v) == dim]


def exact_covariance(xs):
    n, dim = len(xs), len(xs[0])
    mean = [Fraction(sum(x[k] for x in xs), n) for k in range(dim)]
    return mean, [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n for j in range(dim)] for i in range(dim)]


def leverrier(matrix):
    """Characteristic polynomial by traces of powers, exact."""
    dim = len(matrix)
    a = np.array(matrix, dtype=object)
    coefs, m = [1], np.zeros((dim, dim), dtype=object)
    for k in range(1, dim + 1):
        m = a @ m + coefs[-1] * np.array([[int(i == j) for j in range(dim)] for i in range(dim)], dtype=object)
        coefs.append(-Fraction(int(np.trace(a @ m)), k))
    return [int(c) for c in reversed(coefs)]


def check(spark, rows, count=8):
    got = W.whiten(table(spark, rows), count).collect()
    ints = integer_rows(rows)
    n, dim = len(ints), len(ints[0][1])
    mean, cov = exact_covariance([x for _, x in ints])
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > 1e-9 * values[0]).sum())
    comps = min(count, rank)
    assert len(got) == n * comps
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, comps + 1))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sums = [sum(x[k] for _, x in ints) for k in range(dim)]
    expected = Counter((i, sum((n * v - s) ** 2 for v, s in zip(x, sums))) for i, x in ints)
    assert Counter({k: v * comps for k, v in expected.items()}) == Counter((r.vec_id, r.deviation) for r in got)
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    centred = {i: np.array([float(v - m) for v, m in zip(x, mean)]) for i, x in ints}
    return got, centred, values, vectors, comps


def test_whitened_rows(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(0, 0.3, (300, 12)) @ np.diag(np.linspace(2.0, 0.1, 12))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(400 + i, rows[0][1]) for i in range(150)]  # a group of copies
    rows += [(900, None), (901, [1.0, None] * 6), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [1.0]), (905, [])]
    got, centred, values, vectors, comps = check(spark, rows)
    for c in range(comps):
        assert values[c] - values[c + 1] > 1e-6 * values[0]  # else the comparison below means nothing
        pairs = [(r.whitened, float(centred[r.vec_id] @ vectors[:, c]) / math.sqrt(values[c])) for r in got if r.component == c + 1]
        sign = 1 if sum(a * b for a, b in pairs) > 0 else -1
        assert max(abs(a - sign * b) for a, b in pairs) < 1e-8


def test_few_rows_repeated_ids_and_low_rank(spark):
    rows = [(1, [0.5, 1.0, 0.0]), (1, [0.5, 1.0, 0.0]), (None, [0.25, 0.0, 0.0]), (3, [0.0, 2.0, 0.0])]
    _, _, _, _, comps = check(spark, rows)
    assert comps == 2


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]):
        assert W.whiten(table(spark, rows, 1)).collect() == []


def test_huge_entries(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e18, 0.5]), (4, [0.0, 0.0])]
    got = W.whiten(table(spark, rows)).collect()
    assert len(got) == 8 and {r.deviation for r in got} == {None}
    assert got[0].identity_error < 1e-6


@pytest.mark.parametrize("dim", [1, 2, 5, 9, 16])
def test_polynomial_against_traces(spark, dim):
    rng = np.random.default_rng(dim)
    y = rng.integers(-5000, 5000, (dim + 3, dim))
    if dim == 9:
        y[:, 3] = y[:, 2]  # a null direction
    matrix = [[int(v) for v in row] for row in (y.T @ y)]
    assert W.characteristic_polynomial(spark, matrix) == leverrier(matrix)


def product(roots):
    coefs = [1]
    for r in roots:
        coefs = [a - r * b for a, b in zip([0] + coefs, coefs + [0])]
    return coefs


def test_roots_with_multiplicity():
    for roots in ([5], [9, 4, 1], [7, 7, 7, 2], [100, 99, 98, 98, 0, 0], [10**30 + 1, 10**30, 3], [4, 2, 1], [0, 0]):
        found = W.largest_roots(product(roots), 8)
        expanded = [(Fraction(a, 1) / Fraction(2) ** bits, bits) for a, bits, m in found for _ in range(m)]
        positive = sorted((r for r in roots if r), reverse=True)
        assert len(expanded) == len(positive)
        for (value, bits), root in zip(expanded, positive):
            assert abs(value - root) <= Fraction(1) / Fraction(2) ** bits
            assert abs(value - root) <= Fraction(root) / 2**120
    assert [m for _, _, m in W.largest_roots(product([9, 8, 7, 6]), 2)] == [1, 1]


def test_null_vectors_are_exact_to_a_double():
    close = [[10**12 + 1, 1, 0], [1, 10**12 + 1, 0], [0, 0, 10**12 + 3]]  # roots 10^12 + 3, + 2 and + 0
    for value, expected in ((10**12 + 3, [0, 0, 1]), (10**12 + 2, [0.5**0.5, 0.5**0.5, 0])):
        numerator = (value << 200) + 1
        vector = W.null_vectors(close, numerator, 200, 1)[0]
        assert vector == pytest.approx(expected, abs=1e-15)
    twice = W.null_vectors([[5, 0, 0], [0, 5, 0], [0, 0, 1]], (5 << 200) + 1, 200, 2)
    assert np.array(twice) @ np.array(twice).T == pytest.approx(np.eye(2), abs=1e-15)


def test_exact_sums_of_large_integers():
    rng = np.random.default_rng(1)
    y = rng.integers(-(1 << 61), 1 << 61, (50, 3))
    first, second = W.exact_sums(y)
    rows = [[int(v) for v in r] for r in y]
    assert list(first) == [sum(r[k] for r in rows) for k in range(3)]
    assert second.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
