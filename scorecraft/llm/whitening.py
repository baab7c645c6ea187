"""Embedding whitening by the exact characteristic polynomial.

A vector's components c become integers x = floor(SCALE * c) + SHIFT. For n
vectors with sums S, the scatter n * sum(x x') - S S' is n^2 times the
covariance V, and an integer matrix: nothing is rounded before its eigenvalues
are known. It does not change when the same vector is taken from every x, so
it is summed over y = x - SHIFT.

1. Tasks sum y and y y' exactly (matrix products of 20-bit limbs, which doubles
   hold exactly) and send limbs of the sums; Spark adds them.
2. The scatter's characteristic polynomial is found modulo as many 31-bit primes
   as a bound of its coefficients needs, one Hessenberg reduction a prime, dealt
   over Spark tasks; Chinese remaindering gives its integer coefficients.
3. A symmetric matrix has real eigenvalues only, so the sign variations of the
   polynomial moved by a (Descartes) are exactly the number of roots above a.
   Halving intervals by that count isolates the largest roots; a single root is
   then halved by the polynomial's exact sign to PRECISION bits. Roots that agree
   in all those bits are taken as one of that multiplicity.
4. Inverse iteration in decimals of DIGITS digits on scatter - root * I, one Spark
   task a root, gives unit vectors of its null space, accurate to a double; the
   sign makes the largest entry positive.
5. A last pass projects every vector; the covariance of what it wrote gives the
   identity error.

Scale: passes over the vectors are map-side sums and a projection; the driver
holds matrices, polynomials and roots of the dimension's size alone, whatever
the number of rows. No row is shuffled.

Defined cases: rows whose vector is null, holds null or non-finite entries, or
has not the most frequent length (of equal frequency the longer) take no part.
Entries beyond 2^62 / SCALE count as that. Repeated rows and null ids count like
all others. Fewer components than asked for are given where V has a lower rank:
equal vectors, one vector, empty vectors or an empty table give no rows. A
deviation that is no long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal, localcontext
from functools import reduce
from hashlib import sha256
from math import comb, gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm.common import small_batches, stage

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Leading bits of a root; digits of the inverse iteration, and its rounds.
PRECISION, DIGITS, ROUNDS = 128, 120, 3
#: Limbs of the exact sums, and rows whose products of limbs a double holds.
LIMB, ROWS = 20, 1 << 13


def sound_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``id, vec`` (array of double) of the rows that take part, and their length."""
    vec = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    sound = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(sound, vec).alias("vec")).filter(F.col("vec").isNotNull())
    length = F.size("vec").alias("length")
    usual = rows.groupBy(length).count().orderBy(F.desc("count"), F.desc("length")).first()
    dim = usual["length"] if usual else 0
    return rows.filter(F.size("vec") == dim), dim


def integers(vecs: pa.Array, dim: int) -> np.ndarray:
    """y = x - SHIFT of a batch, a row a vector."""
    flat = np.floor(SCALE * vecs.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
    return np.clip(flat, -(2.0**62), 2.0**62).astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Arrays of doubles p with y = sum p[k] * 2^(LIMB * k), |p| <= 2^(LIMB - 1)."""
    out, half = [], 1 << (LIMB - 1)
    while not out or y.any():
        low = ((y + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
    return out


def exact_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of y and of y y', as Python integers."""
    dim = y.shape[1]
    first, second = np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
    for at in range(0, len(y), ROWS):
        parts = limbs(y[at : at + ROWS])
        for i, a in enumerate(parts):
            first += a.sum(axis=0).astype(np.int64).astype(object) << (LIMB * i)
            for j, b in enumerate(parts):
                second += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return first, second


def scatter_sums(rows: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums of y, sums of y y' over all rows. Numbers are sent as limbs of 30
    bits; place (dim, dim) of the upper triangle holds n, (i, dim) the sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        for batch in batches:
            y = integers(batch.column("vec"), dim)
            a, b = exact_sums(y)
            n, first, second = n + len(y), first + a, second + b
        cells = [(dim, dim, n)] + [(i, dim, first[i]) for i in range(dim)]
        cells += [(i, j, second[i, j]) for i in range(dim) for j in range(i, dim)]
        out = []
        for i, j, value in cells:
            sign, value, k = (-1 if value < 0 else 1), abs(int(value)), 0
            while value:
                out.append((i, j, k, sign * (value & (2**30 - 1))))
                value, k = value >> 30, k + 1
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "k", "v"]
        )

    found = rows.select("vec").mapInArrow(sums, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    total: dict[tuple[int, int], int] = {}
    for r in found.collect():  # dim^2 numbers
        total[r["i"], r["j"]] = total.get((r["i"], r["j"]), 0) + (r["v"] << (30 * r["k"]))
    get = lambda i, j: total.get((min(i, j), max(i, j)), 0)
    return get(dim, dim), [get(i, dim) for i in range(dim)], [[get(i, j) for j in range(dim)] for i in range(dim)]


# --- the characteristic polynomial -------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin, exact below 2^32 with the bases 2, 7 and 61."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 61)):
        return n in (2, 3, 5, 7, 61)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_over(bound: int) -> list[int]:
    """Primes below 2^31, from the top, whose product is over ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def coefficient_bound(trace: int, dim: int) -> int:
    """No coefficient of the characteristic polynomial of a matrix without
    negative eigenvalues is larger in size (Maclaurin's inequality)."""
    return max(comb(dim, k) * trace**k // dim**k + 1 for k in range(dim + 1))


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """The matrix reduced modulo p by similarity: zero below the subdiagonal."""
    a = a.copy()
    for k in range(len(a) - 2):
        filled = np.flatnonzero(a[k + 1 :, k])
        if not len(filled):
            continue
        i = k + 1 + filled[0]
        if i != k + 1:
            a[[i, k + 1]] = a[[k + 1, i]]
            a[:, [i, k + 1]] = a[:, [k + 1, i]]
        f = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :, k:] = (a[k + 2 :, k:] - f[:, None] * a[k + 1, k:] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * f % p).sum(axis=1)) % p
    return a


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x I - matrix) modulo p, the constant first."""
    dim = len(matrix)
    h = hessenberg(np.array([[v % p for v in row] for row in matrix], dtype=np.int64).reshape(dim, dim), p)
    polys = np.zeros((dim + 1, dim + 1), dtype=np.int64)
    polys[0, 0] = 1
    for m in range(dim):
        weights, product = np.zeros(m, dtype=np.int64), 1
        for i in range(m - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            weights[i] = product * int(h[i, m]) % p
        polys[m + 1, 1:] = polys[m, :-1]
        polys[m + 1] -= h[m, m] * polys[m] % p + (weights[:, None] * polys[:m] % p).sum(axis=0)
        polys[m + 1] %= p
    return [int(c) for c in polys[dim]]


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """The integers, positive or negative, that have these residues."""
    values, modulus = None, 1
    for p, found in residues.items():
        if values is None:
            values, modulus = list(found), p
            continue
        inverse = pow(modulus, -1, p)
        values = [v + modulus * ((r - v) * inverse % p) for v, r in zip(values, found)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact integer coefficients, the constant first; a prime's work is a row."""
    dim, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    primes = primes_over(2 * coefficient_bound(trace, dim) + 1)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"p": batch["p"], "residues": [polynomial_mod(matrix, int(p)) for p in batch["p"]]})

    tasks = max(1, min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    found = rows.mapInPandas(reduced, "p long, residues array<long>").collect()  # dim^2 numbers
    coefs = remaindered({r["p"]: r["residues"] for r in found})
    if coefs[dim] != 1 or coefs[dim - 1] != -trace or any(c * (-1) ** (dim - k) < 0 for k, c in enumerate(coefs)):
        raise ArithmeticError("the polynomial found is not that of a scatter matrix")
    return coefs


# --- its roots ---------------------------------------------------------------


def variations(coefs: list[int]) -> int:
    """Sign variations: the number of roots above 0 where all are real."""
    signs = [c > 0 for c in coefs if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def moved_by_one(coefs: list[int]) -> list[int]:
    """q(u + 1) of q(u), by sums alone."""
    out = list(coefs)
    for i in range(len(out) - 1):
        total = 0
        for k in range(len(out) - 1, i - 1, -1):
            total += out[k]
            out[k] = total
    return out


def value_sign(coefs: list[int], numerator: int, bits: int) -> int:
    """Sign at numerator / 2^bits."""
    total, degree = 0, len(coefs) - 1
    for k in range(degree, -1, -1):
        total = total * numerator + (coefs[k] << (bits * (degree - k)))
    return (total > 0) - (total < 0)


def largest_roots(coefs: list[int], count: int) -> list[tuple[int, int, int]]:
    """The largest positive roots of a polynomial without other than real roots
    and none below 0, as ``numerator, bits, multiplicity``, falling: the root is
    in ((numerator - 1) / 2^bits, (numerator + 1) / 2^bits)."""
    while len(coefs) > 1 and coefs[0] == 0:
        coefs = coefs[1:]
    degree = len(coefs) - 1
    if not degree:
        return []
    top = max(-coefs[degree - 1], 1).bit_length()  # every root is below their sum
    found = []
    # An interval (i, i + 1] / 2^(depth - top) with its polynomial moved to it.
    stack = [(0, 0, [c << (top * k) for k, c in enumerate(coefs)], 0)]
    while stack:
        i, depth, q, above = stack.pop()
        inside = variations(q) - above
        if inside <= 0 or above >= count:
            continue
        if i.bit_length() >= PRECISION:
            found.append((2 * i + 1, depth + 1 - top, inside))
            continue
        if inside == 1 and i:
            sign = 1 if above % 2 == 0 else -1  # above the root
            while i.bit_length() < PRECISION:
                i, depth = 2 * i, depth + 1
                at, bits = (i + 1, depth - top) if depth >= top else ((i + 1) << (top - depth), 0)
                if value_sign(coefs, at, bits) == -sign:
                    i += 1
            found.append((2 * i + 1, depth + 1 - top, 1))
            continue
        left = [c << (degree - k) for k, c in enumerate(q)]
        right = moved_by_one(left)
        over = variations(right)
        stack.append((2 * i, depth + 1, left, over))
        stack.append((2 * i + 1, depth + 1, right, above))
    return found


# --- null spaces -------------------------------------------------------------


def factored(matrix: list[list[int]], root: Decimal) -> tuple[list[list[Decimal]], list[int]]:
    """LU factors of matrix - root * I with row exchanges, in the context's digits."""
    dim = len(matrix)
    a = [[Decimal(v) for v in row] for row in matrix]
    for i in range(dim):
        a[i][i] -= root
    tiny = max(abs(root), Decimal(1)).scaleb(-2 * DIGITS)
    order = list(range(dim))
    for k in range(dim):
        best = max(range(k, dim), key=lambda r: abs(a[r][k]))
        a[k], a[best], order[k], order[best] = a[best], a[k], order[best], order[k]
        if not a[k][k]:
            a[k][k] = tiny
        pivot = a[k]
        for row in a[k + 1 :]:
            if row[k]:
                f = row[k] = row[k] / pivot[k]
                row[k + 1 :] = [x - f * y for x, y in zip(row[k + 1 :], pivot[k + 1 :])]
    return a, order


def solved(lu: list[list[Decimal]], order: list[int], b: list[Decimal]) -> list[Decimal]:
    x = [b[i] for i in order]
    for i, row in enumerate(lu):
        x[i] -= sum((row[j] * x[j] for j in range(i)), Decimal(0))
    for i in range(len(lu) - 1, -1, -1):
        x[i] = (x[i] - sum((lu[i][j] * x[j] for j in range(i + 1, len(lu))), Decimal(0))) / lu[i][i]
    return x


def unit(v: list[Decimal], others: list[list[Decimal]]) -> list[Decimal]:
    """v made orthogonal to the others, of length 1."""
    for _ in range(2):
        for o in others:
            dot = sum((a * b for a, b in zip(v, o)), Decimal(0))
            v = [a - dot * b for a, b in zip(v, o)]
        length = sum((a * a for a in v), Decimal(0)).sqrt()
        v = [a / length for a in v]
    return v


def null_vectors(matrix: list[list[int]], numerator: int, bits: int, multiplicity: int) -> list[list[float]]:
    """An orthonormal basis of the root's null space, rounded to doubles."""
    with localcontext(Context(prec=DIGITS)):
        root = Decimal(numerator) * Decimal(2) ** -bits
        lu, order = factored(matrix, root)
        basis: list[list[Decimal]] = []
        for m in range(multiplicity):
            v = [Decimal(int.from_bytes(sha256(f"{m}:{i}".encode()).digest()[:4], "big") + 1) for i in range(len(matrix))]
            for _ in range(ROUNDS):
                v = unit(solved(lu, order, unit(v, basis)), basis)
            basis.append(v)
        largest = [max(v, key=abs) for v in basis]
        return [[float(a.copy_sign(a * big)) for a in v] for v, big in zip(basis, largest)]


def components(spark: SparkSession, matrix: list[list[int]], count: int) -> list[tuple[Decimal, list[float]]]:
    """``eigenvalue, unit vector`` of the largest eigenvalues that are not 0."""
    roots = largest_roots(characteristic_polynomial(spark, matrix), count)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, numerator, bits, multiplicity in batch.itertuples(index=False):
                vectors = null_vectors(matrix, int(numerator), int(bits), int(multiplicity))
                yield pd.DataFrame({"place": [place] * len(vectors), "nth": range(len(vectors)), "vector": vectors})

    rows = [(k, str(numerator), bits, multiplicity) for k, (numerator, bits, multiplicity) in enumerate(roots)]
    todo = spark.createDataFrame(rows, "place int, numerator string, bits int, multiplicity int").repartition(max(1, len(rows)))
    found = todo.mapInPandas(solve, "place int, nth int, vector array<double>").collect()  # count vectors
    with localcontext(Context(prec=DIGITS)):
        values = [Decimal(numerator) * Decimal(2) ** -bits for numerator, bits, _ in roots]
        return [(values[r["place"]], r["vector"]) for r in sorted(found, key=lambda r: (r["place"], r["nth"]))][:count]


# --- whitening ---------------------------------------------------------------


def deviations(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they fit, else Python's integers."""
    fits = n * (int(np.abs(y).max(initial=0)) + 1) + max(map(abs, sums), default=0) < 1 << 62
    return n * y - np.array(sums, dtype=np.int64) if fits else n * y.astype(object) - np.array(sums, dtype=object)


def square_sums(dev: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; None beyond a long."""
    if dev.dtype != object and (dev.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
        return [int(v) for v in (dev * dev).sum(axis=1)]
    exact = [sum(int(v) * int(v) for v in row) for row in dev]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(
    vectors: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of
    each vector that takes part and each of the ``count`` largest components."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows, dim = sound_vectors(vectors, id_col, vector_col)
    id_type = rows.schema["id"].dataType.simpleString()
    n, sums, squares = scatter_sums(rows, dim) if dim else (0, [], [])
    scatter = [[n * squares[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    factor = reduce(gcd, (v for row in scatter for v in row), 0)
    if not factor:
        return spark.createDataFrame(
            [], f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    found = components(spark, [[v // factor for v in row] for row in scatter], count)
    with localcontext(Context(prec=DIGITS)):
        trace = Decimal(sum(scatter[i][i] for i in range(dim)) // factor)
        explained = [float(value / trace) for value, _ in found]
        # deviation from the mean = (n x - S) / n; sqrt(e) = sqrt(value * factor) / n
        scales = [float(1 / (value * factor).sqrt()) for value, _ in found]
    axes = np.array([vector for _, vector in found]).T

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dev = deviations(integers(batch.column("vec"), dim), n, sums)
            w = (dev.astype(np.float64) @ axes) * np.array(scales)
            columns = [batch.column("id"), pa.array(square_sums(dev), pa.int64()), *(pa.array(w[:, k]) for k in range(len(found)))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "deviation", *(f"w{k}" for k in range(len(found)))])

    names = [f"w{k}" for k in range(len(found))]
    projected = stage(
        rows.mapInArrow(project, f"id {id_type}, deviation long, {', '.join(f'{c} double' for c in names)}"), "whitening"
    )
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    covariance = projected.agg(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    error = max(abs(value - (i == j)) for (i, j), value in zip(pairs, covariance))
    cells = F.array(*[
        F.struct(F.lit(k + 1).alias("component"), F.col(c).alias("whitened"), F.lit(explained[k]).alias("explained"))
        for k, c in enumerate(names)
    ])
    return projected.select("id", "deviation", F.inline(cells)).select(
        F.col("id").alias("vec_id"), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(float(error)).alias("identity_error"),
    )
