"""Whitening of embeddings by the exact characteristic polynomial of their scatter matrix.

Coordinates are whole numbers, so sums and products over all rows are exact. Tasks add them up; the
scatter matrix has one entry per pair of dimensions, whatever the number of rows. Its characteristic
polynomial is found modulo many primes, which the tasks share, by reduction to Hessenberg form; Chinese
remainders give the integer coefficients. All roots are real, so sign changes after a shift count
the roots above a point exactly (Descartes) and bisection isolates them at any precision. Components
come from inverse iteration in decimal arithmetic, for which the isolated roots are exact enough
even if they nearly coincide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.rows import flat_python, prepare

# Scale and offset of the whole-number coordinates.
SCALE = 1024
OFFSET = 100_000

# Components that are returned.
COMPONENTS = 8
# Bits to which a root is narrowed below its own size.
ROOT_BITS = 200
# Decimal digits of the inverse iteration, beyond those of the roots.
GUARD_DIGITS = 40
# Primes worked on by one task at a time.
PRIMES_A_ROW = 8

_LIMB = 20  # bits of a limb of a coordinate; products of limbs are added exactly in double precision
_PART = 40  # bits of a part of an exact sum that crosses a shuffle
_ROWS = 2**12  # rows whose products of limbs stay below 2**52


@dataclass(frozen=True)
class Whitening:
    """What is learned: rows, dimension sums, eigenvalues of the covariance (falling), their unit vectors, its trace."""

    rows: int
    sums: tuple[int, ...]
    values: tuple[float, ...]
    vectors: np.ndarray
    shares: tuple[float, ...]

    @property
    def weights(self) -> np.ndarray:
        """Columns that turn centred coordinates into whitened ones."""
        return self.vectors / np.sqrt(np.array(self.values))


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has entries, all of them finite numbers, and the length that most such rows have.

    Entries beyond 2**50 in size have no whole-number coordinate and count as not finite. Of lengths
    that equally many rows have, the greatest stays. The check of the length is a count by length.
    """
    v = F.col(f"`{vector}`")
    sound = vectors.filter(
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= 2.0**50))
    )
    by_length = sound.groupBy(F.size(v).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).head()
    return sound.filter(F.size(v) == (by_length["length"] if by_length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Centred-ready whole numbers of a batch: floor(SCALE * c), one row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(len(column), -1) * SCALE).astype(np.int64)


def _limbs(whole: np.ndarray) -> list[np.ndarray]:
    """Limbs of the numbers, low first; the last one carries the sign."""
    made = []
    while np.abs(whole).max(initial=0) >= 2**_LIMB:
        made.append((whole & (2**_LIMB - 1)).astype(np.float64))
        whole = whole >> _LIMB
    return [*made, whole.astype(np.float64)]


def _products(whole: np.ndarray) -> np.ndarray:
    """Exact sums over rows of all products of two columns, as Python integers; a column of ones comes first."""
    total = np.zeros((whole.shape[1] + 1,) * 2, dtype=object)
    for start in range(0, len(whole), _ROWS):
        block = whole[start : start + _ROWS]
        limbs = _limbs(np.column_stack([np.ones(len(block), np.int64), block]))
        for a, left in enumerate(limbs):
            for b, right in enumerate(limbs):
                total += (left.T @ right).astype(np.int64).astype(object) << (_LIMB * (a + b))
    return total


def _moments(vectors: DataFrame, vector: str) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums, and the scatter times the rows: n * sum(y y') - sum(y) sum(y)', exact for any number of rows.

    Each task sends one matrix, cut into parts that add up without overflow.
    """
    prepare(vectors.sparkSession)
    names = ["a", "b", "part", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                found = _products(_matrix(batch.column(0)))
                total = found if total is None else total + found
        if total is None:
            return
        rows = []
        for a in range(len(total)):
            for b in range(a, len(total)):
                rest, part = total[a, b], 0
                while rest not in (0, -1) or part == 0:
                    rows.append((a, b, part, rest & (2**_PART - 1)))
                    rest, part = rest >> _PART, part + 1
                if rest:
                    rows.append((a, b, part, rest))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=names)

    sent = vectors.select(F.col(f"`{vector}`")).mapInArrow(run, "a int, b int, part int, value bigint")
    entries: dict[tuple[int, int], int] = {}
    for a, b, part, value in sent.groupBy("a", "b", "part").agg(F.sum("value")).collect():
        entries[a, b] = entries.get((a, b), 0) + (value << (_PART * part))
    if not entries:
        return 0, [], []
    rows, size = entries[0, 0], max(b for _, b in entries)
    sums = [entries[0, b] for b in range(1, size + 1)]
    scatter = [[0] * size for _ in range(size)]
    for a in range(size):
        for b in range(a, size):
            scatter[a][b] = scatter[b][a] = rows * entries[a + 1, b + 1] - sums[a] * sums[b]
    return rows, sums, scatter


# --- characteristic polynomial ---


def _is_prime(number: int) -> bool:
    """Miller and Rabin; these bases decide every number below 3 * 10**9."""
    if number % 2 == 0:
        return number == 2
    odd, twos = number - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        power = pow(base, odd, number)
        if power in (1, number - 1):
            continue
        if not any((power := power * power % number) == number - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The greatest primes below 2**31, as many as give a product above ``bound``."""
    found, product, at = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(at):
            found.append(at)
            product *= at
        at -= 2
    return found


def polynomial_modulo(matrix: list[list[int]], prime: int) -> list[int]:
    """Coefficients of det(x I - matrix) modulo ``prime``, constant first."""
    size = len(matrix)
    h = np.array([[v % prime for v in row] for row in matrix], dtype=np.int64)
    for k in range(size - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, prime) % prime
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % prime) % prime
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % prime).sum(axis=1)) % prime
    found = np.zeros((size + 1, size + 1), dtype=np.int64)
    found[0, 0] = 1
    for k in range(1, size + 1):
        found[k, 1:] = found[k - 1, :-1]
        found[k] = (found[k] - h[k - 1, k - 1] * found[k - 1]) % prime
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % prime
            if not below:
                break
            found[k] = (found[k] - int(h[i - 1, k - 1]) * below % prime * found[i - 1]) % prime
    return found[size].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x I - matrix) of a matrix without negative eigenvalues, constant first.

    The coefficient of x**(d-k) is at most C(d, k) * (trace / d)**k in size. Primes are dealt to tasks;
    what comes back is one remainder per prime and coefficient.
    """
    size, trace = len(matrix), sum(matrix[k][k] for k in range(len(matrix)))
    bound = max(comb(size, k) * (trace // size + 1) ** k for k in range(size + 1))
    primes = primes_beyond(2 * bound)
    shared = spark.sparkContext.broadcast(matrix)
    rows = [(primes[k : k + PRIMES_A_ROW],) for k in range(0, len(primes), PRIMES_A_ROW)]

    def make():
        def work(lists):
            for some in lists or ():
                yield [pa.array(some, pa.int64()), pa.array([polynomial_modulo(shared.value, p) for p in some], pa.list_(pa.int64()))]

        return work

    dealt = spark.createDataFrame(rows, "primes array<bigint>").repartition(len(rows))
    found = dict(map(tuple, flat_python(dealt, ["primes"], "prime bigint, remainders array<bigint>", make).collect()))
    product = 1
    coefficients = [0] * (size + 1)
    for prime in primes:
        inverse = pow(product, -1, prime)
        coefficients = [c + product * ((r - c) * inverse % prime) for c, r in zip(coefficients, found[prime])]
        product *= prime
    return [c - product if c > product // 2 else c for c in coefficients]


# --- roots ---


def _shifted(coefficients: list[int], by: int) -> list[int]:
    """Coefficients of p(x + by)."""
    made = list(coefficients)
    for low in range(len(made) - 1):
        for k in range(len(made) - 2, low - 1, -1):
            made[k] += by * made[k + 1]
    return made


def roots_above(coefficients: list[int], point: int) -> int:
    """Roots greater than ``point``, with multiplicity; exact since all roots are real."""
    signs = [c > 0 for c in _shifted(coefficients, point) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def greatest_roots(coefficients: list[int], wanted: int) -> list[tuple[Decimal, int]]:
    """(root, multiplicity) of the greatest roots above 0, falling, until ``wanted`` are counted.

    Roots that agree to :data:`ROOT_BITS` bits below the least place of the coefficients' scale count as one.
    The polynomial is scaled so that roots of it are whole numbers to that many bits; bisection keeps, for every
    interval, the exact number of roots in it, and follows the sign alone once there is one.
    """
    size = len(coefficients) - 1
    positive = roots_above(coefficients, 0)
    wanted = min(wanted, positive)
    if not wanted:
        return []
    scaled = [c << (ROOT_BITS * (size - k)) for k, c in enumerate(coefficients)]  # roots times 2**ROOT_BITS
    top = -scaled[size - 1]  # the sum of the roots

    def value(at: int) -> int:
        total = 0
        for c in reversed(scaled):
            total = total * at + c
        return total

    found: list[tuple[Decimal, int]] = []
    # (low, high, roots above low, roots above high): roots are in (low, high]
    open_ones = [(0, top, positive, 0)]
    while open_ones and sum(m for _, m in found) < wanted:
        low, high, above_low, above_high = open_ones.pop()
        if high - low <= 1:
            found.append((_unscaled(high), above_low - above_high))
        elif above_low - above_high == 1:
            # One simple root: p has the same sign everywhere right of it up to the next root.
            sign_high = value(high)
            if sign_high == 0:
                found.append((_unscaled(high), 1))
                continue
            while high - low > 1:
                middle = (low + high) // 2
                here = value(middle)
                if here == 0:
                    low, high = middle - 1, middle
                elif (here > 0) == (sign_high > 0):
                    high = middle
                else:
                    low = middle
            found.append((_unscaled(high), 1))
        else:
            middle = (low + high) // 2
            above = roots_above(scaled, middle)
            if above_low > above:
                open_ones.append((low, middle, above_low, above))
            if above > above_high:
                open_ones.append((middle, high, above, above_high))
    return found


def _unscaled(whole: int) -> Decimal:
    with localcontext(prec=len(str(whole)) + ROOT_BITS):
        return Decimal(whole) / (1 << ROOT_BITS)


# --- components ---


def null_space(matrix: list[list[int]], root: Decimal, count: int) -> list[list[Decimal]]:
    """``count`` orthonormal vectors of the eigenvalue ``root`` by inverse iteration.

    The shift is nudged in its last places, so that the factored matrix is regular.
    """
    size = len(matrix)
    digits = len(str(max(int(root), 1))) + ROOT_BITS * 3 // 10 + GUARD_DIGITS
    with localcontext(prec=digits):
        shift = root + Decimal(1).scaleb(-(ROOT_BITS * 3 // 10))
        lower = [[Decimal(v) - (shift if i == k else 0) for k, v in enumerate(row)] for i, row in enumerate(matrix)]
        order = list(range(size))
        for k in range(size):
            best = max(range(k, size), key=lambda i: abs(lower[i][k]))
            lower[k], lower[best], order[k], order[best] = lower[best], lower[k], order[best], order[k]
            pivot_row = lower[k]
            for row in lower[k + 1 :]:
                if row[k]:
                    row[k] = factor = row[k] / pivot_row[k]
                    for j in range(k + 1, size):
                        row[j] -= factor * pivot_row[j]
        found: list[list[Decimal]] = []
        for trial in range(count):
            vector = [Decimal(1 + (i * 7919 + trial * 104_729) % 1009) for i in range(size)]
            for _ in range(3):
                vector = _solve(lower, [vector[i] for i in order])
                for _ in range(2):
                    for other in found:
                        along = sum(a * b for a, b in zip(vector, other))
                        vector = [a - along * b for a, b in zip(vector, other)]
                    length = sum(a * a for a in vector).sqrt()
                    vector = [a / length for a in vector]
            found.append(vector)
        return found


def _solve(factored: list[list[Decimal]], right: list[Decimal]) -> list[Decimal]:
    size, made = len(right), list(right)
    for i in range(size):
        made[i] -= sum((factored[i][j] * made[j] for j in range(i)), Decimal(0))
    for i in reversed(range(size)):
        made[i] = (made[i] - sum((factored[i][j] * made[j] for j in range(i + 1, size)), Decimal(0))) / factored[i][i]
    return made


def learn(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Fit on all rows, which :func:`usable` must have chosen. Only matrices of the dimension reach the driver.

    Components stop at the rank: where the covariance is 0 there is nothing to divide by.
    """
    spark = vectors.sparkSession
    rows, sums, scatter = _moments(vectors, vector)
    trace = sum(scatter[k][k] for k in range(len(scatter)))
    if not trace:
        return Whitening(rows, tuple(sums), (), np.zeros((len(sums), 0)), ())
    roots = greatest_roots(characteristic_polynomial(spark, scatter), components)
    dealt = spark.createDataFrame([(k, str(r), m) for k, (r, m) in enumerate(roots)], "place int, root string, copies int")
    shared = spark.sparkContext.broadcast(scatter)

    def make():
        def work(places, roots, copies):
            for place, root, count in zip(places or (), roots or (), copies or ()):
                made = [[float(a) for a in v] for v in null_space(shared.value, Decimal(root), count)]
                yield [pa.array([place], pa.int32()), pa.array([made], pa.list_(pa.list_(pa.float64())))]

        return work

    spaces = flat_python(dealt.repartition(len(roots), "place"), ["place", "root", "copies"], "place int, found array<array<double>>", make)
    found = [v for _, some in sorted(map(tuple, spaces.collect()), key=lambda r: r[0]) for v in some][:components]
    values = [root for root, count in roots for _ in range(count)][:components]
    return Whitening(
        rows,
        tuple(sums),
        tuple(float(v / (rows * rows)) for v in values),
        np.array(found).T,
        tuple(float(v / trace) for v in values),
    )


def _centred(whole: np.ndarray, model: Whitening) -> np.ndarray:
    """x - S / n, from the whole part and the rest of the mean apart."""
    means = [divmod(s, model.rows) for s in model.sums]
    return (whole - np.array([m for m, _ in means])) - np.array([r / model.rows for _, r in means])


def deviations(whole: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums over dimensions of (n x - S)**2, exact; None beyond 64 bits."""
    sums = np.array(model.sums, dtype=object)
    reach = max((int(np.abs(whole[:, k]).max(initial=0)) * model.rows + abs(s) for k, s in enumerate(model.sums)), default=0)
    if reach * reach * max(len(sums), 1) < 2**63:
        off = whole * model.rows - sums.astype(np.int64)
        return (off * off).sum(axis=1).tolist()
    off = whole.astype(object) * model.rows - sums
    return (off * off).sum(axis=1).tolist()


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured over all rows."""
    size = len(model.values)
    if not size:
        return 0.0
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            made = _centred(_matrix(batch.column(0)), model) @ weights if len(batch) else np.zeros((0, size))
            made = np.column_stack([np.ones(len(made)), made])
            total += made.T @ made
        a, b = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()), pa.array(total.ravel())], names=["a", "b", "value"])

    sent = vectors.select(F.col(f"`{vector}`")).mapInArrow(run, "a int, b int, value double").groupBy("a", "b").agg(F.sum("value"))
    total = np.zeros((size + 1, size + 1))
    for a, b, value in sent.collect():
        total[a, b] = value
    total /= model.rows
    return float(np.abs(total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(size)).max())


def whiten(vectors: DataFrame, id_col: str, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``vectors`` and component: the id, ``component`` (from 1 by falling eigenvalue),
    ``n``, ``deviation``, ``deviation_exact``, ``whitened``, ``explained`` and ``identity_error``.

    Rows without a usable vector (:func:`usable`) are left out. A null id and repeated rows are rows like others;
    columns besides the id and the vector are left out. Without spread (no row, one row, equal rows) there is no
    component and the result is empty; with a rank below ``components`` there are as many as the rank. Eigenvalues
    that agree give any orthonormal vectors of their space, the same for all rows. ``deviation`` is null where it
    exceeds 64 bits, which takes about a million rows; ``deviation_exact`` has all its digits as text.
    """
    rows = usable(vectors, vector)
    model = learn(rows, vector, components)
    error = identity_error(rows, model, vector)
    size, weights = len(model.values), model.weights
    schema = T.StructType(
        [T.StructField(id_col, vectors.schema[id_col].dataType)]
        + list(T.StructType.fromDDL("component int, n bigint, deviation bigint, deviation_exact string, whitened double, explained double, identity_error double"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch) or not size:
                continue
            whole, count = _matrix(batch.column(1)), len(batch)
            exact = deviations(whole, model)
            place = np.repeat(np.arange(count), size)
            spread = pa.array([d if d < 2**63 else None for d in exact], pa.int64())
            columns = [
                batch.column(0).take(pa.array(place)),
                pa.array(np.tile(np.arange(1, size + 1), count), pa.int32()),
                pa.array(np.full(count * size, model.rows), pa.int64()),
                spread.take(pa.array(place)),
                pa.array(list(map(str, exact)), pa.string()).take(pa.array(place)),
                pa.array((_centred(whole, model) @ weights).ravel()),
                pa.array(np.tile(model.shares, count), pa.float64()),
                pa.array(np.full(count * size, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.select(F.col(f"`{id_col}`"), F.col(f"`{vector}`")).mapInArrow(run, schema)
