"""Whitening of embeddings: exact scatter, its characteristic polynomial, its roots, and a component for each root."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import materialize

#: Scale and shift that make a component of a vector an integer.
SCALE, SHIFT = 64, 1_000_000
#: An entry whose integer is beyond this is taken for one that is not finite.
LARGEST = 1 << 53
#: Bits that the roots are told apart by, below the largest one, and bits of the fractions in the solver.
ROOT_BITS, SOLVER_BITS = 192, 320
#: A value travels as a pair: multiples of this, and the rest.
LIMB = 1 << 60


def integer_vectors(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and y, where y + SHIFT are the integers floor(64 c) + SHIFT of a vector's entries c.

    Rows whose vector is null, or holds null or non-finite entries, are left out; so are those of another length than most
    vectors have (of lengths that are as frequent, the longer stays). Repeated rows stay each; other columns are ignored.
    """
    entries = F.transform(f"`{vec}`", lambda c: c.cast("double") * SCALE)
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    kept = rows.select("vec_id", entries.alias("c")).filter(F.col("c").isNotNull() & good)
    sizes = kept.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    y = F.transform("c", lambda c: F.floor(c))
    return kept.filter(F.size("c") == (sizes["d"] if sizes else 0)).select("vec_id", y.alias("y"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows by entries."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of integers, as Python integers: in doubles where all sums stay below 2**53."""
    if not len(a):
        return np.zeros((a.shape[1], b.shape[1]), object)
    high = int(np.abs(a).max(initial=0)) * len(a)
    if high * int(np.abs(b).max(initial=0)) < 1 << 53:
        return (a.T.astype(float) @ b.astype(float)).astype(np.int64).astype(object)
    return a.T.astype(object) @ b.astype(object)


def _limbs(values: dict[tuple[int, int], int]) -> pa.RecordBatch:
    keys = list(values)
    parts = [divmod(values[k], LIMB) for k in keys]
    columns = [[k[0] for k in keys], [k[1] for k in keys], [p[0] for p in parts], [p[1] for p in parts]]
    kinds = [pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["i", "j", "high", "low"])


def scatter(vectors: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of each dimension of y, and the exact products of all pairs of dimensions, summed over the rows.

    A task sends one number for each pair of dimensions, whatever its rows; sums of the tasks' numbers are one row for a pair.
    """

    def products(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in frames:
            if batch.num_rows:
                # A column of ones makes the counts and the sums entries of the same matrix.
                y = np.hstack([_matrix(batch.column(0)).astype(np.int64), np.ones((batch.num_rows, 1), np.int64)])
                own = exact_product(y, y)
                total = own if total is None else total + own
        if total is not None:
            yield _limbs({(i, j): int(total[i, j]) for i in range(len(total)) for j in range(i, len(total))})

    sent = vectors.select("y").mapInArrow(products, "i int, j int, high decimal(38,0), low bigint")
    summed = sent.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    if not summed:
        return 0, [], np.zeros((0, 0), object)
    size = max(r["j"] for r in summed) + 1
    out = np.zeros((size, size), object)
    for r in summed:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["high"]) * LIMB + int(r["low"])
    return out[-1, -1], list(out[-1, :-1]), out[:-1, :-1]


def centred(n: int, sums: list[int], products: np.ndarray) -> np.ndarray:
    """n^2 times the covariance: integers."""
    s = np.array(sums, object)
    return n * products - np.outer(s, s)


# The characteristic polynomial -----------------------------------------------------------------------------


def _is_prime(p: int) -> bool:
    odd = p - 1
    twos = (odd & -odd).bit_length() - 1
    for base in (2, 3, 5, 7):  # enough below 3,215,031,751
        x = pow(base, odd >> twos, p)
        if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2**31, from the largest down, whose product has more than so many bits."""
    out, have, p = [], 0.0, (1 << 31) - 1
    while have <= bits:
        if _is_prime(p):
            out.append(p)
            have += math.log2(p)
        p -= 2
    return out


def polynomial_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - m) modulo p, the leading one first: m is made a Hessenberg matrix by similar steps."""
    a = (m % p).astype(np.int64)
    d = len(a)
    for k in range(d - 2):
        found = np.flatnonzero(a[k + 1 :, k])
        if not len(found):
            continue
        at = k + 1 + int(found[0])
        if at != k + 1:
            a[[at, k + 1]] = a[[k + 1, at]]
            a[:, [at, k + 1]] = a[:, [k + 1, at]]
        factors = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factors[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factors % p).sum(axis=1)) % p
    # rows[k]: coefficients for the leading k by k part, the constant first.
    rows = np.zeros((d + 1, d + 1), np.int64)
    rows[0, 0] = 1
    for k in range(d):
        rows[k + 1, 1:] = rows[k, :-1]
        weights, path = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(a[i, k]) * path % p
            path = path * int(a[i, i - 1]) % p if i else 0
        rows[k + 1] = (rows[k + 1] - (weights[:, None] * rows[: k + 1] % p).sum(axis=0)) % p
    return [int(c) for c in rows[d, ::-1]]


def _coefficient_bits(m: np.ndarray) -> int:
    """A bound for the bits of a coefficient and its sign: sums of products of k roots that are 0 or more and add up to the trace."""
    d, trace = len(m), max(1, sum(int(m[i, i]) for i in range(len(m))))
    mean = math.log2(Fraction(trace, d))
    return 3 + math.ceil(max(math.log2(math.comb(d, k)) + k * max(mean, 0.0) for k in range(d + 1)))


def characteristic_polynomial(spark, m: np.ndarray) -> list[int]:
    """Integer coefficients of det(x - m), the leading one first. Tasks take a prime each; remainders are put together here."""
    d, chosen = len(m), primes(_coefficient_bits(m))
    text = [[str(x) for x in row] for row in m]

    def remainders(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array([[int(x) for x in row] for row in text], object)
        for batch in frames:
            found = [polynomial_mod(own, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["p", "c"])

    listed = spark.createDataFrame([(p,) for p in chosen], "p bigint").repartition(min(len(chosen), 16), "p")
    rows = sorted((r["p"], r["c"]) for r in listed.mapInArrow(remainders, "p bigint, c array<bigint>").collect())
    whole = math.prod(p for p, _ in rows)
    lifts = [whole // p * pow(whole // p % p, -1, p) for p, _ in rows]
    sums = [sum(lift * c[k] for lift, (_, c) in zip(lifts, rows)) % whole for k in range(d + 1)]
    return [c - whole if 2 * c > whole else c for c in sums]


# Its roots -------------------------------------------------------------------------------------------------


def _above(coefficients: list[int], at: int, scale: int = 0) -> int:
    """How many roots are above at / 2**scale, each as often as it counts. With real roots only, the changes of sign are their number."""
    if at:
        zeros = (at & -at).bit_length() - 1
        at, scale, d = at >> zeros, scale - zeros, len(coefficients) - 1
        # In u = x / place - 1 the signs are those of p(x + place); the step from x / place to u takes additions only.
        terms = np.array([c * at ** (d - k) << (scale * k if scale >= 0 else -scale * (d - k)) for k, c in enumerate(coefficients)], object)
        for end in range(d + 1, 1, -1):
            terms[:end] = np.add.accumulate(terms[:end])
        coefficients = terms
    signs = [c > 0 for c in coefficients if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(coefficients: list[int], at: int) -> int:
    value = 0
    for c in coefficients:
        value = value * at + c
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], most: int, bits: int = ROOT_BITS) -> tuple[list[tuple[int, int]], int]:
    """Up to `most` positive roots of a polynomial whose roots are real and 0 or more: [(root, multiplicity)], falling, and a scale.

    A root is the number given over 2**scale, or less than one such unit below it; the largest has about so many bits.
    Intervals are halved until they hold one root, or are one unit wide; their roots are counted exactly.
    """
    top = 1 << max(0, -coefficients[1]).bit_length()  # above the sum of the roots
    while top > 1 and not _above(coefficients, top >> 1):
        top >>= 1
    scale = max(0, bits - top.bit_length())
    scaled = [c << (scale * k) for k, c in enumerate(coefficients)]
    out, todo = [], [(0, _above(coefficients, 0), top << scale, 0)]  # low, roots above it, high, roots above that
    while todo and sum(m for _, m in out) < most:
        low, over_low, high, over_high = todo.pop()
        held = over_low - over_high
        if held == 0:
            continue
        if high - low == 1:
            out.append((high, held))
        elif held == 1:
            begin = -1 if over_low % 2 else 1  # the sign just above low; p is positive above all roots
            while high - low > 1:
                middle = (low + high) >> 1
                low, high = (middle, high) if _sign(scaled, middle) == begin else (low, middle)
            out.append((high, 1))
        else:
            middle = (low + high) >> 1
            over = _above(coefficients, middle, scale)
            todo += [(low, over_low, middle, over), (middle, over, high, over_high)]
    return out, scale


# Components ------------------------------------------------------------------------------------------------


def _solve(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Columns x with a x = b up to a common factor each; all numbers are fractions with so many bits."""
    a, b, d = a.copy(), b.copy(), len(a)
    for k in range(d):
        at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if at != k:
            a[[at, k]], b[[at, k]] = a[[k, at]], b[[k, at]]
        if not a[k, k]:
            a[k, k] = 1  # an exact root: the smallest pivot that can be written
        factors = (a[k + 1 :, k] << bits) // a[k, k]
        a[k + 1 :, k:] -= (factors[:, None] * a[k, k:]) >> bits
        b[k + 1 :] -= (factors[:, None] * b[k]) >> bits
    x = np.zeros_like(b)
    for k in range(d - 1, -1, -1):
        rest = b[k] - ((a[k, k + 1 :] @ x[k + 1 :]) >> bits if k + 1 < d else 0)
        x[k] = (rest << bits) // a[k, k]
    return x


def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    length = math.isqrt(int(v @ v))
    return (v << bits) // max(1, length)


def null_vectors(m: np.ndarray, root: int, scale: int, count: int, bits: int = SOLVER_BITS) -> list[list[float]]:
    """Orthonormal vectors v with m v = root / 2**scale v, as many as the root counts; the largest entry of each is positive.

    Inverse iteration with a shift half a unit from the root, in fractions with so many bits: what is left of the other
    components falls by the distance of their roots over that unit each time.
    """
    d = len(m)
    extra = max(0, bits - scale - 1)
    a = (m << (scale + 1)) - (2 * root - 1) * np.eye(d, dtype=int).astype(object)
    a = a << extra if extra else a
    unit = scale + 1 + extra
    x = np.array([[((i + 1) * (j + 3) * 2654435761 % 1000003) - 500001 for j in range(count)] for i in range(d)], object) << unit
    for _ in range(3):
        done = []
        for j in range(count):
            v = _unit(x[:, j], unit)
            for _ in range(2):
                for w in done:
                    v = v - ((int(v @ w) >> unit) * w >> unit)
                v = _unit(v, unit)
            done.append(v)
        x = np.array(done, object).T
        x = _solve(a, x, unit)
    done = []
    for j in range(count):
        v = _unit(x[:, j], unit)
        for _ in range(2):
            for w in done:
                v = v - ((int(v @ w) >> unit) * w >> unit)
            v = _unit(v, unit)
        at = max(range(d), key=lambda i: abs(v[i]))
        done.append(v if v[at] > 0 else -v)
    return [[float(Fraction(int(c), 1 << unit)) for c in v] for v in done]


def components(spark, m: np.ndarray, most: int) -> list[tuple[Fraction, list[float]]]:
    """(root, unit vector) of the largest positive roots of m's polynomial, falling. Tasks take a root each."""
    if not len(m) or not any(m[i, i] for i in range(len(m))):
        return []
    roots, scale = largest_roots(characteristic_polynomial(spark, m), most)
    text = [[str(x) for x in row] for row in m]

    def solved(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array([[int(x) for x in row] for row in text], object)
        for batch in frames:
            rows = [(no, v) for no, root, count in zip(*(batch.column(i).to_pylist() for i in range(3))) for v in null_vectors(own, int(root), scale, count)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["no", "v"])

    asked = spark.createDataFrame([(no, str(root), count) for no, (root, count) in enumerate(roots)], "no int, root string, count int")
    found: dict[int, list] = {}
    for r in asked.repartition(len(roots), "no").mapInArrow(solved, "no int, v array<double>").collect():
        found.setdefault(r["no"], []).append(r["v"])
    return [(Fraction(root, 1 << scale), v) for no, (root, _) in enumerate(roots) for v in sorted(found[no])][:most]


# Whitening -------------------------------------------------------------------------------------------------


def _projections(vectors: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> DataFrame:
    """vec_id, deviation and w: the centred vector's products with the columns of basis. Centring is exact."""

    def project(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, b = np.array(sums, object), basis
        for batch in frames:
            y = _matrix(batch.column(1)).astype(np.int64)
            most = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
            wide = most * most * max(1, y.shape[1]) >= 1 << 63
            off = n * y.astype(object) - s if wide else n * y - s.astype(np.int64)
            far = (off * off).sum(axis=1)
            far = [int(x) if int(x) < 1 << 63 else None for x in far] if wide else far
            w = (off / n).astype(float) @ b
            flat = pa.array(w.ravel(), pa.float64())
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * b.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "deviation", "w"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "y").mapInArrow(project, f"vec_id {kind}, deviation bigint, w array<double>")


def identity_error(projected: DataFrame, n: int) -> float:
    """The largest entry, by amount, of the covariance of w minus the identity; summed by task, then by pair of components."""

    def sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in frames:
            if batch.num_rows:
                w = np.hstack([_matrix(batch.column(0)), np.ones((batch.num_rows, 1))])
                total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    rows = projected.select("w").mapInArrow(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    k = max(r["j"] for r in rows)
    cells = {(r["i"], r["j"]): r["s"] / n for r in rows}
    return max(abs(cells[i, j] - cells[i, k] * cells[j, k] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(rows: DataFrame, vec: str = "embedding", most: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row that integer_vectors keeps and each component.

    x are the integers of a vector, S their sums over all n rows. n^2 times the covariance is a matrix M of integers, summed
    exactly by the tasks; its size is the dimension, not the data. Its characteristic polynomial comes from Hessenberg
    reductions modulo primes and the Chinese remainder theorem, the roots from counts of sign changes and halving, and
    components from inverse iteration in 320-bit fractions. Eigenvalues are M's roots over n^2. Components of eigenvalue 0
    cannot be scaled and are left out, so that fewer than `most` may come: none for one vector, or for equal ones. A root
    that counts m times gives m components that are orthogonal; which ones is the same for all rows.
    deviation is the exact sum of (n x - S)^2; where it passes a long it is null. Empty tables give no rows, and null ids
    and repeated rows are kept as they are.
    """
    spark = rows.sparkSession
    vectors = materialize(integer_vectors(rows, vec), "whiten-vectors")
    n, sums, products = scatter(vectors)
    m = centred(n, sums, products)
    found = components(spark, m, most)
    if not found:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    trace = sum(int(m[i, i]) for i in range(len(m)))
    explained = [float(root / trace) for root, _ in found]
    # The square root of e, from integers: e is a root over n^2.
    basis = np.array([np.array(v) / _root(root / (n * n)) for root, v in found]).T
    projected = materialize(_projections(vectors, n, sums, basis), "whiten-projections")
    error = round(identity_error(projected, n), 12)
    shares = F.array(*map(F.lit, explained))
    out = projected.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )


def _root(e: Fraction) -> float:
    """The square root as a double."""
    shift = max(0, 128 - e.numerator.bit_length() + e.denominator.bit_length())
    shift += shift % 2
    return float(Fraction(math.isqrt((e.numerator << shift) // e.denominator), 1 << (shift // 2)))
