"""Whitening against numpy, and its exact parts against exact arithmetic."""

from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from sievelight.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n int, y string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, 8, "z") for i, v in rows], SCHEMA).repartition(3)


def integers(vectors):
    return np.floor(np.array([[float(np.float32(c)) for c in v] for v in vectors]) * 64).astype(np.int64) + 1_000_000


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 40)) @ np.diag(np.linspace(3, 0.5, 40))).astype(np.float32).tolist()
    bad = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] + [0.0] * 39), (904, [1.0] * 3), (905, [])]
    out = whitening.whiten(table(spark, [*enumerate(vectors), *bad])).toPandas()
    assert sorted(out.vec_id.unique()) == list(range(300)) and sorted(out.component.unique()) == list(range(1, 33)) and len(out) == 300 * 32
    x = integers(vectors)
    values, axes = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    want = (x - x.mean(axis=0)) @ axes / np.sqrt(values)
    got = out.pivot(index="vec_id", columns="component", values="whitened").values
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-9
    assert np.abs(np.cov(got.T, bias=True) - np.eye(32)).max() < 1e-9 and out.identity_error.nunique() == 1 and 0 <= out.identity_error[0] < 1e-9
    shares = out.groupby("component").explained.first().values
    assert np.allclose(shares, values / np.trace(np.cov(x.T.astype(float), bias=True)), rtol=1e-9)
    s = x.sum(axis=0)
    deviations = ((300 * x - s) ** 2).sum(axis=1)
    assert out.groupby("vec_id").deviation.first().tolist() == deviations.tolist() and set(out.n) == {300}


def test_polynomial_of_small_matrices(spark):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        b = rng.integers(-9, 9, (4, 6))
        m = (b @ b.T).astype(object)
        if seed == 3:
            m[:, 1], m[1, :] = 0, 0  # a reduction that finds no pivot
        coefficients = whitening.characteristic_polynomial(spark, m)

        def determinant(a):
            size = len(a)
            return sum((-1) ** sum(p[i] > p[j] for i in range(size) for j in range(i + 1, size)) * np.prod([a[i][p[i]] for i in range(size)], dtype=object) for p in permutations(range(size)))

        for x in (-3, 0, 2, 11):
            value = sum(c * x ** (4 - k) for k, c in enumerate(coefficients))
            assert value == determinant([[x * (i == j) - m[i, j] for j in range(4)] for i in range(4)])


def test_roots_and_multiplicities():
    roots, scale = whitening.largest_roots([1, -12, 45, -54], 5)  # (x - 3)^2 (x - 6)
    assert [(Fraction(r, 1 << scale), m) for r, m in roots] == [(6, 1), (3, 2)]
    roots, scale = whitening.largest_roots([1, -4, 2, 0], 5)  # 2 + sqrt 2, 2 - sqrt 2, 0
    assert [round(float(Fraction(r, 1 << scale)), 12) for r, _ in roots] == [round(2 + 2**0.5, 12), round(2 - 2**0.5, 12)]


def test_near_roots_keep_apart():
    a, b = 10**12, 10**12 + 1
    roots, scale = whitening.largest_roots([1, -(a + b), a * b], 5)
    assert [Fraction(r, 1 << scale) for r, _ in roots] == [b, a]
    m = np.array([[10**12, 1], [1, 10**12]], object)
    (v,) = whitening.null_vectors(m, (10**12 + 1) << 40, 40, 1)
    assert v == pytest.approx([2**-0.5, 2**-0.5], abs=1e-15)


def test_equal_roots_get_orthogonal_components(spark):
    corners = [[float(s * (i == j)) for j in range(4)] for i in range(4) for s in (-1, 1)]
    out = whitening.whiten(table(spark, enumerate(corners))).toPandas()
    got = out.pivot(index="vec_id", columns="component", values="whitened").values
    assert got.shape == (8, 4) and np.abs(np.cov(got.T, bias=True) - np.eye(4)).max() < 1e-12 and np.allclose(out.explained, 0.25)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)], [(1, [])], [(1, [3.0]), (2, [3.0])]])
def test_without_spread_there_are_no_components(spark, rows):
    assert whitening.whiten(table(spark, rows)).count() == 0


def test_few_rows_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (None, [0.0, 2.0, 0.0])]
    out = whitening.whiten(table(spark, rows)).toPandas()
    assert len(out) == 3 and set(out.component) == {1} and out.explained.tolist() == [1.0] * 3 and out.vec_id.isna().sum() == 1


def test_large_entries_are_exact():
    rng = np.random.default_rng(2)
    y = rng.integers(-(1 << 52), 1 << 52, (50, 3))
    product = whitening.exact_product(y, y)
    assert all(product[i, j] == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for i in range(3) for j in range(3))
    assert whitening._is_prime((1 << 31) - 1) and not whitening._is_prime(25326001) and not whitening._is_prime(1373653)
    huge = [1e15, -1e15]
    assert [sum(r) for r in whitening._matrix(__import__("pyarrow").array([huge]))] == [0.0]
