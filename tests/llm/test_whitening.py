"""Whitening of embeddings against exact fractions and plain numpy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from evidentia.llm import whitening as W


def vectors(n, width, seed=1):
    pick = random.Random(seed)
    base = [[pick.gauss(0, 1) for _ in range(3)] for _ in range(width)]
    rows = []
    for i in range(n):
        z = [pick.gauss(0, 1) for _ in range(3)]
        rows.append((i, [0.2 * sum(a * b for a, b in zip(z, own, strict=True)) + 0.1 * pick.gauss(0, 1) for own in base]))
    return rows


def exact(rows, scale=64, offset=1_000_000):
    """(x by row, sums, covariance as fractions)."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(scale * c) + offset for c in v] for _, v in kept]
    n, width = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(width)]
    cov = [[Fraction(sum((n * r[a] - sums[a]) * (n * r[b] - sums[b]) for r in x), n**3) for b in range(width)] for a in range(width)]
    return [i for i, _ in kept], x, sums, cov


def test_outer_products_are_those_of_exact_fractions():
    pick = np.random.default_rng(3)
    high = pick.normal(size=(700, 6)) * np.array([1e-6, 1, 1e9, 3, 1e3, 7])
    low = high * pick.normal(size=high.shape) * 2.0**-54
    total = W.Doubled(np.zeros((6, 6)))
    W.outer(total, high, low)
    for a in range(6):
        for b in range(6):
            want = sum((Fraction(float(h[a])) + Fraction(float(w[a]))) * (Fraction(float(h[b])) + Fraction(float(w[b]))) for h, w in zip(high, low, strict=True))
            size = sum(abs(Fraction(float(h[a])) * Fraction(float(h[b]))) for h in high)
            assert abs(Fraction(float(total.high[a, b])) + Fraction(float(total.low[a, b])) - want) <= size * Fraction(1, 2**86)


def test_sums_and_merges_keep_the_low_part():
    total = W.Doubled(np.full((1, 1), 1e16))
    for _ in range(1000):
        total.add(np.full((1, 1), 0.1))
    assert Fraction(float(total.high[0, 0])) + Fraction(float(total.low[0, 0])) - 10**16 == pytest.approx(Fraction(0.1) * 1000, rel=1e-13)


def test_components_match_brute_force(spark):
    rows = vectors(300, 6) + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0]), (904, []), (5, vectors(6, 6)[5][1]), (None, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as component", "2 as n", "'x' as whitened").repartition(5)
    ids, x, sums, cov = exact([r for r in rows if r[1] is None or len(r[1]) == 6])
    values, axes = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, axes = values[::-1], axes[:, ::-1]
    found = W.whitened_components(df, most=4)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = found.collect()
    n = len(x)
    assert len(got) == 4 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    mean = np.array([float(Fraction(s, n)) for s in sums])
    want = {}
    for i, row in zip(ids, x, strict=True):
        dev = sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True))
        for k in range(4):
            want.setdefault((i, k + 1), []).append((dev, abs(float((np.array(row) - mean) @ axes[:, k])) / math.sqrt(values[k])))
    for r in got:
        assert any(r.deviation == dev and abs(abs(r.whitened) - w) < 1e-8 for dev, w in want[(r.vec_id, r.component)])
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)


def test_signs_are_the_same_for_all_rows_and_order_falls(spark):
    df = spark.createDataFrame(vectors(200, 5), "vec_id bigint, embedding array<float>").repartition(3)
    got = W.whitened_components(df).toPandas()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(5)).max() < 1e-9
    shares = got.groupby("component").explained.first().tolist()
    assert shares == sorted(shares, reverse=True) and sum(shares) == pytest.approx(1)


def test_a_large_offset_costs_no_digits(spark):
    rows = [(i, [1e7 + (i % 7) / 64, 1e7 + (i % 5) / 64, -3e7 + (i % 11) / 64]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    _, _, _, cov = exact(rows)
    model = W.fit(df)
    assert model.trace == pytest.approx(float(sum(cov[k][k] for k in range(3))), rel=1e-15)


def test_large_deviations_are_exact_or_null():
    model = W.Whitening(10**9, (10**18, 5), np.array([10**9, 0]), np.zeros(2), np.zeros(2), np.ones(1), np.ones((2, 1)), 1.0)
    assert W.deviations(np.array([[10**9 + 2, 0], [10**9 + 40, 0]], np.int64), model) == [4 * 10**18 + 25, None]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_tables_without_variance_give_no_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert W.whitened_components(df).collect() == []


def test_constant_dimensions_are_left_out(spark):
    rows = [(i, [1.0, float(i % 4), 2.0]) for i in range(40)]
    got = W.whitened_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 40 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)
