"""Exact binomial tails and bounds against sums in whole numbers and against known asymptotics."""

from fractions import Fraction
from math import comb, erfc, sqrt

import pytest
from pyspark.sql import functions as F

from labeltrail.functions.binomial import exact_lower_bound, exact_sign_p, exact_upper_bound, incomplete_beta


def tail(s, n, p):
    p = Fraction(p)
    return float(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(s, n + 1)))


def test_incomplete_beta(spark):
    cases = [(x, s, n) for n in (1, 2, 3, 10, 60, 300) for s in {1, 2, n // 3, n // 2, n - 1, n} if 1 <= s <= n for x in (0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0)]
    got = spark.createDataFrame(cases, "x double, s bigint, n bigint").select("x", "s", "n", incomplete_beta(F.col("x"), F.col("s"), F.col("n") - F.col("s") + 1).alias("v")).collect()
    for r in got:
        assert r.v == pytest.approx(tail(r.s, r.n, r.x), abs=1e-11)


def test_sign_p(spark):
    cases = [(0, 0), (3, 3), (0, 1), (5, 0), (2, 9), (40, 61), (700, 800), (500_000, 503_000), (3_000_000_000, 3_000_100_000)]
    got = [r.p for r in spark.createDataFrame(cases, "a bigint, b bigint").select(exact_sign_p(F.col("a"), F.col("b")).alias("p")).collect()]
    for (a, b), p in zip(cases[:7], got):
        want = 1.0 if a == b else min(1.0, 2 * sum(comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b))
        assert p == pytest.approx(want, rel=1e-10)
    for (a, b), p in zip(cases[7:], got[7:]):  # normal tail with continuity correction
        assert p == pytest.approx(erfc((abs(a - b) - 1) / sqrt(2 * (a + b))), rel=2e-3)


def test_bounds(spark):
    cases = [(0, 7), (1, 1), (1, 50), (7, 7), (48, 50), (120, 400), (0, 0), (950_000, 1_000_000)]
    rows = spark.createDataFrame(cases, "s bigint, n bigint").select("s", "n", exact_lower_bound(F.col("s"), F.col("n")).alias("lo"), exact_upper_bound(F.col("s"), F.col("n")).alias("hi")).collect()
    for r in rows:
        if r.n == 0:
            assert r.lo is None and r.hi is None
            continue
        assert r.lo <= r.s / r.n <= r.hi
        if r.s == 0:
            assert r.lo == 0
        elif r.n < 1000:
            assert tail(r.s, r.n, r.lo) == pytest.approx(0.025, rel=1e-8)
        if r.s == r.n:
            assert r.hi == 1
        elif r.n < 1000:
            assert 1 - tail(r.s + 1, r.n, r.hi) == pytest.approx(0.025, rel=1e-8)
    last = next(r for r in rows if r.n == 1_000_000)
    assert last.lo == pytest.approx(0.95 - 1.96 * sqrt(0.95 * 0.05 / 1e6), abs=2e-6)
