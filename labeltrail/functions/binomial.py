"""Exact binomial tails and bounds as column expressions of fixed length, for counts of any size.

A binomial tail is a regularised incomplete beta, the integral of a beta density.  The density comes from deviances and the error of
Stirling's formula, without differences of large logarithms, and the integral from Gauss-Legendre nodes over 40 standard deviations,
so neither work nor memory grows with the counts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nodes of the integral, its reach in standard deviations, halvings of a bound.
NODES, REACH, HALVINGS = 128, 40.0, 60
_SMALL = 16


def _named(value: Column, use) -> Column:
    """`use` applied to a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _stirling_error(n: Column) -> Column:
    """ln n! less Stirling's formula."""
    table = [0.0] + [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, _SMALL)]
    i = 1 / F.when(n > 0, n)
    series = i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i * (1 / 1680))))
    return F.when(n < _SMALL, F.get(F.array(*[F.lit(v) for v in table]), F.least(n, F.lit(_SMALL - 1.0)).cast("int"))).otherwise(series)


def _deviance(k: Column, mean: Column) -> Column:
    v = (k - mean) / F.when(mean > 0, mean)
    return mean * ((1 + v) * F.log1p(v) - v)


def _beta_density(a: Column, b: Column, t: Column, scale: Column) -> Column:
    """Density of Beta(a, b) for whole a, b of at least 1; `scale` is its part that t does not change."""
    n, k = a + b - 2, a - 1
    inner = scale * F.exp(-_deviance(k, n * t) - _deviance(n - k, n * (1 - t)))
    edge = F.when(n == 0, F.lit(1.0)).when(k == 0, (n + 1) * F.exp(n * F.log1p(-t))).when(k == n, (n + 1) * F.exp(n * F.log(t)))
    return F.coalesce(F.when((k == 0) | (k == n), edge).otherwise(inner), F.lit(0.0))  # nothing at t = 0 and 1, where logarithms end


def _density_scale(a: Column, b: Column) -> Column:
    n, k = a + b - 2, a - 1
    inside = (k > 0) & (k < n)
    kk, rest = F.when(inside, k).otherwise(1.0), F.when(inside, n - k).otherwise(1.0)
    return (n + 1) * F.exp(_stirling_error(n) - _stirling_error(kk) - _stirling_error(rest)) * F.sqrt(n / (2 * math.pi * kk * rest))


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b), the chance that Beta(a, b) is at most x, for whole a and b of at least 1 and 0 <= x <= 1."""
    a, b = a.cast("double"), b.cast("double")
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    points = F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(w)).alias("w")) for u, w in zip((nodes + 1) / 2, weights / 2)])
    facts = F.struct(x.cast("double").alias("x"), a.alias("a"), b.alias("b"), _density_scale(a, b).alias("scale"),
                     (REACH * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("reach"),
                     F.coalesce((a - 1) / F.when(a + b > 2, a + b - 2), F.lit(0.5)).alias("mode"))

    def tail(f: Column) -> Column:
        left = f["x"] <= f["mode"]
        start = F.when(left, F.greatest(f["x"] - f["reach"], F.lit(0.0))).otherwise(f["x"])
        end = F.when(left, f["x"]).otherwise(F.least(f["x"] + f["reach"], F.lit(1.0)))
        return _named(F.struct(f.alias("f"), left.alias("left"), start.alias("start"), (end - start).alias("width")), whole)

    def whole(s: Column) -> Column:
        f = s["f"]
        area = F.aggregate(points, F.lit(0.0), lambda sum_, p: sum_ + p["w"] * _beta_density(f["a"], f["b"], s["start"] + p["u"] * s["width"], f["scale"]))
        area = F.least(F.greatest(area * s["width"], F.lit(0.0)), F.lit(1.0))
        return F.when(s["left"], area).otherwise(1 - area)

    return _named(facts, tail)


def exact_lower_bound(successes: Column, n: Column, tail: float = 0.025) -> Column:
    """Lower Clopper-Pearson bound: the rate at which so many successes or more have a chance of `tail`; 0 without successes, null without trials."""
    s, n = successes.cast("double"), n.cast("double")
    facts = F.struct(s.alias("s"), (n - s + 1).alias("r"))

    def found(f: Column) -> Column:
        def halved(h: Column, _: Column) -> Column:
            middle = (h["lo"] + h["hi"]) / 2
            step = lambda m: F.when(incomplete_beta(m, f["s"], f["r"]) < tail, F.struct(m.alias("lo"), h["hi"].alias("hi"))).otherwise(
                F.struct(h["lo"].alias("lo"), m.alias("hi")))
            return _named(middle, step)

        whole = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), whole, halved, lambda h: (h["lo"] + h["hi"]) / 2)

    return F.when(n > 0, F.when(s > 0, _named(facts, found)).otherwise(0.0))


def exact_upper_bound(successes: Column, n: Column, tail: float = 0.025) -> Column:
    """Upper Clopper-Pearson bound; 1 when all succeed."""
    return 1 - exact_lower_bound(n - successes, n, tail)


def exact_sign_p(n10: Column, n01: Column) -> Column:
    """Two-sided exact binomial p at 1/2 of n10 out of n10 + n01 (1 when there are none): twice the smaller tail."""
    low, n = F.least(n10, n01), n10 + n01
    p = 2 * incomplete_beta(F.lit(0.5), F.greatest(n10, n01), low + 1)
    return F.when((n == 0) | (n10 == n01), F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))
