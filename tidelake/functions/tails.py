"""Tails and quantiles of the normal, t, F, chi-square and binomial distributions, in plain Python."""

from __future__ import annotations

import math


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b or tiny)
        c = b + num / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_tail(t: float, dof: float) -> float:
    half = 0.5 * beta_inc(dof / 2, 0.5, dof / (dof + t * t))
    return half if t >= 0 else 1 - half


def f_tail(f: float, a: float, b: float) -> float:
    return beta_inc(b / 2, a / 2, b / (b + a * f)) if f > 0 else 1.0


def chi2_tail(x: float, dof: float) -> float:
    return gamma_tail(dof / 2, x / 2)


def _inverse(tail, p: float) -> float:
    """x >= 0 with upper tail p."""
    lo, hi = 0.0, 1.0
    while tail(hi) > p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > p else (lo, mid)
    return (lo + hi) / 2


def t_quantile(p: float, dof: float) -> float:
    return _inverse(lambda t: t_tail(t, dof), 1 - p) if p >= 0.5 else -t_quantile(1 - p, dof)


def f_quantile(p: float, a: float, b: float) -> float:
    return _inverse(lambda f: f_tail(f, a, b), 1 - p)


def sign_test(k: int, n: int) -> float:
    """Two-sided exact binomial test of k of n at one half."""
    if n == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(min(k, n - k) + 1)]
    top = max(log)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(x - top) for x in log))


def tost(mean: float, se: float, dof: float, margin: float) -> float:
    """p of two one-sided t tests that the mean lies within the margin."""
    return max(t_tail((mean + margin) / se, dof), t_tail((margin - mean) / se, dof))
