"""Probability distributions without external libraries, accurate in both tails."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def normal_sf(x: float) -> float:
    return math.erfc(x / math.sqrt(2)) / 2


def normal_ppf(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("a probability lies between 0 and 1")
    return _NORMAL.inv_cdf(p)


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _fraction(terms: Callable[[int], tuple[float, float]], b0: float) -> float:
    """A continued fraction b0 + a1/(b1 + a2/(b2 + ...)) by the product of convergents' ratios."""
    f = c = b0 or 1e-300
    d = 0.0
    for i in range(1, 20_000):
        a, b = terms(i)
        d = 1 / ((b + a * d) or 1e-300)
        c = (b + a / c) or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            return f
    raise ArithmeticError("a continued fraction did not converge")


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)

    def term(i: int) -> tuple[float, float]:
        if i == 1:
            return 1.0, 1.0
        m, odd = divmod(i - 1, 2)
        top = -(a + m) * (a + b + m) if odd else m * (b - m)
        base = (a + 2 * m) * (a + 2 * m + 1) if odd else (a + 2 * m - 1) * (a + 2 * m)
        return top * x / base, 1.0

    return math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) / a * _fraction(term, 0.0)


def t_sf(t: float, df: float) -> float:
    half = betainc(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


def t_cdf(t: float, df: float) -> float:
    return t_sf(-t, df)


def t_two_sided_p(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def gammainc(a: float, x: float, upper: bool = False) -> float:
    """The regularised incomplete gamma function, or its complement."""
    if x <= 0:
        return float(upper)
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        low = total * math.exp(a * math.log(x) - x - math.lgamma(a))
        return 1 - low if upper else low
    # Q = scale / (b1 + a2/(b2 + ...)), with b_i = x + 2i - 1 - a and a_i = -(i-1)(i-1-a)
    tail = _fraction(lambda i: (-i * (i - a), x + 2 * i + 1 - a), x + 1 - a)
    high = math.exp(a * math.log(x) - x - math.lgamma(a)) / tail
    return high if upper else 1 - high


def chi2_cdf(x: float, df: float) -> float:
    return gammainc(df / 2, x / 2)


def chi2_sf(x: float, df: float) -> float:
    return gammainc(df / 2, x / 2, upper=True)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def f_cdf(x: float, d1: float, d2: float) -> float:
    return 0.0 if x <= 0 else betainc(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))


def _inverse(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    if not 0 < p < 1:
        raise ValueError("a probability lies between 0 and 1")
    while cdf(high) < p:
        high *= 2
    while low < 0 and cdf(low) > p:
        low *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def t_ppf(p: float, df: float) -> float:
    return _inverse(lambda x: t_cdf(x, df), p, -10.0, 10.0)


def chi2_ppf(p: float, df: float) -> float:
    return _inverse(lambda x: chi2_cdf(x, df), p, 0.0, df + 10.0)
