"""Upper tails of the t, F and chi-squared distributions, one scalar at a time.

Used on the driver for a single statistic per test; continued fractions and series after the
standard formulas for the regularised incomplete beta and gamma functions.
"""

from __future__ import annotations

import math

TINY = 1e-300


def _lentz(first: float, terms) -> float:
    """Modified Lentz evaluation of first + a1/(b1 + a2/(b2 + ...))."""
    value = first or TINY
    c, d = value, 0.0
    for a, b in terms:
        d = b + a * d or TINY
        c = b + a / c or TINY
        d = 1.0 / d
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)

    def terms():
        for m in range(1, 2000):
            k = m // 2
            if m % 2:
                yield -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)), 1.0
            else:
                yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), 1.0

    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(log_front) / (a * _lentz(1.0, terms()))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))

    def terms():
        for i in range(1, 2000):
            yield -i * (i - a), x + 2 * i + 1.0 - a

    return math.exp(log_front) / _lentz(x + 1.0 - a, terms())


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_upper(x: float, dof: float) -> float:
    return gamma_upper(dof / 2.0, x / 2.0)
