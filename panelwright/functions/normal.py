"""Distribution functions for one-row results on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

_N = NormalDist()


def normal_cdf(x: float) -> float:
    return _N.cdf(x)


def normal_quantile(p: float) -> float:
    return _N.inv_cdf(p)


def normal_density(x: float) -> float:
    return _N.pdf(x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + top * d) or tiny)
            c = (1.0 + top / c) or tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided tail probability of Student's t."""
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))
