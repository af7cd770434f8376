"""Test statistics and p-values as Column expressions over aggregates.

Statistics are chi-square with Yates' correction and pooled-variance t. Tail probabilities need functions
Spark lacks (erfc, the incomplete beta); they are quadratures over a constant list of nodes, so no Python
runs. The plain forms for one number (``chi2_1dof_p``, ``t_two_sided_p``) serve callers on the driver.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_quantile(p: float) -> float:
    """Standard normal quantile (driver-side constant from a parameter)."""
    return NormalDist().inv_cdf(p)


def z_alpha(alpha: float = 0.05, two_tailed: bool = True) -> float:
    return z_quantile(1 - alpha / 2) if two_tailed else z_quantile(1 - alpha)


def yates_term(observed: Column, expected: Column) -> Column:
    """(|O - E| - min(0.5, |O - E|))² / E: one cell of the continuity-corrected statistic."""
    d = F.abs(observed - expected)
    return F.pow(d - F.least(F.lit(0.5), d), 2) / expected


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the regularized incomplete beta (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    if t is None or dof is None or not math.isfinite(t) or dof <= 0:
        return float("nan")
    return betainc_reg(dof / 2.0, 0.5, dof / (dof + t * t))


def chi2_1dof_p(x: float) -> float:
    if x is None or not math.isfinite(x):
        return float("nan")
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


#: Nodes of the tail quadrature: s = exp(pi/2 sinh(k h)) for -4 <= k h <= 4 spans 1e-19 to 4e18.
_STEP, _NODES = 1 / 32, 128


def _tail_integral(log_density) -> Column:
    """Integral over s from 0 to infinity of exp(log_density(s)), by exp-sinh quadrature (all terms positive).

    One fold over a constant list in the JVM; 13 digits for densities that fall from 1 at s = 0.
    """
    x = lambda k: k.cast("double") * F.lit(_STEP)
    node = lambda k: F.exp(F.lit(math.pi / 2) * F.sinh(x(k)))
    term = lambda k: F.exp(log_density(node(k))) * node(k) * F.cosh(x(k))
    total = F.aggregate(F.sequence(F.lit(-_NODES), F.lit(_NODES)), F.lit(0.0), lambda acc, k: acc + term(k))
    return total * F.lit(_STEP * math.pi / 2)


def chi2_p_value(stat: Column, dof: Column) -> Column:
    """Upper tail of chi-square for 0 or 1 degrees of freedom (2×2 tables); 0 dof → 1.0, no finite statistic → NaN.

    With z² = stat / 2 the tail is erfc(z) = 2/sqrt(pi) exp(-z²) times the integral of exp(-2zs - s²).
    """
    z = F.sqrt(F.greatest(stat, F.lit(0.0)) / 2)
    tail = F.lit(2 / math.sqrt(math.pi)) * F.exp(-z * z) * _tail_integral(lambda s: -(2 * z + s) * s)
    return F.when(dof == 0, F.lit(1.0)).when(F.abs(stat) < float("inf"), tail).otherwise(F.lit(float("nan")))


def t_p_value(t: Column, dof: Column) -> Column:
    """Two-sided Student t tail; no finite statistic or no degree of freedom → NaN.

    The density beyond |t| over that beyond 0, so its constant (a ratio of gammas) cancels.
    """
    half, a = (dof + 1) / 2, F.abs(t)
    at = F.exp(-half * F.log1p(a * a / dof))
    beyond = _tail_integral(lambda s: -half * F.log1p((2 * a + s) * s / (dof + a * a)))
    whole = _tail_integral(lambda s: -half * F.log1p(s * s / dof))
    return F.when((a < float("inf")) & (dof > 0), at * beyond / whole).otherwise(F.lit(float("nan")))


def sample_size_proportion_expr(p1: Column, mde: Column, za: float, zb: float) -> Column:
    """ceil((za*sqrt(2 p̄(1-p̄)) + zb*sqrt(p1(1-p1)+p2(1-p2)))² / mde²), NULL when mde is 0 or the expected
    rate exceeds 1."""
    p2 = p1 + mde
    pbar = (p1 + p2) / 2
    num = F.pow(F.lit(za) * F.sqrt(2 * pbar * (1 - pbar)) + F.lit(zb) * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2)), 2)
    den = F.pow(p2 - p1, 2)
    return F.when((den > 0) & (p2 <= 1), F.ceil(num / den)).cast("long")


def sample_size_mean_expr(sd: Column, mde: Column, za: float, zb: float) -> Column:
    """ceil(2 ((za+zb) sd / mde)²), NULL when mde is 0."""
    return F.when(mde != 0, F.ceil(2 * F.pow((F.lit(za + zb) * sd) / mde, 2))).cast("long")

