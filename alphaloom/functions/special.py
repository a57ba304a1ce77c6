"""Special functions as Column expressions, folded in the JVM by `aggregate` over a fixed number of terms."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
#: Lanczos' coefficients for g = 7, and Acklam's rational functions of the inverse normal.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _let(values: list[Column], body: Callable[..., Column]) -> Column:
    """body of the values, each computed once: a lambda's variable may be named as often as the body likes."""
    return F.get(F.transform(F.array(F.struct(*[v.cast("double").alias(f"v{k}") for k, v in enumerate(values)])), lambda s: body(*[s[f"v{k}"] for k in range(len(values))])), F.lit(0))


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def log_gamma(x: Column) -> Column:
    """Of x >= 0.5."""

    def of(x: Column) -> Column:
        s = F.lit(LANCZOS[0])
        for k, c in enumerate(LANCZOS[1:], 1):
            s = s + c / (x - 1 + k)
        t = x + 6.5
        return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(t) - t + F.log(s)

    return _let([x], of)


def gamma_q(a: Column, x: Column, terms: int = 300) -> Column:
    """Regularised upper incomplete gamma function of a >= 0.5 at x: one less the lower one's series below a + 1, else Lentz'
    form of the continued fraction. terms: as many as either takes; they suffice for a up to some thousand."""

    def of(a: Column, x: Column, front: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(terms))
        first = F.struct((1 / a).alias("s"), (1 / a).alias("t"))
        series = F.aggregate(steps, first, lambda z, k: F.struct((z["s"] + z["t"] * x / (a + k)).alias("s"), (z["t"] * x / (a + k)).alias("t")), lambda z: z["s"])
        b = x + 1 - a
        start = F.struct((1 / _away(b)).alias("d"), F.lit(1 / TINY).alias("c"), (1 / _away(b)).alias("h"))

        def step(z: Column, k: Column) -> Column:
            an, bn = -k * (k - a), b + 2 * k
            d = 1 / _away(an * z["d"] + bn)
            c = _away(bn + an / z["c"])
            done = F.abs(d * c - 1) < 1e-16
            return F.struct(d.alias("d"), c.alias("c"), F.when(done, z["h"]).otherwise(z["h"] * d * c).alias("h"))

        upper = F.aggregate(steps, start, step, lambda z: z["h"])
        return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), 1 - series * front)).otherwise(upper * front)

    safe = F.greatest(x.cast("double"), F.lit(TINY))
    return _let([a, x, F.exp(a * F.log(safe) - x - log_gamma(a))], of)


def beta_i(x: Column, a: Column, b: Column, terms: int = 200) -> Column:
    """Regularised incomplete beta function of a, b >= 0.5 at x, by Lentz' form of its continued fraction."""

    def fraction(x: Column, a: Column, b: Column) -> Column:
        d = 1 / _away(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))

        def half(z: Column, n: Column) -> Column:
            d = 1 / _away(1 + n * z["d"])
            c = _away(1 + n / z["c"])
            return F.struct(c.alias("c"), d.alias("d"), (z["h"] * d * c).alias("h"))

        even = lambda z, m: half(z, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        odd = lambda z, m: half(z, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        terms_ = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: F.array(2 * m, 2 * m + 1)))
        return F.aggregate(terms_, start, lambda z, k: F.when(k % 2 == 0, even(z, F.floor(k / 2))).otherwise(odd(z, F.floor(k / 2))), lambda z: z["h"])

    def of(x: Column, a: Column, b: Column, front: Column) -> Column:
        turned = x > (a + 1) / (a + b + 2)
        y, p, q = F.when(turned, 1 - x).otherwise(x), F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b)
        part = _let([y, p, q], lambda y, p, q: fraction(y, p, q) / p) * front
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(turned, 1 - part).otherwise(part)

    inside = lambda v: F.least(F.greatest(v.cast("double"), F.lit(TINY)), F.lit(1 - 1e-16))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(inside(x)) + b * F.log1p(-inside(x)))
    return _let([x, a, b, front], of)


def normal_cdf(x: Column) -> Column:
    """To some 1e-14, by the incomplete gamma function of one half."""
    return _let([x], lambda x: _let([gamma_q(F.lit(0.5), x * x / 2)], lambda q: F.when(x >= 0, 1 - q / 2).otherwise(q / 2)))


def inverse_normal(p: Column) -> Column:
    """The normal quantile of 0 < p < 1: a rational start and one step of Newton's method; null elsewhere."""

    def start(p: Column) -> Column:
        q = p - 0.5
        r = q * q
        tail = lambda v: _let([F.sqrt(-2 * F.log(F.greatest(v, F.lit(TINY))))], lambda t: _polynomial(ACKLAM_C, t) / _polynomial(ACKLAM_D, t))
        middle = _polynomial(ACKLAM_A, r) * q / _polynomial(ACKLAM_B, r)
        return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(middle)

    def newton(p: Column, z: Column) -> Column:
        return z - (normal_cdf(z) - p) * math.sqrt(2 * math.pi) * F.exp(z * z / 2)

    p = p.cast("double")
    return F.when((p > 0) & (p < 1), _let([p, _let([p], start)], newton))


def chi2_sf(x: Column, k: Column) -> Column:
    """Survival function of chi squared with k degrees of freedom."""
    return gamma_q(k.cast("double") / 2, x.cast("double") / 2)


def t_cdf(x: Column, nu: Column) -> Column:
    """Distribution function of Student's t with nu degrees of freedom."""
    return _let([x, nu], lambda x, nu: _let([beta_i(nu / (nu + x * x), nu / 2, F.lit(0.5)) / 2], lambda tail: F.when(x > 0, 1 - tail).otherwise(tail)))


def t_test_p(x: Column, nu: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    return _let([x, nu], lambda x, nu: beta_i(nu / (nu + x * x), nu / 2, F.lit(0.5)))
