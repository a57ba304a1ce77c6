"""Scalar functions as Column expressions, which run in the JVM; rounded_array is rounded for what Python makes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing number (fixed values).
MISSING = ["-", "—", "", "nan", "None"]


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero; halves go up, by a shift a thousand times finer than the last digit."""
    return F.round(x.cast("double") + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def rounded_array(x: np.ndarray, digits: int | None = 6) -> np.ndarray:
    """As rounded, of an array; as it is, without digits."""
    if digits is None:
        return x
    y = (x + 10.0 ** -(digits + 3)) * 10.0**digits
    return np.where(np.isfinite(y), np.copysign(np.floor(np.abs(y) + 0.5), y) / 10.0**digits, x) + 0.0


def half_even(x: Column, digits: int = 4) -> Column:
    return F.bround(x, digits)


def valid(x: Column, bound: float = 1e8) -> Column:
    """Neither NaN nor infinite nor as large as the bound."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound)


def clean(x: Column, bound: float = 1e8) -> Column:
    return F.when(valid(x, bound), x)


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def safe_pct_change(old: Column, new: Column, default: float = 0.0) -> Column:
    return safe_divide(new - old, old, default)


def safe_number(text: Column) -> Column:
    """A double, or null for the spellings of a missing one and for what is no number."""
    t = F.trim(text)
    return clean(F.when(~t.isin(MISSING), t).try_cast("double"), float("inf"))


def to_float(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def ratio_percent(a: Column, b: Column) -> Column:
    return F.bround(F.try_divide(a, b) * 100, 2)


def nearly(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) < tolerance


def pad_code(code: Column) -> Column:
    return F.lpad(code.cast("string"), 6, "0")


def market_code(code: Column) -> Column:
    """Six digits and the exchange that the first one tells."""
    c = pad_code(code)
    first = F.substring(c, 1, 1)
    exchange = F.when(first.isin("0", "3"), "SZ").when(first == "6", "SH").when(first.isin("4", "8"), "BJ").otherwise("SZ")
    return F.concat_ws(".", c, exchange)


def normal_date(text: Column) -> Column:
    """A date from YYYYMMDD, YYYY/MM/DD or YYYY-MM-DD; null for anything else."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{8}$"), F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(F.regexp_replace(t, "/", "-"))
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso).try_cast("date")


def days_between(a: Column, b: Column, failed: int = 999) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(failed))


def report_label(date: Column) -> Column:
    m = F.month(date)
    return F.when(m == 3, "Q1").when(m == 6, "Q2").when(m == 9, "Q3").otherwise("Q4")


def norm_cdf(x: Column) -> Column:
    """Distribution function of the standard normal by the polynomial 7.1.26 of Abramowitz and Stegun."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    y = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * y)


def norm_cdf_sql(x: str) -> str:
    z, s = f"(abs({x}) / sqrt(2.0))", f"sign({x})"
    t = f"(1 / (1 + 0.3275911 * {z}))"
    y = f"(1 - (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{z} * {z}))"
    return f"(0.5 * (1 + {s} * {y}))"


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def erf(x: Column) -> Column:
    return 2 * norm_cdf(x * math.sqrt(2)) - 1


def label(score: Column, strong: float = 0.3, weak: float = 0.1) -> Column:
    return F.when(score > strong, "strong_positive").when(score > weak, "positive").when(score < -strong, "strong_negative").when(score < -weak, "negative").otherwise("neutral")


def keyword_class(text: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The label of the first rule whose pattern occurs."""
    out = None
    for pattern, name in rules:
        hit = F.lower(text).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out.otherwise(other), F.lit(other)) if out is not None else F.lit(other)


def embedded_json(text: Column) -> Column:
    """The JSON object in a text: the text itself, a fenced block, or from the first { to the last }."""
    t = F.trim(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(t.rlike(r"(?s)^\{.*\}$"), t).when(fenced != "", fenced).when(braces != "", braces)


def binary_even(x: Column, digits: int = 2) -> Column:
    """Rounded by the product with a power of ten, as it is in binary, exact halves to the even digit. half_even() goes by
    the shortest decimal instead, which can be a half where the product is none."""
    scale = F.lit(10.0**digits)
    return F.rint(x * scale) / scale


def short_amount(x: Column) -> Column:
    """Money as text: hundreds of millions and tens of thousands abbreviated (units 亿 and 万), else two digits."""
    return (
        F.when(F.abs(x) >= 1e8, F.concat(F.format_string("%.2f", binary_even(x / 1e8)), F.lit("亿")))
        .when(F.abs(x) >= 1e4, F.concat(F.format_string("%.2f", binary_even(x / 1e4)), F.lit("万")))
        .otherwise(F.format_string("%.2f", binary_even(x)))
    )


def signed_percent(x: Column) -> Column:
    return F.concat(F.when(x > 0, "+").otherwise(""), F.format_string("%.2f", F.bround(x * 100, 2)), F.lit("%"))


def order_statistic(x: Column, alpha: float) -> Column:
    """Aggregate: sorted values, the one at place int(n * alpha), without interpolation."""
    values = F.sort_array(F.collect_list(x))
    return F.get(values, F.floor(F.size(values) * alpha).cast("int"))
