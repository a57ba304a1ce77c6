"""Special functions against the standard library and closed forms."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from alphaloom.functions import special as sp
from alphaloom.operators import engines as eng


def column(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).repartition(2).sortWithinPartitions("i").orderBy("i").select(expression).collect()]


def test_normal(spark):
    z = [k / 7 for k in range(-45, 46)]
    got = column(spark, list(enumerate(z)), "i int, x double", sp.normal_cdf(F.col("x")))
    assert all(abs(a - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-13 for a, x in zip(got, z))
    p = [1e-12, 1e-6, 0.001, 0.024, 0.0243, 0.3, 0.5, 0.77, 0.9757, 0.976, 0.999, 1 - 1e-6]
    got = column(spark, list(enumerate([*p, 0.0, 1.0, -1.0])), "i int, p double", sp.inverse_normal(F.col("p")))
    assert all(abs(a - NormalDist().inv_cdf(x)) < 1e-9 * max(1, abs(a)) for a, x in zip(got, p)) and got[-3:] == [None] * 3


def test_gamma(spark):
    x = [0.5, 0.7, 1, 1.5, 2, 3.3, 10, 77.7, 500]
    assert all(abs(a - math.lgamma(v)) < 1e-11 * max(1, abs(a)) for a, v in zip(column(spark, list(enumerate(map(float, x))), "i int, x double", sp.log_gamma(F.col("x"))), x))
    rows = [(k, x) for k in (2, 4, 8, 40, 400) for x in (0.0, 0.01, 1.0, k / 2, float(k), 2.0 * k, 5.0 * k)]
    got = column(spark, [(i, k, x) for i, (k, x) in enumerate(rows)], "i int, k int, x double", sp.chi2_sf(F.col("x"), F.col("k")))
    for a, (k, x) in zip(got, rows):  # even degrees of freedom: a sum of Poisson terms
        want = sum(math.exp(-x / 2 + j * math.log(x / 2) - math.lgamma(j + 1)) if x else float(j == 0) for j in range(k // 2))
        assert a == pytest.approx(want, abs=1e-11)
    odd = column(spark, [(0, 1, 3.841458820694124), (1, 3, 7.814727903251179)], "i int, k int, x double", sp.chi2_sf(F.col("x"), F.col("k")))
    assert odd == pytest.approx([0.05, 0.05], abs=1e-10)


def test_student(spark):
    rows = [(nu, t) for nu in (1, 2, 3, 5, 30, 400) for t in (-8.0, -1.5, -0.1, 0.0, 0.3, 2.0, 12.0)]
    got = column(spark, [(i, n, t) for i, (n, t) in enumerate(rows)], "i int, n int, t double", sp.t_cdf(F.col("t"), F.col("n")))
    for a, (n, t) in zip(got, rows):
        want = 0.5 + math.atan(t) / math.pi if n == 1 else 0.5 + t / 2 / math.sqrt(2 + t * t) if n == 2 else eng.t_cdf(t, n)
        assert a == pytest.approx(want, abs=1e-11)
    p = column(spark, [(0, 12, 2.178812829667229), (1, 5, -2.570581835636314)], "i int, n int, t double", sp.t_test_p(F.col("t"), F.col("n")))
    assert p == pytest.approx([0.05, 0.05], abs=1e-10)
    b = column(spark, [(0, 0.3), (1, 0.9), (2, 0.0), (3, 1.0)], "i int, x double", sp.beta_i(F.col("x"), F.lit(2.0), F.lit(3.0)))
    assert b == pytest.approx([sum(math.comb(4, k) * x**k * (1 - x) ** (4 - k) for k in range(2, 5)) for x in (0.3, 0.9, 0.0, 1.0)], abs=1e-12)
