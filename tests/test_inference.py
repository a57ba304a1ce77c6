"""Tail intervals, copulas, ranking losses, limits and graph scores against brute force and known parameters."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from alphaloom import plans
from alphaloom.operators import copulas as cop
from alphaloom.operators import engines as eng
from alphaloom.operators import ranking, tails
from alphaloom.plans import registry

plans.load()
from alphaloom.plans import inference as inf  # noqa: E402

SMALL = "/root/testdata/sf0.001"
CASES = [("gaussian", 0.5, math.inf), ("clayton", 2.0, math.inf), ("gumbel", 2.0, math.inf), ("frank", 5.0, math.inf), ("rotated_gumbel", 2.0, math.inf), ("t", 0.6, 3.0)]


def test_student_matches_the_incomplete_beta():
    x = np.array([-3.0, -0.5, 0.0, 1.7, 6.0])
    assert cop.distribution(x, 4.5) == pytest.approx([eng.t_cdf(v, 4.5) for v in x], abs=1e-6)
    assert cop.quantile(cop.distribution(x, 4.5), 4.5) == pytest.approx(x, abs=1e-4)


@pytest.mark.parametrize("family,theta,nu", CASES)
def test_families_agree_with_their_draws(family, theta, nu):
    grid = (np.arange(300) + 0.5) / 300
    u, v = np.meshgrid(grid, grid)
    density = np.exp(cop.log_density(family, theta, nu, u, v))
    assert density.mean() == pytest.approx(1, abs=0.02)
    a, b = np.array([0.3, 0.5, 0.8]), np.array([0.4, 0.5, 0.2])
    sums = [density[(u < p) & (v < q)].sum() / u.size for p, q in zip(a, b)]
    assert cop.distribution_of(family, theta, nu, a, b) == pytest.approx(sums, abs=0.01)
    x = cop.simulate_copula(family, theta, 4000, seed=1, nu=nu)
    assert [((x[:, 0] <= p) & (x[:, 1] <= q)).mean() for p, q in zip(a, b)] == pytest.approx(sums, abs=0.025)
    got = cop.copula(x[:, 0], x[:, 1])
    assert cop.FAMILIES[int(got["family"])] == family and got["theta"] == pytest.approx(theta, rel=0.1)


def test_fit_test_rejects_the_wrong_family():
    x = cop.simulate_copula("clayton", 4.0, 300, seed=3)
    u, v = cop.ranks(x[:, 0]), cop.ranks(x[:, 1])
    assert cop.goodness_of_fit("clayton", 4.0, math.inf, u, v, 60)["p"] > 0.05
    assert cop.goodness_of_fit("gaussian", 0.1, math.inf, u, v, 60)["p"] < 0.05
    brute = sum((((u <= a) & (v <= b)).mean() - c) ** 2 for a, b, c in zip(u, v, (u**-4.0 + v**-4.0 - 1) ** -0.25))
    assert cop.goodness_of_fit("clayton", 4.0, math.inf, u, v, 1)["cvm"] == pytest.approx(brute, rel=1e-3)


def test_profile_intervals_hold_the_parameters():
    r = np.random.default_rng(3)
    xi, beta = 0.35, 1.2
    x = -np.concatenate([r.uniform(-1, 0, 9_000), beta / xi * ((1 - r.uniform(size=1000)) ** -xi - 1)])
    got = tails.profile_intervals(x)
    assert got["xi_low"] < got["xi"] < got["xi_high"] and got["xi_low"] < xi < got["xi_high"]
    assert got["beta_low"] < beta < got["beta_high"]
    assert got["var_low"] < beta / xi * (0.1**-xi - 1) < got["var_high"]
    e = np.array([0.1, 0.4, 2.0])
    want = sum(-math.log(1.5) - (1 + 1 / 0.3) * math.log(1 + 0.3 * v / 1.5) for v in e)
    assert float(tails.gpd_loglik(0.3, 1.5, e)) == pytest.approx(want)
    assert tails.gpd_loglik(np.array([-0.9]), np.array([1.0]), e)[0] == -np.inf


def test_pair_copulas(spark):
    got = registry.QUERIES["m15_pair_copulas"](spark, SMALL).toPandas()
    whole = registry.QUERIES["m15_multi_copula"](spark, SMALL).toPandas()
    assert (got.a < got.b).all() and len(got) == len(got[["book", "a", "b"]].drop_duplicates())
    for w in whole.itertuples():
        mine = got[got.book == w.book]
        assert w.pairs == len(mine) and w.loglik == pytest.approx(mine.loglik.sum())
        assert w.aic == pytest.approx(2 * (2 * len(mine) + (mine.family == 5).sum()) - 2 * mine.loglik.sum())


def test_cholesky(spark):
    a = np.array([[4.0, 2.0, 0.4], [2.0, 3.0, 0.5], [0.4, 0.5, 1.0]])
    low = ranking.cholesky(a)
    assert low @ low.T == pytest.approx(a) and np.allclose(low, np.tril(low))
    assert np.isfinite(ranking.cholesky(np.ones((3, 3)))).all()
    got = registry.QUERIES["h13_cholesky"](spark, SMALL).toPandas()
    assert (got.i >= got.j).all() and (got[got.i == got.j].value > 0).all()


@pytest.mark.parametrize("block", [3, 1024])
def test_ranking_gradient_by_brute_force(spark, block):
    r = np.random.default_rng(7)
    day = dt.date(2020, 1, 1)
    rows = [(day, i, int(r.integers(0, 4)), float(r.normal())) for i in range(20)] + [(dt.date(2020, 1, 2), i, 0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "trade_date date, code long, label int, value double")
    got = {(x.trade_date, x.code): x.gradient for x in ranking.ranking_gradient(df, 5, block=block).collect()}
    ideal = sum((2**g - 1) / math.log2(k + 2) for k, g in enumerate(sorted((x[2] for x in rows[:20]), reverse=True)[:5]))
    want = dict.fromkeys(((x[0], x[1]) for x in rows), 0.0)
    for _, i, a, s in rows[:20]:
        for _, j, b, z in rows[:20]:
            if a > b:
                p = 1 / (1 + math.exp(z - s))
                step = (2**a - 2**b) / ideal * p * (1 - p)
                want[day, i] -= step
                want[day, j] += step
    assert got == pytest.approx(want)
    assert {x.trade_date: x.loss for x in ranking.ranking_loss(df).collect()}[dt.date(2020, 1, 2)] == 0


def test_weights_within_limits(spark):
    r = np.random.default_rng(5)
    x = r.normal(0.001, 0.05, (80, 12))
    w = inf.risk_integrated(x, np.eye(12)[:1], np.array([0.05]))
    cov, var = eng.shrunk_covariance(x), eng.gpd_mle(x.ravel())["var_99"]
    assert w.sum() <= 0.95 + 1e-9 and (w >= -1e-9).all() and w.max() <= 0.1 + 1e-9 and w[0] == w.max()
    assert 2.326 * math.sqrt(w @ cov @ w) <= var + 1e-9
    assert inf.risk_integrated(x[:4], np.eye(12)[:1], np.array([0.05])).sum() <= 0.95


def test_validation_of_several_factors(spark):
    r = np.random.default_rng(2)
    series = {"strong": 0.1 + r.normal(0, 0.02, 60), "none": np.tile([0.01, -0.01], 30), "short": r.normal(size=11), "flat": np.full(20, 0.1), "middle": r.normal(0.05, 0.1, 20)}
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for k, xs in series.items() for i, v in enumerate(xs)]
    got = inf.validated(spark.createDataFrame(rows, "name string, trade_date date, ic double")).toPandas().set_index("name")
    assert set(got.index) == {"strong", "none", "middle"} and got.p["strong"] < 1e-6 and got.p["none"] == pytest.approx(1)
    x = series["middle"]
    assert got.t_stat["middle"] == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(20))
    assert pd.isna(got.persistence["middle"]) and got.persistence["strong"] < 1
    empty = inf.validated(spark.createDataFrame([], "name string, trade_date date, ic double"))
    assert empty.count() == 0
