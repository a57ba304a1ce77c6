"""Copulas of d variables against two-dimensional ones, integrals and known laws; DCC and tail losses against known ones."""

import math

import numpy as np
import pandas as pd
import pytest

from alphaloom.operators import copulas as cop
from alphaloom.operators import dependence as dep
from alphaloom.operators import engines as eng

CASES = [("clayton", 1.7), ("gumbel", 1.6), ("rotated_gumbel", 1.6), ("frank", 4.0)]


@pytest.mark.parametrize("family, theta", CASES)
def test_density(family, theta):
    r = np.random.default_rng(1)
    u = r.uniform(0.02, 0.98, (50, 2))
    assert np.allclose(dep.log_density(family, theta, u), cop.log_density(family, theta, math.inf, u[:, 0], u[:, 1]), atol=1e-8)
    # over the unit cube the density of three variables integrates to one
    nodes, w = np.polynomial.legendre.leggauss(48)
    nodes, w = (np.sin(math.pi / 2 * nodes) + 1) / 2, w * math.pi / 4 * np.cos(math.pi / 2 * nodes)
    x = np.stack(np.meshgrid(nodes, nodes, nodes), -1).reshape(-1, 3)
    total = (np.exp(dep.log_density(family, theta, x)) * np.einsum("i,j,k->ijk", w, w, w).ravel()).sum()
    assert total == pytest.approx(1, abs=0.02)


@pytest.mark.parametrize("family, theta", [*CASES, ("gaussian", 0.6), ("t", 0.6)])
def test_draws(family, theta):
    d = 4
    corr = np.full((d, d), theta) + (1 - theta) * np.eye(d) if family in ("gaussian", "t") else np.eye(d)
    u = dep.draw(family, theta, 5.0, corr, 6_000, 3)
    assert abs(u.mean() - 0.5) < 0.02 and abs(u.var() - 1 / 12) < 0.005
    want = {"clayton": theta / (theta + 2), "gumbel": 1 - 1 / theta, "rotated_gumbel": 1 - 1 / theta, "frank": 0.388}.get(family) or 2 / math.pi * math.asin(min(theta, 1))
    assert cop.kendall(u[:2000, 0], u[:2000, 3]) == pytest.approx(want, abs=0.04)
    fits = dep.fit_copulas(u[:1500])
    assert fits[0]["family"] == family
    if family == "t":
        assert fits[0]["nu"] in (4.0, 5.0, 6.0, 8.0)


def test_dcc_of_two_is_the_pair(spark):
    r = np.random.default_rng(5)
    x = r.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], 300) * 0.01
    two, many = eng.dcc(x[:, 0], x[:, 1]), dep.dcc(x)
    assert many["last"][0, 1] == pytest.approx(two["last_corr"]) and many["mean"][0, 1] == pytest.approx(two["mean_corr"]) and many["loglik"] == pytest.approx(two["loglik"])


def book(x, number=1):
    t, d = x.shape
    return pd.DataFrame({"book": number, "code": np.tile(np.arange(d), t), "trade_date": np.repeat(np.arange(t), d), "ret": x.ravel()})


def test_dcc_recovers_correlations(spark):
    r = np.random.default_rng(6)
    corr = np.array([[1, 0.7, 0.2], [0.7, 1, -0.3], [0.2, -0.3, 1]])
    x = r.multivariate_normal(np.zeros(3), corr, 1500) * 0.02
    fits = dep.dcc_fits(spark.createDataFrame(pd.concat([book(x), book(x[:30], 2)])))
    f = fits.collect()
    assert len(f) == 1 and np.allclose(np.reshape(f[0]["mean"], (3, 3)), corr, atol=0.08) and np.allclose(np.reshape(f[0]["last"], (3, 3)), corr, atol=0.3)
    tail = dep.dcc_tail_loss(fits, scenarios=20_000).collect()[0]
    sd = 0.02 * math.sqrt(np.reshape(f[0]["last"], (3, 3)).sum() / 9)
    assert f[0].nu >= 15 and 2.2 * sd < tail["var"] < 2.9 * sd and tail.tail_loss > tail["var"]


def test_tail_loss_of_a_known_portfolio(spark):
    r = np.random.default_rng(8)
    corr = np.full((4, 4), 0.5) + 0.5 * np.eye(4)
    x = r.multivariate_normal(np.zeros(4), corr, 2500) * 0.01
    fits = dep.copula_fits(spark.createDataFrame(book(x)))
    got = {g.family: g for g in dep.copula_tail_loss(fits, level=0.95, scenarios=20_000).collect()}
    sd = 0.01 * math.sqrt(corr.sum() / 16)
    assert set(got) == set(cop.FAMILIES) and got["gaussian"].place <= 2  # t with many degrees of freedom is nearly the same
    assert got["gaussian"].tail_loss == pytest.approx(2.063 * sd, rel=0.05) and got["gaussian"]["var"] == pytest.approx(1.645 * sd, rel=0.05)
    assert got["clayton"].tail_loss > 1.05 * got["gumbel"].tail_loss  # joint falls weigh more in Clayton's lower tail
    one = {g.family: g for g in dep.copula_tail_loss(fits, {2: 1.0}, level=0.95, scenarios=20_000).collect()}
    assert one["frank"].tail_loss == pytest.approx(2.063 * 0.01, rel=0.06)


def test_scenarios(spark):
    r = np.random.default_rng(9)
    x = r.standard_t(4, (200, 3)) * 0.01
    fits = dep.copula_fits(spark.createDataFrame(book(x))).where("place = 1")
    s = dep.copula_scenarios(fits, 1_000, 7).toPandas()
    assert len(s) == 3_000 and s.scenario.nunique() == 1_000 and s.ret.between(x.min(), x.max()).all() and s.u.between(0, 1).all()
    again = dep.copula_scenarios(fits, 1_000, 7).toPandas()
    key = ["scenario", "code"]
    assert s.sort_values(key).u.tolist() == again.sort_values(key).u.tolist()


def test_covariance_scenarios(spark):
    r = np.random.default_rng(11)
    corr = np.array([[1, 0.6, 0.1], [0.6, 1, 0.3], [0.1, 0.3, 1]])
    x = r.multivariate_normal([0.01, 0.0, -0.01], corr * 0.02**2, 400)
    fits = dep.covariance_fits(spark.createDataFrame(book(x)))
    s = dep.covariance_scenarios(fits, 8_000, 5).toPandas().pivot(index="scenario", columns="code", values="ret").to_numpy()
    assert s.shape == (8_000, 3) and np.allclose(s.mean(0), x.mean(0), atol=0.001)
    assert np.allclose(np.corrcoef(s.T), eng.shrunk_covariance(x) / np.outer(*[np.sqrt(np.diag(eng.shrunk_covariance(x)))] * 2), atol=0.04)
