"""Covariances and what is made of them over all codes, against pandas."""

import numpy as np
import pytest

from alphaloom import plans
from alphaloom.operators import risk
from alphaloom.plans import registry
from alphaloom.plans.risk import monthly
from alphaloom.sources.adapters import Tables

plans.load()
DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def brute(spark):
    t = Tables(spark, DIR)
    wide = monthly(t).toPandas().pivot(index="trade_date", columns="code", values="ret").sort_index(axis=1)
    there = wide.notna().to_numpy().astype(int)
    balance = t.industry.select("code", "acctbal").toPandas().set_index("code").acctbal.sort_index()
    assert wide.columns.max() > 20
    return wide.cov(min_periods=2), there.T @ there, balance


def rows(spark, name):
    return registry.QUERIES[name](spark, DIR).toPandas()


def test_covariance(spark, brute):
    cov, n, _ = brute
    got = rows(spark, "n01_covariance")
    at, bt = cov.index.get_indexer(got.a), cov.index.get_indexer(got.b)
    assert len(got) == (np.triu(n) > 0).sum() and (got.n == n[at, bt]).all()
    assert np.allclose(got["cov"].astype(float), cov.to_numpy()[at, bt], atol=2e-6, equal_nan=True)


def test_equilibrium(spark, brute):
    cov, _, balance = brute
    want = 2.5 * cov.fillna(0) @ (balance / balance.sum()).reindex(cov.index)
    got = rows(spark, "n02_equilibrium_returns").set_index("code").pi.sort_index()
    assert got.index.tolist() == cov.index.tolist() and np.allclose(got, want, atol=2e-6)


def test_attribution(spark, brute):
    cov, _, balance = brute
    s = cov.fillna(0).to_numpy().sum(1) / len(balance)
    want = risk.Z[0.99] * s / np.sqrt(s.sum() / len(balance))
    got = rows(spark, "o09_risk_attribution").set_index("code").sort_index()
    assert got.index.tolist() == cov.index.tolist()
    assert np.allclose(got.marginal, want, atol=2e-6) and np.allclose(got.component, want / len(balance), atol=2e-6)


def test_rebalance(spark, brute):
    balance = brute[2]
    got = rows(spark, "n08_rebalance").set_index("code").sort_index()
    want = 1 / len(balance) - balance / balance.sum()
    assert got.index.tolist() == balance.index.tolist() and np.allclose(got.change, want, atol=2e-6)
    assert np.allclose(got.amount, want.abs() * 1_000_000, atol=0.02)
    assert (got.side == np.select([want.abs() < 0.005, want > 0], ["hold", "buy"], "sell")).all()
