"""Blocks of codes are written once and read by the tasks that need them: no series is shuffled for every two blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.functions.scalar import rounded, rounded_array
from alphaloom.operators import gram


@pytest.fixture(scope="module")
def wide():
    r = np.random.default_rng(11)
    x = r.normal(size=(50, 40)) * 0.02
    x[:, 25:][r.random((50, 15)) < 0.1] = np.nan
    return pd.DataFrame(x, index=range(50), columns=[f"c{i:03d}" for i in r.permutation(700)[:40]])


def table(spark, wide, more=()):
    rows = wide.stack().reset_index()
    rows.columns = ["trade_date", "code", "ret"]
    return spark.createDataFrame([*map(tuple, rows[["code", "trade_date", "ret"]].to_numpy().tolist()), *more], "code string, trade_date int, ret double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_covariances_shuffle_nothing(spark, wide):
    """Some codes have every date, some not; a row without a code makes no pair."""
    got = gram.covariances(table(spark, wide, [(None, 3, 0.5), (None, 4, 0.1)]), width=8, digits=6)
    assert "Exchange" not in plan(got)
    got = got.toPandas().set_index(["a", "b"]).sort_index()
    order = sorted(wide.columns)
    want = wide[order].cov().stack(), wide[order].corr().stack()
    assert list(got.index) == [(a, b) for a in order for b in order if a <= b]
    for c, w in zip(("cov", "corr"), want):
        w = w[got.index]
        assert np.abs(got[c] - w).max() < 6e-7 and (got[c] == got[c].round(6)).all()


def test_arrays_round_as_columns(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=2000) * 10.0 ** r.integers(-9, 4, 2000), np.arange(-50, 50) / 2e6, [0.0, -0.0, -1e-8, np.nan, np.inf, -np.inf]])
    for digits in (6, 9):
        want = [v[0] for v in spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1).select(rounded(F.col("x"), digits)).collect()]
        got = rounded_array(x, digits)
        assert np.array_equal(got, want, equal_nan=True) and not np.signbit(got[got == 0]).any()
    assert rounded_array(x, None) is x


def test_shrunk_deals_once(spark, wide, monkeypatch):
    """One writing of blocks serves the sums and the pairs."""
    dealt, real = [], gram.deal
    monkeypatch.setattr(gram, "deal", lambda *a, **k: dealt.append(real(*a, **k)) or dealt[-1], raising=False)
    got = gram.shrunk(table(spark, wide), width=8, digits=9)
    assert len(dealt) == 1 and dealt[0].n > 3 and "Exchange" not in plan(got)
    got = got.toPandas().set_index(["a", "b"]).sort_index()
    order = sorted(wide.columns)
    s, dev = wide[order].cov().to_numpy(), (wide[order] - wide[order].mean()).to_numpy()
    v, t, off = np.diag(s), (~np.isnan(dev)).sum(0), ~np.eye(len(order), dtype=bool)
    target = np.where(off, v.mean() * (s / np.sqrt(np.outer(v, v)))[off].mean(), v.mean())
    gap, noise = ((s - target) ** 2).mean(), (np.nansum((dev**2 - v) ** 2, 0) / (t * (t - 1))).mean()
    share = gap / (gap + noise)
    upper = np.triu_indices(len(order))
    assert list(got.index) == [(order[i], order[j]) for i, j in zip(*upper)]
    assert np.allclose(got.shrinkage, share) and np.abs(got["cov"] - ((1 - share) * s + share * target)[upper]).max() < 6e-10
