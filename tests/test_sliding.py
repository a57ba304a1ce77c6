"""Factors by matrices of frames equal the same factors as Spark's frames, and no frame is evaluated by Spark."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import factors as fac
from alphaloom.operators import sliding
from alphaloom.operators.factor_engine import Engine


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    rows = []
    for code, n in ((1, 330), (2, 70), (3, 4), (4, 90)):
        for k in range(n):
            c = 100.0 if code == 4 else float(np.round(50 + 10 * rng.random(), 6))
            hole = code == 2 and k % 11 == 0
            rows.append((code, dt.date(2020, 1, 1) + dt.timedelta(k), c - 1, c + 2, c - 2, None if code == 1 and k == 40 else c, None if hole else float(rng.integers(0, 4)), c * 3, None if hole else float(np.round(rng.random(), 4)), None if k % 17 == 5 else float(rng.normal() / 50)))
    b = spark.createDataFrame(rows, "code long, trade_date date, open double, high double, low double, close double, volume double, amount double, turnover_rate double, mkt double")
    return fac.with_returns(b).repartition(3).cache()


def same(got, want):
    keys = ["code", "trade_date"]
    a, b = (x.orderBy(*keys).toPandas() for x in (got.select(*want.columns), want))
    assert len(a) == len(b)
    for c in want.columns[2:]:
        for x, y in zip(a[c], b[c]):
            assert (x is None or math.isnan(x)) == (y is None or math.isnan(y)), c
            assert x is None or math.isnan(x) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-11), c


@pytest.mark.parametrize("names", [["roc", "std", "corr", "max", "min", "vma"], ["vstd", "cntp", "beta", "rsqr", "rank", "skew"], ["kurt", "turn", "amp", "vwap", "oc"]])
def test_families(bars, names):
    want = bars.select("code", "trade_date", *[fac.FAMILIES[n](w).alias(f"{n}_{w}") for n in names for w in (5, 20)])
    same(fac.families(bars, names, [5, 20]), want)


def test_crosses(bars):
    same(fac.crossed(bars), bars.select("code", "trade_date", *[c.alias(k) for k, c in fac.crosses().items()]))


def test_singles(bars):
    names = ["turnover_momentum", "historical_vol", "downside_vol", "beta", "var_95", "volume_ratio", "money_flow", "turnover_anomaly"]
    engine = Engine.standard().enabled([*names, "momentum_1m", "close"])
    want = bars.select("code", "trade_date", *[engine.factors[n].expression().alias(n) for n in [*names, "momentum_1m"]])
    same(engine.compute(bars), want)


def test_long_series(spark):
    """More bars than frames are held at a time."""
    b = spark.range(2 * sliding.ROWS + 7).select(F.lit(1).alias("code"), F.expr("date_add(date'2000-01-01', cast(id AS INT))").alias("trade_date"), (F.col("id") * 7919 % 101 + 1.0).alias("close"), (F.col("id") * 31 % 17 + 1.0).alias("volume"))
    b = fac.with_returns(b)
    same(fac.families(b, ["corr", "std", "roc"], [60]), b.select("code", "trade_date", *[fac.FAMILIES[n](60).alias(f"{n}_60") for n in ("corr", "std", "roc")]))


def test_no_frames_in_plans(bars):
    for df in (fac.crossed(bars), fac.families(bars, ["kurt"], [60]), Engine.standard().enabled(["beta", "var_95"]).compute(bars)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RowFrame, -59" not in plan and "RowFrame, -251" not in plan


def test_profile_likelihood():
    """Logarithms of products of factors: the likelihood by a logarithm for each excess."""
    from alphaloom.operators import tails

    rng = np.random.default_rng(5)
    e = rng.exponential(0.02, 47)
    xi, beta = rng.uniform(-0.99, 0.95, (40, 1)), rng.uniform(0.002, 0.1, (40, 31))
    with np.errstate(all="ignore"):
        z = 1 + xi[..., None] * e / beta[..., None]
        want = np.where((z > 0).all(-1), -len(e) * np.log(beta) - (1 + 1 / xi) * np.log(z).sum(-1), -np.inf)
    calls, log = [], np.log
    try:
        np.log = lambda x, *a, **k: calls.append(np.size(x)) or log(x, *a, **k)
        got = tails.gpd_loglik(xi, beta, e)
    finally:
        np.log = log
    assert np.allclose(got, want, rtol=1e-12) and sum(calls) <= (len(e) // 8 + 2) * beta.size


def test_orders_are_drawn_once_a_length():
    """Series of one length share their random orders."""
    from alphaloom.operators import forecasts as fc

    assert fc._kept_draw(50, 5000, 8, 42, 0) is fc._kept_draw(50, 5000, 8, 42, 0)
    days = fc._draw(50, 5000, 8, 42, 4864)
    assert days.shape == (50, 136) and (np.sort(days, axis=0) == np.arange(50)[:, None]).all()


def test_frames_together(spark):
    """A function of many frames is called for many at once, and alone for those where it raises."""
    from alphaloom.operators import forecasts as fc

    def spread(x):
        if (x == 13.0).any():
            raise ValueError
        return x.max(axis=1) - x.min(axis=1) + (1000 if len(x) > 1 else 0)

    rows = spark.createDataFrame([(c, k, float(k * c)) for c in (1, 2) for k in range(20)], "code long, trade_date int, close double")
    got = {(r.code, r.trade_date): r.v for r in fc.rolling(rows, "close", spread, 4, "v", many=True).collect()}
    assert got[2, 19] == 1006.0 and got[2, 2] is None  # no 13 among the even numbers: all frames at once
    assert got[1, 5] == 3.0 and all((got[1, k] is None) == (k < 3 or 13 <= k <= 16) for k in range(20))


def test_state_round_trips():
    """A key whose state is known costs one read, one write and one timer moved; none is looked for."""
    import pandas as pd

    from alphaloom.streaming.state import LastValue

    calls = []

    class Fake:
        held = None

        def __getattr__(self, name):
            def call(*a):
                calls.append(name)
                if name == "update":
                    Fake.held = a[0]
                return Fake.held if name == "get" else None

            return call

    p = LastValue(1000)
    p.handle = p.state = Fake()
    at = pd.Timestamp("2024-01-01")
    rows = lambda *x: iter([pd.DataFrame([{"event_id": i, "ts": at + pd.Timedelta(ms, "ms"), "value": 1.0 * i} for i, ms in x])])
    first = next(p.handleInputRows((1, "a"), rows((2, 500), (1, 0)), None))
    assert list(first.event_id) == [1, 2] and list(first.hit) == [False, True] and calls == ["get", "update", "registerTimer"]
    calls.clear()
    assert list(next(p.handleInputRows((1, "a"), rows((3, 1400)), None)).previous) == [2.0] and calls == ["get", "update", "deleteTimer", "registerTimer"]
