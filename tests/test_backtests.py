"""Streamed backtests against a price matrix held in pandas, folds against the plain rule, and figures against numpy."""

import numpy as np
import pandas as pd
import pytest

from alphaloom.operators import backtests as bt


def matrix_backtest(prices, scores, top, every, capital=1_000_000.0, slip=0.0001, commission=0.0003, least=5.0, stamp=0.001, lot=1):
    close = prices.pivot_table(index="trade_date", columns="code", values="close")
    score = scores.pivot_table(index="trade_date", columns="code", values="value").reindex(close.index)
    filled, cash, held, out = close.ffill(), capital, {}, []
    for k, day in enumerate(close.index):
        moved = 0.0
        ranked = score.loc[day].dropna()
        ranked = ranked[close.loc[day].reindex(ranked.index).notna()]
        if k % every == 0 and len(ranked):
            for c, n in held.items():
                v = n * filled.loc[day, c] * (1 - slip)
                cash += v - max(v * commission, least) - v * stamp
                moved += v
            held = {}
            best = sorted(ranked.items(), key=lambda p: (-p[1], p[0]))[:top]
            each = cash / len(best)
            for c, _ in best:
                price = close.loc[day, c] * (1 + slip)
                n = int(each / (price * (1 + commission)) / lot) * lot
                v = n * price
                if n and v + max(v * commission, least) <= cash:
                    cash -= v + max(v * commission, least)
                    held[c] = n
                    moved += v
        out.append((day, cash + sum(n * filled.loc[day, c] for c, n in held.items()), moved))
    return out


@pytest.fixture(scope="module")
def market(spark):
    r = np.random.default_rng(3)
    days = pd.date_range("2020-01-01", periods=60).date
    close = 20 * np.exp(np.cumsum(r.normal(size=(60, 15)) * 0.03, 0))
    rows = [(d, c, float(close[i, c]), float(r.normal())) for i, d in enumerate(days) for c in range(15) if r.random() > 0.1]
    frame = pd.DataFrame(rows, columns=["trade_date", "code", "close", "value"])
    frame.loc[frame.trade_date < days[4], "value"] = np.nan  # no signals yet
    frame.loc[frame.trade_date == days[30], "value"] = np.nan  # a date without any
    df = spark.createDataFrame(frame.astype({"value": object}).where(frame.notna(), None), "trade_date date, code long, close double, value double")
    return frame, df, days


@pytest.mark.parametrize("lot", [1, 100])
def test_paths(spark, market, lot):
    frame, df, days = market
    grid = spark.createDataFrame([(f"{n}_{k}", n, k) for n in (1, 4, 20) for k in (1, 5, 6)], "experiment string, top int, every int")
    folds = bt.walk_folds(60, 20, 15, 15)
    assert folds == [(0, 20, 34), (1, 35, 49)]
    got = bt.paths(df.select("trade_date", "code", "close"), df.select("trade_date", "code", "value"), bt.runs_of(grid, folds, 59), lot=lot).toPandas()
    assert len(got) == 9 * (60 + 15 + 15)
    for (name, fold), path in got.groupby(["experiment", "fold"]):
        n, k = map(int, name.split("_"))
        lo, hi = dict([(-1, (0, 59)), (0, (20, 34)), (1, (35, 49))])[fold]
        here = frame[(frame.trade_date >= days[lo]) & (frame.trade_date <= days[hi])]
        want = matrix_backtest(here, here.dropna(), n, k, lot=lot)
        path = path.sort_values("trade_date")
        assert path.trade_date.tolist() == [w[0] for w in want]
        assert np.allclose(path.equity, [w[1] for w in want], rtol=1e-12) and np.allclose(path.turnover, [w[2] for w in want], rtol=1e-9)


def test_figures_and_search(spark, market):
    _, df, _ = market
    grid = spark.createDataFrame([("a", 2, 3), ("b", 5, 4), ("c", 3, 2)], "experiment string, top int, every int")
    path = bt.paths(df.select("trade_date", "code", "close"), df.select("trade_date", "code", "value"), bt.runs_of(grid, bt.purged_folds(60), 59)).persist()
    f = bt.figures(path, 252).toPandas().set_index(["experiment", "fold"])
    for key, p in path.toPandas().groupby(["experiment", "fold"]):
        e = p.sort_values("trade_date").equity.to_numpy()
        r = e[1:] / e[:-1] - 1
        assert f.loc[key, "sharpe"] == pytest.approx((r.mean() - 0.03 / 252) / r.std(ddof=1) * np.sqrt(252)) and f.loc[key, "total_return"] == pytest.approx(e[-1] / e[0] - 1)
        assert f.loc[key, "max_drawdown"] == pytest.approx((1 - e / np.maximum.accumulate(e)).max())
    s = bt.grid_search(path, 252).toPandas().set_index("experiment")
    means = f[f.index.get_level_values(1) >= 0].groupby("experiment").sharpe.mean()
    assert s.sharpe_mean.to_dict() == pytest.approx(means.to_dict()) and s.sort_values("place").index.tolist() == means.sort_values(ascending=False).index.tolist()
    assert (s.folds == len(bt.purged_folds(60))).all()


def test_folds():
    assert bt.purged_folds(100) == [(0, 20, 39), (1, 40, 59), (2, 60, 79), (3, 80, 99)] and bt.purged_folds(14) == []
    assert bt.walk_folds(400) == [(0, 252, 314), (1, 315, 377)] and bt.walk_folds(300) == []
