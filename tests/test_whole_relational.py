"""Relational queries over whole tables, against sets and pandas."""

import datetime as dt

import pandas as pd
import pytest

from alphaloom import plans
from alphaloom.plans import registry
from alphaloom.plans.crosssection import momentum
from alphaloom.sources.adapters import Tables

plans.load()
DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, DIR)


@pytest.fixture(scope="module")
def monthly(tables):
    m = tables.monthly.toPandas()
    m["end"] = [(pd.Timestamp(d) + pd.offsets.MonthEnd(0)).date() for d in m.trade_date]
    return m


@pytest.fixture(scope="module")
def financials(tables):
    return tables.financials.toPandas()


def rows(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, DIR).collect())


def test_flatten(spark, monthly):
    assert rows(spark, "b12_flatten_map", "code", "trade_date", "close") == sorted(zip(monthly.code, monthly.trade_date, monthly.close))


def test_sets(spark, monthly, financials):
    a, b = set(zip(monthly.code, monthly.end)), set(zip(financials.code, financials.report_date))
    assert a & b and a - b
    assert rows(spark, "g02_intersect", "code", "report_date") == sorted(a & b)
    assert rows(spark, "g03_difference", "code", "report_date") == sorted(a - b)


def test_outer_zero(spark, monthly, financials):
    x, y = dict(zip(zip(monthly.code, monthly.end), monthly.volume)), dict(zip(zip(financials.code, financials.report_date), financials.n_orders))
    got = rows(spark, "c03_full_outer_zero", "code", "report_date", "x", "y")
    assert got == [(*k, x.get(k, 0), y.get(k, 0)) for k in sorted(x.keys() | y.keys())]
    assert x.keys() - y.keys()


def test_outer_half(spark, tables, financials):
    m = tables.returns.where("ret IS NOT NULL").toPandas()
    x = (m.ret > 0).groupby([m.code, [d.year for d in m.trade_date]]).mean().to_dict()
    y = (financials.net_profit > 0).groupby([financials.code, [d.year for d in financials.report_date]]).mean().to_dict()
    got = rows(spark, "c04_full_outer_half", "code", "year", "x", "y")
    assert [g[:2] for g in got] == sorted(x.keys() | y.keys())
    assert all(g[2:] == pytest.approx((x.get(g[:2], 0.5), y.get(g[:2], 0.5)), abs=2e-6) for g in got)


def test_missing_dates(spark, tables, monthly):
    codes = [r.code for r in tables.industry.select("code").collect()]
    there = set(zip(monthly.code, monthly.trade_date))
    assert rows(spark, "c12_missing_dates", "code", "trade_date") == sorted((c, d) for c in codes for d in set(monthly.trade_date) if (c, d) not in there)


def test_calendar(spark, tables):
    bars = tables.bars.select("code", "trade_date").toPandas().groupby("code").trade_date.agg(["min", "max"])
    want = [(c, a + dt.timedelta(i)) for c, a, z in bars.sort_index().itertuples() for i in range((z - a).days + 1)]
    assert rows(spark, "h17_date_sequence", "code", "d") == want and len(want) > 31 * len(bars)


def test_fill(spark, tables, monthly):
    m = momentum(tables).where("value IS NOT NULL").toPandas().pivot(index="trade_date", columns="code", values="value")
    m = m.reindex(index=[r.trade_date for r in momentum(tables).select("trade_date").distinct().orderBy("trade_date").collect()], columns=sorted(set(monthly.code)))
    want = m.apply(lambda r: r.fillna(r.median()), axis=1).fillna(0.0)
    got = registry.QUERIES["k03_fill_missing"](spark, DIR).toPandas()
    assert len(got) == want.size
    assert all(v == pytest.approx(want.at[d, c], abs=2e-6) for d, c, v in zip(got.trade_date, got.code, got.value.astype(float)))
    assert {c for c in m.columns if c % 7 == 0 and m[c].notna().any()}
