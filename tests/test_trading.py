"""The broker, files and the factor engine on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from alphaloom.operators import trading as tr
from alphaloom.operators.factor_engine import Engine, configured
from alphaloom.sources import files


def test_broker(spark):
    d = [dt.date(2024, 1, k) for k in (2, 3)]
    rows = [("a", d[0], 1, "BUY", 300, 10.0), ("a", d[0], 2, "SELL", 100, 10.0), ("a", d[1], 1, "SELL", 200, 20.0), ("a", d[1], 2, "SELL", 200, 20.0), ("a", d[1], 3, "BUY", 100, 1.0), ("b", d[0], 1, "SELL", 1, 5.0)]
    orders = spark.createDataFrame(rows, "code string, trade_date date, seq int, side string, quantity long, price double")
    got = {(r.code, r.trade_date, r.seq): r for r in tr.broker(orders).collect()}
    assert [got["a", *k].status for k in ((d[0], 1), (d[0], 2), (d[1], 1), (d[1], 2), (d[1], 3))] == ["filled", "rejected", "filled", "rejected", "filled"]
    assert got["b", d[0], 1].status == "rejected" and got["a", d[1], 3].position == 200
    sale = got["a", d[1], 1]
    assert sale.fill_price == pytest.approx(20 * 0.9999) and sale.commission == pytest.approx(max(sale.fill_price * 200 * 0.0003, 5) + sale.fill_price * 200 * 0.001)


def test_sentiment_counts(spark):
    rows = [("订单放量 大涨", 3, 0), ("不会大涨", 0, 1), ("没有下跌", 1, 0), ("不不不不不不大涨", 0, 1), ("不一二三四五大涨", 1, 0), ("", 0, 0), (None, 0, 0), ("难以修复", 0, 1)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string").select("t", *[c.alias(k) for c, k in zip(tr.sentiment_counts(F.col("t")), "pn")])
    got = {r.t: (r.p, r.n) for r in df.collect()}
    assert got == {t: (p, n) for t, p, n in rows}


def test_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(10).withColumn("x", F.when(F.col("id") < 8, F.col("id")))
    assert files.append(rows, path) == 10 and files.append(rows.limit(3), path) == 3
    assert files.delete(spark, path, F.col("x") > 100) == 0
    gone = files.delete(spark, path, F.col("x") >= 5)
    assert gone == 3 and files.read_table(spark, path).count() == 10  # rows with a null x stay
    assert files.append(rows.limit(2), path) == 2 and files.read_table(spark, path).count() == 12
    assert files.delete(spark, path) == 12 and files.read_table(spark, path).count() == 0
    bom = tmp_path / "bars.csv"
    bom.write_text("﻿ts_code,trade_date,open,high,low,close,vol,amount,turnover_rate\n000001.SZ,20240102,1,2,0.5,1.5,,10,\n", encoding="utf-8")
    (bar,) = files.read_bars(spark, f"file://{bom}").collect()
    assert (bar.code, bar.trade_date, bar.close, bar.volume, bar.turnover_rate) == ("000001", dt.date(2024, 1, 2), 1.5, 0.0, 0.0)


def test_factor_engine():
    engine = Engine.standard()
    assert {"pe", "roc_5", "momentum_1m", "hl_spread_60"} <= set(engine.factors) and engine.factors["var_95"].direction == -1
    assert [*engine.enabled(["roc_5", "none"]).factors] == ["roc_5"]
    assert configured("a: [x, ${B}]\nb: [y]", {"B": "z"}, "a") == ["x", "z"] and configured("", {}, "a") == []


def test_risk_check(spark):
    rows = [(True, True, 0.0, True), (False, False, 0.0, True), (False, True, 60.0, True), (False, True, 10.0, False)]
    df = spark.createDataFrame(rows, "b boolean, p boolean, v double, r boolean")
    got = df.select(*[c.alias(k) for k, c in tr.risk_check(F.col("b"), F.col("p"), F.col("v"), F.lit(1000.0), F.col("r")).items()]).collect()
    assert [(r.risk_score, r.risk_level, r.passed) for r in got] == [(5, "CRITICAL", False), (3, "ELEVATED", False), (2, "GUARDED", True), (1, "LOW", False)]
