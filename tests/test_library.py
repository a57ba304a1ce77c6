"""Units of the library: scalar functions, joins, engines and streams on small made-up rows."""

import datetime as dt

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.functions import scalar as sc
from alphaloom.operators import copulas as cop
from alphaloom.operators import crosssection as xs
from alphaloom.operators import engines as eng
from alphaloom.operators import factors as fac
from alphaloom.operators import graph, quality, text, validation
from alphaloom.operators import relational as rel
from alphaloom.streaming import events as st
from alphaloom.streaming import state

D = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, sc.safe_divide(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, sc.half_even(F.lit(0.125), 2)) == 0.12
    assert one(spark, sc.norm_cdf(F.lit(1.645))) == pytest.approx(0.95, abs=1e-4)
    assert [one(spark, sc.safe_number(F.lit(x))) for x in (" 1.5 ", "—", "nan", "x")] == [1.5, None, None, None]
    assert [one(spark, sc.market_code(F.lit(x))) for x in ("1", "600000", "430001")] == ["000001.SZ", "600000.SH", "430001.BJ"]
    assert [one(spark, sc.normal_date(F.lit(x))) for x in ("20200102", "2020/01/02", "soon")] == [D(1), D(1), None]
    assert one(spark, sc.embedded_json(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert one(spark, sc.short_amount(F.lit(123456789.0))) == "1.23亿" and one(spark, sc.signed_percent(F.lit(0.0123))) == "+1.23%"
    assert one(spark, text.sentiment(F.lit("good, not good bad"), ["good"], ["bad"], ["not"])) == pytest.approx(-0.33)
    assert one(spark, text.bigrams(F.lit("abc d"))) == ["ab", "bc"]


def test_as_of_never_looks_ahead(spark):
    left = spark.createDataFrame([(1, D(n)) for n in (0, 5, 10, 200)] + [(2, D(5)), (None, D(5))], "code long, day date")
    right = spark.createDataFrame([(1, D(5), 1.0), (1, D(8), 2.0), (1, D(8), 3.0)], "code long, report date, v double")
    got = {(r.code, r.day): r.v for r in rel.as_of(left, right, "code", "day", "report", ["v"], limit_days=90).collect()}
    assert got == {(1, D(0)): None, (1, D(5)): 1.0, (1, D(10)): 2.0, (1, D(200)): None, (2, D(5)): None, (None, D(5)): None}


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, rel.insert_new(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, rel.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_factors_on_a_line(spark):
    """Closes of 10 + 0.1 i: momentum, drawdown-free returns, and nulls until a frame is full."""
    rows = [(7, D(i), 10 + 0.1 * i - 0.1, 10.2 + 0.1 * i, 9.8 + 0.1 * i, 10 + 0.1 * i, 1e7, 1e8, 1.0) for i in range(60)]
    bars = spark.createDataFrame(rows, "code long, trade_date date, open double, high double, low double, close double, volume double, amount double, turnover_rate double")
    out = fac.with_returns(bars).select("trade_date", fac.roc(20).alias("roc"), fac.cntp(5).alias("up"), fac.corr(20).alias("corr"), fac.rsi().alias("rsi"), fac.skew(3).alias("skew"), fac.momentum(21).alias("mom")).orderBy("trade_date").collect()
    assert out[18].roc is None and out[59].roc == pytest.approx(15.9 / 14.0 - 1) and out[59].up == 1.0
    assert out[59].corr is None and out[59].rsi == 100.0 and out[59].mom == pytest.approx(15.9 / 13.9 - 1)


def test_winsorize_and_neutralize(spark):
    rows = spark.createDataFrame([(1, i, float(v), "s") for i, v in enumerate([1, 2, 3, 4, 500])], "d int, code int, value double, sector string")
    got = [r.value for r in xs.winsorize_mad(rows, ["d"]).orderBy("code").collect()]
    assert got[:4] == [1, 2, 3, 4] and got[4] == pytest.approx(3 + 3 / 0.6745)
    assert sum(r.value for r in xs.pipeline(rows, ["d"]).collect()) == pytest.approx(0)
    assert [r.value for r in xs.winsorize_mad(rows.limit(3), ["d"]).collect()] == [r.value for r in rows.limit(3).collect()]


def test_quality_of_empty_tables(spark):
    none = spark.createDataFrame([], "a int, d date")
    assert not quality.completeness(none, ["a"]).first().passed and not quality.freshness(none, "d", F.lit("2020-01-01").cast("date")).first().passed
    assert tuple(quality.duplicates(none, ["a"]).first()) == (0, 0)


def test_rank_ic_of_identical_orders(spark):
    rows = spark.createDataFrame([(D(0), i, float(i), i * i / 1e4) for i in range(40)], "trade_date date, code int, value double, fwd double")
    assert validation.rank_ic(rows).first().ic == pytest.approx(1) and validation.spearman(rows).first().ic == pytest.approx(1)
    assert validation.ndcg(rows).first().ndcg == pytest.approx(1) and validation.monotonicity(validation.layered(rows)).first().share == 1


def test_distributions():
    assert eng.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4) and eng.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert eng.t_cdf(2.228, 10) == pytest.approx(0.975, abs=1e-4) and eng.t_cdf(-2.228, 10) == pytest.approx(0.025, abs=1e-4)
    assert eng.norm_ppf(np.array([0.99]))[0] == pytest.approx(2.3263, abs=1e-3)


def test_tail_fits_find_their_parameters():
    r = np.random.default_rng(3)
    xi, beta = 0.35, 1.2
    excess = beta / xi * ((1 - r.uniform(size=4000)) ** -xi - 1)
    x = -np.concatenate([r.uniform(-1, 0, 36_000), excess])
    got = eng.gpd_mle(x, 0.90)
    assert got["xi"] == pytest.approx(xi, abs=0.1) and got["beta"] == pytest.approx(beta, rel=0.15)
    u = r.uniform(size=60_000)
    gev = 2 + 0.5 / 0.2 * ((-np.log(u)) ** -0.2 - 1)
    assert eng.gev_pwm(-gev, block=1)["xi"] == pytest.approx(0.2, abs=0.05)


@pytest.mark.parametrize("family,theta,tau", [("clayton", 2.0, 0.5), ("frank", 5.0, 0.456), ("gaussian", 0.7, 0.494)])
def test_copulas(family, theta, tau):
    x = cop.simulate_copula(family, theta, 1500, seed=1)
    got = cop.copula(x[:, 0], x[:, 1])
    assert got["tau"] == pytest.approx(tau, abs=0.05)
    assert got["family"] == cop.FAMILIES.index(family)
    assert abs(x[:, 1].mean() - 0.5) < 0.03


def test_regimes_and_filters():
    r = np.random.default_rng(42)
    x = np.concatenate([r.normal(-0.02, 0.005, 150), r.normal(0.02, 0.005, 150)])
    got = eng.hmm(x, 2)
    assert got["regime"] == 1 and got["low_mean"] == pytest.approx(-0.02, abs=0.003)
    h = r.normal(size=(400, 2))
    w, v = eng.kalman(h, h @ np.array([0.8, -0.3]) + r.normal(0, 0.05, 400))
    assert w == pytest.approx([0.8, -0.3], abs=0.1) and (v > 0).all()
    g = eng.garch(r.normal(0, 0.01, 500))
    assert g["alpha"] + g["beta"] < 1 and g["forecast_vol"] == pytest.approx(0.01, rel=0.5)


def test_whole_simulations(spark):
    """Ten thousand paths to six horizons, a thousand resamples."""
    from alphaloom.plans import registry

    x = np.array([-0.9, 0.1, 0.2, 0.05])
    low = np.minimum.accumulate(np.cumprod(1 + 0.2 * np.random.default_rng(42).choice(x, (10_000, 252)), axis=1), axis=1) <= 0.5
    assert eng.ruin(x) == {f"ruin_{h}": float(low[:, h - 1].mean()) for h in (1, 5, 21, 63, 126, 252)}
    from alphaloom import plans
    from alphaloom.sources.adapters import Tables

    plans.load()
    small = "/root/testdata/sf0.001"
    triangle = Tables(spark, small).triangle.toPandas()
    parts = [eng.reserve_samples(triangle, (k + 1) * 1000 // 16 - k * 1000 // 16, 42 + k) for k in range(16)]
    x = np.concatenate(parts)
    assert len(x) == 1000
    want = {"mean": x.mean(), **{f"p{round(100 * q)}": np.quantile(x, q) for q in (0.5, 0.75, 0.95)}}
    got = registry.QUERIES["m32_reserve_bootstrap"](spark, small).first().asDict()
    assert got == pytest.approx(want, rel=1e-9)
    assert len(registry.QUERIES["m25_ruin_monte_carlo"](spark, small).columns) == 7


def test_portfolios():
    r = np.random.default_rng(5)
    x = r.normal(0.001, 0.01, (300, 6)) * np.array([1, 1, 1, 2, 2, 4])
    for w in (eng.hrp(x), eng.mean_variance(x.mean(0), eng.shrunk_covariance(x), cap=0.4)):
        assert w.sum() == pytest.approx(1) and (w >= -1e-9).all()
    assert eng.hrp(x)[5] < eng.hrp(x)[0]
    assert eng.capped_simplex(np.array([5.0, 0.0, 0.0]), 0.5) == pytest.approx([0.5, 0.25, 0.25])


def test_breaker_ignores_gains():
    b = eng.Breaker(losses=3, day=0.02, drawdown=0.5, cool=2)
    assert [b.update(p, 100.0, k) for k, p in enumerate([10, -0.1, -0.1, -0.1, 1, 1, 1])] == ["closed", "closed", "closed", "open", "open", "half_open", "closed"]


def test_graph_pieces(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1)], "src long, dst long")
    w = {(r.src, r.dst): r.weight for r in graph.normalized(e).collect()}
    assert len(w) == 6 and all(v == pytest.approx(0.5) for v in w.values())
    peers = graph.sampled_peers(spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "g string, code long"), "g", 20)
    assert peers.count() == 50 * 20 and peers.where("src = dst").count() == 0


def test_stream_matches_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randint(0, 3000)), i % 5, "ab"[i % 2], float(i), None) for i in range(300)]
    table = spark.createDataFrame(rows + rows[:50], st.SCHEMA)
    table.repartition(4).write.parquet(f"{tmp_path}/events")
    read = lambda: st.read_events(spark, f"{tmp_path}/events", files_per_trigger=1)
    once = st.run_to_table(st.without_duplicates(read(), ["event_id"], "365 days").select("event_id"), f"file://{tmp_path}/a", "append")
    assert once.count() == 300
    total = st.run_to_table(st.tumbling(read()), f"file://{tmp_path}/b", "complete").agg(F.sum("n")).first()[0]
    assert total == 350
    assert st.run_to_table(st.sessions(read()), f"file://{tmp_path}/c", "append").count() >= 0
    states = st.run_to_table(state.breakers(read(), late="365 days"), f"file://{tmp_path}/d", "append")
    assert states.count() == 350 and {x.state for x in states.select("state").distinct().collect()} <= {"open", "closed", "half_open"}
