"""Queries of the factor library over daily bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.functions.scalar import rounded
from alphaloom.operators import factors as fac
from alphaloom.operators.factor_engine import Engine, configured
from alphaloom.operators import relational as rel
from alphaloom.operators import sliding
from alphaloom.plans.registry import query, r

WS = [5, 20, 60]
_BASE = """SELECT b.*, m.mkt, CASE WHEN lag(close) OVER o > 0 THEN close / lag(close) OVER o - 1 END AS ret, close - lag(close) OVER o AS diff
 FROM bars b LEFT JOIN market m ON b.trade_date = m.trade_date WINDOW o AS (PARTITION BY code ORDER BY b.trade_date)"""


def base(t, market: bool = True):
    """Bars with their returns and, if wanted, the market's: that has a row for each trading date."""
    return fac.with_returns(t.bars.join(F.broadcast(t.market), "trade_date", "left") if market else t.bars)


def _mean(x, f):
    return f"(sum({x}) OVER {f} / count({x}) OVER {f})"


def _moment(k: int, f: str) -> str:
    """Central moment of ret over a frame, from raw moments."""
    m = [f"avg(power(ret, {i})) OVER {f}" for i in range(1, k + 1)]
    if k == 2:
        return f"({m[1]} - power({m[0]}, 2))"
    if k == 3:
        return f"({m[2]} - 3 * {m[0]} * {m[1]} + 2 * power({m[0]}, 3))"
    return f"({m[3]} - 4 * {m[0]} * {m[2]} + 6 * power({m[0]}, 2) * {m[1]} - 3 * power({m[0]}, 4))"


#: SQL of each family: a function of the window length and the frame, and the column that must fill the frame
SQL = {
    "roc": (lambda w, f: f"CASE WHEN lag(close, {w - 1}) OVER o = 0 THEN 0 ELSE close / lag(close, {w - 1}) OVER o - 1 END", "close"),
    "std": (lambda w, f: f"stddev_pop(ret) OVER {f}", "ret"),
    "corr": (lambda w, f: f"CASE WHEN stddev_pop(close) OVER {f} > 0 AND stddev_pop(volume) OVER {f} > 0 THEN corr(close, volume) OVER {f} END", "close"),
    "max": (lambda w, f: f"max(high) OVER {f} / close", "close"),
    "min": (lambda w, f: f"min(low) OVER {f} / close", "close"),
    "vma": (lambda w, f: f"volume / avg(volume) OVER {f}", "close"),
    "vstd": (lambda w, f: f"stddev_pop(volume) OVER {f} / avg(volume) OVER {f}", "close"),
    "cntp": (lambda w, f: f"avg(CASE WHEN diff > 0 THEN 1.0 ELSE 0.0 END) OVER {f}", "diff"),
    "beta": (lambda w, f: f"covar_samp(ret, mkt) OVER {f} / (var_pop(CASE WHEN mkt IS NOT NULL THEN mkt END) OVER {f} + 1e-12)", "ret"),
    "rsqr": (lambda w, f: f"CASE WHEN stddev_pop(ret) OVER {f} > 0 AND stddev_pop(mkt) OVER {f} > 0 THEN power(corr(ret, mkt) OVER {f}, 2) END", "ret"),
    "rank": (lambda w, f: f"len(list_filter(list(ret) OVER {f}, lambda x: x <= ret)) / {w}.0", "ret"),
    "skew": (lambda w, f: f"CASE WHEN stddev_pop(ret) OVER {f} > 0 THEN {_moment(3, f)} / power({_moment(2, f)}, 1.5) END", "ret"),
    "kurt": (lambda w, f: f"CASE WHEN stddev_pop(ret) OVER {f} > 0 THEN {_moment(4, f)} / power({_moment(2, f)}, 2) - 3 END", "ret"),
    "turn": (lambda w, f: f"CASE WHEN avg(turnover_rate) OVER {f} <> 0 THEN stddev_pop(turnover_rate) OVER {f} / avg(turnover_rate) OVER {f} END", "close"),
    "amp": (lambda w, f: f"avg((high - low) / (close + 1e-12)) OVER {f}", "close"),
    "hl_spread": (lambda w, f: f"avg((high - low) / (close + 1e-12)) OVER {f}", "close"),
    "vwap": (lambda w, f: f"(close - sum(amount) OVER {f} / sum(volume) OVER {f}) / (sum(amount) OVER {f} / sum(volume) OVER {f})", "close"),
    "oc": (lambda w, f: f"avg((close - open) / (open + 1e-12)) OVER {f}", "close"),
}


def _family(name: str, number: int) -> None:
    columns = ", ".join(f"CASE WHEN count({SQL[name][1]}) OVER f{w} >= {w} THEN {r(SQL[name][0](w, f'f{w}'))} END AS {name}_{w}" for w in WS)
    frames = ", ".join(f"f{w} AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in WS)

    @query(f"i{number:02d}_{name}", f"WITH b AS ({_BASE}) SELECT code, trade_date, {columns} FROM b WINDOW o AS (PARTITION BY code ORDER BY trade_date), {frames}")
    def _(t):
        out = fac.families(base(t, "mkt" in sliding.FAMILIES[name][1]), [name], WS)
        return out.select("code", "trade_date", *[rounded(F.col(f"{name}_{w}")).alias(f"{name}_{w}") for w in WS])


for _number, _name in enumerate(["roc", "std", "corr", "max", "min", "vma", "vstd", "cntp", "beta", "rsqr", "rank", "skew", "kurt", "turn", "amp", "hl_spread", "vwap", "oc"], 1):
    _family(_name, _number)


#: SQL of single factors, by the name that came first.
_SINGLE_SQL: dict[str, str] = {}


def _single(name: str, columns: dict, sql: dict[str, str], made: dict | None = None) -> None:
    """A query of some factors of the last 252 bars (f252) and shorter frames. made: the factors as matrices, where they
    are others than the library's of the same names."""
    frames = [5, 14, 20, 21, 42, 63, 252]
    named = ", ".join(f"f{w} AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in frames)
    parts = ", ".join(f"{r(x)} AS {k}" for k, x in sql.items())

    for k, x in sql.items():
        _SINGLE_SQL.setdefault(k, x)

    @query(name, f"WITH b AS ({_BASE}) SELECT code, trade_date, {parts} FROM b WINDOW o AS (PARTITION BY code ORDER BY trade_date), p20 AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), p21 AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 41 PRECEDING AND 21 PRECEDING), {named}")
    def _(t):
        own = made or {k: sliding.SINGLE[k] for k in columns if k in sliding.SINGLE}
        if len(own) == len(columns):
            out = sliding.with_factors(base(t, any("mkt" in c for _, c in own.values())), own)
            return out.select("code", "trade_date", *[rounded(F.col(k)).alias(k) for k in columns])
        return base(t, False).select("code", "trade_date", *[rounded(f()).alias(k) for k, f in columns.items()])


def _lagged(n: int, top: str = "close") -> str:
    return f"CASE WHEN lag(close, {n}) OVER o > 0 THEN {top} / lag(close, {n}) OVER o - 1 END"


_single("i26_momentum", {f"momentum_{k}": (lambda n=n: fac.momentum(n)) for k, n in (("1m", 21), ("3m", 63), ("6m", 126))}, {"momentum_1m": _lagged(20), "momentum_3m": _lagged(62), "momentum_6m": _lagged(125)})
_single("i27_momentum_12m1m", {"momentum_12m1m": fac.momentum_12m1m}, {"momentum_12m1m": _lagged(251, "lag(close, 21) OVER o")})
_single("i28_turnover_momentum", {"turnover_momentum": fac.turnover_momentum}, {"turnover_momentum": "CASE WHEN count(turnover_rate) OVER f42 >= 42 THEN (avg(turnover_rate) OVER f21 - avg(turnover_rate) OVER p21) / nullif(avg(turnover_rate) OVER p21, 0) END"})
_single("i34_historical_vol", {"historical_vol": fac.historical_vol}, {"historical_vol": "CASE WHEN count(ret) OVER f252 >= 20 THEN stddev_pop(ret) OVER f252 * sqrt(252.0) END"})
_single("i35_downside_vol", {"downside_vol": fac.downside_vol}, {"downside_vol": "CASE WHEN count(CASE WHEN ret < 0 THEN ret END) OVER f252 >= 10 THEN stddev_pop(CASE WHEN ret < 0 THEN ret END) OVER f252 * sqrt(252.0) END"})
_single("i36_market_beta", {"beta": fac.market_beta}, {"beta": "CASE WHEN count(ret) OVER f252 >= 60 THEN covar_pop(ret, mkt) OVER f252 / nullif(var_pop(mkt) OVER f252, 0) END"})
_single("i37_var_95", {"var_95": fac.var_95}, {"var_95": "CASE WHEN count(ret) OVER f252 >= 60 THEN abs(list_sort(list_filter(list(ret) OVER f252, lambda x: x IS NOT NULL))[floor(count(ret) OVER f252 * 0.05)::INTEGER + 1]) * sqrt(252.0) END"})
_single("i38_volume_ratio", {"volume_ratio": fac.volume_ratio}, {"volume_ratio": "CASE WHEN count(close) OVER f20 >= 20 THEN avg(volume) OVER f5 / avg(volume) OVER f20 END"})
_single("i39_money_flow", {"money_flow": fac.money_flow}, {"money_flow": "CASE WHEN count(close) OVER f5 >= 5 THEN sum((close - open) * volume / (open * amount)) OVER f5 END"})
_single("i40_turnover_anomaly", {"turnover_anomaly": fac.turnover_anomaly}, {"turnover_anomaly": "CASE WHEN count(turnover_rate) OVER p20 >= 20 THEN CASE WHEN stddev_pop(turnover_rate) OVER p20 < 1e-15 THEN 0 ELSE (turnover_rate - avg(turnover_rate) OVER p20) / stddev_pop(turnover_rate) OVER p20 END END"})
_single("i45_step_momentum", {f"momentum_{k}": (lambda n=n: fac.momentum(n)) for k, n in (("1m", 22), ("3m", 64), ("6m", 126))}, {"momentum_1m": _lagged(21), "momentum_3m": _lagged(63), "momentum_6m": _lagged(125)})
_single("i46_step_vol", {f"vol_{k}": (lambda w=w, n=n: F.when(F.count("ret").over(fac.frame(w)) >= n, F.stddev_pop("ret").over(fac.frame(w)))) for k, w, n in (("1m", 21, 15), ("3m", 63, 40))}, {"vol_1m": "CASE WHEN count(ret) OVER f21 >= 15 THEN stddev_pop(ret) OVER f21 END", "vol_3m": "CASE WHEN count(ret) OVER f63 >= 40 THEN stddev_pop(ret) OVER f63 END"})
_single("i47_turnover_1m", {"turnover_1m": lambda: F.when(F.count("turnover_rate").over(fac.frame(21)) >= 15, F.avg("turnover_rate").over(fac.frame(21)))}, {"turnover_1m": "CASE WHEN count(turnover_rate) OVER f21 >= 15 THEN avg(turnover_rate) OVER f21 END"})
_single("i48_volume_ratio_loose", {"volume_ratio": lambda: F.avg("volume").over(fac.frame(5)) / F.avg("volume").over(fac.frame(20))}, {"volume_ratio": "avg(volume) OVER f5 / avg(volume) OVER f20"}, {"volume_ratio": (sliding.mean_ratio, ["volume"])})
_single("i49_rsi", {"rsi_14": fac.rsi}, {"rsi_14": "CASE WHEN count(diff) OVER f14 >= 14 THEN CASE WHEN avg(greatest(-diff, 0)) OVER f14 = 0 THEN 100 ELSE 100 - 100 / (1 + avg(greatest(diff, 0)) OVER f14 / avg(greatest(-diff, 0)) OVER f14) END END"})
_single("i50_ma_gap", {"ma5_gap": fac.ma_gap}, {"ma5_gap": "CASE WHEN count(close) OVER f5 >= 5 THEN (close - avg(close) OVER f5) / (avg(close) OVER f5) END"})
def _full_sql(name: str, w: int, f: str) -> str:
    return f"CASE WHEN count({SQL[name][1]}) OVER {f} >= {w} THEN {SQL[name][0](w, f)} END"


def _crosses_sql() -> dict[str, str]:
    out = {}
    for a, b, op, windows in fac.CROSSES:
        for w in windows:
            x, y = (f"({_full_sql(n, w, f'f{w}')})" for n in (a, b))
            out[f"{a}_{b}_{w}"] = f"{x} * {y}" if op == "product" else f"{x} / nullif({y}, 0)"
    return out


def _frames_sql(windows) -> str:
    return ", ".join(f"f{w} AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in windows)


@query("i19_cross_factor", f"WITH b AS ({_BASE}) SELECT code, trade_date, {', '.join(f'{r(x)} AS {k}' for k, x in _crosses_sql().items())} FROM b WINDOW o AS (PARTITION BY code ORDER BY trade_date), {_frames_sql([10, 20, 60])}")
def _(t):
    out = fac.crossed(base(t))
    return out.select("code", "trade_date", *[rounded(F.col(k)).alias(k) for k in out.columns[2:]])


def _factory_sql() -> str:
    """Every factor over its frame at every bar, of which the last stays."""
    named = {f"{n}_{w}": _full_sql(n, w, f"f{w}") for names, windows in fac.FACTORY for n in names for w in windows} | _crosses_sql()
    wide = ", ".join(f"{r(x)} AS {k}" for k, x in named.items())
    windows = sorted({w for _, ws in fac.FACTORY for w in ws})
    return f"""WITH b AS ({_BASE}), late AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) <= {max(windows)}),
 wide AS (SELECT code, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k, {wide} FROM late WINDOW o AS (PARTITION BY code ORDER BY trade_date), {_frames_sql(windows)})
 SELECT code, factor, value FROM wide UNPIVOT (value FOR factor IN ({', '.join(named)})) WHERE k = 1"""


@query("i20_alpha_factory", _factory_sql())
def _(t):
    """The 140 factors of the factory for the last bar of each code, in long form."""
    return fac.to_long(fac.factory(t.bars, t.market)).select("code", "factor", rounded(F.col("value")).alias("value"))


_Q = "PARTITION BY code ORDER BY report_date"


_PASSED = ["pe", "pb", "fcf_yield", "roe", "roa", "gross_margin", "net_margin", "cashflow_to_revenue"]


def _passed(name: str, columns: list[str]) -> None:
    @query(name, f"SELECT code, report_date, {', '.join(columns)} FROM fundamentals")
    def _(t):
        return t.fundamentals.select("code", "report_date", *columns)


for _name, _columns in (("i21_pass_through", ["pe", "net_margin", "cashflow_to_revenue"]), ("i22_pb", ["pb"]), ("i24_fcf_yield", ["fcf_yield"]), ("i29_roe", ["roe"]), ("i30_roa", ["roa"]), ("i31_gross_margin", ["gross_margin"])):
    _passed(_name, _columns)


@query("i23_ps", f"SELECT f.code, f.report_date, {r('coalesce(CASE WHEN f.n_orders % 2 = 0 THEN 1.5 END, b.close / f.revenue)', 9)} AS ps FROM financials f ASOF LEFT JOIN bars b ON f.code = b.code AND f.report_date >= b.trade_date")
def _(t):
    f = rel.as_of(t.financials, t.bars, "code", "report_date", "trade_date", ["close"])
    given = F.when(F.col("n_orders") % 2 == 0, F.lit(1.5))
    return f.select("code", "report_date", rounded(F.coalesce(given, F.try_divide("close", "revenue")), 9).alias("ps"))


@query("i25_peg", f"WITH g AS (SELECT *, net_profit / lag(net_profit) OVER ({_Q}) - 1 AS growth FROM financials) SELECT code, report_date, CASE WHEN growth > 0 THEN {r('revenue / net_profit / growth', 2)} END AS peg FROM g")
def _(t):
    w = Window.partitionBy("code").orderBy("report_date")
    g = t.financials.withColumn("growth", F.col("net_profit") / F.lag("net_profit").over(w) - 1)
    return g.select("code", "report_date", F.when(F.col("growth") > 0, rounded(F.col("revenue") / F.col("net_profit") / F.col("growth"), 2)).alias("peg"))


@query("i41_sentiment_lookup", "SELECT b.code, b.trade_date, s.n_orders AS north_bound FROM (SELECT code, trade_date FROM monthly) b LEFT JOIN financials s ON b.code = s.code AND last_day(b.trade_date) = s.report_date")
def _(t):
    s = t.financials.select(F.col("code").alias("c"), "report_date", F.col("n_orders").alias("north_bound"))
    m = t.monthly.select("code", "trade_date")
    return m.join(s, (m["code"] == s["c"]) & (F.last_day("trade_date") == s["report_date"]), "left").select("code", "trade_date", "north_bound")


@query(
    "i42_report_changes",
    f"SELECT code, report_date, {r(f'(n_orders - lag(n_orders) OVER ({_Q})) / nullif(lag(n_orders) OVER ({_Q}), 0)')} AS analyst_coverage, n_orders - lag(n_orders) OVER ({_Q}) AS institutional_holding, coalesce({r(f'(n_orders - lag(n_orders) OVER ({_Q})) / nullif(lag(n_orders) OVER ({_Q}), 0)')}, n_orders)::DOUBLE AS shareholder_count FROM financials",
)
def _(t):
    before = F.lag("n_orders").over(Window.partitionBy("code").orderBy("report_date"))
    change = rounded(F.try_divide(F.col("n_orders") - before, before))
    return t.financials.select("code", "report_date", change.alias("analyst_coverage"), (F.col("n_orders") - before).alias("institutional_holding"), F.coalesce(change, F.col("n_orders").cast("double")).alias("shareholder_count"))


_ENGINE_SQL = f"""WITH b AS ({_BASE}) SELECT code, trade_date, {r("CASE WHEN count(close) OVER f5 >= 5 THEN close / lag(close, 4) OVER o - 1 END")} AS roc_5, {r(_lagged(20))} AS momentum_1m,
 {r("CASE WHEN count(close) OVER f5 >= 5 THEN (close - avg(close) OVER f5) / (avg(close) OVER f5) END")} AS ma5_gap FROM b WINDOW o AS (PARTITION BY code ORDER BY trade_date), {_frames_sql([5])}"""


@query("u03_factor_engine", f"SELECT code, trade_date, factor, value FROM ({_ENGINE_SQL}) UNPIVOT (value FOR factor IN (roc_5, momentum_1m, ma5_gap))")
def _(t):
    """The enabled factors of the registry over all bars, in long form."""
    engine = Engine.standard().enabled(["roc_5", "momentum_1m", "ma5_gap"])
    out = fac.to_long(engine.compute(base(t)))
    return out.select("code", "trade_date", "factor", rounded(F.col("value")).alias("value"))


_REPORTS = ["pe", "pb", "ps", "peg", "fcf_yield", "roe", "roa", "gross_margin", "net_margin", "cashflow_to_revenue", "north_bound", "analyst_coverage", "institutional_holding", "shareholder_count"]
_WINDOWED = [n for names in fac.CATEGORIES.values() for n in names if n not in _REPORTS]
_ALL_SQL = f"""WITH b AS ({_BASE}), v AS (SELECT code, trade_date, {', '.join(f'({_SINGLE_SQL[n]})::DOUBLE AS {n}' for n in _WINDOWED)} FROM b
 WINDOW o AS (PARTITION BY code ORDER BY trade_date), p20 AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), p21 AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 41 PRECEDING AND 21 PRECEDING), {_frames_sql([5, 14, 20, 21, 42, 63, 252])}),
p AS (SELECT f.code, f.report_date, CASE WHEN f.n_orders % 2 = 0 THEN 1.5 ELSE x.close / f.revenue END AS ps FROM financials f ASOF LEFT JOIN bars x ON f.code = x.code AND f.report_date >= x.trade_date),
g AS (SELECT code, report_date, revenue, net_profit, n_orders, net_profit / lag(net_profit) OVER ({_Q}) - 1 AS growth, lag(n_orders) OVER ({_Q}) AS past FROM financials),
q AS (SELECT f.*, p.ps, CASE WHEN growth > 0 THEN {r('g.revenue / g.net_profit / growth', 2)} END AS peg, g.n_orders AS north_bound, (g.n_orders - past) / nullif(past, 0) AS analyst_coverage, g.n_orders - past AS institutional_holding, coalesce((g.n_orders - past) / nullif(past, 0), g.n_orders) AS shareholder_count
 FROM fundamentals f JOIN p ON f.code = p.code AND f.report_date = p.report_date JOIN g ON f.code = g.code AND f.report_date = g.report_date),
j AS (SELECT v.*, {', '.join(f'q.{n}::DOUBLE AS {n}' for n in _REPORTS)} FROM v ASOF LEFT JOIN q ON v.code = q.code AND v.trade_date >= q.report_date)
SELECT code, factor, count(value) AS n, {r('avg(value)', 5)} AS mean FROM (SELECT * FROM j UNPIVOT (value FOR factor IN ({', '.join([*_WINDOWED, *_REPORTS])}))) GROUP BY 1, 2"""


@query("u03_all_factors", _ALL_SQL)
def _(t):
    """All 26 factors of the registry by one engine over all bars, those of reports as of each bar: how many values each
    code has of each, and their mean."""
    by = Window.partitionBy("code").orderBy("report_date")
    f = rel.as_of(t.financials, t.bars, "code", "report_date", "trade_date", ["close"])
    past, growth = F.lag("n_orders").over(by), F.col("net_profit") / F.lag("net_profit").over(by) - 1
    change = F.try_divide(F.col("n_orders") - past, past)
    more = {
        "ps": F.when(F.col("n_orders") % 2 == 0, F.lit(1.5)).otherwise(F.try_divide("close", "revenue")),
        "peg": F.when(growth > 0, rounded(F.col("revenue") / F.col("net_profit") / growth, 2)),
        "north_bound": F.col("n_orders"), "analyst_coverage": change, "institutional_holding": F.col("n_orders") - past, "shareholder_count": F.coalesce(change, F.col("n_orders").cast("double")),
    }
    reports = t.fundamentals.join(f.select("code", "report_date", *[c.cast("double").alias(k) for k, c in more.items()]), ["code", "report_date"])
    engine = Engine.standard().enabled([n for names in fac.CATEGORIES.values() for n in names])
    out = fac.to_long(engine.compute(rel.as_of(base(t), reports, "code", "trade_date", "report_date", _REPORTS)))
    assert not engine.failed and len(engine.factors) == 26
    return out.groupBy("code", "factor").agg(F.count("value").alias("n"), rounded(F.avg("value"), 5).alias("mean"))


@query("u01_factor_plug_in", f"WITH b AS ({_BASE}) SELECT code, trade_date, {r('CASE WHEN high > low THEN (close - low) / (high - low) END')} AS close_place, {r('CASE WHEN count(ret) OVER f5 >= 5 THEN sum(abs(ret)) OVER f5 END')} AS path FROM b WINDOW {_frames_sql([5])}")
def _(t):
    """Two factors that a user registers: an expression, and a vectorised function of a code's bars; one that cannot be
    computed is left out and counted."""
    engine = Engine()
    engine.register("close_place", lambda: F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))), "volume_price")
    engine.register("broken", lambda: F.col("no_such_column"), "value")
    engine.register_batch("path", lambda bars: bars["ret"].abs().rolling(5, min_periods=5).sum(), "volatility", direction=-1)
    out = engine.compute(base(t))
    assert engine.failed == {"broken": 1}
    return out.select("code", "trade_date", rounded(F.col("close_place")).alias("close_place"), rounded(F.col("path")).alias("path"))


@query("u02_factor_results", "SELECT factor, category, direction FROM (VALUES ('roc_5', '', 1), ('momentum_1m', 'momentum', 1), ('var_95', 'volatility', -1), ('roe', 'quality', 1)) v(factor, category, direction)")
def _(t):
    """What the registry says of some factors."""
    rows = [(f.name, f.category, f.direction) for f in Engine.standard().enabled(["roc_5", "momentum_1m", "var_95", "roe"]).factors.values()]
    return t.spark.createDataFrame(rows, "factor string, category string, direction int")


@query("b13_configured_columns", "SELECT code, report_date, pe, roe FROM fundamentals")
def _(t):
    """Columns chosen by a list of a configuration text, which may name environment variables."""
    names = configured("factors: {enabled: [pe, ${SECOND}, no_such]}", {"SECOND": "roe"}, "enabled")
    return t.fundamentals.select("code", "report_date", *[c for c in names if c in t.fundamentals.columns])


@query("i51_financial_extract", "SELECT code, factor, value FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY report_date DESC) AS k FROM financials) UNPIVOT (value FOR factor IN (revenue, net_profit, ocf)) WHERE k = 1")
def _(t):
    last = rel.top_per(t.financials, ["code"], [F.desc("report_date")], 1)
    return last.unpivot(["code"], ["revenue", "net_profit", "ocf"], "factor", "value")


_RATIOS = {"pe": "value", "pb": "value", "roe": "quality", "roa": "quality", "gross_margin": "quality", "net_margin": "quality", "cashflow_to_revenue": "quality", "fcf_yield": "value"}


@query("i52_category", f"SELECT category, factor, count(value) AS n FROM (SELECT * FROM fundamentals UNPIVOT INCLUDE NULLS (value FOR factor IN ({', '.join(_RATIOS)}))) JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _RATIOS.items())}) v(factor, category) USING (factor) GROUP BY 1, 2")
def _(t):
    """Report figures by factor, with the category that its name implies."""
    x = t.fundamentals.unpivot(["code", "report_date"], list(_RATIOS), "factor", "value")
    return x.groupBy(fac.category(F.col("factor")).alias("category"), "factor").agg(F.count("value").alias("n"))
