"""Queries of aggregations, windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.functions import scalar as sc
from alphaloom.functions.scalar import rounded
from alphaloom.operators import quality
from alphaloom.plans.registry import query, r


@query("d01_count", "SELECT count(*) AS n FROM lineitem")
def _(t):
    return t.read("lineitem").agg(F.count("*").alias("n"))


@query("d02_count_distinct", "SELECT count(DISTINCT cast(l_shipdate AS DATE)) AS n FROM lineitem")
def _(t):
    return t.read("lineitem").agg(F.countDistinct(F.to_date("l_shipdate")).alias("n"))


@query("d03_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t.read("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("d04_high_water", "SELECT l_suppkey AS code, min(cast(l_shipdate AS DATE)) AS first, max(cast(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1")
def _(t):
    d = F.to_date("l_shipdate")
    return t.read("lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.min(d).alias("first"), F.max(d).alias("last"))


_IC = f"SELECT sector, avg(ret) AS m, count(*) AS n FROM returns JOIN industry ON returns.code = industry.code WHERE ret IS NOT NULL GROUP BY 1 HAVING count(*) >= 10"


def _ic(t):
    return t.returns.join(t.industry, "code").where("ret IS NOT NULL").groupBy("sector").agg(F.avg("ret").alias("m"), F.count("*").alias("n")).where("n >= 10")


@query("d05_group_having", f"SELECT sector, n, sign(m)::INTEGER AS direction, {r('abs(m) / sum(abs(m)) OVER ()')} AS weight FROM ({_IC})")
def _(t):
    return _ic(t).select("sector", "n", F.signum("m").cast("int").alias("direction"), rounded(F.abs("m") / F.sum(F.abs("m")).over(Window.partitionBy(F.lit(1)))).alias("weight"))


@query("d06_top_abs_mean", f"SELECT sector, {r('m')} AS m FROM ({_IC}) ORDER BY abs(m) DESC, sector LIMIT 5")
def _(t):
    return _ic(t).orderBy(F.desc(F.abs("m")), "sector").limit(5).select("sector", rounded(F.col("m")).alias("m"))


@query("d07_multi_summary", f"SELECT count(*) AS n, {r('avg(o_totalprice)', 4)} AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def _(t):
    return t.read("orders").agg(F.count("*").alias("n"), rounded(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("d08_population_variance", f"SELECT code, {r('avg(close)')} AS m, {r('var_pop(close)', 3)} AS v FROM monthly GROUP BY 1")
def _(t):
    return t.monthly.groupBy("code").agg(rounded(F.avg("close")).alias("m"), rounded(F.var_pop("close"), 3).alias("v"))


@query("d09_sample_variance", f"SELECT code, {r('coalesce(var_samp(close), 0)', 3)} AS v FROM monthly GROUP BY 1")
def _(t):
    return t.monthly.groupBy("code").agg(rounded(F.coalesce(F.var_samp("close"), F.lit(0.0)), 3).alias("v"))


@query("d10_median", f"SELECT trade_date, {r('median(close)')} AS med FROM monthly GROUP BY 1")
def _(t):
    return t.monthly.groupBy("trade_date").agg(rounded(F.median("close")).alias("med"))


@query("d11_order_statistic", f"SELECT code, {r('abs(list_sort(list(ret))[floor(count(ret) * 0.05)::INTEGER + 1])')} AS var_95 FROM daily_returns GROUP BY 1")
def _(t):
    return t.daily_returns.groupBy("code").agg(rounded(F.abs(sc.order_statistic(F.col("ret"), 0.05))).alias("var_95"))


@query("d12_weighted_average", f"SELECT trade_date, {r('coalesce(sum(ret * close * volume) / nullif(sum(close * volume), 0), avg(ret))')} AS chg FROM returns WHERE ret IS NOT NULL GROUP BY 1")
def _(t):
    w = F.col("close") * F.col("volume")
    return t.returns.where("ret IS NOT NULL").groupBy("trade_date").agg(rounded(F.coalesce(F.try_divide(F.sum(F.col("ret") * w), F.sum(w)), F.avg("ret"))).alias("chg"))


@query("d13_completeness", f"""SELECT 'ret' AS "column", {r('avg((ret IS NULL)::INTEGER)')} AS missing, avg((ret IS NULL)::INTEGER) < 0.05 AS passed FROM returns UNION ALL SELECT 'close', {r('avg((close IS NULL)::INTEGER)')}, avg((close IS NULL)::INTEGER) < 0.05 FROM returns""")
def _(t):
    return quality.completeness(t.returns, ["ret", "close"]).withColumn("missing", rounded(F.col("missing")))


@query("d14_duplicate_keys", "SELECT count(*) AS n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated FROM lineitem")
def _(t):
    return quality.duplicates(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("d15_distribution", f"SELECT {r('avg(close) - 3 * stddev_samp(close)', 4)} AS low3, {r('avg(close) + 3 * stddev_samp(close)', 4)} AS high3, avg(close) - 3 * stddev_samp(close) >= 0.01 AND avg(close) + 3 * stddev_samp(close) <= 1e6 AS passed FROM monthly")
def _(t):
    out = quality.distribution(t.monthly, "close", *quality.BOUNDS["close"])
    return out.select(rounded(F.col("low3"), 4).alias("low3"), rounded(F.col("high3"), 4).alias("high3"), "passed")


@query("d16_freshness", "SELECT (DATE '2001-11-11' - max(trade_date) - 2)::BIGINT AS age, DATE '2001-11-11' - max(trade_date) - 2 <= 3 AS passed FROM bars")
def _(t):
    return quality.freshness(t.bars, "trade_date", F.lit("2001-11-11").cast("date"))


@query("d17_volume_anomaly", "SELECT trade_date, n, coalesce(n / avg(n) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.5, false) AS anomaly FROM (SELECT trade_date, count(*) AS n FROM bars GROUP BY 1)")
def _(t):
    return quality.volume_anomaly(t.bars, "trade_date")


@query("d18_quality_report", "SELECT (SELECT count(*) FROM monthly) AS n, (SELECT avg((close IS NULL)::INTEGER) < 0.05 FROM monthly) AS complete, (SELECT count(*) = count(DISTINCT (code, trade_date)) FROM monthly) AS single, (SELECT max(trade_date) >= DATE '2001-10-01' FROM monthly) AS fresh")
def _(t):
    m = t.monthly
    return (
        quality.completeness(m, ["close"]).select(F.col("passed").alias("complete"))
        .join(quality.duplicates(m, ["code", "trade_date"]).select("n", (F.col("repeated") == 0).alias("single")), how="cross")
        .join(m.agg((F.max("trade_date") >= F.lit("2001-10-01").cast("date")).alias("fresh")), how="cross")
    )


@query("d19_conditional_counts", f"SELECT trade_date, {r('avg(score)')} AS mean, {r('avg(CASE WHEN score > 0.1 THEN 1.0 ELSE 0.0 END)')} AS up, {r('avg(CASE WHEN score < -0.1 THEN 1.0 ELSE 0.0 END)')} AS down FROM sentiment WHERE mentions > 0 GROUP BY 1")
def _(t):
    share = lambda c: rounded(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return t.sentiment.where("mentions > 0").groupBy("trade_date").agg(rounded(F.avg("score")).alias("mean"), share(F.col("score") > 0.1).alias("up"), share(F.col("score") < -0.1).alias("down"))


@query("d20_sector_weights", f"SELECT sector, {r('sum(acctbal) / (SELECT sum(acctbal) FROM industry)')} AS weight, sum(acctbal) / (SELECT sum(acctbal) FROM industry) > 0.05 AS over FROM industry GROUP BY 1")
def _(t):
    s = t.industry.groupBy("sector").agg(F.sum("acctbal").alias("s"))
    w = F.col("s") / F.sum("s").over(Window.partitionBy(F.lit(1)))
    return s.select("sector", rounded(w).alias("weight"), (w > 0.05).alias("over"))


@query("d21_yearly_returns", f"SELECT code, year(trade_date)::INTEGER AS y, {r('sum(ret) * 100')} AS pct FROM daily_returns GROUP BY 1, 2 HAVING count(*) > 50")
def _(t):
    y = t.daily_returns.groupBy("code", F.year("trade_date").alias("y")).agg(F.sum("ret").alias("s"), F.count("*").alias("n"))
    return y.where("n > 50").select("code", "y", rounded(F.col("s") * 100).alias("pct"))


@query("d22_equity_summary", f"SELECT code, {r('1 - arg_max(close, trade_date) / max(close)')} AS drawdown, {r('arg_max(close, trade_date) / arg_min(close, trade_date) - 1')} AS total, {r('avg(ret) / stddev_samp(ret) * sqrt(12.0)')} AS sharpe FROM returns GROUP BY 1")
def _(t):
    last, first = F.max_by("close", "trade_date"), F.min_by("close", "trade_date")
    return t.returns.groupBy("code").agg(rounded(1 - last / F.max("close")).alias("drawdown"), rounded(last / first - 1).alias("total"), rounded(F.avg("ret") / F.stddev_samp("ret") * 12**0.5).alias("sharpe"))


@query("d23_feature_pivot", "SELECT code, coalesce(sum(n_orders) FILTER (year(report_date) = 1996), 0)::BIGINT AS y1996, coalesce(sum(n_orders) FILTER (year(report_date) = 1999), 0)::BIGINT AS y1999 FROM financials GROUP BY 1")
def _(t):
    named = t.financials.withColumn("y", F.concat(F.lit("y"), F.year("report_date").cast("string")))
    wide = named.groupBy("code").pivot("y", ["y1996", "y1999"]).agg(F.sum("n_orders"))
    return wide.fillna(0)


@query("d24_regroup", "SELECT trade_date, count(*) AS codes, sum(volume) AS volume FROM monthly GROUP BY 1")
def _(t):
    return t.monthly.groupBy("trade_date").agg(F.count("*").alias("codes"), F.sum("volume").alias("volume"))


_O = "PARTITION BY code ORDER BY trade_date"


def _w(a: int | None = None, b: int = 0):
    w = Window.partitionBy("code").orderBy("trade_date")
    return w if a is None else w.rowsBetween(a, b)


@query("e05_pct_change", f"SELECT code, trade_date, {r(f'CASE WHEN lag(close) OVER ({_O}) > 0 THEN close / lag(close) OVER ({_O}) - 1 END')} AS chg FROM bars")
def _(t):
    before = F.lag("close").over(_w())
    return t.bars.select("code", "trade_date", rounded(F.when(before > 0, F.col("close") / before - 1)).alias("chg"))


@query("e06_calendar_forward", f"""WITH d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM (SELECT DISTINCT trade_date FROM monthly)), m AS (SELECT code, close, k FROM monthly JOIN d ON monthly.trade_date = d.trade_date)
SELECT a.code, a.k, {r('b.close / a.close - 1')} AS fwd FROM m a LEFT JOIN m b ON a.code = b.code AND b.k = least(a.k + 5, (SELECT max(k) FROM d))""")
def _(t):
    d = t.monthly.select("trade_date").distinct()
    d = d.select("trade_date", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("trade_date")).cast("long").alias("k"))
    m = t.monthly.join(F.broadcast(d), "trade_date").select("code", "close", "k")
    top = d.agg(F.max("k").alias("top"))
    a = m.join(F.broadcast(top), how="cross").withColumn("to", F.least(F.col("k") + 5, F.col("top")))
    b = m.select(F.col("code").alias("c"), F.col("k").alias("kb"), F.col("close").alias("later"))
    return a.join(b, (a["code"] == b["c"]) & (a["to"] == b["kb"]), "left").select("code", "k", rounded(F.col("later") / F.col("close") - 1).alias("fwd"))


@query("e07_rolling_apply", f"SELECT code, trade_date, {r(f'CASE WHEN count(*) OVER ({_O} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10 THEN max(close) OVER ({_O} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - min(close) OVER ({_O} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END')} AS spread FROM bars")
def _(t):
    w = _w(-9)
    return t.bars.select("code", "trade_date", rounded(F.when(F.count("*").over(w) == 10, F.max("close").over(w) - F.min("close").over(w))).alias("spread"))


_F60 = f"({_O} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query("e08_rolling_var_forecast", f"SELECT code, trade_date, {r(f'CASE WHEN count(*) OVER {_F60} < 60 THEN 0.03 ELSE -(avg(ret) OVER {_F60} - 1.645 * CASE WHEN stddev_samp(ret) OVER {_F60} = 0 THEN 0.01 ELSE stddev_samp(ret) OVER {_F60} END) END')} AS var FROM daily_returns")
def _(t):
    w = _w(-59)
    s = F.stddev_samp("ret").over(w)
    return t.daily_returns.select("code", "trade_date", rounded(F.when(F.count("*").over(w) < 60, 0.03).otherwise(-(F.avg("ret").over(w) - 1.645 * F.when(s == 0, 0.01).otherwise(s)))).alias("var"))


_P20 = f"({_O} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(
    "e09_rolling_var_cvar",
    f"""WITH x AS (SELECT code, trade_date, avg(ret) OVER {_P20} - 1.645 * stddev_samp(ret) OVER {_P20} AS v, list(ret) OVER {_P20} AS l, count(*) OVER {_P20} AS n FROM daily_returns)
SELECT code, trade_date, {r('v')} AS var, {r('list_avg(list_filter(l, lambda q: q <= v))')} AS cvar FROM x WHERE n = 20""",
)
def _(t):
    w = _w(-20, -1)
    x = t.daily_returns.select("code", "trade_date", (F.avg("ret").over(w) - 1.645 * F.stddev_samp("ret").over(w)).alias("v"), F.collect_list("ret").over(w).alias("l"))
    low = F.filter("l", lambda q: q <= F.col("v"))
    mean = F.try_divide(F.aggregate(low, F.lit(0.0), lambda a, b: a + b), F.size(low))
    return x.where(F.size("l") == 20).select("code", "trade_date", rounded(F.col("v")).alias("var"), rounded(mean).alias("cvar"))


@query("e10_rolling_sharpe", f"SELECT code, trade_date, {r(f'CASE WHEN count(*) OVER {_F60} = 60 THEN avg(ret) OVER {_F60} / nullif(stddev_samp(ret) OVER {_F60}, 0) * sqrt(252.0) END')} AS sharpe FROM daily_returns")
def _(t):
    w = _w(-59)
    return t.daily_returns.select("code", "trade_date", rounded(F.when(F.count("*").over(w) == 60, F.try_divide(F.avg("ret").over(w), F.stddev_samp("ret").over(w)) * 252**0.5)).alias("sharpe"))


@query("e11_rolling_stability", f"SELECT code, {r('avg(m)')} AS mean, {r('stddev_pop(m)')} AS sd, {r('max(m)')} AS high, {r('min(m)')} AS low FROM (SELECT code, avg(ret) OVER {_F60} AS m, count(*) OVER {_F60} AS n FROM daily_returns) WHERE n = 60 GROUP BY 1")
def _(t):
    w = _w(-59)
    x = t.daily_returns.select("code", F.avg("ret").over(w).alias("m"), F.count("*").over(w).alias("n")).where("n = 60")
    return x.groupBy("code").agg(*[rounded(f("m")).alias(k) for k, f in (("mean", F.avg), ("sd", F.stddev_pop), ("high", F.max), ("low", F.min))])


@query("e12_regime_label", f"SELECT trade_date, CASE WHEN s > 0.1 THEN 'bull' WHEN s < -0.1 THEN 'bear' ELSE 'sideways' END AS regime FROM (SELECT trade_date, sum(mkt) OVER (ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS s FROM market)")
def _(t):
    s = F.sum("mkt").over(Window.partitionBy(F.lit(1)).orderBy("trade_date").rowsBetween(-60, -1))
    return t.market.select("trade_date", F.when(s > 0.1, "bull").when(s < -0.1, "bear").otherwise("sideways").alias("regime"))


@query("e13_max_drawdown", f"SELECT code, {r('max(1 - close / peak)')} AS drawdown FROM (SELECT code, close, max(close) OVER ({_O}) AS peak FROM bars) GROUP BY 1")
def _(t):
    peak = F.max("close").over(_w(Window.unboundedPreceding))
    return t.bars.select("code", (1 - F.col("close") / peak).alias("d")).groupBy("code").agg(rounded(F.max("d")).alias("drawdown"))


@query("e14_price_adjustment", f"WITH f AS (SELECT code, trade_date, close, CASE WHEN code % 2 = 0 AND month(trade_date) = 6 THEN 0.95 ELSE 1.0 END AS f FROM monthly) SELECT code, trade_date, {r(f'close * exp(sum(ln(f)) OVER (PARTITION BY code ORDER BY trade_date DESC))')} AS backward, {r(f'close / exp(sum(ln(f)) OVER ({_O}))')} AS forward FROM f")
def _(t):
    f = t.monthly.withColumn("f", F.when((F.col("code") % 2 == 0) & (F.month("trade_date") == 6), 0.95).otherwise(1.0))
    back = Window.partitionBy("code").orderBy(F.desc("trade_date")).rowsBetween(Window.unboundedPreceding, 0)
    usable = F.when(F.col("f") > 0, F.col("f"))
    return f.select("code", "trade_date", rounded(F.col("close") * F.product(usable).over(back)).alias("backward"), rounded(F.col("close") / F.product(usable).over(_w(Window.unboundedPreceding))).alias("forward"))


@query("e16_loss_streak", f"SELECT code, trade_date, sum((ret < 0)::INTEGER) OVER (PARTITION BY code, g ORDER BY trade_date)::BIGINT AS streak FROM (SELECT *, sum((ret >= 0)::INTEGER) OVER ({_O}) AS g FROM daily_returns)")
def _(t):
    g = t.daily_returns.withColumn("g", F.sum((F.col("ret") >= 0).cast("int")).over(_w(Window.unboundedPreceding)))
    w = Window.partitionBy("code", "g").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("code", "trade_date", F.sum((F.col("ret") < 0).cast("int")).over(w).alias("streak"))


@query(
    "e17_traffic_light",
    f"""WITH v AS (SELECT code, trade_date, row_number() OVER ({_O}) - 1 AS k, (ret < -0.3)::INTEGER AS hit FROM daily_returns), s AS (SELECT code, k, sum(hit) OVER (PARTITION BY code ORDER BY k ROWS BETWEEN CURRENT ROW AND 249 FOLLOWING) AS x, count(*) OVER (PARTITION BY code ORDER BY k ROWS BETWEEN CURRENT ROW AND 249 FOLLOWING) AS n FROM v)
SELECT code, k, x::BIGINT AS violations, CASE WHEN x <= 4 THEN 'green' WHEN x <= 9 THEN 'yellow' ELSE 'red' END AS zone FROM s WHERE k % 50 = 0 AND n = 250""",
)
def _(t):
    v = t.daily_returns.select("code", (F.row_number().over(_w()) - 1).cast("long").alias("k"), (F.col("ret") < -0.3).cast("int").alias("hit"))
    w = Window.partitionBy("code").orderBy("k").rowsBetween(0, 249)
    s = v.withColumns({"violations": F.sum("hit").over(w), "n": F.count("*").over(w)}).where("k % 50 = 0 AND n = 250")
    return s.select("code", "k", "violations", F.when(F.col("violations") <= 4, "green").when(F.col("violations") <= 9, "yellow").otherwise("red").alias("zone"))


@query("e19_transitions", f"SELECT code, sum((b = 0 AND a = 0)::INTEGER)::BIGINT AS n00, sum((b = 0 AND a = 1)::INTEGER)::BIGINT AS n01, sum((b = 1 AND a = 0)::INTEGER)::BIGINT AS n10, sum((b = 1 AND a = 1)::INTEGER)::BIGINT AS n11 FROM (SELECT code, a, lag(a) OVER ({_O}) AS b FROM (SELECT code, trade_date, (ret < 0)::INTEGER AS a FROM daily_returns)) WHERE b IS NOT NULL GROUP BY 1")
def _(t):
    a = t.daily_returns.select("code", "trade_date", (F.col("ret") < 0).cast("int").alias("a")).withColumn("b", F.lag("a").over(_w())).where("b IS NOT NULL")
    n = lambda x, y: F.sum(((F.col("b") == x) & (F.col("a") == y)).cast("int")).alias(f"n{x}{y}")
    return a.groupBy("code").agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1))


@query("h01_safe_divide", f"SELECT event_id, {r('coalesce(value / nullif(user_id % 3, 0), 0)')} AS q, {r('coalesce((value - user_id % 5) / nullif(user_id % 5, 0), 0)')} AS c FROM events")
def _(t):
    e = t.read("events")
    return e.select("event_id", rounded(sc.safe_divide(F.col("value"), F.col("user_id") % 3)).alias("q"), rounded(sc.safe_pct_change((F.col("user_id") % 5).cast("double"), F.col("value"))).alias("c"))


@query("h03_half_even", "SELECT event_id, (round_even(event_id / 8.0, 2) + 0.0)::DOUBLE AS x FROM events")
def _(t):
    return t.read("events").select("event_id", (sc.half_even(F.col("event_id") / F.lit(8.0), 2) + 0.0).alias("x"))


@query("h04_math", f"SELECT event_id, {r('sqrt(abs(value))')} AS a, {r('ln(1 + abs(value))')} AS b, {r('exp(-abs(value) / 100)')} AS c, {r('power(abs(value), 0.6)')} AS d FROM events")
def _(t):
    v = F.abs("value")
    return t.read("events").select("event_id", rounded(F.sqrt(v)).alias("a"), rounded(F.log1p(v)).alias("b"), rounded(F.exp(-v / 100)).alias("c"), rounded(F.pow(v, F.lit(0.6))).alias("d"))


@query("h05_normal_cdf", f"SELECT vec_id, {r(sc.norm_cdf_sql('(embedding[1] * 10)::DOUBLE'))} AS p, {r('2 * ' + sc.norm_cdf_sql('(embedding[2] * sqrt(2.0))::DOUBLE') + ' - 1')} AS e FROM embeddings")
def _(t):
    x = F.col("embedding")
    return t.read("embeddings").select("vec_id", rounded(sc.norm_cdf((x[0] * F.lit(10.0).cast("float")).cast("double"))).alias("p"), rounded(sc.erf(x[1].cast("double"))).alias("e"))


@query("h12_ols", f"SELECT code, {r('regr_slope(ret, mkt)')} AS slope, {r('regr_intercept(ret, mkt)')} AS intercept, {r('regr_r2(ret, mkt)')} AS r2 FROM daily_returns JOIN market ON daily_returns.trade_date = market.trade_date GROUP BY 1")
def _(t):
    j = t.daily_returns.join(t.market, "trade_date")
    return j.groupBy("code").agg(rounded(F.regr_slope("ret", "mkt")).alias("slope"), rounded(F.regr_intercept("ret", "mkt")).alias("intercept"), rounded(F.regr_r2("ret", "mkt")).alias("r2"))


@query("h14_market_code", "SELECT code, lpad(code::VARCHAR, 6, '0') || '.' || CASE left(lpad(code::VARCHAR, 6, '0'), 1) WHEN '0' THEN 'SZ' WHEN '3' THEN 'SZ' WHEN '6' THEN 'SH' WHEN '4' THEN 'BJ' WHEN '8' THEN 'BJ' ELSE 'SZ' END AS ts_code FROM (SELECT p_partkey * 7919 % 900000 AS code FROM part)")
def _(t):
    return t.read("part").select((F.col("p_partkey") * 7919 % 900000).alias("code")).select("code", sc.market_code(F.col("code")).alias("ts_code"))


@query("h15_normal_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE cast(o_orderdate AS DATE) END AS d FROM orders")
def _(t):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(d, "yyyyMMdd")).when(k == 1, F.date_format(d, "yyyy/MM/dd")).when(k == 2, d.cast("string")).otherwise("n/a")
    return t.read("orders").select("o_orderkey", sc.normal_date(raw).alias("d"))


@query("h16_days_between", "SELECT o_orderkey, coalesce(abs(cast(o_orderdate AS DATE) - CASE WHEN o_orderkey % 2 = 0 THEN DATE '1998-01-01' END), 999)::INTEGER AS days FROM orders")
def _(t):
    other = F.when(F.col("o_orderkey") % 2 == 0, F.lit("1998-01-01").cast("date"))
    return t.read("orders").select("o_orderkey", sc.days_between(F.to_date("o_orderdate"), other).alias("days"))


_H17 = "SELECT code, cast(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT code, min(trade_date) AS first, max(trade_date) AS last FROM bars GROUP BY 1)"


@query("h17_date_sequence", _H17)
def _(t):
    """Every day from the first bar of a code to its last."""
    e = t.bars.groupBy("code").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("z"))
    return e.select("code", F.explode(F.sequence("a", "z")).alias("d"))


@query("h18_report_label", "SELECT code, report_date, CASE month(report_date) WHEN 3 THEN 'Q1' WHEN 6 THEN 'Q2' WHEN 9 THEN 'Q3' ELSE 'Q4' END AS q FROM financials")
def _(t):
    return t.financials.select("code", "report_date", sc.report_label(F.col("report_date")).alias("q"))


@query("h19_ratios", "SELECT code, report_date, (round_even(net_profit / revenue * 100, 2) + 0.0)::DOUBLE AS margin FROM financials")
def _(t):
    return t.financials.select("code", "report_date", (sc.ratio_percent(F.col("net_profit"), F.col("revenue")) + 0.0).alias("margin"))


@query("h20_nearly_equal", "SELECT code, trade_date, abs(high - low) < 1e-6 AS flat FROM bars")
def _(t):
    return t.bars.select("code", "trade_date", sc.nearly(F.col("high"), F.col("low")).alias("flat"))


@query("h21_to_float", "SELECT conv_id, turn, coalesce(try_cast(CASE WHEN turn % 2 = 0 THEN conv_id::VARCHAR ELSE 'x' END AS DOUBLE), 0) AS v FROM conversations")
def _(t):
    return t.read("conversations").select("conv_id", "turn", sc.to_float(F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string")).otherwise("x")).alias("v"))


_RULES = [("license", "legal"), ("@", "contact"), ("der |die ", "german"), ("the ", "english")]


@query("h22_keyword_class", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for p, n in _RULES) + " ELSE 'other' END AS label FROM documents")
def _(t):
    return t.read("documents").select("doc_id", sc.keyword_class(F.col("text"), _RULES).alias("label"))


@query("h24_label", "SELECT code, trade_date, CASE WHEN score > 0.3 THEN 'strong_positive' WHEN score > 0.1 THEN 'positive' WHEN score < -0.3 THEN 'strong_negative' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM sentiment")
def _(t):
    return t.sentiment.select("code", "trade_date", sc.label(F.col("score")).alias("label"))


@query("h25_embedded_json", "SELECT event_id, json_extract_string(props, '$.k')::VARCHAR AS k FROM events WHERE props IS NOT NULL")
def _(t):
    e = t.read("events").where("props IS NOT NULL")
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("so "), "props", F.lit(" there")))
    return e.select("event_id", F.get_json_object(sc.embedded_json(raw), "$.k").alias("k"))


@query("h29_number_formats", "SELECT o_orderkey, CASE WHEN o_totalprice >= 1e4 THEN printf('%.2f', round_even(o_totalprice / 1e4, 2)) || '万' ELSE printf('%.2f', round_even(o_totalprice, 2)) END AS amount FROM orders")
def _(t):
    return t.read("orders").select("o_orderkey", sc.short_amount(F.col("o_totalprice")).alias("amount"))
