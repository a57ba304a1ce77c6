"""Queries of backtests by period, brokerage, portfolio checks, scenarios, scores and texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.functions.scalar import norm_cdf_sql, rounded
from alphaloom.operators import trading as tr
from alphaloom.operators import validation as val
from alphaloom.plans.registry import query, r
from alphaloom.plans.risk import _M, monthly, shown
from alphaloom.plans.validation import _LAYERS, _all_ics, _ic, _pairs, all_ics, pairs

_TOP = f"p AS ({_pairs()}), q AS (SELECT trade_date, round(avg(fwd), 9) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY value DESC, code) AS k FROM p) WHERE k <= 10 GROUP BY 1)"


def _periods(t):
    return tr.period_returns(pairs(t), ["trade_date"], 10).select("trade_date", F.round("ret", 9).alias("ret"))


@query("o02_db_backtest", f"WITH {_TOP} SELECT trade_date, {r('exp(sum(ln(1 + ret)) OVER (ORDER BY trade_date))')} AS equity FROM q")
def _(t):
    """Full liquidation each month, equal cash in the ten best, no costs."""
    return shown(tr.equity(_periods(t)).select("trade_date", "equity"), "equity")


_NET = f"{_TOP}, n AS (SELECT trade_date, (1 + ret) * 0.999 / 1.001 - 1 AS net FROM q), e AS (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY trade_date)) AS equity FROM n), d AS (SELECT *, 1 - equity / greatest(max(equity) OVER (ORDER BY trade_date), 1) AS fall FROM e)"


@query("o03_costed_backtest", f"WITH {_NET} SELECT {r('max_by(equity, trade_date) - 1')} AS total, {r('power(max_by(equity, trade_date), 12.0 / count(*)) - 1')} AS annual, {r('(12 * avg(net) - 0.025) / (stddev_pop(net) * sqrt(12.0))')} AS sharpe, {r('max(fall)')} AS drawdown FROM d")
def _(t):
    return shown(tr.summary(tr.equity(_periods(t), cost=0.001)), "total", "annual", "sharpe", "drawdown")


@query(
    "o04_risk_scaled_backtest",
    f"""WITH RECURSIVE {_TOP}, k AS (SELECT *, row_number() OVER (ORDER BY trade_date) AS k FROM q), w AS (SELECT 0::BIGINT AS k, NULL::DATE AS trade_date, 1.0::DOUBLE AS scale, 1.0::DOUBLE AS equity, 1.0::DOUBLE AS peak
 UNION ALL SELECT k, trade_date, scale, e, greatest(peak, e) FROM (SELECT k.k, k.trade_date, s AS scale, equity * (1 + s * ret) AS e, peak FROM (SELECT *, CASE WHEN 1 - equity / peak >= 0.20 THEN 0.25 WHEN 1 - equity / peak >= 0.15 THEN 0.50 WHEN 1 - equity / peak >= 0.10 THEN 0.75 ELSE 1.0 END::DOUBLE AS s FROM w) w JOIN k ON k.k = w.k + 1))
SELECT trade_date, scale, {r('equity')} AS equity FROM w WHERE k > 0""",
)
def _(t):
    return shown(tr.risk_scaled(_periods(t)), "equity")


_GRID = [(a / 5, b / 5, (5 - a - b) / 5) for a in range(6) for b in range(6 - a)]
_THREE = " UNION ALL ".join(f"SELECT trade_date, code, 'm{n}' AS f, value, fwd FROM ({_pairs(n)})" for n in (1, 3, 6))


@query(
    "n12_fusion_weights",
    f"""WITH v AS ({_THREE}), s AS (SELECT trade_date, code, max(fwd) AS fwd, max(value) FILTER (f = 'm1') AS a, max(value) FILTER (f = 'm3') AS b, max(value) FILTER (f = 'm6') AS c FROM v GROUP BY 1, 2 HAVING count(*) = 3), g(fw, gw, aw) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)' for a, b, c in _GRID)}),
x AS (SELECT fw, gw, aw, trade_date, avg(fwd) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY fw, gw, aw, trade_date ORDER BY round(fw * a + gw * b + aw * c, 9) DESC, code) AS k FROM s, g) WHERE k <= 10 GROUP BY ALL)
SELECT fw, gw, aw, {r('exp(sum(ln(1 + ret))) - 1')} AS total FROM x GROUP BY 1, 2, 3""",
)
def _(t):
    """A backtest for each mixture of three momenta."""
    s = None
    for n, c in ((1, "a"), (3, "b"), (6, "c")):
        one = pairs(t, n).select("trade_date", "code", F.col("value").alias(c), *(["fwd"] if n == 1 else []))
        s = one if s is None else s.join(one, ["trade_date", "code"])
    g = t.spark.createDataFrame(_GRID, "fw double, gw double, aw double")
    x = s.join(F.broadcast(g), F.lit(True)).withColumn("value", F.round(F.col("fw") * F.col("a") + F.col("gw") * F.col("b") + F.col("aw") * F.col("c"), 9))
    p = tr.period_returns(x, ["fw", "gw", "aw", "trade_date"], 10)
    return p.groupBy("fw", "gw", "aw").agg(rounded(F.exp(F.sum(F.log1p("ret"))) - 1).alias("total"))


@query("p02_broker", None)
def _(t):
    """Two orders of each code on each of its dates: a purchase, and a sale of twice as much on every other date."""
    day = F.dayofyear("trade_date")
    b = t.bars.select("code", "trade_date", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.col("close").alias("price"), day.alias("d"))
    o = b.where("seq = 1 OR d % 2 = 0").select("code", "trade_date", "seq", F.when(F.col("seq") == 1, "BUY").otherwise("SELL").alias("side"), (F.col("seq") * 100).cast("long").alias("quantity"), "price")
    return shown(tr.broker(o), "fill_price", "commission")


@query("p16_daily_var_records", f"WITH w AS (SELECT code, trade_date, ret, list_sort(list(ret) OVER f) AS l FROM daily_returns WINDOW f AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT code, trade_date, {r('abs(l[2])')} AS var_95, {r('-ret')} AS loss, -ret > abs(l[2]) AS violation FROM w WHERE len(l) = 20")
def _(t):
    """The historical value at risk of the twenty returns before, beside the day's loss."""
    w = Window.partitionBy("code").orderBy("trade_date").rowsBetween(-20, -1)
    x = t.daily_returns.withColumn("l", F.sort_array(F.collect_list("ret").over(w))).where(F.size("l") == 20)
    var = F.abs(F.col("l")[1])
    return x.select("code", "trade_date", rounded(var).alias("var_95"), rounded(-F.col("ret")).alias("loss"), (-F.col("ret") > var).alias("violation"))


@query(
    "p13_risk_manager",
    f"""WITH {_M}, g AS (SELECT region, trade_date, avg(ret) AS ret FROM m JOIN industry ON m.code = industry.code GROUP BY 1, 2), e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY region ORDER BY trade_date)) AS q FROM g), b AS (SELECT region, max(1 - q / greatest(peak, 1)) > 0.30 AS blocked FROM (SELECT *, max(q) OVER (PARTITION BY region ORDER BY trade_date) AS peak FROM e) GROUP BY 1),
v AS (SELECT region, 1000000 * abs(list_sort(list(ret))[floor(count(*) * 0.05)::INTEGER + 1]) AS var_amount FROM g GROUP BY 1), p AS (SELECT region, NOT bool_or(w > 0.10) AS ok FROM (SELECT region, greatest(acctbal, 0) / sum(greatest(acctbal, 0)) OVER (PARTITION BY region) AS w FROM industry) GROUP BY 1),
s AS (SELECT b.region, blocked, ok, CASE WHEN blocked THEN 5 WHEN NOT ok THEN 3 WHEN var_amount > 50000 THEN 2 ELSE 1 END AS risk_score FROM b JOIN v ON b.region = v.region JOIN p ON b.region = p.region)
SELECT region, risk_score, CASE risk_score WHEN 5 THEN 'CRITICAL' WHEN 3 THEN 'ELEVATED' WHEN 2 THEN 'GUARDED' ELSE 'LOW' END AS risk_level, NOT blocked AND ok AS passed, CASE WHEN blocked THEN 'no trading' WHEN NOT ok THEN 'adjust positions' ELSE 'trade' END AS advice FROM s""",
)
def _(t):
    """A portfolio in each region: blocked after a drawdown of three tenths, positions of a tenth at most, and value at risk."""
    w, one = Window.partitionBy("region").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("region")
    g = monthly(t).join(t.industry.select("code", "region"), "code").groupBy("region", "trade_date").agg(F.avg("ret").alias("ret"))
    e = g.withColumn("q", F.exp(F.sum(F.log1p("ret")).over(w))).withColumn("fall", 1 - F.col("q") / F.greatest(F.max("q").over(w), F.lit(1.0)))
    x = e.groupBy("region").agg((F.max("fall") > 0.30).alias("blocked"), F.sort_array(F.collect_list("ret")).alias("l"))
    held = F.greatest("acctbal", F.lit(0.0))
    p = t.industry.select("region", (held / F.sum(held).over(one)).alias("w")).groupBy("region").agg((~F.bool_or(F.col("w") > 0.10)).alias("ok"))
    j = x.join(p, "region").withColumn("var_amount", 1_000_000 * F.abs(F.get("l", F.floor(F.size("l") * 0.05).cast("int"))))
    return j.select("region", *[c.alias(k) for k, c in tr.risk_check(F.col("blocked"), F.col("ok"), F.col("var_amount"), F.lit(1_000_000.0), F.lit(True)).items()])


_WORDS = [(w, 1) for w in tr.POSITIVE] + [(w, -1) for w in tr.NEGATIVE]
#: Between the words of a headline: longer than a negation reaches.
_FILLER = "公司今日发布公告："
#: Places of a headline: the multiplier that picks its word, and the divisor that picks whether it is negated.
_PLACES = [(7, 3), (11, 5), (13, 7)]


@query(
    "r05_stock_sentiment",
    f"""WITH w(i, sign) AS (VALUES {', '.join(f'({i}, {sign})' for i, (_, sign) in enumerate(_WORDS))}), p(k, m, d) AS (VALUES {', '.join(f'({k}, {m}, {d})' for k, (m, d) in enumerate(_PLACES))}),
x AS (SELECT event_id, user_id, CASE WHEN event_id // d % 4 = 0 THEN -sign ELSE sign END AS sign FROM events, p JOIN w ON i = (event_id * m + k) % {len(_WORDS)}), e AS (SELECT event_id, user_id, sign(sum(sign)) AS s FROM x GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (s > 0) AS positive, count(*) FILTER (s < 0) AS negative, count(*) FILTER (s = 0) AS neutral, (round_even(sum(s) / count(*)::DOUBLE, 2) + 0.0)::DOUBLE AS score FROM e GROUP BY 1""",
)
def _(t):
    """A headline for each event, of three words of the lexicon by its id, some behind a negation: the lexicon reads the
    texts, the SQL the words' signs."""
    words, negations = F.array(*[F.lit(w) for w, _ in _WORDS]), F.array(*[F.lit(w) for w in tr.NEGATIONS])
    e = F.col("event_id")
    parts = [F.lit(_FILLER)]
    for k, (m, d) in enumerate(_PLACES):
        no = F.when(F.floor(e / d) % 4 == 0, F.get(negations, ((e + k) % len(tr.NEGATIONS)).cast("int"))).otherwise("")
        parts += [no, F.get(words, ((e * m + k) % len(_WORDS)).cast("int")), F.lit(_FILLER)]
    return tr.sentiment(t.read("events").select("user_id", F.concat(*parts).alias("title")), "user_id", "title")


_AGENTS = {"view": ("macro", 0.25), "click": ("sector", 0.25), "purchase": ("stock", 0.30), "signup": ("sentiment", 0.20)}


@query(
    "r07_composite_agents",
    f"""WITH w(event_type, weight) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, (_, v) in _AGENTS.items())}), s AS (SELECT user_id, event_type, avg(greatest(least((value - 50) / 50, 1), -1)) AS signal FROM events GROUP BY 1, 2), c AS (SELECT user_id, round(sum(signal * weight) / sum(weight), 9) AS c FROM s JOIN w ON s.event_type = w.event_type GROUP BY 1)
SELECT user_id, {r('c', 3)} AS composite, CASE WHEN c > 0.3 THEN 'strongly positive' WHEN c > 0.1 THEN 'positive' WHEN c > -0.1 THEN 'neutral' WHEN c > -0.3 THEN 'negative' ELSE 'strongly negative' END AS label FROM c""",
)
def _(t):
    """Signals of four agents, weighted and normalised over those that are done; an event type stands for an agent."""
    w = t.spark.createDataFrame([(k, a, x) for k, (a, x) in _AGENTS.items()], "event_type string, agent string, weight double")
    s = t.read("events").groupBy("user_id", "event_type").agg(F.avg(F.greatest(F.least((F.col("value") - 50) / 50, F.lit(1.0)), F.lit(-1.0))).alias("signal")).join(F.broadcast(w), "event_type")
    c = s.groupBy("user_id").agg(F.round(F.sum(F.col("signal") * F.col("weight")) / F.sum("weight"), 9).alias("c"))
    label = F.when(F.col("c") > 0.3, "strongly positive").when(F.col("c") > 0.1, "positive").when(F.col("c") > -0.1, "neutral").when(F.col("c") > -0.3, "negative").otherwise("strongly negative")
    return c.select("user_id", rounded(F.col("c"), 3).alias("composite"), label.alias("label"))


_MONO = f"SELECT avg(share) AS rising FROM (SELECT a.trade_date, avg((b.mean_fwd > a.mean_fwd)::INTEGER) AS share FROM ({_LAYERS}) a JOIN ({_LAYERS}) b ON a.trade_date = b.trade_date AND a.layer < b.layer GROUP BY 1)"
_REG = f"SELECT count(*) AS regimes, count(DISTINCT ic > 0) = 1 AS one_sign, stddev_samp(ic) AS spread FROM (SELECT quarter(trade_date) AS q, avg(ic) AS ic FROM ({_ic()}) WHERE ic IS NOT NULL GROUP BY 1)"
_AUTO = f"""SELECT avg(corr) AS auto FROM (WITH p AS ({_pairs()}), d AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nxt FROM (SELECT DISTINCT trade_date FROM p)), b AS (SELECT d.nxt AS trade_date, p.code, p.value AS before, q.value FROM p JOIN d ON p.trade_date = d.trade_date JOIN p q ON q.trade_date = d.nxt AND q.code = p.code),
k AS (SELECT trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY before, code) AS a, row_number() OVER (PARTITION BY trade_date ORDER BY value, code) AS b FROM b) SELECT trade_date, corr(a, b) AS corr FROM k GROUP BY 1 HAVING count(*) >= 30)"""


@query(
    "l15_five_dimensions",
    f"""WITH h AS (SELECT horizon, avg(ic) AS m, avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS t FROM ({_all_ics()}) WHERE ic IS NOT NULL GROUP BY 1), x AS (SELECT (SELECT m FROM h WHERE horizon = 6) AS m, (SELECT t FROM h WHERE horizon = 6) AS t, (SELECT max(abs(m)) FROM h) AS peak, (SELECT abs(m) FROM h WHERE horizon = 12) AS late, * FROM ({_MONO}), ({_REG}), ({_AUTO})), y AS (SELECT *, coalesce(late, peak) / nullif(peak, 0) AS rest FROM x),
s AS (SELECT CASE WHEN abs(m) > 0.05 AND abs(t) > 3 THEN 30 WHEN abs(m) > 0.02 AND abs(t) > 2 THEN 20 WHEN abs(m) > 0.01 THEN 10 ELSE 0 END AS ic, CASE WHEN peak > 0.03 AND rest > 0.5 THEN 20 WHEN peak > 0.02 AND rest > 0.3 THEN 15 WHEN peak > 0.01 THEN 8 ELSE 3 END AS decay,
 CASE WHEN regimes >= 3 AND one_sign AND spread < 0.03 THEN 15 WHEN regimes >= 3 AND one_sign THEN 10 WHEN regimes >= 3 THEN 5 WHEN regimes = 2 THEN 8 ELSE 0 END AS regime, CASE WHEN rising > 0.75 THEN 15 WHEN rising > 0.60 THEN 12 WHEN rising > 0.50 THEN 6 ELSE 0 END AS monotonic,
 CASE WHEN auto > 0.85 THEN 20 WHEN auto > 0.70 THEN 15 WHEN auto > 0.50 THEN 8 ELSE 3 END AS stability FROM y)
SELECT *, ic + decay + regime + monotonic + stability AS points, CASE WHEN ic + decay + regime + monotonic + stability >= 80 THEN 'PASS' WHEN ic + decay + regime + monotonic + stability >= 55 THEN 'CONDITIONAL' ELSE 'FAIL' END AS verdict FROM s""",
)
def _(t):
    """All five dimensions of six-month momentum; quarters of the year stand for regimes, horizons are momenta."""
    h = all_ics(t).where("ic IS NOT NULL").groupBy("horizon").agg(F.avg("ic").alias("m"), (F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("*"))).alias("t"))
    at = lambda c, n: F.max(F.when(F.col("horizon") == n, F.col(c)))
    x = h.agg(at("m", 6).alias("m"), at("t", 6).alias("t"), F.max(F.abs("m")).alias("peak"), F.abs(at("m", 12)).alias("late"))
    p = pairs(t)
    q = val.rank_ic(p).where("ic IS NOT NULL").groupBy(F.quarter("trade_date").alias("q")).agg(F.avg("ic").alias("ic"))
    parts = [
        q.agg(F.count("*").alias("regimes"), (F.countDistinct(F.col("ic") > 0) == 1).alias("one_sign"), F.stddev_samp("ic").alias("spread")),
        val.monotonicity(val.layered(p)).agg(F.avg("share").alias("rising")),
        val.autocorrelation(p).agg(F.avg("corr").alias("auto")),
    ]
    for one in parts:  # one row each
        x = x.join(F.broadcast(one), F.lit(True))
    points = tr.factor_points(*[F.col(c) for c in ("m", "t", "peak")], F.coalesce("late", "peak"), *[F.col(c) for c in ("regimes", "one_sign", "spread", "rising", "auto")])
    s = x.select(*[c.alias(k) for k, c in points.items()])
    total = sum((F.col(k) for k in points), F.lit(0))
    return s.select("*", total.alias("points"), val.verdict(total).alias("verdict"))


_BLOCKS = f"{_M}, dt AS (SELECT trade_date, (row_number() OVER (ORDER BY trade_date) - 1) // 5 AS block FROM (SELECT DISTINCT trade_date FROM m)), n AS (SELECT count(*) // 5 AS n FROM dt), sc AS (SELECT s AS scenario, (s * 7919 + 42) % n AS block FROM generate_series(0, 999) g(s), n), mb AS (SELECT code, block, avg(ret) AS ret FROM m JOIN dt ON m.trade_date = dt.trade_date GROUP BY 1, 2)"


@query("m33_block_scenarios", f"WITH {_BLOCKS} SELECT scenario, code, {r('ret')} AS ret FROM sc JOIN mb ON sc.block = mb.block")
def _(t):
    return shown(tr.block_scenarios(monthly(t)), "ret")


@query("m19_portfolio_tail_loss", f"WITH {_BLOCKS}, w AS (SELECT code, 1.0 / count(*) OVER () AS w FROM industry), p AS (SELECT scenario, sum(-ret * w) AS loss FROM sc JOIN mb ON sc.block = mb.block JOIN w ON mb.code = w.code GROUP BY 1) SELECT {r('avg(loss)')} AS loss FROM (SELECT loss, row_number() OVER (ORDER BY loss DESC) AS k FROM p) WHERE k <= 10")
def _(t):
    w = t.industry.select("code", (F.lit(1.0) / F.count("*").over(tr.one())).alias("w"))
    return shown(tr.tail_loss(tr.block_scenarios(monthly(t)), w), "loss")


@query("m34_reverse_stress", f"WITH e AS (SELECT sum(w * abs(1 + code % 3 * 0.1)) AS e FROM (SELECT code, 1.0::DOUBLE / count(*) OVER () AS w FROM industry)), x AS (SELECT i, round(-0.10 + 0.20 * (((i + 1) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE), 4) AS m FROM generate_series(0, 9999) g(i)), l AS (SELECT i, m, abs(m) * e AS loss FROM x, e) SELECT m AS market_return, {r('loss')} AS loss FROM l WHERE loss >= 0.08 ORDER BY l.loss, i LIMIT 10")
def _(t):
    p = t.industry.select((F.lit(1.0) / F.count("*").over(tr.one())).alias("weight"), (1 + F.col("code") % 3 * 0.1).alias("beta"))
    return shown(tr.reverse_stress(p, 0.08), "loss")


@query("m03_mean_excess", f"WITH x AS (SELECT code, -ret AS x, row_number() OVER (PARTITION BY code ORDER BY -ret DESC) - 1 AS i, count(*) OVER (PARTITION BY code) AS n FROM daily_returns WHERE ret < 0), u AS (SELECT x.*, k FROM x, generate_series(1, 29) g(k) WHERE k < least(30, n // 5) AND i = k * n // least(30, n // 5)) SELECT u.code, round(u.x, 6) AS threshold, {r('avg(x.x - u.x)')} AS excess FROM u JOIN x ON u.code = x.code AND x.i < u.i AND x.x > u.x GROUP BY u.code, u.k, u.x")
def _(t):
    return shown(tr.mean_excess(t.daily_returns), "excess")


_GL = ", ".join(f"({float(x)!r}::DOUBLE, {float(w)!r}::DOUBLE)" for x, w in zip(*np.polynomial.legendre.leggauss(12)))


@query("h09_bivariate_normal", f"WITH e AS (SELECT vec_id, embedding[1]::DOUBLE * 5 AS h, embedding[2]::DOUBLE * 5 AS k, ((vec_id % 19) - 9) / 10.0::DOUBLE AS rho FROM embeddings), g(x, w) AS (VALUES {_GL}), s AS (SELECT vec_id, any_value(h) AS h, any_value(k) AS k, any_value(rho) AS rho, sum(w * exp(-(h * h - 2 * rho * (x + 1) / 2 * h * k + k * k) / (2 * (1 - power(rho * (x + 1) / 2, 2)))) / sqrt(1 - power(rho * (x + 1) / 2, 2))) AS t FROM e, g GROUP BY 1) SELECT vec_id, {r(norm_cdf_sql('h') + ' * ' + norm_cdf_sql('k') + ' + rho * t / (4 * pi())')} AS p FROM s")
def _(t):
    x = lambda i: F.col("embedding")[i].cast("double") * 5
    return t.read("embeddings").select("vec_id", rounded(tr.bivariate_normal_cdf(x(0), x(1), ((F.col("vec_id") % 19) - 9) / F.lit(10.0))).alias("p"))


@query("h26_decimal_json", "SELECT o_orderkey, '{\"__decimal__\":\"' || o_totalprice::DECIMAL(18, 4)::VARCHAR || '\"}' AS tagged, o_totalprice::DECIMAL(18, 4)::DOUBLE AS price FROM orders")
def _(t):
    """Decimals tagged in JSON and read back without loss."""
    o = t.read("orders").select("o_orderkey", F.to_json(F.struct(F.col("o_totalprice").cast("decimal(18, 4)").cast("string").alias("__decimal__"))).alias("tagged"))
    return o.select("o_orderkey", "tagged", F.get_json_object("tagged", "$.__decimal__").cast("decimal(18, 4)").cast("double").alias("price"))


@query("h28_report_text", f"WITH {_M}, s AS (SELECT code, {r('avg(ret) * 100', 2)} AS m, count(*) AS n FROM m GROUP BY 1) SELECT code, '## ' || lpad(code::VARCHAR, 6, '0') || chr(10) || '- months: ' || n || chr(10) || '- direction: ' || CASE WHEN m > 0 THEN 'up' ELSE 'down' END AS report FROM s")
def _(t):
    s = monthly(t).groupBy("code").agg(rounded(F.avg("ret") * 100, 2).alias("m"), F.count("*").alias("n"))
    text = F.concat(F.lit("## "), F.lpad(F.col("code").cast("string"), 6, "0"), F.lit("\n- months: "), F.col("n").cast("string"), F.lit("\n- direction: "), F.when(F.col("m") > 0, "up").otherwise("down"))
    return s.select("code", text.alias("report"))


@query("r11_report_assembly", "SELECT conv_id, '# Report' || chr(10) || string_agg('## ' || role || chr(10) || n || ' turns', chr(10) ORDER BY role) AS report FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY 1")
def _(t):
    """A section for each agent that answered, in order."""
    s = t.read("conversations").groupBy("conv_id", "role").agg(F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.count("*").cast("string"), F.lit(" turns")).alias("x"))
    g = s.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("role", "x"))).alias("l"))
    return g.select("conv_id", F.concat(F.lit("# Report\n"), F.array_join("l.x", "\n")).alias("report"))
