"""Queries of credibility, ruin, reserves, copulas and the deflated Sharpe ratio."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.functions.scalar import norm_cdf_sql, rounded
from alphaloom.operators import actuarial as act
from alphaloom.operators import gram, risk
from alphaloom.plans.registry import query, r
from alphaloom.plans.risk import _DEV, _M, _XY, against_market, monthly, shown

_UV = f"{_XY}, uv AS (SELECT code, rank() OVER (PARTITION BY code ORDER BY x) / (count(*) OVER (PARTITION BY code) + 1.0) AS u, rank() OVER (PARTITION BY code ORDER BY y) / (count(*) OVER (PARTITION BY code) + 1.0) AS v FROM p)"
_TAU = f"{_UV}, kt AS (SELECT a.code, {r('sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sum(abs(sign(a.x - b.x) * sign(a.y - b.y))), 0)')} AS tau FROM p a JOIN p b ON a.code = b.code AND a.t < b.t GROUP BY 1), c AS (SELECT code, tau, CASE WHEN tau <= 0 THEN 0.1 ELSE 2 * tau / (1 - tau) END AS ct, CASE WHEN tau <= 0 THEN 1.01 ELSE 1 / (1 - tau) END AS gt, CASE WHEN tau = 0 THEN 0.01 ELSE 9 * tau END AS ft FROM kt)"
_GUMBEL = "ln(power(s, 1 / gt) + gt - 1) - power(s, 1 / gt) - ln(u) - ln(v) + (gt - 1) * (ln(-ln(u)) + ln(-ln(v))) + (1 / gt - 2) * ln(s)"
_FRANK = "ln(ft * (1 - exp(-ft)) * exp(-ft * (u + v))) - 2 * ln(abs((1 - exp(-ft)) - (1 - exp(-ft * u)) * (1 - exp(-ft * v))))"
_CLAYTON = "ln(1 + ct) - (1 + ct) * (ln(u) + ln(v)) - (2 + 1 / ct) * ln(power(u, -ct) + power(v, -ct) - 1)"


@query(
    "m14_copula_loglik",
    f"""WITH {_TAU}, j AS (SELECT uv.code, u, v, tau, ct, gt, ft, power(-ln(u), gt) + power(-ln(v), gt) AS s FROM uv JOIN c ON uv.code = c.code)
SELECT code, max(tau) AS tau, {r(f'sum({_CLAYTON})', 4)} AS clayton, {r(f'sum({_GUMBEL})', 4)} AS gumbel, {r(f'sum({_FRANK})', 4)} AS frank FROM j GROUP BY 1""",
)
def _(t):
    """Log likelihoods of three copulas between each code and the market, with parameters from Kendall's tau (Frank's: the
    first term of its series, nine times tau)."""
    p, w = against_market(t), Window.partitionBy("code")
    n = F.count("*").over(w) + 1
    u = p.select("code", (F.rank().over(w.orderBy("x")) / n).alias("u"), (F.rank().over(w.orderBy("y")) / n).alias("v"))
    j = u.join(shown(risk.kendall(p), "tau"), "code")
    tau, x, y = F.col("tau"), F.col("u"), F.col("v")
    clayton, gumbel, frank = F.when(tau <= 0, 0.1).otherwise(2 * tau / (1 - tau)), F.when(tau <= 0, 1.01).otherwise(1 / (1 - tau)), F.when(tau == 0, 0.01).otherwise(9 * tau)
    sums = {"clayton": risk.clayton_loglik(x, y, clayton), "gumbel": act.gumbel_loglik(x, y, gumbel), "frank": act.frank_loglik(x, y, frank)}
    return j.groupBy("code").agg(F.max("tau").alias("tau"), *[rounded(F.sum(c), 4).alias(k) for k, c in sums.items()])


@query(
    "m18_tail_dependence",
    f"""WITH {_M}, j AS (SELECT a.code AS a, b.code AS b, a.ret AS x, b.ret AS y FROM m a JOIN m b ON a.trade_date = b.trade_date AND a.code < b.code), q AS (SELECT *, list_sort(list(x) OVER w)[floor(count(*) OVER w * 0.05)::INTEGER + 1] AS qx, list_sort(list(y) OVER w)[floor(count(*) OVER w * 0.05)::INTEGER + 1] AS qy FROM j WINDOW w AS (PARTITION BY a, b))
SELECT a, b, {r('avg((y <= qy)::INTEGER) FILTER (x <= qx)')} AS lower FROM q GROUP BY 1, 2""",
)
def _(t):
    """Of every two codes, over their common months: how often the second is in its lower twentieth when the first is."""
    return gram.lower_tails(monthly(t), digits=6)


def _credibility_sql(source: str, keys: str, half_life: int | None) -> str:
    """CTEs that end in w (keys, code, n, credibility, posterior, weight). source: a table of keys, code, trade_date, ret."""
    over = f"PARTITION BY {keys[:-2]}" if keys else ""
    d = "1.0" if half_life is None else f"power({0.5 ** (1.0 / half_life)!r}, count(*) OVER (PARTITION BY {keys}code) - row_number() OVER (PARTITION BY {keys}code ORDER BY trade_date))"
    return f"""d AS (SELECT *, {d} AS d FROM {source}), s AS (SELECT {keys}code, sum(d)::DOUBLE AS n, avg(ret) AS plain, sum(ret * d) / sum(d) AS mean, var_samp(ret) AS s2 FROM d GROUP BY ALL),
g AS (SELECT *, avg(s2) OVER ({over}) AS m, CASE WHEN coalesce(var_samp(plain) OVER ({over}), 0) <= 0 THEN 0.1 * avg(s2) OVER ({over}) ELSE var_samp(plain) OVER ({over}) END AS v, avg(plain) OVER ({over}) AS grand FROM s),
z AS (SELECT *, n / (n + m / v) AS credibility, n / (n + m / v) * mean + (1 - n / (n + m / v)) * grand AS posterior FROM g), e AS (SELECT *, coalesce(exp(greatest(least(posterior / sqrt(m / (n + m / v)), 50), -50)), 1) AS e FROM z),
w AS (SELECT {keys}code, n, credibility, posterior, e / sum(e) OVER ({over}) AS weight FROM e)"""


@query("m21_buhlmann_straub", f"WITH {_M}, {_credibility_sql('m', '', None)} SELECT code, {r('n')} AS n, {r('credibility')} AS credibility, {r('posterior')} AS posterior, {r('weight')} AS weight FROM w")
def _(t):
    return shown(act.credibility(monthly(t), "code", "ret"), "n", "credibility", "posterior", "weight")


@query("m21_decay", f"WITH {_M}, {_credibility_sql('m', '', 14)} SELECT code, {r('n')} AS n, {r('credibility')} AS credibility, {r('posterior')} AS posterior, {r('weight')} AS weight FROM w")
def _(t):
    return shown(act.credibility(monthly(t), "code", "ret", half_life=14), "n", "credibility", "posterior", "weight")


@query(
    "m22_hierarchical_credibility",
    f"""WITH {_M}, q AS (SELECT *, quarter(trade_date)::INTEGER AS regime FROM m), {_credibility_sql('q', 'regime, ', None)}, f AS (SELECT regime, periods / sum(periods) OVER () AS share, sources FROM (SELECT regime, count(DISTINCT trade_date) AS periods, count(DISTINCT code) AS sources FROM q GROUP BY 1))
SELECT code, {r('sum(share * weight) / sum(share)')} AS blended, count(*) AS regimes FROM w JOIN f ON w.regime = f.regime WHERE sources >= 2 GROUP BY 1""",
)
def _(t):
    """Quarters of the year stand for regimes."""
    return shown(act.hierarchical(monthly(t).withColumn("regime", F.quarter("trade_date")), "code", "ret", "regime"), "blended")


@query(
    "m23_hachemeister",
    f"""WITH {_M}, l AS (SELECT code, ret AS y, lag(ret) OVER (PARTITION BY code ORDER BY trade_date) AS x, count(*) OVER (PARTITION BY code) AS n FROM m), k AS (SELECT * FROM l WHERE n >= 5 AND x IS NOT NULL),
p AS (SELECT regr_intercept(y, x) AS p0 FROM k), b AS (SELECT code, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS rss FROM k GROUP BY 1),
a AS (SELECT *, n * sxx - sx * sx AS det, var_samp(b0) OVER () AS a00, var_samp(b1) OVER () AS a11, covar_samp(b0, b1) OVER () AS a01, avg(rss / greatest(n - 2, 1)) OVER () AS v FROM b),
c AS (SELECT *, a00 + v * sxx / det AS m00, a11 + v * n / det AS m11, a01 - v * sx / det AS m01 FROM a), z AS (SELECT *, (a00 * m11 - a01 * m01) / (m00 * m11 - m01 * m01) AS z0, (a11 * m00 - a01 * m01) / (m00 * m11 - m01 * m01) AS z1 FROM c)
SELECT code, {r('b0')} AS intercept, {r('b1')} AS slope, {r('z0')} AS z0, {r('z1')} AS z1, {r('z0 * b0 + (1 - z0) * p0')} AS blended FROM z, p""",
)
def _(t):
    return shown(act.hachemeister(monthly(t), "code", "ret"), "intercept", "slope", "z0", "z1", "blended")


_X = "SELECT code, ret * 0.2 AS x FROM daily_returns"
_RUIN = "SELECT code, count(*) AS n, coalesce(sum(-x) FILTER (x < 0), 0) AS lost, count(*) FILTER (x < 0) AS losses, coalesce(sum(x) FILTER (x > 0), 0) AS gained, avg(x) AS mean, var_samp(x) AS var, coalesce(sum(greatest(0.5 + x, 0)) FILTER (x < 0), 0) AS below"


@query(
    "m26_ruin_closed_forms",
    f"""WITH s AS ({_RUIN} FROM ({_X}) GROUP BY 1), k AS (SELECT *, lost / losses AS mu, gained / n AS c, gained / nullif(lost, 0) - 1 AS theta FROM s)
SELECT code, {r('CASE WHEN losses = 0 THEN 0 WHEN coalesce(theta, 0) <= 0 THEN 1 ELSE least(exp(-theta * 0.5 / (mu * (1 + theta))) / (1 + theta), 1) END')} AS cramer_lundberg,
 {r('CASE WHEN losses = 0 THEN 0 WHEN gained = 0 OR mu / c >= 1 THEN 1 ELSE (1 - mu / c) * (1 - least(below / lost, 1)) END')} AS beekman_bowers,
 {r('CASE WHEN mean <= 0 OR coalesce(var, 0) = 0 THEN 1 ELSE least(exp(-2 * mean / var * 0.5), 1) END')} AS lundberg FROM k""",
)
def _(t):
    """A surplus of one half against trades of a fifth of the capital."""
    return shown(act.ruin(t.daily_returns, size=0.2), "cramer_lundberg", "beekman_bowers", "lundberg")



@query("m26_ruin_moments", f"SELECT code, {r('avg((ret < 0)::INTEGER)')} AS lambda, {r('avg(-ret) FILTER (ret < 0)')} AS mean_loss, {r('avg(ret)')} AS drift, {r('CASE WHEN avg(ret) <= 0 THEN 1 ELSE exp(-2 * avg(ret) * 0.5 / var_pop(ret)) END')} AS ruin FROM daily_returns GROUP BY 1")
def _(t):
    """Moments of losses and the diffusion approximation of ruin from an initial wealth of one half."""
    loss = F.col("ret") < 0
    ruin = F.when(F.avg("ret") <= 0, 1.0).otherwise(F.exp(-2 * F.avg("ret") * 0.5 / F.var_pop("ret")))
    return t.daily_returns.groupBy("code").agg(rounded(F.avg(loss.cast("double"))).alias("lambda"), rounded(F.avg(F.when(loss, -F.col("ret")))).alias("mean_loss"), rounded(F.avg("ret")).alias("drift"), rounded(ruin).alias("ruin"))


@query("m27_ruin_update", f"WITH a AS (SELECT code, p::INTEGER AS period, {r('max(p) / 200.0 * avg((ret < -0.4)::INTEGER)')} AS ruin FROM daily_returns, (VALUES (5), (21), (63), (126)) v(p) GROUP BY 1, 2), k AS (SELECT code, max_by(ruin, period) FILTER (period <= 30) AS k FROM a GROUP BY 1) SELECT a.code, period, {r('CASE WHEN period <= 30 THEN 0 WHEN k >= 1 THEN ruin ELSE (ruin - k) / (1 - k) END')} AS ruin FROM a JOIN k ON a.code = k.code")
def _(t):
    """Ruin by horizon (here in proportion to it and to the share of great losses), updated after thirty days survived."""
    share = t.daily_returns.groupBy("code").agg(F.avg((F.col("ret") < -0.4).cast("double")).alias("s"))
    at = share.select("code", "s", F.explode(F.array(*[F.lit(p) for p in (5, 21, 63, 126)])).alias("period"))
    return shown(act.survived(at.select("code", "period", rounded(F.col("period") / 200.0 * F.col("s")).alias("ruin")), 30), "ruin")


@query("m27_risk_budget", f"WITH {_M}, e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY code ORDER BY trade_date)) AS q FROM m), d AS (SELECT code, trade_date, 1 - q / greatest(max(q) OVER (PARTITION BY code ORDER BY trade_date), 1) AS fall FROM e) SELECT code, trade_date, {r('greatest(0.01, 0.2 * greatest(1 - fall / 2, 0))')} AS budget FROM d")
def _(t):
    w = Window.partitionBy("code").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    e = monthly(t).withColumn("q", F.exp(F.sum(F.log1p("ret")).over(w)))
    fall = 1 - F.col("q") / F.greatest(F.max("q").over(w), F.lit(1.0))
    return e.select("code", "trade_date", rounded(act.risk_budget(fall, F.lit(0.2))).alias("budget"))


@query(
    "m29_mack_cv",
    f"""WITH {_DEV}, n AS (SELECT max(i) + 1 AS n FROM triangle), l AS (SELECT *, lead(c) OVER (PARTITION BY i ORDER BY j) AS later FROM triangle), s AS (SELECT l.j, CASE WHEN n - l.j - 2 >= 1 THEN sum(c * power(later / c - factor, 2)) / (n - l.j - 2) / power(max(factor), 2) ELSE 0 END AS s FROM l JOIN d ON l.j = d.j, n WHERE later IS NOT NULL AND c > 0 GROUP BY l.j, n),
x AS (SELECT i, g.j, paid * coalesce(cum, 1) AS ult FROM g LEFT JOIN u ON g.j = u.j) SELECT {r('sqrt((SELECT sum(ult * ult * s) FROM x JOIN s ON s.j >= x.j WHERE i >= 1)) / (SELECT sum(ult) FROM x)')} AS cv""",
)
def _(t):
    return shown(act.mack_cv(t.triangle), "cv")


@query("m30_cape_cod", f"WITH {_DEV}, c AS (SELECT i, paid, paid * coalesce(cum, 1) AS ult, 6e8 + i * 1e6 AS premium FROM g LEFT JOIN u ON g.j = u.j), p AS (SELECT *, premium * sum(paid) OVER () / sum(premium * paid / ult) OVER () AS prior FROM c) SELECT i, {r('greatest(paid + prior * (1 - paid / ult) + 0.7 * (ult - prior), paid)', 2)} AS ultimate FROM p")
def _(t):
    premiums = t.triangle.select("i").distinct().select("i", (6e8 + F.col("i") * 1e6).alias("premium"))
    return shown(act.cape_cod(t.triangle, premiums).select("i", "ultimate"), "ultimate", digits=2)


_SHARPE = f"{_M}, a AS (SELECT *, avg(ret) OVER (PARTITION BY code) AS mu FROM m), q AS (SELECT code, max(mu) AS mu, count(*) AS n, avg(power(ret - mu, 2)) AS c2, avg(power(ret - mu, 3)) AS c3, avg(power(ret - mu, 4)) AS c4 FROM a GROUP BY 1), s AS (SELECT code, n, mu / sqrt(c2) AS s, c3 / power(c2, 1.5) AS skew, c4 / (c2 * c2) AS kurt FROM q)"
_SE, _D = "sqrt((1 + 0.5 * s * s) / n)", "(s - 0.1)"
_PSR = f"sqrt((1 - skew * {_D} + (kurt - 1) / 4 * {_D} * {_D}) / n)"


def _sharpe(t):
    g = monthly(t).groupBy("code").agg(F.count("*").alias("n"), (F.avg("ret") / F.stddev_pop("ret")).alias("s"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    dsr, haircut = act.deflated_sharpe(F.col("s"), 10, F.col("n"))
    return g.select("code", rounded(F.col("s")).alias("sharpe"), rounded(dsr).alias("dsr"), rounded(haircut).alias("haircut"), rounded(act.probabilistic_sharpe(F.col("s"), 0.1, F.col("n"), F.col("skew"), F.col("kurt"))).alias("psr"))


_SHARPES = f"SELECT code, {r('s')} AS sharpe, {r('1 - ' + norm_cdf_sql(f'((s - {_SE} * sqrt(2 * ln(10.0))) / {_SE})'))} AS dsr, {r(f'greatest(s - {_SE} * sqrt(2 * ln(10.0)), 0)')} AS haircut, {r(norm_cdf_sql(f'({_D} / {_PSR})'))} AS psr FROM s"


@query("o06_probabilistic_sharpe", f"WITH {_SHARPE} {_SHARPES}")
def _(t):
    """Deflated for ten trials, less what chance would give, and the probability of a monthly ratio above 0.1."""
    return _sharpe(t)


@query("o15_dsr_report", f"WITH {_SHARPE}, o AS ({_SHARPES}) SELECT *, CASE WHEN dsr > 0.05 THEN 'possible data snooping' ELSE '' END AS warning FROM o")
def _(t):
    return _sharpe(t).withColumn("warning", F.when(F.col("dsr") > 0.05, "possible data snooping").otherwise(""))


@query(
    "p10_position_limits",
    "WITH w AS (SELECT code, region, sector, greatest(acctbal, 0) / (SELECT sum(greatest(acctbal, 0)) FROM industry) * 5 AS w FROM industry) SELECT code, w > 0.10 AS single, sum(w) OVER (PARTITION BY sector) > 0.30 AS industry, sum(w) OVER (PARTITION BY region) > 0.95 AS total FROM w",
)
def _(t):
    """A portfolio in each region: positions over a tenth, sectors over three tenths, and a total over 95 %."""
    held = F.greatest("acctbal", F.lit(0.0))
    w = t.industry.select("code", "region", "sector", (held / F.sum(held).over(act.one()) * 5).alias("w"))
    over = lambda c: F.sum("w").over(Window.partitionBy(c))
    return w.select("code", (F.col("w") > risk.SINGLE_LIMIT).alias("single"), (over("sector") > risk.INDUSTRY_LIMIT).alias("industry"), (over("region") > risk.TOTAL_LIMIT).alias("total"))
