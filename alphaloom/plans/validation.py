"""Queries of factor validation, on six-month momentum against next month's return."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.functions.scalar import norm_cdf, norm_cdf_sql, rounded
from alphaloom.operators import validation as val
from alphaloom.plans.registry import query, r

_O = "(PARTITION BY code ORDER BY trade_date)"


def pairs(t, n: int = 6):
    w = Window.partitionBy("code").orderBy("trade_date")
    value, fwd = F.col("close") / F.lag("close", n).over(w) - 1, F.lead("close").over(w) / F.col("close") - 1
    return t.monthly.select("trade_date", "code", rounded(value, 9).alias("value"), rounded(fwd, 9).alias("fwd")).where("value IS NOT NULL AND fwd IS NOT NULL")


def _pairs(n: int = 6) -> str:
    return f"SELECT * FROM (SELECT trade_date, code, {r(f'close / lag(close, {n}) OVER {_O} - 1', 9)} AS value, {r(f'lead(close) OVER {_O} / close - 1', 9)} AS fwd FROM monthly) WHERE value IS NOT NULL AND fwd IS NOT NULL"


def _ic(n: int = 6) -> str:
    return f"SELECT trade_date, count(*) AS n, CASE WHEN count(*) >= 30 THEN 1 - 6 * sum(d * d) / (count(*) * (count(*)::DOUBLE * count(*) - 1)) END AS ic FROM (SELECT trade_date, (row_number() OVER (PARTITION BY trade_date ORDER BY value, code) - row_number() OVER (PARTITION BY trade_date ORDER BY fwd, code))::DOUBLE AS d FROM ({_pairs(n)})) GROUP BY 1"


@query("l01_rank_ic", f"SELECT trade_date, n, {r('ic')} AS ic FROM ({_ic()})")
def _(t):
    return val.rank_ic(pairs(t)).select("trade_date", "n", rounded(F.col("ic")).alias("ic"))


@query(
    "l02_spearman",
    f"""WITH p AS (SELECT trade_date, round(value, 1) AS value, fwd FROM ({_pairs()})), a AS (SELECT trade_date, rank() OVER (PARTITION BY trade_date ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY trade_date ORDER BY fwd) + (count(*) OVER (PARTITION BY trade_date, fwd) - 1) / 2.0 AS b FROM p)
SELECT trade_date, CASE WHEN count(*) >= 3 THEN {r('corr(a, b)')} END AS ic FROM a GROUP BY 1""",
)
def _(t):
    return val.spearman(pairs(t).withColumn("value", F.round("value", 1))).select("trade_date", rounded(F.col("ic")).alias("ic"))


@query("l03_information_ratio", f"SELECT year(trade_date)::INTEGER AS y, {r('avg(ic)')} AS mean_ic, CASE WHEN count(ic) >= 12 THEN {r('avg(ic) / nullif(stddev_pop(ic), 0)')} END AS ir, count(ic) AS n FROM ({_ic()}) GROUP BY 1")
def _(t):
    out = val.information_ratio(val.rank_ic(pairs(t)).withColumn("y", F.year("trade_date")), ["y"])
    return out.select("y", rounded(F.col("mean_ic")).alias("mean_ic"), rounded(F.col("ir")).alias("ir"), "n")


_LAYER = f"SELECT *, (least(floor(k / greatest(floor(n / 10), 1)), 9) + 1)::INTEGER AS layer FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY value, code) - 1 AS k, count(*) OVER (PARTITION BY trade_date) AS n FROM ({_pairs()})) WHERE n >= 30"
_LAYERS = f"SELECT trade_date, layer, count(*) AS n, avg(fwd) AS mean_fwd, avg(value) AS mean_value FROM ({_LAYER}) GROUP BY 1, 2"


@query("e04_layer_groups", f"SELECT trade_date, code, layer FROM ({_LAYER})")
def _(t):
    return val.with_layers(pairs(t)).select("trade_date", "code", "layer")


@query("l04_layered_backtest", f"SELECT trade_date, layer, n, {r('mean_fwd')} AS mean_fwd, {r('mean_value')} AS mean_value FROM ({_LAYERS})")
def _(t):
    return val.layered(pairs(t)).select("trade_date", "layer", "n", rounded(F.col("mean_fwd")).alias("mean_fwd"), rounded(F.col("mean_value")).alias("mean_value"))


_RANKED = f"SELECT trade_date, fwd, power(2.0, greatest(fwd, 0)) - 1 AS g, row_number() OVER (PARTITION BY trade_date ORDER BY value DESC, code) AS p, row_number() OVER (PARTITION BY trade_date ORDER BY fwd DESC, code) AS q FROM ({_pairs()})"


@query("l05_ndcg", f"SELECT trade_date, {r('sum(g / log2(p + 1)) FILTER (p <= 30) / nullif(sum(g / log2(q + 1)) FILTER (q <= 30), 0)')} AS ndcg FROM ({_RANKED}) GROUP BY 1")
def _(t):
    return val.ndcg(pairs(t)).select("trade_date", rounded(F.col("ndcg")).alias("ndcg"))


@query("l06_ranking_metric", f"SELECT trade_date, {r('(avg(fwd) FILTER (p <= 5) - avg(fwd)) / nullif(avg(fwd) FILTER (q <= 5) - avg(fwd), 0)')} AS metric FROM ({_RANKED}) GROUP BY 1")
def _(t):
    return val.ranking_metric(pairs(t)).select("trade_date", rounded(F.col("metric")).alias("metric"))


def _all_ics() -> str:
    return " UNION ALL ".join(f"SELECT {n} AS horizon, trade_date, ic FROM ({_ic(n)})" for n in (1, 3, 6, 12))


def all_ics(t):
    out = None
    for n in (1, 3, 6, 12):
        one = val.rank_ic(pairs(t, n)).select(F.lit(n).alias("horizon"), "trade_date", "ic")
        out = one if out is None else out.unionByName(one)
    return out


@query("l07_ic_decay", f"SELECT horizon, {r('avg(ic)')} AS mean_ic, {r('stddev_pop(ic)')} AS sd, {r('avg(ic) / nullif(stddev_pop(ic), 0)')} AS ir FROM ({_all_ics()}) WHERE ic IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    d = all_ics(t).where("ic IS NOT NULL").groupBy("horizon").agg(F.avg("ic").alias("m"), F.stddev_pop("ic").alias("s"), F.count("*").alias("n")).where("n >= 3")
    return d.select("horizon", rounded(F.col("m")).alias("mean_ic"), rounded(F.col("s")).alias("sd"), rounded(F.try_divide("m", "s")).alias("ir"))


@query(
    "l08_autocorrelation",
    f"""WITH p AS ({_pairs()}), d AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nxt FROM (SELECT DISTINCT trade_date FROM p)), b AS (SELECT d.nxt AS trade_date, p.code, p.value AS before, q.value FROM p JOIN d ON p.trade_date = d.trade_date JOIN p q ON q.trade_date = d.nxt AND q.code = p.code),
k AS (SELECT trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY before, code) AS a, row_number() OVER (PARTITION BY trade_date ORDER BY value, code) AS b FROM b) SELECT trade_date, {r('corr(a, b)')} AS corr FROM k GROUP BY 1 HAVING count(*) >= 30""",
)
def _(t):
    return val.autocorrelation(pairs(t)).select("trade_date", rounded(F.col("corr")).alias("corr"))


@query(
    "l09_validate",
    f"SELECT (SELECT {r('avg(ic)')} FROM ({_ic()})) AS mean_ic, (SELECT {r('avg(ic) / stddev_pop(ic)')} FROM ({_ic()})) AS ir, (SELECT {r('avg(mean_fwd) FILTER (layer = 10) - avg(mean_fwd) FILTER (layer = 1)')} FROM ({_LAYERS})) AS spread, (SELECT {r('count(*)::DOUBLE / (SELECT count(*) FROM monthly)')} FROM ({_pairs()})) AS coverage",
)
def _(t):
    p = pairs(t)
    ic = val.rank_ic(p).agg(rounded(F.avg("ic")).alias("mean_ic"), rounded(F.avg("ic") / F.stddev_pop("ic")).alias("ir"))
    mean = lambda k: F.avg(F.when(F.col("layer") == k, F.col("mean_fwd")))
    spread = val.layered(p).agg(rounded(mean(10) - mean(1)).alias("spread"))
    coverage = p.agg(F.count("*").alias("a")).join(t.monthly.agg(F.count("*").alias("b")), how="cross").select(rounded(F.col("a") / F.col("b")).alias("coverage"))
    return ic.join(spread, how="cross").join(coverage, how="cross")


_TESTS = f"SELECT name, 2 * (1 - {norm_cdf_sql('abs(z)')}) AS p FROM (SELECT year(trade_date)::VARCHAR AS name, avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS z FROM ({_ic()}) WHERE ic IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)"


def tests(t):
    by = val.rank_ic(pairs(t)).where("ic IS NOT NULL").groupBy(F.year("trade_date").cast("string").alias("name"))
    z = by.agg((F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("*"))).alias("z"), F.count("*").alias("n")).where("n >= 3")
    return z.select("name", rounded(2 * (1 - norm_cdf(F.abs("z"))), 9).alias("p"))


@query(
    "l11_multiple_testing",
    f"""WITH x AS (SELECT name, {r('p', 9)} AS p FROM ({_TESTS})), y AS (SELECT *, count(*) OVER ()::DOUBLE AS m, row_number() OVER (ORDER BY p, name)::DOUBLE AS i FROM x), z AS (SELECT *, sum(1 / i) OVER () AS c FROM y),
w AS (SELECT name, p, least(p * m, 1) AS bonferroni, max(least(p * (m - i + 1), 1)) OVER (ORDER BY i) AS holm, min(least(p * m / i, 1)) OVER (ORDER BY i DESC) AS bh, min(least(p * m / i * c, 1)) OVER (ORDER BY i DESC) AS "by" FROM z)
SELECT name, {r('bonferroni')} AS bonferroni, {r('holm')} AS holm, {r('bh')} AS bh, {r('"by"')} AS "by", bh <= 0.05 AS bh_reject, holm <= 0.05 AS holm_reject FROM w""",
)
def _(t):
    out = val.multiple_testing(tests(t))
    return out.select("name", *[rounded(F.col(c)).alias(c) for c in ("bonferroni", "holm", "bh", "by")], "bh_reject", "holm_reject")


_GRADE = f"SELECT horizon, avg(ic) AS m, avg(ic) / stddev_pop(ic) AS ir, avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS t, avg((ic > 0)::INTEGER) AS share FROM ({_all_ics()}) WHERE ic IS NOT NULL GROUP BY 1"


@query(
    "l15_score_and_grade",
    f"""WITH g AS ({_GRADE}), q AS (SELECT *, CASE WHEN abs(m) >= 0.05 AND abs(t) >= 3 THEN 30 WHEN abs(m) >= 0.02 AND abs(t) >= 2 THEN 20 WHEN abs(m) >= 0.01 THEN 10 ELSE 0 END AS points,
 CASE WHEN abs(ir) >= 0.5 THEN 3 WHEN abs(ir) >= 0.3 THEN 2 WHEN abs(ir) >= 0.1 THEN 1 ELSE 0 END + CASE WHEN abs(t) >= 3 THEN 3 WHEN abs(t) >= 2 THEN 2 WHEN abs(t) >= 1 THEN 1 ELSE 0 END + CASE WHEN abs(share - 0.5) >= 0.2 THEN 2 WHEN abs(share - 0.5) >= 0.1 THEN 1 ELSE 0 END AS k FROM g)
SELECT horizon, points, CASE WHEN points * 3 >= 80 THEN 'PASS' WHEN points * 3 >= 55 THEN 'CONDITIONAL' ELSE 'FAIL' END AS verdict, CASE WHEN k >= 7 THEN 'A' WHEN k >= 5 THEN 'B' WHEN k >= 3 THEN 'C' ELSE 'D' END AS grade FROM q""",
)
def _(t):
    g = all_ics(t).where("ic IS NOT NULL").groupBy("horizon").agg(F.avg("ic").alias("m"), (F.avg("ic") / F.stddev_pop("ic")).alias("ir"), (F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("*"))).alias("t"), F.avg((F.col("ic") > 0).cast("double")).alias("share"))
    points = val.score_ic(F.col("m"), F.col("t"))
    # one dimension of five, held against a third of the verdict's thresholds; all five are in l15_five_dimensions
    return g.select("horizon", points.alias("points"), val.verdict(points * 3).alias("verdict"), val.grade(F.col("ir"), F.col("t"), F.col("share")).alias("grade"))


@query("l17_monotonicity", f"SELECT a.trade_date, {r('avg((b.mean_fwd > a.mean_fwd)::INTEGER)')} AS share FROM ({_LAYERS}) a JOIN ({_LAYERS}) b ON a.trade_date = b.trade_date AND a.layer < b.layer GROUP BY 1")
def _(t):
    return val.monotonicity(val.layered(pairs(t))).select("trade_date", rounded(F.col("share")).alias("share"))


_SERIES = " UNION ALL ".join(f"SELECT trade_date, 'm{n}' AS factor, avg(value) AS v FROM ({_pairs(n)}) GROUP BY 1" for n in (1, 3, 6, 12))


@query("l18_factor_correlation", f"WITH s AS ({_SERIES}) SELECT a.factor AS a, b.factor AS b, {r('corr(a.v, b.v)')} AS corr FROM s a JOIN s b ON a.trade_date = b.trade_date AND a.factor < b.factor GROUP BY 1, 2")
def _(t):
    s = None
    for n in (1, 3, 6, 12):
        one = pairs(t, n).groupBy("trade_date").agg(F.avg("value").alias("v")).withColumn("factor", F.lit(f"m{n}"))
        s = one if s is None else s.unionByName(one)
    x, y = s.select("trade_date", F.col("factor").alias("a"), F.col("v").alias("p")), s.select("trade_date", F.col("factor").alias("b"), F.col("v").alias("q"))
    return x.join(y, "trade_date").where("a < b").groupBy("a", "b").agg(rounded(F.corr("p", "q")).alias("corr"))


@query(
    "l19_regime_ic",
    f"""WITH m AS (SELECT trade_date, avg(ret) AS x FROM returns WHERE ret IS NOT NULL GROUP BY 1), g AS (SELECT trade_date, CASE WHEN {r('sum(x) OVER (ORDER BY trade_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} > 0 THEN 'up' ELSE 'down' END AS regime FROM m)
SELECT regime, {r('avg(ic)')} AS mean_ic, count(*) AS n FROM ({_ic()}) i JOIN g ON i.trade_date = g.trade_date WHERE ic IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""",
)
def _(t):
    m = t.returns.where("ret IS NOT NULL").groupBy("trade_date").agg(F.avg("ret").alias("x"))
    s = F.sum("x").over(Window.partitionBy(F.lit(1)).orderBy("trade_date").rowsBetween(-3, -1))
    g = m.select("trade_date", F.when(rounded(s) > 0, "up").otherwise("down").alias("regime"))
    j = val.rank_ic(pairs(t)).where("ic IS NOT NULL").join(g, "trade_date")
    return j.groupBy("regime").agg(rounded(F.avg("ic")).alias("mean_ic"), F.count("*").alias("n")).where("n >= 10")


@query("l20_ic_weights", f"SELECT horizon, {r('abs(m) / sum(abs(m)) OVER ()')} AS weight, {r('greatest(m, 0) / nullif(sum(greatest(m, 0)) OVER (), 0)')} AS positive_weight FROM (SELECT horizon, avg(ic) AS m FROM ({_all_ics()}) WHERE ic IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)")
def _(t):
    m = all_ics(t).where("ic IS NOT NULL").groupBy("horizon").agg(F.avg("ic").alias("m"), F.count("*").alias("n")).where("n >= 10")
    one = Window.partitionBy(F.lit(1))
    up = F.greatest("m", F.lit(0.0))
    return m.select("horizon", rounded(F.abs("m") / F.sum(F.abs("m")).over(one)).alias("weight"), rounded(F.try_divide(up, F.sum(up).over(one))).alias("positive_weight"))
