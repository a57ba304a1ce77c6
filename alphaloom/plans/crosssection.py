"""Queries of preprocessing, fusion, signals and the flagship selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.functions.scalar import rounded
from alphaloom.operators import crosssection as xs
from alphaloom.operators import factors as fac
from alphaloom.operators import relational as rel
from alphaloom.plans.registry import query, r


def momentum(t, n: int = 6):
    """trade_date, code, value: n-month momentum of monthly bars."""
    w = Window.partitionBy("code").orderBy("trade_date")
    return t.monthly.select("trade_date", "code", rounded(F.col("close") / F.lag("close", n).over(w) - 1, 9).alias("value")).where("value IS NOT NULL")


def _mom(n: int = 6) -> str:
    return f"SELECT trade_date, code, {r(f'close / lag(close, {n}) OVER (PARTITION BY code ORDER BY trade_date) - 1', 9)} AS value FROM monthly"


_V = f"v AS (SELECT * FROM ({_mom()}) WHERE value IS NOT NULL), s AS (SELECT v.*, i.sector FROM v LEFT JOIN industry i ON v.code = i.code)"
_W = "PARTITION BY trade_date"


def out(df):
    return df.select("trade_date", "code", rounded(F.col("value")).alias("value"))


def sectored(t):
    return rel.with_sector(momentum(t), t.industry)


@query(
    "top_momentum",
    f"""WITH {_V}, z AS (SELECT *, CASE WHEN count(*) OVER ({_W}) >= 5 THEN CASE WHEN stddev_pop(value) OVER ({_W}) > 1e-12 THEN (value - avg(value) OVER ({_W})) / stddev_pop(value) OVER ({_W}) ELSE 0 END ELSE value END AS z FROM s),
n AS (SELECT trade_date, code, {r('z - avg(z) OVER (PARTITION BY trade_date, sector)')} AS score FROM z)
SELECT * FROM (SELECT *, row_number() OVER ({_W} ORDER BY score DESC, code) AS rank FROM n) WHERE rank <= 10""",
)
def top_momentum(t):
    """The ten codes of each month with the highest sector-neutral six-month momentum."""
    z = sectored(t).transform(xs.standardize, ["trade_date"]).transform(xs.neutralize, ["trade_date"])
    return rel.top_per(z.select("trade_date", "code", rounded(F.col("value")).alias("score")), ["trade_date"], [F.desc("score"), F.col("code")], 10)


@query(
    "k01_winsorize_mad",
    f"""WITH {_V}, m AS (SELECT *, median(value) OVER ({_W}) AS med, count(*) OVER ({_W}) AS n FROM v), d AS (SELECT *, median(abs(value - med)) OVER ({_W}) * 3 / 0.6745 AS w FROM m)
SELECT trade_date, code, {r('CASE WHEN n >= 5 AND w > 0 THEN greatest(least(value, med + w), med - w) ELSE value END')} AS value FROM d""",
)
def _(t):
    return out(xs.winsorize_mad(momentum(t), ["trade_date"]))


@query("k02_winsorize_sigma", f"WITH {_V} SELECT trade_date, code, {r(f'CASE WHEN count(*) OVER ({_W}) >= 5 THEN greatest(least(value, avg(value) OVER ({_W}) + 3 * stddev_pop(value) OVER ({_W})), avg(value) OVER ({_W}) - 3 * stddev_pop(value) OVER ({_W})) ELSE value END')} AS value FROM v")
def _(t):
    return out(xs.winsorize_sigma(momentum(t), ["trade_date"]))


_K03 = f"""WITH {_V}, g AS (SELECT * FROM (SELECT DISTINCT trade_date FROM v), (SELECT DISTINCT code FROM monthly)), j AS (SELECT g.trade_date, g.code, v.value FROM g LEFT JOIN v ON g.trade_date = v.trade_date AND g.code = v.code)
SELECT trade_date, code, {r(f'coalesce(value, median(value) OVER ({_W}), 0)')} AS value FROM j"""


@query("k03_fill_missing", _K03)
def _(t):
    """Missing are the values of codes without enough months before."""
    m = momentum(t)
    grid = m.select("trade_date").distinct().join(rel.small(t.monthly.select("code").distinct()), how="cross")
    return out(xs.fill_missing(m, grid, ["trade_date"], ["trade_date", "code"]))


@query("k04_standardize", f"WITH {_V} SELECT trade_date, code, {r(f'CASE WHEN count(*) OVER ({_W}) >= 5 THEN CASE WHEN stddev_pop(value) OVER ({_W}) > 1e-12 THEN (value - avg(value) OVER ({_W})) / stddev_pop(value) OVER ({_W}) ELSE 0 END ELSE value END')} AS value FROM v")
def _(t):
    return out(xs.standardize(momentum(t), ["trade_date"]))


@query("k05_neutralize", f"WITH {_V} SELECT trade_date, code, {r('value - avg(value) OVER (PARTITION BY trade_date, sector)')} AS value FROM s")
def _(t):
    return out(xs.neutralize(sectored(t), ["trade_date"]))


@query(
    "k06_pipeline",
    f"""WITH {_V}, m AS (SELECT *, median(value) OVER ({_W}) AS med, count(*) OVER ({_W}) AS n FROM s), d AS (SELECT *, median(abs(value - med)) OVER ({_W}) * 3 / 0.6745 AS w FROM m),
c AS (SELECT trade_date, code, sector, n, CASE WHEN n >= 5 AND w > 0 THEN greatest(least(value, med + w), med - w) ELSE value END AS value FROM d),
z AS (SELECT *, CASE WHEN n >= 5 THEN (value - avg(value) OVER ({_W})) / stddev_pop(value) OVER ({_W}) ELSE value END AS z FROM c)
SELECT trade_date, code, {r('z - avg(z) OVER (PARTITION BY trade_date, sector)')} AS value FROM z""",
)
def _(t):
    return out(xs.pipeline(sectored(t), ["trade_date"]))


@query("k07_fusion_zscore", f"WITH {_V} SELECT trade_date, code, {r('(value - m) / s')} AS value FROM (SELECT *, avg(value) OVER ({_W}) AS m, stddev_samp(value) OVER ({_W}) AS s, count(*) OVER ({_W}) AS n FROM v) WHERE n >= 10")
def _(t):
    return out(xs.fusion_zscore(momentum(t), ["trade_date"]))


@query("k08_industry_zscore", f"WITH {_V} SELECT trade_date, code, {r('CASE WHEN n >= 3 THEN (value - m) / CASE WHEN d < 1e-12 THEN 1 ELSE d END ELSE value END')} AS value FROM (SELECT *, avg(value) OVER p AS m, stddev_samp(value) OVER p AS d, count(*) OVER p AS n FROM s WINDOW p AS (PARTITION BY trade_date, sector))")
def _(t):
    return out(xs.industry_zscore(sectored(t), ["trade_date"]))


@query("k09_min_max", f"WITH {_V} SELECT trade_date, code, {r(f'CASE WHEN max(value) OVER ({_W}) - min(value) OVER ({_W}) > 1e-12 THEN (value - min(value) OVER ({_W})) / (max(value) OVER ({_W}) - min(value) OVER ({_W})) ELSE 0.5 END')} AS value FROM v")
def _(t):
    return out(xs.min_max(momentum(t), ["trade_date"]))


_FACTORS = [("mom_1", 1, -0.03), ("mom_3", 3, -0.08), ("mom_6", 6, -0.06), ("mom_12", 12, -0.05)]


@query(
    "k10_factor_fusion",
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT trade_date, code, '{n}' AS factor, {w} AS weight, value FROM ({_mom(k)}) WHERE value IS NOT NULL" for n, k, w in _FACTORS)
    + f"""), z AS (SELECT trade_date, code, weight, (value - avg(value) OVER p) / stddev_samp(value) OVER p AS z, count(*) OVER p AS n FROM f WINDOW p AS (PARTITION BY trade_date, factor)),
c AS (SELECT trade_date, code, sum(z * weight) AS score, count(*) AS k FROM z WHERE n >= 10 GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT trade_date, code, {r('score')} AS score FROM (SELECT *, count(*) OVER ({_W}) AS m FROM c) WHERE m >= 30""",
)
def _(t):
    w = Window.partitionBy("code").orderBy("trade_date")
    wide = t.monthly.select("trade_date", "code", *[rounded(F.col("close") / F.lag("close", k).over(w) - 1, 9).alias(n) for n, k, _ in _FACTORS])
    z = xs.fusion_zscore(fac.to_long(wide), ["trade_date", "factor"])
    weights = t.spark.createDataFrame([(n, w) for n, _, w in _FACTORS], "factor string, weight double")
    return xs.fuse_factors(z, weights, min_factors=4).select("trade_date", "code", rounded(F.col("score")).alias("score"))


@query(
    "k11_signal_fusion",
    f"""WITH a AS ({_mom(3)}), b AS ({_mom(12)}), x AS (SELECT trade_date, code, value, 0.4 AS w, 'a' AS src FROM a WHERE value IS NOT NULL UNION ALL SELECT trade_date, code, value, 0.3, 'b' FROM b WHERE value IS NOT NULL),
y AS (SELECT trade_date, code, w * CASE WHEN max(value) OVER p - min(value) OVER p > 1e-12 THEN (value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p) ELSE 0.5 END AS s FROM x WINDOW p AS (PARTITION BY src, trade_date))
SELECT trade_date, code, {r('sum(s)')} AS score FROM y GROUP BY 1, 2""",
)
def _(t):
    return xs.fuse_signals([(momentum(t, 3), 0.4), (momentum(t, 12), 0.3)]).select("trade_date", "code", rounded(F.col("score")).alias("score"))


@query("k12_feature_normalise", f"SELECT code, trade_date, {', '.join(r(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()') + ' AS ' + c for c in ('close', 'volume', 'turnover_rate'))} FROM monthly")
def _(t):
    columns = ["close", "volume", "turnover_rate"]
    stats = t.monthly.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = t.monthly.join(F.broadcast(stats), how="cross")
    return z.select("code", "trade_date", *[rounded((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))).alias(c) for c in columns])


@query(
    "k13_time_align",
    """SELECT b.code, b.trade_date, b.close, f.revenue, s.score, i.sector FROM bars b ASOF LEFT JOIN financials f ON b.code = f.code AND b.trade_date >= f.report_date
 LEFT JOIN (SELECT code, max_by(score, trade_date) AS score FROM sentiment GROUP BY 1) s ON b.code = s.code LEFT JOIN industry i ON b.code = i.code""",
)
def _(t):
    rows = rel.as_of(t.bars.select("code", "trade_date", "close"), t.financials, "code", "trade_date", "report_date", ["revenue"])
    mood = t.sentiment.groupBy("code").agg(F.max_by("score", "trade_date").alias("score"))
    return rel.with_sector(rows.join(mood, "code", "left"), t.industry).select("code", "trade_date", "close", "revenue", "score", "sector")


_N = f"WITH {_V}, n AS (SELECT trade_date, code, row_number() OVER ({_W} ORDER BY value DESC, code) AS rk, count(*) OVER ({_W}) AS n FROM v)"


@query("e01_rank_percentile", f"{_N} SELECT trade_date, code, rk AS rank, {r('CASE WHEN n = 1 THEN 0.5 ELSE (rk - 1) / (n - 1.0) END')} AS percentile FROM n")
def _(t):
    w = Window.partitionBy("trade_date")
    n, rk = F.count("*").over(w), F.row_number().over(w.orderBy(F.desc("value"), "code")).cast("long")
    return momentum(t).select("trade_date", "code", rk.alias("rank"), rounded(F.when(n == 1, 0.5).otherwise((rk - 1) / F.nullif(n - 1, F.lit(0)))).alias("percentile"))


@query("e02_percentile_asc", f"WITH {_V} SELECT trade_date, code, {r('(k - 1) / (n - 1.0)')} AS percentile FROM (SELECT *, row_number() OVER ({_W} ORDER BY value, code) AS k, count(*) OVER ({_W}) AS n FROM v) WHERE n >= 2")
def _(t):
    w = Window.partitionBy("trade_date")
    k = momentum(t).withColumns({"k": F.row_number().over(w.orderBy("value", "code")), "n": F.count("*").over(w)})
    return k.where("n >= 2").select("trade_date", "code", rounded((F.col("k") - 1) / (F.col("n") - 1)).alias("percentile"))


@query("e03_cume_rank", f"WITH {_V} SELECT trade_date, code, {r('k / n')} AS percentile, {r('(value - m) / s')} AS z FROM (SELECT *, row_number() OVER ({_W} ORDER BY value, code) AS k, count(*) OVER ({_W}) AS n, avg(value) OVER ({_W}) AS m, stddev_samp(value) OVER ({_W}) AS s FROM v) WHERE n >= 30")
def _(t):
    w = Window.partitionBy("trade_date")
    k = momentum(t).withColumns({"k": F.row_number().over(w.orderBy("value", "code")), "n": F.count("*").over(w), "m": F.avg("value").over(w), "s": F.stddev_samp("value").over(w)})
    return k.where("n >= 30").select("trade_date", "code", rounded(F.col("k") / F.col("n")).alias("percentile"), rounded((F.col("value") - F.col("m")) / F.col("s")).alias("z"))


@query("e15_industry_cap", f"WITH {_V} SELECT trade_date, code, sector FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, sector ORDER BY value DESC, code) AS k FROM s) WHERE k <= 3")
def _(t):
    return rel.top_per(sectored(t), ["trade_date", "sector"], [F.desc("value"), F.col("code")], 3).select("trade_date", "code", "sector")


@query("n07_signals", f"{_N} SELECT trade_date, code, CASE WHEN (rk - 1) / greatest(n - 1.0, 1) <= 0.1 THEN 'BUY' WHEN (rk - 1) / greatest(n - 1.0, 1) >= 0.9 THEN 'SELL' WHEN code % 2 = 0 AND (rk - 1) / greatest(n - 1.0, 1) >= 0.8 THEN 'SELL' ELSE 'HOLD' END AS signal FROM n")
def _(t):
    w = Window.partitionBy("trade_date")
    p = (F.row_number().over(w.orderBy(F.desc("value"), "code")) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    held = F.col("code") % 2 == 0
    return momentum(t).select("trade_date", "code", F.when(p <= 0.1, "BUY").when(p >= 0.9, "SELL").when(held & (p >= 0.8), "SELL").otherwise("HOLD").alias("signal"))
