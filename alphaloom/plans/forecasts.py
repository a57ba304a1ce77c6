"""Queries of special functions, forecast tests, sizes, users' functions and the typed graph."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.functions import special as sp
from alphaloom.functions.scalar import rounded
from alphaloom.operators import actuarial as act
from alphaloom.operators import engines as eng
from alphaloom.operators import forecasts as fc
from alphaloom.operators import typed_graph as tg
from alphaloom.plans.graph_text import _peers
from alphaloom.plans.registry import query, r
from alphaloom.plans.risk import _N08, equal, held
from alphaloom.operators import risk


@query("h06_inverse_normal", f"SELECT vec_id, {r('embedding[1]::DOUBLE * 12')} AS z FROM embeddings")
def _(t):
    """The quantile of the probability of each value is the value."""
    z = F.col("embedding")[0].cast("double") * 12
    return t.read("embeddings").select("vec_id", rounded(sp.inverse_normal(sp.normal_cdf(z))).alias("z"))


def _simpson(f: str, end: str, n: int = 400) -> str:
    """The integral of f (of y) from 0 to end, over n steps."""
    return f"({end}) / {3 * n} * list_sum(list_transform(generate_series(0, {n}), lambda g: (CASE WHEN g % {n} = 0 THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END) * {f.replace('y', f'(({end}) * g / {n}.0::DOUBLE)')}))"


@query("h07_chi2", f"SELECT vec_id, {r('1 - ' + _simpson('2 * power(y, k - 1) * exp(-y * y / 2)', 'sqrt(x)') + ' / (power(2.0::DOUBLE, k / 2.0) * gamma(k / 2.0))')} AS p FROM (SELECT vec_id, vec_id % 6 + 1 AS k, abs(embedding[2]::DOUBLE) * 40 AS x FROM embeddings)")
def _(t):
    """Survival functions of one to six degrees of freedom."""
    return t.read("embeddings").select("vec_id", rounded(sp.chi2_sf(F.abs(F.col("embedding")[1].cast("double")) * 40, F.col("vec_id") % 6 + 1)).alias("p"))


@query("h08_student_t", f"SELECT vec_id, {r('0.5 + ' + _simpson('power(cos(y), n - 1)', 'atan(x / sqrt(n))') + ' * exp(lgamma((n + 1) / 2.0) - lgamma(n / 2.0)) / sqrt(pi())')} AS p FROM (SELECT vec_id, vec_id % 30 + 1 AS n, embedding[3]::DOUBLE * 15 AS x FROM embeddings)")
def _(t):
    return t.read("embeddings").select("vec_id", rounded(sp.t_cdf(F.col("embedding")[2].cast("double") * 15, F.col("vec_id") % 30 + 1)).alias("p"))


_FC = f"""SELECT * FROM (SELECT code, trade_date, ret, avg(ret) OVER w AS mean, stddev_samp(ret) OVER w AS sd, count(*) OVER w AS n FROM (SELECT code, trade_date, ln(1 + ret) AS ret FROM daily_returns) WINDOW w AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE n = 60 AND sd > 0"""


def _forecast(t):
    """Forecasts of logarithmic returns, whose losses are not bounded by one."""
    return fc.rolling_forecasts(t.daily_returns.select("code", "trade_date", F.log1p("ret").alias("ret")))


@query("m40_tail_statistic", f"SELECT code, count(*) AS n, {r(f'sum(CASE WHEN -ret > {fc.Z95} * sd - mean AND {fc.TAIL95} * sd - mean > 0 THEN -ret / ({fc.TAIL95} * sd - mean) ELSE 0 END) / (count(*) * 0.05::DOUBLE) - 1')} AS z FROM ({_FC}) GROUP BY 1")
def _(t):
    """Acerbi and Szekely's statistic of rolling forecasts."""
    f = _forecast(t)
    hit = (-F.col("ret") > F.col("var")) & (F.col("es") > 0)
    return f.groupBy("code").agg(F.count("*").alias("n"), rounded(F.sum(F.when(hit, -F.col("ret") / F.col("es")).otherwise(0.0)) / (F.count("*") * 0.05) - 1).alias("z"))


@query("m40_acerbi_szekely", None)
def _(t):
    """The statistic with its p-value by 5,000 orders of the losses."""
    return fc.acerbi_szekely(_forecast(t))


def _by_series(name: str, test, columns: list[str]) -> None:
    """test(rows of rolling forecasts) of each code with 30 of them."""

    @query(name, None)
    def _(t):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            if len(pdf) < 30:
                return pd.DataFrame(columns=["code", *columns])
            out = test(pdf.sort_values("trade_date"))
            return pd.DataFrame({"code": [pdf.code.iloc[0]], **{c: [float(out[c])] for c in columns}})

        return _forecast(t).groupBy("code").applyInPandas(run, "code long, " + ", ".join(f"{c} double" for c in columns))


_by_series("m40_dynamic_quantile", lambda x: eng.dynamic_quantile((-x.ret > x["var"]).to_numpy(float), x["var"].to_numpy(), 0.95), ["dq", "p"])
_by_series("m40_berkowitz", lambda x: eng.berkowitz(eng.norm_cdf(((x.ret - x["mean"]) / x.sd).to_numpy())), ["lr", "p"])


@query("m27_optimal_size", None)
def _(t):
    """The position of highest expected wealth with ruin of a hundredth at most, by resampled paths."""
    return eng.by_code(t.daily_returns, fc.optimal_size, ["size", "most", "ruin", "wealth", "growth"], least=60)


@query("m27_conditional_ruin", None)
def _(t):
    """Ruin by horizon from resampled paths, given that the first thirty days were survived."""
    ruin = eng.by_code(t.daily_returns, eng.ruin, [f"ruin_{h}" for h in eng.HORIZONS], least=60)
    at = ruin.select("code", F.explode(F.array(*[F.struct(F.lit(h).alias("period"), F.col(f"ruin_{h}").alias("ruin")) for h in eng.HORIZONS])).alias("x"))
    return act.survived(at.select("code", "x.period", "x.ruin"), 30)


def _mad(x: np.ndarray) -> np.ndarray:
    """Of each row."""
    return np.median(np.abs(x - np.median(x, axis=1, keepdims=True)), axis=1)


_U6 = "(PARTITION BY code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("u06_rolling_callback", f"SELECT code, trade_date, {r(f'CASE WHEN count(*) OVER {_U6} = 20 THEN mad(close) OVER {_U6} END')} AS mad FROM bars")
def _(t):
    """A user's median absolute deviation over twenty bars."""
    out = fc.rolling(t.bars.select("code", "trade_date", "close"), "close", _mad, 20, "mad", many=True)
    return out.select("code", "trade_date", rounded(F.col("mad")).alias("mad"))


def _log_excess(volume: float) -> float:
    return math.log(volume - 30)


@query("u02_row_results", f"SELECT code, count(*) AS n, count_if(volume <= 30) AS failed, {r('avg(ln(volume - 30)) FILTER (volume > 30)')} AS mean FROM bars GROUP BY 1")
def _(t):
    """A user's function of every bar: those on which it raises are counted and stop no others."""
    out = fc.result_counts(fc.row_results(t.bars.select("code", F.col("volume").cast("double").alias("volume")), _log_excess, "volume"), "code")
    return out.select("code", "n", "failed", rounded(F.col("mean")).alias("mean"))


_SUPPLY = [("FRANCE", "GERMANY"), ("CHINA", "JAPAN"), ("CHINA", "VIETNAM"), ("BRAZIL", "PERU"), ("INDIA", "CHINA"), ("JAPAN", "CHINA"), ("EGYPT", "KENYA")]


@query(
    "q01_typed_graph",
    f"""WITH {_peers(20)}, fund AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS code FROM lineitem JOIN industry ON code = l_suppkey), concept AS (SELECT DISTINCT l_partkey AS g, l_suppkey AS code FROM lineitem JOIN industry ON code = l_suppkey),
e AS (SELECT 'supply_chain' AS kind, a.code AS src, b.code AS dst FROM industry a JOIN (VALUES {', '.join(map(str, _SUPPLY))}) c(up, down) ON a.sector = up JOIN industry b ON b.sector = down
UNION SELECT 'same_industry', src, dst FROM peers UNION SELECT 'co_holding', a.code, b.code FROM fund a JOIN fund b ON a.g = b.g AND a.code < b.code UNION SELECT 'concept', a.code, b.code FROM concept a JOIN concept b ON a.g = b.g AND a.code < b.code)
SELECT kind, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY kind, least(src, dst), greatest(src, dst) ORDER BY src) AS k FROM e) WHERE k = 1""",
)
def _(t):
    """Edges of four kinds in one plan: nations that supply others, industries, orders as funds, and parts as concepts."""
    li = t.read("lineitem")
    supply = t.spark.createDataFrame(_SUPPLY, "up string, down string")
    return tg.build(t.industry.select("code"), t.industry, supply, li.select(F.col("l_orderkey").alias("fund"), F.col("l_suppkey").alias("code")), li.select(F.col("l_partkey").alias("concept"), F.col("l_suppkey").alias("code")))


@query("f06_rebalance_order", f"SELECT code, side, amount, row_number() OVER (ORDER BY amount DESC, code) AS place FROM ({_N08}) WHERE side <> 'hold'")
def _(t):
    """Trades of a rebalancing, the largest amounts first."""
    d = risk.rebalance(*(f(t.industry).withColumnRenamed("w", "weight") for f in (equal, held)), 1_000_000.0).where("side <> 'hold'")
    d = d.select("code", "side", rounded(F.col("amount"), 2).alias("amount"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("amount"), "code")).cast("long"))
