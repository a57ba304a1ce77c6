"""Queries of sequential engines and of streams."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from alphaloom.functions.scalar import rounded
from alphaloom.operators import backtests as bt
from alphaloom.operators import copulas as cop
from alphaloom.operators import dependence as dep
from alphaloom.operators import engines as eng
from alphaloom.operators import relational as rel
from alphaloom.plans.crosssection import _mom, momentum
from alphaloom.plans.registry import query, r
from alphaloom.session import new_dir
from alphaloom.plans.risk import against_market, monthly
from alphaloom.streaming import events as st
from alphaloom.streaming import state


def _fit(name: str, fit, columns: list[str], least: int, source: str = "daily_returns", many: int = 0) -> None:
    @query(name, None)
    def _(t):
        return eng.by_code(getattr(t, source), fit, columns, least=least, many=many)


_fit("m01_gpd_mle", eng.gpd_mle, ["threshold", "xi", "beta", "loglik", "var_99", "se_xi"], 100)
_fit("m08_gev_fit", eng.gev_pwm, ["xi", "sigma", "mu", "return_level_100", "blocks"], 210)
_fit("m25_ruin_monte_carlo", eng.ruin, [f"ruin_{h}" for h in eng.HORIZONS], 60)
_fit("m41_garch", eng.garch, ["alpha", "beta", "omega", "forecast_vol", "loglik"], 60)
_fit("m41_egarch", eng.egarch, ["alpha", "gamma", "beta", "loglik"], 60)
_fit("m42_hmm_regimes", eng.hmm_many, ["regime", "low_mean", "high_mean", "stay", "loglik"], 100, many=256)


#: Figures of a fitted copula.
FIT = ["tau", "family", "theta", "nu", "loglik", "aic", "lower_tail", "upper_tail"]


def _pairwise(name: str, fit, columns: list[str]) -> None:
    """fit(x, y) of each code's monthly returns and the market's."""

    @query(name, None)
    def _(t):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t")
            out = fit(pdf.x.to_numpy(), pdf.y.to_numpy())
            return pd.DataFrame({"code": [pdf.code.iloc[0]], **{c: [float(out[c])] for c in columns}})

        return against_market(t).groupBy("code").applyInPandas(run, "code long, " + ", ".join(f"{c} double" for c in columns))


_pairwise("m13_copula_fit", lambda x, y: cop.copula(cop.ranks(x), cop.ranks(y), float(np.corrcoef(x, y)[0, 1])), FIT)
_pairwise("m20_dcc_garch", eng.dcc, ["last_corr", "mean_corr", "loglik"])


@query("m20_dcc_books", None)
def _(t):
    """Each book's dynamic correlations: the last and mean one of every pair, and the criterion of the joint t."""
    f = dep.dcc_fits(_books(t))
    at = lambda c: F.get(c, F.col("i") * F.size("codes") + F.col("j"))
    i = f.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("codes") - 1)))
    pairs = i.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("codes") - 1))).where("i < j")
    return pairs.select("book", F.get("codes", F.col("i")).alias("a"), F.get("codes", F.col("j")).alias("b"), at("last").alias("last_corr"), at("mean").alias("mean_corr"), "nu", "loglik", "t_loglik", "aic")


@query("m20_dcc_tail_loss", None)
def _(t):
    """The next month's tail loss of each book by 10,000 draws through its last correlations."""
    return dep.dcc_tail_loss(dep.dcc_fits(_books(t)))


@query("m17_copula_simulation", None)
def _(t):
    """A thousand scenarios of each book's returns from its best copula."""
    return dep.copula_scenarios(dep.copula_fits(_books(t)).where("place = 1"), 1_000)


@query("m33_covariance_scenarios", None)
def _(t):
    """A thousand scenarios of each book from its shrunk covariances."""
    return dep.covariance_scenarios(dep.covariance_fits(_books(t)))


@query("m19_compare_families", None)
def _(t):
    """Every family fitted to each book, its criterion, and the tail loss of 10,000 draws of it."""
    return dep.copula_tail_loss(dep.copula_fits(_books(t)))


@query("m32_reserve_bootstrap", None)
def _(t):
    """A thousand resamples of the triangle, spread over tasks."""
    return eng.reserve_bootstrap(t.triangle)


@query("m43_kalman_weights", None)
def _(t):
    """Weights of three momentum exposures for each region's mean return, updated month by month."""
    w = momentum(t, 1).withColumnRenamed("value", "a").join(momentum(t, 3).withColumnRenamed("value", "b"), ["trade_date", "code"]).join(momentum(t, 6).withColumnRenamed("value", "c"), ["trade_date", "code"])
    rows = w.join(t.returns.where("fwd IS NOT NULL").select("trade_date", "code", "fwd"), ["trade_date", "code"]).join(t.industry.select("code", "region"), "code")
    monthly_means = rows.groupBy("region", "trade_date").agg(*[F.avg(c).alias(c) for c in ("a", "b", "c", "fwd")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date")
        x, v = eng.kalman(pdf[["a", "b", "c"]].to_numpy(), pdf.fwd.to_numpy())
        return pd.DataFrame({"region": pdf.region.iloc[0], "factor": ["a", "b", "c"], "weight": x, "variance": v})

    return monthly_means.groupBy("region").applyInPandas(run, "region string, factor string, weight double, variance double")


def _books(t):
    """Monthly returns with a column book: codes in groups of ten."""
    return monthly(t).withColumn("book", F.floor(F.col("code") / 10).cast("long"))


def _allocation(name: str, solve, many: bool = False) -> None:
    @query(name, None)
    def _(t):
        return eng.allocate(_books(t), "book", solve, many)


def _optimal(books: list[np.ndarray], expected) -> np.ndarray:
    """Weights of books of one size, for the returns that expected(returns, covariances) gives."""
    cov = [eng.shrunk_covariance(x) for x in books]
    return eng.mean_variances(np.array([expected(x, c) for x, c in zip(books, cov)]), np.array(cov), cap=0.3)


def _with_view(x: np.ndarray, cov: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    return eng.black_litterman(cov, np.full(n, 1 / n), np.eye(n)[:1], np.array([0.02]))


_allocation("n04_mean_variance", lambda books: _optimal(books, lambda x, _: x.mean(0)), many=True)
_allocation("n06_hrp", eng.hrp)
_allocation("n03_black_litterman", lambda books: _optimal(books, _with_view), many=True)


_GRID = [(n, k) for n in (10, 20, 30, 40, 50) for k in (5, 10, 20, 40, 60)]


def _searched(t):
    """25 experiments over all months, and over the test windows of purged folds."""
    grid = t.spark.createDataFrame(_NAMED, "experiment string, top int, every int")
    n = t.monthly.select("trade_date").distinct().count()
    prices = t.monthly.select("trade_date", "code", "close")
    return bt.paths(prices, momentum(t), bt.runs_of(grid, bt.purged_folds(n), n - 1))


_D = {k: f"{v!r}::DOUBLE" for k, v in {"buy": 1.0001, "sell": 0.9999, "fee": 0.0003, "gross": 1.0003, "stamp": 0.001}.items()}


def _paths_sql(grid: list[tuple[str, int, int]]) -> str:
    """Paths by recursion over rebalancing dates: a step's cash, its whole lots, and what they sell for at the next one.

    list x: a pick's price when bought (1) and when sold (2); cash and m belong to the step.
    """
    lots = f"floor(cash / m / (x[1] * {_D['buy']} * {_D['gross']}))"
    cost = f"({lots} * x[1] * {_D['buy']} + greatest({lots} * x[1] * {_D['buy']} * {_D['fee']}, 5.0::DOUBLE))"
    sold = f"({lots} * x[2] * {_D['sell']})"
    gain = f"({sold} - greatest({sold} * {_D['fee']}, 5.0::DOUBLE) - {sold} * {_D['stamp']})"
    each = lambda e: f"list_sum(list_transform(list_zip(p, q), lambda x: CASE WHEN {lots} > 0 THEN {e} ELSE 0.0::DOUBLE END))"
    return f"""WITH RECURSIVE dt AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS k FROM (SELECT DISTINCT trade_date FROM monthly)), ml AS (SELECT code, k, close FROM monthly JOIN dt USING (trade_date)),
sg AS (SELECT ml.k, ml.code, ml.close, row_number() OVER (PARTITION BY ml.k ORDER BY v.value DESC, ml.code) AS place FROM ({_mom()}) v JOIN dt USING (trade_date) JOIN ml ON ml.code = v.code AND ml.k = dt.k WHERE v.value IS NOT NULL),
xp(experiment, top, every) AS (VALUES {', '.join(f"('{e}', {n}, {k})" for e, n, k in grid)}),
du AS (SELECT experiment, top, k, row_number() OVER w AS step, coalesce(lead(k) OVER w, (SELECT max(k) FROM dt)) AS until, lead(k) OVER w AS next FROM xp, (SELECT DISTINCT k FROM sg) s WHERE k % every = 0 WINDOW w AS (PARTITION BY experiment ORDER BY k)),
pk AS (SELECT du.*, sg.code, sg.close FROM du JOIN sg ON du.k = sg.k AND sg.place <= du.top), sl AS (SELECT pk.*, ml.close AS later FROM pk ASOF JOIN ml ON pk.code = ml.code AND pk.until >= ml.k),
ls AS (SELECT experiment, step, k, any_value(next) AS next, count(*) AS m, list(close ORDER BY code) AS p, list(later ORDER BY code) AS q, list(code ORDER BY code) AS c FROM sl GROUP BY 1, 2, 3),
rc AS (SELECT experiment, 1::BIGINT AS step, 1000000.0::DOUBLE AS cash FROM xp
 UNION ALL SELECT rc.experiment, rc.step + 1, cash + {each(f'{gain} - {cost}')} FROM rc JOIN ls ON rc.experiment = ls.experiment AND rc.step = ls.step WHERE next IS NOT NULL),
st AS (SELECT ls.*, cash, cash - {each(cost)} AS rest, {each(f"{lots} * x[1] * {_D['buy']}")} AS bought, {each(sold)} AS sales FROM rc JOIN ls ON rc.experiment = ls.experiment AND rc.step = ls.step),
hd AS (SELECT experiment, step, k, next, unnest(c) AS code, unnest(list_transform(list_zip(p, q), lambda x: CASE WHEN {lots} > 0 THEN {lots} ELSE 0.0::DOUBLE END)) AS n FROM st),
dy AS (SELECT hd.*, dt.k AS at FROM hd JOIN dt ON dt.k >= hd.k AND dt.k < coalesce(hd.next, 1000000)), vl AS (SELECT dy.experiment, dy.at, dy.step, sum(n * ml.close) AS v FROM dy ASOF JOIN ml ON dy.code = ml.code AND dy.at >= ml.k GROUP BY 1, 2, 3)
SELECT xp.experiment, dt.trade_date, {r('coalesce(st.rest + vl.v, 1000000.0::DOUBLE)', 2)} AS equity, {r('CASE WHEN st.k = dt.k THEN bought + coalesce((SELECT sales FROM st b WHERE b.experiment = st.experiment AND b.step = st.step - 1), 0) ELSE 0 END', 2)} AS turnover
FROM xp CROSS JOIN dt LEFT JOIN vl ON vl.experiment = xp.experiment AND vl.at = dt.k LEFT JOIN st ON st.experiment = xp.experiment AND st.step = vl.step"""


def _whole_paths(t, grid):
    n = t.monthly.select("trade_date").distinct().count()
    runs = bt.runs_of(t.spark.createDataFrame(grid, "experiment string, top int, every int"), [], n - 1)
    out = bt.paths(t.monthly.select("trade_date", "code", "close"), momentum(t), runs)
    return out.select("experiment", "trade_date", rounded(F.col("equity"), 2).alias("equity"), rounded(F.col("turnover"), 2).alias("turnover"))


_NAMED = [(f"top{n}_every{k}", n, k) for n, k in _GRID]


@query("o01_backtest", _paths_sql([("base", 10, 3)]))
def _(t):
    """One experiment's path over all months: the ten highest momenta, every third."""
    return _whole_paths(t, [("base", 10, 3)])


@query("o13_grid_paths", _paths_sql(_NAMED))
def _(t):
    """The paths of the grid's 25 experiments over all months."""
    return _whole_paths(t, _NAMED)


@query("o13_grid_search", None)
def _(t):
    """The grid's experiments, validated by purged folds, in the order of their mean sharpe."""
    return bt.grid_search(_searched(t))


@query("p01_order_fills", None)
def _(t):
    orders = t.bars.select("code", "trade_date", F.when(F.dayofyear("trade_date") % 3 == 0, -1000).otherwise(700).alias("quantity"), (F.col("volume") * 100).alias("volume"))
    return eng.fill_orders(orders)


@query("p11_circuit_breaker", None)
def _(t):
    return eng.breaker_path(t.daily_returns)


def _stream(t):
    return st.read_events(t.spark, f"{t.sf_dir}/events*.parquet")


def _shared(t) -> str:
    return new_dir(t.spark, "streams")


@query("s01_stream_tumbling", f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, {r('sum(value)', 4)} AS total FROM events GROUP BY 1, 2")
def _(t):
    out = st.run_to_table(st.tumbling(_stream(t)), _shared(t), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded(F.col("total"), 4).alias("total"))


@query("s05_stream_dedupe", "SELECT event_id, event_type FROM events")
def _(t):
    """Each event sent twice comes out once."""
    e = _stream(t)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return st.run_to_table(st.without_duplicates(twice, ["event_id"], late="365 days").select("event_id", "event_type"), _shared(t), "append")


@query("s07_stream_breaker", None)
def _(t):
    """A breaker for each user, forgotten after thirty idle days."""
    out = st.run_to_table(state.breakers(_stream(t)), _shared(t), "append")
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "state")


_KEY = "PARTITION BY user_id, event_type ORDER BY ts, event_id"


@query(
    "s08_ttl_state",
    f"""WITH l AS (SELECT *, lag(ts) OVER ({_KEY}) AS pt, lag(value) OVER ({_KEY}) AS pv FROM events), h AS (SELECT *, coalesce(epoch_ms(ts) - epoch_ms(pt) <= 172800000, false) AS hit FROM l),
g AS (SELECT *, sum((NOT hit)::INTEGER) OVER ({_KEY}) AS grp FROM h)
SELECT user_id, event_type, event_id, ts, hit, CASE WHEN hit THEN pv END AS previous, (row_number() OVER (PARTITION BY user_id, event_type, grp ORDER BY ts, event_id) - 1)::INTEGER AS hits FROM g""",
)
def _(t):
    """A stream of events over keyed last values that live for two days: whether each found its key, and what it held."""
    out = st.run_to_table(state.last_values(_stream(t), "2 days"), _shared(t), "append")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
