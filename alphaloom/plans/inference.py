"""Queries of tail intervals and comparisons, copulas of many codes, ranking losses, allocations within risk limits,
validation of several factors at once, and graph scores by date."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.functions.scalar import rounded
from alphaloom.operators import copulas as cop
from alphaloom.operators import engines as eng
from alphaloom.operators import graph, ranking, risk, tails
from alphaloom.operators import validation as val
from alphaloom.plans.graph_text import _peers, _weights
from alphaloom.plans.registry import query, r
from alphaloom.plans.risk import _GPD, against_market, monthly
from alphaloom.plans.stateful import FIT, _books, _fit
from alphaloom.plans.validation import all_ics

_fit("m02_profile_ci", tails.profile_intervals, [f"{k}{s}" for k in ("xi", "beta", "var") for s in ("", "_low", "_high")], 100)

#: Levels and the normal quantiles at them.
LEVELS = {0.95: 1.645, 0.99: 2.326, 0.999: 3.090}
_DENSITY = {k: math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (1 - k) for k, z in LEVELS.items()}


def _gev_tail(x: np.ndarray) -> dict[str, float]:
    """Quantiles of block maxima, and their mean over a hundred probabilities from the level to 0.9999."""
    g = eng.gev_pwm(x)
    at = lambda p: g["mu"] - g["sigma"] / g["xi"] * (1 - (-np.log(p)) ** -g["xi"])
    out = {}
    for k, level in enumerate(LEVELS):
        out |= {f"v{k}": float(at(level)), f"e{k}": float(at(level + np.arange(100) * (0.9999 - level) / 100).mean())}
    return out


_LEVEL_ROWS = ", ".join(f"({k}, {z}, {_DENSITY[k]!r})" for k, z in LEVELS.items())


@query(
    "m06_compare_models",
    f"""WITH l(level, z, d) AS (SELECT a::DOUBLE, b::DOUBLE, c::DOUBLE FROM (VALUES {_LEVEL_ROWS}) v(a, b, c)), {_GPD}, s AS (SELECT code, avg(-ret) AS m, stddev_samp(ret) AS sd FROM daily_returns GROUP BY 1 HAVING count(*) >= 210),
h AS (SELECT code, level, max(CASE WHEN i = least(floor(n * level + 1e-9), n - 1) + 1 THEN x END) OVER (PARTITION BY code, level) AS v, x FROM x, l),
b AS (SELECT code, loss AS x, row_number() OVER (PARTITION BY code ORDER BY loss) AS i, count(*) OVER (PARTITION BY code) AS n FROM (SELECT code, max(-ret) AS loss FROM (SELECT code, ret, floor((row_number() OVER (PARTITION BY code ORDER BY trade_date) - 1) / 21) AS block FROM daily_returns) GROUP BY code, block HAVING count(*) = 21)),
w AS (SELECT code, avg(x) AS b0, sum(x * (i - 1)) / max(n) / greatest(max(n) - 1, 1) AS b1, sum(x * (i - 1) * (i - 2)) / max(n) / greatest(max(n) - 1, 1) / greatest(max(n) - 2, 1) AS b2 FROM b GROUP BY 1),
c AS (SELECT *, (2 * b1 - b0) / (3 * b2 - b0) - ln(2) / ln(3) AS c FROM w), k AS (SELECT *, CASE WHEN abs(least(greatest(7.859 * c + 2.9554 * c * c, -0.5), 0.5)) > 1e-6 THEN least(greatest(7.859 * c + 2.9554 * c * c, -0.5), 0.5) ELSE 1e-6 END AS k FROM c),
g AS (SELECT code, k, (2 * b1 - b0) * k / (gamma(1 + k) * (1 - power(2, -k))) AS sigma, b0 + (2 * b1 - b0) / (1 - power(2, -k)) * (gamma(1 + k) - 1) / gamma(1 + k) AS mu FROM k),
o AS (SELECT code, level, 'normal' AS model, m + z * sd AS v, m + d * sd AS e FROM s, l
UNION ALL SELECT code, level, 'historical', max(v), avg(x) FROM h WHERE x >= v AND code IN (SELECT code FROM s) GROUP BY 1, 2
UNION ALL SELECT code, level, 'gpd', v, CASE WHEN xi < 1 THEN (v + beta - xi * threshold) / (1 - xi) END FROM (SELECT *, threshold + beta / xi * (power(n / excesses * (1 - level), -xi) - 1) AS v FROM f, l) WHERE code IN (SELECT code FROM s)
UNION ALL SELECT code, level, 'gev', mu + sigma / k * (1 - power(-ln(level), k)), (SELECT avg(mu + sigma / k * (1 - power(-ln(level + j * (0.9999 - level) / 100), k))) FROM generate_series(0, 99) q(j)) FROM g, l WHERE code IN (SELECT code FROM s))
SELECT code, level, model, {r('v', 4)} AS var, {r('e', 4)} AS es FROM o""",
)
def _(t):
    """Value at risk and expected shortfall by level and model, of codes with 210 returns or more; all are losses."""
    x = t.daily_returns.select("code", "trade_date", "ret")
    w = Window.partitionBy("code")
    ranked = x.select("code", (-F.col("ret")).alias("x")).withColumns({"i": F.row_number().over(w.orderBy("x")), "n": F.count("*").over(w)}).where("n >= 210")
    moments = ranked.groupBy("code").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(z).alias("z"), F.lit(_DENSITY[k]).alias("d")) for k, z in LEVELS.items()])).alias("l")
    normal = moments.select("*", levels).select("code", "l.level", F.lit("normal").alias("model"), (F.col("m") + F.col("l.z") * F.col("sd")).alias("var"), (F.col("m") + F.col("l.d") * F.col("sd")).alias("es"))
    at = lambda level: F.least(F.floor(F.col("n") * level + 1e-9), F.col("n") - 1) + 1
    # losses from the quantile on: it is the least of those at its place or later, and equal losses before it count too
    past = ranked.withColumns({f"v{k}": F.max(F.when(F.col("i") == at(level), F.col("x"))).over(w) for k, level in enumerate(LEVELS)})
    hist = past.groupBy("code").agg(*[a for k in range(len(LEVELS)) for a in (F.max(f"v{k}").alias(f"v{k}"), F.avg(F.when(F.col("x") >= F.col(f"v{k}"), F.col("x"))).alias(f"e{k}"))])
    gev = eng.by_code(x, _gev_tail, [f"{c}{k}" for k in range(len(LEVELS)) for c in "ve"], least=210)

    def long(wide, model):
        rows = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"v{k}").alias("var"), F.col(f"e{k}").alias("es")) for k, level in enumerate(LEVELS)])).alias("l")
        return wide.select("code", rows).select("code", "l.level", F.lit(model).alias("model"), "l.var", "l.es")

    fit = risk.gpd_pwm(t.daily_returns, least=210)
    out = normal.unionByName(long(hist, "historical")).unionByName(long(gev, "gev"))
    for level in LEVELS:
        out = out.unionByName(risk.tail_var(fit, level).select("code", F.lit(level).alias("level"), F.lit("gpd").alias("model"), "var", "es"))
    return out.select("code", "level", "model", rounded(F.col("var"), 4).alias("var"), rounded(F.col("es"), 4).alias("es"))


def _pair_fits(t):
    """book, a, b and the best copula of the monthly returns of each two codes of a book, over 30 or more common dates."""
    m = _books(t).select("book", "trade_date", "code", "ret")
    kind = dict(m.dtypes)["code"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="trade_date", columns="code", values="ret")
        codes, found = wide.columns, cop.pair_copulas(wide.to_numpy(float))
        return pd.DataFrame([[pdf.book.iloc[0], codes[i], codes[j], *(got[c] for c in FIT)] for i, j, got in found], columns=["book", "a", "b", *FIT])

    return m.groupBy("book").applyInPandas(run, f"book long, a {kind}, b {kind}, " + ", ".join(f"{c} double" for c in FIT))


@query("m15_pair_copulas", None)
def _(t):
    return _pair_fits(t)


@query("m15_multi_copula", None)
def _(t):
    """Each book's likelihood and criterion over all its pairs, with one parameter more for each pair than its family has."""
    f = _pair_fits(t)
    extra = F.when(F.col("family") == cop.FAMILIES.index("t"), 3).otherwise(2)
    sums = f.groupBy("book").agg(F.count("*").alias("pairs"), F.sum("loglik").alias("loglik"), F.sum(extra).alias("params"), F.avg("lower_tail").alias("lower_tail"), F.avg("upper_tail").alias("upper_tail"))
    return sums.withColumn("aic", 2 * F.col("params") - 2 * F.col("loglik"))


@query("m16_copula_fit_test", None)
def _(t):
    """Each code against the market: the fitted family and its test by 200 resamples."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 30:
            return pd.DataFrame(columns=["code", "family", "cvm", "p"])
        pdf = pdf.sort_values("t")
        u, v = cop.ranks(pdf.x.to_numpy()), cop.ranks(pdf.y.to_numpy())
        got = cop.copula(u, v, float(np.corrcoef(pdf.x, pdf.y)[0, 1]))
        name = cop.FAMILIES[int(got["family"])]
        test = cop.goodness_of_fit(name, got["theta"], got["nu"] or math.inf, u, v)
        return pd.DataFrame({"code": [pdf.code.iloc[0]], "family": [name], "cvm": [test["cvm"]], "p": [test["p"]]})

    # resamples are dear where rows are few: a stated number of partitions is not merged into fewer, and the hash is a key
    # of its own, as an exchange by a key that rows lie by already would be left out
    spread = against_market(t).withColumn("h", F.xxhash64("code")).repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "h")
    return spread.groupBy("h", "code").applyInPandas(run, "code long, family string, cvm double, p double")


@query("h13_cholesky", None)
def _(t):
    """Lower factors of the books' shrunk covariances: book, i, j, value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="trade_date", columns="code", values="ret").dropna()
        if len(wide) < 12 or wide.shape[1] < 2:
            return pd.DataFrame(columns=["book", "i", "j", "value"])
        low = ranking.cholesky(eng.shrunk_covariance(wide.to_numpy()))
        i, j = np.tril_indices(len(low))
        return pd.DataFrame({"book": pdf.book.iloc[0], "i": wide.columns[i].astype("int64"), "j": wide.columns[j].astype("int64"), "value": low[i, j]})

    return _books(t).select("book", "code", "trade_date", "ret").groupBy("book").applyInPandas(run, "book long, i long, j long, value double")


def risk_integrated(x: np.ndarray, picks: np.ndarray, views: np.ndarray, ruin_limit: float = 0.1, equity_share: float = 1.0) -> np.ndarray:
    """Weights for the equilibrium returns, moved by views on picks, within limits from the generalised Pareto tail of all the book's returns.

    A code holds at most the least of 0.15 / (2 VaR) between 0.02 and 0.15, the ruin limit and 0.15 of the equity share,
    and 0.01 at least; together they hold that times their number, 0.95 at most. All are scaled down where 2.326
    deviations of the book exceed the 99 % VaR. With under 50 returns the VaR is taken as 0.08.
    """
    losses = x.ravel()
    cov = eng.shrunk_covariance(x)
    n = x.shape[1]
    var = eng.gpd_mle(losses)["var_99"] if len(losses) >= 50 else 0.08
    single = max(0.01, min(min(max(0.15 / (2 * var), 0.02), 0.15) if var > 0 else 0.15, ruin_limit, 0.15 * equity_share))
    total = min(single * n, 0.95)
    w = total * eng.mean_variance(eng.black_litterman(cov, np.full(n, 1 / n), picks, views), cov, cap=single / total)
    spread = 2.326 * math.sqrt(w @ cov @ w)
    return w * min(1.0, var / spread) if var > 0 else w


@query("n05_risk_integrated", None)
def _(t):
    """A view of 2 % a month on the first code of each book."""
    return eng.allocate(_books(t), "book", lambda x: risk_integrated(x, np.eye(x.shape[1])[:1], np.array([0.02])))


_LABELS = """p AS (SELECT trade_date, code, round(close / lag(close, 6) OVER (PARTITION BY code ORDER BY trade_date) - 1, 9) AS value, round(lead(close) OVER (PARTITION BY code ORDER BY trade_date) / close - 1, 9) AS fwd FROM monthly),
q AS (SELECT trade_date, code, value, (ntile(5) OVER (PARTITION BY trade_date ORDER BY fwd, code) - 1) AS label FROM p WHERE value IS NOT NULL AND fwd IS NOT NULL),
k AS (SELECT *, power(2.0, label) AS g, row_number() OVER (PARTITION BY trade_date ORDER BY value DESC, code) AS a, row_number() OVER (PARTITION BY trade_date ORDER BY label DESC, code) AS b FROM q),
i AS (SELECT trade_date, coalesce(sum((g - 1) / log2(b + 1)) FILTER (b <= 5), 0) AS ideal, coalesce(sum((g - 1) / log2(a + 1)) FILTER (a <= 5), 0) AS seen FROM k GROUP BY 1)"""


def labelled(t):
    """Six-month momentum, and the fifth (0 to 4) of the next month's return as label."""
    w = Window.partitionBy("code").orderBy("trade_date")
    p = t.monthly.select("trade_date", "code", F.round(F.col("close") / F.lag("close", 6).over(w) - 1, 9).alias("value"), F.round(F.lead("close").over(w) / F.col("close") - 1, 9).alias("fwd")).where("value IS NOT NULL AND fwd IS NOT NULL")
    return p.select("trade_date", "code", "value", (F.ntile(5).over(Window.partitionBy("trade_date").orderBy("fwd", "code")) - 1).alias("label"))


@query("n11_ranking_loss", f"WITH {_LABELS} SELECT trade_date, {r('CASE WHEN ideal = 0 THEN 0 ELSE 1 - seen / ideal END')} AS loss FROM i")
def _(t):
    return ranking.ranking_loss(labelled(t)).select("trade_date", rounded(F.col("loss")).alias("loss"))


@query(
    "n11_ranking_gradient",
    f"""WITH {_LABELS}, z AS (SELECT x.trade_date, x.code, (x.g - y.g) / nullif(ideal, 0) / (1 + exp(y.value - x.value)) * (1 - 1 / (1 + exp(y.value - x.value))) AS v FROM k x JOIN k y ON x.trade_date = y.trade_date JOIN i ON x.trade_date = i.trade_date)
SELECT trade_date, code, {r('coalesce(-sum(v), 0)')} AS gradient FROM z GROUP BY 1, 2""",
)
def _(t):
    return ranking.ranking_gradient(labelled(t)).select("trade_date", "code", rounded(F.col("gradient")).alias("gradient"))


def validated(ics):
    """name, n, mean_ic, t_stat, p, and from 50 coefficients the GARCH persistence and conditional volatility of ics
    (name, trade_date, ic); names with fewer than 12, or that do not vary, are left out."""
    columns = ["mean_ic", "t_stat", "p", "persistence", "vol_mean", "vol_last"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("trade_date").ic.to_numpy(float)
        se = x.std(ddof=1) / math.sqrt(len(x)) if len(x) >= 12 else 0.0
        if se <= 1e-12:
            return pd.DataFrame(columns=["name", "n", *columns])
        stat = x.mean() / se
        row = [pdf["name"].iloc[0], len(x), x.mean(), stat, 2 * (1 - eng.t_cdf(abs(stat), len(x) - 1)), None, None, None]
        if len(x) >= 50:
            g, dev = eng.garch(x), x - x.mean()
            s, path = dev.var(), []
            for d in dev:
                path.append(math.sqrt(s))
                s = g["omega"] + g["alpha"] * d * d + g["beta"] * s
            row[5:] = [g["alpha"] + g["beta"], float(np.mean(path)), path[-1]]
        return pd.DataFrame([row], columns=["name", "n", *columns])

    return ics.groupBy("name").applyInPandas(run, "name string, n long, " + ", ".join(f"{c} double" for c in columns))


@query("l10_validate_all", None)
def _(t):
    """Momentum over four horizons: t-tests, Benjamini and Hochberg's adjustment at 0.05, and stability by GARCH."""
    ics = all_ics(t).where("ic IS NOT NULL").select(F.concat(F.lit("momentum_"), F.col("horizon").cast("string")).alias("name"), "trade_date", "ic")
    out = val.multiple_testing(validated(ics))
    calm = F.when((F.col("persistence") < 0.9) & (F.col("vol_mean") < 0.03), "stable").when(F.col("persistence") < 0.95, "middling").when(F.col("persistence").isNotNull(), "unstable")
    return out.select("name", "n", "mean_ic", "t_stat", "p", F.col("bh").alias("adjusted_p"), F.col("bh_reject").alias("significant"), "persistence", "vol_mean", "vol_last", calm.alias("stability"))


_HORIZONS = (1, 3, 6)
_PRICES = ", ".join(f"round(close / lag(close, {n}) OVER (PARTITION BY code ORDER BY trade_date) - 1, 9) AS x{i}" for i, n in enumerate(_HORIZONS))
_ZS = ", ".join(f"(x{i} - avg(x{i}) OVER (PARTITION BY trade_date)) / CASE WHEN stddev_pop(x{i}) OVER (PARTITION BY trade_date) = 0 THEN 1 ELSE stddev_pop(x{i}) OVER (PARTITION BY trade_date) END AS z{i}" for i in range(3))
_W1 = "((i * 3 + j) % 7 / 7.0 - 0.4)"


@query(
    "q06_graph_scores",
    f"""WITH m AS (SELECT trade_date, code, {_PRICES} FROM monthly), n AS (SELECT * FROM m WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL), z AS (SELECT trade_date, code, {_ZS} FROM n), {_peers(20)},
s AS (SELECT src, dst FROM peers UNION SELECT dst, src FROM peers), e AS (SELECT a.trade_date, src, dst FROM s JOIN z a ON a.code = src JOIN z b ON b.code = dst AND a.trade_date = b.trade_date), d AS (SELECT trade_date, src, count(*)::DOUBLE AS d FROM e GROUP BY 1, 2),
w AS (SELECT e.trade_date, e.src, e.dst, 1 / sqrt(a.d * b.d) AS w FROM e JOIN d a ON e.trade_date = a.trade_date AND e.src = a.src JOIN d b ON e.trade_date = b.trade_date AND e.dst = b.src),
v AS (SELECT trade_date, code, i, CASE i WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END AS v FROM z, generate_series(0, 2) g(i)), u AS (SELECT w.trade_date, dst AS code, i, sum(w * v) AS v FROM w JOIN v ON v.trade_date = w.trade_date AND v.code = src GROUP BY 1, 2, 3),
h AS (SELECT trade_date, code, j, greatest(sum(v * {_W1}) + 0.1, 0) AS v FROM u, generate_series(0, 2) g(j) GROUP BY 1, 2, 3), q AS (SELECT w.trade_date, dst AS code, j AS i, sum(w * v) AS v FROM w JOIN h ON h.trade_date = w.trade_date AND h.code = src GROUP BY 1, 2, 3)
SELECT trade_date, code, {r('sum(v * (i % 7 / 7.0 - 0.4))', 5)} AS score FROM q GROUP BY 1, 2""",
)
def _(t):
    """Scores of a two-layer network for each date: momentum of three horizons, standardised within the date, over the
    graph of its industries; codes without an edge that date have none. All dates go through one plan, as nodes are
    (date, code)."""
    w, by = Window.partitionBy("code").orderBy("trade_date"), Window.partitionBy("trade_date")
    x = t.monthly.select("trade_date", "code", *[F.round(F.col("close") / F.lag("close", n).over(w) - 1, 9).alias(f"x{i}") for i, n in enumerate(_HORIZONS)]).dropna()
    sd = lambda i: F.stddev_pop(f"x{i}").over(by)
    z = [(F.col(f"x{i}") - F.avg(f"x{i}").over(by)) / F.when(sd(i) == 0, 1.0).otherwise(sd(i)) for i in range(3)]
    rings = graph.rings(t.industry, "sector", 20)
    if not graph.share_codes(rings):
        # a code without an industry counts in a date's mean, and has no place
        placed = x.join(rings, "code", "left").select("trade_date", "code", "ring", "at", "turn", *[c.alias(f"z{i}") for i, c in enumerate(z)]).where("ring IS NOT NULL")
        out = graph.gcn_along(graph.linked(placed, "trade_date"), ["z0", "z1", "z2"], "trade_date", _weights(3, 3), np.full(3, 0.1), _weights(3), 0.0)
        return out.select("trade_date", "code", rounded(F.col("score"), 5).alias("score"))
    z = x.select("trade_date", "code", F.array(*z).alias("features"))
    here = z.select("trade_date", "code")
    both = graph.symmetric(graph.sampled_peers(t.industry, "sector", 20))
    dated = both.join(here.withColumnRenamed("code", "src"), "src").join(here.withColumnRenamed("code", "dst"), ["trade_date", "dst"])
    node = lambda c: F.struct("trade_date", F.col(c).alias("code"))
    out = graph.gcn(dated.select(node("src").alias("src"), node("dst").alias("dst")), z.select(node("code").alias("id"), "features"), _weights(3, 3), np.full(3, 0.1), _weights(3, 1), np.zeros(1))
    return out.select("id.trade_date", "id.code", rounded(F.col("features")[0], 5).alias("score"))
