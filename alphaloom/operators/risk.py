"""Tail risk, dependence, credibility, reserving, solvency, execution and attribution in DataFrame operations.

Rows are long: code (or asset), trade_date, ret. Losses are negated returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantiles of the standard normal (fixed values).
Z = {0.95: 1.645, 0.99: 2.326, 0.999: 3.090}
#: Historical scenarios: shock, volatility multiple, liquidity discount (fixed values).
SCENARIOS = [("2008", -0.72, 3.0, 0.30), ("2015", -0.45, 2.0, 0.25), ("2020", -0.15, 1.5, 0.10), ("2024", -0.30, 2.0, 0.20)]
#: Correlations of solvency modules that differ from 0 (fixed values).
SCR_CORRELATIONS = [("equity", "concentration", 0.5), ("equity", "credit", 0.25), ("concentration", "credit", 0.25)]
#: Limits for one position, an industry and the total (fixed values).
SINGLE_LIMIT, INDUSTRY_LIMIT, TOTAL_LIMIT = 0.10, 0.30, 0.95


def hill(returns: DataFrame, tail: float = 0.10) -> DataFrame:
    """code, xi: mean log excess of the k largest losses over the next, k = int(tail * n) between 5 and n - 1."""
    losses = returns.where("ret < 0").select("code", (-F.col("ret")).alias("x"))
    w = Window.partitionBy("code")
    ranked = losses.withColumns({"i": F.row_number().over(w.orderBy(F.desc("x"))), "n": F.count("*").over(w)})
    k = F.least(F.greatest(F.floor(F.col("n") * tail), F.lit(5)), F.col("n") - 1)
    edge = F.max(F.when(F.col("i") == k + 1, F.log("x"))).over(w)
    out = ranked.withColumns({"k": k, "e": edge}).where("i <= k AND n > 5")
    return out.groupBy("code").agg((F.sum(F.log("x") - F.col("e")) / F.max("k")).alias("xi"))


def gpd_pwm(returns: DataFrame, quantile: float = 0.90, least: int = 50) -> DataFrame:
    """code, n, excesses, threshold, xi, beta: generalised Pareto by probability-weighted moments above the loss quantile.

    The threshold is the quantile of losses from below, so that 0.9 leaves the largest tenth (the reference sorts the
    other way and keeps nine tenths).
    """
    w = Window.partitionBy("code")
    x = returns.select("code", (-F.col("ret")).alias("x")).withColumns({"i": F.row_number().over(w.orderBy("x")), "n": F.count("*").over(w)})
    u = F.max(F.when(F.col("i") == F.floor(F.col("n") * quantile), F.col("x"))).over(w)
    over = x.withColumn("u", u).where(F.col("i") > F.floor(F.col("n") * quantile)).withColumn("m", F.col("n") - F.floor(F.col("n") * quantile))
    j = F.col("i") - F.floor(F.col("n") * quantile)
    sums = over.where(F.col("n") >= least).groupBy("code").agg(F.max("n").alias("n"), F.max("m").alias("excesses"), F.max("u").alias("threshold"), F.avg(F.col("x") - F.col("u")).alias("a0"), F.avg((F.col("x") - F.col("u")) * (F.col("m") - j) / (F.col("m") - 1)).alias("a1"))
    beta = F.try_divide(2 * F.col("a0") * F.col("a1"), F.col("a0") - 2 * F.col("a1"))
    return sums.select("code", "n", "excesses", "threshold", (2 - F.try_divide("a0", F.col("a0") - 2 * F.col("a1"))).alias("xi"), beta.alias("beta"))


def tail_var(fit: DataFrame, level: float = 0.99) -> DataFrame:
    """fit with var and es at the level: u + beta / xi * ((n / n_u * (1 - level)) ** -xi - 1)."""
    p = F.col("n") / F.col("excesses") * (1 - level)
    var = F.col("threshold") + F.when(F.abs("xi") < 1e-9, -F.col("beta") * F.log(p)).otherwise(F.col("beta") / F.col("xi") * (F.pow(p, -F.col("xi")) - 1))
    out = fit.withColumn("var", var)
    return out.withColumn("es", F.when(F.col("xi") < 1, (F.col("var") + F.col("beta") - F.col("xi") * F.col("threshold")) / (1 - F.col("xi"))))


def block_maxima(returns: DataFrame, size: int = 21) -> DataFrame:
    """code, block, loss: the largest loss of each whole block of `size` returns."""
    k = F.floor((F.row_number().over(Window.partitionBy("code").orderBy("trade_date")) - 1) / size)
    return returns.select("code", k.cast("long").alias("block"), "ret").groupBy("code", "block").agg(F.max(-F.col("ret")).alias("loss"), F.count("*").alias("n")).where(F.col("n") == size).drop("n")


def pseudo_observations(returns: DataFrame) -> DataFrame:
    w = Window.partitionBy("code")
    return returns.withColumn("u", F.rank().over(w.orderBy("ret")) / (F.count("*").over(w) + 1))


def kendall(pairs: DataFrame, by: str = "code") -> DataFrame:
    """by, tau: concordant less discordant pairs of (x, y) over all; t orders the rows of a group.

    All pairs within a group are compared, so that a group is a short series (months, not ticks).
    """
    a = pairs.select(by, F.col("t").alias("t1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = pairs.select(F.col(by).alias("_b"), F.col("t").alias("t2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    j = a.join(b, (F.col(by) == F.col("_b")) & (F.col("t1") < F.col("t2")))
    s = F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))
    return j.groupBy(by).agg(F.try_divide(F.sum(s), F.sum(F.abs(s))).alias("tau"))


def clayton_loglik(u: Column, v: Column, theta: Column) -> Column:
    """Log density of the Clayton copula; sum it over observations."""
    s = F.pow(u, -theta) + F.pow(v, -theta) - 1
    return F.log(1 + theta) - (1 + theta) * (F.log(u) + F.log(v)) - (2 + 1 / theta) * F.log(s)


def development_factors(triangle: DataFrame) -> DataFrame:
    """j, factor (from j to j + 1), to_ultimate: column sums over accident years that have both, c positive."""
    later = F.lead("c").over(Window.partitionBy("i").orderBy("j"))
    t = triangle.withColumn("later", later).where("later IS NOT NULL AND c > 0")
    f = t.groupBy("j").agg((F.sum("later") / F.sum("c")).alias("factor"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    return f.withColumn("to_ultimate", F.product("factor").over(w))


def latest_diagonal(triangle: DataFrame) -> DataFrame:
    return triangle.groupBy("i").agg(F.max("j").alias("j"), F.max_by("c", "j").alias("paid"))


def chain_ladder(triangle: DataFrame, tail: float = 1.0) -> DataFrame:
    """i, paid, ultimate, reserve."""
    d = latest_diagonal(triangle).join(F.broadcast(development_factors(triangle)), "j", "left")
    u = F.col("paid") * F.coalesce("to_ultimate", F.lit(1.0)) * tail
    return d.select("i", "j", "paid", u.alias("ultimate"), (u - F.col("paid")).alias("reserve"))


def bornhuetter_ferguson(triangle: DataFrame, prior: DataFrame, credibility: float = 0.5) -> DataFrame:
    """i, paid, ultimate: paid + prior * (1 - 1 / F) + credibility * (chain ladder - prior), at least paid. prior: i, prior."""
    c = chain_ladder(triangle).join(prior, "i")
    f = F.col("ultimate") / F.col("paid")
    u = F.col("paid") + F.col("prior") * (1 - 1 / f) + credibility * (F.col("ultimate") - F.col("prior"))
    return c.select("i", "paid", F.greatest(u, F.col("paid")).alias("ultimate"))


def scr(modules: DataFrame) -> DataFrame:
    """total, undiversified, diversification of modules (name, capital) under the fixed correlations."""
    spark = modules.sparkSession
    rho = spark.createDataFrame(SCR_CORRELATIONS, "a string, b string, rho double")
    x, y = modules.select(F.col("name").alias("a"), F.col("capital").alias("ca")), modules.select(F.col("name").alias("b"), F.col("capital").alias("cb"))
    cross = rho.join(x, "a").join(y, "b").agg(F.coalesce(F.sum(2 * F.col("rho") * F.col("ca") * F.col("cb")), F.lit(0.0)).alias("cross"))
    own = modules.agg(F.sum(F.col("capital") * F.col("capital")).alias("squares"), F.sum("capital").alias("undiversified"))
    total = F.sqrt(F.col("squares") + F.col("cross"))
    return own.join(cross, how="cross").select(total.alias("total"), "undiversified", (F.col("undiversified") - total).alias("diversification"))


def risk_limits(var_99: Column, equity_share: Column, positions: Column) -> list[Column]:
    """single, industry and total limits from the tail estimate and the equity share of capital."""
    evt = F.least(F.greatest(F.try_divide(F.lit(0.15), 2 * var_99), F.lit(0.02)), F.lit(0.15))
    single = F.greatest(F.lit(0.01), F.least(evt, 0.15 * equity_share))
    return [single.alias("single"), F.least(3 * single, F.lit(0.30)).alias("industry"), F.least(positions * single, F.lit(0.95)).alias("total")]


def stress(positions: DataFrame) -> DataFrame:
    """scenario, loss: market value times shock * beta, less the liquidity discount, which adds to the loss.

    positions: market_value, beta. (The reference adds the discount with the opposite sign.)
    """
    s = positions.sparkSession.createDataFrame(SCENARIOS, "scenario string, shock double, volatility double, liquidity double")
    return positions.join(F.broadcast(s), how="cross").groupBy("scenario").agg(F.sum(F.col("market_value") * (F.col("shock") * F.col("beta") - F.col("liquidity"))).alias("loss"))


def kupiec(hits: DataFrame, by: str = "code", level: float = 0.99) -> DataFrame:
    """by, n, x, lr, zone: proportion-of-failures likelihood ratio of column hit (0 or 1) and the Basel zone."""
    p = 1 - level
    c = hits.groupBy(by).agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("x"))
    q = F.col("x") / F.col("n")
    term = lambda k, pr: F.when(k == 0, 0.0).otherwise(k * F.log(pr))
    free = term(F.col("x"), q) + term(F.col("n") - F.col("x"), 1 - q)
    fixed = F.col("x") * F.log(F.lit(p)) + (F.col("n") - F.col("x")) * F.log(F.lit(1 - p))
    zone = F.when(F.col("x") <= 4, "green").when(F.col("x") <= 9, "yellow").otherwise("red")
    return c.select(by, "n", "x", (2 * (free - fixed)).alias("lr"), zone.alias("zone"))


def christoffersen(counts: DataFrame, by: str = "code") -> DataFrame:
    """by, lr: independence likelihood ratio from transition counts n00, n01, n10, n11."""
    n00, n01, n10, n11 = (F.col(c).cast("double") for c in ("n00", "n01", "n10", "n11"))
    p, p0, p1 = (n01 + n11) / (n00 + n01 + n10 + n11), F.try_divide(n01, n00 + n01), F.try_divide(n11, n10 + n11)
    term = lambda k, pr: F.when(k == 0, 0.0).otherwise(k * F.log(pr))
    one = term(n00, 1 - p0) + term(n01, p0) + term(n10, 1 - p1) + term(n11, p1)
    return counts.select(by, (2 * (one - term(n00 + n10, 1 - p) - term(n01 + n11, p))).alias("lr"))


def performance(returns: DataFrame, by: str = "code", periods: int = 252, free: float = 0.03) -> DataFrame:
    """by, annual, volatility, sharpe, drawdown, calmar, win_rate of simple returns."""
    w = Window.partitionBy(by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    e = returns.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(w)))
    e = e.withColumn("fall", 1 - F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(1.0)))
    a, v, d = periods * F.avg("ret"), F.stddev_pop("ret") * periods**0.5, F.max("fall")
    return e.groupBy(by).agg(a.alias("annual"), v.alias("volatility"), F.try_divide(a - free, v).alias("sharpe"), d.alias("drawdown"), F.try_divide(a, d).alias("calmar"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def brinson(weights: DataFrame) -> DataFrame:
    """sector, allocation, selection, interaction from rows sector, w_p, w_b, r_p, r_b."""
    s = weights.groupBy("sector").agg(F.sum("w_p").alias("wp"), F.sum("w_b").alias("wb"), F.coalesce(F.try_divide(F.sum(F.col("w_p") * F.col("r_p")), F.sum("w_p")), F.lit(0.0)).alias("rp"), F.coalesce(F.try_divide(F.sum(F.col("w_b") * F.col("r_b")), F.sum("w_b")), F.lit(0.0)).alias("rb"))
    total = F.sum(F.col("wb") * F.col("rb")).over(Window.partitionBy(F.lit(1)))
    return s.select("sector", ((F.col("wp") - F.col("wb")) * (F.col("rb") - total)).alias("allocation"), (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"), ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"))


def symmetric(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.where("a <> b").withColumns({"a": F.col("b"), "b": F.col("a")}))


def rebalance(target: DataFrame, current: DataFrame, capital: float, least: float = 0.005) -> DataFrame:
    """code, change, side, amount: target weights against current ones; smaller changes are held."""
    j = target.select("code", F.col("weight").alias("t")).join(current.select("code", F.col("weight").alias("c")), "code", "full").fillna(0.0, ["t", "c"])
    d = F.col("t") - F.col("c")
    return j.select("code", d.alias("change"), F.when(F.abs(d) < least, "hold").when(d > 0, "buy").otherwise("sell").alias("side"), (F.abs(d) * capital).alias("amount"))


def impact(quantity: Column, volume: Column, volatility: Column, gamma: float = 0.10, eta: float = 0.15, kappa: float = 0.0020) -> dict[str, Column]:
    """Permanent and temporary impact with exponents 1 and 0.6, and the square-root rule."""
    share = F.try_divide(quantity, volume)
    return {"permanent": gamma * volatility * share, "temporary": eta * volatility * F.pow(share, F.lit(0.6)), "square_root": kappa * F.sqrt(share)}


def slices(orders: DataFrame, n: int, lot: int = 100) -> DataFrame:
    """orders with slice (from 0) and quantity_slice: equal whole lots, the rest in the last."""
    each = F.floor(F.col("quantity") / (n * lot)) * lot
    out = orders.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("quantity_slice", F.when(F.col("slice") == n - 1, F.col("quantity") - each * (n - 1)).otherwise(each).cast("long"))


def vwap_slices(orders: DataFrame, profile: list[float], lot: int = 100, kappa: float = 0.0020) -> DataFrame:
    """orders with slice, quantity_slice and impact: by the day's volume profile in whole lots, one at least; the last
    slice has what is left, or nothing. impact: the square-root rule on the slice's part of the volume."""
    w = F.get(F.lit([x / sum(profile) for x in profile]), F.col("slice"))
    out = orders.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(len(profile) - 1)))).withColumn("w", w)
    out = out.withColumn("q", F.greatest(F.lit(lot), F.floor(F.col("quantity") * F.col("w") / lot) * lot))
    before = F.coalesce(F.sum("q").over(Window.partitionBy("code").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("quantity_slice", F.when(F.col("slice") == len(profile) - 1, F.greatest(F.col("quantity") - before, F.lit(0))).otherwise(F.col("q")).cast("long"))
    return out.withColumn("impact", kappa * F.sqrt(F.col("quantity_slice") / F.greatest(F.floor(F.col("volume") * F.col("w")), F.lit(1)))).drop("w", "q")


def kelly(win_rate: Column, win: Column, loss: Column, most: float = 0.25) -> Column:
    return F.least(F.greatest(win_rate - F.try_divide(1 - win_rate, F.try_divide(win, loss)), F.lit(0.0)), F.lit(most))


def walk_forward(dates: DataFrame, train: int, test: int, purge: int = 0, embargo: int = 0, expanding: bool = True) -> DataFrame:
    """fold, part, trade_date: test blocks of `test` dates in a row, each after its training dates less purge and embargo."""
    k = dates.select("trade_date").distinct().select("trade_date", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("trade_date")) - 1).cast("long").alias("k"))
    n = k.agg(F.count("*").alias("n"))
    folds = n.select(F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - train) / test) - 1, F.lit(0)))).alias("fold")).withColumn("start", train + F.col("fold") * test)
    j = k.join(F.broadcast(folds), F.col("k") < F.col("start") + test)
    before = F.col("k") < F.col("start") - purge - embargo
    if not expanding:
        before = before & (F.col("k") >= F.col("start") - purge - embargo - train)
    return j.withColumn("part", F.when(F.col("k") >= F.col("start"), "test").when(before, "train")).where("part IS NOT NULL").select("fold", "part", "trade_date")
