"""Backtests by period, a broker, checks of a portfolio, scenarios, and scores and texts made of results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.functions.scalar import norm_cdf

#: Drawdowns and the share of capital that each leaves at work (fixed values).
TIERS = [(0.20, 0.25), (0.15, 0.50), (0.10, 0.75)]
RISK_LEVELS = {1: "LOW", 2: "GUARDED", 3: "ELEVATED", 4: "HIGH", 5: "CRITICAL"}
#: Words of the sentiment lexicon, negations, and texts that are neutral whatever their words (fixed values).
POSITIVE = "涨停 大涨 上涨 利好 超预期 增长 突破 创新高 买入 增持 回购 分红 盈利 扭亏 龙头 景气 扩张 中标 获批 量产 订单 放量 反弹 企稳 修复 低估 优质 升级".split()
NEGATIVE = "跌停 大跌 下跌 利空 低于预期 下滑 跌破 创新低 卖出 减持 亏损 暴雷 退市 监管 处罚 违约 破产 停产 裁员 诉讼 冻结 衰退 恶化 滞涨 高估 踩踏 恐慌".split()
NEGATIONS = "不 没 无 未 非 别 莫 勿 否 难以 无法".split()
NEUTRAL = r"符合预期|低于市场传闻|但不改.*趋势|长期.*看好"


def one() -> Window:
    """All rows: for a few rows, one for each source or date."""
    return Window.partitionBy(F.lit(1))


def period_returns(rows: DataFrame, by: list[str], top: int, score: str = "value", fwd: str = "fwd", code: str = "code") -> DataFrame:
    """by, ret: all is sold at the end of each period and the `top` best scores are bought in equal cash."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), code)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).groupBy(*by).agg(F.avg(fwd).alias("ret"))


def equity(returns: DataFrame, date: str = "trade_date", by: list[str] | None = None, cost: float = 0.0) -> DataFrame:
    """returns with equity from 1, each period's less `cost` of what is moved on either side."""
    w = (Window.partitionBy(*by) if by else one()).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("net", (1 + F.col("ret")) * (1 - cost) / (1 + cost) - 1).withColumn("equity", F.exp(F.sum(F.log1p("net")).over(w)))


def summary(path: DataFrame, periods: int = 12, free: float = 0.025, date: str = "trade_date") -> DataFrame:
    """total, annual (geometric), sharpe and drawdown of a path; one row."""
    w = one().orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    p = path.withColumn("fall", 1 - F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(1.0)))
    total = F.max_by("equity", date)
    return p.agg((total - 1).alias("total"), (F.pow(total, periods / F.count("*")) - 1).alias("annual"), ((periods * F.avg("net") - free) / (F.stddev_pop("net") * periods**0.5)).alias("sharpe"), F.max("fall").alias("drawdown"))


def risk_scaled(returns: DataFrame, date: str = "trade_date") -> DataFrame:
    """trade_date, scale, equity: what is at work in a period follows the drawdown before it.

    A path is a fold over its periods, of which there are as many as dates.
    """
    scale = lambda fall: F.coalesce(*[F.when(fall >= F.lit(d), F.lit(s)) for d, s in TIERS], F.lit(1.0))
    start = F.struct(F.lit(1.0).alias("equity"), F.lit(1.0).alias("peak"), F.array().cast("array<struct<trade_date:date,scale:double,equity:double>>").alias("path"))

    def step(a: Column, x: Column) -> Column:
        s = scale(1 - a["equity"] / a["peak"])
        e = a["equity"] * (1 + s * x["ret"])
        return F.struct(e.alias("equity"), F.greatest(a["peak"], e).alias("peak"), F.concat(a["path"], F.array(F.struct(x["trade_date"].alias("trade_date"), s.alias("scale"), e.alias("equity")))).alias("path"))

    series = returns.agg(F.sort_array(F.collect_list(F.struct(F.col(date).alias("trade_date"), "ret"))).alias("l"))
    return series.select(F.explode(F.aggregate("l", start, step)["path"]).alias("p")).select("p.*")


def broker(orders: DataFrame, slip: float = 0.0001, rate: float = 0.0003, least: float = 5.0, stamp: float = 0.001) -> DataFrame:
    """orders (code, trade_date, seq, side, quantity, price) with status, fill_price, commission and position.

    A sale fills only from what was held before the day, less what was sold since: shares bought on a day can be sold
    from the next one on. Each code's orders are taken in turn.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["trade_date", "seq"]).reset_index(drop=True)
        held = bought = 0
        day, out = None, []
        for x in own.itertuples():
            if x.trade_date != day:
                day, bought = x.trade_date, 0
            if x.side == "SELL" and held - bought < x.quantity:
                out.append(("rejected", np.nan, 0.0, held))
                continue
            price = x.price * (1 + slip if x.side == "BUY" else 1 - slip)
            fee = max(price * x.quantity * rate, least) + (price * x.quantity * stamp if x.side == "SELL" else 0.0)
            held += x.quantity if x.side == "BUY" else -x.quantity
            bought += x.quantity if x.side == "BUY" else 0
            out.append(("filled", price, fee, held))
        return own.assign(**dict(zip(("status", "fill_price", "commission", "position"), zip(*out))))

    return orders.groupBy("code").applyInPandas(run, orders.schema.simpleString()[7:-1].replace(":", " ") + ", status string, fill_price double, commission double, position long")


def risk_check(blocked: Column, positions_ok: Column, var_amount: Column, capital: Column, rate_ok: Column) -> dict[str, Column]:
    """Score, level, whether trading may go on, and advice."""
    score = F.when(blocked, 5).when(~positions_ok, 3).when(var_amount > 0.05 * capital, 2).otherwise(1)
    level = F.element_at(F.create_map(*[F.lit(x) for kv in RISK_LEVELS.items() for x in kv]), score)
    advice = F.when(blocked, "no trading").when(~positions_ok, "adjust positions").otherwise("trade")
    return {"risk_score": score, "risk_level": level, "passed": ~blocked & positions_ok & rate_ok, "advice": advice}


def sentiment_counts(text: Column) -> tuple[Column, Column]:
    """Positive and negative words of the lexicon at every place of the text; a negation among the five characters before
    a word turns it round."""
    t = F.coalesce(text, F.lit(""))
    one, two = "".join(x for x in NEGATIONS if len(x) == 1), "|".join(x for x in NEGATIONS if len(x) == 2)
    negated = f"(?<=[{one}].{{0,4}}|(?:{two}).{{0,3}})"
    count = lambda words, before="": F.regexp_count(t, F.lit(f"{before}(?=(?:{'|'.join(words)}))"))
    p, n, pn, nn = count(POSITIVE), count(NEGATIVE), count(POSITIVE, negated), count(NEGATIVE, negated)
    return p - pn + nn, n - nn + pn


def sentiment(items: DataFrame, by: str, text: str) -> DataFrame:
    """by, positive, negative, neutral, score of the items' texts: (positive - negative) / all, two digits."""
    up, down = sentiment_counts(F.col(text))
    kind = F.when(F.col(text).rlike(NEUTRAL), 0).when(up > down, 1).when(down > up, -1).otherwise(0)
    k = items.select(by, kind.alias("_k")).groupBy(by).agg(*[F.count(F.when(F.col("_k") == v, 1)).alias(n) for n, v in (("positive", 1), ("negative", -1), ("neutral", 0))], F.sum("_k").alias("_s"), F.count("*").alias("_n"))
    return k.select(by, "positive", "negative", "neutral", (F.bround(F.col("_s") / F.col("_n"), 2) + 0.0).alias("score"))


def block_scenarios(returns: DataFrame, scenarios: int = 1000, block: int = 5, date: str = "trade_date") -> DataFrame:
    """scenario, code, ret: means over whole blocks of neighbouring dates, the same block for all codes.

    Blocks are drawn by a fixed multiplicative sequence, so that a scenario can be had again.
    """
    dates = returns.select(date).distinct().withColumn("block", F.floor((F.row_number().over(one().orderBy(date)) - 1) / block))
    full = dates.agg(F.floor(F.count("*") / block).cast("long").alias("blocks"))
    drawn = returns.sparkSession.range(scenarios).join(F.broadcast(full), F.lit(True)).where("blocks > 0").select(F.col("id").alias("scenario"), F.pmod(F.col("id") * 7919 + 42, F.col("blocks")).alias("block"))
    means = returns.join(F.broadcast(dates), date).groupBy("code", "block").agg(F.avg("ret").alias("ret"))
    return drawn.join(means, "block").select("scenario", "code", "ret")


def tail_loss(scenarios: DataFrame, weights: DataFrame, confidence: float = 0.99) -> DataFrame:
    """loss: the mean of the worst scenarios of a portfolio (weights: code, w), a share of 1 - confidence of them."""
    p = scenarios.join(weights, "code").groupBy("scenario").agg(F.sum(-F.col("ret") * F.col("w")).alias("loss"))
    ranked = p.select("loss", F.row_number().over(one().orderBy(F.desc("loss"), "scenario")).alias("k"), F.count("*").over(one()).alias("n"))
    return ranked.where(F.col("k") <= F.floor(F.col("n") * F.lit(1 - confidence) + 1e-9)).agg(F.avg("loss").alias("loss"))


def reverse_stress(positions: DataFrame, target: float, low: float = -0.10, high: float = 0.10, draws: int = 10_000, most: int = 10) -> DataFrame:
    """market_return, loss: of evenly spread market returns those that cost the target or more, the `most` mildest.

    positions: weight, beta. Draws follow the golden ratio's multiples.
    """
    exposure = positions.agg(F.sum(F.col("weight") * F.abs("beta")).alias("e"))
    u = F.pmod((F.col("id") + 1) * F.lit(0.6180339887498949), F.lit(1.0))
    m = positions.sparkSession.range(draws).select(F.round(low + (high - low) * u, 4).alias("market_return"), "id")
    hit = m.join(F.broadcast(exposure), F.lit(True)).withColumn("loss", F.abs("market_return") * F.col("e")).where(F.col("loss") >= target)
    return hit.orderBy("loss", "id").limit(most).select("market_return", "loss")


def mean_excess(returns: DataFrame, points: int = 30) -> DataFrame:
    """code, threshold, excess: the mean of losses above the threshold, less it, at up to `points` places of their order."""
    w = Window.partitionBy("code")
    x = returns.where("ret < 0").select("code", (-F.col("ret")).alias("x")).withColumns({"i": F.row_number().over(w.orderBy(F.desc("x"))) - 1, "n": F.count("*").over(w)})
    above = F.sum("x").over(w.orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, 0)) - F.col("x") * F.count("*").over(w.partitionBy("code", "x"))
    number = F.count("*").over(w.orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, 0)) - F.count("*").over(w.partitionBy("code", "x"))
    p = F.least(F.lit(points), F.floor(F.col("n") / 5))
    at = x.withColumns({"above": above, "number": number, "p": p}).withColumn("k", F.ceil(F.col("i") * F.col("p") / F.col("n")))
    return at.where((F.floor(F.col("k") * F.col("n") / F.col("p")) == F.col("i")) & (F.col("k") >= 1) & (F.col("k") < F.col("p")) & (F.col("number") > 0)).select("code", F.round("x", 6).alias("threshold"), (F.col("above") / F.col("number") - F.col("x")).alias("excess"))


def bivariate_normal_cdf(h: Column, k: Column, rho: Column) -> Column:
    """P(X <= h, Y <= k) of correlated standard normals: twelve Gauss-Legendre points along the correlation."""
    nodes, weights = np.polynomial.legendre.leggauss(12)
    total = F.lit(0.0)
    for x, w in zip(nodes, weights):
        r = rho * F.lit(float((x + 1) / 2))
        total = total + F.lit(float(w)) * F.exp(-(h * h - 2 * r * h * k + k * k) / (2 * (1 - r * r))) / F.sqrt(1 - r * r)
    return norm_cdf(h) * norm_cdf(k) + rho * total / F.lit(4 * np.pi)


def factor_points(mean_ic: Column, t: Column, peak: Column, late: Column, regimes: Column, one_sign: Column, spread: Column, rising: Column, autocorrelation: Column) -> dict[str, Column]:
    """Points of the five dimensions of a factor (thresholds are fixed values): coefficient, decay, regimes, layers, stability."""
    rest = F.when(peak > 0, late / peak).otherwise(0.0)
    return {
        "ic": F.when((F.abs(mean_ic) > 0.05) & (F.abs(t) > 3), 30).when((F.abs(mean_ic) > 0.02) & (F.abs(t) > 2), 20).when(F.abs(mean_ic) > 0.01, 10).otherwise(0),
        "decay": F.when((peak > 0.03) & (rest > 0.5), 20).when((peak > 0.02) & (rest > 0.3), 15).when(peak > 0.01, 8).otherwise(3),
        "regime": F.when((regimes >= 3) & one_sign & (spread < 0.03), 15).when((regimes >= 3) & one_sign, 10).when(regimes >= 3, 5).when(regimes == 2, 8).otherwise(0),
        "monotonic": F.when(rising > 0.75, 15).when(rising > 0.60, 12).when(rising > 0.50, 6).otherwise(0),
        "stability": F.when(autocorrelation > 0.85, 20).when(autocorrelation > 0.70, 15).when(autocorrelation > 0.50, 8).otherwise(3),
    }
