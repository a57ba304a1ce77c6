"""Time-series factors: each is a Column over shared windows of one code's bars, in date order.

A factor gives a value for every bar. Where the frame holds fewer bars than it needs the value is null. Returns are
taken once, as a column `ret`, before the windows are applied; a missing or non-positive previous close gives none.

The families are written over a view of the bars: Frames gives their value at every bar, Last at the last bar of each
code only, as plain aggregates of the few bars that count. Spark evaluates a frame anew for every bar; families() and
crossed() take the same values at every bar from operators/sliding.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.operators import sliding

#: Window lengths of the factory (fixed values).
WINDOWS = [5, 10, 20, 30, 60]
EXTRA_WINDOWS = [3, 15, 40, 90, 120, 180, 252]
TINY = 1e-12


def order() -> Window:
    return Window.partitionBy("code").orderBy("trade_date")


def frame(w: int) -> Window:
    return order().rowsBetween(-(w - 1), 0)


class Frames:
    """Of every bar: what is taken over the last w bars, the bar's own values, and those n bars before."""

    def over(self, fn: Callable[..., Column], w: int, *columns: Column) -> Column:
        return fn(*columns).over(frame(w))

    def now(self, c: str) -> Column:
        return F.col(c)

    def back(self, c: str, n: int) -> Column:
        return F.lag(c, n).over(order())

    def not_above_now(self, c: str, w: int) -> Column:
        held = F.collect_list(c).over(frame(w))
        return F.size(F.filter(held, lambda x: x <= F.col(c)))


class Last(Frames):
    """Of the last bar of a code: its bars are numbered from the last, k = 1, and c_now holds the last value of c."""

    def over(self, fn: Callable[..., Column], w: int, *columns: Column) -> Column:
        return fn(*[F.when(F.col("k") <= w, c) for c in columns])

    def now(self, c: str) -> Column:
        return F.max(F.when(F.col("k") == 1, F.col(c)))

    def back(self, c: str, n: int) -> Column:
        return F.max(F.when(F.col("k") == n + 1, F.col(c)))

    def not_above_now(self, c: str, w: int) -> Column:
        return F.count(F.when((F.col("k") <= w) & (F.col(c) <= F.col(f"{c}_now")), 1))


EVERY, LAST = Frames(), Last()


def full(value: Column, w: int, over: str = "close", v: Frames = EVERY) -> Column:
    """value, where the frame of w bars has w non-null values of the column."""
    return F.when(v.over(F.count, w, F.col(over)) >= w, value)


def with_returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(order())
    return bars.withColumns({"ret": F.when(before > 0, F.col("close") / before - 1), "diff": F.col("close") - before})


def _share(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _moving(v: Frames, w: int, *columns: str) -> Column:
    """Whether each column varies within the frame."""
    out = F.lit(True)
    for c in columns:
        out = out & (v.over(F.stddev_pop, w, F.col(c)) > 0)
    return out


def _correlation(v: Frames, w: int, a: str, b: str) -> Column:
    """Null where either side is constant in the frame; Spark's corr would divide by zero there."""
    x, y = F.col(a), F.col(b)
    return F.try_divide(v.over(F.covar_pop, w, x, y), v.over(F.stddev_pop, w, x) * v.over(F.stddev_pop, w, y))


def roc(w: int, v: Frames = EVERY) -> Column:
    """Return over w - 1 steps; 0 where the first close is 0."""
    before = v.back("close", w - 1)
    return full(F.when(before == 0, 0.0).otherwise(_share(v.now("close"), before) - 1), w, v=v)


def std(w: int, v: Frames = EVERY) -> Column:
    return full(v.over(F.stddev_pop, w, F.col("ret")), w, "ret", v)


def corr(w: int, v: Frames = EVERY) -> Column:
    """Correlation of close and volume, null where either is constant."""
    return full(F.when(_moving(v, w, "close", "volume"), _correlation(v, w, "close", "volume")), w, v=v)


def high_max(w: int, v: Frames = EVERY) -> Column:
    return full(_share(v.over(F.max, w, F.col("high")), v.now("close")), w, v=v)


def low_min(w: int, v: Frames = EVERY) -> Column:
    return full(_share(v.over(F.min, w, F.col("low")), v.now("close")), w, v=v)


def vma(w: int, v: Frames = EVERY) -> Column:
    m = v.over(F.avg, w, F.col("volume"))
    return full(F.when(m == 0, 1.0).otherwise(_share(v.now("volume"), m)), w, v=v)


def _variation(c: str, w: int, v: Frames) -> Column:
    return full(_share(v.over(F.stddev_pop, w, F.col(c)), v.over(F.avg, w, F.col(c))), w, v=v)


def vstd(w: int, v: Frames = EVERY) -> Column:
    return _variation("volume", w, v)


def cntp(w: int, v: Frames = EVERY) -> Column:
    """Share of rises among the last w changes."""
    return full(v.over(F.avg, w, F.when(F.col("diff") > 0, 1.0).otherwise(0.0)), w, "diff", v)


def beta(w: int, v: Frames = EVERY) -> Column:
    """Sample covariance with the market over its population variance (with a tiny term), as the reference has it."""
    return full(v.over(F.covar_samp, w, F.col("ret"), F.col("mkt")) / (v.over(F.var_pop, w, F.col("mkt")) + TINY), w, "ret", v)


def rsqr(w: int, v: Frames = EVERY) -> Column:
    return full(F.when(_moving(v, w, "ret", "mkt"), F.pow(_correlation(v, w, "ret", "mkt"), F.lit(2))), w, "ret", v)


def rank(w: int, v: Frames = EVERY) -> Column:
    """Share of the last w returns that are not above the last."""
    return full(v.not_above_now("ret", w) / F.lit(float(w)), w, "ret", v)


def skew(w: int, v: Frames = EVERY) -> Column:
    return full(F.when(_moving(v, w, "ret"), v.over(F.skewness, w, F.col("ret"))), w, "ret", v)


def kurt(w: int, v: Frames = EVERY) -> Column:
    return full(F.when(_moving(v, w, "ret"), v.over(F.kurtosis, w, F.col("ret"))), w, "ret", v)


def turn(w: int, v: Frames = EVERY) -> Column:
    return _variation("turnover_rate", w, v)


def amp(w: int, v: Frames = EVERY) -> Column:
    return full(v.over(F.avg, w, (F.col("high") - F.col("low")) / (F.col("close") + TINY)), w, v=v)


def vwap(w: int, v: Frames = EVERY) -> Column:
    mean = _share(v.over(F.sum, w, F.col("amount")), v.over(F.sum, w, F.col("volume")))
    return full(_share(v.now("close") - mean, mean), w, v=v)


def oc(w: int, v: Frames = EVERY) -> Column:
    return full(v.over(F.avg, w, (F.col("close") - F.col("open")) / (F.col("open") + TINY)), w, v=v)


#: name: factor of a window and a view
FAMILIES: dict[str, Callable[..., Column]] = {"roc": roc, "std": std, "corr": corr, "max": high_max, "min": low_min, "vma": vma, "vstd": vstd, "cntp": cntp, "beta": beta, "rsqr": rsqr, "rank": rank, "skew": skew, "kurt": kurt, "turn": turn, "amp": amp, "hl_spread": amp, "vwap": vwap, "oc": oc}


def families(bars: DataFrame, names: list[str], windows: list[int]) -> DataFrame:
    """code, trade_date and a column name_w for each family and window, by matrices of frames."""
    return sliding.with_factors(bars, {f"{n}_{w}": sliding.family(n, w) for n in names for w in windows})


def lagged(c: str, n: int) -> Column:
    return F.lag(c, n).over(order())


def momentum(points: int) -> Column:
    """Return over points - 1 steps, that is from the first of `points` closes."""
    return F.when(lagged("close", points - 1) > 0, F.col("close") / lagged("close", points - 1) - 1)


def momentum_12m1m() -> Column:
    return F.when(lagged("close", 251) > 0, lagged("close", 21) / lagged("close", 251) - 1)


def turnover_momentum() -> Column:
    last, prior = F.avg("turnover_rate").over(frame(21)), F.avg("turnover_rate").over(order().rowsBetween(-41, -21))
    return F.when(F.count("turnover_rate").over(frame(42)) >= 42, _share(last - prior, prior))


def historical_vol(w: int = 252) -> Column:
    return F.when(F.count("ret").over(frame(w)) >= 20, F.stddev_pop("ret").over(frame(w)) * 252**0.5)


def downside_vol(w: int = 252) -> Column:
    down = F.when(F.col("ret") < 0, F.col("ret"))
    return F.when(F.count(down).over(frame(w)) >= 10, F.stddev_pop(down).over(frame(w)) * 252**0.5)


def market_beta(w: int = 252) -> Column:
    f = frame(w)
    return F.when((F.count("ret").over(f) >= 60) & (F.var_pop("mkt").over(f) > 0), F.covar_pop("ret", "mkt").over(f) / F.var_pop("mkt").over(f))


def var_95(w: int = 252) -> Column:
    """Absolute order statistic at int(0.05 n), annualised."""
    held = F.sort_array(F.collect_list("ret").over(frame(w)))
    return F.when(F.size(held) >= 60, F.abs(F.get(held, F.floor(F.size(held) * 0.05).cast("int"))) * 252**0.5)


def volume_ratio() -> Column:
    return full(_share(F.avg("volume").over(frame(5)), F.avg("volume").over(frame(20))), 20)


def money_flow() -> Column:
    x = _share((F.col("close") - F.col("open")) * F.col("volume"), F.col("open") * F.col("amount"))
    return full(F.sum(x).over(frame(5)), 5)


def turnover_anomaly() -> Column:
    before = order().rowsBetween(-20, -1)
    m, s = F.avg("turnover_rate").over(before), F.stddev_pop("turnover_rate").over(before)
    return F.when(F.count("turnover_rate").over(before) >= 20, F.when(s < 1e-15, 0.0).otherwise((F.col("turnover_rate") - m) / s))


def rsi(w: int = 14) -> Column:
    gain, loss = F.avg(F.greatest("diff", F.lit(0.0))).over(frame(w)), F.avg(F.greatest(-F.col("diff"), F.lit(0.0))).over(frame(w))
    return full(F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss)), w, "diff")


def ma_gap(w: int = 5) -> Column:
    m = F.avg("close").over(frame(w))
    return full((F.col("close") - m) / m, w)


def product(a: Column, b: Column) -> Column:
    return a * b


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


#: Factors by category (fixed values).
CATEGORIES = {
    "value": ["pe", "pb", "ps", "peg", "fcf_yield"],
    "momentum": ["momentum_1m", "momentum_3m", "momentum_6m", "momentum_12m1m", "turnover_momentum"],
    "quality": ["roe", "roa", "gross_margin", "net_margin", "cashflow_to_revenue"],
    "volatility": ["historical_vol", "downside_vol", "beta", "var_95"],
    "volume_price": ["volume_ratio", "money_flow", "turnover_anomaly"],
    "sentiment": ["north_bound", "analyst_coverage", "institutional_holding", "shareholder_count"],
}


def category(name: Column) -> Column:
    out = None
    for label, names in CATEGORIES.items():
        out = F.when(name.isin(names), label) if out is None else out.when(name.isin(names), label)
    return out.otherwise("")


#: Families of the factory with their windows, and its crosses of two families (fixed values): 127 factors and 13.
FACTORY: list[tuple[list[str], list[int]]] = [
    (["roc", "std", "corr", "max", "min", "vma", "cntp"], WINDOWS),
    (["beta", "rsqr", "rank", "skew", "kurt", "turn", "amp"], WINDOWS),
    (["roc", "std", "max", "min", "beta", "rsqr"], EXTRA_WINDOWS),
    (["vwap", "hl_spread", "oc"], WINDOWS),
]
CROSSES: list[tuple[str, str, str, list[int]]] = [
    ("roc", "std", "ratio", [10, 20, 60]),
    ("beta", "std", "ratio", [20, 60]),
    ("corr", "vma", "product", [10, 20, 60]),
    ("max", "min", "ratio", [10, 20, 60]),
    ("rank", "roc", "product", [20, 60]),
]


def crosses(v: Frames = EVERY) -> dict[str, Column]:
    """The crossed factors: product or quotient of two families at one window, null where either is or the divisor is 0."""
    made = {"product": product, "ratio": ratio}
    return {f"{a}_{b}_{w}": made[op](FAMILIES[a](w, v), FAMILIES[b](w, v)) for a, b, op, windows in CROSSES for w in windows}


def crossed(bars: DataFrame) -> DataFrame:
    """code, trade_date and the crossed factors at every bar, by matrices of frames."""
    return sliding.with_factors(bars, {f"{a}_{b}_{w}": sliding.crossed(a, b, op, w) for a, b, op, windows in CROSSES for w in windows})


def factory(bars: DataFrame, market: DataFrame) -> DataFrame:
    """code, trade_date and all factors of the factory at the last bar of each code.

    Only the bars that the longest window and its first return need are kept, before anything is computed; the factors
    are then conditional aggregates of them, in one grouping. market: trade_date, mkt.
    """
    last = Window.partitionBy("code").orderBy(F.desc("trade_date"))
    kept = bars.withColumn("k", F.row_number().over(last)).where(F.col("k") <= max(EXTRA_WINDOWS) + 1)
    before = F.lead("close").over(last)
    kept = kept.withColumns({"ret": F.when(before > 0, F.col("close") / before - 1), "diff": F.col("close") - before})
    kept = kept.withColumn("ret_now", F.first("ret").over(last)).join(market, "trade_date", "left")
    named = {f"{n}_{w}": FAMILIES[n](w, LAST) for names, windows in FACTORY for n in names for w in windows} | crosses(LAST)
    return kept.groupBy("code").agg(F.max("trade_date").alias("trade_date"), *[c.alias(k) for k, c in named.items()])


def to_long(wide: DataFrame) -> DataFrame:
    """code, trade_date, factor, value, without nulls."""
    names = [c for c in wide.columns if c not in ("code", "trade_date")]
    return wide.unpivot(["code", "trade_date"], names, "factor", "value").where("value IS NOT NULL")
