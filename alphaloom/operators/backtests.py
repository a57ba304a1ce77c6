"""Backtests of many experiments as one stream of rows per run, and their validation by folds of dates.

What an experiment buys on a date depends on ranks alone, so that picks are a join of its rebalancing dates with the
ranked scores, made for all experiments at once. Prices follow only the codes that are held, for as long as they are. A
run's rows then pass one task in order of date, which holds the positions and a date's rows; no task sees the universe.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COSTS = {"slip": 0.0001, "commission": 0.0003, "least": 5.0, "stamp": 0.001}


def calendar(prices: DataFrame) -> DataFrame:
    """trade_date, k: the dates in order, from 0."""
    return prices.select("trade_date").distinct().withColumn("k", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("trade_date")) - 1).cast("long"))


def purged_folds(n: int, splits: int = 5, embargo: float = 0.01, purge: float = 0.01) -> list[tuple[int, int, int]]:
    """fold, first and last date index of the test windows that leave dates to train on before the embargo and the purge:
    ten at least, and five to test."""
    if n < splits * 3:
        return []
    gap, size = max(1, int(embargo * n)) + max(1, int(purge * n)), n // splits
    windows = [(f * size, n if f == splits - 1 else (f + 1) * size) for f in range(splits)]
    kept = [(a, b) for a, b in windows if a - gap >= 1]
    return [(i, a, b - 1) for i, (a, b) in enumerate(kept) if a - gap >= 10 and b - a >= 5]


def walk_folds(n: int, train: int = 252, step: int = 63, test: int = 63) -> list[tuple[int, int, int]]:
    """fold, first and last date index of test windows that follow on `train` dates and more, `step` apart."""
    return [(i, a, a + test - 1) for i, a in enumerate(range(train, n - test + 1, step)) if test >= 5 and train >= 10]


def runs_of(experiments: DataFrame, folds: list[tuple[int, int, int]], last: int) -> DataFrame:
    """experiment, top, every, fold, lo, hi: each experiment over all dates (fold -1) and over the folds' test windows.

    The grid and its folds are parameters: their product does not grow with the data.
    """
    table = experiments.sparkSession.createDataFrame([(-1, 0, last), *folds], "fold int, lo long, hi long")
    return experiments.join(F.broadcast(table), how="cross")


def events(prices: DataFrame, scores: DataFrame, runs: DataFrame) -> DataFrame:
    """experiment, fold, k, kind, place, code, price: what a run meets, in the order of k, kind and place.

    kind 0: the date itself; 1: the price of a code held since an earlier date; 2: a pick (place: its rank by score, then
    code, among the codes with a price that day). A date without picks leaves positions as they are.
    """
    days = calendar(prices)
    priced = prices.join(F.broadcast(days), "trade_date").select("k", "code", F.col("close").alias("price"))
    signals = scores.where("value IS NOT NULL").join(F.broadcast(days), "trade_date").join(priced, ["k", "code"])
    most = runs.agg(F.max("top")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("value"), "code"))
    ranked = signals.withColumn("place", rank).where(F.col("place") <= most).select("k", "code", "price", "place")
    due = runs.withColumn("k", F.explode(F.expr("sequence(lo, hi, cast(every AS long))"))).select("experiment", "fold", "top", "hi", "k")
    due = due.join(ranked.select("k").distinct(), "k", "left_semi")
    due = due.withColumn("until", F.coalesce(F.lead("k").over(Window.partitionBy("experiment", "fold").orderBy("k")), "hi"))
    picks = due.join(ranked, "k").where(F.col("place") <= F.col("top"))
    held = picks.where(F.col("until") > F.col("k")).select("experiment", "fold", "code", F.explode(F.sequence(F.col("k") + 1, F.col("until"))).alias("k"))
    marks = held.join(priced, ["k", "code"])
    shape = lambda df, kind, place, code, price: df.select("experiment", "fold", "k", F.lit(kind).alias("kind"), place.cast("int").alias("place"), code.alias("code"), price.cast("double").alias("price"))
    kind = prices.schema["code"].dataType
    none = F.lit(None)
    dates = runs.select("experiment", "fold", F.explode(F.sequence("lo", "hi")).alias("k"))
    return shape(dates, 0, F.lit(0), none.cast(kind), none).union(shape(marks, 1, F.lit(0), F.col("code"), F.col("price"))).union(shape(picks, 2, F.col("place"), F.col("code"), F.col("price")))


class _Run:
    """Cash and positions of a run; one date's rows at a time."""

    def __init__(self, capital: float, lot: int, costs: dict[str, float]) -> None:
        self.cash, self.held, self.last, self.lot, self.costs = capital, {}, {}, lot, costs

    def date(self, marks: list[tuple], picks: list[tuple]) -> tuple[float, float]:
        """Equity and turnover after a date: all is sold and the picks bought in equal cash, in whole lots."""
        c, moved = self.costs, 0.0
        self.last.update(marks)
        if picks:
            for code, n in sorted(self.held.items()):
                v = n * self.last[code] * (1 - c["slip"])
                self.cash += v - max(v * c["commission"], c["least"]) - v * c["stamp"]
                moved += v
            self.held, self.last = {}, dict(picks)
            each = self.cash / len(picks)
            for code, close in picks:
                price = close * (1 + c["slip"])
                n = int(each / (price * (1 + c["commission"])) / self.lot) * self.lot
                cost = n * price + max(n * price * c["commission"], c["least"])
                if n > 0 and cost <= self.cash:
                    self.cash -= cost
                    self.held[code] = n
                    moved += n * price
        return self.cash + sum(n * self.last[code] for code, n in sorted(self.held.items())), moved


def paths(prices: DataFrame, scores: DataFrame, runs: DataFrame, capital: float = 1_000_000.0, lot: int = 1, **costs: float) -> DataFrame:
    """experiment, fold, trade_date, equity, turnover: a row for each date of each run.

    prices: trade_date, code, close (one row each); scores: trade_date, code, value; runs as runs_of() gives them. Every
    `every` dates from a run's first, all is sold and the `top` scores bought at that date's close. A held code without a
    price keeps its last one.
    """
    rates = COSTS | costs
    rows = events(prices, scores, runs)
    order = ["experiment", "fold", "k", "kind", "place", "code"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now, at, marks, picks = None, None, None, [], []
        for b in batches:
            out = []
            for experiment, fold, k, kind, place, code, price in b[[*order, "price"]].itertuples(index=False):
                if kind == 0:
                    if at is not None:
                        out.append((*now, at, *state.date(marks, picks)))
                    if (experiment, fold) != now:
                        state, now = _Run(capital, lot, rates), (experiment, fold)
                    at, marks, picks = k, [], []
                elif kind == 1:
                    marks.append((code, price))
                else:
                    picks.append((code, price))
            if out:
                yield pd.DataFrame(out, columns=["experiment", "fold", "k", "equity", "turnover"])
        if at is not None:
            yield pd.DataFrame([(*now, at, *state.date(marks, picks))], columns=["experiment", "fold", "k", "equity", "turnover"])

    dealt = rows.repartition("experiment", "fold").sortWithinPartitions(*order)
    out = dealt.mapInPandas(run, "experiment string, fold int, k long, equity double, turnover double")
    return out.join(F.broadcast(calendar(prices)), "k").select("experiment", "fold", "trade_date", "equity", "turnover")


def figures(path: DataFrame, periods: int = 12, free: float = 0.03) -> DataFrame:
    """experiment, fold, total_return, sharpe, max_drawdown, turnover of each run (sharpe: null where returns do not vary)."""
    w = Window.partitionBy("experiment", "fold").orderBy("trade_date")
    r = path.withColumns({"ret": F.col("equity") / F.lag("equity").over(w) - 1, "peak": F.max("equity").over(w)})
    sd = F.stddev_samp("ret")
    sharpe = F.when(sd > 0, (F.avg("ret") - free / periods) / sd * periods**0.5)
    return r.groupBy("experiment", "fold").agg((F.max_by("equity", "trade_date") / F.min_by("equity", "trade_date") - 1).alias("total_return"), sharpe.alias("sharpe"), F.max(1 - F.col("equity") / F.col("peak")).alias("max_drawdown"), F.sum("turnover").alias("turnover"))


def grid_search(path: DataFrame, periods: int = 12) -> DataFrame:
    """experiment, its figures over all dates, the number of folds with mean and sample deviation of their sharpe, return
    and drawdown, and place by mean sharpe of the folds (over all dates where there are none)."""
    f = figures(path, periods)
    over = F.when(F.col("fold") == -1, F.struct("total_return", "sharpe", "max_drawdown", "turnover"))
    names = ["sharpe", "total_return", "max_drawdown"]
    inside = lambda c: F.when(F.col("fold") >= 0, F.col(c))
    each = [x for c in names for x in (F.avg(inside(c)).alias(f"{c}_mean"), F.when(F.count(inside(c)) == 1, 0.0).otherwise(F.stddev_samp(inside(c))).alias(f"{c}_std"))]
    s = f.groupBy("experiment").agg(F.max(over).alias("x"), F.count_if(F.col("fold") >= 0).alias("folds"), *each)
    by = F.coalesce(F.when(F.col("folds") > 0, F.col("sharpe_mean")).otherwise(F.col("x.sharpe")), F.lit(-999.0))
    return s.select("experiment", "x.*", "folds", *[f"{c}_{k}" for c in names for k in ("mean", "std")], F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(by), "experiment")).alias("place"))
