"""Tests of forecast tails, sizes that ruin bounds, and functions of the user's own over rolling frames."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import permutations as every_order

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.operators import sliding
from alphaloom.operators.engines import resampled

#: Normal quantiles of 0.95, and the mean of what lies beyond.
Z95, TAIL95 = 1.645, 2.0627


def rolling_forecasts(returns: DataFrame, window: int = 60) -> DataFrame:
    """code, trade_date, ret, mean, sd, var, es: normal forecasts at 0.95 from the `window` returns before each date; dates
    with fewer before them are left out."""
    def before(of: Callable[[sliding.Held], np.ndarray]) -> tuple:
        def made(b: sliding.Bars) -> sliding.Values:
            x = b.over("ret", window, 1)
            return of(x), x.n == window

        return made, ["ret"]

    factors = {"mean": before(lambda x: x.mean()[0]), "sd": before(lambda x: x.std()[0] * math.sqrt(window / max(window - 1, 1)))}
    f = sliding.with_factors(returns, factors, ["ret"]).where("sd > 0")
    return f.select("code", "trade_date", "ret", "mean", "sd", (Z95 * F.col("sd") - F.col("mean")).alias("var"), (TAIL95 * F.col("sd") - F.col("mean")).alias("es"))


def _draw(n: int, orders: int, shares: int, seed: int, lo: int) -> np.ndarray:
    """Random orders of n days, those from lo on of `orders` in 256 at most: a row for each loss, its day by order."""
    r = np.random.default_rng(zlib.crc32(f"{seed}|{n}|{shares}|{lo}".encode()))
    days = np.arange(n)
    return np.ascontiguousarray(r.permuted(np.broadcast_to(days, (min(256, orders - lo), n)), axis=1).T)


@lru_cache(maxsize=40)
def _kept_draw(n: int, orders: int, shares: int, seed: int, lo: int) -> np.ndarray:
    """The same for every series of n days; long ones are drawn anew, as they would fill a task's memory."""
    return _draw(n, orders, shares, seed, lo)


def acerbi_szekely(forecasts: DataFrame, level: float = 0.95, orders: int = 5000, shares: int = 8, seed: int = 42) -> DataFrame:
    """code, n, z, p: the mean of losses over their forecast tail on days beyond var, over the share expected, less one; and
    how many of `orders` random orders of the losses have a z as far from zero.

    forecasts: code, trade_date, var, es, ret. Where a series has no more orders than that, all are taken, and p is exact.
    Random orders are the same for all series of one length, which lie together, so that they are drawn once; shares is a
    part of their seed. Only losses above the least var can count, so that only their places are followed.
    """
    kind = forecasts.schema["code"].dataType.simpleString()

    def figures(loss: np.ndarray, var: np.ndarray, es: np.ndarray) -> tuple[float, float]:
        n, bound = len(loss), np.where(es > 0, var, np.inf)
        tail = np.where(es > 0, es, 1.0)
        least = np.nanmin(bound) if not np.isnan(bound).all() else np.inf
        large = np.flatnonzero(loss > least)

        def of(days: np.ndarray) -> np.ndarray:
            x = loss[large]
            i, j = np.nonzero(x[:, None] > bound.take(days))
            return np.bincount(j, x[i] / tail[days[i, j]], days.shape[1]) / (n * (1 - level)) - 1

        seen = float(of(large[:, None])[0])
        near = abs(seen) * (1 - 1e-12)
        if math.factorial(min(n, 20)) <= orders:
            parts = [np.array(list(every_order(range(n)))).T]
        else:
            draw = _kept_draw if n <= 4096 else _draw
            parts = (draw(n, orders, shares, seed, lo) for lo in range(0, orders, 256))
        far = taken = 0
        for days in parts:
            far, taken = far + int((np.abs(of(days[large])) >= near).sum()), taken + days.shape[1]
        return seen, far / taken

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [figures(-np.array(r, float), np.array(v, float), np.array(e, float)) for r, v, e in zip(b["_r"], b["_v"], b["_e"])]
            z, p = (pd.Series([f[k] for f in found], dtype=float, index=b.index) for k in (0, 1))
            yield pd.DataFrame({"code": b["code"], "n": b["_n"].astype("int64"), "z": z, "p": p})

    whole = forecasts.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("trade_date", "ret", "var", "es"))).alias("_s"))
    series = whole.select("code", F.size("_s").alias("_n"), F.col("_s.ret").alias("_r"), F.col("_s.var").alias("_v"), F.col("_s.es").alias("_e"))
    tasks = int(forecasts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a stated number of partitions is not merged into fewer, as tests are dear where rows are few
    dealt = series.repartition(tasks, "_n", F.pmod(F.xxhash64("code"), F.lit(16))).sortWithinPartitions("_n")
    return dealt.mapInPandas(run, f"code {kind}, n long, z double, p double")


def ruin_share(draws: np.ndarray, size: float, threshold: float = 0.5) -> float:
    """Share of wealth paths (rows of returns, taken at a share `size` of wealth) that fall to the threshold."""
    wealth = np.cumsum(np.log(np.maximum(1 + size * draws, 1e-12)), axis=1)
    return float((wealth.min(1) <= math.log(threshold)).mean())


def optimal_size(x: np.ndarray, acceptable: float = 0.01, paths: int = 10_000, steps: int = 252, rounds: int = 20, threshold: float = 0.5, seed: int = 42) -> dict[str, float]:
    """The size of highest expected wealth whose ruin is acceptable, by halving the range up to half of Kelly's (between a
    hundredth and one); every candidate meets the same resampled paths, so that ruin never falls as sizes grow.

    Logarithms are taken of the series, not of its draws. A path's logarithm is concave in the size and 0 at none, so that
    one which does not fall at a size falls at no smaller one: such paths, but for those within rounding, need no more steps.
    """
    mu, var = float(x.mean()), float(x.var(ddof=1)) if len(x) > 1 else 0.0
    low, high = 0.0, max(min(0.5 * mu / var if var > 0 else 0.25, 1.0), 0.01)
    values, most, floor = x.astype(np.float32), high, math.log(threshold)
    best, best_wealth, best_ruin = 0.0, 0.0, 0.0

    def lowest(f: float, places: np.ndarray) -> np.ndarray:
        growth = np.log(np.maximum(1 + f * values, 1e-12))
        wealth, least = np.zeros(places.shape[1], np.float32), np.full(places.shape[1], np.inf, np.float32)
        for at in places:
            wealth += growth.take(at)
            np.minimum(least, wealth, out=least)
        return least

    every = resampled(len(x), paths, steps, seed)
    places = every[:, lowest(high, every) <= floor + 0.01]
    for _ in range(rounds):
        f = (low + high) / 2
        least = lowest(f, places)
        ruin = float((least <= floor).sum() / paths)
        if ruin <= acceptable:
            wealth = max((1 + f * mu) ** steps, threshold)
            best, best_wealth, best_ruin = (f, wealth, ruin) if wealth > best_wealth else (best, best_wealth, best_ruin)
            low = f
        else:
            high, places = f, places[:, least <= floor + 0.01]
    return {"size": best, "most": most, "ruin": best_ruin, "wealth": best_wealth, "growth": max(best * mu - best**2 * var / 2, 0.0)}


def rolling(rows: DataFrame, column: str, function: Callable[[np.ndarray], float], window: int, name: str = "value", by: str = "code", order: str = "trade_date", many: bool = False) -> DataFrame:
    """rows with a column: the user's function of the last `window` values of each row's key, null where there are fewer.

    The function sees an array of doubles and may raise: such a row gets null. With `many` it takes a matrix of frames, a row
    each, and gives an array; where that raises, each frame is tried alone. A task holds one key's rows.
    """

    def alone(frames: np.ndarray) -> list[float]:
        out = []
        for x in frames:
            try:
                out.append(float(function(x[None])[0] if many else function(x)))
            except Exception:  # noqa: BLE001 - what a user's function raises is a missing value here
                out.append(math.nan)
        return out

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(order, "ascending")], null_placement="at_start"))
        v = pc.cast(table.column("_v"), pa.float64()).to_numpy()
        value = np.full(len(v), math.nan)
        if len(v) >= window:
            frames = sliding_window_view(v, window)
            for lo in range(0, len(frames), 1024):
                part = np.ascontiguousarray(frames[lo : lo + 1024])
                try:
                    value[window - 1 + lo : window - 1 + lo + len(part)] = function(part) if many else alone(part)
                except Exception:  # noqa: BLE001
                    value[window - 1 + lo : window - 1 + lo + len(part)] = alone(part)
        return table.drop_columns(["_v"]).append_column(name, pa.array(value, pa.float64(), from_pandas=True))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn("_v", F.col(column).cast("double")).groupBy(by).applyInArrow(run, f"{kinds}, `{name}` double")


def row_results(rows: DataFrame, function: Callable[..., float], *columns: str) -> DataFrame:
    """rows with value and error: the user's function of each row's columns, or the name of the exception that it raised.

    Rows travel in Arrow batches; one that fails does not stop the others.
    """

    @F.pandas_udf("struct<value:double,error:string>")
    def apply(*v: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for x in zip(*v):
            try:
                values.append(float(function(*x)))
                errors.append(None)
            except Exception as e:  # noqa: BLE001 - failures are results
                values.append(None)
                errors.append(type(e).__name__)
        return pd.DataFrame({"value": pd.Series(values, dtype=float), "error": errors})

    return rows.withColumn("_r", apply(*[F.col(c) for c in columns])).select("*", "_r.value", "_r.error").drop("_r")


def result_counts(results: DataFrame, *by: str) -> DataFrame:
    """by, n, failed, and the mean value of row_results() without the failures."""
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.avg(F.when(F.col("error").isNull() & ~F.isnan("value"), F.col("value"))).alias("mean"))
