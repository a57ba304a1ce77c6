"""Cross-sectional preprocessing: each function takes long rows (keys, value) and windows over a whole date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of the preprocessor (fixed values).
N_SIGMA, MAD_SCALE, MIN_SAMPLE, UNKNOWN = 3.0, 0.6745, 5, "unknown"


def _guarded(v: Column, w: Window, new: Column, least: int = MIN_SAMPLE) -> Column:
    return F.when(F.count(v).over(w) >= least, new).otherwise(v)


def winsorize_mad(rows: DataFrame, keys: list[str], value: str = "value", n_sigma: float = N_SIGMA) -> DataFrame:
    """Clips to median ± n * MAD / 0.6745; unchanged where MAD is 0 or the group has fewer than five."""
    w, v = Window.partitionBy(*keys), F.col(value)
    mid = rows.withColumn("_m", F.median(v).over(w)).withColumn("_d", F.abs(v - F.col("_m")))
    wide = mid.withColumn("_w", F.median("_d").over(w) * n_sigma / MAD_SCALE)
    clipped = F.greatest(F.least(v, F.col("_m") + F.col("_w")), F.col("_m") - F.col("_w"))
    return wide.withColumn(value, _guarded(v, w, F.when(F.col("_w") > 0, clipped).otherwise(v))).drop("_m", "_d", "_w")


def winsorize_sigma(rows: DataFrame, keys: list[str], value: str = "value", n_sigma: float = N_SIGMA, sample: bool = False, least: int = MIN_SAMPLE) -> DataFrame:
    w, v = Window.partitionBy(*keys), F.col(value)
    m, s = F.avg(v).over(w), (F.stddev_samp(v) if sample else F.stddev_pop(v)).over(w)
    return rows.withColumn(value, _guarded(v, w, F.greatest(F.least(v, m + n_sigma * s), m - n_sigma * s), least))


def fill_missing(rows: DataFrame, grid: DataFrame, keys: list[str], on: list[str], value: str = "value", with_median: bool = True) -> DataFrame:
    """grid (all cells that shall be there) with the values of rows; an absent one becomes its group's median, or 0."""
    full = grid.join(rows, on, "left")
    fill = F.median(value).over(Window.partitionBy(*keys)) if with_median else F.lit(0.0)
    return full.withColumn(value, F.coalesce(F.col(value), fill, F.lit(0.0)))


def standardize(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """z-scores with the population deviation; 0 where it is 0; groups of fewer than five are unchanged."""
    w, v = Window.partitionBy(*keys), F.col(value)
    s = F.stddev_pop(v).over(w)
    return rows.withColumn(value, _guarded(v, w, F.when(s > 1e-12, (v - F.avg(v).over(w)) / s).otherwise(0.0)))


def neutralize(rows: DataFrame, keys: list[str], sector: str = "sector", value: str = "value") -> DataFrame:
    """Less the sector's mean; rows without a sector share one."""
    w = Window.partitionBy(*keys, F.coalesce(F.col(sector), F.lit(UNKNOWN)))
    return rows.withColumn(value, F.col(value) - F.avg(value).over(w))


def pipeline(rows: DataFrame, keys: list[str], sector: str = "sector", value: str = "value") -> DataFrame:
    return rows.transform(winsorize_mad, keys, value).transform(standardize, keys, value).transform(neutralize, keys, sector, value)


def fusion_zscore(rows: DataFrame, keys: list[str], value: str = "value", least: int = 10) -> DataFrame:
    """z-scores with the sample deviation; smaller groups go; a vanishing deviation counts as 1."""
    w, v = Window.partitionBy(*keys), F.col(value)
    s = F.stddev_samp(v).over(w)
    z = rows.withColumns({"_n": F.count(v).over(w), "_z": (v - F.avg(v).over(w)) / F.when(s < 1e-12, 1.0).otherwise(s)})
    return z.where(F.col("_n") >= least).withColumn(value, F.col("_z")).drop("_n", "_z")


def industry_zscore(rows: DataFrame, keys: list[str], sector: str = "sector", value: str = "value", least: int = 3) -> DataFrame:
    w, v = Window.partitionBy(*keys, sector), F.col(value)
    s = F.stddev_samp(v).over(w)
    return rows.withColumn(value, F.when(F.count(v).over(w) >= least, (v - F.avg(v).over(w)) / F.when(s < 1e-12, 1.0).otherwise(s)).otherwise(v))


def min_max(rows: DataFrame, keys: list[str], value: str = "value", constant: float = 0.5) -> DataFrame:
    w, v = Window.partitionBy(*keys), F.col(value)
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    return rows.withColumn(value, F.when(hi - lo > 1e-12, (v - lo) / (hi - lo)).otherwise(constant))


def fuse_factors(rows: DataFrame, weights: DataFrame, date: str = "trade_date", min_factors: int = 8, min_codes: int = 30) -> DataFrame:
    """date, code, score: the weighted sum of factor z-scores; codes with few factors and thin dates go.

    weights: factor, weight (signed).
    """
    joined = rows.join(F.broadcast(weights), "factor")
    scored = joined.groupBy(date, "code").agg(F.sum(F.col("value") * F.col("weight")).alias("score"), F.count("*").alias("n")).where(F.col("n") >= min_factors)
    return scored.withColumn("_c", F.count("*").over(Window.partitionBy(date))).where(F.col("_c") >= min_codes).select(date, "code", "score")


def fuse_signals(sources: list[tuple[DataFrame, float]], date: str = "trade_date") -> DataFrame:
    """date, code, score: each source's scores min-max scaled by date and weighted; an absent one counts 0."""
    parts = [min_max(df.select(date, "code", "value"), [date]).select(date, "code", (F.col("value") * w).alias("value")) for df, w in sources]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(date, "code").agg(F.sum("value").alias("score"))
