"""Data-quality checks: each aggregates a table to a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the distribution check (fixed values).
BOUNDS = {"pe": (0.0, 1e4), "pb": (0.0, 100.0), "roe": (-1.0, 1.0), "roa": (-1.0, 1.0), "return": (-1.0, 1.0), "close": (0.01, 1e6), "volume": (0.0, 1e12), "amount": (0.0, 1e14), "factor_value": (-100.0, 100.0)}


def completeness(df: DataFrame, columns: list[str], limit: float = 0.05) -> DataFrame:
    """column, missing, passed: the share of nulls of each column; an empty table fails."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "missing").withColumn("passed", F.coalesce(F.col("missing") < limit, F.lit(False)))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, repeated: rows beyond the first of each key."""
    per = df.groupBy(*keys).agg(F.count("*").alias("k"))
    return per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("repeated"))


def distribution(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """low3, high3, passed: whether mean ± 3 sample deviations stay within the bounds."""
    m, s = F.avg(column), F.coalesce(F.stddev_samp(column), F.lit(0.0))
    return df.agg((m - 3 * s).alias("low3"), (m + 3 * s).alias("high3")).withColumn("passed", (F.col("low3") >= low) & (F.col("high3") <= high))


def freshness(df: DataFrame, date: str, as_of: Column, max_age: int = 3) -> DataFrame:
    """age, passed: days from the last date to as_of, less one on Saturdays and two on Sundays."""
    weekend = F.when(F.dayofweek(as_of) == 7, 1).when(F.dayofweek(as_of) == 1, 2).otherwise(0)
    return df.agg(F.max(date).alias("last")).select((F.datediff(as_of, "last") - weekend).cast("long").alias("age")).withColumn("passed", F.coalesce(F.col("age") <= max_age, F.lit(False)))


def volume_anomaly(df: DataFrame, date: str, limit: float = 0.5) -> DataFrame:
    """date, n, anomaly: whether a day has fewer rows than `limit` times the mean of the days before."""
    daily = df.groupBy(date).agg(F.count("*").alias("n"))
    before = F.avg("n").over(Window.partitionBy(F.lit(1)).orderBy(date).rowsBetween(Window.unboundedPreceding, -1))
    return daily.select(date, "n", F.coalesce(F.col("n") / before < limit, F.lit(False)).alias("anomaly"))
