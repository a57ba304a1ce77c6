"""Pairwise ranking losses and Cholesky factors over grouped rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_loss(rows: DataFrame, k: int = 5, date: str = "trade_date") -> DataFrame:
    """date, ideal, loss: 1 - NDCG@k of value against label (0 where no label is positive); gains are 2^label - 1."""
    by = Window.partitionBy(date)
    places = rows.select(date, F.pow(F.lit(2.0), "label").alias("g"), F.row_number().over(by.orderBy(F.desc("value"), "code")).alias("p"), F.row_number().over(by.orderBy(F.desc("label"), "code")).alias("q"))
    gain = lambda at: F.coalesce(F.sum(F.when(F.col(at) <= k, (F.col("g") - 1) / F.log2(F.col(at) + 1.0))), F.lit(0.0))
    sums = places.groupBy(date).agg(gain("q").alias("ideal"), gain("p").alias("seen"))
    return sums.select(date, "ideal", F.when(F.col("ideal") == 0, 0.0).otherwise(1 - F.col("seen") / F.col("ideal")).alias("loss"))


def slope_sums(at: np.ndarray, s: np.ndarray, weight: np.ndarray, sigma: float = 1.0, nodes: int = 24, block: int = 8192) -> np.ndarray:
    """At each place of `at`, and for each column of weight, the sum of weight times z (1 - z), z the logistic function of
    sigma times the distance from s.

    The sum is analytic within pi / sigma of the real line, so that over each interval of 2 / sigma that has places the
    polynomial through 24 Chebyshev nodes is the sum to a double's precision; sums are taken at the nodes alone.
    """
    at, s = np.asarray(at, float) * sigma, np.asarray(s, float) * sigma
    x = np.cos((2 * np.arange(nodes) + 1) * np.pi / (2 * nodes))
    side = (-1.0) ** np.arange(nodes) * np.sin((2 * np.arange(nodes) + 1) * np.pi / (2 * nodes))
    out, cell = np.zeros((len(at), weight.shape[1])), np.floor(at / 2)
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.diff(cell[order], prepend=np.nan) != 0)
    for rows in np.split(order, starts[1:]) if len(order) else ():
        middle = 2 * cell[rows[0]] + 1
        place = x + middle if len(rows) > nodes else at[rows]
        sums = np.zeros((len(place), weight.shape[1]))
        for lo in range(0, len(s), block):
            e = np.exp(-np.abs(place[:, None] - s[lo : lo + block]))
            sums += (e / (1 + e) ** 2) @ weight[lo : lo + block]
        if len(rows) > nodes:
            far = at[rows, None] - middle - x
            hit = far == 0
            w = side / np.where(hit, 1.0, far)
            w = np.where(hit.any(1)[:, None], hit, w)
            sums = (w @ sums) / w.sum(1, keepdims=True)
        out[rows] = sums
    return out


def ranking_gradient(rows: DataFrame, k: int = 5, sigma: float = 1.0, block: int = 8192, date: str = "trade_date") -> DataFrame:
    """date, code, gradient: over pairs with unequal labels, the change of gains over the ideal, weighted by the slope of
    the logistic function at sigma times the difference of values; against the row of the higher label.

    Each task holds one date's codes, labels and values; all pairs count, by
    sums that take time in proportion to the codes, `block` of them at a time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gain, s, ideal = 2.0 ** pdf.label.to_numpy(float), pdf.value.to_numpy(float), float(pdf.ideal.iloc[0])
        out = np.zeros(len(pdf))
        if ideal:
            ones, gains = slope_sums(s, s, np.stack([np.ones(len(s)), gain], 1), sigma, block=block).T
            out = -sigma * (gain * ones - gains) / ideal
        return pd.DataFrame({date: pdf[date], "code": pdf.code, "gradient": out})

    kinds = dict(rows.dtypes)
    joined = rows.select(date, "code", "label", "value").join(ranking_loss(rows, k, date).select(date, "ideal"), date)
    # a stated number of partitions is not merged into fewer, as little is read and much computed
    spread = joined.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), date)
    return spread.groupBy(date).applyInPandas(run, f"{date} {kinds[date]}, code {kinds['code']}, gradient double")


def cholesky(a: np.ndarray, floor: float = 1e-15) -> np.ndarray:
    """Lower factor of a; squares on the diagonal are at least `floor`, so that a singular matrix has one too."""
    low = np.zeros_like(a, dtype=float)
    for j in range(len(a)):
        rest = a[j:, j] - low[j:, :j] @ low[j, :j]
        low[j, j] = np.sqrt(max(rest[0], floor))
        low[j + 1 :, j] = rest[1:] / low[j, j]
    return low
