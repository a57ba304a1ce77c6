"""Factor validation: information coefficients, layers, ranking measures and multiple testing.

Rows are long: trade_date, code, value, fwd (the return after). Ties go by code, so that results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_ic(rows: DataFrame, date: str = "trade_date", least: int = 30) -> DataFrame:
    """date, n, ic: Spearman's coefficient from ordinal ranks; null below `least` pairs."""
    w = Window.partitionBy(date)
    d = F.row_number().over(w.orderBy("value", "code")) - F.row_number().over(w.orderBy("fwd", "code"))
    ranked = rows.where("value IS NOT NULL AND fwd IS NOT NULL").select(date, d.cast("double").alias("d"))
    n = F.count("*").cast("double")
    return ranked.groupBy(date).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, 1 - 6 * F.sum(F.col("d") * F.col("d")) / F.nullif(n * (n * n - 1), F.lit(0.0))).alias("ic"))


def average_rank(value: str, *by: str) -> Column:
    """Rank that equal values share as their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def spearman(rows: DataFrame, date: str = "trade_date", least: int = 3) -> DataFrame:
    usable = rows.where("value IS NOT NULL AND fwd IS NOT NULL AND NOT isnan(value) AND NOT isnan(fwd)")
    ranked = usable.select(date, average_rank("value", date).alias("a"), average_rank("fwd", date).alias("b"))
    c = F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))
    return ranked.groupBy(date).agg(F.when(F.count("*") >= least, c).alias("ic"))


def information_ratio(ics: DataFrame, by: list[str], ic: str = "ic", least: int = 12) -> DataFrame:
    return ics.groupBy(*by).agg(F.avg(ic).alias("mean_ic"), F.when(F.count(ic) >= least, F.try_divide(F.avg(ic), F.stddev_pop(ic))).alias("ir"), F.count(ic).alias("n"))


def with_layers(rows: DataFrame, groups: int = 10, date: str = "trade_date") -> DataFrame:
    """rows with a column layer from 1 to groups, by value: floor(n / groups) each, the rest in the last."""
    w = Window.partitionBy(date)
    size = F.floor(F.count("*").over(w) / groups)
    k = F.row_number().over(w.orderBy("value", "code")) - 1
    return rows.withColumns({"layer": (F.least(F.floor(k / F.greatest(size, F.lit(1))), F.lit(groups - 1)) + 1).cast("int"), "_n": F.count("*").over(w)}).where(F.col("_n") >= 3 * groups).drop("_n")


def layered(rows: DataFrame, groups: int = 10, date: str = "trade_date") -> DataFrame:
    return with_layers(rows, groups, date).groupBy(date, "layer").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean_fwd"), F.avg("value").alias("mean_value"))


def monotonicity(layers: DataFrame, date: str = "trade_date") -> DataFrame:
    """date, share: of pairs of layers a < b, those whose mean return rises."""
    x = layers.select(date, F.col("layer").alias("a"), F.col("mean_fwd").alias("p"))
    y = layers.select(F.col(date).alias("_d"), F.col("layer").alias("b"), F.col("mean_fwd").alias("q"))
    pairs = x.join(y, (F.col(date) == F.col("_d")) & (F.col("a") < F.col("b")))
    return pairs.groupBy(date).agg(F.avg((F.col("q") > F.col("p")).cast("double")).alias("share"))


def ndcg(rows: DataFrame, k: int = 30, date: str = "trade_date") -> DataFrame:
    """date, ndcg: gains are positive returns; the predicted top k against the ideal one."""
    w = Window.partitionBy(date)
    gain = F.pow(F.lit(2.0), F.greatest("fwd", F.lit(0.0))) - 1
    ranked = rows.select(date, gain.alias("g"), F.row_number().over(w.orderBy(F.desc("value"), "code")).alias("p"), F.row_number().over(w.orderBy(F.desc("fwd"), "code")).alias("q"))
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col("g") / F.log2(F.col(r) + 1)))
    return ranked.groupBy(date).agg(F.try_divide(part("p"), part("q")).alias("ndcg"))


def ranking_metric(rows: DataFrame, k: int = 5, date: str = "trade_date") -> DataFrame:
    """date, metric: how far the top k's mean return lies between the mean of all and that of the best k."""
    w = Window.partitionBy(date)
    ranked = rows.select(date, "fwd", F.row_number().over(w.orderBy(F.desc("value"), "code")).alias("p"), F.row_number().over(w.orderBy(F.desc("fwd"), "code")).alias("q"))
    top, best, every = F.avg(F.when(F.col("p") <= k, F.col("fwd"))), F.avg(F.when(F.col("q") <= k, F.col("fwd"))), F.avg("fwd")
    return ranked.groupBy(date).agg(F.try_divide(top - every, best - every).alias("metric"))


def autocorrelation(rows: DataFrame, date: str = "trade_date", least: int = 30) -> DataFrame:
    """date, corr: correlation of ordinal ranks with those of the date before, over codes in both."""
    dates = rows.select(date).distinct()
    dates = dates.select(date, F.lead(date).over(Window.partitionBy(F.lit(1)).orderBy(date)).alias("_next"))
    a = rows.join(F.broadcast(dates), date).select(F.col("_next").alias(date), "code", F.col("value").alias("before"))
    both = a.join(rows.select(date, "code", "value"), [date, "code"])
    w = Window.partitionBy(date)
    ranked = both.select(date, F.row_number().over(w.orderBy("before", "code")).alias("a"), F.row_number().over(w.orderBy("value", "code")).alias("b"))
    return ranked.groupBy(date).agg(F.count("*").alias("n"), F.corr("a", "b").alias("corr")).where(F.col("n") >= least).select(date, "corr")


def multiple_testing(tests: DataFrame, p: str = "p", name: str = "name", alpha: float = 0.05) -> DataFrame:
    """tests with adjusted p-values and verdicts by Bonferroni, Holm, Benjamini-Hochberg and Benjamini-Yekutieli.

    Holm's are made monotone and Benjamini-Yekutieli's scaled, as intended (the reference leaves both out).
    """
    one = Window.partitionBy(F.lit(1))
    up = one.orderBy(p, name)
    base = tests.withColumns({"_m": F.count("*").over(one).cast("double"), "_i": F.row_number().over(up).cast("double")})
    base = base.withColumn("_c", F.sum(1 / F.col("_i")).over(one))
    so_far, from_here = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(0, Window.unboundedFollowing)
    scaled = F.col(p) * F.col("_m") / F.col("_i")
    adjusted = {
        "bonferroni": F.least(F.col(p) * F.col("_m"), F.lit(1.0)),
        "holm": F.max(F.least(F.col(p) * (F.col("_m") - F.col("_i") + 1), F.lit(1.0))).over(so_far),
        "bh": F.min(F.least(scaled, F.lit(1.0))).over(from_here),
        "by": F.min(F.least(scaled * F.col("_c"), F.lit(1.0))).over(from_here),
    }
    out = base.withColumns(adjusted)
    return out.withColumns({f"{k}_reject": F.col(k) < alpha if k == "bonferroni" else F.col(k) <= alpha for k in adjusted}).drop("_m", "_i", "_c")


def score_ic(mean_ic: Column, t: Column) -> Column:
    """Points of the first dimension (thresholds are fixed values)."""
    return F.when((F.abs(mean_ic) >= 0.05) & (F.abs(t) >= 3), 30).when((F.abs(mean_ic) >= 0.02) & (F.abs(t) >= 2), 20).when(F.abs(mean_ic) >= 0.01, 10).otherwise(0)


def verdict(points: Column) -> Column:
    return F.when(points >= 80, "PASS").when(points >= 55, "CONDITIONAL").otherwise("FAIL")


def grade(ir: Column, t: Column, share: Column) -> Column:
    """A to D from points for the absolute information ratio, t and the share of positive coefficients."""
    points = (
        F.when(F.abs(ir) >= 0.5, 3).when(F.abs(ir) >= 0.3, 2).when(F.abs(ir) >= 0.1, 1).otherwise(0)
        + F.when(F.abs(t) >= 3, 3).when(F.abs(t) >= 2, 2).when(F.abs(t) >= 1, 1).otherwise(0)
        + F.when(F.abs(share - 0.5) >= 0.2, 2).when(F.abs(share - 0.5) >= 0.1, 1).otherwise(0)
    )
    return F.when(points >= 7, "A").when(points >= 5, "B").when(points >= 3, "C").otherwise("D")
