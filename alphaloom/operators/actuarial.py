"""Credibility of signal sources, ruin, reserves by premium and their variation, and copula likelihoods.

Sources are long: a key, an order (`trade_date`), a value. What a step needs of all sources together is a few sums, taken
as windows over one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.functions.scalar import norm_cdf
from alphaloom.operators.risk import bornhuetter_ferguson, chain_ladder, development_factors


def one() -> Window:
    """All rows: for a few rows, one for each source or date."""
    return Window.partitionBy(F.lit(1))


def credibility(records: DataFrame, by: str, value: str, half_life: int | None = None, within: list[str] | None = None) -> DataFrame:
    """within, by, n, credibility, posterior, weight by Bühlmann and Straub.

    Z = n / (n + m / v), m the mean variance within sources and v the variance of their means (a tenth of m where that
    is not positive). Weights are the softmax of posterior over its deviation, kept within 50. With a half-life, values
    count by how many lie after them, and n is the sum of these weights. within: columns whose groups stand apart.
    """
    groups = within or []
    all_ = Window.partitionBy(*groups) if groups else one()
    own = Window.partitionBy(*groups, by)
    decay = F.lit(1.0) if half_life is None else F.pow(F.lit(0.5 ** (1.0 / half_life)), F.count("*").over(own) - F.row_number().over(own.orderBy("trade_date")))
    rows = records.where(F.col(value).isNotNull()).select(*groups, by, F.col(value).alias("x"), decay.alias("d"))
    s = rows.groupBy(*groups, by).agg(F.sum("d").alias("n"), F.avg("x").alias("plain"), (F.sum(F.col("x") * F.col("d")) / F.sum("d")).alias("mean"), F.var_samp("x").alias("s2"))
    s = s.withColumns({"m": F.avg("s2").over(all_), "v": F.coalesce(F.var_samp("plain").over(all_), F.lit(0.0)), "grand": F.avg("plain").over(all_)})
    s = s.withColumn("v", F.when(F.col("v") <= 0, 0.1 * F.col("m")).otherwise(F.col("v")))
    z = F.col("n") / (F.col("n") + F.col("m") / F.col("v"))
    s = s.withColumn("credibility", z).withColumn("posterior", F.col("credibility") * F.col("mean") + (1 - F.col("credibility")) * F.col("grand"))
    ratio = F.col("posterior") / F.sqrt(F.col("m") / (F.col("n") + F.col("m") / F.col("v")))
    s = s.withColumn("e", F.coalesce(F.exp(F.greatest(F.least(ratio, F.lit(50.0)), F.lit(-50.0))), F.lit(1.0)))
    return s.select(*groups, by, "n", "credibility", "posterior", (F.col("e") / F.sum("e").over(all_)).alias("weight"))


def hierarchical(records: DataFrame, by: str, value: str, regime: str) -> DataFrame:
    """by, blended, regimes: weights of each regime with two sources or more, blended by how often the regime occurs.

    records: trade_date, one regime for each date.
    """
    sizes = records.groupBy(regime).agg(F.countDistinct("trade_date").alias("periods"), F.countDistinct(by).alias("sources"))
    share = sizes.select(regime, (F.col("periods") / F.sum("periods").over(one())).alias("share"), "sources").where("sources >= 2")
    w = credibility(records, by, value, within=[regime]).join(F.broadcast(share), regime)
    return w.groupBy(by).agg((F.sum(F.col("share") * F.col("weight")) / F.sum("share")).alias("blended"), F.count("*").alias("regimes"))


def hachemeister(records: DataFrame, by: str, value: str, least: int = 5) -> DataFrame:
    """by, intercept, slope, z0, z1, blended: regressions of a value on the one before, drawn to the pooled one.

    Z = A (A + s² (X'X)^-1)^-1, A the covariance of the sources' coefficients and s² their mean residual variance; its
    diagonal blends. Sources of fewer than `least` values are left out.
    """
    w = Window.partitionBy(by).orderBy("trade_date")
    rows = records.select(by, F.col(value).alias("y"), F.lag(value).over(w).alias("x"), F.count("*").over(Window.partitionBy(by)).alias("all")).where((F.col("all") >= least) & F.col("x").isNotNull())
    sums = [F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy")]
    s = rows.groupBy(by).agg(*sums)
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    b1 = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), det)
    s = s.withColumns({"det": det, "slope": b1}).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    s = s.withColumn("s2", (F.col("syy") - F.col("intercept") * F.col("sy") - F.col("slope") * F.col("sxy")) / F.greatest(F.col("n") - 2, F.lit(1.0)))
    total = {c: F.sum(c).over(one()) for c in ("n", "sx", "sy", "sxx", "sxy")}
    pooled = (total["n"] * total["sxy"] - total["sx"] * total["sy"]) / (total["n"] * total["sxx"] - total["sx"] * total["sx"])
    s = s.withColumns({"p1": pooled, "a00": F.var_samp("intercept").over(one()), "a11": F.var_samp("slope").over(one()), "a01": F.covar_samp("intercept", "slope").over(one()), "v": F.avg("s2").over(one())})
    s = s.withColumn("p0", F.sum("sy").over(one()) / F.sum("n").over(one()) - F.col("p1") * F.sum("sx").over(one()) / F.sum("n").over(one()))
    m00, m11, m01 = F.col("a00") + F.col("v") * F.col("sxx") / F.col("det"), F.col("a11") + F.col("v") * F.col("n") / F.col("det"), F.col("a01") - F.col("v") * F.col("sx") / F.col("det")
    d = m00 * m11 - m01 * m01
    z0, z1 = (F.col("a00") * m11 - F.col("a01") * m01) / d, (F.col("a11") * m00 - F.col("a01") * m01) / d
    s = s.withColumns({"z0": z0, "z1": z1})
    return s.select(by, "intercept", "slope", "z0", "z1", (F.col("z0") * F.col("intercept") + (1 - F.col("z0")) * F.col("p0")).alias("blended"))


def ruin(returns: DataFrame, by: str = "code", surplus: float = 0.5, size: float = 1.0) -> DataFrame:
    """by, cramer_lundberg, beekman_bowers, lundberg: ruin of a surplus from gains and losses of one trade each.

    Surplus and gains are in the same unit: returns times size. (The reference sets returns against money, which gives
    about 0.)
    """
    x = F.col("ret") * size
    s = returns.groupBy(by).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(x < 0, -x)), F.lit(0.0)).alias("lost"), F.count(F.when(x < 0, 1)).alias("losses"),
        F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("gained"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"),
        F.coalesce(F.sum(F.when(x < 0, F.greatest(surplus + x, F.lit(0.0)))), F.lit(0.0)).alias("below"),
    )
    mu, c = F.try_divide("lost", "losses"), F.col("gained") / F.col("n")
    theta = F.try_divide(F.col("gained"), F.col("lost")) - 1
    exact = F.exp(-theta * surplus / (mu * (1 + theta))) / (1 + theta)
    rho, equilibrium = F.try_divide(mu, c), F.least(F.try_divide(F.col("below"), F.col("lost")), F.lit(1.0))
    bound = F.exp(-2 * F.try_divide("mean", "var") * surplus)
    none, sure = F.col("losses") == 0, F.coalesce(theta, F.lit(0.0)) <= 0
    return s.select(
        by,
        F.when(none, 0.0).when(sure, 1.0).otherwise(F.least(exact, F.lit(1.0))).alias("cramer_lundberg"),
        F.when(none, 0.0).when((F.col("gained") == 0) | (rho >= 1), 1.0).otherwise((1 - rho) * (1 - equilibrium)).alias("beekman_bowers"),
        F.when((F.col("mean") <= 0) | (F.coalesce("var", F.lit(0.0)) == 0), 1.0).otherwise(F.least(bound, F.lit(1.0))).alias("lundberg"),
    )


def survived(ruin_at: DataFrame, days: int) -> DataFrame:
    """by, period, ruin of ruin_at (code, period, ruin), given that the first `days` were survived."""
    known = F.max_by(F.when(F.col("period") <= days, F.col("ruin")), F.when(F.col("period") <= days, F.col("period"))).over(Window.partitionBy("code"))
    k = F.coalesce(known, F.lit(0.0))
    return ruin_at.select("code", "period", F.when(F.col("period") <= days, 0.0).when(k >= 1, F.col("ruin")).otherwise((F.col("ruin") - k) / (1 - k)).alias("ruin"))


def risk_budget(drawdown: Column, most: Column) -> Column:
    """The position that a drawdown leaves: most * (1 - drawdown / 2), at least a hundredth."""
    return F.greatest(F.lit(0.01), most * F.greatest(1 - drawdown / 2, F.lit(0.0)))


def mack_cv(triangle: DataFrame) -> DataFrame:
    """cv: Mack's variation of the ultimates, sqrt(Σ ult² Σ σ² / f²) over their sum; one row.

    σ² of a development year weighs squared residuals of the link ratios by c, over one less than their number.
    """
    f = development_factors(triangle)
    n = triangle.agg((F.max("i") + 1).alias("n"))
    links = triangle.withColumn("later", F.lead("c").over(Window.partitionBy("i").orderBy("j"))).where("later IS NOT NULL AND c > 0")
    links = links.join(F.broadcast(f), "j").groupBy("j").agg(F.sum(F.col("c") * F.pow(F.col("later") / F.col("c") - F.col("factor"), F.lit(2))).alias("ss"), F.max("factor").alias("f"))
    sigma = links.join(F.broadcast(n), how="cross").select(F.col("j").alias("k"), F.when(F.col("n") - F.col("j") - 2 >= 1, F.col("ss") / (F.col("n") - F.col("j") - 2) / (F.col("f") * F.col("f"))).otherwise(0.0).alias("s"))
    u = chain_ladder(triangle)
    part = u.join(F.broadcast(sigma), (F.col("k") >= F.col("j")) & (F.col("i") >= 1) & (F.col("ultimate") > 0)).agg(F.sum(F.col("ultimate") * F.col("ultimate") * F.col("s")).alias("var"))
    return part.join(u.agg(F.sum("ultimate").alias("total")), how="cross").select(F.try_divide(F.sqrt(F.coalesce("var", F.lit(0.0))), "total").alias("cv"))


def cape_cod(triangle: DataFrame, premiums: DataFrame, belief: float = 0.7) -> DataFrame:
    """i, paid, ultimate: the prior is premium times the loss ratio of what is known to what is earned. premiums: i, premium."""
    c = chain_ladder(triangle).join(premiums, "i")
    prior = c.withColumn("elr", F.sum("paid").over(one()) / F.sum(F.col("premium") * F.col("paid") / F.col("ultimate")).over(one()))
    return bornhuetter_ferguson(triangle, prior.select("i", (F.col("premium") * F.col("elr")).alias("prior")), belief)


def deflated_sharpe(sharpe: Column, trials: int, n: Column) -> tuple[Column, Column]:
    """The p-value of a Sharpe ratio as the best of so many trials, and the ratio less the best that chance would give."""
    se = F.sqrt((1 + 0.5 * sharpe * sharpe) / n)
    best = se * F.sqrt(2 * F.log(F.lit(float(max(trials, 1)))))
    return 1 - norm_cdf((sharpe - best) / se), F.greatest(sharpe - best, F.lit(0.0))


def probabilistic_sharpe(sharpe: Column, benchmark: float, n: Column, skew: Column, kurtosis: Column) -> Column:
    """Probability that the ratio is above the benchmark, with skewness and (plain) kurtosis in its error."""
    d = sharpe - benchmark
    se = F.sqrt((1 - skew * d + (kurtosis - 1) / 4 * d * d) / n)
    return norm_cdf(F.try_divide(d, se))


def gumbel_loglik(u: Column, v: Column, theta: Column) -> Column:
    """Log density of the Gumbel copula; sum it over observations."""
    x, y = -F.log(u), -F.log(v)
    s = F.pow(x, theta) + F.pow(y, theta)
    w = F.pow(s, 1 / theta)
    return F.log(w + theta - 1) - w + x + y + (theta - 1) * (F.log(x) + F.log(y)) + (1 / theta - 2) * F.log(s)


def frank_loglik(u: Column, v: Column, theta: Column) -> Column:
    """Log density of the Frank copula, theta not 0."""
    e = lambda x: F.exp(-theta * x)
    d = (1 - F.exp(-theta)) - (1 - e(u)) * (1 - e(v))
    return F.log(theta * (1 - F.exp(-theta)) * e(u + v)) - 2 * F.log(F.abs(d))
