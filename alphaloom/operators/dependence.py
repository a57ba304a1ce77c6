"""Dependence of many series at once: copulas of d variables, their draws, and dynamic conditional correlation.

Fits are made per book (a group of series, whose returns fit a task). Draws are split by share: each task makes its own
from a seed of its own, so that a book's scenarios are spread over the cluster; what is kept of them is one number a
scenario, or a row for each scenario and series.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.operators import copulas as cop
from alphaloom.operators.engines import garch, shrunk_covariance
from alphaloom.operators.ranking import cholesky

#: Degrees of freedom that the likelihood of t is taken over.
DEGREES = (2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 15.0, 20.0, 30.0)
ARCHIMEDEAN = ("clayton", "gumbel", "rotated_gumbel", "frank")


@lru_cache(maxsize=64)
def _gumbel_polynomial(d: int, alpha: float) -> np.ndarray:
    """Coefficients of the d-th derivative of exp(-t^alpha): signed Stirling numbers of the first kind meet the second."""
    first, second = np.zeros((d + 1, d + 1)), np.zeros((d + 1, d + 1))
    first[0, 0] = second[0, 0] = 1
    for n in range(1, d + 1):
        for k in range(1, n + 1):
            first[n, k] = first[n - 1, k - 1] - (n - 1) * first[n - 1, k]
            second[n, k] = second[n - 1, k - 1] + k * second[n - 1, k]
    return np.array([(-1) ** (d - k) * sum(alpha**j * first[d, j] * second[j, k] for j in range(k, d + 1)) for k in range(d + 1)])


@lru_cache(maxsize=64)
def _eulerian(n: int) -> np.ndarray:
    row = np.ones(1)
    for m in range(2, n + 1):
        row = np.array([(k + 1) * (row[k] if k < m - 1 else 0) + (m - k) * (row[k - 1] if k else 0) for k in range(m)])
    return row


def log_density(family: str, theta: float, u: np.ndarray) -> np.ndarray:
    """Of the exchangeable Archimedean copula of u's columns."""
    d = u.shape[1]
    if family == "rotated_gumbel":
        return log_density("gumbel", theta, 1 - u)
    if family == "clayton":
        return np.log1p(theta * np.arange(d)).sum() - (1 + theta) * np.log(u).sum(1) - (d + 1 / theta) * np.log((u**-theta).sum(1) - d + 1)
    if family == "gumbel":
        x = -np.log(u)
        t = (x**theta).sum(1)
        a = t ** (1 / theta)
        p = np.polyval(_gumbel_polynomial(d, 1 / theta)[::-1], a)
        return d * math.log(theta) - a + (x + (theta - 1) * np.log(x)).sum(1) - d * np.log(t) + np.log(p)
    grow = -np.expm1(-theta * u)
    h = np.exp(np.log(grow).sum(1) + (1 - d) * math.log(-math.expm1(-theta)))
    n = d - 1  # the polylogarithm of order -n is a polynomial over (1 - h)^(n + 1)
    li = np.log(h) + np.log(np.polyval(_eulerian(n)[::-1], h)) - (n + 1) * np.log1p(-h) if n else np.log(h) - np.log1p(-h)
    return n * math.log(theta / -math.expm1(-theta)) + li - theta * u.sum(1) - np.log(h)


def _elliptical(x: np.ndarray, corr: np.ndarray, nu: float) -> np.ndarray:
    """Log density of the joint distribution of x (normal where nu is infinite)."""
    d, sign = x.shape[1], np.linalg.slogdet(corr)
    q = np.einsum("ti,ij,tj->t", x, np.linalg.inv(corr), x)
    if math.isinf(nu):
        return -0.5 * (d * math.log(2 * math.pi) + sign[1] + q)
    return math.lgamma((nu + d) / 2) - math.lgamma(nu / 2) - d / 2 * math.log(nu * math.pi) - 0.5 * sign[1] - (nu + d) / 2 * np.log1p(q / nu)


def _proper(corr: np.ndarray) -> np.ndarray:
    """The nearest correlation matrix whose eigenvalues are at least 1e-6 (by clipping them)."""
    w, v = np.linalg.eigh((corr + corr.T) / 2)
    m = v @ np.diag(np.maximum(w, 1e-6)) @ v.T
    s = np.sqrt(np.diag(m))
    return m / np.outer(s, s)


def fit_copulas(u: np.ndarray) -> list[dict]:
    """Every family that applies to u's columns: family, theta, nu, corr (flat), loglik, aic, best first.

    Correlations are those that Kendall's taus imply, theta is what the mean tau implies (Frank's: the likeliest of a
    grid), nu the likeliest of DEGREES. The Archimedean families need a positive mean tau.
    """
    d = u.shape[1]
    tau = np.eye(d)
    for i in range(d):
        for j in range(i):
            tau[i, j] = tau[j, i] = min(max(cop.kendall(u[:, i], u[:, j]), -0.95), 0.95)
    mean = (tau.sum() - d) / max(d * (d - 1), 1)
    corr, out = _proper(np.sin(math.pi * tau / 2)), []

    def joint(nu: float) -> float:
        x = cop.quantile(u, nu)
        return float((_elliptical(x, corr, nu) - sum(_elliptical(x[:, [i]], np.eye(1), nu) for i in range(d))).sum())

    pairs = d * (d - 1) / 2
    out.append({"family": "gaussian", "theta": 0.0, "nu": math.inf, "corr": corr, "loglik": joint(math.inf), "k": pairs})
    nu = max(DEGREES, key=joint)
    out.append({"family": "t", "theta": 0.0, "nu": nu, "corr": corr, "loglik": joint(nu), "k": pairs + 1})
    if mean > 0.01:
        theta = {"clayton": 2 * mean / (1 - mean), "gumbel": 1 / (1 - mean), "rotated_gumbel": 1 / (1 - mean)}
        theta["frank"] = max(np.linspace(0.25, 20, 80), key=lambda x: np.nan_to_num(log_density("frank", x, u).sum(), nan=-np.inf))
        out += [{"family": f, "theta": float(x), "nu": math.inf, "corr": np.eye(d), "loglik": float(log_density(f, x, u).sum()), "k": 1} for f, x in theta.items()]
    for x in out:
        x["aic"] = 2 * x.pop("k") - 2 * x["loglik"]
    return sorted(out, key=lambda x: x["aic"])


def draw(family: str, theta: float, nu: float, corr: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n rows of the copula: elliptical by the Cholesky factor, Archimedean by a frailty that a row's columns share."""
    r, d = np.random.default_rng(seed), len(corr)
    if family in ("gaussian", "t"):
        x = r.standard_normal((n, d)) @ cholesky(corr).T
        return cop.distribution(x / np.sqrt(r.chisquare(nu, n) / nu)[:, None] if family == "t" else x, nu if family == "t" else math.inf)
    e = r.exponential(size=(n, d))
    if family == "clayton":
        return (1 + e / r.gamma(1 / theta, size=n)[:, None]) ** (-1 / theta)
    if family == "frank":
        v = r.logseries(-math.expm1(-theta), n)[:, None]
        return -np.log1p(math.expm1(-theta) * np.exp(-e / v)) / theta
    alpha, angle, w = 1 / theta, r.uniform(0, math.pi, n), r.exponential(size=n)
    # positive stable of index alpha; at 1 it is the constant 1
    v = np.ones(n) if theta == 1 else np.sin(alpha * angle) / np.sin(angle) ** (1 / alpha) * (np.sin((1 - alpha) * angle) / w) ** ((1 - alpha) / alpha)
    u = np.exp(-((e / v[:, None]) ** alpha))
    return 1 - u if family == "rotated_gumbel" else u


def dcc(returns: np.ndarray, a: float = 0.05, b: float = 0.90) -> dict:
    """Dynamic conditional correlation of d series (columns) with fixed a and b, each standardised by its own GARCH.

    last (correlations after the last row), mean (of the standardised series' products), sigma (each series' next standard
    deviation), loglik (of the Gaussian copula), and nu, t_loglik and aic of the joint t over DEGREES.
    """
    d = returns.shape[1]
    z, sigma = np.empty_like(returns), np.empty(d)
    for k in range(d):
        x = returns[:, k]
        g, x = garch(x), x - x.mean()
        s = x.var()
        for t, q in enumerate(x):
            z[t, k] = q / math.sqrt(s)
            s = g["omega"] + g["alpha"] * q * q + g["beta"] * s
        sigma[k] = math.sqrt(s)
    mean = z.T @ z / len(z)
    q, ll, joint, corr = mean.copy(), 0.0, np.zeros(len(DEGREES)), mean
    for e in z:
        s = np.sqrt(np.diag(q))
        corr = q / np.outer(s, s)
        inverse, (_, det) = np.linalg.inv(corr), np.linalg.slogdet(corr)
        form = e @ inverse @ e
        ll -= 0.5 * (det + form - e @ e)
        joint += [math.lgamma((n + d) / 2) - math.lgamma(n / 2) - d / 2 * math.log(n * math.pi) - 0.5 * det - (n + d) / 2 * math.log1p(form / n) for n in DEGREES]
        q = mean * (1 - a - b) + a * np.outer(e, e) + b * q
    best = int(np.argmax(joint))
    return {"last": corr, "mean": mean, "sigma": sigma, "loglik": ll, "nu": DEGREES[best], "t_loglik": float(joint[best]), "aic": 2 * (3 * d + 3) - 2 * float(joint[best])}


def by_book(returns: DataFrame, fit: Callable[[list, np.ndarray], pd.DataFrame], schema: str, least: int = 60, date: str = "trade_date") -> DataFrame:
    """fit(codes, matrix of dates by codes) of each book (book, code, date, ret), over dates that all its codes have.

    Books with fewer such dates than `least`, or with one code, are left out.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=date, columns="code", values="ret").sort_index().dropna()
        if len(wide) < least or wide.shape[1] < 2:
            return pd.DataFrame(columns=names)
        out = fit(list(wide.columns), wide.to_numpy())
        return out.assign(book=pdf.book.iloc[0])[names]

    return returns.groupBy("book").applyInPandas(run, schema)


def copula_fits(returns: DataFrame, least: int = 60) -> DataFrame:
    """book, codes, place (1: lowest aic), family, theta, nu, corr, loglik, aic, and each code's sorted returns."""

    def fit(codes: list, x: np.ndarray) -> pd.DataFrame:
        u = np.stack([cop.ranks(c) for c in x.T], 1)
        rows = [{**f, "place": k, "codes": codes, "corr": f["corr"].ravel().tolist(), "sorted": np.sort(x, 0).T.tolist()} for k, f in enumerate(fit_copulas(u), 1)]
        return pd.DataFrame(rows)

    return by_book(returns, fit, "book long, codes array<long>, place int, family string, theta double, nu double, corr array<double>, loglik double, aic double, sorted array<array<double>>", least)


def _shares(fits: DataFrame, scenarios: int, shares: int) -> DataFrame:
    """Each fit once for each share of its scenarios, dealt over all tasks."""
    tasks = int(fits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fits.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("n", F.floor((F.col("share") + 1) * scenarios / shares) - F.floor(F.col("share") * scenarios / shares)).withColumn("first", F.floor(F.col("share") * scenarios / shares)).repartition(tasks, F.xxhash64("book", "family", "share"))


def _seed(*key: object) -> int:
    return zlib.crc32("|".join(map(str, key)).encode())


def _at(sorted_returns: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Returns at the probabilities u: between the ordered ones, by their places over one more than their number."""
    n = len(sorted_returns)
    return np.interp(u, np.arange(1, n + 1) / (n + 1), sorted_returns)


def copula_scenarios(fits: DataFrame, scenarios: int = 10_000, shares: int = 16, seed: int = 42) -> DataFrame:
    """book, family, scenario, code, u, ret of draws from the fits (as copula_fits gives them)."""

    def run(batches):
        for b in batches:
            for f in b.itertuples(index=False):
                d = len(f.codes)
                u = draw(f.family, f.theta, f.nu, np.asarray(f.corr).reshape(d, d), int(f.n), _seed(seed, f.book, f.family, f.share))
                ret = np.stack([_at(np.asarray(s), c) for s, c in zip(f.sorted, u.T)], 1)
                yield pd.DataFrame({"book": f.book, "family": f.family, "scenario": np.repeat(f.first + np.arange(int(f.n)), d), "code": np.tile(np.asarray(f.codes), int(f.n)), "u": u.ravel(), "ret": ret.ravel()})

    return _shares(fits, scenarios, shares).mapInPandas(run, "book long, family string, scenario long, code long, u double, ret double")


def _tail(losses: DataFrame, level: float, scenarios: int) -> DataFrame:
    """book, family, var, tail_loss (mean of the worst 1 - level of the scenarios)."""
    k = max(1, math.floor(scenarios * (1 - level) + 1e-9))
    place = F.row_number().over(Window.partitionBy("book", "family").orderBy(F.desc("loss")))
    return losses.withColumn("k", place).where(F.col("k") <= k).groupBy("book", "family").agg(F.min("loss").alias("var"), F.avg("loss").alias("tail_loss"))


def copula_tail_loss(fits: DataFrame, weights: dict | None = None, level: float = 0.99, scenarios: int = 10_000, shares: int = 16, seed: int = 42) -> DataFrame:
    """book, family, place, theta, nu, loglik, aic, var, tail_loss of a portfolio of each book under every fitted family.

    weights: by code, of a book's size; by default equal ones. Only a scenario's loss leaves a task.
    """

    def run(batches):
        for b in batches:
            for f in b.itertuples(index=False):
                d = len(f.codes)
                w = np.full(d, 1 / d) if weights is None else np.array([weights.get(c, 0.0) for c in f.codes])
                u = draw(f.family, f.theta, f.nu, np.asarray(f.corr).reshape(d, d), int(f.n), _seed(seed, f.book, f.family, f.share))
                yield pd.DataFrame({"book": f.book, "family": f.family, "loss": -sum(w[k] * _at(np.asarray(f.sorted[k]), u[:, k]) for k in range(d))})

    tail = _tail(_shares(fits, scenarios, shares).mapInPandas(run, "book long, family string, loss double"), level, scenarios)
    nu = F.when(F.col("nu") < float("inf"), F.col("nu")).alias("nu")
    return fits.select("book", "family", "place", "theta", nu, "loglik", "aic").join(tail, ["book", "family"])


def dcc_fits(returns: DataFrame, least: int = 60) -> DataFrame:
    """book, codes, last, mean (flat correlation matrices), sigma, loglik, nu, t_loglik, aic of each book."""

    def fit(codes: list, x: np.ndarray) -> pd.DataFrame:
        f = dcc(x)
        return pd.DataFrame([{**f, "codes": codes, "family": "dcc", **{k: f[k].ravel().tolist() for k in ("last", "mean", "sigma")}}])

    return by_book(returns, fit, "book long, family string, codes array<long>, last array<double>, mean array<double>, sigma array<double>, loglik double, nu double, t_loglik double, aic double", least)


def dcc_tail_loss(fits: DataFrame, level: float = 0.99, scenarios: int = 10_000, shares: int = 16, seed: int = 42) -> DataFrame:
    """book, family, var, tail_loss of equal weights over the next period: multivariate t draws by the last correlations'
    Cholesky factor, scaled to unit variance and by each series' next standard deviation."""

    def run(batches):
        for b in batches:
            for f in b.itertuples(index=False):
                d, n = len(f.codes), int(f.n)
                r = np.random.default_rng(_seed(seed, f.book, f.share))
                x = r.standard_normal((n, d)) @ cholesky(np.asarray(f.last).reshape(d, d)).T
                x *= np.sqrt((f.nu - 2) / r.chisquare(f.nu, n))[:, None]
                yield pd.DataFrame({"book": f.book, "family": f.family, "loss": -(x * np.asarray(f.sigma)).mean(1)})

    return _tail(_shares(fits, scenarios, shares).mapInPandas(run, "book long, family string, loss double"), level, scenarios)


def covariance_fits(returns: DataFrame, least: int = 12) -> DataFrame:
    """book, family, codes, mean and cov (flat, shrunk towards constant correlation) of each book's returns."""

    def fit(codes: list, x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([{"family": "normal", "codes": codes, "mean": x.mean(0).tolist(), "cov": shrunk_covariance(x).ravel().tolist()}])

    return by_book(returns, fit, "book long, family string, codes array<long>, mean array<double>, cov array<double>", least)


def covariance_scenarios(fits: DataFrame, scenarios: int = 1_000, shares: int = 8, seed: int = 42) -> DataFrame:
    """book, scenario, code, ret: normal draws with the fitted means and covariances, split by share over tasks."""

    def run(batches):
        for b in batches:
            for f in b.itertuples(index=False):
                d, n = len(f.codes), int(f.n)
                low = cholesky(np.asarray(f.cov).reshape(d, d))
                x = np.asarray(f.mean) + np.random.default_rng(_seed(seed, f.book, f.share)).standard_normal((n, d)) @ low.T
                yield pd.DataFrame({"book": f.book, "scenario": np.repeat(f.first + np.arange(n), d), "code": np.tile(np.asarray(f.codes), n), "ret": x.ravel()})

    return _shares(fits, scenarios, shares).mapInPandas(run, "book long, scenario long, code long, ret double")
