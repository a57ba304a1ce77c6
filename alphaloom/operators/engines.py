"""Sequential and iterative engines: each fits one entity's series in a grouped pandas function.

A group is one series, portfolio or experiment; its length, not the table's, bounds a task's memory. Where the
reference's formula is at odds with what it names, the intended one is computed: thresholds from below, Hosking's sign
of the shape, Frank's sign, inverse normal tails, and likelihoods of copulas rather than of joint densities.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NORMAL = NormalDist()


def by_code(rows: DataFrame, fit: Callable, columns: list[str], value: str = "ret", least: int = 30, code: str = "code", date: str = "trade_date", many: int = 0) -> DataFrame:
    """code and the named figures of fit(series in date order), for series of at least `least` values.

    Series travel whole, and those of one length lie together, so that they can share what depends on it. With `many`,
    fit takes a list of up to that many series of about one length and returns an array of figures by name.
    """
    kind = rows.schema[code].dataType.simpleString()
    known = rows.select(code, date, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    series = known.groupBy(code).agg(F.sort_array(F.collect_list(F.struct(date, "_v"))).alias("_s")).select(code, F.col("_s._v").alias("_x"), F.size("_s").alias("_n")).where(F.col("_n") >= least)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a stated number of partitions is not merged into fewer, as fits are dear where rows are few
    dealt = series.repartition(tasks, "_n", F.pmod(F.xxhash64(code), F.lit(16))).sortWithinPartitions("_n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [np.array(v, float) for v in b["_x"]]
            if many:
                found = [fit(x[i : i + many]) for i in range(0, len(x), many)]
                out = {c: np.concatenate([f[c] for f in found]) if found else [] for c in columns}
            else:
                found = [fit(v) for v in x]
                out = {c: [float(f[c]) for f in found] for c in columns}
            yield pd.DataFrame({code: b[code], **{c: pd.Series(v, dtype=float, index=b.index) for c, v in out.items()}})

    return dealt.mapInPandas(run, f"{code} {kind}, " + ", ".join(f"{c} double" for c in columns))


# distributions


def norm_ppf(p: np.ndarray) -> np.ndarray:
    return np.array([NORMAL.inv_cdf(min(max(float(x), 1e-12), 1 - 1e-12)) for x in np.atleast_1d(p)])


def norm_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-float(v) / math.sqrt(2)) for v in np.atleast_1d(x)])


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        k = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d if abs(1 + k * d) > 1e-300 else 1e-300)
        c = 1 + k / c if abs(1 + k / c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_cdf(x: float, nu: float) -> float:
    tail = 0.5 * incomplete_beta(nu / (nu + x * x), nu / 2, 0.5)
    return 1 - tail if x > 0 else tail


def chi2_sf(x: float, k: float) -> float:
    """Survival function: the regularised upper incomplete gamma function of k / 2 at x / 2."""
    a, y = k / 2, x / 2
    if y <= 0:
        return 1.0
    if y < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= y / n
            total += term
        return 1 - total * math.exp(-y + a * math.log(y) - math.lgamma(a))
    b = y + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-y + a * math.log(y) - math.lgamma(a)) * h


# tails


def gpd_mle(x: np.ndarray, quantile: float = 0.90) -> dict[str, float]:
    """Generalised Pareto by maximum likelihood on a refined grid of the shape; the scale profile is one-dimensional."""
    losses = np.sort(-x)
    u = losses[int(len(losses) * quantile) - 1]
    e = losses[losses > u] - u
    # With t = xi / beta given, the likeliest xi is the mean of log(1 + t e): one dimension is searched, ever finer.
    grid = np.concatenate([np.linspace(-0.99 / e.max(), -1e-6 / e.mean(), 30), np.logspace(-6, 2, 60) / e.mean()])

    for _ in range(4):
        xi = np.log1p(grid[:, None] * e).mean(1)
        beta = xi / grid
        good = beta > 0
        ll = np.where(good, -len(e) * (np.log(np.where(good, beta, 1.0)) + xi + 1), -np.inf)
        k = int(ll.argmax())
        ll, xi, beta = (float(v[k]) for v in (ll, np.where(good, xi, 0.0), np.where(good, beta, 1.0)))
        grid = np.linspace(grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)], 21)
        grid = grid[np.abs(grid * e.mean()) > 1e-9]
    p = len(losses) / len(e) * 0.01
    var = u - beta * math.log(p) if abs(xi) < 1e-9 else u + beta / xi * (p**-xi - 1)
    return {"threshold": u, "xi": xi, "beta": beta, "loglik": ll, "var_99": var, "se_xi": (1 + xi) / math.sqrt(len(e))}


def gev_pwm(x: np.ndarray, block: int = 21) -> dict[str, float]:
    """Generalised extreme values of block maxima of losses, by probability-weighted moments."""
    n = len(x) // block
    m = np.sort((-x[: n * block]).reshape(n, block).max(1))
    i = np.arange(1, n + 1)
    b0, b1, b2 = m.mean(), (m * (i - 1)).sum() / n / max(n - 1, 1), (m * (i - 1) * (i - 2)).sum() / n / max(n - 1, 1) / max(n - 2, 1)
    c = (2 * b1 - b0) / (3 * b2 - b0) - math.log(2) / math.log(3)
    k = min(max(7.859 * c + 2.9554 * c * c, -0.5), 0.5)
    k = k if abs(k) > 1e-6 else 1e-6
    g = math.gamma(1 + k)
    sigma = (2 * b1 - b0) * k / (g * (1 - 2.0**-k))
    mu = b0 + sigma * (g - 1) / k
    level = mu + sigma / k * (1 - (-math.log(1 - 1 / 100)) ** k)
    return {"xi": -k, "sigma": sigma, "mu": mu, "return_level_100": level, "blocks": n}


# volatility and regimes


def garch(x: np.ndarray) -> dict[str, float]:
    """GARCH(1, 1) by a grid of (alpha, beta) with the variance as target."""
    r = x - x.mean()
    v = r.var()
    best = (-np.inf, 0.0, 0.0, v)
    for a in (0.03, 0.05, 0.08, 0.12, 0.2):
        for b in (0.6, 0.75, 0.85, 0.92):
            if a + b >= 0.999:
                continue
            s, ll = v, 0.0
            for q in r * r:
                ll -= 0.5 * (math.log(s) + q / s)
                s = v * (1 - a - b) + a * q + b * s
            if ll > best[0]:
                best = (ll, a, b, s)
    return {"alpha": best[1], "beta": best[2], "omega": v * (1 - best[1] - best[2]), "forecast_vol": math.sqrt(best[3]), "loglik": best[0]}


def egarch(x: np.ndarray) -> dict[str, float]:
    r = x - x.mean()
    lv = math.log(r.var())
    best = (-np.inf, 0.0, 0.0, 0.0)
    for a in (0.05, 0.1, 0.2):
        for g in (-0.1, -0.05, 0.0):
            for b in (0.85, 0.92, 0.97):
                s, ll = lv, 0.0
                for q in r:
                    z = q / math.exp(s / 2)
                    ll -= 0.5 * (s + z * z)
                    s = lv * (1 - b) + a * (abs(z) - math.sqrt(2 / math.pi)) + g * z + b * s
                if ll > best[0]:
                    best = (ll, a, g, b)
    return {"alpha": best[1], "gamma": best[2], "beta": best[3], "loglik": best[0]}


def hmm(x: np.ndarray, states: int = 3, rounds: int = 50) -> dict[str, float]:
    """Gaussian hidden Markov model by scaled expectation maximisation; the regime of the last twenty values."""
    return {k: int(v[0]) if k == "regime" else float(v[0]) for k, v in hmm_many([x], states, rounds).items()}


def hmm_many(series: list[np.ndarray], states: int = 3, rounds: int = 50) -> dict[str, np.ndarray]:
    """hmm() of each of several series at once, a step of all of them at a time; each ends its rounds by itself.

    Shorter series go on with values that every state explains equally well, which changes no sum.
    """
    size = np.array([len(x) for x in series])
    x = np.stack([np.pad(v, (0, size.max() - len(v))) for v in series], 1)
    there = np.arange(len(x))[:, None] < size
    mean = np.stack([np.quantile(v, (np.arange(states) + 0.5) / states) for v in series], 1)
    sd = np.repeat([[v.std() + 1e-9 for v in series]], states, 0)
    trans = np.full((states, states, len(series)), 0.1 / max(states - 1, 1))
    trans[range(states), range(states)] = 0.9
    start, last, live = np.full((states, len(series)), 1 / states), np.full(len(series), -np.inf), np.arange(len(series))
    out = {"mean": mean.copy(), "stay": np.zeros(len(series)), "loglik": np.zeros(len(series))}
    for turn in range(rounds):
        e = np.where(there[:, None], np.exp(-0.5 * ((x[:, None] - mean) / sd) ** 2) / sd / math.sqrt(2 * math.pi) + 1e-300, 1.0)
        a, c = np.empty_like(e), np.empty(x.shape)
        for t in range(len(x)):
            a[t] = (start if t == 0 else (a[t - 1][:, None] * trans).sum(0)) * e[t]
            c[t] = a[t].sum(0)
            a[t] /= c[t]
        b, xi = np.ones_like(e), np.zeros_like(trans)
        ahead = e[1:] / c[1:, None]
        for t in range(len(x) - 2, -1, -1):
            on = trans * (ahead[t] * b[t + 1])
            b[t] = on.sum(1)
            xi += a[t][:, None] * on * there[t + 1]
        g = a * b
        g = np.where(there[:, None], g / g.sum(1, keepdims=True), 0.0)
        trans = xi / xi.sum(1, keepdims=True)
        start, mean = g[0], (g * x[:, None]).sum(0) / g.sum(0)
        sd = np.sqrt((g * (x[:, None] - mean) ** 2).sum(0) / g.sum(0)) + 1e-6
        ll = np.where(there, np.log(c), 0.0).sum(0)
        out["mean"][:, live], out["stay"][live], out["loglik"][live] = mean, trans[range(states), range(states)].mean(0), ll
        on = ~(ll - last < 1e-6 * np.abs(ll))
        if not on.any():
            break
        live, last, x, there, mean, sd, trans, start = live[on], ll[on], x[:, on], there[:, on], mean[:, on], sd[:, on], trans[:, :, on], start[:, on]
    order = np.sort(out["mean"], axis=0)
    now = np.argmin(np.abs(order - np.array([v[-20:].mean() for v in series])), axis=0)
    return {"regime": now.astype(float), "low_mean": order[0], "high_mean": order[-1], "stay": out["stay"], "loglik": out["loglik"]}


def kalman(exposures: np.ndarray, returns: np.ndarray, q: float = 1e-4, r: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Random-walk weights after all updates, and their variances."""
    n = exposures.shape[1]
    w, p = np.full(n, 1 / n), np.eye(n)
    for h, y in zip(exposures, returns):
        p = p + q * np.eye(n)
        k = p @ h / (h @ p @ h + r)
        w, p = w + k * (y - h @ w), p - np.outer(k, h) @ p
    return w, np.diag(p)


#: Steps within which ruin is counted.
HORIZONS = (1, 5, 21, 63, 126, 252)


@lru_cache(maxsize=1)
def resampled(n: int, paths: int, steps: int, seed: int) -> np.ndarray:
    """Places in a series of n values by step and path: those that the generator's choice() takes, the same for every
    series of that length."""
    places = np.random.default_rng(seed).integers(0, n, (paths, steps)).astype(np.uint16 if n <= 1 << 16 else np.int64)
    return np.ascontiguousarray(places.T)


def ruin(x: np.ndarray, paths: int = 10_000, steps: int = 252, size: float = 0.2, threshold: float = 0.5, seed: int = 42) -> dict[str, float]:
    """Share of bootstrapped wealth paths that fall to the threshold within each of HORIZONS."""
    growth = 1 + size * np.maximum(x, -1 / size + 1e-9)
    wealth, low, out = np.ones(paths), np.full(paths, np.inf), {}
    for step, at in enumerate(resampled(len(x), paths, steps, seed), 1):
        wealth *= growth.take(at)
        np.minimum(low, wealth, out=low)
        if step in HORIZONS:
            out[f"ruin_{step}"] = float((low <= threshold).mean())
    return out


# dependence


def dcc(x: np.ndarray, y: np.ndarray, a: float = 0.05, b: float = 0.90) -> dict[str, float]:
    """Dynamic conditional correlation of two series with fixed a and b, each standardised by its own GARCH."""

    def standard(r: np.ndarray) -> np.ndarray:
        g, r = garch(r), r - r.mean()
        s, out = r.var(), np.empty(len(r))
        for t, q in enumerate(r):
            out[t] = q / math.sqrt(s)
            s = g["omega"] + g["alpha"] * q * q + g["beta"] * s
        return out

    z = np.stack([standard(x), standard(y)], 1)
    mean = z.T @ z / len(z)
    q, ll, rho = mean.copy(), 0.0, 0.0
    for e in z:
        rho = q[0, 1] / math.sqrt(q[0, 0] * q[1, 1])
        ll -= 0.5 * (math.log(1 - rho**2) + (e @ e - 2 * rho * e[0] * e[1]) / (1 - rho**2) - e @ e)
        q = mean * (1 - a - b) + a * np.outer(e, e) + b * q
    return {"last_corr": rho, "mean_corr": float(mean[0, 1]), "loglik": ll}


# tests of forecasts


def dynamic_quantile(hits: np.ndarray, var: np.ndarray, level: float = 0.99, lags: int = 4) -> dict[str, float]:
    h = hits - (1 - level)
    x = np.column_stack([np.ones(len(h) - lags), *[h[lags - k : len(h) - k] for k in range(1, lags + 1)], var[lags:]])
    beta, *_ = np.linalg.lstsq(x, h[lags:], rcond=None)
    stat = float(beta @ (x.T @ x) @ beta / ((1 - level) * level))
    return {"dq": stat, "p": chi2_sf(stat, x.shape[1])}


def berkowitz(pit: np.ndarray) -> dict[str, float]:
    z = norm_ppf(np.clip(pit, 1e-6, 1 - 1e-6))
    x, y = z[:-1], z[1:]
    rho = float(np.cov(x, y)[0, 1] / x.var(ddof=1))
    mu = float(y.mean() - rho * x.mean())
    s2 = float(((y - mu - rho * x) ** 2).mean())
    free = -0.5 * len(y) * (math.log(2 * math.pi * s2) + 1)
    fixed = float((-0.5 * (math.log(2 * math.pi) + y * y)).sum())
    return {"lr": 2 * (free - fixed), "p": chi2_sf(max(2 * (free - fixed), 0.0), 3)}


# portfolios


def shrunk_covariance(r: np.ndarray) -> np.ndarray:
    """Sample covariance shrunk towards constant correlation, by the share that Ledoit and Wolf derive for identity."""
    x = r - r.mean(0)
    n, p = x.shape
    s = x.T @ x / max(n - 1, 1)
    sd = np.sqrt(np.diag(s))
    corr = s / np.outer(sd, sd)
    mean = (corr.sum() - p) / max(p * (p - 1), 1)
    target = mean * np.outer(sd, sd)
    np.fill_diagonal(target, sd**2)
    pi = (((x[:, :, None] * x[:, None, :]) - s) ** 2).mean(0).sum()
    gap = ((s - target) ** 2).sum()
    k = min(max(pi / max(gap, 1e-300) / n, 0.0), 1.0)
    return k * target + (1 - k) * s


def capped_simplex(w: np.ndarray, cap: float) -> np.ndarray:
    """The nearest weights between 0 and cap that add up to 1."""
    cap = max(cap, 1 / len(w))
    lo, hi = (w - cap).min(), w.max()
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(w - mid, 0, cap).sum() > 1 else (lo, mid)
    return np.clip(w - hi, 0, cap)


def capped_simplexes(w: np.ndarray, cap: float) -> np.ndarray:
    """capped_simplex() of each row, without halving: what is left of a row is linear between the points where a weight
    leaves 0 or meets the cap."""
    cap = max(cap, 1 / w.shape[1])
    points = np.sort(np.concatenate([w - cap, w], 1), axis=1)
    left = np.clip(w[:, None, :] - points[:, :, None], 0, cap).sum(2)
    # the last point at which at least 1 is left, and the next one
    k = np.clip((left >= 1).sum(1) - 1, 0, points.shape[1] - 2)
    rows = np.arange(len(w))
    a, b, x, y = points[rows, k], points[rows, k + 1], left[rows, k], left[rows, k + 1]
    at = np.where(x > y, a + (x - 1) * (b - a) / np.where(x > y, x - y, 1), a)
    return np.clip(w - at[:, None], 0, cap)


def mean_variance(mu: np.ndarray, cov: np.ndarray, delta: float = 2.5, cap: float = 0.10, steps: int = 500) -> np.ndarray:
    return mean_variances(mu[None], cov[None], delta, cap, steps)[0]


def mean_variances(mu: np.ndarray, cov: np.ndarray, delta: float = 2.5, cap: float = 0.10, steps: int = 500) -> np.ndarray:
    """Weights of many books of one size: a row of means and a matrix of covariances each."""
    w = np.full(mu.shape, 1 / mu.shape[1])
    rate = 1 / (delta * np.linalg.norm(cov, 2, axis=(1, 2)) + 1e-12)
    for _ in range(steps):
        before, w = w, capped_simplexes(w + rate[:, None] * (mu - delta * np.einsum("bij,bj->bi", cov, w)), cap)
        if (w == before).all():
            break
    return w


def black_litterman(cov: np.ndarray, market: np.ndarray, p: np.ndarray, q: np.ndarray, tau: float = 0.05, delta: float = 2.5) -> np.ndarray:
    pi = delta * cov @ market
    omega = np.diag(np.diag(p @ (tau * cov) @ p.T)) + 1e-12 * np.eye(len(q))
    gain = tau * cov @ p.T @ np.linalg.inv(p @ (tau * cov) @ p.T + omega)
    return pi + gain @ (q - p @ pi)


def hrp(r: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: single linkage on correlation distance, then inverse-variance splits down the order."""
    cov, corr = np.cov(r.T), np.nan_to_num(np.corrcoef(r.T), nan=0.0)
    d = np.sqrt(np.clip((1 - corr) / 2, 0, 1))
    clusters = [[i] for i in range(len(d))]
    while len(clusters) > 1:
        a, b = min(((i, j) for i in range(len(clusters)) for j in range(i)), key=lambda ij: min(d[x, y] for x in clusters[ij[0]] for y in clusters[ij[1]]))
        clusters[b] += clusters.pop(a)
    order, w = clusters[0], np.ones(len(d))

    def variance(c: list[int]) -> float:
        iv = 1 / np.diag(cov)[c]
        iv /= iv.sum()
        return float(iv @ cov[np.ix_(c, c)] @ iv)

    todo = [order]
    while todo:
        c = todo.pop()
        if len(c) > 1:
            x, y = c[: len(c) // 2], c[len(c) // 2 :]
            a = 1 - variance(x) / (variance(x) + variance(y))
            w[x] *= a
            w[y] *= 1 - a
            todo += [x, y]
    return w / w.sum()


#: Books that a task solves at once.
BOOKS = 256


def allocate(returns: DataFrame, group: str, solve: Callable[[np.ndarray], np.ndarray], many: bool = False) -> DataFrame:
    """group, code, weight: solve(returns matrix: dates by codes) for each group, over dates that all its codes have.

    With `many`, solve takes a list of such matrices, of one number of codes, and returns weights of each.
    """
    kind = returns.schema[group].dataType.simpleString()

    def wide_of(pdf: pd.DataFrame) -> pd.DataFrame | None:
        wide = pdf.pivot_table(index="trade_date", columns="code", values="ret").dropna()
        return None if len(wide) < 12 or wide.shape[1] < 2 else wide

    def rows_of(key, codes, weights) -> pd.DataFrame:
        return pd.DataFrame({group: [key] * len(codes), "code": np.asarray(codes, "int64"), "weight": weights})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = wide_of(pdf)
        if wide is None:
            return pd.DataFrame({group: pd.Series([], dtype=pdf[group].dtype), "code": pd.Series([], dtype="int64"), "weight": pd.Series([], dtype=float)})
        return rows_of(pdf[group].iloc[0], wide.columns, solve(wide.to_numpy()))

    rows = returns.select(group, "code", "trade_date", "ret")
    if not many:
        return rows.groupBy(group).applyInPandas(run, f"{group} {kind}, code long, weight double")

    def solved(held: list[tuple]) -> Iterator[pd.DataFrame]:
        for n in sorted({x.shape[1] for _, _, x in held}):
            some = [h for h in held if h[2].shape[1] == n]
            for (key, codes, _), w in zip(some, solve([x for _, _, x in some])):
                yield rows_of(key, codes, w)

    def run_many(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for key, *parts in zip(*(batch[c] for c in (group, "_d", "_c", "_x"))):
                wide = wide_of(pd.DataFrame(dict(zip(("trade_date", "code", "ret"), parts))))
                if wide is not None:
                    held.append((key, wide.columns.to_numpy(), wide.to_numpy()))
            if len(held) >= BOOKS:
                yield from solved(held)
                held = []
        yield from solved(held)

    whole = rows.groupBy(group).agg(F.collect_list(F.struct("trade_date", "code", "ret")).alias("_r")).select(group, F.col("_r.trade_date").alias("_d"), F.col("_r.code").alias("_c"), F.col("_r.ret").alias("_x"))
    return whole.mapInPandas(run_many, f"{group} {kind}, code long, weight double")


# execution


class Breaker:
    """Circuit breaker: opens on `losses` losses in a row, a day's loss of `day` of equity, or a drawdown; half-open after
    the cool-down, closed again by a gain."""

    def __init__(self, losses: int = 3, day: float = 0.02, drawdown: float = 0.08, cool: float = 300.0) -> None:
        self.losses, self.day, self.drawdown, self.cool = losses, day, drawdown, cool
        self.state, self.streak, self.peak, self.opened = "closed", 0, 0.0, 0.0

    def update(self, pnl: float, equity: float, now: float) -> str:
        self.peak = max(self.peak, equity)
        self.streak = self.streak + 1 if pnl < 0 else 0
        if self.state == "open" and now - self.opened >= self.cool:
            self.state = "half_open"
        elif self.state == "half_open" and pnl > 0:
            self.state = "closed"
        bad = self.streak >= self.losses or -pnl >= self.day * max(equity, 1e-9) or (self.peak > 0 and 1 - equity / self.peak >= self.drawdown)
        if bad and self.state != "open":
            self.state, self.opened = "open", now
        return self.state


def breaker_path(pnl: DataFrame) -> DataFrame:
    """code, trade_date, state from rows code, trade_date, ret: one breaker for each code; a step is a day."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b, equity, out = Breaker(cool=5.0), 1.0, []
        for k, (day, r) in enumerate(pdf.sort_values("trade_date")[["trade_date", "ret"]].itertuples(index=False)):
            gain = equity * 0.05 * r
            equity += gain
            out.append((pdf.code.iloc[0], day, b.update(gain, equity, float(k))))
        return pd.DataFrame(out, columns=["code", "trade_date", "state"])

    return pnl.select("code", "trade_date", "ret").groupBy("code").applyInPandas(run, "code long, trade_date date, state string")


def fill_orders(orders: DataFrame, lot: int = 100, share: float = 0.1) -> DataFrame:
    """code, trade_date, filled, position: orders (code, trade_date, quantity, volume) fill in whole lots up to a share of
    volume; what was bought today can be sold from tomorrow."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held, out = 0, []
        for day, q, v in pdf.sort_values("trade_date")[["trade_date", "quantity", "volume"]].itertuples(index=False):
            want = int(min(abs(q), share * v) // lot) * lot
            fill = want if q > 0 else -min(want, held)
            held += fill
            out.append((pdf.code.iloc[0], day, fill, held))
        return pd.DataFrame(out, columns=["code", "trade_date", "filled", "position"])

    return orders.groupBy("code").applyInPandas(run, "code long, trade_date date, filled long, position long")


def reserve_samples(triangle: pd.DataFrame, n: int = 1000, seed: int = 42) -> np.ndarray:
    """Reserves of n triangles with resampled Pearson residuals, of a cumulative triangle (i, j, c)."""
    c = triangle.pivot_table(index="i", columns="j", values="c").to_numpy()
    size = c.shape[0]

    def ultimate(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = [np.nansum(m[: size - j - 1, j + 1]) / np.nansum(m[: size - j - 1, j]) for j in range(size - 1)]
        full = m.copy()
        for i in range(size):
            for j in range(size - i, size):
                full[i, j] = full[i, j - 1] * f[j - 1]
        return full, np.array(f)

    full, f = ultimate(c)
    back = full.copy()
    for i in range(size):
        for j in range(size - i - 2, -1, -1):
            back[i, j] = back[i, j + 1] / f[j]
    fit = np.diff(back, axis=1, prepend=0)
    seen = ~np.isnan(c)
    res = ((np.diff(c, axis=1, prepend=0) - fit) / np.sqrt(np.abs(fit)))[seen]
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        inc = fit + np.where(seen, rng.choice(res, c.shape), 0.0) * np.sqrt(np.abs(fit))
        m = np.where(seen, np.cumsum(inc, axis=1), np.nan)
        full, _ = ultimate(m)
        out.append(sum(full[i, -1] - m[i, size - 1 - i] for i in range(size)))
    return np.array(out)


def reserve_bootstrap(triangle: DataFrame, n: int = 1000, shares: int = 16, seed: int = 42) -> DataFrame:
    """mean, p50, p75, p95 of n resampled reserves, spread over tasks by share, each with a seed of its own.

    A triangle has a row for each accident and development year, which every task receives.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf.share.iloc[0])
        return pd.DataFrame({"reserve": reserve_samples(pdf, (k + 1) * n // shares - k * n // shares, seed + k)})

    dealt = triangle.select("i", "j", "c", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")).repartition(shares, F.xxhash64("share"))
    x = dealt.groupBy("share").applyInPandas(run, "reserve double")
    at = lambda p: F.percentile("reserve", p)
    return x.agg(F.avg("reserve").alias("mean"), at(0.5).alias("p50"), at(0.75).alias("p75"), at(0.95).alias("p95"))
