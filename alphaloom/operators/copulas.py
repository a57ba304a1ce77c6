"""Copulas of two variables: log densities, conditional distributions, fits, simulation and a test of fit.

A family is a name, theta (the correlation of "gaussian" and "t") and nu (degrees of freedom, "t" alone). Distribution
functions and draws both come from one conditional distribution per family: the first by integrating it, the second by
inverting it.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

FAMILIES = ("gaussian", "clayton", "gumbel", "frank", "rotated_gumbel", "t")
_Z = np.linspace(-9, 9, 18_001)
_PHI = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in _Z])
_NODES, _NODE_WEIGHTS = np.polynomial.legendre.leggauss(40)


@lru_cache(maxsize=256)
def _student(nu: float) -> tuple[np.ndarray, np.ndarray]:
    """Angles and probabilities of Student's t: at sqrt(nu) tan(angle) its density is a power of the cosine."""
    angle = np.linspace(-math.pi / 2, math.pi / 2, 20_001)
    w = np.clip(np.cos(angle), 0, None) ** (nu - 1)
    area = np.concatenate([[0.0], np.cumsum((w[1:] + w[:-1]) / 2)])
    return angle, area / area[-1]


def distribution(x: np.ndarray, nu: float = math.inf) -> np.ndarray:
    """Of Student's t, or the normal one."""
    if math.isinf(nu):
        return np.interp(x, _Z, _PHI)
    angle, area = _student(nu)
    return np.interp(np.arctan(x / math.sqrt(nu)), angle, area)


def quantile(p: np.ndarray, nu: float = math.inf) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    if math.isinf(nu):
        return np.interp(p, _PHI, _Z)
    angle, area = _student(nu)
    return math.sqrt(nu) * np.tan(np.interp(p, area, angle))


def kendall(u: np.ndarray, v: np.ndarray) -> float:
    """Of pairs that tie in neither variable; a row of pairs at a time."""
    agree = pairs = 0.0
    for i in range(len(u) - 1):
        s = np.sign(u[i + 1 :] - u[i]) * np.sign(v[i + 1 :] - v[i])
        agree, pairs = agree + s.sum(), pairs + np.abs(s).sum()
    return float(agree / max(pairs, 1))


def log_density(family: str, theta: float, nu: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    if family == "rotated_gumbel":
        return log_density("gumbel", theta, nu, 1 - u, 1 - v)
    if family in ("gaussian", "t"):
        x, y, left = quantile(u, nu), quantile(v, nu), 1 - theta**2
        if family == "gaussian":
            return -0.5 * math.log(left) - (theta**2 * (x * x + y * y) - 2 * theta * x * y) / (2 * left)
        front = math.lgamma(nu / 2 + 1) + math.lgamma(nu / 2) - 2 * math.lgamma((nu + 1) / 2) - 0.5 * math.log(left)
        joint = np.log1p((x * x + y * y - 2 * theta * x * y) / (nu * left))
        return front - (nu / 2 + 1) * joint + (nu + 1) / 2 * (np.log1p(x * x / nu) + np.log1p(y * y / nu))
    if family == "clayton":
        return math.log(1 + theta) - (1 + theta) * (np.log(u) + np.log(v)) - (2 + 1 / theta) * np.log(u**-theta + v**-theta - 1)
    if family == "gumbel":
        a, b = -np.log(u), -np.log(v)
        s = a**theta + b**theta
        z = s ** (1 / theta)
        return -z + (theta - 1) * (np.log(a) + np.log(b)) + a + b + (2 / theta - 2) * np.log(s) + np.log1p((theta - 1) / z)
    d = -np.expm1(-theta) - np.expm1(-theta * u) * np.expm1(-theta * v)
    return np.log(np.abs(theta * np.expm1(-theta))) - theta * (u + v) - 2 * np.log(np.abs(d))


def conditional(family: str, theta: float, nu: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """P(V <= v) given U = u."""
    if family == "rotated_gumbel":
        return 1 - conditional("gumbel", theta, nu, 1 - u, 1 - v)
    if family == "gaussian":
        return distribution((quantile(v) - theta * quantile(u)) / math.sqrt(1 - theta**2))
    if family == "t":
        x, y = quantile(u, nu), quantile(v, nu)
        return distribution((y - theta * x) * np.sqrt((nu + 1) / ((nu + x * x) * (1 - theta**2))), nu + 1)
    u, v = np.clip(u, 1e-12, 1 - 1e-12), np.clip(v, 1e-12, 1 - 1e-12)
    if family == "clayton":
        # u^-(theta + 1) is taken inside, where it cannot overflow
        return (1 + u**theta * (v**-theta - 1)) ** (-1 - 1 / theta)
    if family == "gumbel":
        a, b = -np.log(u), -np.log(v)
        s = a**theta + b**theta
        return np.exp(a - s ** (1 / theta)) * (a / s ** (1 / theta)) ** (theta - 1)
    x, y = -np.expm1(-theta * u), -np.expm1(-theta * v)
    return (1 - x) * y / (-np.expm1(-theta) - x * y)


def distribution_of(family: str, theta: float, nu: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """P(U <= u, V <= v): the conditional distribution integrated up to u at forty Gauss-Legendre nodes."""
    at = u[:, None] * (_NODES + 1) / 2
    return (conditional(family, theta, nu, at, v[:, None]) * _NODE_WEIGHTS).sum(1) * u / 2


def simulate_copula(family: str, theta: float, n: int, seed: int = 42, nu: float = math.inf) -> np.ndarray:
    """n pairs: a uniform u, and the v at which the conditional distribution reaches another uniform draw."""
    rng = np.random.default_rng(seed)
    u, w = rng.uniform(1e-9, 1 - 1e-9, n), rng.uniform(1e-9, 1 - 1e-9, n)
    low, high = np.zeros(n), np.ones(n)
    for _ in range(30):
        mid = (low + high) / 2
        below = conditional(family, theta, nu, u, mid) < w
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.stack([u, (low + high) / 2], 1)


def tails(family: str, theta: float, nu: float) -> tuple[float, float]:
    """Coefficients of lower and upper tail dependence."""
    if family == "t":
        both = 2 * float(distribution(np.array([-math.sqrt((nu + 1) * (1 - theta) / (1 + theta))]), nu + 1)[0])
        return both, both
    gumbel = 2 - 2 ** (1 / theta) if family in ("gumbel", "rotated_gumbel") else 0.0
    return {"clayton": (2 ** (-1 / theta) if family == "clayton" else 0.0, 0.0), "gumbel": (0.0, gumbel), "rotated_gumbel": (gumbel, 0.0)}.get(family, (0.0, 0.0))


#: Parameters at which Frank's likelihood is tried.
_FRANK = np.array([t for t in np.linspace(-20, 20, 81) if abs(t) > 0.1])


def frank_logliks(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Frank's log likelihood at each of _FRANK."""
    t = _FRANK[:, None]
    d = -np.expm1(-t) - np.expm1(-t * u) * np.expm1(-t * v)
    return len(u) * np.log(np.abs(_FRANK * np.expm1(-_FRANK))) - _FRANK * (u + v).sum() - 2 * np.log(np.abs(d)).sum(1)


def kendalls(x: np.ndarray) -> np.ndarray:
    """kendall() of each two columns, from the signs of differences of all pairs of rows, a block of rows at a time."""
    n, p = x.shape
    agree, pairs = np.zeros((p, p)), np.zeros((p, p))
    rows = max(1, (1 << 20) // (n * p))
    for lo in range(0, n - 1, rows):
        i, j = np.nonzero(np.arange(n) > np.arange(lo, min(lo + rows, n - 1))[:, None])
        s = np.sign(x[j] - x[lo + i])
        agree += s.T @ s
        pairs += np.abs(s).T @ np.abs(s)
    return agree / np.maximum(pairs, 1)


def copula(u: np.ndarray, v: np.ndarray, rho: float | None = None, tau: float | None = None) -> dict[str, float]:
    """The best of FAMILIES by Akaike's criterion; family is its place there.

    Parameters come from Kendall's tau (taken here, if not given), Frank's by likelihood. That of t is rho, the correlation
    of the values themselves, or what tau implies where it is not given, with max(2.5, 2 tau / (1 - tau)) degrees of
    freedom. Clayton and the Gumbel families are left out where tau is not positive.
    """
    tau = min(max(kendall(u, v) if tau is None else tau, -0.95), 0.95)
    implied = math.sin(math.pi * tau / 2)
    candidates = {"gaussian": (implied, math.inf), "t": (min(max(implied if rho is None else rho, -0.999), 0.999), max(2.5, 2 * tau / (1 - tau)))}
    if tau > 0.01:
        candidates |= {"clayton": (2 * tau / (1 - tau), math.inf), "gumbel": (1 / (1 - tau), math.inf), "rotated_gumbel": (1 / (1 - tau), math.inf)}
    candidates["frank"] = (float(_FRANK[frank_logliks(u, v).argmax()]), math.inf)
    loglik = {k: float(log_density(k, *p, u, v).sum()) for k, p in candidates.items()}
    aic = {k: (4 if k == "t" else 2) - 2 * x for k, x in loglik.items()}
    best = min(sorted(aic), key=aic.get)
    theta, nu = candidates[best]
    lower, upper = tails(best, theta, nu)
    return {"tau": tau, "family": float(FAMILIES.index(best)), "theta": float(theta), "nu": nu if best == "t" else 0.0, "loglik": loglik[best], "aic": aic[best], "lower_tail": lower, "upper_tail": upper}


def pair_copulas(x: np.ndarray, least: int = 30) -> list[tuple[int, int, dict[str, float]]]:
    """i, j and copula() of each two columns over the rows that both have (the others are not a number), if `least` or more.

    Columns with the same rows share their ranks, and their taus are taken at once.
    """
    there = ~np.isnan(x)
    out = []
    if there.all():
        if len(x) >= least:
            u = np.stack([ranks(c) for c in x.T], 1)
            taus, rhos = kendalls(u), np.corrcoef(x.T)
            out = [(i, j, copula(u[:, i], u[:, j], float(rhos[i, j]), float(taus[i, j]))) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])]
        return out
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            both = x[there[:, i] & there[:, j]][:, [i, j]]
            out += [(i, j, pair[0][2]) for pair in [pair_copulas(both, least)] if pair]
    return out


def ranks(x: np.ndarray) -> np.ndarray:
    """Pseudo-observations: places in order over one more than their number."""
    return (np.argsort(np.argsort(x, kind="stable"), kind="stable") + 1) / (len(x) + 1)


def inverse(family: str, theta: float, nu: float, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The v at which conditional() is w given u."""
    if family == "rotated_gumbel":
        return 1 - inverse("gumbel", theta, nu, 1 - u, 1 - w)
    if family == "gaussian":
        return distribution(theta * quantile(u) + math.sqrt(1 - theta**2) * quantile(w))
    if family == "t":
        x = quantile(u, nu)
        return distribution(theta * x + quantile(w, nu + 1) * np.sqrt((nu + x * x) * (1 - theta**2) / (nu + 1)), nu)
    if family == "clayton":
        return (1 + u**-theta * np.expm1(-theta / (1 + theta) * np.log(w))) ** (-1 / theta)
    if family == "frank":
        return -np.log1p(w * np.expm1(-theta) / (np.exp(-theta * u) * (1 - w) + w)) / theta
    # Gumbel: s + (theta - 1) log s is known; Newton's steps in log s come down to it from above
    a = -np.log(u)
    known = a + (theta - 1) * np.log(a) - np.log(w)
    y = np.log(a - np.log(w))
    for _ in range(60):
        step = (np.exp(y) + (theta - 1) * y - known) / (np.exp(y) + theta - 1)
        y = y - step
        if np.abs(step).max() < 1e-14:
            break
    return np.exp(-a * np.expm1(theta * np.maximum(y - np.log(a), 0)) ** (1 / theta))


def _distance(family: str, theta: float, nu: float, u: np.ndarray, v: np.ndarray) -> float:
    empirical = np.concatenate([((u <= u[i : i + 512, None]) & (v <= v[i : i + 512, None])).mean(1) for i in range(0, len(u), 512)])
    return float(((empirical - distribution_of(family, theta, nu, u, v)) ** 2).sum())


def _rank_distances(family: str, theta: float, nu: float, order: np.ndarray) -> np.ndarray:
    """_distance() of resamples, each given as its places of v in order of u: all stand on one grid of ranks."""
    m, n = order.shape
    at = np.arange(1, n + 1) / (n + 1)
    if n <= 2 * m:
        # the grid has no more points than the resamples have pairs, or twice as many
        grid = (conditional(family, theta, nu, (at[:, None] * (_NODES + 1) / 2)[:, None], at[None, :, None]) @ _NODE_WEIGHTS) * at[:, None] / 2
        fitted = grid[np.arange(n), order]
    else:
        fitted = np.stack([distribution_of(family, theta, nu, at, at[o]) for o in order])
    out = np.empty(m)
    before = np.tri(n, dtype=bool)
    for r in range(m):
        o = order[r]
        out[r] = ((((o <= o[:, None]) & before).sum(1) / n - fitted[r]) ** 2).sum()
    return out


def goodness_of_fit(family: str, theta: float, nu: float, u: np.ndarray, v: np.ndarray, resamples: int = 200, seed: int = 42) -> dict[str, float]:
    """Cramer and von Mises' distance of the empirical copula from the fitted one, and its share of resamples from the
    fitted copula that lie as far away or farther (counting the observed one). All resamples are drawn and ranked at once."""
    seen = _distance(family, theta, nu, u, v)
    draws = np.empty((2, resamples, len(u)))
    for k, s in enumerate(np.random.default_rng(seed).integers(1, 1_000_000, resamples)):
        rng = np.random.default_rng(int(s))
        draws[0, k], draws[1, k] = rng.uniform(1e-9, 1 - 1e-9, len(u)), rng.uniform(1e-9, 1 - 1e-9, len(u))
    x = inverse(family, theta, nu, *draws)
    places = np.argsort(np.argsort(x, axis=1, kind="stable"), axis=1, kind="stable")
    order = np.take_along_axis(places, np.argsort(draws[0], axis=1, kind="stable"), 1)
    far = int((_rank_distances(family, theta, nu, order) >= seen).sum())
    return {"cvm": seen, "p": (far + 1) / (resamples + 1)}
