"""Intervals and comparisons of tail models of one series of returns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from alphaloom.operators.engines import gpd_mle

#: Fixed value: the 0.95 quantile of chi-squared with one degree of freedom.
CHI2_95 = 3.841459


def gpd_loglik(xi: np.ndarray, beta: np.ndarray, excesses: np.ndarray) -> np.ndarray:
    """Of arrays of shapes and scales (which broadcast); minus infinity where an excess is out of range."""
    xi, beta = np.broadcast_arrays(np.asarray(xi, float), np.asarray(beta, float))
    with np.errstate(all="ignore"):
        slope = xi / beta
        # z = 1 + slope * excess is least at one end; logarithms are taken of eight factors at a time
        least = 1 + np.minimum(slope * excesses.min(), slope * excesses.max())
        logs = np.zeros(xi.shape)
        for i in range(0, len(excesses), 8):
            part = 1 + slope * excesses[i]
            for e in excesses[i + 1 : i + 8]:
                part *= 1 + slope * e
            logs += np.log(part)
        power = np.where(np.abs(xi) < 1e-9, excesses.sum() / beta, (1 + 1 / xi) * logs)
    return np.where((least > 0) & (beta > 0), -len(excesses) * np.log(np.where(beta > 0, beta, 1.0)) - power, -np.inf)


def profile(loglik: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, rounds: int = 5, points: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """Where the likelihood of each row is largest between its bounds, and how large: a grid, ever finer.

    loglik takes an array of a row for each bound and a column for each point of the grid.
    """
    rows = np.arange(len(low))
    for _ in range(rounds):
        grid = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, points)
        values = loglik(grid)
        k = values.argmax(1)
        found = grid[rows, k], values[rows, k]
        low, high = grid[rows, np.maximum(k - 1, 0)], grid[rows, np.minimum(k + 1, points - 1)]
    return found


def profile_intervals(x: np.ndarray, quantile: float = 0.90, level: float = 0.99, points: int = 50) -> dict[str, float]:
    """Estimates of the generalised Pareto tail (xi, beta and the value at risk) and their 95 % intervals: of points + 1
    values around each estimate, those whose profile likelihood is within half of CHI2_95 of the largest.

    The values reach four standard errors, and at least half of xi and 75 % of beta, to either side; xi stays between
    -0.99 and 0.95 (the reference stops at -0.45, which leaves bounded tails without an interval).
    """
    fit = gpd_mle(x, quantile)
    losses = np.sort(-x)
    excesses = losses[losses > fit["threshold"]] - fit["threshold"]
    xi, beta, share = fit["xi"], fit["beta"], len(losses) / len(excesses)
    steps = np.linspace(-1, 1, points + 1)
    least = fit["loglik"] - CHI2_95 / 2
    shapes = np.clip(xi + steps * max(0.5 * abs(xi), 4 * fit["se_xi"]), -0.99, 0.95)
    scales = np.maximum(beta * (1 + 0.75 * steps), 1e-8)
    best_scale, by_shape = profile(lambda b: gpd_loglik(shapes[:, None], b, excesses), np.full(points + 1, 0.1 * beta), np.full(points + 1, 5 * beta))
    _, by_scale = profile(lambda s: gpd_loglik(s, scales[:, None], excesses), np.full(points + 1, -0.99), np.full(points + 1, 0.95))
    p = share * (1 - level)
    safe = np.where(np.abs(shapes) < 1e-9, 1e-9, shapes)
    var = fit["threshold"] + best_scale / safe * (p**-safe - 1)
    at = fit["threshold"] - beta * math.log(p) if abs(xi) < 1e-9 else fit["threshold"] + beta / xi * (p**-xi - 1)
    out = {}
    for name, estimate, values, likely in (("xi", xi, shapes, by_shape), ("beta", beta, scales, by_scale), ("var", at, var, by_shape)):
        kept = np.append(values[likely >= least], estimate)
        out |= {name: estimate, f"{name}_low": kept.min(), f"{name}_high": kept.max()}
    return out
