"""Fits of many series: what series have in common is computed once, with the results of each by itself."""

import time

import numpy as np
import pytest

from alphaloom.operators import engines as eng
from alphaloom.operators import forecasts as fc


def plain_hmm(x, states=3, rounds=50):
    """Mean, staying and likelihood of one series by the textbook's recursions."""
    mean, sd = np.quantile(x, (np.arange(states) + 0.5) / states), np.full(states, x.std() + 1e-9)
    trans, start, last = np.full((states, states), 0.05) + 0.85 * np.eye(states), np.full(states, 1 / states), -np.inf
    for _ in range(rounds):
        e = np.exp(-0.5 * ((x[:, None] - mean) / sd) ** 2) / sd / np.sqrt(2 * np.pi) + 1e-300
        a, c, b = np.zeros((len(x), states)), np.zeros(len(x)), np.ones((len(x), states))
        for t in range(len(x)):
            a[t] = (start if t == 0 else a[t - 1] @ trans) * e[t]
            c[t] = a[t].sum()
            a[t] /= c[t]
        for t in range(len(x) - 2, -1, -1):
            b[t] = trans @ (e[t + 1] * b[t + 1]) / c[t + 1]
        g = a * b / (a * b).sum(1, keepdims=True)
        xi = sum(np.outer(a[t], e[t + 1] * b[t + 1] / c[t + 1]) * trans for t in range(len(x) - 1))
        trans, start = xi / xi.sum(1, keepdims=True), g[0]
        mean = (g * x[:, None]).sum(0) / g.sum(0)
        sd = np.sqrt((g * (x[:, None] - mean) ** 2).sum(0) / g.sum(0)) + 1e-6
        ll = np.log(c).sum()
        if ll - last < 1e-6 * abs(ll):
            break
        last = ll
    return np.sort(mean), np.diag(trans).mean(), ll


def test_hmm_many():
    r = np.random.default_rng(5)
    series = [r.normal(0, 0.1, n) + np.repeat(r.normal(0, 0.3, 8), n // 8 + 1)[:n] for n in (120, 171, 171, 200)]
    got = eng.hmm_many(series)
    for k, x in enumerate(series):
        mean, stay, ll = plain_hmm(x)
        assert [got[c][k] for c in ("low_mean", "high_mean", "stay", "loglik")] == pytest.approx([mean[0], mean[-1], stay, ll], rel=1e-7, abs=1e-9)
        assert eng.hmm(x)["regime"] == got["regime"][k]


def test_hmm_many_is_shared_work():
    r = np.random.default_rng(6)
    begin = time.process_time()
    eng.hmm_many([r.normal(0, 0.1, 300) for _ in range(200)])
    assert time.process_time() - begin < 15  # one by one: more than half a minute


def test_ruin_of_the_same_draws():
    x = np.random.default_rng(1).normal(0, 0.4, 90)
    low = np.minimum.accumulate(np.cumprod(1 + 0.2 * np.maximum(np.random.default_rng(42).choice(x, (500, 252)), -5 + 1e-9), axis=1), axis=1) <= 0.5
    assert eng.ruin(x, paths=500) == {f"ruin_{h}": low[:, h - 1].mean() for h in eng.HORIZONS}


@pytest.mark.parametrize("drift", [0.05, 0.01, -0.01])
def test_size_of_the_same_draws(drift):
    x = np.random.default_rng(2).normal(drift, 0.2, 200)
    got, draws = fc.optimal_size(x, paths=1_000), np.random.default_rng(42).choice(x, (1_000, 252)).astype(np.float32)
    assert got["ruin"] == fc.ruin_share(draws, got["size"])
    low, high, best = 0.0, got["most"], (0.0, 0.0)
    for _ in range(20):
        f = (low + high) / 2
        if fc.ruin_share(draws, f) <= 0.01:
            low, best = f, max(best, (max((1 + f * x.mean()) ** 252, 0.5), f))
        else:
            high = f
    assert got["size"] == pytest.approx(best[1], abs=1e-12) or got["wealth"] == pytest.approx(best[0])


def test_sizes_are_quick():
    x = np.random.default_rng(3).normal(0.02, 0.3, 600)
    eng.resampled(600, 10_000, 252, 42)
    begin = time.process_time()
    fc.optimal_size(x)
    eng.ruin(x)
    assert time.process_time() - begin < 0.6
