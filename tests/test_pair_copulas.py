"""Copulas of the pairs of a book together equal those of each pair alone."""

import math

import numpy as np
import pytest

from alphaloom.operators import copulas as cop


@pytest.fixture(scope="module")
def book():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(84, 5)) + rng.normal(size=(84, 1))
    x[:, 3] = -x[:, 0] + rng.normal(size=84) / 3
    x[10:14, 2] = x[9, 2]
    return x


def alone(x, y):
    u, v = cop.ranks(x), cop.ranks(y)
    grid = [t for t in np.linspace(-20, 20, 81) if abs(t) > 0.1]
    frank = max(grid, key=lambda t: cop.log_density("frank", t, math.inf, u, v).sum())
    return cop.kendall(u, v), frank, cop.copula(u, v, float(np.corrcoef(x, y)[0, 1]))


@pytest.mark.parametrize("holes", [False, True])
def test_pairs(book, holes, monkeypatch):
    x = book.copy()
    if holes:
        x[3:9, 1], x[40:, 4] = np.nan, np.nan
        x[20:60, 0] = np.nan
    want = {}
    for i in range(5):
        for j in range(i + 1, 5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if both.sum() >= 30:
                want[i, j] = alone(x[both, i], x[both, j])
    monkeypatch.setattr(cop, "kendall", None)  # taus of a book are taken at once
    got = {(i, j): g for i, j, g in cop.pair_copulas(x)}
    assert got.keys() == want.keys() and (len(got) < 10) == holes
    for k, g in got.items():
        tau, frank, fit = want[k]
        assert g["tau"] == pytest.approx(min(max(tau, -0.95), 0.95), abs=1e-12)
        assert g == pytest.approx(fit, rel=1e-9, abs=1e-12)
        if cop.FAMILIES[int(g["family"])] == "frank":
            assert g["theta"] == frank


def test_taus_by_blocks(book):
    got = cop.kendalls(np.tile(book, (12, 1)))
    assert got[0, 1] == pytest.approx(cop.kendall(np.tile(book[:, 0], 12), np.tile(book[:, 1], 12)), abs=1e-12)
