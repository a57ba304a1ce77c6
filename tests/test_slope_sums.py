"""Sums of the logistic slope over all pairs, in time proportional to the rows."""

import time

import numpy as np
import pytest

from alphaloom.operators.ranking import slope_sums


@pytest.mark.parametrize("n, spread, sigma", [(1, 1.0, 1.0), (9, 3.0, 1.0), (700, 0.3, 1.0), (700, 4.0, 2.5), (500, 60.0, 0.7)])
def test_equals_all_pairs(n, spread, sigma):
    r = np.random.default_rng(n)
    s, w = r.normal(0, spread, n), r.uniform(0, 16, (n, 2))
    z = 1 / (1 + np.exp(-sigma * (s[:, None] - s)))
    assert np.allclose(slope_sums(s, s, w, sigma), (z * (1 - z)) @ w, rtol=1e-12, atol=1e-12)


def test_linear():
    r = np.random.default_rng(0)
    s, begin = r.normal(0, 0.5, 60_000), time.process_time()
    slope_sums(s, s, np.ones((60_000, 2)))
    assert time.process_time() - begin < 10  # all pairs: minutes
