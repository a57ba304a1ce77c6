"""Resamples of a fitted copula, drawn and ranked at once, against one at a time."""

import math
import time

import numpy as np
import pytest

from alphaloom.operators import copulas as cop

CASES = [("gaussian", 0.6, math.inf), ("gaussian", -0.4, math.inf), ("t", 0.5, 3.0), ("clayton", 1.5, math.inf), ("gumbel", 1.6, math.inf), ("rotated_gumbel", 1.02, math.inf), ("frank", 4.0, math.inf), ("frank", -7.5, math.inf)]


@pytest.mark.parametrize("family, theta, nu", CASES)
def test_inverse(family, theta, nu):
    r = np.random.default_rng(1)
    u, w = r.uniform(1e-4, 1 - 1e-4, 2_000), r.uniform(1e-4, 1 - 1e-4, 2_000)
    v = cop.inverse(family, theta, nu, u, w)
    assert np.allclose(cop.conditional(family, theta, nu, u, v), w, atol=2e-6)


@pytest.mark.parametrize("family, theta, nu", CASES)
@pytest.mark.parametrize("n", [40, 100])
def test_goodness_of_fit(family, theta, nu, n):
    x = cop.simulate_copula("gaussian", 0.5, n, 8)
    u, v = cop.ranks(x[:, 0]), cop.ranks(x[:, 1])
    seen, far = cop._distance(family, theta, nu, u, v), 0
    for s in np.random.default_rng(42).integers(1, 1_000_000, 45):
        x = cop.simulate_copula(family, theta, n, int(s), nu)
        far += cop._distance(family, theta, nu, cop.ranks(x[:, 0]), cop.ranks(x[:, 1])) >= seen
    got = cop.goodness_of_fit(family, theta, nu, u, v, 45)
    assert got["cvm"] == seen and got["p"] == pytest.approx((far + 1) / 46)


def test_quick():
    x = cop.simulate_copula("gaussian", 0.5, 80, 8)
    u, v = cop.ranks(x[:, 0]), cop.ranks(x[:, 1])
    begin = time.process_time()
    for _ in range(3):
        cop.goodness_of_fit("t", 0.5, 3.0, u, v)
    assert time.process_time() - begin < 0.9
