"""Books solved together have the weights of books solved one by one, by projections without halving."""

import numpy as np
import pandas as pd
import pytest

from alphaloom.operators import engines as eng


@pytest.mark.parametrize("cap", [0.05, 0.1, 0.3, 1.0])
def test_projections(cap):
    rng = np.random.default_rng(1)
    for n in (2, 3, 10):
        w = rng.normal(size=(200, n)) * rng.choice([0.01, 0.3, 5], (200, 1))
        w[0] = 0.5
        got = eng.capped_simplexes(w, cap)
        assert np.allclose(got, [eng.capped_simplex(x, cap) for x in w], atol=1e-12) and np.allclose(got.sum(1), 1)


def by_halving(mu, cov, cap, delta=2.5, steps=500):
    w = np.full(len(mu), 1 / len(mu))
    rate = 1 / (delta * np.linalg.norm(cov, 2) + 1e-12)
    for _ in range(steps):
        w = eng.capped_simplex(w + rate * (mu - delta * cov @ w), cap)
    return w


def test_books_together(spark):
    rng = np.random.default_rng(2)
    # books of three sizes, one too short, one with a missing date
    x = {(b, c, d): float(rng.normal() / 20) for b, n in ((0, 4), (1, 3), (2, 4), (3, 2)) for c in range(n) for d in range(8 if b == 3 else 20)}
    x[0, 1, 5] = None
    rows = spark.createDataFrame([(b, b * 10 + c, f"2020-01-{d + 1:02d}", v) for (b, c, d), v in x.items()], "book long, code long, trade_date string, ret double")
    seen = []

    def solve(books):
        seen.append(len(books))
        return eng.mean_variances(np.array([m.mean(0) for m in books]), np.array([eng.shrunk_covariance(m) for m in books]), cap=0.5)

    got = eng.allocate(rows, "book", solve, many=True).toPandas().set_index(["book", "code"]).weight
    assert sorted(set(got.index.get_level_values(0))) == [0, 1, 2]
    for b, own in rows.toPandas().groupby("book"):
        if b != 3:
            m = pd.pivot_table(own, index="trade_date", columns="code", values="ret").dropna()
            want = by_halving(m.to_numpy().mean(0), eng.shrunk_covariance(m.to_numpy()), 0.5)
            assert np.allclose(got[b].sort_index(), want, atol=1e-10)
