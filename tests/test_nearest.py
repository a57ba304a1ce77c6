"""The bounded search against plain differences, and its speed."""

import time

import numpy as np
import pytest

from alphaloom.operators import graph


def plain(x, ids, y, own, k):
    out = []
    for q, o in zip(y, own):
        d = np.sqrt(((x - q) ** 2).sum(1))
        d[ids == o] = np.inf
        out += [(o, ids[j], d[j]) for j in np.lexsort((ids, d))[:k] if d[j] < np.inf]
    return out


@pytest.mark.parametrize("kind", ["normal", "copies", "lattice", "shifted", "wide", "few"])
def test_nearest(kind):
    r = np.random.default_rng(3)
    x = r.normal(size=(7 if kind == "few" else 400, 16))
    if kind == "copies":
        x = x[r.integers(0, 9, 400)]
    elif kind == "lattice":
        x = np.round(x)
    elif kind == "shifted":
        x = x * 1e-4 + 1e6
    elif kind == "wide":
        x[::2] *= 1e160
    ids = r.permutation(len(x)).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        got = graph.nearest(x, ids, x[:90], ids[:90], 10, held=5_000)
        want = plain(x, ids, x[:90], ids[:90], 10)
    assert [tuple(v) for v in zip(*got)] == want


def test_edges_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [3.0, 4.0])], "id long, features array<double>")
    got = sorted(tuple(r) for r in graph.knn_edges(rows, 10).collect())
    assert got == [(1, 2, 0.0), (1, 5, 5.0), (2, 1, 0.0), (2, 5, 5.0), (5, 1, 5.0), (5, 2, 5.0)]


def test_nearest_is_quicker_than_differences():
    x = np.random.default_rng(1).normal(size=(20_000, 64))
    ids = np.arange(20_000)
    began = time.perf_counter()
    graph.nearest(x, ids, x[:200], ids[:200], 10)
    middle = time.perf_counter()
    np.sqrt(((x[None] - x[:20, None]) ** 2).sum(2))
    assert middle - began < 3 * (time.perf_counter() - middle)
