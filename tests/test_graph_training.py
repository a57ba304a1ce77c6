"""Gradients of the graph network against finite differences and dense algebra, and a loss that falls on held-out groups."""

import numpy as np
import pytest

from alphaloom.operators import graph_training as gt


def graph(spark, groups=4, n=20, seed=1, signal=0.0):
    r = np.random.default_rng(seed)
    edges, nodes, arrays = [], [], []
    for g in range(groups):
        pairs = {(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, n, (2 * n, 2)) if a != b}
        x = r.normal(size=(n, 3))
        adj = np.zeros((n, n))
        for a, b in pairs:
            adj[a, b] = adj[b, a] = 1
        d = adj.sum(1)
        norm = adj / np.sqrt(np.outer(d, d) + (np.outer(d, d) == 0))
        y = signal * (norm @ norm @ x)[:, 0] + r.normal(size=n) * (1 if signal == 0 else 0.02)
        edges += [(g * 100 + a, g * 100 + b) for a, b in pairs]
        part = "train" if g < groups - groups // 3 else "valid"
        nodes += [(g * 100 + i, [float(v) for v in x[i]], None if i == 3 else float(y[i]), g, part) for i in range(n)]
        arrays.append((norm, x, y, d, part))
    return spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(nodes, "id long, features array<double>, label double, grp int, part string"), arrays


def dense_loss(arrays, net, margin, part="train"):
    out = []
    for norm, x, y, d, p in arrays:
        if p == part:
            s = norm @ np.maximum(norm @ x @ net.w1 + net.b1, 0) @ net.w2 + net.b2[0]
            here = [i for i in range(len(y)) if i != 3 and d[i]]
            pairs = [max(0.0, margin - (s[i] - s[j])) for i in here for j in here if y[i] > y[j]]
            out.append(np.mean(pairs))
    return float(np.mean(out))


def test_gradient(spark):
    edges, nodes, arrays = graph(spark)
    net = gt.Network.start(3, 5)
    problem = gt.Problem(edges, nodes, 3)
    losses, gradient = problem.loss_and_gradient(net, margin=0.3)
    problem.close()
    assert losses["train"] == pytest.approx(dense_loss(arrays, net, 0.3)) and losses["valid"] == pytest.approx(dense_loss(arrays, net, 0.3, "valid"))
    flat, step = net.flat(), 1e-6
    for k in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[k] += step
        down[k] -= step
        slope = (dense_loss(arrays, net.shaped(up), 0.3) - dense_loss(arrays, net.shaped(down), 0.3)) / (2 * step)
        assert gradient.flat()[k] == pytest.approx(slope, abs=1e-6)


def test_fit_learns(spark):
    edges, nodes, arrays = graph(spark, groups=6, seed=3, signal=1.0)
    problem = gt.Problem(edges, nodes, 3)
    net, history = gt.fit(problem, gt.Network.start(3, 6), epochs=12, patience=3, margin=0.2, adam=gt.Adam(rate=0.05))
    problem.close()
    assert history[-1][1] < 0.8 * history[0][1] and min(v for _, _, v in history) < 0.85 * history[0][2]
    assert dense_loss(arrays, net, 0.2, "valid") == pytest.approx(min(v for _, _, v in history), rel=1e-3)
    assert {r[0] for r in net.rows()} == {"w1", "b1", "w2", "b2"} and len(net.rows()) == net.flat().size


def test_early_stop(spark):
    edges, nodes, _ = graph(spark, groups=3, seed=5)
    problem = gt.Problem(edges, nodes, 3)
    _, history = gt.fit(problem, gt.Network.start(3, 4), epochs=9, patience=2, adam=gt.Adam(rate=0.0, decay=0.0))
    problem.close()
    assert len(history) == 3


def test_adam_is_the_textbook_step():
    a, w = gt.Adam(rate=0.1, decay=0.0), np.array([1.0, -2.0])
    w1 = a.step(w, np.array([0.5, -4.0]))
    assert np.allclose(w1, [0.9, -1.9])  # the first step is the rate, whatever the gradient
