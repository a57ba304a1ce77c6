"""Sums along rings against those over edges, hinge sums against all pairs, and plans without a row for an edge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import graph
from alphaloom.operators import graph_training as gt
from alphaloom.plans import registry


@pytest.mark.parametrize("n", [1, 2, 7, 8, 13, 40])
def test_rings_are_the_edges(spark, n):
    rows = spark.createDataFrame([(c, "a") for c in range(n)] + [(c, "b") for c in range(n, n + 5)], "code long, sector string")
    nodes = rows.crossJoin(spark.range(2).withColumnRenamed("id", "grp")).where("(code + grp) % 4 <> 1").withColumn("x", F.sin("code") + F.col("grp"))
    here = nodes.select("grp", "code")
    edges = graph.symmetric(graph.sampled_peers(rows, "sector", 3)).join(here.withColumnRenamed("code", "src"), "src").join(here.withColumnRenamed("code", "dst"), ["grp", "dst"])
    node = lambda c: F.struct("grp", F.col(c).alias("code"))
    a = graph.normalized(edges.select(node("src").alias("src"), node("dst").alias("dst")))
    want = {tuple(r.id): r.features[0] for r in graph.propagate(a, nodes.select(node("code").alias("id"), F.array("x").alias("features")), 1).collect()}
    got = graph.normalized_along(graph.linked(nodes.join(graph.rings(rows, "sector", 3), "code"), "grp", 3), ["x"], "grp", 3)
    got = {(r.grp, r.code): r.x for r in got.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


@pytest.mark.parametrize("n, digits, labels", [(1, 3, 5), (50, 1, 3), (400, 2, 1000), (301, 12, 40)])
def test_hinge_is_the_sum_of_pairs(n, digits, labels):
    r = np.random.default_rng(n)
    s, y = np.round(r.normal(size=n) / 10, digits), r.integers(0, labels, n).astype(float)
    y[r.random(n) < 0.1] = np.nan
    above, short = y[:, None] > y, 0.1 - (s[:, None] - s)
    held = above & (short > 0)
    g, loss, pairs = gt.hinge(s, y, 0.1)
    assert pairs == above.sum() and loss == pytest.approx(short[held].sum()) and (g == held.sum(0) - held.sum(1)).all()


def test_hinge_of_many_takes_no_pairs():
    r = np.random.default_rng(1)
    s, y = r.normal(size=200_000), r.normal(size=200_000)
    g, _, pairs = gt.hinge(s, y, 0.02)
    assert pairs == 200_000 * 199_999 // 2 and g.sum() == 0


def test_ring_problem_is_the_problem(spark):
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(c, "ab"[c % 2]) for c in range(30)], "code long, sector string")
    data = [(c, g, [float(v) for v in r.normal(size=3)], None if c == 4 else float(r.normal()), "train" if g < 2 else "valid") for c in range(30) for g in range(3) if (c + g) % 5]
    nodes = spark.createDataFrame(data, "code long, grp int, features array<double>, label double, part string")
    node = lambda c: F.struct("grp", F.col(c).alias("code"))
    here = nodes.select("grp", "code")
    edges = graph.symmetric(graph.sampled_peers(rows, "sector", 3)).join(here.withColumnRenamed("code", "src"), "src").join(here.withColumnRenamed("code", "dst"), ["grp", "dst"])
    a = gt.Problem(edges.select(node("src").alias("src"), node("dst").alias("dst")), nodes.select(node("code").alias("id"), "features", "label", "grp", "part"), 3)
    b = gt.RingProblem(nodes.join(graph.rings(rows, "sector", 3), "code").withColumnRenamed("code", "id"), 3, 3)
    net = gt.Network.start(3, 5)
    (x, dx), (y, dy) = a.loss_and_gradient(net, 0.3), b.loss_and_gradient(net, 0.3)
    a.close(), b.close()
    assert x == pytest.approx(y) and dx.flat() == pytest.approx(dy.flat())


def test_graph_scores_join_no_edges(spark):
    plan = registry.QUERIES["q06_graph_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "rangeframe" in plan.lower() and plan.count("dst") == 0
