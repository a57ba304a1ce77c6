"""The forward passes over whole tables, against dense matrices."""

import numpy as np
import pytest

from alphaloom import plans
from alphaloom.plans import registry
from alphaloom.plans.graph_text import _weights

plans.load()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """More ids than 200, not from 0 on, of width 6."""
    path, x = str(tmp_path_factory.mktemp("graph")), np.random.default_rng(2).normal(size=(230, 6)).astype(np.float32)
    spark.createDataFrame([(i + 50, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    x = x.astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    a = np.zeros(d.shape)
    a[np.repeat(np.arange(len(x)), 10), np.argsort(d, axis=1, kind="stable")[:, :10].ravel()] = 1
    return path, x, np.maximum(a, a.T)


def check(spark, name, path, want):
    got = np.array(sorted(tuple(r) for r in registry.QUERIES[name](spark, path).collect()))
    assert got[:, 0].tolist() == list(range(50, 280))
    assert np.allclose(got[:, 1:], want, atol=2e-6)


def test_gcn_reads_all(spark, table):
    path, x, a = table
    n = a / np.sqrt(np.outer(a.sum(1), a.sum(1)))
    check(spark, "q04_gcn_forward", path, (n @ np.maximum(n @ x @ _weights(6, 3) + 0.1, 0) @ _weights(3, 3))[:, :2])


def test_gat_reads_all(spark, table):
    path, x, a = table
    h = x @ _weights(6, 3)
    z = (h @ [0.5, -0.25, 1.0])[:, None] + (h @ [1.0, -0.5, 0.75])[None]
    e = np.where(a > 0, np.exp(np.where(z > 0, z, 0.2 * z)), 0)
    check(spark, "q05_gat_forward", path, ((e / e.sum(0)).T @ h)[:, [0, 2]])
