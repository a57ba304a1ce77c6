"""Pairs of codes that share a group, from blocks of codes: each leaves its task once, and none is shuffled."""

import numpy as np
import pytest

from alphaloom.operators import typed_graph as tg


@pytest.mark.parametrize("text", [False, True])
def test_no_shuffle_of_pairs(spark, monkeypatch, text):
    """Memberships come twice, groups are in parts, and one holds every code."""
    monkeypatch.setattr(tg, "ROWS", 40, raising=False)
    r = np.random.default_rng(8)
    name = (lambda k, v: f"{k}{v}") if text else (lambda k, v: int(v) * 1_000_003 - 5)
    rows = [(name("g", g), name("c", c)) for g, c in zip(r.integers(0, 60, 400), r.integers(0, 90, 400))]
    rows += rows[:50] + [(name("g", 77), name("c", c)) for c in range(90)] * text + [(None, name("c", 3)), (name("g", 1), None)]
    groups = {}
    for g, c in rows:
        if g is not None and c is not None:
            groups.setdefault(g, set()).add(c)
    want = sorted({(a, b) for m in groups.values() for a in m for b in m if a < b})
    kind = "string" if text else "long"
    got = tg.pairs_in_groups(spark.createDataFrame(rows, f"fund {kind}, code {kind}"), "fund", 16)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("pairs, many", [(1 << 20, 1 << 12), (7, 1 << 12), (5, 6)])
def test_marks(monkeypatch, pairs, many):
    monkeypatch.setattr(tg, "PAIRS", pairs)
    monkeypatch.setattr(tg, "MANY", many)
    r = np.random.default_rng(2)
    (g, at), (h, to) = (np.unique(np.column_stack([r.integers(0, 25, n), r.integers(0, 12, n)]), axis=0).T for n in (60, 90))
    h = h + 3
    met = np.zeros((12, 12), bool)
    tg._mark(met, g, at, h, to)
    want = np.zeros((12, 12), bool)
    for k in np.intersect1d(g, h):
        want[np.ix_(at[g == k], to[h == k])] = True
    assert want.any() and (met == want).all()
