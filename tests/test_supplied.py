"""Supply edges against all pairs, and a plan that shuffles none of them."""

import pytest

from alphaloom.operators import typed_graph as tg

LINKS = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("a", "z"), ("a", "b")]


@pytest.mark.parametrize("more", [[], [(1, "c"), (4, "a")]])
def test_supplied_is_every_pair_once(spark, more):
    rows = [(c, "abcd"[c % 4]) for c in range(23)] + more
    every = {(s, t) for s, x in rows for t, y in rows if (x, y) in LINKS and s != t}
    want = sorted((s, t) for s, t in every if s < t or (t, s) not in every)
    industry, supply = spark.createDataFrame(rows, "code long, sector string"), spark.createDataFrame(LINKS, "up string, down string")
    got = tg.supplied(industry, supply)
    assert sorted(tuple(r) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("row_number" in plan) == bool(more)  # before, pairs were always ranked, after a shuffle
