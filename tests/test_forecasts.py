"""Permutation tests, sizes, users' functions, typed graphs and table versions, on small cases."""

import datetime as dt
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import forecasts as fc
from alphaloom.operators import typed_graph as tg
from alphaloom.sources import files


def forecasts(spark, n, codes=1, seed=2):
    r = np.random.default_rng(seed)
    rows = [(c, dt.date(2024, 1, 1) + dt.timedelta(days=k), float(r.normal() * 0.03), float(0.01 + 0.02 * r.random()), float(0.03 + 0.02 * r.random())) for c in range(codes) for k in range(n)]
    return pd.DataFrame(rows, columns=["code", "trade_date", "ret", "var", "es"])


def statistic(loss, var, es):
    return sum(x / e for x, v, e in zip(loss, var, es) if x > v) / (len(loss) * 0.05) - 1


def test_exact_p(spark):
    f = forecasts(spark, 7, 3)
    got = {r.code: r for r in fc.acerbi_szekely(spark.createDataFrame(f), orders=5040).collect()}
    for code, g in f.groupby("code"):
        loss, var, es = -g.ret.to_numpy(), g["var"].to_numpy(), g.es.to_numpy()
        seen = statistic(loss, var, es)
        far = [abs(statistic(o, var, es)) >= abs(seen) * (1 - 1e-12) for o in permutations(loss)]
        assert got[code].z == pytest.approx(seen) and got[code].p == pytest.approx(np.mean(far)) and got[code].n == 7
    drawn = {r.code: r.p for r in fc.acerbi_szekely(spark.createDataFrame(f), orders=5000).collect()}
    assert all(abs(drawn[c] - got[c].p) < 0.03 for c in got)


def test_orders_do_not_depend_on_tasks(spark):
    f = spark.createDataFrame(forecasts(spark, 60, 2))
    a, b = (sorted(map(tuple, fc.acerbi_szekely(f.repartition(n), orders=400, shares=5).collect())) for n in (1, 4))
    assert a == b and all(0 < x[3] <= 1 for x in a)


def test_rolling_forecasts(spark):
    f = forecasts(spark, 70)
    got = fc.rolling_forecasts(spark.createDataFrame(f)).toPandas().sort_values("trade_date")
    assert len(got) == 10
    assert np.allclose(got["mean"], [f.ret[k : k + 60].mean() for k in range(10)]) and np.allclose(got["var"], [1.645 * f.ret[k : k + 60].std() - f.ret[k : k + 60].mean() for k in range(10)])


def test_optimal_size():
    r = np.random.default_rng(4)
    x = r.normal(0.001, 0.02, 500)
    got = fc.optimal_size(x, paths=2_000)
    kelly = x.mean() / x.var(ddof=1)
    draws = np.random.default_rng(42).choice(x, (2_000, 252)).astype(np.float32)
    assert 0 < got["size"] <= got["most"] == pytest.approx(min(max(kelly / 2, 0.01), 1)) and got["ruin"] <= 0.01
    sizes = [fc.ruin_share(draws, f) for f in (0.1, 0.5, 1.0, 3.0)]
    assert sizes == sorted(sizes)
    risky = fc.optimal_size(r.normal(0.02, 0.2, 300), paths=2_000)
    assert risky["ruin"] <= 0.01 and fc.ruin_share(np.random.default_rng(42).choice(x, (10, 5)), 0.0) == 0
    assert fc.optimal_size(np.full(10, -0.01), paths=50)["size"] <= 0.01


def test_rolling_callback(spark):
    x = spark.createDataFrame([(c, k, None if k == 7 else float((k * 37 + c) % 11)) for c in (1, 2) for k in range(12)], "code long, trade_date int, v double")

    def spread(v):
        if np.isnan(v).any():
            raise ValueError("missing")
        return v.max() - v.min()

    got = {(r.code, r.trade_date): r.value for r in fc.rolling(x, "v", spread, 3).collect()}
    for c in (1, 2):
        v = [None if k == 7 else (k * 37 + c) % 11 for k in range(12)]
        for k in range(12):
            part = v[max(0, k - 2) : k + 1]
            assert got[c, k] == (max(part) - min(part) if len(part) == 3 and None not in part else None)


def test_row_results(spark):
    rows = spark.createDataFrame([(1, 4.0, 2.0), (1, 1.0, 0.0), (2, None, 1.0), (2, 9.0, 3.0)], "code long, a double, b double")
    out = fc.row_results(rows, lambda a, b: a / b if a > 0 else a.no_such, "a", "b")
    assert sorted((r.code, r.error or "") for r in out.collect()) == [(1, ""), (1, "ZeroDivisionError"), (2, ""), (2, "AttributeError")]
    assert {r.code: (r.n, r.failed, r["mean"]) for r in fc.result_counts(out, "code").collect()} == {1: (2, 1, 2.0), 2: (2, 1, 3.0)}


def test_pairs_in_groups(spark):
    r = np.random.default_rng(3)
    rows = [(int(g), int(c)) for g, c in zip(r.integers(0, 6, 300), r.integers(0, 40, 300))] + [(None, 1), (9, None), (8, 5)]
    groups = {}
    for g, c in rows:
        if g is not None and c is not None:
            groups.setdefault(g, set()).add(c)
    want = sorted({(a, b) for m in groups.values() for a in m for b in m if a < b})
    df = spark.createDataFrame(rows, "fund int, code long")
    for block in (4, 256):
        assert sorted(map(tuple, tg.pairs_in_groups(df, "fund", block).collect())) == want
    assert tg.pairs_in_groups(df.limit(0), "fund").count() == 0


def test_a_large_group_is_bounded(spark):
    big = spark.range(50_000).select(F.lit(1).alias("fund"), F.col("id").alias("code"))
    small = spark.range(5).select(F.lit(2).alias("fund"), F.col("id").alias("code"))
    got = tg.pairs_in_groups(big.union(small), "fund", largest=1000, most=20)
    n = got.count()
    assert 50_000 * 20 - 20 <= n <= 50_000 * 20 + 10 and got.where("src < 5 AND dst < 5").count() == 10


def test_typed_graph(spark):
    nodes = spark.createDataFrame([(k,) for k in range(6)], "code long")
    industry = spark.createDataFrame([(0, "oil"), (1, "oil"), (2, "chem"), (3, "chem"), (4, None), (99, "oil")], "code long, sector string")
    supply = spark.createDataFrame([("oil", "chem"), ("chem", "oil")], "up string, down string")
    fund = spark.createDataFrame([("f", 0), ("f", 5), ("f", 4), ("f", 98), ("g", 5), ("g", 0)], "fund string, code long")
    concept = spark.createDataFrame([("c", 2), ("c", 5)], "concept string, code long")
    e = tg.build(nodes, industry, supply, fund, concept)
    got = sorted(map(tuple, e.collect()))
    assert [g for g in got if g[0] == "supply_chain"] == [("supply_chain", a, b) for a in (0, 1) for b in (2, 3)]
    assert [g for g in got if g[0] == "co_holding"] == [("co_holding", 0, 4), ("co_holding", 0, 5), ("co_holding", 4, 5)]
    assert [g for g in got if g[0] == "concept"] == [("concept", 2, 5)] and sum(g[0] == "same_industry" for g in got) == 2
    both = {(r.src, r.dst): r.kinds for r in tg.adjacency(e).collect()}
    assert both[5, 0] == ["co_holding"] and all((b, a) in both for a, b in both)
    assert tg.adjacency(e, ["concept"]).count() == 2 and tg.build(nodes).count() == 0


def test_a_failing_delete_leaves_a_whole_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    files.append(spark.range(20).coalesce(1), path)
    real = files._switch

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(files, "_switch", fail)
    with pytest.raises(OSError):
        files.delete(spark, path, F.col("id") < 5)
    assert files.read_table(spark, path).count() == 20
    monkeypatch.setattr(files, "_switch", real)
    begun = files.read_table(spark, path)
    assert files.delete(spark, path, F.col("id") < 5) == 5 and files.read_table(spark, path).count() == 15 and begun.count() == 20
    assert files.delete(spark, path, F.col("id") < 7) == 2 and files.append(spark.range(3), path) == 3 and files.read_table(spark, path).count() == 16
    with pytest.raises(RuntimeError):
        real(spark, path, 2, "v2-other")  # another delete has made version 2 meanwhile
    assert files.read_table(spark, path).count() == 16
