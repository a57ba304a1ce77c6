"""Two factors share the name volume_ratio: one waits for twenty bars, the loose one has a value from the first on."""

import numpy as np
import pytest

from alphaloom import plans
from alphaloom.plans import registry

plans.load()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """One code's 24 days and another's 3, a row a day."""
    path = str(tmp_path_factory.mktemp("bars"))
    rows = [(c, f"2020-01-{d + 1:02d}", float(1 + (7 * d + c) % 11), 30.0 + d) for c, days in ((1, 24), (2, 3)) for d in range(days)]
    df = spark.createDataFrame(rows, "l_suppkey long, d string, l_quantity double, l_extendedprice double")
    df.selectExpr("l_suppkey", "CAST(d AS timestamp) AS l_shipdate", "l_quantity", "l_extendedprice", "0.1D AS l_discount").write.parquet(f"{path}/lineitem.parquet")
    return path, {c: [q for k, _, q, _ in rows if k == c] for c in (1, 2)}


@pytest.mark.parametrize("name, least", [("i48_volume_ratio_loose", 1), ("i38_volume_ratio", 20)])
def test_first_bars(spark, table, name, least):
    path, volumes = table
    got = registry.QUERIES[name](spark, path).orderBy("code", "trade_date").collect()
    want = [np.mean(v[max(0, i - 4) : i + 1]) / np.mean(v[max(0, i - 19) : i + 1]) if i + 1 >= least else None for v in volumes.values() for i in range(len(v))]
    assert [r.volume_ratio is None for r in got] == [x is None for x in want]
    assert [r.volume_ratio for r in got if r.volume_ratio is not None] == pytest.approx([x for x in want if x is not None], abs=1e-6)
