"""Short amounts round in binary, as their SQL does, where an amount lies at the middle between two shown ones."""

import duckdb

from alphaloom import plans
from alphaloom.plans import registry

plans.load()


def test_number_formats(spark, tmp_path):
    c = duckdb.connect()
    # 10,050 to 600,050 by hundreds, and the cents about them; and small ones by cents
    c.execute("CREATE TABLE orders AS SELECT row_number() OVER () AS o_orderkey, x AS o_totalprice FROM (SELECT 10050.0::DOUBLE + 100 * k + d / 100.0::DOUBLE AS x FROM range(5901) r(k), range(-1, 2) q(d) UNION ALL SELECT k / 100.0::DOUBLE FROM range(-2000, 20000) r(k) UNION ALL SELECT k / 8.0::DOUBLE FROM range(-200, 2000) r(k))")
    c.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    want = dict(c.execute(registry.ORACLES["h29_number_formats"]).fetchall())
    got = {r.o_orderkey: r.amount for r in registry.QUERIES["h29_number_formats"](spark, str(tmp_path)).collect()}
    assert len(got) == len(want) and {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {}
