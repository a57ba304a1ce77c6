"""Every registered query of the library against its SQL on the smallest tables, and the entry module's contract."""

import datetime
import math
import os

import duckdb
import pytest

from alphaloom import plans
from alphaloom.plans import registry

SMALL = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0):
        return str(v.date())
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, oracle, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = oracle.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    got = sorted(([plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    rows = sorted(([plain(v) for v in r] for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)
    assert len(got) == len(rows)
    for a, b in zip(got, rows):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, SMALL).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
