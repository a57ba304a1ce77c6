"""Keyed state over several micro-batches: expiry by timers, late rows, an initial state and breakers that forget."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from alphaloom.streaming import events as ev
from alphaloom.streaming import state as st

DAY = dt.datetime(2024, 1, 1)


def at(days):
    return DAY + dt.timedelta(days=days)


def stream(spark, tmp_path, batches):
    """A stream that reads one file of events a micro-batch, in order."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(i, at(t), u, e, v, None) for i, t, u, e, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
        for f in (tmp_path / f"{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return ev.read_events(spark, f"{tmp_path}/*/*.parquet", 1)


def live_rows(spark, directory):
    return spark.read.format("statestore").option("stateVarName", "state").load(directory).count()


def test_expiry_and_late_rows(spark, tmp_path):
    batches = [
        [(1, 0.0, 1, "a", 5.0), (2, 0.5, 1, "a", 6.0), (3, 3.0, 1, "a", 7.0), (4, 0.0, 2, "a", 1.0)],
        [(5, 20.0, 9, "z", 0.0)],
        [(6, 21.0, 9, "z", 1.0)],
        [(7, 1.0, 2, "a", 2.0), (8, 22.0, 1, "a", 8.0), (9, 22.0, 2, "a", None)],
        [(10, 23.0, 2, "a", 3.0)],
    ]
    out = ev.run_to_table(st.last_values(stream(spark, tmp_path / "in", batches), "2 days", "1 day"), str(tmp_path / "out"), "append")
    got = {r.event_id: (r.hit, r.previous, r.hits) for r in out.collect()}
    assert got[1] == (False, None, 0) and got[2] == (True, 5.0, 1)
    assert got[3] == (False, None, 0)  # two and a half days after: the key had expired within the batch
    assert got[8] == (False, None, 0) and got[9] == (False, None, 0)
    assert 7 not in got  # later than the watermark: dropped
    assert got[10] == (True, None, 1)
    marks = next((tmp_path / "out").glob("*/marks"))
    assert live_rows(spark, str(marks)) == 3  # (9, z), (1, a) and (2, a): timers took the first states away and new ones came


def test_timers_take_state_away(spark, tmp_path):
    batches = [[(k, 0.0, k, "a", 1.0) for k in range(50)], [(100, 40.0, 999, "z", 1.0)], [(101, 41.0, 999, "z", 1.0)], [(102, 42.0, 999, "z", 1.0)]]
    ev.run_to_table(st.last_values(stream(spark, tmp_path / "in", batches), "2 days", "1 day"), str(tmp_path / "out"), "append")
    assert live_rows(spark, str(next((tmp_path / "out").glob("*/marks")))) == 1


def test_initial_state(spark, tmp_path):
    first = spark.createDataFrame([(1, "a", at(-1), 4.0), (2, "a", at(-9), 4.0)], "user_id long, event_type string, ts timestamp, value double")
    out = ev.run_to_table(st.last_values(stream(spark, tmp_path / "in", [[(1, 0.0, 1, "a", 5.0), (2, 0.0, 2, "a", 5.0), (3, 0.0, 3, "a", 5.0)]]), initial=first), str(tmp_path / "out"), "append")
    assert {r.event_id: (r.hit, r.previous) for r in out.collect()} == {1: (True, 4.0), 2: (False, None), 3: (False, None)}


@pytest.mark.parametrize("cuts", [[8], [2, 5]])
def test_breakers_forget(spark, tmp_path, cuts):
    losses = [(k, 0.1 * k, 1, "x", 10.0) for k in range(4)] + [(4, 0.5, 1, "x", 60.0), (5, 60.0, 1, "x", 60.0), (6, 60.1, 1, "x", 49.0), (7, 60.2, 1, "x", 55.0)]
    batches = [losses[a:b] for a, b in zip([0, *cuts], [*cuts, 8]) if a < b]
    out = ev.run_to_table(st.breakers(stream(spark, tmp_path / "in", batches), "30 days", "1 day"), str(tmp_path / "out"), "append")
    got = [r.state for r in out.orderBy("ts").collect()]
    assert got[0] == "open" and got[3] == "open" and got[5:] == ["closed", "closed", "closed"]
