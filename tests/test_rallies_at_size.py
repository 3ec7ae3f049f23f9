"""The walk along a session's runs holds its place from batch to batch, and makes no group of each run."""

import random

import pytest
from test_landing import slow_points

from motionlake.operators import rallies


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_points_without_a_group_for_each_run(small_batches):
    """rows stream by; runs that span batches, and two runs that share one, are walked on and begun anew."""
    spark, r = small_batches, random.Random(11)
    rows, want = [], {}
    for s in range(6):
        for run in (1, 2):
            t, own = 100.0 * run, []
            for _ in range(r.randrange(1, 12)):
                t += r.choice([0.3, 0.8, 1.7])
                kind = r.choice(["hit", "bounce", "bounce", "net", "kink"])
                own.append((t, kind, r.choice(["near", "far"]) if kind == "bounce" else None, r.choice(["in", "out", None]) if kind == "bounce" else None))
            rows += [(s, run, 100 * run + k, *x) for k, x in enumerate(own)]
            want[s, run] = slow_points(own, 1.5)
    r.shuffle(rows)
    d = rallies.points(spark.createDataFrame(rows, "s int, run int, event_id int, t double, kind string, half string, verdict string"), "s")
    assert "FlatMapGroups" not in d._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for x in d.orderBy("s", "run", "event_id").collect():
        got.setdefault((x.s, x.run), []).append(x.point)
    assert got == want


def test_runs_carry_events_and_flights_whole(spark):
    e = spark.createDataFrame([(1, 7, 0.0, "hit"), (1, 8, 9.0, "bounce"), (2, 7, 1.0, None), (None, 1, 0.0, "hit")], "s int, event_id int, t double, kind string")
    f = spark.createDataFrame([(1, 7, 1.0, 2.0, "far"), (1, 9, 9.5, 9.9, None)], "s int, flight_id int, t0 double, t1 double, half string")
    events, flights = rallies.runs(e, f, "s")
    assert events.columns == ["s", "event_id", "t", "kind", "run"] and flights.columns == ["s", "flight_id", "t0", "t1", "half", "run"]
    assert sorted(map(tuple, events.collect()), key=str) == [(1, 7, 0.0, "hit", 1), (1, 8, 9.0, "bounce", 2), (2, 7, 1.0, None, 1)]
    assert sorted(map(tuple, flights.collect()), key=str) == [(1, 7, 1.0, 2.0, "far", 1), (1, 9, 9.5, 9.9, None, 2)]
