"""Operators on recordings against slow versions written row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.operators import ball, history, pose, rally, scorecard, series, stats


@pytest.mark.parametrize("listed", [2_000_000, 0])
def test_median_slope_listed_and_counted(spark, monkeypatch, listed):
    r = random.Random(5)
    monkeypatch.setattr(stats, "LISTED_PAIRS", listed)
    for n in (1, 2, 3, 7, 40, 41):
        for grid in (5, 1000):
            t = np.array([float(r.randrange(grid)) for _ in range(n)])
            v = np.array([float(r.randrange(6)) for _ in range(n)])
            slopes = [(v[j] - v[i]) / (t[j] - t[i]) for i in range(n) for j in range(n) if t[i] < t[j]]
            assert abs(stats._median_slope(t, v) - (float(np.median(slopes)) if slopes else 0.0)) < 1e-9
    if listed:
        rows = [(k, float(i), float((7 * i * k) % 11) if i % 9 else None) for k in range(3) for i in range(40)] + [(9, 1.0, float("nan"))]
        got = {x.k: x.slope for x in stats.theil_sen(spark.createDataFrame(rows, "k int, t double, v double"), "k", "t", "v").collect()}
        assert set(got) == {0, 1, 2} and got[0] == 0.0


def candidates(rows):
    return [("c", f, float(x), float(y), tier, float(axis), 50.0, 50.0, float(area)) for f, x, y, tier, axis, area in rows]


CANDIDATES = "clip string, frame int, x double, y double, tier int, orientation_deg double, seed_x double, seed_y double, area double"


@pytest.mark.parametrize(
    "rows,want,ended",
    [
        # the second step is sought where the first leads, not at the nearest place
        ([(0, 50, 50, 1, 0, 1), (1, 90, 50, 1, 0, 1), (2, 130, 50, 1, 0, 1), (2, 104, 53, 1, 0, 1)], [50, 90, 130], "window_end"),
        # the seed is of the first frame alone
        ([(0, 300, 50, 1, 0, 1), (1, 50, 50, 1, 0, 1), (2, 90, 50, 1, 0, 1), (3, 130, 50, 1, 0, 1)], [], None),
        # two frames are coasted through, a third is not
        ([(0, 50, 50, 1, 0, 1), (1, 60, 50, 1, 0, 1), (2, 70, 50, 1, 0, 1), (5, 100, 50, 1, 0, 1)], [50, 60, 70, 100], "window_end"),
        ([(0, 50, 50, 1, 0, 1), (1, 60, 50, 1, 0, 1), (2, 70, 50, 1, 0, 1), (6, 110, 50, 1, 0, 1)], [50, 60, 70], "coast_exhausted"),
        # a streak must lie along the last step, whatever the step to it
        ([(0, 50, 50, 1, 0, 1), (1, 60, 50, 1, 0, 1), (2, 70, 50, 2, 90, 1), (2, 71, 52, 2, 175, 1), (3, 80, 53, 1, 0, 1)], [50, 60, 71, 80], "window_end"),
        ([(0, 50, 50, 1, 0, 1), (1, 60, 50, 1, 0, 1), (2, 70, 50, 1, 0, 1), (3, 76, 57, 1, 0, 1)], [50, 60, 70], "direction_change"),
        # what stands still is no ball
        ([(0, 50, 50, 1, 0, 1), (1, 51, 50, 1, 0, 1), (1, 58, 50, 1, 0, 1), (2, 66, 50, 1, 0, 1)], [50, 58, 66], "window_end"),
    ],
)
def test_track_rules(spark, rows, want, ended):
    got = ball.track(spark.createDataFrame(candidates(rows), CANDIDATES), "clip", "frame", 60.0, 20.0).orderBy("frame").collect()
    assert [r.x for r in got] == want and {r.ended for r in got} == ({ended} if want else set())


def test_track_without_a_seed_and_near_the_edge(spark):
    rows = [("c", 0, 300.0, 300.0, 1, 0.0, None, None, 9.0), ("c", 0, 60.0, 50.0, 1, 0.0, None, None, 5.0), ("c", 0, 5.0, 50.0, 1, 0.0, None, None, 99.0)]
    rows += [("c", k, 300.0 + 9 * k, 300.0, 1, 0.0, None, None, 1.0) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, CANDIDATES)
    assert [r.x for r in ball.track(df, "clip", "frame", 60.0, 20.0, (640, 480)).orderBy("frame").collect()] == [300.0, 309.0, 318.0, 327.0]
    assert ball.track(df, "clip", "frame", 60.0, 20.0, (320, 480)).count() == 0


def test_outside_with_nulls(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 5.0, None), ("a", 1, 50.0, 5.0, "n"), ("a", 1, None, 5.0, "n"), ("a", 2, 5.0, 5.0, None), ("a", 1, 5.0, 5.0, None)], "k string, f int, x double, y double, note string")
    boxes = spark.createDataFrame([("a", 1, 0.0, 10.0, 0.0, 10.0), ("a", 1, 40.0, 45.0, 0.0, 10.0)], "k string, f int, x0 double, x1 double, y0 double, y1 double")
    assert sorted(map(tuple, ball.outside(df, boxes, "k", "f").collect()), key=str) == sorted([("a", 1, 50.0, 5.0, "n"), ("a", 1, None, 5.0, "n"), ("a", 2, 5.0, 5.0, None)], key=str)


def test_gaps_are_held_where_they_are_long(spark):
    values = [None, 1.0, None, 3.0, None, None, None, 7.0, None, None, None, None, None, 20.0, None, None, None, None, 30.0, None]
    df = spark.createDataFrame([("s", i, v if v is not None else -99.0, v is not None) for i, v in enumerate(values)], "k string, n int, v double, ok boolean")
    got = [r.filled for r in series.fill_short(df, "k", "n", "v", "ok").orderBy("n").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 7.0, 7.0, 20.0, 20.0, 20.0, 20.0, 20.0, 20.0, 30.0, 30.0, 30.0, 30.0]


def test_global_queue_positions_and_throttle(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(40), r.random() < 0.7, r.choice(["a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, at int, on boolean, k string")
    got = {x.id: x.ahead for x in history.queue_positions(df, "at", F.col("on")).collect()}
    assert got == {i: sum(o and b < a for _, b, o, _ in rows) for i, a, on, _ in rows if on}
    kept = sorted(map(tuple, history.throttle(df, "k", "at", 7.0).collect()), key=str)
    want = []
    for k in ("a", "b", None):
        last = -math.inf
        for a in sorted(a for _, a, _, x in rows if x == k):
            if a - last >= 7:
                want.append((k, float(a)))
                last = a
    assert kept == sorted(want, key=str)


def test_end_reasons_and_counts(spark):
    def run(events):
        rows = [("r", float(i), *e) for i, e in enumerate(events)]
        df = spark.createDataFrame(rows, "k string, t double, kind string, half string, verdict string, hitter string, net_m double")
        c = rally.stroke_counts(df, "k", "t", "kind", "half", "net_m").first()
        return rally.end_reason(df, "k", "t", "kind", "half", "verdict", "hitter").first().reason, (c.observed, c.inferred, c.ambiguous)

    hit, kink, net = ("hit", None, None, None, None), ("kink", None, None, None, None), ("net", None, None, None, None)
    bounce = lambda half, verdict="in", hitter=None, m=9.0: ("bounce", half, verdict, hitter, m)
    assert run([hit]) == ("timeout", (1, 0, 0))
    assert run([hit, net, bounce("far", "out")])[0] == "net"
    assert run([hit, bounce("near", "out", "near")])[0] == "net"
    assert run([hit, bounce("far", "out", "near"), bounce("far")])[0] == "ball_out"
    assert run([hit, bounce("far", "in", "near"), bounce("far")]) == ("double_bounce", (1, 0, 0))
    assert run([bounce("far"), bounce("near")]) == ("lost_track", (0, 2, 0))
    assert run([hit, bounce("far"), hit, bounce("near"), bounce("near"), bounce("near", "out")])[0] == "double_bounce"
    assert run([kink, hit, kink, kink, bounce("far"), kink, kink])[1] == (1, 0, 3)
    assert run([hit, bounce("far", m=0.5), bounce("near")])[1] == (1, 0, 1)
    assert run([hit, bounce("far"), bounce("far", m=0.5)])[1] == (1, 1, 0)
    assert run([kink])[0] == "lost_track"


def test_card_equals_rows(spark):
    """Scores by columns against scores by rows, categories and overall."""
    r = random.Random(6)
    bands = spark.createDataFrame([("a", "contact", 1.0, False, 1.0, 2.0, None, None), ("b", "contact", 2.0, True, 0.0, 1.0, 0.0, None), ("c", "balance", 1.0, False, 5.0, 6.0, None, 6.5), ("d", "swing_path", 1.0, False, 2.0, 2.0, None, None)], "metric string, category string, weight double, lower_is_better boolean, ideal_min double, ideal_max double, physical_min double, physical_max double")
    bands = scorecard.hard_bounds(bands)
    rows = [(i, *(r.choice([None, float("nan"), r.uniform(-2, 9)]) for _ in range(4))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    wide = scorecard.card(df, ["a", "b", "c", "d"], bands)
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    scored = scorecard.metric_scores(df, "id", ["a", "b", "c", "d"], bands)
    cats = scorecard.categories(scored, "id", spark.createDataFrame([(c,) for c in scorecard.CATEGORY_WEIGHTS], "category string"))
    assert sorted(map(tuple, wide.select("id", F.inline("categories")).collect())) == sorted(map(tuple, cats.collect()))
    assert sorted(map(tuple, wide.select("id", "overall").collect())) == sorted(map(tuple, scorecard.overall(cats, "id").collect()))


def test_hand_by_reach_at_the_fastest_frame(spark):
    """One wrist travels further, the other reaches wider: where either is fastest, the one further out decides."""

    def sequence(name, right_out):
        frames_ = []
        for f in range(30):
            mark = [(0.5, 0.5, 0.0, 1.0)] * 33
            for k, y in ((11, 0.3), (12, 0.3), (23, 0.5), (24, 0.5)):
                mark[k] = (0.45 if k % 2 else 0.55, y, 0.0, 1.0)
            sway = 0.02 * (f % 2)
            far = 0.25 if f in (14, 15) else 0.0
            mark[16] = (0.55 + (0.30 if right_out else 0.02) + sway, 0.5, 0.0, 1.0)
            mark[15] = (0.45 - far, 0.5, 0.0, 1.0)
            frames_.append((name, f, f / 30.0, True, 720, 720, [dict(zip(("x", "y", "z", "visibility"), m)) for m in mark]))
        return frames_

    schema = "seq_id string, frame int, ts_s double, detected boolean, width_px int, height_px int, landmarks array<struct<x: double, y: double, z: double, visibility: double>>"
    df = spark.createDataFrame(sequence("a", True) + sequence("b", False), schema)
    got = {r.seq_id: r for r in pose.handedness(pose.frames(df)).collect()}
    assert got["b"].hand == "left" and all(0 <= x.confidence <= 1 for x in got.values())
