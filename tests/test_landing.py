"""Landings and rallies: geometry against matrices, calls and runs against slow readings."""

import random

import numpy as np
from pyspark.sql import functions as F

from motionlake.operators import calibration, court, landing, rallies

EVENTS = "s string, run int, event_id int, t double, kind string, u double, v double, uu double, uv double, vv double, confidence double, flags array<string>, end string, shot_type string"


def view():
    """A camera behind the near baseline: projection, and taps of all keypoints."""
    place, f = np.array([0.5, -20.0, 7.0]), 900.0
    down = np.radians(15)
    turn = np.array([[1, 0, 0], [0, -np.sin(down), -np.cos(down)], [0, np.cos(down), -np.sin(down)]])
    p = np.array([[f, 0, 640], [0, f, 360], [0, 0, 1]]) @ np.column_stack([turn, -turn @ place])
    return place, f, p


def seen(p, xyz):
    q = p @ np.append(xyz, 1.0)
    return q[:2] / q[2]


def maps(spark, p, step=1):
    points = landing.keypoints(spark).orderBy("keypoint").collect()[::step]
    taps = [("m", x.x_m, x.y_m, *map(float, seen(p, [x.x_m, x.y_m, 0.0])), 1280, 720) for x in points]
    return calibration.court_maps(spark.createDataFrame(taps, "s string, x_m double, y_m double, u_px double, v_px double, frame_w int, frame_h int"), "s")


def test_camera_place_and_ground(spark):
    place, f, p = view()
    cal = maps(spark, p).withColumn("shake_px", F.lit(0.5))
    c = cal.first()
    assert np.allclose([c.cam_x, c.cam_y, c.cam_z, c.focal_px], [*place, f], rtol=1e-6) and c.calls_allowed and len(c.wobble) == 28
    q = np.array(c.projection).reshape(3, 4)
    assert np.allclose(q / q[2, 3], p / p[2, 3], rtol=1e-6)
    assert not maps(spark, p, 2).first().calls_allowed
    # a ball that lies on the court is found where it touches the ground
    rows, truth = [], {}
    for k, (x, y) in enumerate([(0.0, 3.0), (-3.9, 11.0), (4.0, -11.5), (2.0, -1.0)]):
        u, v = seen(p, [x, y, landing.BALL_RADIUS])
        truth[k] = x, y
        rows.append(("m", 1, k, float(k), "bounce", float(u), float(v), 1.0, 0.2, 2.0, 0.9, [], None, None))
    got = landing.on_ground(spark.createDataFrame(rows, EVENTS), cal, "s").collect()
    h = np.array(c.h).reshape(3, 3)
    for r in got:
        assert np.allclose([r.x, r.y], truth[r.event_id], atol=1e-6)
        # covariance by differences of the map and of refitted maps
        at = lambda m, a, b: (lambda w: w[:2] / w[2])(m @ np.array([a, b, 1.0]))
        j = np.column_stack([(at(h, r.u + 1e-4, r.v) - at(h, r.u - 1e-4, r.v)) / 2e-4, (at(h, r.u, r.v + 1e-4) - at(h, r.u, r.v - 1e-4)) / 2e-4])
        cov = j @ (np.array([[1.0, 0.2], [0.2, 2.0]]) + 0.25 * np.eye(2)) @ j.T
        for w in c.wobble:
            d = (at(np.array(w.plus).reshape(3, 3), r.u, r.v) - at(np.array(w.minus).reshape(3, 3), r.u, r.v)) / w.step
            cov += 1.5**2 * np.outer(d, d)
        cov *= ((place[2] - landing.BALL_RADIUS) / place[2]) ** 2
        assert np.allclose([r.xx, r.xy, r.yy], [cov[0, 0], cov[0, 1], cov[1, 1]], rtol=1e-4, atol=1e-9)


FLAT = "s string, h array<double>, cam_x double, cam_y double, cam_z double, shake_px double, sigma_tap_px double, wobble array<struct<plus: array<double>, minus: array<double>, step: double>>, calls_allowed boolean"


def flat(spark, allowed=True):
    return spark.createDataFrame([("m", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 0.0, 0.0, 1e12, None, 1.0, [], allowed)], FLAT)


def play(spark, events, allowed=True, doubles=False):
    """events: (kind, x, y, end); places in metres, deviations of 5 cm."""
    rows = [("m", 1, k, k * 0.8, kind, float(x), float(y), 0.0025, 0.0, 0.0025, 0.9, list(flags), end, None) for k, (kind, x, y, end, *flags) in enumerate(events)]
    e = spark.createDataFrame(rows, EVENTS)
    return e, landing.landings(e, flat(spark, allowed), "s", doubles)


def calls(found):
    return {r.event_id: (r.hitter_end, r.target, r.call and r.call.verdict, r.call and r.call.line) for r in found.collect()}


def test_targets_and_calls(spark):
    events = [
        ("hit", 0, -11, "near"), ("bounce", 4.0, 8, None), ("bounce", 4.115, 8, None), ("hit", 0, 11, "far"), ("bounce", 1, -12.2, None), ("hit", 0, -11, "near"), ("bounce", 0, -6, None), ("net", 0, 0, None), ("bounce", 0, -6, None),
        ("bounce", 0, 0.1, None), ("bounce", -5.0, 8, None, "weak_bounce"), ("bounce", 0, 13, None, "one_sided_bounce"), ("bounce", -5.0, 8, None, "one_sided_bounce"),
    ]
    got = calls(play(spark, events)[1])
    assert got[1] == ("near", "singles_half", "in", "right_singles_sideline") and got[2][2] == "too_close"
    assert got[4] == ("far", "singles_half", "out", "near_baseline")
    assert got[6] == (None, "half_only", "in", "left_singles_sideline") or got[6][:3] == (None, "half_only", "in")  # a missed hit
    assert got[8] == ("near", "singles_half", None, None)  # fell back from the net
    assert got[9][2] is None and got[10][2:] == ("too_close", "left_singles_sideline") and got[11][2:] == ("too_close", "far_baseline") and got[12][2] == "out"
    assert calls(play(spark, events, doubles=True)[1])[2][2] == "in"
    assert all(x[2] is None for x in calls(play(spark, events, allowed=False)[1]).values())


def test_out_ball_that_was_played_on(spark):
    e, found = play(spark, [("hit", 0, -11, "near"), ("bounce", 0, 12.5, None), ("bounce", 0, -6, None), ("hit", 0, -11, "near")])
    again, after = landing.session_landings(e, flat(spark), "s")
    assert [(r.event_id, r.end) for r in landing.played_on(e, found, "s").collect()] == [(1, "far")]
    assert [(r.kind, r.end) for r in again.orderBy("event_id").collect()][1] == ("hit", "far") and set(calls(after)) == {2} and calls(after)[2][0] == "far"
    s = landing.summary(after, "s").first()
    assert s["count"] == 1 and s["in"] == 1 and abs(s.expected_short + s.expected_mid + s.expected_deep + s.expected_beyond - 1) < 1e-9


def test_refusal(spark):
    rows = [(30.0, "stable", True, None), (10.0, "moving", True, "frame_rate_too_low"), (30.0, "moving", True, "camera_moving"), (30.0, None, True, "camera_unknown"), (30.0, "stable", None, "not_calibrated"), (None, "stable", True, "frame_rate_too_low")]
    df = spark.createDataFrame(rows, "fps double, s string, c boolean, want string")
    assert all(r[0] == r[1] for r in df.select(landing.refusal(F.col("fps"), F.col("s"), F.col("c")), "want").collect())


def slow_points(events, restart):
    """(point of each event or None) of one run; events are (t, kind, half, verdict)."""
    out, number, dead, half_dead, prior = [], 0, None, None, None
    for t, kind, half, verdict in events:
        if dead is not None and kind == "bounce" and t - dead < restart and half and half_dead and half != half_dead:
            dead = None
        if dead is not None and not (kind == "hit" and t - dead >= restart):
            out.append(None)
            continue
        if dead is not None:
            number, dead, prior = number + 1, None, None
        out.append(number)
        if kind == "bounce" and (verdict == "out" or prior and prior[0] == "bounce" and half and prior[1] == half):
            dead, half_dead = t, half
        if kind in ("hit", "bounce"):
            prior = kind, half
    return out


def test_points_against_a_slow_walk(spark):
    r = random.Random(7)
    rows, want = [], {}
    for s in range(30):
        t, run = 0.0, []
        for k in range(r.randrange(1, 14)):
            t += r.choice([0.3, 0.8, 1.7])
            kind = r.choice(["hit", "bounce", "bounce", "net", "kink"])
            run.append((t, kind, r.choice(["near", "far"]) if kind == "bounce" else None, r.choice(["in", "in", "out", None]) if kind == "bounce" else None))
            rows.append((s, 1, k, *run[-1]))
        want[s] = slow_points(run, 1.5)
    got = {}
    for x in rallies.points(spark.createDataFrame(rows, "s int, run int, event_id int, t double, kind string, half string, verdict string"), "s").orderBy("s", "event_id").collect():
        got.setdefault(x.s, []).append(x.point)
    assert got == want


def test_rallies(spark):
    """Two points apart by silence, one of them with a lost ball, and a run without a contact."""
    events = [
        ("hit", 0, -11, "near"), ("bounce", 0, 8, None), ("hit", 0, 11, "far"), ("bounce", 0, -8, None), ("bounce", 0, -9, None),  # double bounce
    ]
    e, _ = play(spark, events)
    more = [("m", 1, 50 + k, 20.0 + 0.8 * k, kind, 0.0, float(y), 0.0025, 0.0, 0.0025, 0.9, [], end, None) for k, (kind, y, end) in enumerate([("hit", -11, "near"), ("bounce", 8, None), ("hit", 11, "far")])]
    e = e.unionByName(spark.createDataFrame(more + [("m", 1, 90, 60.0, "kink", 0.0, 0.0, 0.1, 0.0, 0.1, 0.9, [], None, None)], EVENTS))
    found = landing.landings(e, flat(spark), "s")
    flights = spark.createDataFrame([("m", 1, 0.0, 1.5, "far"), ("m", 2, 1.6, 3.1, "near"), ("m", 3, 20.0, 21.5, "far"), ("m", 4, 21.9, 22.3, "far")], "s string, flight_id int, t0 double, t1 double, half string")
    got = [x.asDict() for x in rallies.segment(e, found, flights, "s").orderBy("rally").collect()]
    assert [(x["rally"], x["observed"], x["inferred"], x["length_min"], x["length_max"], x["confidence"], x["reason"], x["flags"]) for x in got] == [
        (0, 2, 0, 2, 2, "high", "double_bounce", []),
        (1, 1, 0, 1, 2, "medium", "timeout", ["last_hit_unconfirmed"]),  # the hit is where the tracks join
    ]


def slow_bump(times, shifts, edge):
    """When the first settled excursion begins, sample by sample."""
    above, k = [np.hypot(*s) >= 0.002 * edge for s in shifts], 0
    while k < len(times):
        stop = k
        while stop < len(times) and above[stop]:
            stop += 1
        if stop > k and times[stop - 1] - times[k] >= 0.95:
            for first in range(k, stop):
                inside = [j for j in range(first, stop) if times[j] - times[first] <= 1.05]
                part = np.array([shifts[j] for j in inside])
                steady = np.max(np.hypot(*(part - np.median(part, axis=0)).T)) <= 0.001 * edge
                if times[first] <= times[k] + 1.05 and times[inside[-1]] - times[first] >= 0.95 and steady:
                    return times[k]
        k = max(stop, k + 1)
    return None


def test_camera_bumps_against_a_slow_reading(spark):
    r = random.Random(8)
    rows, want = [], {}
    for s in range(40):
        times, shifts, place = [], [], [0.0, 0.0]
        for k in range(r.randrange(1, 40)):
            if r.random() < 0.08:
                place = [r.choice([0.0, 3.0, 8.0]), r.choice([0.0, 4.0])]
            times.append(0.2 * k + r.choice([0.0, 0.01]))
            shifts.append((place[0] + r.uniform(-0.3, 0.3), place[1] + r.choice([0.0, 0.0, 0.0, 2.0])))
            rows.append((s, times[-1], *shifts[-1], 50.0))
        want[s] = slow_bump(times, shifts, 1280.0)
    df = spark.createDataFrame(rows, "s int, t double, dx double, dy double, n double")
    got = {x.s: x.bumped_at for x in court.bumps(df, "s", "t", "dx", "dy", 1280.0).collect()}
    assert got == {k: v for k, v in want.items() if v is not None} and 3 < len(got) < 40
    still = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 50.0), ("a", 1.0, 1.0, 0.0, 50.0), ("a", 2.0, float("nan"), 0.0, 50.0), ("b", 0.0, 0.0, 0.0, 50.0), ("c", 0.0, 0.0, 0.0, 3.0), ("c", 1.0, 0.0, 0.0, 3.0)], "s string, t double, dx double, dy double, n double")
    assert [(x.s, x.samples, x.verdict) for x in court.camera_stability(still, "s", "t", "dx", "dy", "n", 1280.0).orderBy("s").collect()] == [("a", 3, "stable"), ("b", 1, "unknown"), ("c", 2, "unknown")]
