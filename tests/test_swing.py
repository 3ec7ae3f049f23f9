"""Swing metrics against numpy on arrays."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from motionlake.operators import swing

MARKS = "seq_id int, frame int, ts_s double, pos int, marks array<struct<x: double, y: double, seen: boolean>>"


def random_swings(spark, count=8, n=24):
    rng = np.random.default_rng(3)
    xy, seen = rng.normal(0, 1, (count, n, 33, 2)), rng.random((count, n, 33)) < 0.85
    xy[:, :, 15] = np.cumsum(rng.normal(0, 0.3, (count, n, 2)), axis=1)
    xy[:, :, 16] = np.cumsum(rng.normal(0.1, 0.3, (count, n, 2)), axis=1)
    seen[0, :, 15:17] = False
    t = np.cumsum(rng.uniform(0.02, 0.05, (count, n)), axis=1)
    rows = [(s, k, float(t[s, k]), k, [(float(x), float(y), bool(v)) for (x, y), v in zip(xy[s, k], seen[s, k])]) for s in range(count) for k in range(n)]
    hands = [(s, ["left", "right", None][s % 3]) for s in range(count)]
    contacts = [(s, 2 + 3 * s) for s in range(count)]
    phases = [(s, p, a, b) for s in range(count) for p, a, b in (("ready", 0, 2), ("takeback", 2, 5), ("contact", 9, 9), ("follow_through", 10, 10 if s == 4 else 18))]
    frames = [spark.createDataFrame(rows, MARKS), spark.createDataFrame(hands, "seq_id int, hand string"), spark.createDataFrame(contacts, "seq_id int, pos int"), spark.createDataFrame(phases, "seq_id int, phase string, start int, `end` int")]
    return xy, seen, t, dict(hands), dict(contacts), frames


def near(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-9


def test_against_arrays(spark):
    xy, seen, t, hands, contacts, (marks, h, c, ph) = random_swings(spark)
    count, n = xy.shape[:2]
    got = {name: {r.seq_id: r for r in df.collect()} for name, df in {
        "path": swing.swing_path(marks, c, h), "lag": swing.wrist_lag(marks, c, h), "through": swing.follow_through_height(marks, c, h),
        "apart": swing.wrist_separations(marks, c), "at": swing.at_contact(marks, c, h), "way": swing.swing_length(marks, ph, h),
    }.items()}
    for s in range(count):
        w = {"left": 15, "right": 16, None: None}[hands[s]]
        e = {"left": 13, "right": 14, None: None}[hands[s]]
        k = contacts[s]
        pick = [f for f in range(max(0, k - 6), min(n - 1, k + 3) + 1) if w and seen[s, f, w]]
        want = (None, None)
        if len(pick) >= 3:
            p = xy[s, pick, w]
            d = np.linalg.svd(p - p.mean(axis=0))[2][0]
            d = d if d @ (p[-1] - p[0]) >= 0 else -d
            a = math.degrees(math.atan2(d[1], d[0]))
            a = 180 - a if a > 90 else -180 - a if a < -90 else a
            want = a, float(np.sqrt(np.mean(((p - p.mean(axis=0)) @ np.array([-d[1], d[0]])) ** 2)))
        r = got["path"].get(s)
        assert near(r and r.angle_deg, want[0]) and near(r and r.deviation_tu, want[1]), s
        f = k - 3
        want = None
        if w and f >= 0 and seen[s, f, w] and seen[s, f, e]:
            v = np.gradient(xy[s, :, w], t[s], axis=0) if False else None
            arm = xy[s, f, w] - xy[s, f, e]
            lo, hi = max(0, f - 1), min(n - 1, f + 1)
            v = (xy[s, hi, w] - xy[s, lo, w]) / (t[s, hi] - t[s, lo])
            want = math.degrees(math.acos(np.clip(arm @ v / np.linalg.norm(arm) / np.linalg.norm(v), -1, 1)))
        r = got["lag"].get(s)
        assert near(r and r.lag_deg, want), s
        heights = [xy[s, f, w, 1] - xy[s, f, 11:13, 1].mean() for f in range(k + 1, n) if w and seen[s, f, w] and seen[s, f, 11:13].all()]
        r = got["through"].get(s)
        assert near(r and r.height_tu, max(heights) if heights else None)
        apart = [float(np.linalg.norm(xy[s, f, 15] - xy[s, f, 16])) for f in range(max(0, k - 3), min(n - 1, k + 3) + 1) if seen[s, f, 15:17].all()]
        r = got["apart"].get(s)
        assert np.allclose(r.separations if r else [], apart)
        r = got["at"].get(s)
        axis = (xy[s, k, 12] - xy[s, k, 11]) * (1 if w == 16 else -1) if k < n else None
        want = float((xy[s, k, w] - xy[s, k, 11:13].mean(axis=0)) @ axis / np.linalg.norm(axis)) if w and k < n and seen[s, k, [w, 11, 12]].all() else None
        assert near(r and r.across_tu, want)
        assert (r and r.above_nose) == (bool(xy[s, k, w, 1] > xy[s, k, 0, 1]) if w and k < n and seen[s, k, [w, 0]].all() else None)
        r = got["way"].get(s)
        span = range(2, 18)
        good = [f for f in span if w and seen[s, f, w]]
        way = sum(float(np.linalg.norm(xy[s, f + 1, w] - xy[s, f, w])) for f in span[:-1] if w and seen[s, f, w] and seen[s, f + 1, w])
        assert (r is None) == (s == 4)
        assert s == 4 or near(r.length_tu, way if len(good) >= 2 else None) and near(r.duration_s, t[s, 17] - t[s, 2])


def test_folds_and_signs(spark):
    df = spark.createDataFrame([(1, 135.0), (1, -135.0), (1, 20.0), (2, 90.0), (3, None), (3, 4.0), (4, -7.0), (4, 5.0)], "k int, a double")
    assert [r[0] for r in df.select(swing.forward_fold(F.col("a"))).collect()] == [45.0, -45.0, 20.0, 90.0, None, 4.0, -7.0, 5.0]
    got = {r.k: r.a for r in swing.largest_signed(df, "k", "a").collect()}
    assert abs(got[1]) == 135.0 and got[2] == 90.0 and got[3] is None and got[4] == -7.0


def slow_turn(frames, a, b, least, line):
    """(turn, flag) of one sequence's frames within the swing: (marks, seen) of both landmarks."""
    good, short = [], False
    for (ax, ay, sa), (bx, by, sb) in ((f[a], f[b]) for f in frames):
        if sa and sb:
            if math.hypot(bx - ax, by - ay) >= least:
                good.append(math.degrees(math.atan2(by - ay, bx - ax)))
            else:
                short = True
    if len(good) < 5:
        return None, f"{line}_foreshortened" if short else f"{line}_too_few_frames"
    s, c = (sum(f(math.radians(2 * x)) for x in good[:3]) / 3 for f in (math.sin, math.cos))
    start = math.degrees(math.atan2(s, c)) / 2
    off = [abs((x - start + 90) % 180 - 90) for x in good]
    return max(sorted(off[k - 1 : k + 2])[1] for k in range(1, len(off) - 1)), None


def test_turns_and_knees_against_slow_readings(spark):
    r = random.Random(6)
    rows, spans, want, knees, sides = [], [], {}, {}, {}
    for i in range(40):
        n, turn = r.choice([4, 12, 30]), r.uniform(-4, 4)
        frames = []
        for f in range(n):
            size = r.choice([0.05, 0.3, 0.3, 0.3])
            angle = math.radians(turn * f + r.gauss(0, 2))
            marks = [(r.gauss(0, 1), r.gauss(0, 1), r.random() < 0.9) for _ in range(33)]
            for a, b in ((11, 12), (23, 24)):
                marks[b] = (marks[a][0] + size * math.cos(angle), marks[a][1] + size * math.sin(angle), marks[b][2])
            frames.append(marks)
            rows.append((i, f, f / 30, f, [{"x": x, "y": y, "seen": s} for x, y, s in marks]))
        spans += [(i, "takeback", 1, 4), (i, "forward_swing", 3, min(n, 8)), (i, "follow_through", 5, n)]
        inside = frames[1:n] if n > 5 else None
        if inside:
            want[i] = [slow_turn(inside, 11, 12, 0.10, "shoulder_line"), slow_turn(inside, 23, 24, 0.08, "hip_line")]
        way = 1 if i % 2 else -1
        at = frames[3]
        legs = [(at[k][0] * way, -j, (h, k, a)) for j, (h, k, a) in enumerate(((23, 25, 27), (24, 26, 28))) if at[h][2] and at[k][2] and at[a][2]]
        if legs:
            leg = max(legs)[2]
            sides[i] = "left" if leg[0] == 23 else "right"
            bends = []
            for m in frames[3 : min(n, 8)]:
                h, k, a = (m[j] for j in leg)
                if h[2] and k[2] and a[2]:
                    u, v = (h[0] - k[0], h[1] - k[1]), (a[0] - k[0], a[1] - k[1])
                    bends.append(math.degrees(math.acos(max(-1, min(1, (u[0] * v[0] + u[1] * v[1]) / (math.hypot(*u) * math.hypot(*v)))))))
            if bends:
                knees[i] = min(bends)
    marks = spark.createDataFrame(rows, "seq_id int, frame int, ts_s double, pos int, marks array<struct<x: double, y: double, seen: boolean>>")
    ph = spark.createDataFrame(spans, "seq_id int, phase string, start int, end int")
    contacts = marks.select("seq_id").distinct().withColumn("pos", F.lit(3))
    ways = contacts.select("seq_id", F.when(F.col("seq_id") % 2 == 1, 1).otherwise(-1).alias("direction"))
    for k, found in enumerate((swing.line_turn(marks, ph), swing.hip_turn(marks, ph))):
        got = {x.seq_id: (x.turn_deg, x.flag) for x in found.collect()}
        assert set(got) == set(want)
        for i, (turn, flag) in ((i, w[k]) for i, w in want.items()):
            assert got[i][1] == flag and (got[i][0] is None if turn is None else abs(got[i][0] - turn) < 1e-6)
    assert {w[0][1] for w in want.values()} == {None, "shoulder_line_foreshortened"} or len({w[0][1] for w in want.values()}) >= 2
    assert {x.seq_id: x.side for x in swing.front_leg(marks, contacts, ways).collect()} == sides
    got = {x.seq_id: x.angle_deg for x in swing.knee_flexion(marks, ph, contacts, ways).collect()}
    assert set(got) == set(knees) and all(abs(got[i] - v) < 1e-5 for i, v in knees.items())
    warned = spark.range(1).select(swing.turn_warning(F.lit("hip_rotation_deg"), F.lit("hip_line_foreshortened")).alias("w")).first().w
    assert warned.startswith("hip_line_foreshortened: hip_rotation_deg unavailable")
