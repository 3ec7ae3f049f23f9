"""Rallies against a slow reading; whole sessions from candidates on."""

import random

import numpy as np
from test_flights import MAP, camera_row

from motionlake.operators import courtsession, rallies
from motionlake.operators.ballevents import Camera

OTHER = {"near": "far", "far": "near"}


def slow_rallies(events, flights):
    """Rows of one session.  events: (t, id, kind, end, half, hitter, verdict, y); flights: (id, t0, t1, half)."""
    events = sorted(events)
    items = sorted([(e[0], e[0], 0, e) for e in events] + [(f[1], f[2], 1, f) for f in flights], key=lambda x: x[:3])
    runs = []
    for a, z, what, x in items:
        if not runs or a - runs[-1][1] > 2.5:
            runs.append([a, z, [], []])
        runs[-1][1] = max(runs[-1][1], z)
        runs[-1][2 + what].append(x)
    pieces = []
    for start, end, own, tracks in runs:
        parts, now, dead, prior, lost = [], [], None, None, False
        for e in own:
            t, _, kind, _, half, _, verdict, _ = e
            if dead and kind == "bounce" and t - dead[0] < 1.5 and dead[1] and half == OTHER[dead[1]]:
                dead = None
            if dead:
                if t - dead[0] < 1.5 or kind != "hit":
                    lost = lost or kind != "kink"
                    continue
                parts.append((now, lost))
                now, dead, prior, lost = [], None, None, False
            now.append(e)
            if kind == "bounce" and (verdict == "out" or (prior and prior[2] == "bounce" and half and prior[4] == half)):
                dead = (t, half)
            if kind in ("hit", "bounce"):
                prior = e
        if now:
            parts.append((now, lost))
        for k, (p, lost) in enumerate(parts):
            a, z = start if k == 0 else p[0][0], end if k == len(parts) - 1 else p[-1][0]
            near = tracks if len(parts) == 1 else [f for f in tracks if f[2] >= a - 0.05 and f[1] <= z + 0.05]
            pieces.append((a, z, p, near, lost))
    out = []
    for a, z, own, tracks, lost in pieces:
        contacts = [e for e in own if e[2] in ("hit", "bounce")]
        if not contacts:
            continue
        nets = [e[0] for e in own if e[2] == "net"]
        bad = set()
        for x, y in zip(contacts, contacts[1:]):
            if x[2] == "hit" and x[3] and y[2] == "bounce":
                if (y[0] - x[0] < 0.3 and y[4] == OTHER[x[3]]) or (y[4] == x[3] and not any(x[0] < t < y[0] for t in nets)):
                    bad.add(x[1])
        repeats = lambda c: {y[1] for x, y in zip(c, c[1:]) if x[2] == y[2] == "hit" and x[3] == y[3] and y[0] - x[0] < 0.3}
        flagged = bad | repeats(contacts)
        kept = [e for e in contacts if e[1] not in bad]
        again = repeats(kept)
        kept = [e for e in kept if e[1] not in again]
        landed = max([e[0] for e in own if e[2] in ("bounce", "net")], default=-1e9)
        over = {h[1] for h in contacts if h[2] == "hit" and h[3] and any(f[3] == OTHER[h[3]] and f[2] >= h[0] + 0.4 and f[1] <= h[0] + 0.05 for f in tracks)}
        late = {e[1] for e in kept if e[2] == "hit" and e[0] > landed} - over
        observed, inferred, wide = sum(e[2] == "hit" and e[1] not in late for e in kept), 0, len(late)
        if kept and kept[-1][2] == "bounce" and kept[-1][4]:
            later = [f for f in tracks if f[3] and f[2] > kept[-1][0] + 0.05]
            last = max(later, key=lambda f: (f[2], f[0]))[3] if later else None
            if last and last != kept[-1][4]:
                inferred, wide = inferred + (last == "near"), wide + (last == "far")
        if kept:
            wide += sum(e[2] == "kink" and kept[0][0] < e[0] < kept[-1][0] for e in own) + any(e[2] == "kink" and e[0] > kept[-1][0] for e in own)
            inferred += kept[0][2] != "hit"
        net = lambda e: e[2] == "bounce" and e[7] is not None and abs(e[7]) < 1.0
        for x, y in zip(kept, kept[1:]):
            if x[2] == y[2] == "bounce":
                if net(x):
                    wide += y[4] is not None
                else:
                    inferred += net(y) or bool(x[4] and y[4] and x[4] != y[4])
        spans = sorted((f[1], f[2]) for f in tracks)
        gaps = sum(b[0] - x[1] > 0.2 and not any(x[1] - 0.05 <= e[0] <= b[0] + 0.05 for e in own) for x, b in zip(spans, spans[1:]))
        seen = [e for e in own if e[2] != "kink"]
        hit = max((k for k, e in enumerate(seen) if e[2] == "hit"), default=-1)
        after = seen[hit + 1 :]
        b = [e for e in after if e[2] == "bounce"]
        if any(e[2] == "net" for e in after) or (b and b[0][5] and b[0][5] == b[0][4]):
            reason = "net"
        elif not b:
            reason = "timeout"
        elif b[0][6] == "out":
            reason = "ball_out"
        else:
            reason = "double_bounce" if len(b) > 1 and b[0][4] and b[0][4] == b[1][4] else "lost_track"
        flags = [
            name for name, on in (
                ("contacts_after_point_end", lost), ("bounce_at_net", any(net(e) for e in own)), ("implausible_hit_dropped", flagged),
                ("last_hit_unconfirmed", late - flagged), ("lost_track_gap", gaps), ("two_balls", any(y[0] < x[1] for x, y in zip(spans, spans[1:]))),
            ) if on
        ]
        out.append((round(a, 6), round(z, 6), observed, inferred, observed + inferred, observed + inferred + wide + gaps, reason, flags))
    return out


def test_rallies_against_a_slow_reading(spark):
    r = random.Random(11)
    rows, found, tracks, want = [], [], [], {}
    for s in range(40):
        t, events, flights = 0.0, [], []
        for k in range(r.randrange(1, 22)):
            t = round(t + r.choice([0.11, 0.23, 0.5, 0.9, 1.7, 2.0, 3.1]) + r.random() / 1000, 6)
            kind = r.choice(["hit", "hit", "bounce", "bounce", "bounce", "net", "kink"])
            half = r.choice(["near", "far"]) if kind == "bounce" else None
            y = r.choice([0.4, 3.0, 9.0]) * (1 if half == "far" else -1) if half else None
            events.append((t, k, kind, r.choice(["near", "far", None]) if kind == "hit" else None, half, r.choice(["near", "far", None]) if half else None, r.choice(["in", "in", "out", None]) if half else None, y))
        at = 0.0
        for k in range(r.randrange(0, 12)):
            a = round(max(0.0, at + r.choice([-0.1, 0.03, 0.15, 0.4, 1.0, 3.0])) + r.random() / 1000, 6)
            z = round(a + r.choice([0.3, 0.8, 2.0]), 6)
            flights.append((k, a, z, r.choice(["near", "far", None])))
            at = z
        rows += [(s, k, t, kind, end) for t, k, kind, end, *_ in events]
        found += [(s, k, y, half, hitter, (verdict,)) for t, k, kind, end, half, hitter, verdict, y in events if kind == "bounce"]
        tracks += [(s, *f) for f in flights]
        want[s] = slow_rallies(events, flights)
    e = spark.createDataFrame(rows, "s int, event_id int, t double, kind string, end string")
    found_ = spark.createDataFrame(found, "s int, event_id int, y double, half string, hitter_end string, call struct<verdict: string>")
    f = spark.createDataFrame(tracks, "s int, flight_id int, t0 double, t1 double, half string")
    got = {}
    for x in rallies.segment(e, found_, f, "s").orderBy("s", "rally").collect():
        got.setdefault(x.s, []).append((round(x.start, 6), round(x.end, 6), x.observed, x.inferred, x.length_min, x.length_max, x.reason, x.flags))
    for s, rows in want.items():
        assert got.get(s, []) == rows, s
    flags = {f for rows in want.values() for x in rows for f in x[7]}
    assert len(flags) == 6 and sum(map(len, want.values())) > 60


def seen_ball():
    """Candidates of a ball that is hit, bounces and is hit back."""
    row = camera_row()
    camera = Camera(row[0], row[1], row[2:5], row[5])
    p, v, path, bounced = np.array([0.5, -10.0, 1.0]), np.array([0.8, 22.0, 3.2]), [], None
    for k in range(96):
        path.append(p.copy())
        v = v + [0, 0, -9.81 / 60]
        p = p + v / 60
        if p[2] < 0 and bounced is None:
            bounced, p[2], v = k, 0.0, v * [0.75, 0.75, -0.75]
        if bounced and k > bounced + 24 and v[1] > 0:
            v = np.array([-8.0, -20.0, 8.0])
    return camera.project(np.array(path)), bounced / 60


def test_sessions_that_are_refused_cut_and_whole(spark):
    uv, bounced = seen_ball()
    row = camera_row()
    sessions = range(1, 7)  # whole, bumped, moving, unmapped, slow, without frames
    rate = {5: 10.0}
    c = spark.createDataFrame([(k, i, float(x), float(y), 5.0, 5.0, 0.0, 0.9, 1.0) for k in sessions if k < 6 for i, (x, y) in enumerate(uv)], "k int, frame int, x double, y double, minor double, major double, orientation_deg double, colour_score double, contrast double")
    f = spark.createDataFrame([(k, i, i / rate.get(k, 60.0)) for k in sessions if k < 6 for i in range(len(uv))], "k int, frame int, time_s double")
    bump = bounced - 0.1
    stable = spark.createDataFrame([(1, "stable", None, 1.0), (2, "shaky", bump, 1.0), (3, "moving", None, 9.0), (4, "stable", None, 1.0), (5, "stable", None, 1.0), (6, "stable", None, 1.0)], "k int, verdict string, bumped_at double, rms double")
    wobble = "array<struct<plus: array<double>, minus: array<double>, step: double>>"
    maps = spark.createDataFrame([(k, *row, 1.0, [], True) for k in sessions if k != 4], f"{MAP}, sigma_tap_px double, wobble {wobble}, calls_allowed boolean")
    hits = spark.createDataFrame([(k, 0.0, None, None, "near", 0.9, "serve", None, None) for k in sessions], "k int, time_s double, wrist_u double, wrist_v double, end string, confidence double, shot_type string, feet_u double, feet_v double")
    got = courtsession.analyze(c, f, stable, maps, hits, "k")
    status = {x.k: (x.status, x.refusal_reason) for x in got.sessions.collect()}
    assert status == {1: ("complete", None), 2: ("partial", None), 3: ("refused", "camera_moving"), 4: ("refused", "not_calibrated"), 5: ("refused", "frame_rate_too_low"), 6: ("refused", "frame_rate_too_low")}
    assert {x.k for x in got.flights.select("k").distinct().collect()} == {1, 2}
    events = got.events.orderBy("k", "t").collect()
    assert [x.kind for x in events if x.k == 1] == ["hit", "bounce", "hit"] and [x.kind for x in events if x.k == 2] == ["hit"]
    (place,) = got.landings.collect()
    assert place.k == 1 and place.hitter_end == "near" and place.half == "far" and place.is_serve
    game = {x.k: x for x in got.rallies.collect()}
    assert game[1].length_min >= 1 and game[1].start == 0.0 and game[2].end < bump and got.summary.first()["count"] == 1
    nothing = courtsession.analyze(c.limit(0), f.limit(0), stable.limit(0), maps, hits, "k")
    assert nothing.sessions.count() == nothing.rallies.count() == nothing.summary.count() == 0
