"""Linked flights, breaks and event classes against slow readings of their rules."""

import math
import random

import numpy as np
import pytest

from motionlake.operators import ball, ballevents, flights
from motionlake.operators.ballevents import Camera, can_bounce, can_touch_net
from motionlake.operators.fits import Stretches, rough_windows


def camera_row(focal=1500.0, cam=(0.0, -22.0, 6.0)):
    ahead = -np.array(cam) / np.linalg.norm(cam)
    across = np.array([ahead[1], -ahead[0], 0.0]) / np.hypot(*ahead[:2])
    turn = np.stack([across, np.cross(ahead, across), ahead])
    p = np.array([[focal, 0, 960.0], [0, focal, 540.0], [0, 0, 1]]) @ np.column_stack([turn, -turn @ cam])
    return np.linalg.inv(p[:, [0, 1, 3]]).ravel().tolist(), p.ravel().tolist(), *cam, focal


MAP = "k int, h array<double>, projection array<double>, cam_x double, cam_y double, cam_z double, focal_px double"


def px_per_m(x, y, row):
    g = np.reshape(row[0], (3, 3)) @ [x, y, 1.0]
    return row[5] / math.dist((g[0] / g[2], g[1] / g[2], 0.0), row[2:5])


def poly(t, v, degree):
    return np.polynomial.Polynomial.fit(t, v, degree)


def quad_rms(t, xy, degree=None):
    degree = min(2, len(t) - 1) if degree is None else degree
    return math.sqrt(sum(np.mean((poly(t, xy[:, c], degree)(t) - xy[:, c]) ** 2) for c in (0, 1)))


def thrown_squares(t, xy, free):
    """The image of a parabola, by the whole system of one stretch."""
    s = (t - t.mean()) / np.abs(t - t.mean()).max()
    size = max(np.abs(xy - xy.mean(axis=0)).max(), 1.0)
    p = (xy - xy.mean(axis=0)) / size
    rows, right = [], []
    for k in range(len(t)):
        b = [1.0, s[k], s[k] ** 2]
        for c in (0, 1):
            full = [*(b if c == 0 else [0] * 3), *(b if c == 1 else [0] * 3), *(-p[k, c] * np.array(b))]
            rows.append(full if free else full[:6] + full[7:])
            right.append(p[k, c])
    if free:
        c = np.linalg.svd(np.array(rows))[2][-1]
    else:
        x = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0]
        c = np.array([*x[:6], 1.0, *x[6:]])
    w = c[6] + c[7] * s + c[8] * s**2
    if (free and (np.abs(w).min() < 1e-9 or w.min() < 0 < w.max())) or (not free and w.min() <= 1e-6):
        return math.inf
    u, v = (c[0] + c[1] * s + c[2] * s**2) / w, (c[3] + c[4] * s + c[5] * s**2) / w
    return float((((u - p[:, 0]) ** 2 + (v - p[:, 1]) ** 2) * size**2).sum())


def smooth_rms(t, xy):
    q = quad_rms(t, xy)
    return q if q <= 3 or len(t) < 6 else min(q, math.sqrt(thrown_squares(t, xy, True) / len(t)))


def slow_rough(t, xy):
    rough = 0
    for a in range(len(t)):
        at = [j for j in range(a, len(t)) if t[j] - t[a] <= 0.25 + 1e-9]
        w, p = t[at], xy[at]
        if len(at) < 5 or smooth_rms(w, p) <= 3:
            continue
        piece = lambda u, v: 0.0 if len(u) <= 2 else quad_rms(u, v, min(2, len(u) - 2)) if len(u) < 6 else smooth_rms(u, v)
        if all(math.sqrt((piece(w[:c], p[:c]) ** 2 * c + piece(w[c:], p[c:]) ** 2 * (len(at) - c)) / len(at)) > 3 for c in range(1, len(at))):
            rough += 1
    return rough


def test_stretches_of_many_flights_against_single_fits():
    r = np.random.default_rng(3)
    t, xy, first, last = [], [], [], []
    for n in (0, 3, 5, 9, 30, 40, 25, 61):
        first.append(len(t))
        s = np.sort(r.uniform(0, n / 40, n))
        depth = 10 + 25 * s
        path = np.column_stack([900 * (s - 0.2) / depth * 10, (200 - 4000 * s * (0.8 - s)) / depth * 10])
        path += r.normal(0, r.choice([0.1, 2.0, 6.0]), (n, 2)) + (np.where(s > n / 90, 40 * s, 0)[:, None] if n % 2 else 0)
        t += s.tolist()
        xy += path.tolist()
        last.append(len(t))
    t, xy, first, last = np.array(t), np.array(xy), np.array(first), np.array(last)
    want = [slow_rough(t[a:b], xy[a:b]) for a, b in zip(first, last)]
    assert rough_windows(t, xy, first, last).tolist() == want and sum(x > 0 for x in want) >= 2 and 0 in want[3:]
    for a, b in zip(first, last):
        if b - a >= 6:
            both = Stretches(t, xy, np.array([a]), np.array([b]))
            for free in (True, False):
                assert both.thrown(free)[0] == pytest.approx(thrown_squares(t[a:b], xy[a:b], free), rel=1e-6, abs=1e-6)


def slow_link(times, cands, row):
    """One track after the other, one candidate after the other.  cands: (frame, x, y, minor, major, angle), sorted."""
    dt = float(np.median(np.diff(times)))
    least = 6 if 1 / dt >= 45 else 4
    scale = lambda x, y: px_per_m(x, y, row)
    here = {}
    for i, c in enumerate(cands):
        here.setdefault(c[0], []).append(i)
    at = lambda i: np.array(cands[i][1:3])

    def along(i, origin):
        _, x, y, minor, major, angle = cands[i]
        dx, dy = x - origin[0], y - origin[1]
        if minor < 3 or major < 1.6 * minor or (dx == 0 and dy == 0):
            return True
        off = abs((angle - math.degrees(math.atan2(dy, dx))) % 180)
        return min(off, 180 - off) <= 25

    def fits(points):
        t, p = np.array([times[cands[i][0]] for i in points]), np.array([at(i) for i in points])
        return quad_rms(t, p) <= 3

    tracks, used = [], set()
    for f, now in enumerate(times):
        open_ = []
        for k, tr in enumerate(tracks):
            if tr["state"] != "open":
                continue
            if now - times[cands[tr["pts"][-1]][0]] - dt > 0.1 + 1e-9:
                if not tr["ok"]:
                    del tr["pts"][tr["trial"] :]
                tr["state"] = "closed"
                continue
            lead = tr["pts"][tr["from"] :][-5:]
            t = np.array([times[cands[i][0]] for i in lead])
            ahead = np.array([poly(t, np.array([at(i)[c] for i in lead]), min(2, len(lead) - 1))(now) if len(lead) > 1 else at(lead[0])[c] for c in (0, 1)])
            end = at(tr["pts"][-1])
            reach = 71.5 * (now - times[cands[tr["pts"][-1]][0]]) * scale(*end) * 1.5
            open_.append((k, ahead, end, reach, tr["ok"]))
        moved = []
        for proven in (True, False):
            tier = [o for o in open_ if o[4] is proven]
            pairs = sorted((math.dist(at(i), o[1]), o[0], i) for o in tier for i in here.get(f, []) if math.dist(at(i), o[1]) <= max(4, 0.35 * o[3]) and along(i, o[2]))
            for _, k, i in pairs:
                tr = tracks[k]
                lead = tr["pts"][tr["from"] :]
                if k in moved or i in used or (tr["ok"] and len(lead) >= 5 and not fits([*lead[-5:], i])):
                    continue
                tr["pts"].append(i)
                tr["jump"] = True
                used.add(i)
                moved.append(k)
            pairs = sorted((math.dist(at(i), o[1]), o[0], i) for o in tier if tracks[o[0]]["jump"] for i in here.get(f, []) if math.dist(at(i), o[2]) <= o[3] and along(i, o[2]))
            for _, k, i in pairs:
                if k in moved or i in used:
                    continue
                tr = tracks[k]
                tr["from"] = len(tr["pts"]) - 1
                if tr["ok"]:
                    tr["ok"], tr["trial"] = False, len(tr["pts"])
                tr["pts"].append(i)
                tr["jump"] = False
                used.add(i)
                moved.append(k)
        for k in moved:
            tr = tracks[k]
            tried = tr["pts"][tr["trial"] :]
            if not tr["ok"] and len(tried) >= min(6, least):
                t, p = np.array([times[cands[i][0]] for i in tried]), np.array([at(i) for i in tried])
                accel = 2 * np.hypot(*(poly(t, p[:, c], 2).convert().coef[2] if len(poly(t, p[:, c], 2).convert().coef) > 2 else 0.0 for c in (0, 1)))
                if fits(tried) and accel <= 600 * scale(*p.mean(axis=0)) + 3 / dt**2:
                    tr["ok"] = True
                else:
                    del tr["pts"][tr["trial"] :]
                    tr["state"], tr["ok"] = "closed", True
                    used -= {i for i in tried if cands[i][0] >= f - 2}
        if f >= 2:
            free = [[i for i in here.get(g, []) if i not in used] for g in (f - 2, f - 1, f)]
            options = []
            for a in free[0]:
                step = 71.5 * scale(*at(a)) * 1.5
                for b in free[1]:
                    if math.dist(at(a), at(b)) > step * (times[f - 1] - times[f - 2]) or not along(b, at(a)):
                        continue
                    ahead = at(b) + (at(b) - at(a)) * ((times[f] - times[f - 1]) / (times[f - 1] - times[f - 2]))
                    reach = step * (times[f] - times[f - 1])
                    for c in sorted(free[2], key=lambda i: math.dist(at(i), ahead))[:4]:
                        if math.dist(at(b), at(c)) <= reach and along(c, at(b)) and math.dist(at(c), ahead) <= max(4, 0.35 * reach):
                            options.append((math.dist(at(c), ahead), a, b, c))
                            break
            for _, a, b, c in sorted(options):
                if not {a, b, c} & used:
                    used |= {a, b, c}
                    tracks.append({"pts": [a, b, c], "from": 0, "trial": 0, "ok": False, "jump": True, "state": "open"})
    for tr in tracks:
        if tr["state"] == "open" and not tr["ok"]:
            del tr["pts"][tr["trial"] :]
    return [tr["pts"] for tr in tracks if tr["pts"]]


def clip(seed, fps=60.0, clutter=2):
    """Two balls that bounce, with gaps and clutter."""
    r = random.Random(seed)
    rows, frames = [], 90
    for b in range(2):
        x, y, vx, vy = 300 + 500 * b, 500.0, r.uniform(200, 500), r.uniform(-400, -200)
        for f in range(frames):
            t = f / fps
            if r.random() < 0.9 and not 40 <= f < 44:
                rows.append((f, x + vx * t + r.gauss(0, 0.4), y + vy * t + 500 * (t % 0.5) ** 2 - 100 * (t > 0.5) + r.gauss(0, 0.4), 5.0, 6.0, 0.0))
    for f in range(frames):
        for _ in range(r.randrange(2 * clutter + 1)):
            rows.append((f, r.uniform(200, 1500), r.uniform(250, 900), 4.0, r.choice([4.0, 12.0]), r.uniform(0, 180)))
    return np.arange(frames) / fps, sorted(rows)


@pytest.mark.parametrize(("seed", "fps"), [(1, 60.0), (2, 60.0), (3, 30.0), (4, 30.0)])
def test_tracks_against_a_slow_tracker(seed, fps):
    times, rows = clip(seed, fps)
    row = camera_row()
    columns = {c: np.array([x[k] for x in rows], float) for k, c in ((1, "x"), (2, "y"), (3, "minor"), (4, "major"), (5, "orientation_deg"))}
    linker = flights.Linker(times, np.array([x[0] for x in rows]), columns, flights.Scale(row[0], row[2:5], row[5]))
    linker.run()
    got = [t.points for t in linker.tracks if t.points]
    assert got == slow_link(times, rows, row) and max(map(len, got)) > 20
    assert len({c for t in got for c in t}) == sum(map(len, got))  # no candidate twice


def linker_of(times, rows, row):
    columns = {c: np.array([x[k] for x in rows], float) for k, c in ((1, "x"), (2, "y"), (3, "minor"), (4, "major"), (5, "orientation_deg"))}
    return flights.Linker(times, np.array([x[0] for x in rows]), columns, flights.Scale(row[0], row[2:5], row[5]))


def test_few_candidates_cost_no_calls_for_arrays(monkeypatch):
    times, rows = clip(8, clutter=1)
    monkeypatch.setattr(flights, "FEW", 0)
    arrays = linker_of(times, rows, camera_row())
    want = arrays.flights()
    monkeypatch.undo()
    calls = []
    for name in ("solve", "lstsq", "pinv", "svd"):
        monkeypatch.setattr(np.linalg, name, lambda *a, _f=getattr(np.linalg, name), **k: (calls.append(1), _f(*a, **k))[1])
    one_by_one = linker_of(times, rows, camera_row())
    one_by_one.run()
    assert not calls and [t.points for t in one_by_one.tracks] == [t.points for t in arrays.tracks]
    assert linker_of(times, rows, camera_row()).flights() == want and want


def test_link_on_tables(spark):
    times, rows = clip(5)
    row = camera_row()
    cands = [(1, f, x, y, a, b, o, 0.9, 1.0, "z") for f, x, y, a, b, o in rows]
    cands += [(1, 3, None, 5.0, 1.0, 1.0, 0.0, 1.0, 1.0, "z"), (1, 9999, 5.0, 5.0, 1.0, 1.0, 0.0, 1.0, 1.0, "z"), (1, None, 5.0, 5.0, 1.0, 1.0, 0.0, 1.0, 1.0, "z"), (7, 0, 5.0, 5.0, 1.0, 1.0, 0.0, 1.0, 1.0, "z"), (1, 5, float("nan"), 5.0, 1.0, 1.0, 0.0, 1.0, 1.0, "z")]
    c = spark.createDataFrame(cands, "k int, frame int, x double, y double, minor double, major double, orientation_deg double, colour_score double, contrast double, time_s string")
    f = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate(times)] + [(1, 200, 0.1), (1, 5, float(times[5])), (1, None, 0.2), (2, 0, 0.0), (7, 0, None)], "k int, frame int, time_s double")
    m = spark.createDataFrame([(1, *row), (2, *row), (3, *row)], MAP)
    got = flights.link(c.drop("time_s"), f, m, "k").orderBy("flight_id", "frame").collect()
    assert {r.k for r in got} == {1} and len({r.flight_id for r in got}) >= 2
    for i in {r.flight_id for r in got}:
        own = [r for r in got if r.flight_id == i]
        assert [r.frame for r in own] == list(range(own[0].frame, own[-1].frame + 1)) and own[0].detected and own[-1].detected
        assert own[0].confidence == pytest.approx(sum(r.detected for r in own) / len(own)) and all((r.x is None) != r.detected for r in own)
    assert flights.link(c.drop("time_s").limit(0), f, m, "k").count() == 0 and flights.link(c.drop("time_s"), f, m.limit(0), "k").count() == 0


def test_linking_time_grows_with_the_candidates():
    import time

    row, took = camera_row(), []
    for clutter in (20, 80):
        times, rows = clip(6, clutter=clutter)
        columns = {c: np.array([x[k] for x in rows], float) for k, c in ((1, "x"), (2, "y"), (3, "minor"), (4, "major"), (5, "orientation_deg"))}
        began = time.process_time()
        flights.Linker(times, np.array([x[0] for x in rows]), columns, flights.Scale(row[0], row[2:5], row[5])).flights()
        took.append(time.process_time() - began)
    assert took[1] < 60


def slow_breaks(t, xy):
    """(time, ratio, u, v, velocities) of the breaks of one flight, every fit by itself."""

    def side(a, b):
        c = [poly(t[a:b], xy[a:b, k], 1 if b - a <= 3 else 2) for k in (0, 1)]
        return c, sum(((c[k](t[a:b]) - xy[a:b, k]) ** 2).sum() for k in (0, 1))

    def window(k, low, high):
        before = [j for j in range(low, k + 1) if t[k] - t[j] <= 0.15 + 1e-9][-8:]
        after = [j for j in range(k + 1, high) if t[j] - t[k + 1] <= 0.15 + 1e-9][:8]
        return before, after

    def judge(k, low, high):
        b, a = window(k, low, high)
        if min(len(b), len(a)) < 2 or max(len(b), len(a)) < 3 or len(a) + len(b) < 6:
            return None
        lo, hi = b[0], a[-1] + 1
        one = min(quad_rms(t[lo:hi], xy[lo:hi], 2) ** 2 * (hi - lo), thrown_squares(t[lo:hi], xy[lo:hi], False))
        if math.sqrt(one / (hi - lo)) < 1:
            return None
        return (side(lo, k + 1)[1] + side(k + 1, hi)[1]) / one, lo, hi

    found = sorted((x[0], k) for k in range(len(t) - 1) if (x := judge(k, 0, len(t))) and x[0] <= 0.5)
    chosen = {}
    for _, k in found:
        if any(abs(k - c) < 3 for c in chosen):
            continue
        low, high = max((c + 1 for c in chosen if c < k), default=0), min((c + 1 for c in chosen if c > k), default=len(t))
        x = judge(k, low, high)
        if not x or x[0] > 0.5:
            continue
        lo, hi = x[1:]
        best = min((side(lo, c)[1] + side(c, hi)[1], c - 1) for c in range(lo + 2, hi - 1))[1]
        if best != k and (y := judge(best, low, high)) and y[0] <= 0.5:
            k, x = best, y
        if not any(abs(k - c) < 3 for c in chosen):
            chosen[k] = x
    out, step = [], float(np.median(np.diff(t)))
    for k, (ratio, lo, hi) in sorted(chosen.items()):
        b, a = side(lo, k + 1)[0], side(k + 1, hi)[0]
        grid = np.linspace(t[k] - step, t[k + 1] + step, 41)
        d = (b[1].convert() - a[1].convert())
        roots = [r.real for r in d.roots() if abs(r.imag) < 1e-9 and grid[0] <= r.real <= grid[-1]]
        when = min(roots, key=lambda r: abs(r - (t[k] + t[k + 1]) / 2)) if roots else grid[np.argmin([sum((b[c](g) - a[c](g)) ** 2 for c in (0, 1)) for g in grid])]
        out.append((when, ratio, *((b[c](when) + a[c](when)) / 2 for c in (0, 1)), *(b[c].deriv()(when) for c in (0, 1)), *(a[c].deriv()(when) for c in (0, 1))))
    return out


def test_breaks_against_slow_fits(spark):
    r = np.random.default_rng(4)
    rows, want = [], {}
    for k in range(8):
        n = [0, 5, 30, 60, 99, 40, 80, 12][k]
        t = np.cumsum(r.uniform(0.01, 0.03, n))
        x = np.cumsum(r.choice([-15.0, 4.0, 15.0], n)) + (r.normal(0, 30, n) if k % 2 else 0)
        xy = np.column_stack([x, r.normal(0, 5 if k < 6 else 0.3, n) + 200 * np.abs(np.sin(3 * t))]) if n else np.zeros((0, 2))
        rows += [(k, float(a), float(b), float(c)) for a, (b, c) in zip(t, xy)]
        if n:
            want[k] = slow_breaks(t, xy)
    got = {}
    for x in ballevents.break_points(spark.createDataFrame(rows, "k int, t double, x double, y double"), "k", "t").orderBy("k", "time_s").collect():
        got.setdefault(x.k, []).append((x.time_s, x.ratio, x.u, x.v, x.vbx, x.vby, x.vax, x.vay))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items() if v} and sum(map(len, want.values())) > 8
    for k, v in got.items():
        assert np.allclose(v, sorted(want[k]), rtol=1e-5, atol=1e-5)


def test_breaks_with_repeated_times_and_nulls(spark):
    t = np.arange(40) / 60
    y = np.where(t < 0.3, 900 * t, 270 - 700 * (t - 0.3))
    rows = [(1, float(a), float(400 * a), float(b)) for a, b in zip(t, y)]
    odd = [(1, float(t[5]), 9e9, 1.0), (1, float(t[7]), None, 1.0), (1, float(t[9]), float("nan"), 1.0), (1, None, 1.0, 1.0), (None, 0.1, 1.0, 1.0)]
    odd += [(2, 0.1 * (i // 2), float(i // 2), float(i)) for i in range(14)] + [(3, 1.0, float(i), 0.0) for i in range(14)] + [(4, float(i if i < 11 else 11) / 60, float(i), float(i % 5)) for i in range(14)]
    schema = "k int, t double, x double, y double"
    plain = ballevents.break_points(spark.createDataFrame(rows, schema), "k", "t").collect()
    got = ballevents.break_points(spark.createDataFrame(rows + odd, schema).repartition(3), "k", "t").where("k = 1").collect()
    assert len(plain) == 1 and got == plain and abs(plain[0].time_s - 0.3) < 1e-6 and plain[0].vby == pytest.approx(900) and plain[0].vay == pytest.approx(-700)
    assert ballevents.break_points(spark.createDataFrame(rows + odd, schema), "k", "t").count() >= 1
    assert ballevents.break_points(spark.createDataFrame([], schema), "k", "t").count() == 0
    ok = ball.accepted(spark.createDataFrame(rows + odd, schema).where("k = 1 and (t < 0.25 or t is null) and (x < 1e6 or x is null)"), "k", "t").first()
    assert ok.accepted and ok.n == 15


def test_gates_against_sampled_velocities():
    """Whatever physical velocities give is accepted; where none of very many samples comes near, it is refused."""
    rng = np.random.default_rng(2)
    row = camera_row()
    camera = Camera(row[0], row[1], row[2:5], row[5])
    seen = {True: 0, False: 0}
    for _ in range(40):
        place = np.array([[rng.uniform(-6, 6), rng.uniform(-13, 13), 0.0]])
        j, scale = camera.jacobian(place), camera.scale_of(*camera.project(place).T)
        g, fall, keep, back = rng.uniform(-15, 15, 2), -rng.uniform(0.5, 14), rng.choice(ballevents.KEEPS), rng.uniform(0.5, 0.9)
        g[1] = abs(g[1]) * (1 if place[0, 1] >= 0 else -1)
        if -back * fall < 0.5:
            continue
        before, after = j[0] @ [*g, fall], j[0] @ [*(keep * g), -back * fall]
        assert can_bounce(j, before[None], after[None], scale, place[:, 1])[0]
        before, after = rng.normal(0, 400, 2), rng.normal(0, 400, 2)
        got = bool(can_bounce(j, before[None], after[None], scale, place[:, 1])[0])
        n = 400_000
        gx, gy, vz = rng.uniform(-50, 50, n), rng.uniform(0, 50, n) * (1 if place[0, 1] >= 0 else -1), -rng.uniform(0.5, 15, n)
        up, keep = -vz * rng.uniform(0, 0.9, n), rng.choice(ballevents.KEEPS, n)
        off = [np.abs(j[0] @ np.stack(v) - w[:, None]) - (0.15 * np.hypot(*w) + 0.5 * scale) for v, w in (((gx, gy, vz), before), ((keep * gx, keep * gy, up), after))]
        met = bool(((np.concatenate(off) <= 0).all(axis=0) & (up >= 0.5)).any())
        near = bool(((np.concatenate(off) <= 20).all(axis=0) & (up >= 0.4)).any())
        assert got or not met
        assert near or not got
        seen[got] += 1
    assert min(seen.values()) >= 3
    at = camera.net_points(camera.project(np.array([[1.0, 0.0, 0.5]])))
    assert np.allclose(at, [[1.0, 0.0, 0.5]]) and np.isnan(camera.net_points(camera.project(np.array([[1.0, 0.0, 2.5]])))).all()
    j, scale = camera.jacobian(at), camera.focal / np.linalg.norm(at - camera.cam, axis=1)
    assert can_touch_net(j, (j[0] @ [1.0, 20.0, 2.0])[None], (j[0] @ [0.5, -2.0, -3.0])[None], scale)[0]
    assert not can_touch_net(j, (j[0] @ [30.0, 20.0, 2.0])[None], (j[0] @ [-40.0, 20.0, 25.0])[None] * 5, scale)[0]


def test_jacobian_and_ground_against_differences():
    row = camera_row(1300.0, (1.5, -20.0, 8.0))
    camera = Camera(row[0], row[1], row[2:5], row[5])
    at = np.array([[1.0, 3.0, 0.7], [-4.0, -9.0, 0.0]])
    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        assert np.allclose(camera.jacobian(at)[:, :, k], (camera.project(at + step) - camera.project(at - step)) / 2e-5, rtol=1e-5)
    assert np.allclose(camera.ground(camera.project(np.array([[2.0, 5.0, 0.0]]))), [[2.0, 5.0]])
    assert np.isnan(camera.ground(np.array([[960.0, -5000.0]]))).all() and camera.scale(np.array([[960.0, -5000.0]]))[0] == camera.far_scale


def test_events_of_a_session(spark):
    """A ball that is hit, bounces on the far court and is hit back, seen by a camera."""
    row = camera_row()
    camera = Camera(row[0], row[1], row[2:5], row[5])
    t, p, v, path = 0.0, np.array([0.5, -10.0, 1.0]), np.array([0.8, 22.0, 3.2]), []
    bounced = None
    while t < 1.6:
        path.append((t, p.copy()))
        v = v + [0, 0, -9.81 / 60]
        p = p + v / 60
        t += 1 / 60
        if p[2] < 0 and bounced is None:
            bounced, p[2], v = t, 0.0, v * [0.75, 0.75, -0.75]
        if bounced and t > bounced + 0.4 and v[1] > 0:
            v = np.array([-8.0, -20.0, 8.0])
    uv = camera.project(np.array([x for _, x in path]))
    rows = [(1, 0, s, *map(float, q)) for (s, _), q in zip(path, uv)] + [(1, 0, 0.505, None, None)]
    f = spark.createDataFrame(rows, "k int, flight_id int, time_s double, x double, y double")
    hits = spark.createDataFrame([(1, 0.01, float(uv[0][0]), float(uv[0][1]), "near", 0.8, "serve", 1.0, 2.0), (1, None, None, None, None, None, None, None, None), (2, 0.1, None, None, None, 0.5, None, None, None)], "k int, time_s double, wrist_u double, wrist_v double, end string, confidence double, shot_type string, feet_u double, feet_v double")
    got = ballevents.detect(f, spark.createDataFrame([(1, *row), (2, *row)], MAP), hits, "k").orderBy("time_s").collect()
    assert [x.kind for x in got] == ["hit", "bounce", "hit"] and [x.event_id for x in got] == ["h_000000", "b_000001", "h_000002"]
    assert got[0].flags == ["flight_start", "pose_hit"] and got[0].end == "near" and got[0].shot_type == "serve" and abs(got[1].time_s - bounced) < 0.02
    assert got[2].end == "far"
    assert ballevents.detect(f.limit(0), spark.createDataFrame([(1, *row)], MAP), hits, "k").count() == 0


def test_sessions_are_fitted_together(monkeypatch):
    r, sessions = np.random.default_rng(4), []
    for k in range(12):
        t = np.arange(60 + k) / 30
        zigzag = np.abs((t * 5) % 2 - 1)
        sessions.append({0: np.column_stack([t, 500 + 300 * zigzag + r.normal(0, 0.3, len(t)), 400 + 200 * np.abs((t * 3) % 2 - 1)]), 3: np.column_stack([t, 900 + 90 * t, 300 + 200 * t * t])})
    calls = []
    share = ballevents.Breaks.share
    monkeypatch.setattr(ballevents.Breaks, "share", lambda *a: (calls.append(1), share(*a))[1])
    each = [ballevents._breaks([s])[0] for s in sessions]
    alone, calls[:] = len(calls), []
    together = ballevents._breaks(sessions)
    assert len(calls) < alone / 4 and sum(len(f) for f, _ in each) > 24
    for (f, found), (g, other) in zip(each, together, strict=True):
        assert f.tolist() == g.tolist() and all(np.allclose(found[c], other[c], rtol=1e-9, atol=1e-9) for c in found)


def test_labels_follow_the_order_of_play():
    e = lambda kind, conf, *flags: {"kind": kind, "confidence": conf, "flags": list(flags), "end": None}
    play = [e("hit", 0.9), e("hit", 0.2), e("hit", 0.9, "pose_hit"), e("bounce", 0.9), e("bounce", 0.25, "weak_bounce"), e("bounce", 0.9)]
    got = ballevents.relabel(play, ["near", "far", "near", "far", "far", "far"])
    assert [x["kind"] for x in got] == ["hit", "bounce", "hit", "bounce", "hit", "bounce"]
    assert got[1]["flags"] == ["grammar_relabelled", "weak_bounce"] and got[4]["flags"] == ["grammar_relabelled"]
    kept = [e("hit", 0.6), e("hit", 0.6)]
    assert [x["kind"] for x in ballevents.relabel(kept, [None, None])] == ["hit", "hit"] and ballevents.relabel([], []) == []
