"""Swings of a session against a slow reading, and a whole session of planted swings."""

import math
import random
import statistics

import numpy as np

from motionlake.operators import pose, sessions
from motionlake.operators.sessions import Signal


def line(at, x):
    """Values at all places on lines between the known ones, held at the ends."""
    out = []
    for k in range(len(x)):
        a, b = [j for j in at if j <= k], [j for j in at if j >= k]
        if not a or not b:
            out.append(x[b[0]] if b else x[a[-1]])
        else:
            out.append(x[a[-1]] if a[-1] == b[0] else x[a[-1]] + (x[b[0]] - x[a[-1]]) * (k - a[-1]) / (b[0] - a[-1]))
    return out


def slow(t, wrist, hips, torso, valid, seen, apart):
    """(stretches, speed, reliable, candidates) frame by frame."""
    n = len(t)
    scale = []
    for k in range(n):
        near = [torso[j] for j in range(n) if valid[j] and torso[j] > 0 and abs(t[j] - t[k]) <= 5.0]
        scale.append(statistics.median(near) if near else 0.0)
    known = [k for k in range(n) if scale[k] > 0]
    scale = line(known, scale) if known else scale
    parts, start, last = [], None, None
    for k in range(n):
        if not valid[k]:
            continue
        if start is None:
            start = k
        elif k - last - 1 > 3 or scale[k] > 0 and (math.dist(hips[k], hips[last]) / scale[k] > 0.25 or torso[last] > 0 and abs(torso[k] - torso[last]) / torso[last] > 0.35):
            parts.append((start, last + 1))
            start = k
        last = k
    if start is not None:
        parts.append((start, last + 1))
    speed, rel = [0.0] * n, [False] * n
    for a, b in parts:
        m = b - a
        ok = [k for k in range(m) if valid[a + k]]
        vis = [k for k in range(m) if seen[a + k]]
        track = []
        for c in (0, 1):
            w, h = line(ok, [wrist[a + k][c] for k in range(m)]), line(ok, [hips[a + k][c] for k in range(m)])
            w = line(vis, w) if vis else w
            v = [(w[k] - h[k]) / (scale[a + k] or 1.0) for k in range(m)]
            if m >= 5:
                fits = []
                for k in range(m):
                    at = min(max(k, 2), m - 3)
                    fits.append(float(np.polyval(np.polyfit(range(-2, 3), v[at - 2 : at + 3], 2), k - at)))
                v = fits
            track.append([(v[min(k + 1, m - 1)] - v[max(k - 1, 0)]) / ((t[a + min(k + 1, m - 1)] - t[a + max(k - 1, 0)]) or math.inf) for k in range(m)])
        for k in range(m):
            speed[a + k] = math.hypot(track[0][k], track[1][k])
            rel[a + k] = bool(seen[a + k] and seen[a + max(k - 1, 0)] and seen[a + min(k + 1, m - 1)] and valid[a + k])
    return parts, speed, rel


def slow_candidates(t, parts, speed, rel, apart):
    peaks = []
    for i, (a, b) in enumerate(parts):
        if b - a < 3:
            continue
        usable = any(rel[a:b])
        top = [k for k in range(a, b) if (rel[k] or not usable) and (k == a or speed[k] >= speed[k - 1]) and (k == b - 1 or speed[k] >= speed[k + 1])]
        chosen = []
        for k in sorted(top, key=lambda k: (-speed[k], k)):
            if all(abs(k - c) >= apart for c in chosen):
                chosen.append(k)
        if not chosen:
            chosen = [max((k for k in range(a, b) if rel[k] or not usable), key=lambda k: (speed[k], -k))]
        peaks += [(k, i) for k in sorted(chosen) if speed[k] >= 3.0]
    sure = [speed[k] for k, _ in peaks if rel[k]]
    least = 0.35 * float(np.percentile(sure, 90)) if sure else 0.0
    out = []
    for j, (k, i) in enumerate(peaks):
        a, b = parts[i]
        left = peaks[j - 1][0] if j and peaks[j - 1][1] == i else a
        right = peaks[j + 1][0] if j + 1 < len(peaks) and peaks[j + 1][1] == i else b - 1
        valley = max(min(speed[left : k + 1]), min(speed[k : right + 1]))
        out.append([k, i, "wrist_unobserved" if not rel[k] else "below_relative_floor" if speed[k] < least else "not_prominent" if valley > 1e-9 and speed[k] / valley < 2 else None])
    good = [c for c in out if c[2] is None]
    cuts = []
    for p, q in zip(good, good[1:]):
        if p[1] != q[1]:
            cuts.append(None)
            continue
        room = [k for k in range(p[0] + 1, q[0]) if any(t[j] >= t[p[0]] + 0.2 - 1e-6 for j in range(k)) and t[k] <= t[q[0]] - 0.5 + 1e-6]
        room = room or list(range(p[0] + 1, q[0]))
        cuts.append(min(room, key=lambda k: (speed[k], k)) if room else q[0])
    result = {c[0]: (c[2], None, None) for c in out}
    for j, (k, i, _) in enumerate(good):
        inside = [f for f in range(*parts[i]) if t[k] - 2 - 1e-6 <= t[f] <= t[k] + 1 + 1e-6 and (not j or cuts[j - 1] is None or f >= cuts[j - 1]) and (j >= len(cuts) or cuts[j] is None or f < cuts[j])]
        short = not inside or inside[-1] < k or t[k] - t[inside[0]] < 0.5 - 1e-6 or t[inside[-1]] - t[k] < 0.2 - 1e-6
        result[k] = ("window_too_short" if short else None, inside[0], inside[-1] + 1)
    return result


def test_peaks_and_windows_against_a_slow_reading():
    r = random.Random(5)
    reasons, windows, several = set(), 0, 0
    for _ in range(60):
        n = r.choice([2, 30, 120, 240])
        t = np.arange(n) / 32  # exact in binary: some frames are 5 s apart to the last bit
        x, hips = 0.0, [0.0, 0.0]
        wrist, hip, torso, valid, seen = [], [], [], [], []
        on, body = True, 1.0
        for _ in range(n):
            x += r.choice([0.0, 0.02, -0.02, 0.3, -0.3]) if r.random() < 0.5 else 0.0
            if r.random() < 0.01:
                hips = [hips[0] + 1.0, hips[1]]
            if r.random() < 0.005:
                body = r.choice([1.0, 1.6])
            on = on if r.random() < 0.95 else not on
            wrist.append((x + r.gauss(0, 0.004), r.gauss(0, 0.004)))
            hip.append(tuple(hips))
            torso.append(body if r.random() < 0.98 else 0.0)
            valid.append(on or r.random() < 0.3)
            seen.append(r.random() < 0.95)
        args = (t, np.array(wrist), np.array(hip), np.array(torso), np.array(valid), np.array(seen))
        s = Signal(*args)
        parts, speed, rel = slow(t.tolist(), wrist, hip, torso, valid, seen, 18)
        assert s.stretches == parts and np.allclose(s.speed, speed, atol=1e-9) and s.reliable.tolist() == rel
        found = s.candidates(18)
        s.windows(found)
        got = {c["peak"]: (c["rejection"], c.get("start"), c.get("end")) for c in found}
        want = slow_candidates(t.tolist(), parts, s.speed.tolist(), rel, 18)
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(got[k] == v for k, v in want.items() if v[0] is None)
        reasons |= {v[0] for v in want.values()}
        windows += sum(v[0] is None for v in want.values())
        several += len(parts) > 1
        spans = sorted((v[1], v[2]) for v in got.values() if v[0] is None)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert windows > 20 and several > 10 and {None, "not_prominent", "window_too_short"} <= reasons


LM = "array<struct<x: double, y: double, z: double, visibility: double>>"


def swinging(seed, peaks, n=240, lost=()):
    """A body whose right wrist swings forwards at each peak."""
    r = random.Random(seed)
    rows = []
    for f in range(n):
        body = [(0.5 + r.gauss(0, 5e-5), 0.5 + r.gauss(0, 5e-5), 0.0, 0.9)] * 33
        for k, (dx, dy) in {11: (-0.05, -0.2), 12: (0.05, -0.2), 23: (-0.04, 0.0), 24: (0.04, 0.0), 15: (-0.08, 0.0)}.items():
            body[k] = (0.5 + dx + r.gauss(0, 5e-5), 0.5 + dy + r.gauss(0, 5e-5), 0.0, 0.9)
        reach = sum(0.25 * math.tanh((f - p) / 3.0) * math.exp(-(((f - p) / 12.0) ** 2)) for p in peaks)
        body[16] = (0.62 + reach + r.gauss(0, 5e-5), 0.5 - 0.4 * abs(reach) + r.gauss(0, 5e-5), 0.0, 0.9)
        gone = any(a <= f < b for a, b in lost)
        rows.append((seed, f, f / 30.0, not gone, 720, 720, body))
    return rows


def test_a_whole_session(spark):
    rows = swinging(1, [70, 160]) + swinging(2, [100], lost=[(90, 99)]) + swinging(3, []) + swinging(4, [40])
    fr = pose.frames(spark.createDataFrame(rows, f"seq_id int, frame int, ts_s double, detected boolean, width_px int, height_px int, landmarks {LM}"))
    hands = spark.createDataFrame([(1, "right"), (2, "right"), (3, "right"), (4, None)], "seq_id int, hand string")
    got = sessions.segment_session(fr, hands).orderBy("seq_id", "peak").collect()
    one = [x for x in got if x.seq_id == 1 and x.status != "rejected"]
    assert len(one) == 2 and [abs(x.peak - p) <= 3 for x, p in zip(one, (70, 160))] == [True, True]
    for x in one:
        assert abs(x.contact_s - x.peak_s) < 0.25 and x.start < x.contact_frame < x.end and x.direction == 1 and x.confidence >= 0.35 and x.rejection is None
    assert {x.seq_id for x in got} <= {1, 2} and all(x.rejection for x in got if x.seq_id == 2)
    assert sessions.segment_session(fr.limit(0), hands).count() == 0
