"""Normalised marks, core windows and contacts against slow readings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.operators import contacts, normalized, pose
from motionlake.operators.contacts import Swing

LM = "array<struct<x: double, y: double, z: double, visibility: double>>"


def sequence(seed, n, gaps=(), fps=30.0):
    r = random.Random(seed)
    rows = []
    for f in range(n):
        lost = any(a <= f < b for a, b in gaps)
        body = [(0.4 + 0.01 * k + 0.05 * math.sin(f / 5 + k) + r.gauss(0, 0.002), 0.3 + 0.02 * k + 0.05 * math.cos(f / 7 + k), 0.0, 0.1 if lost else 0.9) for k in range(33)]
        rows.append((seed, f, f / fps, not (lost and r.random() < 0.5), 640, 480, body))
    return rows


def frames(spark, rows):
    return pose.frames(spark.createDataFrame(rows, f"seq_id int, frame int, ts_s double, detected boolean, width_px int, height_px int, landmarks {LM}"))


def slow_normal(rows):
    """x, y and both derivatives of every landmark, a sequence at a time."""
    p = np.array([[(b[0] * 640 / 480, -b[1]) for b in r[6]] for r in rows])
    t, valid = np.array([r[2] for r in rows]), np.array([r[3] and np.mean([r[6][k][3] for k in pose.CORE]) >= 0.5 for r in rows])
    torso = np.linalg.norm((p[:, 11] + p[:, 12]) / 2 - (p[:, 23] + p[:, 24]) / 2, axis=1)
    scale = np.median(torso[valid & (torso > 0)]) if (valid & (torso > 0)).any() else np.median(torso[torso > 0])
    good = np.flatnonzero(valid)
    filled = p.copy()
    for f in range(len(p)):
        if valid[f] or not len(good):
            continue
        a, b = good[good < f], good[good > f]
        if not len(a) or not len(b):
            filled[f] = p[a[-1]] if len(a) else p[b[0]]
        else:
            a, b = a[-1], b[0]
            share = (f - a) / (b - a)
            filled[f] = p[a] + share * (p[b] - p[a]) if b - a - 1 <= 3 else p[a] if f - a <= (b - a - 1) // 2 else p[b]
    body = (filled - ((filled[:, 23] + filled[:, 24]) / 2)[:, None]) / scale
    out = body.copy()
    if len(p) >= 5:
        for f in range(len(p)):
            at = min(max(f, 2), len(p) - 3)
            basis = np.vander(np.arange(-2, 3), 3)
            c = np.linalg.lstsq(basis, body[at - 2 : at + 3].reshape(5, -1), rcond=None)[0]
            out[f] = (np.array([(f - at) ** 2, f - at, 1]) @ c).reshape(33, 2)

    def slope(v):
        return np.array([(v[min(f + 1, len(v) - 1)] - v[max(f - 1, 0)]) / ((t[min(f + 1, len(v) - 1)] - t[max(f - 1, 0)]) or math.inf) for f in range(len(v))])

    return out, slope(out), slope(slope(out)), valid


def test_normalised_marks_against_a_slow_reading(spark):
    clips = {1: sequence(1, 40, [(5, 7), (15, 20), (30, 33)]), 2: sequence(2, 4), 3: sequence(3, 12, [(0, 2), (9, 12)]), 4: sequence(4, 8, [(0, 8)]), 5: sequence(5, 1)}
    fr = frames(spark, [r for rows in clips.values() for r in rows])
    got = {(r.seq_id, r.landmark, r.frame): r for r in normalized.normalized(fr).collect()}
    assert len(got) == 33 * sum(map(len, clips.values()))
    marks = {(r.seq_id, r.frame): r.marks for r in normalized.marks_of(normalized.normalized(fr)).collect()}
    ways = {r.seq_id: r.direction for r in normalized.swing_direction(normalized.normalized(fr)).collect()}
    for i, rows in clips.items():
        x, v, a, valid = slow_normal(rows)
        for f in range(len(rows)):
            for k in (0, 11, 15, 28):
                g = got[i, k, f]
                assert np.allclose([g.x, g.y, g.vx, g.vy, g.ax, g.ay], [*x[f, k], *v[f, k], *a[f, k]], atol=1e-7), (i, f, k)
                assert marks[i, f][k].x == g.x and marks[i, f][k].seen == (rows[f][6][k][3] >= 0.5)
        path = {k: np.linalg.norm(np.diff(x[:, k], axis=0), axis=1).sum() for k in (15, 16)}
        k = 16 if path[16] >= path[15] else 15
        speed = np.linalg.norm(v[:, k], axis=1)
        peak = int(np.argmax(speed))
        assert ways[i] == (1 if x[peak, k, 0] - x[int(np.argmin(speed[: peak + 1])), k, 0] >= 0 else -1)


def slow_core(t, valid, reach):
    n = len(t)

    def span(anchor):
        low, high = t[anchor] - 1.0, t[anchor] + 1.0
        if low < t[0]:
            low, high = t[0], min(t[-1], t[0] + 2.0)
        if high > t[-1]:
            low, high = max(t[0], t[-1] - 2.0), t[-1]
        a = min(sum(x < low for x in t), n - 1)
        return a, max(a + 1, n if high >= t[-1] else sum(x < high for x in t))

    best, run = (0, 0), 0
    for f in range(n):
        run = run + 1 if valid[f] else 0
        if run > best[1] - best[0]:
            best = f - run + 1, f + 1
    if best == (0, 0):
        return span(n // 2)
    anchor = (best[0] + best[1] - 1) // 2
    a, b = span(anchor)
    if best[1] - best[0] > b - a:
        anchor = max(range(*best), key=lambda f: (reach[f], -f))
    share = lambda s: sum(valid[s[0] : s[1]]) / (s[1] - s[0])
    found, key = span(anchor), (share(span(anchor)), 0.0)
    for f in range(n):
        if abs(t[f] - t[anchor]) <= 0.5 and (share(span(f)), -abs(t[f] - t[anchor])) > key:
            found, key = span(f), (share(span(f)), -abs(t[f] - t[anchor]))
    return found


def test_core_windows_against_a_slow_search():
    r = random.Random(7)
    for _ in range(300):
        n = r.choice([1, 2, 20, 70, 150])
        step = r.choice([1 / 32, 1 / 16])
        t = np.array([f * step for f in range(n)])
        state, valid = True, []
        for _ in range(n):
            state = state if r.random() < 0.9 else not state
            valid.append(state)
        reach = np.array([r.choice([0.5, 1.0, 2.0]) for _ in range(n)])
        assert normalized.place_core(t, np.array(valid), reach) == slow_core(t, valid, reach)


def test_quality(spark):
    fr = frames(spark, sequence(1, 40, [(5, 7), (15, 18)]) + sequence(2, 90, [(0, 12), (40, 42)]) + sequence(3, 30, [(10, 16)]) + sequence(4, 10, [(0, 10)]))
    got = {r.seq_id: r for r in normalized.core_quality(fr).collect()}
    assert got[1].usable is False and got[1].interpolated == 5 and got[1].core_gap == 3  # 35 of 40 frames are too few
    assert got[2].usable and "dead_time_outside_core" in got[2].flags and got[2].longest_gap == 12 and got[2].interpolated == 2 and got[2].start_s > 0.3
    assert not got[3].usable and got[3].interpolated == 0 and got[3].core_gap == 6
    assert not got[4].usable and got[4].frames_with_pose == 0 and got[4].mean_visibility == 0 and got[4].coverage == 0
    assert normalized.core_quality(fr.limit(0)).count() == 0


def slow_contact(t, x, speed, reach, wrist, shoulder, way, unstable):
    """frame, peak, prominence, confidence, flags, tried, frame after frame."""
    n = len(t)
    rel = [wrist[i] and wrist[max(i - 1, 0)] and wrist[min(i + 1, n - 1)] for i in range(n)]
    fastest = lambda: max((i for i in range(n) if rel[i] or not any(rel)), key=lambda i: (speed[i], -i))
    peak = fastest()
    start = 0
    for i in range(1, peak):
        if way * x[i] <= way * x[i - 1] and way * x[i] < way * x[i + 1]:
            start = i
    arm = [i for i in range(n) if wrist[i] and shoulder[i]]
    low, high = (min(reach[i] for i in arm), max(reach[i] for i in arm)) if arm else (0.0, 0.0)
    ext = lambda i: 0.0 if i not in arm else 1.0 if high <= low else (reach[i] - low) / (high - low)
    top = lambda i: speed[i] >= (speed[i - 1] if i else -1) and speed[i] >= (speed[i + 1] if i < n - 1 else -1)
    usable = any(rel[start:])
    peaks = []
    for i in sorted((i for i in range(start, n) if (rel[i] or not usable) and top(i)), key=lambda i: (-speed[i], i)):
        if len(peaks) < 5 and all(abs(i - p) >= 5 for p in peaks):
            peaks.append(i)
    tried, won = [], None
    for p in peaks or [fastest()]:
        first = max(p, start)
        run = 0
        while run < 4 and first + 1 + run < n and speed[first + 1 + run] >= 0.45 * speed[p]:
            run += 1
        at = n - 1 if first + 1 + run >= n else first + run if run >= 2 else first
        if any(a == at for a, _ in tried):
            continue
        near = [min(max(at + d, 0), n - 1) for d in (-1, 0, 1)]
        why = (["wrist_behind_mid_hip"] if all(way * x[i] <= 0 for i in near) else []) + (["arm_not_extended"] if high - low >= 0.15 and all(ext(i) < 0.6 for i in near) else [])
        tried.append((at, why))
        if not why:
            won, peak = at, p
            break
    ok = [i for i in range(n) if (rel[i] or not any(rel)) and top(i) and abs(i - peak) >= 5]
    second = max((speed[i] for i in ok), default=0)
    prom = 0.0 if speed[peak] <= 0 else min(speed[peak] / second, 10.0) if second > 0 else 10.0
    if won is None:
        return None, peak, prom, 0.0, ["contact_not_found"], tried
    flags = []
    if way * x[won] <= 0:
        flags.append("wrist_behind_mid_hip")
    if ext(won) < 0.6:
        flags.append("arm_not_extended")
    if won < 4 or won > n - 5:
        flags.append("contact_near_clip_end")
    if unstable:
        flags.append("subject_identity_unstable")
    moving = [rel[i] and speed[i] >= 0.5 * speed[peak] for i in range(n)]
    a = b = peak
    while moving[peak] and a > 0 and moving[a - 1]:
        a -= 1
    while moving[peak] and b < n - 1 and moving[b + 1]:
        b += 1
    lead = range(max(0, peak - 6), peak)
    share = sum(rel[i] and speed[i] >= 0.15 * speed[peak] for i in lead) / len(lead) if lead else 0.0
    live = [i for i in range(max(0, peak - 40), min(n, peak + 41)) if rel[i]]
    held = sum(abs(speed[i]) < 1e-6 for i in live) / len(live) if live else 0.0
    if not moving[peak] or b - a + 1 < 2 or share < 0.5 or held > 0.1:
        flags.append("motion_not_sustained")
    seen = sum(rel) / n
    if seen <= 0:
        flags.append("racket_wrist_unobserved")
    sure = (0.35 + 0.65 * min(max((prom - 1.1) / 1.4, 0), 1)) * seen
    for f in flags:
        sure *= {"wrist_behind_mid_hip": 0.6, "arm_not_extended": 0.8, "contact_near_clip_end": 0.7, "subject_identity_unstable": 0.7, "motion_not_sustained": 0.3}.get(f, 1.0)
    return won, peak, prom, sure, flags, tried


def test_contacts_against_a_slow_reading():
    r = np.random.default_rng(3)
    flags, rejected, lost = set(), 0, 0
    for k in range(400):
        n = int(r.choice([3, 6, 25, 60]))
        t = np.arange(n) / 30
        speed = np.abs(r.normal(0, 1, n)) + sum(r.uniform(0, 9) * np.exp(-((np.arange(n) - r.uniform(0, n)) ** 2) / r.choice([0.5, 4, 9])) for _ in range(2))
        speed = np.where(r.random(n) < r.choice([0.0, 0.3]), 0.0, np.round(speed, 1))
        x, reach = np.round(r.normal(0, 0.5, n) + r.choice([-0.6, 0.3]), 2), np.round(r.uniform(0.3, r.choice([0.4, 1.5]), n), 2)
        wrist, shoulder = r.random(n) < r.choice([1.0, 0.9, 0.0]), r.random(n) < 0.95
        way, unstable = int(r.choice([1, -1])), bool(r.random() < 0.2)
        got = Swing(t, x, speed, reach, wrist, shoulder, way).contact(unstable)
        at, peak, prom, sure, why, tried = slow_contact(t, x, speed, reach, wrist, shoulder, way, unstable)
        assert (got["at"], got["peak"], got["flags"], got["tried"]) == (at, peak, why, tried), k
        assert got["prominence"] == pytest.approx(prom) and got["confidence"] == pytest.approx(sure)
        flags |= set(why)
        rejected += any(w for _, w in tried[:-1])
        lost += at is None
    assert len(flags) == 7 and rejected > 20 and lost > 20


def test_direction_is_turned_only_by_one_clear_motion():
    speed = np.array([0.0, 1, 2, 3, 4, 9, 1, 0])
    one = np.ones(8, bool)
    swing = lambda x, wrist=one: Swing(np.arange(8) / 30, np.array(x, float), speed, np.ones(8), wrist, one, 1)
    for x, want in (([0, 0, -0.1, -0.2, -0.3, -0.4, 0, 0], -1), ([0, 0, 0.3, -0.3, 0.3, -0.1, 0, 0], 1), ([0, 0, 0, 0, -0.02, -0.05, 0, 0], 1), ([0, 0, 0.1, 0.2, 0.3, 0.4, 0, 0], 1)):
        s = swing(x)
        s.turn()
        assert s.direction == want
    s = swing([0, 0, -0.1, -0.2, -0.3, -0.4, 0, 0], ~one)
    s.turn()
    assert s.direction == 1


def test_contacts_on_tables(spark):
    rows = sequence(1, 40) + sequence(2, 2) + sequence(3, 30, [(0, 30)])
    fr = frames(spark, rows)
    norm = normalized.normalized(fr)
    hands = spark.createDataFrame([(1, "left"), (2, None), (3, "right")], "seq_id int, hand string")
    got = {r.seq_id: r for r in contacts.select(norm, hands, normalized.swing_direction(norm), pose.identity_unstable(fr)).collect()}
    assert set(got) == {1, 2, 3} and got[2].flags == ["sequence_unusable"] and got[2].frame is None
    assert got[1].tried and (got[1].frame is None) == (got[1].flags == ["contact_not_found"])
    marks = {(r.landmark, r.frame): r for r in norm.where("seq_id = 1").collect()}
    at = lambda k, c: np.array([getattr(marks[k, f], c) for f in range(40)])
    swing = Swing(np.arange(40) / 30, at(15, "x"), np.hypot(at(15, "vx"), at(15, "vy")), np.hypot(at(15, "x") - at(11, "x"), at(15, "y") - at(11, "y")), np.ones(40, bool), np.ones(40, bool), normalized.swing_direction(norm).where("seq_id = 1").first().direction)
    swing.turn()
    want = swing.contact(False)
    assert got[1].frame == want["at"] and got[1].peak_frame == want["peak"] and got[1].confidence == pytest.approx(want["confidence"]) and [(x.frame, x.against) for x in got[1].tried] == want["tried"]
    assert contacts.select(norm.limit(0), hands, normalized.swing_direction(norm)).count() == 0
    nothing = contacts.select(norm.withColumn("x", F.lit(None).cast("double")), hands.limit(0), normalized.swing_direction(norm).limit(0)).where("seq_id = 1").first()
    assert nothing.flags == ["contact_not_found"] or nothing.frame is not None
