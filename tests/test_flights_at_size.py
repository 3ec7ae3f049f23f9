"""Clips with few candidates a frame are linked side by side, with the tracks that each has alone."""

import numpy as np
import pytest
from test_flights import camera_row

from motionlake.operators import fits, flights


def clip(seed, most=4, n=150):
    """Balls that are hit to and fro, unseen now and then, among clutter and streaks; some frames are late."""
    r = np.random.default_rng(seed)
    times = np.cumsum(r.choice([1, 1, 1, 1, 2, 5], n)) / r.choice([30.0, 60.0])
    rows = []
    balls = [(r.uniform([600, 300], [1300, 700]), r.normal(0, 200, 2)) for _ in range(2)]
    for f in range(n):
        for b, (p, v) in enumerate(balls):
            if r.random() < 0.06:
                v = r.normal(0, 400, 2)
            p = p + v * (times[f] - times[f - 1] if f else 0)
            balls[b] = p, v
            if r.random() < 0.9:
                q = p + r.normal(0, 0.4, 2)
                rows.append((f, *q, 4.0, 9.0 if r.random() < 0.3 else 4.0, np.degrees(np.arctan2(v[1], v[0])) + r.normal(0, 8)))
        rows += [(f, *r.uniform([0, 0], [1920, 1080]), 4.0, 4.0, 0.0) for _ in range(r.integers(0, most - 1))]
    rows = np.array(sorted(rows))
    at = rows[:, 0].astype(int)
    columns = dict(zip(("x", "y", "minor", "major", "orientation_deg"), rows[:, 1:].T, strict=True))
    row = camera_row()
    return flights.Linker(times, at, columns, flights.Scale(row[0], row[2:5], row[5]))


@pytest.mark.parametrize("slots", [8, 2])
def test_clips_side_by_side(monkeypatch, slots):
    monkeypatch.setattr(flights, "SLOTS", slots)
    each = [(k, n) for k, n in zip(range(24), [150, 3, 40, 2, 150, 90] * 4, strict=True)]
    alone, together = ([clip(k, n=n) for k, n in each] for _ in range(2))
    for c in alone:
        c.run()
    runs, run = [], flights.Linker.run
    monkeypatch.setattr(flights.Linker, "run", lambda self: (runs.append(1), run(self))[1])
    found = flights.flights(together)
    for a, b in zip(alone, together, strict=True):
        assert a.pieces() == b.pieces()
    assert sum(len(f) for f in found) > 20 and [x for own in found for x in own] == [x for a in alone for x in flights_of(a)]
    assert len(runs) == 4 if slots == 8 else 4 < len(runs) <= 24  # those of two frames, and those with too many tracks


def flights_of(c):
    """The flights of a clip that has been linked."""
    whole = [[x for k in chain for x in c.pieces()[k]] for chain in c.chains(c.pieces())] if c.pieces() else []
    chained = c.chains(c.pieces()) if c.pieces() else []
    (good,) = flights.accepted([c], [whole])
    parts = [c.pieces()[k] for chain, ok in zip(chained, good, strict=True) if not ok and len(chain) > 1 for k in chain]
    (kept,) = flights.accepted([c], [parts])
    return sorted([f for f, ok in zip(whole, good, strict=True) if ok] + [p for p, ok in zip(parts, kept, strict=True) if ok], key=lambda f: (c.at[f[0]], *c.xy[f[0]]))


def test_many_candidates_are_linked_alone():
    crowd = [clip(k, most=9, n=40) for k in (1, 2)]
    same = [clip(k, most=9, n=40) for k in (1, 2)]
    assert flights.flights(crowd) == [c.flights() for c in same] and flights.flights([]) == []


def test_long_clips_are_linked_alone(monkeypatch):
    clips, run, runs = [clip(k, n=40) for k in range(11)] + [clip(11, n=300)], flights.Linker.run, []
    monkeypatch.setattr(flights.Linker, "run", lambda self: (runs.append(len(self.times)), run(self))[1])
    found = flights.flights(clips)
    assert runs == [300] and found == [c.flights() for c in [clip(k, n=40) for k in range(11)] + [clip(11, n=300)]]


def test_pieces_are_fitted_once(monkeypatch):
    """Pieces of one size from one place are fitted once, for all stretches that they are part of."""
    r, asked = np.random.default_rng(5), []
    t = np.arange(400) / 60
    xy = np.cumsum(np.where(r.random((400, 1)) < 0.2, r.normal(0, 60, (400, 2)), [5.0, 2.0]), axis=0)
    deviation = fits.deviation
    monkeypatch.setattr(fits, "deviation", lambda t, xy, lo, hi, **how: (asked.append((lo, hi, how)), deviation(t, xy, lo, hi, **how))[1])
    first, last = np.array([0, 150]), np.array([150, 400])
    got = fits.smooth(t, xy, first, last)
    monkeypatch.setattr(fits, "SAMPLES", 100)
    assert got.tolist() == fits.smooth(t, xy, first, last).tolist()
    cut = [(lo, hi) for lo, hi, how in asked if how.get("spare") and not how["thrown"]][0]
    assert len(set(zip(*map(np.ndarray.tolist, cut), strict=True))) == len(cut[0]) > 400
