"""Events of many sessions are judged together, and corners of what a ball can do are made only where rounding decides."""

import numpy as np
from test_flights import camera_row

from motionlake.operators import ballevents
from motionlake.operators.ballevents import Camera, Cameras
from motionlake.operators.fits import Stretches


def cameras():
    rows = camera_row(), camera_row(1300.0, (1.5, -20.0, 8.0)), camera_row(1700.0, (-2.0, -25.0, 5.0))
    return [Camera(r[0], r[1], r[2:5], r[5]) for r in rows]


def events(camera, n, r):
    """Places on the ground and velocities before and after, half of them those of a bounce."""
    ground = np.column_stack([r.uniform(-9, 9, n), r.uniform(-15, 15, n), np.zeros(n)])
    j = camera.jacobian(ground)
    fall = np.column_stack([r.uniform(-20, 20, n), r.uniform(0, 40, n) * np.where(ground[:, 1] >= 0, 1, -1), r.uniform(-14, -0.6, n)])
    rise = fall * np.column_stack([*(r.uniform(0.2, 1.1, n),) * 2, -r.uniform(0.0, 1.0, n)])
    real = r.random(n) < 0.5
    before, after = (np.where(real[:, None], np.einsum("nij,nj->ni", j, v), r.normal(0, 300, (n, 2))) for v in (fall, rise))
    return ground, camera.project(ground), before, after


def test_few_corners_are_made(monkeypatch):
    r, made = np.random.default_rng(1), []
    corners = ballevents._corners
    for camera in cameras():
        ground, uv, before, after = events(camera, 300, r)
        args = camera.jacobian(ground), before, after, camera.scale_of(*uv.T), ground[:, 1]
        with monkeypatch.context() as m:
            m.setattr(ballevents, "_corners", lambda a, b: (made.append(len(a)), corners(a, b))[1])
            got = ballevents.can_bounce(*args)
        with monkeypatch.context() as m:
            m.setattr(ballevents, "_met", lambda a, b: corners(a, b)[1].any(axis=1), raising=False)
            want = ballevents.can_bounce(*args)
        assert (got == want).all() and 50 < got.sum() < 250
    assert sum(made) < 90


def test_sets_with_bounds_that_touch():
    """A point, nothing by a hair, a bound that bounds nothing, one twice, and bounds without length."""
    box = [[1, 0, 50], [-1, 0, 50], [0, 1, 50], [0, -1, 0]]
    sets = [[[1, 1, 1], [-1, -1, -1]], [[1, 1, 1], [-1, -1, -1 - 1e-5]], [[1, 1, 1], [-1, -1, -1 + 1e-9]], [[0, 0, 0], [1, 0, -60]], [[0, 0, 3], [1, 1, 2]], [[1e-12, 0, 1], [0, 1e-12, -1]], [[0, 0, -1], [1, 0, 1]], [[2, 2, 2], [2, 2, 2]]]
    rows = np.array([s + box for s in sets], float)
    got = ballevents._met(rows[:, :, :2], rows[:, :, 2])
    assert (got == ballevents._corners(rows[:, :, :2], rows[:, :, 2])[1].any(axis=1)).all() and got[0] and not got[1] and not got[3] and got[4]


def test_sessions_are_judged_together():
    r, every = np.random.default_rng(2), cameras()
    own = [events(c, 40, r)[1:] for c in every]
    alone = [ballevents.possible(Cameras([c], np.zeros(40, int)), *x) for c, x in zip(every, own, strict=True)]
    scale, kinds = ballevents.possible(Cameras(every, np.repeat([0, 1, 2], 40)), *(np.concatenate(x) for x in zip(*own, strict=True)))
    assert kinds == [k for _, ks in alone for k in ks] and np.allclose(scale, [x for xs, _ in alone for x in xs]) and len(set(kinds)) >= 3
    assert ballevents.possible(Cameras(every, np.zeros(0, int)), *(np.zeros((0, 2)),) * 3) == ([], [])


def test_thrown_balls_without_a_system_each(monkeypatch):
    r = np.random.default_rng(3)
    t, lo = np.arange(400) / 60, np.arange(0, 380, 5)
    xy = np.cumsum(r.normal(0, 9, (400, 2)), axis=0)
    xy[200:300] = np.stack([900 + 300 * t, 400 + 200 * t], axis=1)[200:300]  # straight: c1 and c2 are not determined
    stretches = Stretches(t, xy, lo, lo + 9)
    want = stretches._solved(False)
    asked = []
    solved = Stretches._solved
    monkeypatch.setattr(Stretches, "_solved", lambda self, free: (asked.append(len(self.size)), solved(self, free))[1])
    assert np.allclose(stretches.thrown(False), want, rtol=1e-7, atol=1e-9) and sum(asked) <= 22
