"""Calibration of many sessions at once against one at a time."""

import itertools
import random

import numpy as np

from motionlake.operators import calibration

GROUND = [(-5.485, -11.885), (5.485, -11.885), (-5.485, 11.885), (5.485, 11.885), (-4.115, 6.4), (4.115, 6.4), (0.0, -6.4), (0.0, 6.4)]
TAPS = "k long, x_m double, y_m double, u_px double, v_px double, frame_w int, frame_h int"


def slow_rejection(uv, width, height):
    if len(uv) < calibration.MIN_TAPS:
        return "too_few_taps"
    if any(np.hypot(*(a - b)) < calibration.DUPLICATE_PX for a, b in itertools.combinations(uv, 2)):
        return "duplicate_taps"

    def flat(a, b, c):
        sides = [np.hypot(*(x - y)) for x, y in ((a, b), (b, c), (a, c))]
        return abs(np.cross(np.append(b - a, 0), np.append(c - a, 0))[2]) / max(sides) < calibration.COLLINEAR_PX

    if not any(not any(flat(*t) for t in itertools.combinations(four, 3)) for four in itertools.combinations(uv, 4)):
        return "collinear_taps"
    return "taps_too_close" if calibration.hull_area(uv) < calibration.MIN_HULL_SHARE * width * height else None


def test_many_sessions_at_once_against_one_at_a_time(spark):
    """no session is a group of its own in Python; every reason and figure is the same."""
    r = random.Random(3)
    rows, want = [], {}
    for k in range(200):
        shape, n = r.choice([50, 50, 12, 3, 0.2]), r.randrange(1, 9)
        noise = r.choice([0, 0.5, 6])
        taps = [(x, y, 640 + shape * x + 3 * y + r.gauss(0, noise), 360 - shape / 2.5 * y + r.gauss(0, noise)) for x, y in r.sample(GROUND, n)]
        rows += [(k, *map(float, t), 1280, 720) for t in taps]
        xy, uv = np.array(taps)[:, :2], np.array(taps)[:, 2:]
        reason, rms = slow_rejection(uv, 1280, 720), None
        if reason is None:
            m, condition = calibration.fit(xy, uv)
            error = np.hypot(*(calibration.project(m, xy) - uv).T)
            rms = np.sqrt((error**2).mean())
            gated = n >= calibration.GATE_TAPS and (rms > calibration.MAX_RMS_PX or error.max() > calibration.MAX_ERROR_PX)
            reason = "degenerate" if condition < calibration.MIN_CONDITION else "reprojection_error" if gated else None
        want[k] = (reason is None, reason, rms, n)
    d = calibration.calibrate(spark.createDataFrame(rows, TAPS).coalesce(1), "k")
    assert "InPandas" not in d._jdf.queryExecution().executedPlan().toString()
    got = {x.k: x for x in d.collect()}
    assert {k: (x.ok, x.reason, x.taps) for k, x in got.items()} == {k: (w[0], w[1], w[3]) for k, w in want.items()}
    assert all((x.rms_px is None) == (want[k][2] is None) and (x.rms_px is None or abs(x.rms_px - want[k][2]) < 1e-9 and len(x.h) == 9) for k, x in got.items())
    assert len({w[1] for w in want.values()}) >= 5
