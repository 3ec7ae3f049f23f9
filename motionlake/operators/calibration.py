"""Court calibration from taps: checks, homography by normalised direct linear transform, verdict."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Gates in pixels and shares, and the ground keypoints in metres.
MIN_TAPS, GATE_TAPS, CALL_TAPS, DUPLICATE_PX, COLLINEAR_PX, MIN_HULL_SHARE = 4, 6, 8, 8.0, 12.0, 0.05
MAX_RMS_PX, MAX_ERROR_PX, MIN_CONDITION = 2.0, 4.0, 1e-3
#: Pixels that a tap is moved either way to see what its error does.
WOBBLE_PX = 1e-2
VERDICT = "ok boolean, reason string, h array<double>, rms_px double, max_px double, taps int"


def normalising(p: np.ndarray) -> np.ndarray:
    """Similarity that moves points to the origin with mean distance root two."""
    c = p.mean(axis=0)
    s = np.sqrt(2) / max(np.hypot(*(p - c).T).mean(), 1e-12)
    return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def project(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    return q[:, :2] / q[:, 2:]


def fit(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, float]:
    """Homography from src to dst and the ratio of its two least singular values' gap to the largest."""
    a, b = normalising(src), normalising(dst)
    p, q = project(a, src), project(b, dst)
    rows = []
    for (x, y), (u, v) in zip(p, q):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    _, s, vt = np.linalg.svd(np.array(rows))
    h = np.linalg.inv(b) @ vt[-1].reshape(3, 3) @ a
    return h / h[2, 2], float(s[7] / s[0])


def hull_area(p: np.ndarray) -> float:
    """Area of the convex hull, by a monotone chain."""
    p = sorted(map(tuple, p))

    def half(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    h = half(p) + half(p[::-1])
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(h, h[1:] + h[:1]))) / 2


def fits(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``fit`` of many sets of as many points each, all at once."""

    def moved(p):
        c = p.mean(axis=1)
        s = np.sqrt(2) / np.maximum(np.hypot(*np.moveaxis(p - c[:, None], -1, 0)).mean(axis=-1), 1e-12)
        m = np.zeros((len(p), 3, 3))
        m[:, 0, 0], m[:, 1, 1], m[:, 2, 2], m[:, 0, 2], m[:, 1, 2] = s, s, 1, -s * c[:, 0], -s * c[:, 1]
        return m

    a, b = moved(src), moved(dst)
    (x, y), (u, v) = np.moveaxis(projections(a, src), -1, 0), np.moveaxis(projections(b, dst), -1, 0)
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.stack([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], -1)], 2)
    _, s, vt = np.linalg.svd(rows.reshape(len(src), -1, 9))
    h = np.linalg.inv(b) @ vt[:, -1].reshape(-1, 3, 3) @ a
    return h / h[:, 2:, 2:], s[:, 7] / s[:, 0]


def projections(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``project`` of many maps, each with its own points."""
    q = np.concatenate([p, np.ones((*p.shape[:2], 1))], -1) @ np.swapaxes(h, 1, 2)
    return q[..., :2] / q[..., 2:]


def rejections(uv: np.ndarray, width: np.ndarray, height: np.ndarray) -> list[str | None]:
    """Why taps cannot calibrate a court, the first reason that holds, of many sets of as many taps each.

    Some four of them must have no three on a line; hulls are drawn only where nothing else speaks against the taps.
    """
    k, n = uv.shape[:2]
    if n < MIN_TAPS:
        return ["too_few_taps"] * k
    pairs = list(itertools.combinations(range(n), 2))
    far = {(i, j): np.hypot(*(uv[:, i] - uv[:, j]).T) for i, j in pairs}
    twice = np.any([d < DUPLICATE_PX for d in far.values()], axis=0)
    flat = {}
    for i, j, m in itertools.combinations(range(n), 3):
        b, c = uv[:, j] - uv[:, i], uv[:, m] - uv[:, i]
        with np.errstate(divide="ignore", invalid="ignore"):
            flat[i, j, m] = np.abs(b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]) / np.maximum(np.maximum(far[i, j], far[j, m]), far[i, m]) < COLLINEAR_PX
    spread = np.zeros(k, bool)
    for four in itertools.combinations(range(n), 4):
        spread |= ~np.any([flat[t] for t in itertools.combinations(four, 3)], axis=0)
        if (spread | twice).all():
            break
    out: list[str | None] = ["duplicate_taps" if t else None if s else "collinear_taps" for t, s in zip(twice.tolist(), spread.tolist())]
    return ["taps_too_close" if r is None and hull_area(p) < MIN_HULL_SHARE * w * h else r for r, p, w, h in zip(out, uv, width.tolist(), height.tolist())]


def calibrate(taps: DataFrame, key: str) -> DataFrame:
    """(key, ok, reason, h, rms_px, max_px, taps) from rows x_m, y_m, u_px, v_px, frame_w, frame_h.

    A session has a handful of taps, so a key is one row, and those with as many taps are solved together.  Keys are
    dealt to spark.sql.shuffle.partitions tasks, however few bytes they have.
    """
    tap = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x_m", "y_m", "u_px", "v_px", "frame_w", "frame_h")))
    parts = int(taps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = taps.repartition(parts, key).groupBy(key).agg(F.collect_list(tap).alias("taps"))
    schema = StructType([taps.schema[key], *StructType.fromDDL(VERDICT).fields])

    def solve(batches):
        kinds = to_arrow_schema(schema)
        for batch in batches:
            counts = pc.list_value_length(batch.column("taps")).to_numpy(zero_copy_only=False)
            each = batch.column("taps").flatten()
            x, y, u, v, w, z = (each.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            starts = np.cumsum(counts) - counts
            reasons, maps, rms, worst = ([None] * len(counts) for _ in range(4))
            for n in np.unique(counts).tolist():
                of = np.flatnonzero(counts == n)
                at = starts[of][:, None] + np.arange(n)
                uv, xy = np.stack([u[at], v[at]], -1), np.stack([x[at], y[at]], -1)
                for i, r in zip(of.tolist(), rejections(uv, w[at[:, 0]], z[at[:, 0]])):
                    reasons[i] = r
                fine = np.array([reasons[i] is None for i in of.tolist()])
                if not fine.any():
                    continue
                uv, xy = uv[fine], xy[fine]
                m, condition = fits(xy, uv)
                error = np.hypot(*np.moveaxis(projections(m, xy) - uv, -1, 0))
                for i, h, r, e, c in zip(of[fine].tolist(), m.reshape(-1, 9).tolist(), np.sqrt((error**2).mean(axis=-1)).tolist(), error.max(axis=-1).tolist(), condition.tolist()):
                    maps[i], rms[i], worst[i] = h, r, e
                    if c < MIN_CONDITION:
                        reasons[i] = "degenerate"
                    elif n >= GATE_TAPS and (r > MAX_RMS_PX or e > MAX_ERROR_PX):
                        reasons[i] = "reprojection_error"
            found = [batch.column(key), [r is None for r in reasons], reasons, maps, rms, worst, counts.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(found, kinds)], schema=kinds)

    return keys.mapInArrow(solve, schema)


def camera(h: np.ndarray, width: float, height: float) -> dict | None:
    """Focal length, place and projection of the camera behind a map from court to image; None where no camera fits.

    Square pixels and a principal point in the middle leave one unknown in two linear constraints on
    the columns of the map: the inverse square of the focal length, in units of the frame's long side.
    """
    long = float(max(width, height))
    m = np.array([[1 / long, 0, -width / 2 / long], [0, 1 / long, -height / 2 / long], [0, 0, 1]]) @ h
    m /= np.linalg.norm(m)
    a, b = m[:, 0], m[:, 1]
    # the first two columns are at right angles and of one length, once x and y are divided by the focal length
    flat = np.array([a[:2] @ b[:2], a[:2] @ a[:2] - b[:2] @ b[:2]])
    deep = np.array([a[2] * b[2], a[2] ** 2 - b[2] ** 2])
    if flat @ flat <= 0 or (w := -(flat @ deep) / (flat @ flat)) <= 0:
        return None
    focal = 1 / np.sqrt(w)
    g = m / np.array([focal, focal, 1.0])[:, None]
    g *= 2 / (np.linalg.norm(g[:, 0]) + np.linalg.norm(g[:, 1]))
    g *= 1 if g[2, 2] >= 0 else -1  # the court is in front of the camera
    u, _, vt = np.linalg.svd(np.column_stack([g[:, 0], g[:, 1], np.cross(g[:, 0], g[:, 1])]))
    turn = u @ vt
    if np.linalg.det(turn) < 0:
        return None
    place = -turn.T @ g[:, 2]
    lens = np.array([[focal * long, 0, width / 2], [0, focal * long, height / 2], [0, 0, 1]])
    return {"focal_px": float(focal * long), "cam": place.tolist(), "projection": (lens @ np.column_stack([turn, g[:, 2]])).ravel().tolist()}


def wobble(uv: np.ndarray, xy: np.ndarray) -> list[dict]:
    """Image-to-court maps with one coordinate of one tap moved either way."""
    out = []
    for k in range(uv.size):
        moved = []
        for sign in (1, -1):
            taps = uv.copy()
            taps.flat[k] += sign * WOBBLE_PX
            moved.append(fit(taps, xy)[0].ravel().tolist())
        out.append({"plus": moved[0], "minus": moved[1], "step": 2 * WOBBLE_PX})
    return out


def court_maps(taps: DataFrame, key: str, sigma_tap_px: float = 1.5) -> DataFrame:
    """(key, h, cam_x, cam_y, cam_z, focal_px, projection, sigma_tap_px, wobble, calls_allowed): what landings need of a session's taps.

    h maps the image to the court.  Sessions whose taps are refused, or behind whose map no camera is
    found, have no row; calls are allowed from CALL_TAPS taps on.
    """
    types = dict(taps.dtypes)
    schema = f"`{key}` {types[key]}, h array<double>, cam_x double, cam_y double, cam_z double, focal_px double, projection array<double>, sigma_tap_px double, wobble array<struct<plus: array<double>, minus: array<double>, step: double>>, calls_allowed boolean"
    good = calibrate(taps, key).where("ok").select(key)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        uv, xy = pdf[["u_px", "v_px"]].to_numpy(float), pdf[["x_m", "y_m"]].to_numpy(float)
        seen = camera(fit(xy, uv)[0], pdf["frame_w"].iloc[0], pdf["frame_h"].iloc[0])
        rows = []
        if seen:
            rows.append((pdf[key].iloc[0], fit(uv, xy)[0].ravel().tolist(), *seen["cam"], seen["focal_px"], seen["projection"], sigma_tap_px, wobble(uv, xy), len(uv) >= CALL_TAPS))
        return pd.DataFrame(rows, columns=[key, "h", "cam_x", "cam_y", "cam_z", "focal_px", "projection", "sigma_tap_px", "wobble", "calls_allowed"])

    return taps.join(good, key, "left_semi").groupBy(key).applyInPandas(one, schema)
