"""Bounces, hits and net contacts: breaks of flights, judged by what a ball can do on a court.

A break is where two short curves fit far better than one.  Its place and its velocities on either
side, with the camera known, say whether it can be a bounce on the ground or a contact with the net.
"""

from __future__ import annotations

from bisect import bisect, insort
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.operators.ball import BREAK_RATIO, BREAK_SEPARATION, MAX_SPEED_M_S, SIDE_SAMPLES, SIDE_SPAN_S
from motionlake.operators.court import DOUBLES_HALF, HALF_LENGTH
from motionlake.operators.fits import Stretches
from motionlake.operators.flights import Scale
from motionlake.operators.groups import by_keys, dealt

#: Samples of a side, of a whole one, of a line's side, of both; least deviation of the single fit, floor of the noise.
SIDE_LEAST, SIDE_WHOLE, LINE_SAMPLES, BOTH_LEAST, SINGLE_PX, NOISE_PX = 2, 3, 3, 6, 1.0, 0.5
#: Stretches that are fitted together, so that they stay near the processor.
PIECE = 2048
#: Rows whose sessions are judged together.
GATHERED = 400_000
#: Places tried for the time of a break, and samples of a side that give full confidence.
GRID, FULL_SIDE = 41, 8
#: Fixed values, in seconds, metres and metres a second: matching of hits, upward impulse, run-off, net, directions.
HIT_S, WRIST_M, IMPULSE_M_S, RUNOFF_M, HIT_RATIO, DIRECTION_M_S = 0.05, 1.2, 2.0, 4.0, 1.2, 1.0
NET_SPAN, NET_POST, NET_CENTRE, NET_MARGIN_PX, NET_KEEPS, NET_LEAST_M_S = 6.399, 1.07, 0.914, 2.0, 0.5, 5.0
#: Share of speed along the ground that a bounce keeps, most that returns upwards, speeds, tolerances.
KEEPS, RETURNS, VERTICAL_M_S, GROUND_M_S, TOLERANCE, TOLERANCE_M_S = np.linspace(0.3, 1.0, 15), 0.9, (0.5, 15.0), 50.0, 0.15, 0.5
#: Confidence below which a label may change and a bounce is weak; costs of repeated labels; seconds of a split bounce.
RELABEL_BELOW, WEAK_BELOW, HIT_AGAIN, BOUNCE_AGAIN, SPLIT_S = 0.6, 0.5, 0.5, 0.3, 0.1

FIELDS = ("time_s", "ratio", "u", "v", "vbx", "vby", "vax", "vay", "sigma_s", "uu", "uv", "vv", "confidence")


class Breaks:
    """Flights one after the other as arrays: times, places, and where each flight begins and ends."""

    def __init__(self, t: np.ndarray, xy: np.ndarray, first: np.ndarray, last: np.ndarray, interval: np.ndarray):
        self.t, self.xy, self.first, self.last, self.interval = t, xy, first, last, interval
        flight = np.repeat(np.arange(len(first)), last - first)
        self.flight = flight
        k = np.arange(len(t))
        # a flight's samples within the span of a sample, SIDE_SAMPLES at most, before it and after it
        self.near, self.far = k.copy(), k + 1
        for a, b in zip(first, last, strict=True):
            own = t[a:b]
            self.near[a:b] = a + np.searchsorted(own, own - SIDE_SPAN_S - 1e-9)
            self.far[a:b] = a + np.searchsorted(own, own + SIDE_SPAN_S + 1e-9, "right")
        self.near, self.far = np.maximum(self.near, k - SIDE_SAMPLES + 1), np.minimum(self.far, k + SIDE_SAMPLES)

    def side(self, lo: np.ndarray, hi: np.ndarray, origin: np.ndarray) -> dict[str, np.ndarray]:
        """A line through LINE_SAMPLES samples at most, else a parabola: coefficients on a clock from ``origin``, lowest first."""
        s = Stretches(self.t, self.xy, lo, hi)
        clock = np.where(s.inside, (s.t - origin[:, None]) / SIDE_SPAN_S, 0.0)
        degree = np.where(hi - lo <= LINE_SAMPLES, 1, 2)
        basis = np.stack([np.ones_like(clock), clock, clock**2], axis=2) * (s.inside[:, :, None] & (np.arange(3) <= degree[:, None, None]))
        c = np.linalg.pinv(basis) @ s.xy
        unit = SIDE_SPAN_S ** np.arange(3)
        inverse = np.linalg.pinv(basis.transpose(0, 2, 1) @ basis, hermitian=True) / unit[:, None] / unit
        return {"c": c / unit[:, None], "inverse": inverse, "rss": s.left(basis @ c), "n": hi - lo, "degree": degree}

    def squares(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The rss of ``side`` alone."""
        if len(lo) > PIECE:
            return np.concatenate([self.squares(lo[k : k + PIECE], hi[k : k + PIECE]) for k in range(0, len(lo), PIECE)])
        if not len(lo):
            return np.zeros(0)
        return Stretches(self.t, self.xy, lo, hi).polynomial(np.where(hi - lo <= LINE_SAMPLES, 1, 2))

    def window(self, split: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The samples that judge a break between each ``split`` and the next one, within [low, high)."""
        return np.maximum(self.near[split], low), np.minimum(self.far[np.minimum(split + 1, len(self.t) - 1)], high)

    def share(self, split: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The share of squares that a break leaves; infinite where it cannot be judged, or is none beside a parabola alone.

        Thrown balls come as near as a parabola or nearer, which only adds to the share.
        """
        if len(split) > PIECE:
            return np.concatenate([self.share(*(v[k : k + PIECE] for v in (split, low, high))) for k in range(0, len(split), PIECE)])
        lo, hi = self.window(split, low, high)
        n, m = split + 1 - lo, hi - split - 1
        share = np.full(len(split), np.inf)
        k = np.flatnonzero((np.minimum(n, m) >= SIDE_LEAST) & (np.maximum(n, m) >= SIDE_WHOLE) & (n + m >= BOTH_LEAST))
        for thrown in (False, True):
            if not len(k):
                break
            a, b, c = lo[k], split[k] + 1, hi[k]
            both = Stretches(self.t, self.xy, a, c)
            if thrown:
                one = np.minimum(one, both.thrown(free=False))
            else:
                one, two = both.polynomial(np.full(len(k), 2)), self.squares(a, b) + self.squares(b, c)
            found = np.where((one > 0) & (np.sqrt(one / (c - a)) >= SINGLE_PX), two / np.maximum(one, 1e-300), np.inf)
            good = found <= BREAK_RATIO
            k, one, two = k[good], one[good], two[good]
            found = found[good]
        if len(k):
            share[k] = found
        return share

    def judge(self, split: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[dict, dict, np.ndarray]:
        """Fits before and after a break between each ``split`` and the next sample, within [low, high), and the share of squares left.

        The share is infinite where a break cannot be judged.
        """
        lo, hi = self.window(split, low, high)
        n, m = split + 1 - lo, hi - split - 1
        ok = (np.minimum(n, m) >= SIDE_LEAST) & (np.maximum(n, m) >= SIDE_WHOLE) & (n + m >= BOTH_LEAST)
        share = np.full(len(split), np.inf)
        sides: list[dict] = [{}, {}]
        if ok.any():
            a, b, c = lo[ok], split[ok] + 1, hi[ok]
            sides = [self.side(a, b, self.t[b - 1]), self.side(b, c, self.t[b - 1])]
            both = Stretches(self.t, self.xy, a, c)
            one = np.minimum(both.polynomial(np.full(len(a), 2)), both.thrown(free=False))
            two = sides[0]["rss"] + sides[1]["rss"]
            share[ok] = np.where((one > 0) & (np.sqrt(one / (c - a)) >= SINGLE_PX), two / np.maximum(one, 1e-300), np.inf)
        place = np.cumsum(ok) - 1
        return {"at": place, **sides[0]}, {"at": place, **sides[1]}, share

    def refine(self, split: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The cut of each split's window that leaves the least squares, the first of equals."""
        lo, hi = np.maximum(self.near[split], low), np.minimum(self.far[split + 1], high)
        cuts = hi - lo - 2 * SIDE_LEAST + 1
        own = np.repeat(np.arange(len(split)), cuts)
        b = np.concatenate([np.arange(a + SIDE_LEAST, c - SIDE_LEAST + 1) for a, c in zip(lo, hi, strict=True)])
        left = self.squares(lo[own], b) + self.squares(b, hi[own])
        order = np.lexsort((b, left, own))
        return b[order[np.searchsorted(own, np.arange(len(split)))]] - 1

    def chosen(self) -> np.ndarray:
        """The splits of all flights, the clearest first; each bounds the sides of those after it.

        Flights are taken a candidate at a time, all together.
        """
        split = np.arange(len(self.t))
        split = split[split + 1 < self.last[self.flight]]
        if not len(split):
            return split
        share = self.share(split, self.first[self.flight[split]], self.last[self.flight[split]])
        split, share = split[share <= BREAK_RATIO], share[share <= BREAK_RATIO]
        order = np.lexsort((split, self.t[split], share, self.flight[split]))
        waiting: dict[int, list[int]] = {}
        for k in split[order[::-1]].tolist():
            waiting.setdefault(int(self.flight[k]), []).append(k)
        taken: dict[int, list[int]] = {f: [] for f in waiting}
        rows: dict[int, list[int]] = {f: [] for f in waiting}  # the same in order, between bounds of the flight

        def beside(k: int, f: int) -> tuple[int, int]:
            """The nearest that are taken before a split and after it, or that lie far beyond the flight."""
            at = bisect(rows[f], k)
            return rows[f][at - 1] if at else -BREAK_SEPARATION - 1, rows[f][at] if at < len(rows[f]) else len(self.t) + BREAK_SEPARATION

        def apart(k: int, f: int) -> bool:
            before, after = beside(k, f)
            return k - before >= BREAK_SEPARATION and after - k >= BREAK_SEPARATION

        while waiting:
            now, low, high = [], [], []
            for f in list(waiting):
                while waiting[f] and not apart(waiting[f][-1], f):
                    waiting[f].pop()
                if not waiting[f]:
                    del waiting[f]
                    continue
                k = waiting[f].pop()
                now.append(k)
                before, after = beside(k, f)
                low.append(max(before + 1, int(self.first[f])))
                high.append(min(after + 1, int(self.last[f])))
            if not now:
                break
            now, low, high = (np.array(x) for x in (now, low, high))
            # those whose window none that is taken has cut were judged before
            alone = self.window(now, self.first[self.flight[now]], self.last[self.flight[now]])
            cut = np.flatnonzero((alone[0] < low) | (alone[1] > high))
            clear = np.ones(len(now), bool)
            clear[cut] = self.share(now[cut], low[cut], high[cut]) <= BREAK_RATIO
            now, low, high = now[clear], low[clear], high[clear]
            if not len(now):
                continue
            moved = self.refine(now, low, high)
            better = moved != now
            better[better] = self.share(moved[better], low[better], high[better]) <= BREAK_RATIO
            for k, f in zip(np.where(better, moved, now).tolist(), self.flight[now].tolist(), strict=True):
                if apart(k, f):
                    taken[f].append(k)
                    insort(rows[f], k)
        self.taken = taken
        return np.array(sorted(k for own in taken.values() for k in own), np.int64)

    def events(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Flights of the breaks, and FIELDS with ``one_sided``.

        The time is where the rows of both curves meet, else where the curves are closest, within an
        interval around the two samples.
        """
        split = self.chosen()
        if not len(split):
            return split, {c: np.zeros(0) for c in (*FIELDS, "one_sided")}
        flight = self.flight[split]
        low, high = np.empty_like(split), np.empty_like(split)
        for j, (k, f) in enumerate(zip(split.tolist(), flight.tolist(), strict=True)):
            # a break's sides are those that the ones chosen before it left to it
            before = self.taken[f][: self.taken[f].index(k)]
            low[j] = max((c + 1 for c in before if c < k), default=int(self.first[f]))
            high[j] = min((c + 1 for c in before if c > k), default=int(self.last[f]))
        pieces = [self.judge(*(v[k : k + PIECE] for v in (split, low, high))) for k in range(0, len(split), PIECE)]
        b, a = ({c: np.concatenate([p[j][c] for p in pieces]) for c in ("c", "inverse", "rss", "n", "degree")} for j in (0, 1))
        share = np.concatenate([p[2] for p in pieces])
        interval = self.interval[flight]
        left, right = self.t[split], self.t[split + 1]
        lo, hi, middle = -interval, right - left + interval, (right - left) / 2
        d = (b["c"] - a["c"])[:, :, 1]
        with np.errstate(all="ignore"):
            disc = d[:, 1] ** 2 - 4 * d[:, 2] * d[:, 0]
            q = -(d[:, 1] + np.where(d[:, 1] >= 0, 1.0, -1.0) * np.sqrt(disc)) / 2
            roots = np.stack([np.where(d[:, 2] != 0, q / d[:, 2], -d[:, 0] / d[:, 1]), np.where((d[:, 2] != 0) & (q != 0), d[:, 0] / q, np.nan)], axis=1)
            roots = np.sort(np.where((roots >= lo[:, None]) & (roots <= hi[:, None]), roots, np.nan), axis=1)
            off = np.nan_to_num(np.abs(roots - middle[:, None]), nan=np.inf)
        when = np.take_along_axis(roots, np.argmin(off, axis=1)[:, None], axis=1)[:, 0]
        power = lambda x: np.stack([np.ones_like(x), x, x * x], axis=-1)
        grid = lo[:, None] + (hi - lo)[:, None] * np.linspace(0, 1, GRID)
        apart = ((power(grid) @ (b["c"] - a["c"])) ** 2).sum(axis=2)
        when = np.where(np.isfinite(off).any(axis=1), when, np.take_along_axis(grid, np.argmin(apart, axis=1)[:, None], axis=1)[:, 0])
        slope = np.stack([np.zeros_like(when), np.ones_like(when), 2 * when], axis=1)
        at = power(when)
        place = [np.einsum("ri,ric->rc", at, x["c"]) for x in (b, a)]
        speed = [np.einsum("ri,ric->rc", slope, x["c"]) for x in (b, a)]
        rss, n = b["rss"] + a["rss"], b["n"] + a["n"]
        dof = 2 * n - 2 * (b["degree"] + a["degree"] + 2)
        noise = np.maximum(np.where(dof > 0, rss / np.maximum(dof, 1), 0.0), NOISE_PX**2)
        spread = noise * sum(np.einsum("ri,rij,rj->r", at, x["inverse"], at) for x in (b, a))
        one_sided = np.minimum(b["n"], a["n"]) < SIDE_WHOLE
        closing = np.abs(speed[1][:, 1] - speed[0][:, 1])
        with np.errstate(divide="ignore"):
            fitted = np.where(closing > 0, np.sqrt(spread) / closing, np.inf)
        sigma = np.where(one_sided, np.where(interval > 0, interval, right - left) / np.sqrt(12.0), np.minimum(fitted, (right - left) / np.sqrt(12.0)))
        mean, point = (speed[0] + speed[1]) / 2, (place[0] + place[1]) / 2
        own = np.clip(1.0 - share, 0.0, 1.0) * np.minimum(1.0, np.minimum(b["n"], a["n"]) / FULL_SIDE)
        cov = [spread / 4 * (i == j) + mean[:, i] * mean[:, j] * sigma**2 for i, j in ((0, 0), (0, 1), (1, 1))]
        values = (left + when, share, *point.T, *speed[0].T, *speed[1].T, sigma, *cov, own)
        return flight, dict(zip(FIELDS, values, strict=True)) | {"one_sided": one_sided}


def _kept(t: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Samples with a finite place and time; of equal times the first."""
    good = np.isfinite(t) & np.isfinite(xy).all(axis=1)
    new = np.ones(len(t), bool)
    new[1:] = ~good[:-1] | (t[1:] != t[:-1])
    return good & new


def _interval(t: np.ndarray) -> float:
    gaps = np.diff(t[np.isfinite(t)])
    return float(np.median(gaps[gaps > 0])) if (gaps > 0).any() else 0.0


def break_points(points: DataFrame, key: str, time: str) -> DataFrame:
    """(key, time_s, ratio, u, v, vbx, vby, vax, vay, sigma_s, uu, uv, vv, confidence, one_sided): where two smooth pieces fit far better than one.

    A break lies between two samples.  Each side has at most SIDE_SAMPLES samples within SIDE_SPAN_S, a
    side of LINE_SAMPLES is fitted by a line; the single fit is the better of a parabola and the image of
    a thrown ball.  The clearest break comes first and bounds the sides of the next, which are judged
    again; each is moved to the cut of its window that leaves the least squares.  Place and time are where the
    curves meet, velocities are theirs there, sigma_s and the covariance are what the fits' noise leaves.

    Samples with a null or non-finite place, and those at a time that a sample has already (the first by x, then
    y, counts), are not fitted; times of samples without a place count for the usual interval.  Flights
    are dealt by key and sorted; a task folds over them, and fits those of a batch together.
    """
    kind = dict(points.dtypes)[key]
    names = [key, *FIELDS, "one_sided"]

    def judged(keys: list, flights: list[np.ndarray], key_type: pa.DataType) -> pa.RecordBatch:
        kept, first, last, intervals = [], [], [], []
        at = 0
        for f in flights:
            own = f[_kept(f[:, 0], f[:, 1:])]
            kept.append(own)
            first.append(at)
            at += len(own)
            last.append(at)
            intervals.append(_interval(f[:, 0]))
        rows = np.concatenate(kept) if kept else np.zeros((0, 3))
        flight, found = Breaks(rows[:, 0], rows[:, 1:], np.array(first, np.int64), np.array(last, np.int64), np.array(intervals)).events()
        return pa.RecordBatch.from_arrays([pa.array([keys[f] for f in flight.tolist()], key_type), *(pa.array(found[c], pa.float64()) for c in FIELDS), pa.array(found["one_sided"].astype(bool))], names=names)

    def fold(batches):
        held_key, held = None, []
        for batch in batches:
            key_type = batch.schema.field(0).type
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_pylist()
            values = np.stack([batch.column(j).fill_null(np.nan).to_numpy(zero_copy_only=False) for j in (1, 2, 3)], axis=1)
            begins = [0, *(j for j in range(1, len(keys)) if keys[j] != keys[j - 1])]
            done_keys, done = [], []
            for a, b in zip(begins, [*begins[1:], len(keys)], strict=True):
                if held and keys[a] != held_key:
                    done_keys.append(held_key)
                    done.append(np.concatenate(held))
                    held = []
                held_key = keys[a]
                held.append(values[a:b])
            if done:
                yield judged(done_keys, done, key_type)
        if held:
            yield judged([held_key], [np.concatenate(held)], key_type)

    rows = points.where(F.col(key).isNotNull()).select(key, F.col(time).cast("double").alias("__t"), F.col("x").cast("double").alias("__x"), F.col("y").cast("double").alias("__y"))
    rows = dealt(rows, key, "__t", F.col("__x").isNull(), "__x", "__y")
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in FIELDS) + ", one_sided boolean"
    return rows.mapInArrow(fold, schema)


# what a ball can do ---------------------------------------------------------------------------------


class Camera:
    """Maps between a court and its image, for arrays of places."""

    def __init__(self, h, projection, cam, focal: float):
        self.h, self.m = np.asarray(h, float).reshape(3, 3), np.asarray(projection, float).reshape(3, 4)
        self.cam, self.focal, self.scale_of = np.asarray(cam, float), focal, Scale(h, tuple(cam), focal)
        back = np.linalg.inv(self.h)
        origin = back @ np.array([0.0, 0.0, 1.0])
        far = back @ np.array([0.0, HALF_LENGTH, 1.0])
        self.front = np.sign(self.h[2] @ (origin / origin[2]))
        self.far_scale = float(self.scale_of(far[:1] / far[2], far[1:2] / far[2])[0])

    def ground(self, uv: np.ndarray) -> np.ndarray:
        """Places on the ground; not finite from the horizon up."""
        with np.errstate(all="ignore"):
            p = self.h @ np.concatenate([uv, np.ones((len(uv), 1))], axis=1).T
            return np.where(np.sign(p[2]) == self.front, p[:2] / p[2], np.nan).T

    def scale(self, uv: np.ndarray) -> np.ndarray:
        """Pixels a metre before the ground; from the horizon up that of the far baseline."""
        return np.where(np.isfinite(self.ground(uv)).all(axis=1), self.scale_of(*uv.T), self.far_scale)

    def project(self, xyz: np.ndarray) -> np.ndarray:
        p = self.m @ np.concatenate([xyz, np.ones((len(xyz), 1))], axis=1).T
        return (p[:2] / p[2]).T

    def jacobian(self, xyz: np.ndarray) -> np.ndarray:
        """Derivatives of the image by the place in space, (n, 2, 3)."""
        p = self.m @ np.concatenate([xyz, np.ones((len(xyz), 1))], axis=1).T
        uv = (p[:2] / p[2]).T
        return (self.m[None, :2, :3] - uv[:, :, None] * self.m[None, 2:, :3]) / p[2][:, None, None]

    def net_points(self, uv: np.ndarray) -> np.ndarray:
        """Where the rays through ``uv`` meet the plane of the net, between posts, ground and top; else not finite."""
        ray = np.linalg.solve(self.m[:, :3], np.concatenate([uv, np.ones((len(uv), 1))], axis=1).T).T
        with np.errstate(all="ignore"):
            reach = -self.cam[1] / ray[:, 1]
            at = self.cam + reach[:, None] * ray
        good = (reach > 0) & (np.abs(at[:, 0]) <= NET_SPAN) & (at[:, 2] >= 0) & (at[:, 2] <= NET_POST)
        at[:, 1] = 0.0
        return np.where(good[:, None], at, np.nan)

    def net_polygon(self) -> np.ndarray:
        return self.project(np.array([[-NET_SPAN, 0, 0], [NET_SPAN, 0, 0], [NET_SPAN, 0, NET_POST], [0, 0, NET_CENTRE], [-NET_SPAN, 0, NET_POST]], float))


class Cameras:
    """What ``Camera`` does, for places that have a camera each: ``of`` says which."""

    def __init__(self, cameras: list[Camera], of: np.ndarray):
        every = lambda f: np.array([f(c) for c in cameras])[of]
        self.cameras, self.of = cameras, of
        self.h, self.m, self.cam, self.focal = every(lambda c: c.h), every(lambda c: c.m), every(lambda c: c.cam), every(lambda c: c.focal)
        self.front, self.far_scale = every(lambda c: c.front), every(lambda c: c.far_scale)

    def only(self, k: np.ndarray) -> Cameras:
        return Cameras(self.cameras, self.of[k])

    @staticmethod
    def _times(m: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Matrices (n, rows, d + 1) by places (n, d) and 1: (rows, n)."""
        out = m[:, :, -1].T.copy()
        for k in range(p.shape[1]):
            out += m[:, :, k].T * p[:, k]
        return out

    def ground(self, uv: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            p = self._times(self.h, uv)
            return np.where(np.sign(p[2]) == self.front, p[:2] / p[2], np.nan).T

    def scale_of(self, uv: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            p = self._times(self.h, uv)
            far = np.sqrt((p[0] / p[2] - self.cam[:, 0]) ** 2 + (p[1] / p[2] - self.cam[:, 1]) ** 2 + self.cam[:, 2] ** 2)
            return np.nan_to_num(self.focal / far, nan=0.0, posinf=0.0)

    def scale(self, uv: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(self.ground(uv)).all(axis=1), self.scale_of(uv), self.far_scale)

    def jacobian(self, xyz: np.ndarray) -> np.ndarray:
        p = self._times(self.m, xyz)
        uv = (p[:2] / p[2]).T
        return (self.m[:, :2, :3] - uv[:, :, None] * self.m[:, 2:, :3]) / p[2][:, None, None]

    def net_points(self, uv: np.ndarray) -> np.ndarray:
        ray = np.linalg.solve(self.m[:, :, :3], np.concatenate([uv, np.ones((len(uv), 1))], axis=1)[:, :, None])[:, :, 0]
        with np.errstate(all="ignore"):
            reach = -self.cam[:, 1] / ray[:, 1]
            at = self.cam + reach[:, None] * ray
        good = (reach > 0) & (np.abs(at[:, 0]) <= NET_SPAN) & (at[:, 2] >= 0) & (at[:, 2] <= NET_POST)
        at[:, 1] = 0.0
        return np.where(good[:, None], at, np.nan)

    def net_polygons(self) -> np.ndarray:
        return np.array([c.net_polygon() for c in self.cameras]).reshape(-1, 5, 2)[self.of]


def inside(points: np.ndarray, polygon: np.ndarray, margin: float) -> np.ndarray:
    """Whether points are in a polygon, one for all or one each, or within ``margin`` of an edge of it."""
    (ax, ay), (bx, by) = np.moveaxis(polygon, -1, 0), np.moveaxis(np.roll(polygon, -1, axis=-2), -1, 0)
    x, y = points[:, :1], points[:, 1:]
    dx, dy = bx - ax, by - ay
    with np.errstate(all="ignore"):
        crosses = ((ay > y) != (by > y)) & (x < ax + (y - ay) * dx / dy)
    s = np.clip(((x - ax) * dx + (y - ay) * dy) / np.maximum(dx**2 + dy**2, 1e-300), 0, 1)
    near = np.hypot(x - ax - s * dx, y - ay - s * dy) <= margin
    return (crosses.sum(axis=1) % 2 == 1) | near.any(axis=1)


@cache
def _picks(n: int, d: int) -> np.ndarray:
    return np.array(list(combinations(range(n), d)))


def _corners(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the bounded sets {x: a x <= b} in two or three dimensions, (n, corners, d), and which of them are real."""
    size = np.maximum(np.linalg.norm(a, axis=2), 1e-300)
    a, b = a / size[:, :, None], b / size
    d = a.shape[2]
    picks = _picks(a.shape[1], d)
    faces, sides = a[:, picks], b[:, picks]
    if d == 2:
        (p, q), (r, s) = faces[:, :, 0].transpose(2, 0, 1), faces[:, :, 1].transpose(2, 0, 1)
        det = p * s - q * r
        at = np.stack([sides[..., 0] * s - sides[..., 1] * q, sides[..., 1] * p - sides[..., 0] * r], axis=2)
    else:
        crossed = [np.cross(faces[:, :, i], faces[:, :, j]) for i, j in ((1, 2), (2, 0), (0, 1))]
        det = (faces[:, :, 0] * crossed[0]).sum(axis=2)
        at = sum(sides[..., i, None] * c for i, c in enumerate(crossed))
    sound = np.abs(det) > 1e-12
    at = at / np.where(sound, det, 1.0)[..., None]
    limit = b + 1e-7 * np.maximum(1.0, np.abs(b))
    set_, corner = np.nonzero(sound)
    for last in range(a.shape[1], 0, -8):  # the bounds come last; few corners are left after them
        part = slice(max(0, last - 8), last)
        keep = (np.einsum("ck,cfk->cf", at[set_, corner], a[set_, part]) <= limit[set_, part]).all(axis=1)
        set_, corner = set_[keep], corner[keep]
    real = np.zeros(sound.shape, bool)
    real[set_, corner] = True
    return at, real


def _have_points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each set {x: a x <= b} in two dimensions has a point, for rows (n, faces, 2) of length 1.

    The first four faces are a box: x0 up to, x0 from, x1 up to, x1 from.  The point that is furthest along both axes is led
    from face to face: one that it breaks bears the next point, as far as the faces before leave room on its line.
    """
    (across, down), rest = a.transpose(2, 1, 0).copy(), b.T.copy()  # face by face
    x, y, alive = rest[0].copy(), rest[2].copy(), np.ones(len(a), bool)
    for face in range(4, len(rest)):
        broken = np.flatnonzero(alive & (across[face] * x + down[face] * y > rest[face] + 1e-9))
        if not len(broken):
            continue
        p, q, limit = across[face, broken], down[face, broken], rest[face, broken]
        u, v, w = (m[:face].take(broken, axis=1) for m in (across, down, rest))
        along = v * p - u * q  # the line runs along (-q, p)
        room = w - (u * p + v * q) * limit
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = room / along
        lo = np.where(along < -1e-8, reach, -np.inf).max(axis=0)
        hi = np.where(along > 1e-8, reach, np.inf).min(axis=0)
        alive[broken] = (lo <= hi + 1e-9) & ~((np.abs(along) <= 1e-8) & (room < -1e-9 * np.maximum(1.0, np.abs(w)))).any(axis=0)
        step = np.where(p > q, hi, lo)
        x[broken], y[broken] = p * limit - q * step, q * limit + p * step
    return alive


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a corner of each set {x: a x <= b} in two dimensions is real; the last four faces are a box as ``can_bounce`` has it.

    Corners are made only where a little more or less room decides.
    """
    size = np.hypot(a[:, :, 0], a[:, :, 1])
    bare = (size == 0) & (b >= 0)  # no bound
    plain = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1) & (bare | (size > 1e-9)).all(axis=1)
    out = np.zeros(len(a), bool)
    k = np.flatnonzero(plain)
    unsure = np.flatnonzero(~plain)
    if len(k):
        bound = np.flatnonzero(~bare[k].all(axis=0))
        order = np.concatenate([bound[-4:], bound[:-4]])
        own = np.ix_(k, order)
        unit = np.where(bare[own], 1.0, size[own])
        faces, limits = a[own] / unit[:, :, None], np.where(bare[own], 1e6, b[own] / unit)
        little = 1e-4 * np.maximum(1.0, np.abs(limits))
        maybe = _have_points(faces, limits + little)
        k, faces, limits, little = k[maybe], faces[maybe], limits[maybe], little[maybe]
        sure = _have_points(faces, limits - little)
        out[k[sure]] = True
        unsure = np.concatenate([unsure, k[~sure]])
    if len(unsure):
        out[unsure] = _corners(a[unsure], b[unsure])[1].any(axis=1)
    return out


def can_bounce(jacobian: np.ndarray, before: np.ndarray, after: np.ndarray, px_per_m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the image velocities can be those of one bounce on the ground.

    The ball falls, then rises with at most RETURNS of that; along the ground it keeps one of the shares
    KEEPS, within GROUND_M_S, and moves away from the net.  Velocities may be off by TOLERANCE of their size
    and TOLERANCE_M_S.  Eliminating the vertical speeds leaves half planes for the velocity along the
    ground; they are met if one of their corners is.
    """
    n = len(y)
    if n > PIECE:
        return np.concatenate([can_bounce(*(v[k : k + PIECE] for v in (jacobian, before, after, px_per_m, y))) for k in range(0, n, PIECE)])
    out = np.isfinite(before).all(axis=1) & np.isfinite(after).all(axis=1) & np.isfinite(jacobian).all(axis=(1, 2))
    slack = [TOLERANCE * np.hypot(*v.T) + TOLERANCE_M_S * px_per_m for v in (before, after)]
    lowest, highest = VERTICAL_M_S
    undecided, good = np.flatnonzero(out), np.zeros(n, bool)

    def bounds(j, v, tol, fixed):
        """Lower and upper bounds of the vertical speed, as (constant, by x, by y) of the ground velocity."""
        dz = np.where(np.abs(j[:, :, 2]) < 1e-9, 1e-9, j[:, :, 2])
        by = -j[:, :, :2] / dz[:, :, None]
        ends = [(v + s * np.sign(dz) * tol[:, None]) / dz for s in (-1, 1)]
        sides = [np.concatenate([np.broadcast_to([[[f, 0.0, 0.0]]], (len(v), 1, 3)), np.concatenate([e[:, :, None], by], axis=2)], axis=1) for e, f in zip(ends, fixed, strict=True)]
        return sides

    for share in KEEPS:
        k = undecided
        if not len(k):
            break
        j = jacobian[k]
        low0, high0 = bounds(j, before[k], slack[0][k], (-highest, -lowest))
        kept = j.copy()
        kept[:, :, :2] *= share
        low1, high1 = bounds(kept, after[k], slack[1][k], (lowest, highest))
        pair = lambda p, q, w: (p[:, :, None, :] + w * q[:, None, :, :]).reshape(len(p), -1, 3)
        rows = np.concatenate([pair(low0, high0, -1.0), pair(low1, high1, -1.0), pair(low1, low0, RETURNS)], axis=1)  # each at most 0
        a, b = rows[:, :, 1:], -rows[:, :, 0]
        box = np.broadcast_to(np.array([[1.0, 0], [-1, 0], [0, 1], [0, -1]]), (len(k), 4, 2))
        away = y[k] >= 0
        limit = np.stack([np.full(len(k), GROUND_M_S), np.full(len(k), GROUND_M_S), np.where(away, GROUND_M_S, 0.0), np.where(away, 0.0, GROUND_M_S)], axis=1)
        met = _met(np.concatenate([a, box], axis=1), np.concatenate([b, limit], axis=1))
        good[k[met]] = True
        undecided = k[~met]
    return good


def can_touch_net(jacobian: np.ndarray, before: np.ndarray, after: np.ndarray, px_per_m: np.ndarray) -> np.ndarray:
    """Whether the image velocities can be those of a ball that meets the net: at least NET_LEAST_M_S along the court, then at most NET_KEEPS of it."""
    out = np.isfinite(before).all(axis=1) & np.isfinite(after).all(axis=1) & np.isfinite(jacobian).all(axis=(1, 2))
    k = np.flatnonzero(out)
    out = np.zeros(len(before), bool)
    if not len(k):
        return out
    ranges = []
    for v in (before[k], after[k]):
        tol = (TOLERANCE * np.hypot(*v.T) + TOLERANCE_M_S * px_per_m[k])[:, None]
        a = np.concatenate([jacobian[k], -jacobian[k], np.broadcast_to(np.concatenate([np.eye(3), -np.eye(3)]), (len(k), 6, 3))], axis=1)
        b = np.concatenate([v + tol, tol - v, np.full((len(k), 6), MAX_SPEED_M_S)], axis=1)
        at, real = _corners(a, b)
        along = at[:, :, 1]
        ranges.append((np.where(real, along, np.inf).min(axis=1), np.where(real, along, -np.inf).max(axis=1)))
    (lo0, hi0), (lo1, hi1) = ranges
    fastest = np.maximum(hi0, -lo0)
    slowest = np.maximum(0.0, np.maximum(lo1, -hi1))
    out[k] = (lo0 <= hi0) & (lo1 <= hi1) & (fastest >= NET_LEAST_M_S - 1e-7) & (slowest <= NET_KEEPS * fastest + 1e-7)
    return out


# labels ---------------------------------------------------------------------------------------------


def _flag(flags: list[str], flag: str) -> list[str]:
    return flags if flag in flags else [*flags, flag]


def nearest_hit(event: dict, hits: list[dict], px_per_m: float) -> dict | None:
    """The pose's contact within HIT_S of an event whose wrist, if seen, is within WRIST_M of it."""
    near = []
    for h in hits:
        off = abs(h["time_s"] - event["time_s"])
        seen = h["wrist_u"] is not None and h["wrist_v"] is not None
        if off <= HIT_S and (not seen or np.hypot(h["wrist_u"] - event["u"], h["wrist_v"] - event["v"]) <= WRIST_M * px_per_m):
            near.append((off, -h["confidence"], h["time_s"], h))
    return min(near, key=lambda x: x[:3])[3] if near else None


def possible(cameras: Cameras, uv: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[list[float], list[str]]:
    """Pixels a metre at each event, and what it is but for the pose: bounce, net_contact, hit or unknown_kink."""
    scale, ground = cameras.scale(uv), cameras.ground(uv)
    on_court = np.isfinite(ground).all(axis=1) & (np.abs(ground[:, 0]) <= DOUBLES_HALF + RUNOFF_M) & (np.abs(ground[:, 1]) <= HALF_LENGTH + RUNOFF_M)
    upward = on_court & (after[:, 1] - before[:, 1] < -IMPULSE_M_S * scale)
    bounce = np.zeros(len(uv), bool)
    k = np.flatnonzero(upward)
    if len(k):
        flat = np.concatenate([ground[k], np.zeros((len(k), 1))], axis=1)
        bounce[k] = can_bounce(cameras.only(k).jacobian(flat), before[k], after[k], cameras.only(k).scale_of(uv[k]), ground[k, 1])
    net = np.zeros(len(uv), bool)
    k = np.flatnonzero(~bounce & inside(uv, cameras.net_polygons(), NET_MARGIN_PX))
    at = cameras.only(k).net_points(uv[k])
    seen = np.isfinite(at).all(axis=1)
    k, at = k[seen], at[seen]
    if len(k):
        own = cameras.only(k)
        net[k] = can_touch_net(own.jacobian(at), before[k], after[k], own.focal / np.linalg.norm(at - own.cam, axis=1))
    size = [np.hypot(*v.T) for v in (before, after)]
    with np.errstate(all="ignore"):
        faster = np.where(size[0] > 0, size[1] / size[0], np.inf) >= HIT_RATIO
    floor = DIRECTION_M_S * scale
    turned = (np.abs(before[:, 0]) >= floor) & (np.abs(after[:, 0]) >= floor) & ((before[:, 0] > 0) != (after[:, 0] > 0))
    return scale.tolist(), np.select([bounce, net, faster | turned], ["bounce", "net_contact", "hit"], "unknown_kink").tolist()


def classify(events: list[dict], camera: Camera, hits: list[dict], judged: tuple[list[float], list[str]] | None = None) -> list[dict]:
    """The events with kind, end, shot_type, feet and flags: a hit of the pose, else what is ``possible``, ``judged`` before if that is given."""
    if not events:
        return []
    if judged is None:
        get = lambda *names: np.array([[e[c] for c in names] for e in events], float)
        judged = possible(Cameras([camera], np.zeros(len(events), np.int64)), get("u", "v"), get("vbx", "vby"), get("vax", "vay"))
    scale, kinds = judged
    out = []
    for j, e in enumerate(events):
        e = dict(e)
        if (h := nearest_hit(e, hits, scale[j])) is not None:
            e |= {"kind": "hit", "end": h["end"], "shot_type": h["shot_type"], "feet_u": h["feet_u"], "feet_v": h["feet_v"], "flags": _flag(e["flags"], "pose_hit")}
        else:
            e["kind"] = kinds[j]
            if e["kind"] == "bounce" and e["confidence"] < WEAK_BELOW:
                e["flags"] = _flag(e["flags"], "weak_bounce")
        out.append(e)
    return out


def merge_split(events: list[dict], camera: Camera) -> list[dict]:
    """A hit that an unknown kink follows at once in its flight, judged as one break; kept as one if that is a bounce."""
    events = sorted(events, key=lambda e: (e["flight_id"], e["time_s"], e["number"]))
    out, k = [], 0
    while k < len(events):
        a = events[k]
        b = events[k + 1] if k + 1 < len(events) else None
        if b and a["flight_id"] == b["flight_id"] and a["kind"] == "hit" and "pose_hit" not in a["flags"] and b["kind"] == "unknown_kink" and b["time_s"] - a["time_s"] <= SPLIT_S:
            flags = [f for f in [*a["flags"], *b["flags"]] if f != "one_sided_bounce"]
            (joined,) = classify([b | {"vbx": a["vbx"], "vby": a["vby"], "confidence": max(a["confidence"], b["confidence"]), "flags": flags}], camera, [])
            if joined["kind"] == "bounce":
                out.append(joined | {"flags": _flag(joined["flags"], "split_bounce_merged")})
                k += 2
                continue
        out.append(a)
        k += 1
    return out


def relabel(events: list[dict], halves: list[str | None]) -> list[dict]:
    """The cheapest labels of bounces and hits in order of time; what is sure, of the pose or of another kind stays.

    A new label costs the event's confidence, a hit after a hit HIT_AGAIN, a bounce after a bounce
    BOUNCE_AGAIN in the same half and twice that otherwise; of equals the given labels stay.
    """
    choices = []
    for e in events:
        free = e["kind"] in ("bounce", "hit") and "pose_hit" not in e["flags"] and e["confidence"] < RELABEL_BELOW
        choices.append([(e["kind"], 0.0)] + ([("hit" if e["kind"] == "bounce" else "bounce", e["confidence"])] if free else []))
    total, back = [c for _, c in choices[0]] if events else [], []
    for k in range(1, len(events)):
        again = BOUNCE_AGAIN if halves[k] is not None and halves[k - 1] == halves[k] else 2 * BOUNCE_AGAIN
        row, links = [], []
        for kind, own in choices[k]:
            cost = {("hit", "hit"): HIT_AGAIN, ("bounce", "bounce"): again}
            best = min((total[p] + cost.get((was, kind), 0.0) + own, p) for p, (was, _) in enumerate(choices[k - 1]))
            row.append(best[0])
            links.append(best[1])
        total = row
        back.append(links)
    pick = min(range(len(total)), key=lambda p: (total[p], p)) if events else 0
    picks = [pick]
    for links in reversed(back):
        picks.append(links[picks[-1]])
    out = []
    for e, own, p in zip(events, choices, reversed(picks), strict=True) if events else ():
        if p:
            flags = _flag(e["flags"], "grammar_relabelled")
            if own[p][0] == "bounce" and e["confidence"] < WEAK_BELOW:
                flags = _flag(flags, "weak_bounce")
            if own[p][0] == "hit":
                flags = [f for f in flags if f != "weak_bounce"]
            e = e | {"kind": own[p][0], "flags": flags, "end": None}
        out.append(e)
    return out


def assign_ends(events: list[dict], halves: list[str | None]) -> list[dict]:
    """Hits without an end: the half of the nearest bounce before, up to a hit, else across the net from the one after."""
    out = []
    for k, e in enumerate(events):
        if e["kind"] == "hit" and e["end"] is None:
            def first(places):
                for j in places:
                    if events[j]["kind"] == "hit":
                        return None
                    if events[j]["kind"] == "bounce" and halves[j] is not None:
                        return halves[j]
                return None

            end = first(range(k - 1, -1, -1))
            if end is None and (across := first(range(k + 1, len(events)))) is not None:
                end = "near" if across == "far" else "far"
            e = e | {"end": end}
        out.append(e)
    return out


def _halves(events: list[dict], camera: Camera) -> list[str | None]:
    ground = camera.ground(np.array([[e["u"], e["v"]] for e in events], float).reshape(-1, 2))
    return [None if not np.isfinite(y) else "near" if y < 0 else "far" for y in ground[:, 1]]


PREFIX = {"bounce": "b", "hit": "h", "net_contact": "n", "unknown_kink": "k"}
EVENT = (
    "event_id string, flight_id int, kind string, time_s double, sigma_s double, u double, v double, uu double, uv double, vv double, vbx double, vby double, "
    "vax double, vay double, confidence double, flags array<string>, end string, shot_type string, feet_u double, feet_v double"
)


def _breaks(sessions: list[dict[int, np.ndarray]]) -> list[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """The breaks of each session, by the places of its flights in order; all flights are fitted together."""
    every = [own[i] for own in sessions for i in sorted(own)]
    kept = [f[_kept(f[:, 0], f[:, 1:])] for f in every]
    ends = np.cumsum([len(k) for k in kept], dtype=np.int64)
    rows = np.concatenate([np.zeros((0, 3)), *kept])
    sizes = np.array([len(k) for k in kept], np.int64)
    flight, found = Breaks(rows[:, 0], rows[:, 1:], ends - sizes, ends, np.array([_interval(f[:, 0]) for f in every])).events()
    begins = np.cumsum([0, *(len(own) for own in sessions)])
    places = np.searchsorted(flight, begins)
    return [(flight[a:b] - begin, {c: v[a:b] for c, v in found.items()}) for a, b, begin in zip(places, places[1:], begins, strict=False)]


def session_events(flights: dict[int, np.ndarray], camera: Camera, hits: list[dict], breaks: tuple | None = None, judged: tuple | None = None) -> list[dict]:
    """All events of a session's flights (arrays of time, x, y; no place where nothing was seen), in order of time, with their ids."""
    ids = sorted(flights)
    kept = [flights[i][_kept(flights[i][:, 0], flights[i][:, 1:])] for i in ids]
    flight, found = breaks or _breaks([flights])[0]
    bare = {"end": None, "shot_type": None, "feet_u": None, "feet_v": None}
    events = []
    values, one_sided = zip(*(found[c].tolist() for c in FIELDS), strict=True), found["one_sided"].tolist()
    for j, (f, own) in enumerate(zip(flight.tolist(), values, strict=True)):
        e = dict(zip(FIELDS, own, strict=True))
        events.append(e | bare | {"flight_id": ids[f], "number": j, "flags": ["one_sided_bounce"] if one_sided[j] else []})
    events = merge_split(classify(events, camera, hits, judged), camera)
    for i, own in zip(ids, kept, strict=True):
        if len(own) < 2:
            continue
        (t0, *p0), (t1, *p1) = own[0].tolist(), own[1].tolist()
        probe = {"time_s": t0, "u": p0[0], "v": p0[1]}
        h = nearest_hit(probe, hits, float(camera.scale(np.array([p0]))[0]))
        if h is not None:
            gone = (t1 - t0) / np.sqrt(12.0)
            speed = [(b - a) / (t1 - t0) for a, b in zip(p0, p1, strict=True)]
            events.append(
                probe | {"ratio": None, "vbx": None, "vby": None, "vax": speed[0], "vay": speed[1], "sigma_s": gone, "uu": NOISE_PX**2, "uv": 0.0, "vv": NOISE_PX**2, "confidence": h["confidence"]}
                | {"kind": "hit", "flight_id": i, "number": -1, "flags": ["flight_start", "pose_hit"], "end": h["end"], "shot_type": h["shot_type"], "feet_u": h["feet_u"], "feet_v": h["feet_v"]}
            )
    events.sort(key=lambda e: (e["time_s"], e["flight_id"], e["number"]))
    halves = _halves(events, camera)
    events = assign_ends(relabel(events, halves), halves)
    return [e | {"event_id": f"{PREFIX[e['kind']]}_{k:06d}"} for k, e in enumerate(events)]


HIT_COLUMNS = ("time_s", "wrist_u", "wrist_v", "end", "confidence", "shot_type", "feet_u", "feet_v")


def detect(flights: DataFrame, maps: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """(key, event_id, flight_id, kind, ...): bounces, hits, net contacts and unknown kinks of each session's flights, in order of time.

    ``flights``: key, flight_id, time_s, x, y as ``flights.link`` gives them; ``maps`` as court_maps gives them;
    ``hits``: the pose's contacts, with key, time_s, wrist_u, wrist_v, end, confidence, shot_type, feet_u and feet_v.
    Breaks are classed by the camera's geometry; a hit and a kink that are one bounce are joined; a hit of
    the pose at a flight's first sample starts it; unsure labels are set by the order of play; hits get the end
    that they come from.  Sessions without a map have no events; hits without a time, and with a null
    confidence, count as none and as 0.  A session is one group, bounded by what a recording can hold.
    """
    kind = dict(flights.dtypes)[key]
    flown = flights.select(key, "flight_id", F.col("time_s").cast("double").alias("time_s"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    flown = flown.where("flight_id is not null and time_s is not null")
    mapped = maps.select(key, "h", "projection", "cam_x", "cam_y", "cam_z", "focal_px")  # the rows without a time
    contacts = hits.where("time_s is not null and not isnan(time_s)").select(key, *HIT_COLUMNS)
    names = [key, *(x.split()[0] for x in EVENT.split(", "))]

    clean = lambda v: None if v is None or v != v else v

    def parts(both: dict[str, np.ndarray]) -> tuple[dict[int, np.ndarray], Camera | None, list[dict]]:
        """Flights, camera and hits of a session."""
        time, ids = both["time_s"].astype(float), both["flight_id"].astype(float)
        still, flown = np.isnan(time), ~np.isnan(ids)
        known, flying = np.flatnonzero(still), np.flatnonzero(flown)
        if not len(known) or not len(flying):
            return {}, None, []
        x, y, ids = both["x"].astype(float)[flying], both["y"].astype(float)[flying], ids[flying].astype(np.int64)
        order = np.lexsort((y, x, time[flying], ids))
        rows, ids = np.stack([time[flying], x, y], axis=1)[order], ids[order]
        begins = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)).tolist()
        flights = {int(ids[a]): rows[a:b] for a, b in zip(begins, [*begins[1:], len(ids)], strict=True)}
        h, projection, *cam, focal = (both[c][known[0]] for c in ("h", "projection", "cam_x", "cam_y", "cam_z", "focal_px"))
        contact = np.flatnonzero(~still & ~flown)
        columns = [[clean(v) for v in both[c][contact].tolist()] for c in HIT_COLUMNS]
        hits = [dict(zip(HIT_COLUMNS, row, strict=True)) for row in zip(*columns, strict=True)]
        return flights, Camera(h, projection, cam, focal), [h | {"confidence": h["confidence"] or 0.0} for h in hits]

    def many(sessions: list[dict[str, np.ndarray]]) -> list[dict]:
        held = [(both[key][0], *parts(both)) for both in sessions]
        held = [x for x in held if x[1]]
        if not held:
            return []
        breaks = _breaks([flights for _, flights, _, _ in held])
        sizes = [len(flight) for flight, _ in breaks]
        get = lambda *names: np.stack([np.concatenate([found[c] for _, found in breaks]) for c in names], axis=1)
        cameras = Cameras([camera for _, _, camera, _ in held], np.repeat(np.arange(len(held)), sizes))
        scale, kinds = possible(cameras, get("u", "v"), get("vbx", "vby"), get("vax", "vay"))
        out: dict[str, list] = {c: [] for c in names}
        at = 0
        for (label, flights, camera, hits), size, own in zip(held, sizes, breaks, strict=True):
            events = session_events(flights, camera, hits, own, (scale[at : at + size], kinds[at : at + size]))
            at += size
            for c in names[1:]:
                out[c] += [e[c] for e in events]
            out[key] += [label] * len(events)
        return [out]

    rows = flown.unionByName(contacts, allowMissingColumns=True).unionByName(mapped, allowMissingColumns=True)
    return by_keys(rows, key, [], many, f"`{key}` {kind}, {EVENT}", GATHERED, arrays=True)
