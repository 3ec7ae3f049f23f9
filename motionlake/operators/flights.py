"""Ball flights out of the candidates of every frame of a clip.

Many tracks grow at once.  A track steps to the candidate nearest to where its last points lead; a
candidate belongs to one track only.  New tracks and those that jumped are on trial until some more
points lie on one curve, and lose what they took when the trial fails.
"""

from __future__ import annotations

from math import atan2, degrees, hypot, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.operators.ball import GATE_SHRINK, MAX_SPEED_M_S, MIN_EXTENT_PX, PER_FRAME, STEP_SAFETY, STITCH_GAP_S, STREAK_DEG
from motionlake.operators.fits import SMOOTH_PX, smooth
from motionlake.operators.groups import by_keys

#: Least gate in pixels, points that a step is led by, and the shape of a streak.
LEAST_GATE_PX, LED_BY, STREAK_ASPECT, STREAK_MINOR_PX = 4.0, 5, 1.6, 3.0
#: Seconds without a detection that a track outlives, detections of a flight, fewer below a frame rate.
COAST_S, DETECTIONS, DETECTIONS_SLOW, SLOW_FPS = 0.1, 6, 4, 45.0
#: Third points tried for a seed, points of a trial, and the acceleration that passes it.
SEED_THIRDS, TRIAL, MAX_M_S2, NOISE_PX_PER_FRAME2 = 4, 6, 600.0, 3.0
#: Products of tracks and candidates, or of three frames' candidates, up to which numbers one by one are faster than arrays.
FEW = 64
#: Candidates of a frame and open tracks of a clip up to which clips are linked side by side, clips that are at least, and their rows.
PER_FRAME_FEW, SLOTS, SIDE_BY_SIDE, GATHERED = 4, 8, 10, 400_000
_EPS = 1e-9


def parabola(u: list[float], v: list[float], w: list[float]) -> tuple[float, ...]:
    """Coefficients of v, then of w, by the least squares of three samples or more, lowest first."""
    n, a, b, c, d = float(len(u)), 0.0, 0.0, 0.0, 0.0
    v0 = v1 = v2 = w0 = w1 = w2 = 0.0
    for t, x, y in zip(u, v, w, strict=True):
        q = t * t
        a += t
        b += q
        c += q * t
        d += q * q
        v0 += x
        v1 += t * x
        v2 += q * x
        w0 += y
        w1 += t * y
        w2 += q * y
    i00, i01, i02, i11, i12, i22 = b * d - c * c, b * c - a * d, a * c - b * b, n * d - b * b, a * b - n * c, n * b - a * a
    det = n * i00 + a * i01 + b * i02
    return (
        (i00 * v0 + i01 * v1 + i02 * v2) / det, (i01 * v0 + i11 * v1 + i12 * v2) / det, (i02 * v0 + i12 * v1 + i22 * v2) / det,
        (i00 * w0 + i01 * w1 + i02 * w2) / det, (i01 * w0 + i11 * w1 + i12 * w2) / det, (i02 * w0 + i12 * w1 + i22 * w2) / det,
    )


class Scale:
    """Pixels a metre, across the line of sight, of what is seen before a point of the ground."""

    def __init__(self, h: list[float], cam: tuple[float, float, float], focal: float):
        self.h, self.cam, self.focal = np.asarray(h, float).reshape(3, 3), cam, focal
        self.rows = self.h.tolist()

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            ground = self.h @ np.stack([x, y, np.ones_like(x)])
            far = np.sqrt((ground[0] / ground[2] - self.cam[0]) ** 2 + (ground[1] / ground[2] - self.cam[1]) ** 2 + self.cam[2] ** 2)
            return np.nan_to_num(self.focal / far, nan=0.0, posinf=0.0)

    def one(self, x: float, y: float) -> float:
        """The same of one place."""
        (a, b, c), (d, e, f), (g, h, i) = self.rows
        w = g * x + h * y + i
        if w == 0:
            return 0.0
        far = sqrt(((a * x + b * y + c) / w - self.cam[0]) ** 2 + ((d * x + e * y + f) / w - self.cam[1]) ** 2 + self.cam[2] ** 2)
        return self.focal / far if far > 0 else 0.0


class Track:
    """Candidates in the order of time; ``led_from`` and ``trial_from`` are places in them, ``curve`` is where the last ones lead."""

    def __init__(self, points: list[int]):
        self.points, self.led_from, self.trial_from = points, 0, 0
        self.may_jump, self.proven, self.open = True, False, True
        self.curve: tuple[float, ...] | None = None

    def step(self, candidate: int) -> None:
        self.points.append(candidate)
        self.may_jump, self.curve = True, None

    def jump(self, candidate: int) -> None:
        """A step that does not follow from the last ones: they lead no more, and what follows is on trial."""
        self.led_from = len(self.points) - 1
        if self.proven:
            self.proven, self.trial_from = False, len(self.points)
        self.points.append(candidate)
        self.may_jump, self.curve = False, None

    def fail(self) -> list[int]:
        """Gives back what is on trial; the track ends before it, if anything is left."""
        lost, self.points = self.points[self.trial_from :], self.points[: self.trial_from]
        self.proven, self.open = True, False
        return lost


class Linker:
    """The candidates of one clip as columns in the order of frames, and its tracks."""

    def __init__(self, times: np.ndarray, frame: np.ndarray, columns: dict[str, np.ndarray], scale):
        self.times, self.frame, self.scale = times, frame, scale
        self.xy = np.stack([columns["x"], columns["y"]], axis=1)
        self.at = times[frame] if len(frame) else np.zeros(0)
        minor, major = columns["minor"], columns["major"]
        self.streak, self.axis = (minor >= STREAK_MINOR_PX) & (major >= STREAK_ASPECT * minor), columns["orientation_deg"]
        self.px_per_m = scale(*self.xy.T)
        gaps = np.diff(times)
        self.dt = float(np.median(gaps)) if len(gaps) else 0.0
        self.least = DETECTIONS if self.dt > 0 and 1 / self.dt >= SLOW_FPS else DETECTIONS_SLOW
        self.trial = min(TRIAL, self.least)
        self.begin = np.searchsorted(frame, np.arange(len(times) + 1)).tolist()
        self.unused = bytearray(b"\1" * len(frame))
        self.free = np.frombuffer(self.unused, bool)  # the same bytes
        self.clock, self.when, self.scales = times.tolist(), self.at.tolist(), self.px_per_m.tolist()
        self.xs, self.ys, self.streaks, self.axes = self.xy[:, 0].tolist(), self.xy[:, 1].tolist(), self.streak.tolist(), self.axis.tolist()
        self.tracks: list[Track] = []

    def along(self, candidates: np.ndarray, origin: np.ndarray) -> np.ndarray:
        """Whether a streak lies along the step to it; anything round does, as does what does not move."""
        step = self.xy[candidates] - origin
        off = np.abs((self.axis[candidates] - np.degrees(np.arctan2(step[..., 1], step[..., 0]))) % 180.0)
        return ~self.streak[candidates] | ~step.any(axis=-1) | (np.minimum(off, 180.0 - off) <= STREAK_DEG)

    def lead(self, tracks: list[Track], now: float) -> np.ndarray:
        """Where the last points of each track lead at a time: a quadratic, or less for fewer points."""
        own = [t.points[t.led_from :][-LED_BY:] for t in tracks]
        n = np.array([len(p) for p in own])
        at = np.array([p + [p[-1]] * (LED_BY - len(p)) for p in own])
        inside = np.arange(LED_BY) < n[:, None]
        last = self.at[at[:, -1]]
        s = (self.at[at] - last[:, None]) / (now - last)[:, None]
        basis = np.stack([np.ones_like(s), s, s * s], axis=2) * (inside[:, :, None] & (np.arange(3) < n[:, None, None]))
        normal = basis.transpose(0, 2, 1) @ basis
        normal[:, range(3), range(3)] += np.arange(3) >= n[:, None]  # degrees that are not there
        return np.linalg.solve(normal, basis.transpose(0, 2, 1) @ self.xy[at]).sum(axis=1)  # the next frame is 1 on that clock

    def along_one(self, c: int, x: float, y: float) -> bool:
        """The same of one candidate."""
        if not self.streaks[c]:
            return True
        dx, dy = self.xs[c] - x, self.ys[c] - y
        if dx == 0 and dy == 0:
            return True
        off = abs(self.axes[c] - degrees(atan2(dy, dx))) % 180.0
        return min(off, 180.0 - off) <= STREAK_DEG

    def lead_one(self, track: Track, now: float) -> tuple[float, float]:
        """The same of one track."""
        end = track.points[-1]
        last, x, y = self.when[end], self.xs[end], self.ys[end]
        if track.curve is None:
            own = track.points[max(track.led_from, len(track.points) - LED_BY) :]
            if len(own) >= 3:
                track.curve = parabola([(self.when[p] - last) / self.dt for p in own], [self.xs[p] - x for p in own], [self.ys[p] - y for p in own])
            elif len(own) == 2:
                s = (self.when[own[0]] - last) / self.dt
                track.curve = (0.0, (self.xs[own[0]] - x) / s, 0.0, 0.0, (self.ys[own[0]] - y) / s, 0.0)
            else:
                track.curve = (0.0,) * 6
        a, b, c, d, e, f = track.curve
        s = (now - last) / self.dt
        return x + a + s * (b + s * c), y + d + s * (e + s * f)

    def fitted(self, points: list[int]) -> tuple[list[float], list[float], list[float], tuple[float, ...], float]:
        """Samples from the first one's place, on a clock from it that ends at 1, their parabolas, and the clock's unit."""
        t, x, y = self.when[points[0]], self.xs[points[0]], self.ys[points[0]]
        span = self.when[points[-1]] - t
        u, v, w = [(self.when[p] - t) / span for p in points], [self.xs[p] - x for p in points], [self.ys[p] - y for p in points]
        return u, v, w, parabola(u, v, w), span

    def on_one_curve(self, points: list[int]) -> bool:
        if len(points) < 3:
            return True
        u, v, w, (a, b, c, d, e, f), _ = self.fitted(points)
        left = sum((a + s * (b + s * c) - x) ** 2 + (d + s * (e + s * f) - y) ** 2 for s, x, y in zip(u, v, w, strict=True))
        return sqrt(left / len(points)) <= SMOOTH_PX

    def can_fly(self, points: list[int]) -> bool:
        """Whether the acceleration in the image is one that a ball can have there."""
        _, _, _, (_, _, c, _, _, f), span = self.fitted(points)
        x, y = (sum(v[p] for p in points) / len(points) for v in (self.xs, self.ys))
        limit = MAX_M_S2 * self.scale.one(x, y) + (NOISE_PX_PER_FRAME2 / self.dt**2 if self.dt > 0 else 0.0)
        return 2.0 * hypot(c, f) / span**2 <= limit

    def offers(self, tracks: list[int], near: np.ndarray, cost: np.ndarray, first: int):
        """(track, candidate) by cost, then track, then candidate."""
        row, column = np.nonzero(near)
        for k in np.lexsort((column, row, cost[row, column])):
            yield tracks[row[k]], first + int(column[k])

    def offers_of_few(self, live: list[int], frame: int) -> list[tuple[bool, list, list]]:
        """For proven tracks and for others, if there are any: steps and jumps as (cost, track, candidate)."""
        now, here = self.clock[frame], range(self.begin[frame], self.begin[frame + 1])
        tiers: tuple = ((True, [], []), (False, [], []))
        for k in live:
            track = self.tracks[k]
            end = track.points[-1]
            x, y = self.xs[end], self.ys[end]
            reach = MAX_SPEED_M_S * STEP_SAFETY * self.scales[end] * (now - self.when[end])
            gate = max(LEAST_GATE_PX, GATE_SHRINK * reach)
            ahead_x, ahead_y = self.lead_one(track, now)
            _, steps, jumps = tiers[not track.proven]
            for c in here:
                cost = hypot(self.xs[c] - ahead_x, self.ys[c] - ahead_y)
                step, jump = cost <= gate, track.may_jump and hypot(self.xs[c] - x, self.ys[c] - y) <= reach
                if (step or jump) and self.along_one(c, x, y):
                    if step:
                        steps.append((cost, k, c))
                    if jump:
                        jumps.append((cost, k, c))
        return [(proven, sorted(steps), sorted(jumps)) for proven, steps, jumps in tiers]

    def extend(self, live: list[int], frame: int) -> list[int]:
        """Steps and jumps of the tracks ``live`` to the frame's candidates; those that moved, in that order."""
        first, beyond = self.begin[frame], self.begin[frame + 1]
        if first == beyond or not live:
            return []
        moved: list[int] = []
        done: set[int] = set()

        def take(k: int, c: int, how) -> None:
            how(c)
            self.unused[c] = 0
            done.add(k)
            moved.append(k)

        def steps(offers) -> None:
            for k, c in offers:
                track = self.tracks[k]
                if k in done or not self.unused[c]:
                    continue
                if track.proven and len(track.points) - track.led_from >= LED_BY and not self.on_one_curve([*track.points[-LED_BY:], c]):
                    continue
                take(k, c, track.step)

        def jumps(offers) -> None:
            for k, c in offers:
                if k not in done and self.unused[c]:
                    take(k, c, self.tracks[k].jump)

        if len(live) * (beyond - first) <= FEW:
            for _, near, far in self.offers_of_few(live, frame):
                steps((k, c) for _, k, c in near)
                jumps((k, c) for _, k, c in far)
            return moved
        here = np.arange(first, beyond)
        own = [self.tracks[k] for k in live]
        ends = np.array([t.points[-1] for t in own])
        reach = MAX_SPEED_M_S * STEP_SAFETY * self.px_per_m[ends] * (self.times[frame] - self.at[ends])
        ahead = self.lead(own, self.times[frame])
        cost = np.hypot(*(self.xy[here][None] - ahead[:, None]).transpose(2, 0, 1))
        far = np.hypot(*(self.xy[here][None] - self.xy[ends][:, None]).transpose(2, 0, 1))
        along = self.along(here[None].repeat(len(own), 0), self.xy[ends][:, None])
        for proven in (True, False):
            tier = np.array([t.proven is proven for t in own])
            gate = np.maximum(LEAST_GATE_PX, GATE_SHRINK * reach)[:, None]
            steps(self.offers(live, tier[:, None] & along & (cost <= gate), cost, first))
            may = tier & np.array([t.may_jump and k not in done for k, t in zip(live, own, strict=True)])
            jumps(self.offers(live, may[:, None] & along & (far <= reach[:, None]), cost, first))
        return moved

    def seeds_of_few(self, first: list[int], second: list[int], third: list[int], frame: int) -> list[tuple[float, int, int, int]]:
        """(distance from the straight line, candidates), one for each pair of the first two frames at most."""
        t0, t1, t2 = self.clock[frame - 2 : frame + 1]
        xs, ys, found = self.xs, self.ys, []
        for a in first:
            reach = MAX_SPEED_M_S * STEP_SAFETY * self.scales[a]
            step = reach * (t2 - t1)
            gate = max(LEAST_GATE_PX, GATE_SHRINK * step)
            for b in second:
                dx, dy = xs[b] - xs[a], ys[b] - ys[a]
                if hypot(dx, dy) > reach * (t1 - t0) or not self.along_one(b, xs[a], ys[a]):
                    continue
                x, y = xs[b] + dx * ((t2 - t1) / (t1 - t0)), ys[b] + dy * ((t2 - t1) / (t1 - t0))
                for off, c in sorted((hypot(xs[c] - x, ys[c] - y), c) for c in third)[:SEED_THIRDS]:
                    if off <= gate and hypot(xs[c] - xs[b], ys[c] - ys[b]) <= step and self.along_one(c, xs[b], ys[b]):
                        found.append((off, a, b, c))  # the nearest that will do
                        break
        return found

    def seeds(self, frame: int) -> None:
        """New tracks out of free candidates of three frames in a row, the straightest first."""
        few = [[c for c in range(self.begin[f], self.begin[f + 1]) if self.unused[c]] for f in (frame, frame - 1, frame - 2)]
        if not all(few):
            return
        third, second, first = few
        found = self.seeds_of_few(first, second, third, frame) if len(first) * len(second) * len(third) <= FEW else self.seeds_of_many(*map(np.array, (first, second, third)), frame)
        for _, a, b, c in sorted(found):
            if self.unused[a] and self.unused[b] and self.unused[c]:
                self.unused[a] = self.unused[b] = self.unused[c] = 0
                self.tracks.append(Track([a, b, c]))

    def seeds_of_many(self, first: np.ndarray, second: np.ndarray, third: np.ndarray, frame: int) -> list[tuple[float, int, int, int]]:
        """The same with arrays."""
        t0, t1, t2 = self.times[frame - 2 : frame + 1]
        reach = MAX_SPEED_M_S * STEP_SAFETY * self.px_per_m[first]
        far = np.hypot(*(self.xy[second][None] - self.xy[first][:, None]).transpose(2, 0, 1))
        ok = (far <= reach[:, None] * (t1 - t0)) & self.along(second[None].repeat(len(first), 0), self.xy[first][:, None])
        found = []
        rows, columns = np.nonzero(ok)
        for lo in range(0, len(rows), 4096):
            i, a, b = rows[lo : lo + 4096], first[rows[lo : lo + 4096]], second[columns[lo : lo + 4096]]
            ahead = self.xy[b] + (self.xy[b] - self.xy[a]) * ((t2 - t1) / (t1 - t0))
            off = np.hypot(*(self.xy[third][None] - ahead[:, None]).transpose(2, 0, 1))
            near = np.argsort(off, axis=1, kind="stable")[:, :SEED_THIRDS]
            c, off = third[near], np.take_along_axis(off, near, axis=1)
            step = reach[i][:, None] * (t2 - t1)
            good = (np.hypot(*(self.xy[c] - self.xy[b][:, None]).transpose(2, 0, 1)) <= step) & self.along(c, self.xy[b][:, None]) & (off <= np.maximum(LEAST_GATE_PX, GATE_SHRINK * step))
            any_ = good.any(axis=1)
            best = np.argmax(good, axis=1)  # the nearest that will do
            pick = np.arange(len(i))
            found += zip(off[pick, best][any_].tolist(), a[any_].tolist(), b[any_].tolist(), c[pick, best][any_].tolist(), strict=True)
        return found

    def run(self) -> None:
        active: list[int] = []
        for frame, now in enumerate(self.clock):
            live = []
            for k in active:
                track = self.tracks[k]
                if now - self.when[track.points[-1]] - self.dt <= COAST_S + _EPS:
                    live.append(k)
                elif track.proven:
                    track.open = False
                else:
                    track.fail()
            for k in self.extend(live, frame):
                track = self.tracks[k]
                if not track.proven and len(track.points) - track.trial_from >= self.trial:
                    tried = track.points[track.trial_from :]
                    if self.on_one_curve(tried) and self.can_fly(tried):
                        track.proven = True
                    else:  # what a failed trial took in the last three frames may seed again
                        lost = np.array(track.fail())
                        self.free[lost[self.frame[lost] >= frame - 2]] = True
            if frame >= 2:
                known = len(self.tracks)
                self.seeds(frame)
                live += range(known, len(self.tracks))
            active = [k for k in live if self.tracks[k].open]
        for k in active:
            if not self.tracks[k].proven:
                self.tracks[k].fail()

    def chains(self, pieces: list[list[int]]) -> list[list[int]]:
        """Pieces joined end to start, one to one, by gap, then distance."""
        starts, ends = (np.array([p[k] for p in pieces], np.int64) for k in (0, -1))
        order = np.argsort(self.at[starts], kind="stable")
        lows, highs = (np.searchsorted(self.at[starts[order]], self.at[ends] + later, "right").tolist() for later in (0.0, STITCH_GAP_S + self.dt + _EPS))
        options, order, begins = [], order.tolist(), starts.tolist()
        for a, (end, lo, hi) in enumerate(zip(ends.tolist(), lows, highs, strict=True)):
            for b in order[lo:hi]:
                gap = self.when[begins[b]] - self.when[end]
                far = hypot(self.xs[begins[b]] - self.xs[end], self.ys[begins[b]] - self.ys[end])
                if b != a and gap > 0 and gap - self.dt <= STITCH_GAP_S + _EPS and far <= MAX_SPEED_M_S * STEP_SAFETY * self.scales[end] * gap:
                    options.append((gap, far, a, b))
        after, before = {}, {}
        for _, _, a, b in sorted(options):
            if a not in after and b not in before:
                after[a], before[b] = b, a
        out = []
        for head in range(len(pieces)):
            if head not in before:
                chain = [head]
                while chain[-1] in after:
                    chain.append(after[chain[-1]])
                out.append(chain)
        return out

    def pieces(self) -> list[list[int]]:
        """Candidates of each track that is left."""
        return [t.points for t in self.tracks if t.points]

    def flights(self) -> list[list[int]]:
        """Candidates of each flight, by its first sample."""
        return flights([self])[0]


class Together:
    """Clips whose frames have few candidates, linked side by side: what ``Linker.run`` does for one, frame by frame for all.

    A track is a place among its clip's SLOTS, and its candidates are chained from the last one back.  A clip in
    which more tracks are open at a time is left to ``Linker.run``.
    """

    def __init__(self, clips: list[Linker]):
        self.clips = sorted(clips, key=lambda c: -len(c.times))
        frames, found = np.array([len(c.times) for c in self.clips]), np.array([len(c.at) for c in self.clips])
        self.longest, self.ends = int(frames.max()), np.sort(frames)
        join = lambda f: np.concatenate([f(c) for c in self.clips])
        self.first_time, self.offset = np.cumsum(frames) - frames, np.cumsum(found) - found
        self.times, self.begin = join(lambda c: c.times), join(lambda c: c.begin[:-1]) + np.repeat(self.offset, frames)
        self.beyond = join(lambda c: c.begin[1:]) + np.repeat(self.offset, frames)
        # one candidate more, which is nobody's
        more = lambda v: np.append(v, v.dtype.type(0))
        self.x, self.y = more(join(lambda c: c.xy[:, 0])), more(join(lambda c: c.xy[:, 1]))
        self.when, self.scale, self.streak, self.axis = more(join(lambda c: c.at)), more(join(lambda c: c.px_per_m)), more(join(lambda c: c.streak)), more(join(lambda c: c.axis))
        self.frame = more(join(lambda c: c.frame))
        self.unused = np.ones(len(self.x), bool)
        self.back = np.full(len(self.x), -1)
        self.dt, self.trial = np.array([c.dt for c in self.clips]), np.array([c.trial for c in self.clips])
        self.h, self.cam, self.focal = np.array([c.scale.h for c in self.clips]), np.array([c.scale.cam for c in self.clips], float), np.array([c.scale.focal for c in self.clips])
        n = len(self.clips)
        whole = lambda: np.zeros((n, SLOTS), np.int64)
        self.open, self.proven, self.may_jump = (np.zeros((n, SLOTS), bool) for _ in range(3))
        # of each track: its number, last candidate, how many it has, how many lead, how many are on trial, and the one before these
        self.number, self.last, self.count, self.led, self.tried, self.before = (whole() for _ in range(6))
        self.known, self.crowded = np.zeros(n, np.int64), np.zeros(n, bool)
        self.closed: list[tuple[np.ndarray, ...]] = []

    def trail(self, last: np.ndarray, n: int) -> np.ndarray:
        """The last ``n`` candidates up to ``last``, oldest first; whatever comes after the first has been passed."""
        out = np.empty((n, len(last)), np.int64)
        for k in range(n - 1, -1, -1):
            out[k] = last
            last = self.back[last]
        return out

    def along(self, c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        streak = self.streak[c]
        if not streak.any():
            return ~streak
        dx, dy = self.x[c] - x, self.y[c] - y
        off = np.abs(self.axis[c] - np.degrees(np.arctan2(dy, dx))) % 180.0
        return ~streak | ((dx == 0) & (dy == 0)) | (np.minimum(off, 180.0 - off) <= STREAK_DEG)

    def leads(self, clip: np.ndarray, last: np.ndarray, led: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``Linker.lead_one`` of many tracks."""
        x, y, end, dt = self.x[last], self.y[last], self.when[last], self.dt[clip]
        own = self.trail(last, LED_BY)
        inside = np.arange(LED_BY)[:, None] >= LED_BY - led
        u = np.where(inside, (self.when[own] - end) / dt, 0.0)
        v, w = np.where(inside, self.x[own] - x, 0.0), np.where(inside, self.y[own] - y, 0.0)
        a, b, c, d, e, f = _parabolas(u, v, w, np.minimum(led, LED_BY))
        two, s = led == 2, (now - end) / dt
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = v[-2] / u[-2], w[-2] / u[-2]
        a, b, c, d, e, f = (np.where(led >= 3, z, np.where(two, line, 0.0)) for z, line in zip((a, b, c, d, e, f), (0.0, slope[0], 0.0, 0.0, slope[1], 0.0), strict=True))
        return x + a + s * (b + s * c), y + d + s * (e + s * f)

    def curves(self, own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Whether the last ``n`` of candidates (samples, tracks) lie on one curve, and twice its acceleration's half."""
        most = len(own)
        inside = np.arange(most)[:, None] >= most - n
        start = own[most - n, np.arange(own.shape[1])]
        t, span = self.when[start], self.when[own[-1]] - self.when[start]
        u = np.where(inside, (self.when[own] - t) / span, 0.0)
        v, w = np.where(inside, self.x[own] - self.x[start], 0.0), np.where(inside, self.y[own] - self.y[start], 0.0)
        a, b, c, d, e, f = _parabolas(u, v, w, n)
        left = np.where(inside, (a + u * (b + u * c) - v) ** 2 + (d + u * (e + u * f) - w) ** 2, 0.0).sum(axis=0)
        return np.sqrt(left / n) <= SMOOTH_PX, 2.0 * np.hypot(c, f) / span**2

    def can_fly(self, clip: np.ndarray, own: np.ndarray, n: np.ndarray, acceleration: np.ndarray) -> np.ndarray:
        inside = np.arange(len(own))[:, None] >= len(own) - n
        x, y = (np.where(inside, v[own], 0.0).sum(axis=0) / n for v in (self.x, self.y))
        h, cam = self.h[clip], self.cam[clip]
        with np.errstate(all="ignore"):
            g = [h[:, k, 0] * x + h[:, k, 1] * y + h[:, k, 2] for k in range(3)]
            far = np.sqrt((g[0] / g[2] - cam[:, 0]) ** 2 + (g[1] / g[2] - cam[:, 1]) ** 2 + cam[:, 2] ** 2)
            scale = np.where((g[2] != 0) & (far > 0), self.focal[clip] / far, 0.0)
        return acceleration <= MAX_M_S2 * scale + NOISE_PX_PER_FRAME2 / self.dt[clip] ** 2

    def close(self, clip: np.ndarray, slot: np.ndarray) -> None:
        """Ends tracks; what is on trial is given back."""
        own = clip, slot
        kept, on_trial = self.proven[own], self.tried[own]
        self.closed.append((clip, self.number[own], np.where(kept, self.last[own], self.before[own]), self.count[own] - np.where(kept, 0, on_trial)))
        self.open[own] = False

    def take(self, clip: np.ndarray, slot: np.ndarray, c: np.ndarray, jump: bool) -> None:
        own = clip, slot
        end = self.last[own]
        if jump:
            proven = self.proven[own]
            self.before[own] = np.where(proven, end, self.before[own])
            self.tried[own] = np.where(proven, 1, self.tried[own] + 1)
            self.led[own], self.proven[own] = 2, False
        else:
            self.tried[own] += 1
            self.led[own] += 1
        self.may_jump[own] = not jump
        self.back[c] = end
        self.last[own] = c
        self.count[own] += 1
        self.unused[c] = False

    def extend(self, n: int, frame: int, now: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``Linker.extend`` of the first ``n`` clips; the tracks that moved."""
        clip, slot = np.nonzero(self.open[:n] & (here[:, 0] < len(self.x) - 1)[:, None])
        if not len(clip):
            return clip, slot
        last, led, time = self.last[clip, slot], self.led[clip, slot], now[clip]
        x, y = self.x[last], self.y[last]
        reach = MAX_SPEED_M_S * STEP_SAFETY * self.scale[last] * (time - self.when[last])
        gate = np.maximum(LEAST_GATE_PX, GATE_SHRINK * reach)
        ahead_x, ahead_y = self.leads(clip, last, led, time)
        c = here[clip]
        cost = np.hypot(self.x[c] - ahead_x[:, None], self.y[c] - ahead_y[:, None])
        good = (c < len(self.x) - 1) & self.along(c, x[:, None], y[:, None])
        step = good & (cost <= gate[:, None])
        jump = good & self.may_jump[clip, slot][:, None] & (np.hypot(self.x[c] - x[:, None], self.y[c] - y[:, None]) <= reach[:, None])
        proven, moved = self.proven[clip, slot], np.zeros(len(clip), bool)
        for tier in (proven, ~proven):
            for offers, jumps in ((step, False), (jump, True)):
                row, column = np.nonzero(offers & (tier & ~moved)[:, None])
                if not len(row):
                    continue
                # offers by clip, then cost, track and candidate: the first of each clip is taken, until none is left
                order = np.lexsort((column, self.number[clip[row], slot[row]], cost[row, column], clip[row]))
                row, column = row[order], column[order]
                while True:
                    fresh = self.unused[c[row, column]] & ~moved[row]
                    row, column = row[fresh], column[fresh]
                    if not len(row):
                        break
                    first = np.flatnonzero(np.diff(clip[row], prepend=-1))
                    r, k = row[first], c[row[first], column[first]]
                    fine = np.ones(len(r), bool)
                    if not jumps and tier is proven:
                        asked = np.flatnonzero(led[r] >= LED_BY)
                        if len(asked):
                            own = np.concatenate([self.trail(last[r[asked]], LED_BY), k[asked][None]])
                            fine[asked] = self.curves(own, np.full(len(asked), LED_BY + 1))[0]
                    moved[r[fine]] = True
                    self.take(clip[r[fine]], slot[r[fine]], k[fine], jumps)
                    rest = np.ones(len(row), bool)
                    rest[first] = False
                    row, column = row[rest], column[rest]
        return clip[moved], slot[moved]

    def judge(self, clip: np.ndarray, slot: np.ndarray, frame: int) -> None:
        """Tracks that have moved and are on trial for long enough."""
        due = ~self.proven[clip, slot] & (self.tried[clip, slot] >= self.trial[clip])
        clip, slot = clip[due], slot[due]
        if not len(clip):
            return
        n = self.tried[clip, slot]
        own = self.trail(self.last[clip, slot], int(n.max()))
        smooth_, acceleration = self.curves(own, n)
        good = smooth_ & self.can_fly(clip, own, n, acceleration)
        self.proven[clip[good], slot[good]] = True
        lost = own[:, ~good][np.arange(len(own))[:, None] >= len(own) - n[~good]]
        self.close(clip[~good], slot[~good])
        self.unused[lost[self.frame[lost] >= frame - 2]] = True

    def seeds(self, n: int, frame: int, places: list[np.ndarray]) -> None:
        """``Linker.seeds`` of the first ``n`` clips."""
        few = [p[:n] for p in places]
        free = [self.unused[p] & (p < len(self.x) - 1) for p in few]
        clip = np.flatnonzero(np.all([f.any(axis=1) for f in free], axis=0))
        if not len(clip):
            return
        a, b, c = (p[clip] for p in few)
        fa, fb, fc = (f[clip] for f in free)
        a, b, c = a[:, :, None, None], b[:, None, :, None], c[:, None, None, :]
        t0, t1, t2 = (self.times[self.first_time[clip] + f][:, None, None, None] for f in (frame - 2, frame - 1, frame))
        xa, ya, xb, yb, xc, yc = self.x[a], self.y[a], self.x[b], self.y[b], self.x[c], self.y[c]
        reach = MAX_SPEED_M_S * STEP_SAFETY * self.scale[a]
        step = reach * (t2 - t1)
        gate = np.maximum(LEAST_GATE_PX, GATE_SHRINK * step)
        dx, dy = xb - xa, yb - ya
        pair = fa[:, :, None, None] & fb[:, None, :, None] & (np.hypot(dx, dy) <= reach * (t1 - t0)) & self.along(np.broadcast_to(b, dx.shape), xa, ya)
        off = np.hypot(xc - (xb + dx * ((t2 - t1) / (t1 - t0))), yc - (yb + dy * ((t2 - t1) / (t1 - t0))))
        good = pair & fc[:, None, None, :] & (off <= gate) & (np.hypot(xc - xb, yc - yb) <= step) & self.along(np.broadcast_to(c, off.shape), xb, yb)
        off = np.where(good, off, np.inf)
        third = off.argmin(axis=3)
        off = off.min(axis=3).reshape(len(clip), -1)
        r, k = np.nonzero(np.isfinite(off))
        order = np.lexsort((k, off[r, k], r))
        r, k = r[order], k[order]
        i, j = k // PER_FRAME_FEW, k % PER_FRAME_FEW
        three = np.stack([a[r, i, 0, 0], b[r, 0, j, 0], c[r, 0, 0, third[r, i, j]]])
        while True:
            fresh = self.unused[three].all(axis=0)
            r, three = r[fresh], three[:, fresh]
            if not len(r):
                return
            first = np.flatnonzero(np.diff(r, prepend=-1))
            at, new = clip[r[first]], three[:, first]
            slot = self.open[at].argmin(axis=1)
            full = self.open[at, slot]
            self.crowded[at[full]] = True
            at, new, slot = at[~full], new[:, ~full], slot[~full]
            self.unused[three[:, first]] = False
            own = at, slot
            self.back[new[0]], self.back[new[1]], self.back[new[2]] = -1, new[0], new[1]
            self.open[own], self.proven[own], self.may_jump[own] = True, False, True
            self.number[own], self.last[own], self.before[own] = self.known[at], new[2], -1
            self.count[own] = self.led[own] = self.tried[own] = 3
            self.known[at] += 1

    def run(self) -> None:
        """Gives each clip its tracks."""
        nobody = len(self.x) - 1
        places: list[np.ndarray] = []
        for frame in range(self.longest):
            n = len(self.ends) - int(np.searchsorted(self.ends, frame, "right"))
            at = self.first_time[:n] + frame
            now = self.times[at]
            here = self.begin[at][:, None] + np.arange(PER_FRAME_FEW)
            here = np.where(here < self.beyond[at][:, None], here, nobody)
            last = self.when[self.last[:n]]
            clip, slot = np.nonzero(self.open[:n] & ~(now[:, None] - last - self.dt[:n, None] <= COAST_S + _EPS))
            if len(clip):
                self.close(clip, slot)
            self.judge(*self.extend(n, frame, now, here), frame)
            places = [here, *places[:2]]
            if frame >= 2:
                self.seeds(n, frame, places[::-1])
        self.close(*np.nonzero(self.open))
        clip, number, last, count = (np.concatenate(v).tolist() for v in zip(*self.closed, strict=True))
        back, offset = self.back.tolist(), self.offset.tolist()
        for c in self.clips:
            c.tracks = []
        for g, _, end, size in sorted(zip(clip, number, last, count, strict=True)):
            points = []
            for _ in range(size):
                points.append(end - offset[g])
                end = back[end]
            self.clips[g].tracks.append(Track(points[::-1]))
        for c, full in zip(self.clips, self.crowded.tolist(), strict=True):
            if full:
                c.tracks = []
                c.run()


def _parabolas(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """``parabola`` of many, (samples, tracks), 0 where there is no sample."""
    q = u * u
    a, b, c, d, v0, v1, v2, w0, w1, w2 = (x.sum(axis=0) for x in (u, q, q * u, q * q, v, u * v, q * v, w, u * w, q * w))
    i00, i01, i02, i11, i12, i22 = b * d - c * c, b * c - a * d, a * c - b * b, n * d - b * b, a * b - n * c, n * b - a * a
    det = n * i00 + a * i01 + b * i02
    with np.errstate(divide="ignore", invalid="ignore"):
        return [(i00 * p + i01 * q + i02 * r) / det if k == 0 else (i01 * p + i11 * q + i12 * r) / det if k == 1 else (i02 * p + i12 * q + i22 * r) / det for p, q, r in ((v0, v1, v2), (w0, w1, w2)) for k in range(3)]


def accepted(clips: list[Linker], flights: list[list[list[int]]]) -> list[list[bool]]:
    """Enough detections, enough extent, smooth: for the flights of each clip, all together."""
    sizes = np.array([len(f) for own in flights for f in own], np.int64)
    if not len(sizes):
        return [[] for _ in flights]
    last = np.cumsum(sizes)
    at = [np.array([c for f in own for c in f], np.int64) for own in flights]
    t, xy = (np.concatenate([v[k] for v, k in zip(values, at, strict=True)]) for values in ([c.at for c in clips], [c.xy for c in clips]))
    extent = np.hypot(*(np.maximum.reduceat(xy, last - sizes) - np.minimum.reduceat(xy, last - sizes)).T)
    ok = (sizes >= np.repeat([c.least for c in clips], [len(own) for own in flights])) & (extent >= MIN_EXTENT_PX)
    ok[ok] = smooth(t, xy, (last - sizes)[ok], last[ok])
    ends = np.cumsum([len(own) for own in flights]).tolist()
    return [ok[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]


def flights(clips: list[Linker]) -> list[list[list[int]]]:
    """Candidates of each flight of each clip, by its first sample."""
    few = sorted((c for c in clips if len(c.at) and len(c.times) >= 3 and np.diff(c.begin).max() <= PER_FRAME_FEW and np.isfinite(c.xy).all()), key=lambda c: -len(c.times))
    # those that would go on for long after the others go alone, as the rest do
    few = [c for c in few if len(c.times) <= 2 * len(few[SIDE_BY_SIDE - 1].times)] if len(few) >= SIDE_BY_SIDE else []
    if few:
        Together(few).run()
    linked = set(map(id, few))
    for c in clips:
        if id(c) not in linked:
            c.run()
    pieces = [c.pieces() for c in clips]
    chains = [c.chains(p) if p else [] for c, p in zip(clips, pieces, strict=True)]
    whole = [[[x for k in chain for x in p[k]] for chain in own] for p, own in zip(pieces, chains, strict=True)]
    good = accepted(clips, whole)
    # a joined flight that fails is judged by its pieces
    parts = [[p[k] for chain, ok in zip(own, fine, strict=True) if not ok and len(chain) > 1 for k in chain] for p, own, fine in zip(pieces, chains, good, strict=True)]
    kept = accepted(clips, parts)
    pick = lambda some, fine: [f for f, ok in zip(some, fine, strict=True) if ok]
    return [sorted(pick(w, g) + pick(p, k), key=lambda f, c=c: (c.at[f[0]], *c.xy[f[0]])) for c, w, g, p, k in zip(clips, whole, good, parts, kept, strict=True)]


_COLUMNS = ("x", "y", "minor", "major", "orientation_deg", "colour_score", "contrast")


def link(candidates: DataFrame, frames: DataFrame, maps: DataFrame, key: str, frame: str = "frame", time: str = "time_s") -> DataFrame:
    """(key, flight_id, frame, time_s, x, y, minor, detected, confidence): a row for each frame of each flight.

    ``candidates``: key, frame, x, y, minor, major, orientation_deg, colour_score, contrast.  ``frames``: key, frame and
    time of every frame, with a candidate or without.  ``maps``: h, cam_x, cam_y, cam_z and focal_px of each key, as
    court_maps gives them; a key without one has no flights.  Flights are numbered from 0 by their first
    sample; frames between detections have no place.  Confidence is the share of frames with one.

    Frames that are no later than one before them, and candidates with a null or non-finite place, with
    an unknown frame or beyond the PER_FRAME best of theirs by colour, then contrast, then place, take no
    part; other nulls count as 0.  Rows alike in every column are two candidates.  Where no scale is seen,
    steps are bounded by the least gate.  A clip is one group, bounded by what a recording can hold; a frame's
    work is the product of its candidates and the open tracks.
    """
    kinds = dict(candidates.dtypes)
    seen = frames.select(key, F.col(frame).alias("frame"), F.col(time).cast("double").alias("time_s")).where("frame is not null and not isnan(time_s) and time_s is not null")
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(None if c in ("x", "y") else 0.0)).alias(c) for c in _COLUMNS]
    found = candidates.select(key, F.col(frame).alias("frame"), *numbers).where("frame is not null and abs(x) < double('inf') and abs(y) < double('inf')")
    mapped = maps.select(key, "h", "cam_x", "cam_y", "cam_z", "focal_px", F.lit(0).cast(dict(frames.dtypes)[frame]).alias("frame"))  # whole numbers stay whole without a null
    of = lambda d, n: d.withColumn("__of", F.lit(n))
    rows = of(seen, 0).unionByName(of(found, 1), allowMissingColumns=True).unionByName(of(mapped, 2), allowMissingColumns=True)
    kind = dict(frames.dtypes)[frame]
    names = [key, "flight_id", "frame", "time_s", "x", "y", "minor", "detected", "confidence"]

    def clip(rows: dict[str, np.ndarray]) -> tuple | None:
        """The key, labels of the frames, places of the candidates, their minor axes, and the clip; none without a frame, a map or a candidate."""
        of, labels = rows["__of"], rows["frame"]
        clip, mapped = np.flatnonzero(of == 0), np.flatnonzero(of == 2)
        if not len(clip) or not len(mapped) or not (of == 1).any():
            return None
        times = rows["time_s"].astype(float)
        clip = clip[np.lexsort((times[clip], labels[clip]))]
        later = np.ones(len(clip), bool)
        later[1:] = times[clip][1:] > np.maximum.accumulate(times[clip])[:-1]
        clip = clip[later]
        new = np.ones(len(clip), bool)
        new[1:] = labels[clip][1:] != labels[clip][:-1]
        clip = clip[new]
        times, labels, taken = times[clip], labels[clip], labels
        own = np.flatnonzero(of == 1)
        at = np.minimum(np.searchsorted(labels, taken[own]), len(labels) - 1)
        own, at = own[labels[at] == taken[own]], at[labels[at] == taken[own]]
        if not len(own):
            return None
        columns = {c: rows[c].astype(float)[own] for c in _COLUMNS}
        down = lambda c: np.where(np.isnan(columns[c]), np.inf, -columns[c])
        best = np.lexsort((columns["y"], columns["x"], down("contrast"), down("colour_score"), at))
        rank = np.arange(len(best)) - np.searchsorted(at[best], at[best])
        best = best[rank < PER_FRAME]
        best = best[np.lexsort((columns["y"][best], columns["x"][best], at[best]))]
        h, *cam, focal = (rows[c][mapped[0]] for c in ("h", "cam_x", "cam_y", "cam_z", "focal_px"))
        columns = {c: v[best] for c, v in columns.items()}
        linker = Linker(times, at[best], columns, Scale(h, tuple(cam), focal))
        return rows[key][0], labels.tolist(), at[best].tolist(), columns["minor"].tolist(), linker

    def many(parts: list[dict[str, np.ndarray]]) -> list[dict]:
        clips = [c for c in map(clip, parts) if c]
        out: dict[str, list] = {c: [] for c in names}
        for (label, labels, places, minor, linker), found in zip(clips, flights([c[-1] for c in clips]), strict=True):
            for number, points in enumerate(found):
                place = {places[c]: c for c in points}
                span = range(min(place), max(place) + 1)
                own = [place.get(f) for f in span]
                out[key] += [label] * len(span)
                out["flight_id"] += [number] * len(span)
                out["frame"] += labels[span.start : span.stop]
                out["time_s"] += linker.clock[span.start : span.stop]
                for name, values in (("x", linker.xs), ("y", linker.ys), ("minor", minor)):
                    out[name] += [None if c is None else values[c] for c in own]
                out["detected"] += [c is not None for c in own]
                out["confidence"] += [len(place) / len(span)] * len(span)
        return [out]

    schema = f"`{key}` {kinds[key]}, flight_id int, frame {kind}, time_s double, x double, y double, minor double, detected boolean, confidence double"
    return by_keys(rows, key, [], many, schema, GATHERED, arrays=True)
