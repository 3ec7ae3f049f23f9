"""Fits of many stretches of image paths at once.

A stretch is a range [lo, hi) of rows of arrays that may hold any number of flights one after the
other.  Stretches of different length are padded with rows of zeros, which change no least squares.
"""

from __future__ import annotations

import numpy as np

#: The largest deviation of a smooth path in pixels, its stretch in seconds, the samples
#: that a stretch needs, those that the image of a thrown ball needs, and the duration of a long flight.
SMOOTH_PX, SMOOTH_S, SMOOTH_SAMPLES, THROWN_SAMPLES, LONG_S = 3.0, 0.25, 5, 6, 1.0
#: Stretches that are fitted together, and samples of the flights that are judged together.
TOGETHER, SAMPLES = 2048, 20_000


class Stretches:
    """Padded rows of stretches, on a clock from the stretch's first sample and scaled to its span."""

    def __init__(self, t: np.ndarray, xy: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.of = t, xy, lo, hi
        at = lo[:, None] + np.arange(int((hi - lo).max()))
        self.inside = at < hi[:, None]
        at = np.minimum(at, len(t) - 1)
        self.size = hi - lo
        self.t, self.xy = np.where(self.inside, t[at], 0.0), np.where(self.inside[:, :, None], xy[at], 0.0)
        self.start = t[lo]
        self.span = np.maximum(t[hi - 1] - self.start, 1e-9)

    def left(self, fitted: np.ndarray) -> np.ndarray:
        """The sum of squares that fitted places leave."""
        return (((fitted - self.xy) * self.inside[:, :, None]) ** 2).sum(axis=(1, 2))

    def polynomial(self, degree: np.ndarray) -> np.ndarray:
        """The sum of squares beside a polynomial of each stretch's degree, 2 at most."""
        s = np.where(self.inside, (self.t - self.start[:, None]) / self.span[:, None], 0.0)
        x, y = self.xy[:, :, 0], self.xy[:, :, 1]
        dot = lambda a, b: np.einsum("rs,rs->r", a, b)[:, None]
        known: list[np.ndarray] = []
        for d, power in enumerate((self.inside.astype(float), s, s * s)):
            for q in known + known:  # twice, for what rounding leaves
                power = power - dot(power, q) * q
            size = np.sqrt(dot(power, power))
            q = np.where((size > 1e-14) & (degree[:, None] >= d), power / np.maximum(size, 1e-14), 0.0)
            x, y = x - dot(x, q) * q, y - dot(y, q) * q
            known.append(q)
        return (dot(x, x) + dot(y, y))[:, 0]

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A clock from -1 to 1 about the mean time, places about their mean, and the size and mean of the latter."""
        n = self.size[:, None]
        t = np.where(self.inside, self.t - self.t.sum(axis=1, keepdims=True) / n, 0.0)
        t = t / np.maximum(np.abs(t).max(axis=1, keepdims=True), 1e-9)
        mean = self.xy.sum(axis=1) / n
        p = np.where(self.inside[:, :, None], self.xy - mean[:, None, :], 0.0)
        size = np.maximum(np.abs(p).max(axis=(1, 2)), 1.0)
        return t, p / size[:, None, None], size, mean

    def thrown(self, free: bool) -> np.ndarray:
        """The sum of squares beside the image of a parabola in space, (A / C, B / C) with quadratics A, B and C.

        With ``free`` C is any quadratic and the homogeneous system is solved by its smallest singular
        vector; else C is 1 + c1 t + c2 t^2 and the solution is least squares.  Infinite where C vanishes
        or changes sign within the stretch.
        """
        if free or self.t.shape[1] < 4:
            return self._solved(free)
        t, p, scale, _ = self.centred()
        # sample by sample, so that sums over the few samples of a stretch run over many stretches at once
        inside, t, x, y = (np.ascontiguousarray(v.T) for v in (self.inside, t, p[:, :, 0], p[:, :, 1]))
        one, square = inside.astype(float), t * t
        # beside A and B, which take up quadratics in either half, two unknowns are left
        known, sizes = _orthogonal([one, t, square])
        first, second, right = ([_without(v, known, known) for v in pair] for pair in ((-x * t, -y * t), (-x * square, -y * square), (x, y)))
        both = lambda a, b: _dot(a[0], b[0]) + _dot(a[1], b[1])
        sizes = [*sizes, np.sqrt(both(first, first))]
        first = [v / np.maximum(sizes[3], 1e-300) for v in first]
        shared = both(first, second)
        second = [v - shared * u for u, v in zip(first, second, strict=True)]
        again = both(first, second)
        second, shared = [v - again * u for u, v in zip(first, second, strict=True)], shared + again
        sizes.append(np.sqrt(both(second, second)))
        c2 = both(second, right) / np.maximum(sizes[4] ** 2, 1e-300)
        c1 = (both(first, right) - shared * c2) / np.maximum(sizes[3], 1e-300)
        w = np.where(inside, 1.0 + c1 * t + c2 * square, 1.0)
        good = (w > 1e-6).all(axis=0)
        w = np.where(good, w, 1.0)
        off = [(sum(_dot(v * w, q) * q for q in known) / w - v) * scale for v in (x, y)]
        squares = np.where(good, sum(_dot(v * one, v) for v in off), np.inf)
        poor = np.flatnonzero(~(np.min(sizes, axis=0) > 1e-9 * np.max(sizes, axis=0)))
        if len(poor):
            every, xy, lo, hi = self.of
            squares[poor] = Stretches(every, xy, lo[poor], hi[poor])._solved(False)
        return squares

    def _solved(self, free: bool) -> np.ndarray:
        """The same by systems that are solved one by one."""
        t, p, size, _ = self.centred()
        one = self.inside.astype(float)
        basis = np.stack([one, t, t * t], axis=2)
        none = np.zeros_like(basis)
        depth = basis if free else basis[:, :, 1:]
        across, down = (-p[:, :, k : k + 1] * depth for k in (0, 1))
        system = np.concatenate([np.concatenate([basis, none, across], axis=2), np.concatenate([none, basis, down], axis=2)], axis=1)
        if free:
            c = np.linalg.svd(system, full_matrices=False)[2][:, -1, :]
            w = np.einsum("rsi,ri->rs", basis, c[:, 6:])
            sign = np.sign(w)
            good = np.where(self.inside, np.abs(w) >= 1e-9, True).all(axis=1) & (np.where(self.inside, sign, -1).max(axis=1) - np.where(self.inside, sign, 1).min(axis=1) <= 0)
        else:
            c = _least_squares(system, np.concatenate([p[:, :, 0], p[:, :, 1]], axis=1))
            w = 1.0 + np.einsum("rsi,ri->rs", depth, c[:, 6:])
            good = np.where(self.inside, w > 1e-6, True).all(axis=1)
        w = np.where(self.inside & good[:, None], w, 1.0)
        fitted = np.stack([np.einsum("rsi,ri->rs", basis, c[:, a : a + 3]) / w for a in (0, 3)], axis=2)
        squares = (((fitted - p) * size[:, None, None] * self.inside[:, :, None]) ** 2).sum(axis=(1, 2))
        return np.where(good, squares, np.inf)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=0)


def _without(v: np.ndarray, *known: list[np.ndarray]) -> np.ndarray:
    """What orthogonal columns leave of one."""
    for columns in known:
        for q in columns:
            v = v - _dot(v, q) * q
    return v


def _orthogonal(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of length 1 that span the same, each for what those before leave of it, and the lengths of that."""
    known, sizes = [], []
    for v in columns:
        v = _without(v, known, known)  # twice, for what rounding leaves
        sizes.append(np.sqrt(_dot(v, v)))
        known.append(v / np.maximum(sizes[-1], 1e-14))
    return known, sizes


def _least_squares(systems: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of each system, the shortest where there are several."""
    if systems.shape[1] < systems.shape[2]:
        return np.einsum("rij,rj->ri", np.linalg.pinv(systems), right)
    q, r = np.linalg.qr(systems)
    size = np.abs(np.diagonal(r, axis1=1, axis2=2))
    sound = size.min(axis=1) > 1e-9 * size.max(axis=1)
    out = np.empty((len(systems), systems.shape[2]))
    out[sound] = np.linalg.solve(r[sound], np.einsum("rij,ri->rj", q[sound], right[sound])[:, :, None])[:, :, 0]
    out[~sound] = np.einsum("rij,rj->ri", np.linalg.pinv(systems[~sound]), right[~sound])
    return out


def _parts(lo: np.ndarray, hi: np.ndarray):
    """Places of stretches of like length, TOGETHER at most."""
    order = np.argsort(hi - lo, kind="stable")
    for a in range(0, len(order), TOGETHER):
        yield order[a : a + TOGETHER]


def deviation(t: np.ndarray, xy: np.ndarray, lo: np.ndarray, hi: np.ndarray, spare: bool = False, thrown: bool = True) -> np.ndarray:
    """Root mean squares beside a quadratic, or beside a thrown ball's image where that is nearer.

    The second is tried from THROWN_SAMPLES on where the first deviates too far, unless ``thrown`` is not
    set.  With ``spare`` one degree of freedom is left to shorter stretches, and one or two samples deviate
    by nothing.
    """
    out = np.zeros(len(lo))
    for k in _parts(lo, hi):
        n = (hi - lo)[k]
        degree = np.minimum(2, np.where(spare & (n < THROWN_SAMPLES), n - 2, n - 1))
        judged = degree >= 0 if not spare else n > 2
        k, n, degree = k[judged], n[judged], degree[judged]
        if not len(k):
            continue
        rms = np.sqrt(Stretches(t, xy, lo[k], hi[k]).polynomial(degree) / n)
        far = (rms > SMOOTH_PX) & (n >= THROWN_SAMPLES)
        if thrown and far.any():
            squares = Stretches(t, xy, lo[k[far]], hi[k[far]]).thrown(free=True)
            rms[far] = np.minimum(rms[far], np.sqrt(squares / n[far]))
        out[k] = rms
    return out


def rough_windows(t: np.ndarray, xy: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Per flight [first, last), how many stretches of SMOOTH_S deviate too far, with a kink in them or without.

    A kink explains a stretch if some cut into two pieces fits; a piece of one or two samples cannot be
    judged and counts as fitting.  Thrown balls are tried only for stretches that no quadratics explain,
    as they bring any stretch nearer.
    """
    flight = np.repeat(np.arange(len(first)), last - first)
    lo = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)]) if len(first) else np.zeros(0, np.int64)
    hi = np.concatenate([a + np.searchsorted(t[a:b], t[a:b] + SMOOTH_S + 1e-9, "right") for a, b in zip(first, last, strict=True)]) if len(first) else lo
    long = hi - lo >= SMOOTH_SAMPLES
    flight, lo, hi = flight[long], lo[long], hi[long]
    for thrown in (False, True):
        far = deviation(t, xy, lo, hi, thrown=thrown) > SMOOTH_PX
        flight, lo, hi = flight[far], lo[far], hi[far]
        if not len(lo):
            break
        n = hi - lo
        stretch = np.repeat(np.arange(len(lo)), n - 1)
        cut = np.arange(len(stretch)) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1) + 1
        begin, end = lo[stretch], hi[stretch]
        # a piece that ends one stretch begins another as a rule
        sides = np.stack([begin, begin + cut]), np.stack([cut, end - begin - cut])
        long = sides[1] > 2
        piece, place = np.unique(sides[0][long] * (int(n.max()) + 1) + sides[1][long], return_inverse=True)
        at, size = np.divmod(piece, int(n.max()) + 1)
        a, b = off = np.zeros(sides[0].shape)
        off[long] = deviation(t, xy, at, at + size, spare=True, thrown=thrown)[place]
        both = np.sqrt((a**2 * cut + b**2 * (end - begin - cut)) / (end - begin))
        kinked = np.bincount(stretch[both <= SMOOTH_PX], minlength=len(lo)) > 0
        flight, lo, hi = flight[~kinked], lo[~kinked], hi[~kinked]
    return np.bincount(flight, minlength=len(first))


def smooth(t: np.ndarray, xy: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each flight is smooth: no rough stretch, or one in a flight of LONG_S or more."""
    allowed = np.where((last > first) & (t[np.maximum(last - 1, 0)] - t[np.minimum(first, len(t) - 1)] >= LONG_S), 1, 0) if len(t) else np.zeros(len(first), int)
    parts = np.split(np.arange(len(first)), np.flatnonzero(np.diff(np.cumsum(last - first) // SAMPLES)) + 1)
    return np.concatenate([rough_windows(t, xy, first[k], last[k]) for k in parts]) <= allowed
