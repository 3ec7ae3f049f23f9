"""A long session to its swings: tracked stretches, speed peaks, windows, and each window analysed by itself.

The hand of a session is given, so that no swing decides it anew.  Peaks and windows are sought in a
session at a time; what follows treats every window as a sequence of its own, all in one plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.functions import cut, over
from motionlake.operators import contacts, normalized
from motionlake.operators.groups import by_key
from motionlake.operators.pose import JUMP_TU, TORSO_CHANGE, VISIBLE, WRISTS, identity_unstable
from motionlake.operators.segmentation import AFTER_S, BEFORE_S, FLOOR, MIN_AFTER_S, MIN_BEFORE_S, REFRACTORY_S, RELATIVE, VALLEY, status
from motionlake.operators.series import MAX_GAP, SMOOTH_FIRST, SMOOTH_MIDDLE, SMOOTH_SECOND

#: Seconds either side over which the torso is measured, the percentile of the relative floor, frames that contact may lie off the peak.
SCALE_S, PERCENTILE, OFF_PEAK = 5.0, 90.0, 6
_EPS = 1e-6
#: Why a peak or a window is no swing, by the flags of its contact, in this order.
OF_CONTACT = {"sequence_unusable": "sequence_unusable", "contact_not_found": "contact_not_found", "racket_wrist_unobserved": "wrist_unobserved", "motion_not_sustained": "no_motion_evidence"}


def smoothed(v: np.ndarray) -> np.ndarray:
    """The quadratic fit of five rows along the first axis; shorter series stay as they are."""
    n = len(v)
    if n < 5:
        return v
    out = np.empty_like(v)
    middle = np.array(SMOOTH_MIDDLE, float) / 35.0
    out[2:-2] = sum(w * v[k : n - 4 + k] for k, w in enumerate(middle))
    for at, weights in ((0, SMOOTH_FIRST), (1, SMOOTH_SECOND)):
        w = np.array(weights, float) / 35.0
        out[at], out[n - 1 - at] = w @ v[:5], w @ v[:-6:-1]
    return out


def slopes(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Central differences, one-sided at the ends, 0 where time stands still."""
    k = np.arange(len(v))
    a, b = np.maximum(k - 1, 0), np.minimum(k + 1, len(v) - 1)
    gap = t[b] - t[a]
    return np.where(gap[:, None] != 0, (v[b] - v[a]) / np.where(gap != 0, gap, 1.0)[:, None], 0.0)


def rolling_scale(torso: np.ndarray, valid: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The median torso of the valid frames within SCALE_S of each frame; without any, on the line between frames with one."""
    good = valid & (torso > 0)
    out = np.zeros(len(t))
    if not good.any():
        return out
    at, values = t[good], torso[good]
    for k, (a, b) in enumerate(zip(np.searchsorted(at, t - SCALE_S), np.searchsorted(at, t + SCALE_S, "right"), strict=True)):
        out[k] = np.median(values[a:b]) if b > a else 0.0
    known = np.flatnonzero(out > 0)
    return np.interp(np.arange(len(t)), known, out[known])


def stretches(hips: np.ndarray, torso: np.ndarray, valid: np.ndarray, scale: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) in which one body is followed: it ends at a gap of more than MAX_GAP frames, where the hips jump, or where the torso changes."""
    at = np.flatnonzero(valid)
    if not len(at):
        return []
    a, b = at[:-1], at[1:]
    with np.errstate(all="ignore"):
        jump = np.hypot(*(hips[b] - hips[a]).T) / scale[b] > JUMP_TU
        change = (torso[a] > 0) & (np.abs(torso[b] - torso[a]) / torso[a] > TORSO_CHANGE)
    cuts = np.flatnonzero((b - a - 1 > MAX_GAP) | (scale[b] > 0) & (jump | change))
    return list(zip(at[np.concatenate([[0], cuts + 1])].tolist(), (at[np.concatenate([cuts, [len(at) - 1]])] + 1).tolist(), strict=True))


class Signal:
    """The speed of the racket hand in torso lengths a second, stretch by stretch."""

    def __init__(self, t, wrist, hips, torso, valid, seen):
        self.t, n = t, len(t)
        self.speed, self.reliable = np.zeros(n), np.zeros(n, bool)
        self.scale = rolling_scale(torso, valid, t)
        self.stretches = stretches(hips, torso, valid, self.scale)
        for a, b in self.stretches:
            k, ok, vis = np.arange(b - a), np.flatnonzero(valid[a:b]), seen[a:b]
            fill = lambda v, at: np.column_stack([np.interp(k, at, v[at, c]) for c in (0, 1)])  # noqa: B023, E731
            w, h = fill(wrist[a:b], ok), fill(hips[a:b], ok)
            if vis.any():
                w = fill(w, np.flatnonzero(vis))  # a place that was not seen is no evidence of speed
            unit = np.where(self.scale[a:b] > 0, self.scale[a:b], 1.0)
            self.speed[a:b] = np.hypot(*slopes(smoothed((w - h) / unit[:, None]), t[a:b]).T)
            self.reliable[a:b] = vis & np.concatenate([vis[:1], vis[:-1]]) & np.concatenate([vis[1:], vis[-1:]]) & valid[a:b]

    def peaks(self, a: int, b: int, apart: int) -> list[int]:
        """Local maxima of a stretch, ``apart`` frames from each other, the fastest first; reliable ones if there are any."""
        s, ok = self.speed[a:b], self.reliable[a:b]
        ok = ok if ok.any() else np.ones(b - a, bool)
        left, right = np.concatenate([[-np.inf], s[:-1]]), np.concatenate([s[1:], [-np.inf]])
        found = np.flatnonzero(ok & (s >= left) & (s >= right))
        free, chosen = np.ones(b - a, bool), []
        for k in found[np.lexsort((found, -s[found]))].tolist():
            if free[k]:
                chosen.append(a + k)
                free[max(0, k - apart + 1) : k + apart] = False
        return sorted(chosen) or [a + int(np.argmax(np.where(ok, s, -np.inf)))]

    def candidates(self, apart: int) -> list[dict]:
        """Peaks above the floor with what rejects them: not seen, slow beside the others, or not clear of a valley."""
        found = [(k, n) for n, (a, b) in enumerate(self.stretches) if b - a >= 3 for k in self.peaks(a, b, apart) if self.speed[k] >= FLOOR]
        sure = [self.speed[k] for k, _ in found if self.reliable[k]]
        least = RELATIVE * np.percentile(sure, PERCENTILE) if sure else 0.0
        out = []
        for i, (k, n) in enumerate(found):
            a, b = self.stretches[n]
            left = found[i - 1][0] if i and found[i - 1][1] == n else a
            right = found[i + 1][0] if i + 1 < len(found) and found[i + 1][1] == n else b - 1
            valley = max(self.speed[left : k + 1].min(), self.speed[k : right + 1].min())
            ratio = float(self.speed[k] / valley) if valley > 1e-9 else None
            why = "wrist_unobserved" if not self.reliable[k] else "below_relative_floor" if self.speed[k] < least else "not_prominent" if ratio is not None and ratio < VALLEY else None
            out.append({"peak": k, "stretch": n, "speed": float(self.speed[k]), "valley_ratio": ratio, "rejection": why})
        return out

    def parting(self, p: int, q: int) -> int:
        """The slowest frame between two peaks, where that leaves both their least window."""
        lo = max(int(np.searchsorted(self.t, self.t[p] + MIN_AFTER_S - _EPS)) + 1, p + 1)
        hi = min(int(np.searchsorted(self.t, self.t[q] - MIN_BEFORE_S + _EPS, "right")), q)
        if hi <= lo:
            lo, hi = p + 1, q
        return lo + int(np.argmin(self.speed[lo:hi])) if hi > lo else q

    def windows(self, found: list[dict]) -> None:
        """Adds start and end, exclusive, to the candidates that stand; windows never share a frame."""
        good = [c for c in found if c["rejection"] is None]
        cuts = [self.parting(a["peak"], b["peak"]) if a["stretch"] == b["stretch"] else None for a, b in zip(good, good[1:], strict=False)]
        for i, c in enumerate(good):
            k, (a, b) = c["peak"], self.stretches[c["stretch"]]
            start = max(int(np.searchsorted(self.t, self.t[k] - BEFORE_S - _EPS)), a, cuts[i - 1] if i and cuts[i - 1] is not None else 0)
            end = min(int(np.searchsorted(self.t, self.t[k] + AFTER_S + _EPS, "right")), b, cuts[i] if i < len(cuts) and cuts[i] is not None else len(self.t))
            short = end <= k or self.t[k] - self.t[start] < MIN_BEFORE_S - _EPS or self.t[end - 1] - self.t[k] < MIN_AFTER_S - _EPS
            c |= {"start": start, "end": end, "rejection": "window_too_short" if short else None}


WINDOW = "peak int, peak_s double, speed double, valley_ratio double, rejection string, start int, end int, start_s double, end_s double"


def swing_windows(fr: DataFrame, hands: DataFrame) -> DataFrame:
    """(seq_id, peak, peak_s, speed, valley_ratio, rejection, start, end, start_s, end_s): the speed peaks of each session and their windows.

    ``fr`` as pose.frames gives it; ``hands``: seq_id and hand, left or right, without which a session has no
    peaks.  Frames are numbered from 0; end is exclusive.  Peaks below the floor are no candidates; those
    rejected have no window.  A session is one group, bounded by its recording.
    """
    kind = dict(fr.dtypes)["seq_id"]
    d = fr.join(hands.where(F.col("hand").isin("left", "right")).select("seq_id", "hand"), "seq_id")
    mark = F.when(F.col("hand") == "left", F.col("body")[WRISTS[0]]).otherwise(F.col("body")[WRISTS[1]])
    d = d.select("seq_id", "frame", "ts_s", F.coalesce("valid", F.lit(False)).alias("valid"), "ox", "oy", "torso", (mark["x"] + F.col("ox")).alias("wx"), (mark["y"] + F.col("oy")).alias("wy"), F.coalesce(mark["v"] >= VISIBLE, F.lit(False)).alias("seen"))
    names = ["seq_id", *(c.split()[0] for c in WINDOW.split(", "))]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = lambda *c: pdf[list(c)].fillna(0.0).to_numpy(float)
        t = pdf["ts_s"].to_numpy(float)
        s = Signal(t, pair("wx", "wy"), pair("ox", "oy"), pair("torso")[:, 0], pdf["valid"].to_numpy(bool), pdf["seen"].to_numpy(bool))
        step = float(np.median(np.diff(t))) if len(t) > 1 else 0.0
        found = s.candidates(max(int(round(REFRACTORY_S / step)), 1) if step > 0 else 1)
        s.windows(found)
        rows = []
        for c in found:
            a, b = c.get("start"), c.get("end")
            rows.append((pdf["seq_id"].iloc[0], c["peak"], t[c["peak"]], c["speed"], c["valley_ratio"], c["rejection"], a, b, None if a is None else t[a], None if b is None else t[max(b - 1, a)]))
        return pd.DataFrame(rows, columns=names).astype({"start": "Int32", "end": "Int32"})

    return by_key(d, "seq_id", ["frame"], one, f"seq_id {kind}, {WINDOW}")


def segment_session(fr: DataFrame, hands: DataFrame) -> DataFrame:
    """(seq_id, peak, ..., status, rejection, confidence, contact_frame, contact_s, direction, flags): the swings of each session.

    Every window without a rejection is a sequence of its own: normalised, judged, and searched for its
    contact with the session's hand.  Rejected are, in this order, windows that cannot be used, in which
    another body takes over, whose contact is not found, not seen, without motion or too far off the peak, and
    those of too little confidence.  contact_s is a time of the session.
    """
    found = cut(swing_windows(fr, hands))
    name = F.concat_ws(":", F.col("seq_id").cast("string"), F.col("peak").cast("string"))
    places = found.where("rejection is null").select("seq_id", name.alias("window"), F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    numbered = fr.withColumn("pos", F.row_number().over(over("seq_id", "frame")) - 1)
    pieces = cut(numbered.join(places, ["seq_id", "pos"]).drop("seq_id", "pos").withColumnRenamed("window", "seq_id"))
    judged = normalized.core_quality(pieces).select("seq_id", "usable", "flags")
    unstable = F.array_contains("flags", "subject_identity_unstable")
    verdict = cut(judged.select("seq_id", F.when(~F.col("usable"), "pose_unusable").when(unstable, "identity_break_in_window").alias("why")))
    marks = cut(normalized.normalized(pieces.join(verdict.where("why is null").select("seq_id"), "seq_id", "left_semi")))
    own = found.join(hands.select("seq_id", "hand"), "seq_id").select(name.alias("window"), "hand").withColumnRenamed("window", "seq_id")
    contact = contacts.select(marks, own, normalized.swing_direction(marks), identity_unstable(pieces))
    contact = contact.select(F.col("seq_id").alias("window"), F.col("frame").alias("contact_frame"), F.col("time_s"), "direction", "confidence", "peak_frame", F.col("flags").alias("contact_flags"))
    label = numbered.select("seq_id", F.col("pos").alias("peak"), F.col("frame").alias("__peak_label"))
    d = found.join(label, ["seq_id", "peak"]).withColumn("window", name).join(verdict.withColumnRenamed("seq_id", "window"), "window", "left").join(contact, "window", "left")
    why = F.col("rejection")
    reason = F.coalesce(why, F.col("why"))
    has = lambda f: F.coalesce(F.array_contains("contact_flags", f), F.lit(False))
    for f, r in OF_CONTACT.items():
        reason = F.coalesce(reason, F.when(has(f), r))
    reason = F.coalesce(reason, F.when(F.abs(F.col("peak_frame") - F.col("__peak_label")) > OFF_PEAK, "contact_off_peak"), F.when(status("confidence") == "rejected", "confidence_below_floor"))
    d = d.withColumn("rejection", reason).withColumn("status", F.when(reason.isNotNull(), "rejected").otherwise(status("confidence")))
    return d.select(
        "seq_id", "peak", "peak_s", "speed", "valley_ratio", "start", "end", "start_s", "end_s", "status", "rejection", "confidence", "contact_frame", (F.col("start_s") + F.col("time_s")).alias("contact_s"), "direction", F.coalesce("contact_flags", F.array().cast("array<string>")).alias("flags")
    )
