"""Contact of a swing: the first plausible one of its speed peaks, with what spoke against the others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.operators.groups import by_key
from motionlake.operators.pose import SHOULDERS, VISIBLE, WRISTS

#: A plateau's share of its peak, its frames at least and at most, frames between peaks, peaks tried, cap of prominence.
PLATEAU, PLATEAU_FRAMES, APART, PEAKS, MOST_PROMINENT = 0.45, (2, 4), 5, 5, 10.0
#: Share of the reach that an extended arm has, reach below which that is not judged, frames at an end of the clip.
EXTENDED, LEAST_REACH_TU, EDGE = 0.6, 0.15, 4
#: What moving is, the frames that must move, those before contact and their share, frames of held marks and their share.
MOVING, MOVING_FRAMES, BEFORE, BEFORE_MOVING, BEFORE_SHARE, HELD_FRAMES, HELD_TU_S, HELD_SHARE = 0.5, 2, 6, 0.15, 0.5, 40, 1e-6, 0.1
#: Frames into the peak by which the direction is read, torso lengths and straightness that it needs.
LEAD, LEAD_TU, STRAIGHT = 5, 0.10, 0.5
#: Confidence at both ends of the ramp of prominence, and what each flag leaves of it.
RAMP, LOWEST = (1.1, 2.5), 0.35
PENALTY = {"wrist_behind_mid_hip": 0.6, "arm_not_extended": 0.8, "contact_near_clip_end": 0.7, "subject_identity_unstable": 0.7, "motion_not_sustained": 0.3}


class Swing:
    """The racket wrist of one sequence: speed, places, and in which frames each can be trusted."""

    def __init__(self, t: np.ndarray, x: np.ndarray, speed: np.ndarray, reach: np.ndarray, wrist: np.ndarray, shoulder: np.ndarray, direction: int):
        self.t, self.x, self.speed, self.reach, self.wrist, self.direction = t, x, speed, reach, wrist, direction
        # a speed is a difference between both neighbours, which must be seen as well
        self.reliable = wrist & np.concatenate([wrist[:1], wrist[:-1]]) & np.concatenate([wrist[1:], wrist[-1:]])
        self.arm = wrist & shoulder
        spread = reach[self.arm]
        self.span = float(spread.max() - spread.min()) if len(spread) else 0.0
        self.least = float(spread.min()) if len(spread) else 0.0

    def fastest(self) -> int:
        if self.reliable.any():
            return int(np.argmax(np.where(self.reliable, self.speed, -np.inf)))
        return int(np.argmax(self.speed))

    def lead(self) -> np.ndarray | None:
        """x of the wrist where it is seen in the frames into the fastest one."""
        if len(self.t) < 2 or not self.reliable.any():
            return None
        peak = self.fastest()
        at = np.arange(max(0, peak - LEAD), peak + 1)
        at = at[self.wrist[at]]
        return self.x[at] if len(at) > 1 else None

    def turn(self) -> None:
        """The direction read off the wrist itself, where that is one clear motion the other way."""
        x = self.lead()
        if x is None:
            return
        way, path = x[-1] - x[0], np.abs(np.diff(x)).sum()
        if np.isfinite(way) and abs(way) >= LEAD_TU and np.isfinite(path) and path > 0 and abs(way) / path >= STRAIGHT:
            self.direction = 1 if way > 0 else -1

    def extension(self, k: int) -> float:
        """The arm's reach within the clip's range, 0 where it is not seen."""
        if not self.arm[k]:
            return 0.0
        return float(np.clip((self.reach[k] - self.least) / self.span, 0.0, 1.0)) if self.span > 0 else 1.0

    def peaks(self, start: int) -> list[int]:
        """Local maxima from ``start`` on, the fastest first, apart from each other, PEAKS at most; the fastest frame without any."""
        ok = self.reliable if self.reliable[start:].any() else np.ones(len(self.t), bool)
        left, right = np.concatenate([[-np.inf], self.speed[:-1]]), np.concatenate([self.speed[1:], [-np.inf]])
        at = np.flatnonzero(ok & (self.speed >= left) & (self.speed >= right))
        chosen: list[int] = []
        for k in sorted(at[at >= start].tolist(), key=lambda k: (-self.speed[k], k)):
            if len(chosen) < PEAKS and all(abs(k - c) >= APART for c in chosen):
                chosen.append(k)
        return chosen or [self.fastest()]

    def onset(self, peak: int, start: int) -> int:
        """The last frame of the plateau after a peak; the peak without one, the last frame where the clip ends before."""
        first, n = max(peak, start), len(self.t)
        k = first + 1
        while k < min(n, first + 1 + PLATEAU_FRAMES[1]) and self.speed[k] >= PLATEAU * self.speed[peak]:
            k += 1
        return n - 1 if k >= n else k - 1 if k - first - 1 >= PLATEAU_FRAMES[0] else first

    def against(self, k: int) -> list[str]:
        """What rejects a frame: it must fail there and in both neighbours."""
        near = np.clip([k - 1, k, k + 1], 0, len(self.t) - 1)
        flags = []
        if (self.x[near] * self.direction <= 0).all():
            flags.append("wrist_behind_mid_hip")
        if self.span >= LEAST_REACH_TU and all(self.extension(j) < EXTENDED for j in near):
            flags.append("arm_not_extended")
        return flags

    def prominence(self, peak: int) -> float:
        """The peak's speed over that of the fastest other maximum APART away, MOST_PROMINENT at most and without one."""
        top = self.speed[peak]
        if top <= 0:
            return 0.0
        ok = self.reliable if self.reliable.any() else np.ones(len(self.t), bool)
        left, right = np.concatenate([[-np.inf], self.speed[:-1]]), np.concatenate([self.speed[1:], [-np.inf]])
        other = self.speed[ok & (self.speed >= left) & (self.speed >= right) & (np.abs(np.arange(len(self.t)) - peak) >= APART)]
        second = other.max() if len(other) else 0.0
        return float(min(top / second, MOST_PROMINENT)) if second > 0 else MOST_PROMINENT

    def moves(self, peak: int) -> bool:
        """Whether there is a swing at a peak: it lasts, the hand moved before it, and marks around were tracked, not held."""
        moving = self.reliable & (self.speed >= MOVING * self.speed[peak])
        if not moving[peak]:
            return False
        still = np.flatnonzero(~moving)
        before, after = still[still < peak], still[still > peak]
        if (after[0] if len(after) else len(self.t)) - (before[-1] if len(before) else -1) - 1 < MOVING_FRAMES:
            return False
        lead = slice(max(0, peak - BEFORE), peak)
        share = float(np.mean(self.reliable[lead] & (self.speed[lead] >= BEFORE_MOVING * self.speed[peak]))) if peak else 0.0
        if share < BEFORE_SHARE:
            return False
        around = slice(max(0, peak - HELD_FRAMES), peak + HELD_FRAMES + 1)
        tracked = self.speed[around][self.reliable[around]]
        return not len(tracked) or float(np.mean(np.abs(tracked) < HELD_TU_S)) <= HELD_SHARE

    def contact(self, unstable: bool) -> dict:
        """The contact with its confidence and flags, and every candidate with what was against it."""
        n = len(self.t)
        if n < 3:
            return {"at": None, "peak": None, "peak_speed": None, "prominence": 0.0, "confidence": 0.0, "flags": ["sequence_unusable"], "tried": []}
        forward = self.x * self.direction
        peak = self.fastest()
        turns = [k for k in range(1, peak) if forward[k] <= forward[k - 1] and forward[k] < forward[k + 1]]
        start = turns[-1] if turns else 0
        tried: list[tuple[int, list[str]]] = []
        won = None
        for k in self.peaks(start):
            at = self.onset(k, start)
            if at in [a for a, _ in tried]:
                continue
            tried.append((at, self.against(at)))
            if not tried[-1][1]:
                won, peak = at, k
                break
        prominence = self.prominence(peak)
        out = {"at": won, "peak": peak, "peak_speed": float(self.speed[peak]), "prominence": prominence, "tried": tried}
        if won is None:
            return out | {"confidence": 0.0, "flags": ["contact_not_found"]}
        observed = float(self.reliable.mean())
        checks = {
            "wrist_behind_mid_hip": forward[won] <= 0, "arm_not_extended": self.extension(won) < EXTENDED, "contact_near_clip_end": won < EDGE or won > n - 1 - EDGE,
            "subject_identity_unstable": unstable, "motion_not_sustained": not self.moves(peak), "racket_wrist_unobserved": observed <= 0,
        }
        flags = [f for f, holds in checks.items() if holds]
        sure = LOWEST + (1 - LOWEST) * float(np.clip((prominence - RAMP[0]) / (RAMP[1] - RAMP[0]), 0.0, 1.0))
        for f in flags:
            sure *= PENALTY.get(f, 1.0)
        return out | {"confidence": float(np.clip(sure * observed, 0.0, 1.0)), "flags": flags}


FOUND = "frame {frame}, time_s double, direction int, peak_frame {frame}, peak_speed double, prominence double, confidence double, flags array<string>, tried array<struct<frame: {frame}, against: array<string>>>"


def select(norm: DataFrame, hands: DataFrame, directions: DataFrame, unstable: DataFrame | None = None) -> DataFrame:
    """(seq_id, frame, time_s, direction, peak_frame, peak_speed, prominence, confidence, flags, tried): the contact of each sequence.

    ``norm``: rows of normalized; ``hands``: seq_id and hand, left or right (right where it is not known);
    ``directions``: seq_id and direction; ``unstable``: seq_id and unstable.  The speed peaks of the forward
    swing are tried, the fastest first: each leads to the end of its plateau, and the first that is not
    rejected there, in that frame and both around it, is the contact.  Where all are rejected there is none:
    frame is null and confidence 0, and ``tried`` says why.  time_s counts from the sequence's first frame.
    Null marks count as not seen, at 0; sequences of under three frames are not usable.
    """
    kinds = dict(norm.dtypes)
    own = [F.when(F.coalesce(F.col("hand"), F.lit("right")) == "left", pair[0]).otherwise(pair[1]) for pair in (WRISTS, SHOULDERS)]
    seen = F.coalesce(F.col("visibility") >= VISIBLE, F.lit(False))
    both = norm.where(F.col("landmark").isin(*WRISTS, *SHOULDERS)).join(hands.select("seq_id", "hand"), "seq_id", "left")
    pick = lambda k, c, name: F.max(F.when(F.col("landmark") == own[k], c)).alias(name)
    at = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    frames = both.groupBy("seq_id", "frame", "ts_s").agg(
        pick(0, at("x"), "x"), pick(0, at("y"), "y"), pick(0, F.hypot(at("vx"), at("vy")), "speed"), pick(0, seen, "wrist"), pick(1, at("x"), "sx"), pick(1, at("y"), "sy"), pick(1, seen, "shoulder")
    )
    frames = frames.join(directions.select("seq_id", "direction"), "seq_id", "left")
    frames = frames.join(unstable.select("seq_id", "unstable"), "seq_id", "left") if unstable is not None else frames.withColumn("unstable", F.lit(False))
    known = hands.select("seq_id", F.coalesce(F.col("hand").isin("left", "right"), F.lit(False)).alias("known"))
    frames = frames.join(known, "seq_id", "left").select(*frames.columns, F.coalesce("known", F.lit(False)).alias("known"))
    names = ["seq_id", "frame", "time_s", "direction", "peak_frame", "peak_speed", "prominence", "confidence", "flags", "tried"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        number = lambda c: pdf[c].fillna(0.0).to_numpy(float)
        flag = lambda c: pdf[c].fillna(False).to_numpy(bool)
        t, label = pdf["ts_s"].to_numpy(float), pdf["frame"].tolist()
        r = pdf.iloc[0]
        way = -1 if r["direction"] == -1 else 1
        swing = Swing(t, number("x"), number("speed"), np.hypot(number("x") - number("sx"), number("y") - number("sy")), flag("wrist"), flag("shoulder"), way)
        if r["known"]:
            swing.turn()
        c = swing.contact(bool(r["unstable"]) if r["unstable"] == r["unstable"] and r["unstable"] is not None else False)
        name = lambda k: None if k is None else label[k]
        tried = [{"frame": label[k], "against": why} for k, why in c["tried"]]
        return pd.DataFrame([(r["seq_id"], name(c["at"]), None if c["at"] is None else t[c["at"]] - t[0], swing.direction, name(c["peak"]), c["peak_speed"], c["prominence"], c["confidence"], c["flags"], tried)], columns=names)

    return by_key(frames, "seq_id", ["frame"], one, f"seq_id {kinds['seq_id']}, " + FOUND.format(frame=kinds["frame"]))
