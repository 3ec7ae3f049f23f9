"""Ball detections to tracks, speed, flights and events.

Greedy and dynamic steps run on one clip or flight at a time with numpy; gates, speeds, capping and
rules around them are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import over, ratio
from motionlake.operators.fits import smooth

#: Gates in pixels, metres per second, degrees and seconds.
MPH, WINDOW_S, MIN_STEP_PX, MIN_SEGMENT_PX = 2.23694, 0.25, 2.0, 60.0
MAX_SPEED_M_S, STEP_SAFETY, MIN_GATE_PX, GATE_SHRINK = 71.5, 1.5, 8.0, 0.35
STREAK_DEG, TURN_DEG, MAX_COASTS, MIN_ACCEPTED = 25.0, 35.0, 2, 3
PLAUSIBLE_MPH, SCALE_RANGE = (15, 160), (8.0, 300.0)
STITCH_GAP_S, MIN_DETECTIONS, MIN_EXTENT_PX = 0.2, 6, 30.0
BREAK_RATIO, BREAK_SEPARATION, SIDE_SAMPLES, SIDE_SPAN_S = 0.5, 3, 8, 0.15
PER_FRAME, EDGE_PX = 256, 12.0


def direction_difference(a: Column, b: Column) -> Column:
    """Angle between two directions, 0 to 180 degrees."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def axis_difference(axis: Column, direction: Column) -> Column:
    """Angle between a line and a direction, 0 to 90 degrees."""
    return F.abs(F.pmod(axis - direction + 90.0, F.lit(180.0)) - 90.0)


def tier(area: Column, circularity: Column, aspect: Column, solidity: Column, fill: Column, minor: Column) -> Column:
    """1 for a round blob, 2 for a streak, 0 for anything else."""
    rounded = area.between(12, 1200) & (circularity >= 0.65) & (aspect <= 1.6) & (solidity >= 0.85) & (fill >= 0.55)
    streak = area.between(12, 1500) & (circularity >= 0.2) & aspect.between(1.6, 12.0) & (minor >= 2)
    return F.when(rounded, 1).when(streak, 2).otherwise(0)


def outside(df: DataFrame, boxes: DataFrame, key: str, frame: str) -> DataFrame:
    """Candidates that lie in no exclusion box (x0, x1, y0, y1) of their frame; columns may be null, a null place lies in none."""
    own = boxes.groupBy(key, frame).agg(F.collect_list(F.struct("x0", "x1", "y0", "y1")).alias("__boxes"))  # a player each
    inside = F.exists("__boxes", lambda b: F.coalesce(F.col("x").between(b["x0"], b["x1"]) & F.col("y").between(b["y0"], b["y1"]), F.lit(False)))
    return df.join(own, [key, frame], "left").where(F.col("__boxes").isNull() | ~inside).select(df.columns)


def cap_per_frame(df: DataFrame, key: str, frame: str, most: int = PER_FRAME) -> DataFrame:
    """The most colourful candidates of each frame, then the highest in contrast; NaN comes last."""
    low = lambda c: F.nanvl(F.col(c), F.lit(float("-inf")))
    w = Window.partitionBy(key, frame).orderBy(F.desc(low("colour_score")), F.desc(low("contrast")), "x", "y")
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def scale_from_segment(segment_px: Column, metres: Column) -> Column:
    """(px_per_m, reason) of a measured length: a scale or why there is none."""
    scale = ratio(segment_px, metres)
    reason = F.when(segment_px < MIN_SEGMENT_PX, "segment_too_short").when(scale.isNull() | ~scale.between(*SCALE_RANGE), "scale_implausible")
    return F.struct(F.when(reason.isNull(), scale).alias("px_per_m"), reason.alias("reason"))


def rotate(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    """A point of the unit square turned clockwise by a multiple of 90 degrees."""
    d = F.pmod(degrees, F.lit(360))
    return F.when(d == 90, 1 - y).when(d == 180, 1 - x).when(d == 270, y).otherwise(x), F.when(d == 90, x).when(d == 180, 1 - y).when(d == 270, 1 - x).otherwise(y)


class _Clip:
    """One clip's candidates as arrays in the order of frames, and the track that grows through them."""

    def __init__(self, pdf: pd.DataFrame, frame: str, size: tuple[float, float] | None):
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        keep = np.isfinite(x) & np.isfinite(y)
        if size is not None:  # a ball that the edge cuts has its centre in the wrong place
            keep &= (x >= EDGE_PX) & (y >= EDGE_PX) & (x <= size[0] - 1 - EDGE_PX) & (y <= size[1] - 1 - EDGE_PX)
        self.first = int(pdf[frame].min())
        self.last = int(pdf[frame].max())
        rows = pdf[keep].sort_values(frame, kind="stable")
        self.xy = rows[["x", "y"]].to_numpy(float)
        self.seed = rows[["seed_x", "seed_y"]].to_numpy(float)
        self.streak, self.axis = rows["tier"].to_numpy() == 2, rows["orientation_deg"].to_numpy(float)
        self.area = rows["area"].to_numpy(float) if "area" in rows else np.zeros(len(rows))
        self.frames = rows[frame].to_numpy(np.int64)

    def at(self, frame: int) -> slice:
        return slice(*np.searchsorted(self.frames, [frame, frame + 1]))

    def begin(self, gate: float) -> int | None:
        """The candidate of the first frame that is nearest to the seed, or without a seed the largest."""
        now = self.at(self.first)
        if now.start == now.stop:
            return None
        far = np.hypot(*(self.xy[now] - self.seed[now]).T)
        if np.isnan(far).all():
            return now.start + int(np.argmax(self.area[now]))
        k = int(np.nanargmin(far))
        return now.start + k if far[k] <= gate else None

    def grow(self, max_step: float, gate: float) -> tuple[list[int], str]:
        """Indexes of the detections, and why the track ended."""
        start = self.begin(gate)
        if start is None:
            return [], "no_seed"
        path, speed, heading, missed = [start], None, None, 0
        for frame in range(self.first + 1, self.last + 1):
            here, now = self.xy[path[-1]], self.at(frame)
            gap = frame - int(self.frames[path[-1]])
            guess, reach = (here, max_step * gap) if speed is None else (here + speed * gap, max(MIN_GATE_PX, GATE_SHRINK * max_step * gap))
            far, step = np.hypot(*(self.xy[now] - guess).T), self.xy[now] - here
            good = (far <= reach) & (np.hypot(*step.T) >= MIN_STEP_PX)
            if heading is not None:
                off = np.abs((self.axis[now] - heading) % 180.0)
                good &= ~self.streak[now] | (np.minimum(off, 180.0 - off) <= STREAK_DEG)
            if not good.any():
                missed += 1
                if missed > MAX_COASTS:
                    return path, "coast_exhausted"
                continue
            k = int(np.argmin(np.where(good, far, np.inf)))
            turn = float(np.degrees(np.arctan2(step[k, 1], step[k, 0])))
            if heading is not None and abs((turn - heading + 180.0) % 360.0 - 180.0) > TURN_DEG:
                return path, "direction_change"
            path.append(now.start + k)
            speed, heading, missed = step[k] / gap, turn, 0
        return path, "window_end"


def track(candidates: DataFrame, key: str, frame: str, max_step_px: float, seed_gate_px: float, size: tuple[float, float] | None = None) -> DataFrame:
    """(key, frame, x, y, ended): the track that grows from the first frame's candidate nearest to the seed.

    Columns: x, y, tier, orientation_deg, seed_x, seed_y, and area, which picks the seed where no place is
    given.  ``max_step_px`` is the way of the fastest ball in a frame.  The next detection is the
    candidate nearest to where the last step leads, within a gate that is narrow once a step is known
    and widens with the frames since the last detection; it must have moved, and a streak must point
    along the last step.  Frames without one are coasted through, MAX_COASTS in a row at most; the
    track ends there, where it turns too sharply, or with the clip.  With ``size`` (width, height)
    candidates near the edge do not count.  Fewer than MIN_ACCEPTED detections are no track.  One clip is
    one group, bounded by its length and cap_per_frame.
    """
    types = dict(candidates.dtypes)

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        clip = _Clip(pdf, frame, size)
        path, ended = clip.grow(max_step_px, seed_gate_px)
        path = path if len(path) >= MIN_ACCEPTED else []
        return pd.DataFrame([(pdf[key].iloc[0], int(clip.frames[k]), *clip.xy[k].tolist(), ended) for k in path], columns=[key, frame, "x", "y", "ended"])

    return candidates.where(F.col(frame).isNotNull()).groupBy(key).applyInPandas(follow, f"`{key}` {types[key]}, `{frame}` {types[frame]}, x double, y double, ended string")


def ball_speed(detections: DataFrame, context: DataFrame, key: str, time: str) -> DataFrame:
    """(key, mph, reason, confidence, used): exactly one of mph and reason is there.

    ``context`` has contact_s, contact_confidence and px_per_m for each key.  Detections within a
    quarter of a second after contact count, without the first; speed is the median of their steps.
    """
    w = over(key, time)
    d = detections.join(context, key).where((F.col(time) >= F.col("contact_s")) & (F.col(time) <= F.col("contact_s") + WINDOW_S))
    d = d.withColumn("rn", F.row_number().over(w)).where("rn > 1")
    d = d.withColumn("step", ratio(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.nullif(F.greatest(F.col(time) - F.lag(time).over(w), F.lit(0.0)), F.lit(0.0))))
    s = d.groupBy(key).agg(F.count(F.lit(1)).alias("used"), F.median("step").alias("px_s"))
    j = context.join(s, key, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    raw = F.bround(ratio("px_s", "px_per_m") * MPH, 0).cast("int")
    reason = (
        F.when(F.col("contact_confidence") < 0.35, "contact_uncertain")
        .when(F.col("px_per_m").isNull(), "not_calibrated")
        .when(F.col("used") < 3, "too_few_detections")
        .when(raw.isNull() | ~raw.between(*PLAUSIBLE_MPH), "implausible_speed")
    )
    level = F.when(F.col("used") >= 9, "high").when(F.col("used") >= 5, "medium").otherwise("low")
    return j.select(key, F.when(reason.isNull(), raw).alias("mph"), reason.alias("reason"), F.when(reason.isNull(), level).alias("confidence"), "used")


def lowest(*levels: Column) -> Column:
    """The lowest of confidence levels."""
    rank = lambda c: F.when(c == "low", 0).when(c == "medium", 1).otherwise(2)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.least(*map(rank, levels)) + 1)


def mad_threshold(df: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, threshold): the larger of 8 and four times the lower median of absolute deviations, rounded up."""

    def lower(d: DataFrame, value: str) -> DataFrame:
        c = d.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy(key).orderBy(value)
        c = c.withColumn("up", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
        return c.where("up * 2 >= all").groupBy(key).agg(F.min(value).alias("m"))

    dev = df.join(lower(df, diff), key).withColumn("dev", F.abs(F.col(diff) - F.col("m"))).drop("m")
    return lower(dev, "dev").select(key, F.greatest(F.lit(8), F.ceil(4.0 * F.col("m"))).cast("int").alias("threshold"))


def stitch(tracklets: DataFrame, key: str, max_gap_s: float = STITCH_GAP_S, reach_px_s: float = 2000.0) -> DataFrame:
    """(key, tracklet_id, flight_id): tracklets joined end to start, one to one, nearest in time first.

    Columns: tracklet_id, t0, x0, y0, t1, x1, y1.  Pairs come from a join on buckets of time; the
    greedy choice runs over one clip's pairs.
    """
    b = lambda c: F.floor(F.col(c) / max_gap_s)
    left = tracklets.select(key, F.col("tracklet_id").alias("a"), "t1", "x1", "y1", F.explode(F.array(b("t1"), b("t1") + 1)).alias("b"))
    right = tracklets.select(key, F.col("tracklet_id").alias("c"), "t0", "x0", "y0", b("t0").alias("b"))
    far = F.hypot(F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1"))
    pairs = left.join(right, [key, "b"]).where("a <> c and t0 > t1").withColumn("gap", F.col("t0") - F.col("t1")).withColumn("far", far).where((F.col("gap") <= max_gap_s) & (F.col("far") <= reach_px_s * F.col("gap")))
    pairs = pairs.select(F.col(key).alias(key), "a", "c", "gap", "far")  # columns of its own, for the cogroup
    kinds = dict(tracklets.dtypes)

    def chain(ids: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        before: dict = {}
        for a, c in found.sort_values(["gap", "far", "a", "c"])[["a", "c"]].itertuples(index=False):
            if a not in after and c not in before:
                after[a], before[c] = c, a
        out = []
        for i in ids["tracklet_id"]:
            head = i
            while head in before:
                head = before[head]
            out.append((ids[key].iloc[0], i, head))
        return pd.DataFrame(out, columns=[key, "tracklet_id", "flight_id"])

    return tracklets.groupBy(key).cogroup(pairs.groupBy(key)).applyInPandas(chain, f"`{key}` {kinds[key]}, tracklet_id {kinds['tracklet_id']}, flight_id {kinds['tracklet_id']}")


def accepted(points: DataFrame, key: str, time: str, least: int = MIN_DETECTIONS) -> DataFrame:
    """(key, n, extent, accepted): flights with enough detections that move and are smooth.

    Smooth is a flight in which every stretch of a quarter of a second lies along a parabola, the image of a
    thrown ball, or two such pieces; one of a second or more may have one stretch that does not.  Samples
    with a null or non-finite time or place do not count.
    """
    types = dict(points.dtypes)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(time)
        t, xy = p[time].to_numpy(float), p[["x", "y"]].to_numpy(float)
        good = np.isfinite(t) & np.isfinite(xy).all(axis=1)
        t, xy = t[good], xy[good]
        extent = float(np.hypot(*np.ptp(xy, axis=0))) if len(t) else 0.0
        ok = len(t) >= least and extent >= MIN_EXTENT_PX and bool(smooth(t, xy, np.zeros(1, np.int64), np.array([len(t)]))[0])
        return pd.DataFrame([(pdf[key].iloc[0], len(t), extent, ok)], columns=[key, "n", "extent", "accepted"])

    return points.groupBy(key).applyInPandas(judge, f"`{key}` {types[key]}, n long, extent double, accepted boolean")


def grammar(events: DataFrame, key: str, order: str, cost_bounce: str, cost_hit: str, repeat: float = 1.0) -> DataFrame:
    """Adds ``kind``: the cheapest labelling by bounce and hit, where repeating a label costs extra.

    Dynamic programming with two states over a key's ordered events; ties prefer bounce.
    """
    schema = events.withColumn("kind", F.lit("")).schema

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order, kind="stable")
        own = p[[cost_bounce, cost_hit]].to_numpy(float)
        total, back = own[0].copy(), []
        for c in own[1:]:
            step = total[:, None] + np.array([[repeat, 0.0], [0.0, repeat]])
            back.append(np.argmin(step, axis=0))
            total = step.min(axis=0) + c
        state, path = int(np.argmin(total)), []
        for b in reversed(back):
            path.append(state)
            state = int(b[state])
        path.append(state)
        return p.assign(kind=[("bounce", "hit")[s] for s in reversed(path)])

    return events.groupBy(key).applyInPandas(label, schema)


def hit_ends(events: DataFrame, key: str, order: str, kind: str, half: str) -> DataFrame:
    """Hits with the end they come from: the half of the bounce before, else the one across the bounce after."""
    w = over(key, order)
    island = F.sum((F.col(kind) == "hit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = events.withColumn("__i", F.coalesce(island, F.lit(0)))
    # the bounces since the last hit belong to this one
    before = F.last(F.when(F.col(kind) == "bounce", F.col(half)), True).over(over([key, "__i"], order))
    d = d.withColumn("__before", before)
    nxt = F.lead(F.when(F.col(kind) == "bounce", F.col(half))).over(w)
    end = F.coalesce("__before", F.when(nxt == "near", "far").when(nxt == "far", "near"))
    return d.withColumn("end", end).where(F.col(kind) == "hit").drop("__i", "__before")


def even_samples(df: DataFrame, key: str, order: str, count: int = 15) -> DataFrame:
    """Up to ``count`` rows of a key, evenly spaced from the first to the last."""
    d = df.withColumn("__k", F.row_number().over(over(key, order)) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: F.bround(j * (F.col("__n") - 1) / (count - 1), 0).cast("int"))
    return d.where(F.array_contains(picks, F.col("__k"))).drop("__k", "__n")
