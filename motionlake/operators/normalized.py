"""Pose sequences made comparable: landmarks about the hips in torso lengths, filled, smoothed, with
derivatives, and the verdict on whether a sequence can be used.

Landmarks are rows, so that filling, smoothing and differences are windows over one key; only the
place of the core window is sought in a sequence at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.functions import over, ratio, whole
from motionlake.operators import series
from motionlake.operators.groups import by_key
from motionlake.operators.pose import CORE, CORE_COVERAGE, VISIBLE, WRISTS, identity_unstable, lm, torso_scale

#: Fixed values, in seconds: the span in which a sequence is judged, and how far it may be moved.
CORE_S, MOVE_S = 2.0, 0.5
MARK = ["seq_id", "landmark"]


def normalized(fr: DataFrame, landmarks: tuple[int, ...] | None = None) -> DataFrame:
    """(seq_id, landmark, frame, ts_s, x, y, vx, vy, ax, ay, visibility, valid): every landmark, or those named, of every frame.

    Places are about the middle of the hips, upright, in torso lengths of the sequence (heights where it
    has none).  Gaps of up to three frames that are not valid are filled on the line, longer ones hold their
    ends; then five frames are smoothed, and central differences taken twice.  One shuffle by sequence and
    landmark carries all windows.
    """
    unit = F.coalesce(F.nullif(F.col("scale"), F.lit(0.0)), F.lit(1.0))
    d = fr.join(torso_scale(fr), "seq_id").select("seq_id", "frame", "ts_s", "valid", unit.alias("unit"), F.posexplode_outer("body").alias("landmark", "p"))
    # outer, as the filter that the optimiser infers for the other works out bodies within bodies, once a landmark and more
    d = d.where(F.col("landmark").isNotNull() if landmarks is None else F.col("landmark").isin(*landmarks))
    d = d.select("seq_id", "landmark", "frame", "ts_s", "valid", F.col("p.v").alias("visibility"), (F.col("p.x") / F.col("unit")).alias("x"), (F.col("p.y") / F.col("unit")).alias("y"))
    for c in ("x", "y"):
        d = series.fill_short(d, MARK, "frame", c, "valid").drop(c, "pos").withColumnRenamed("filled", c)
        d = series.smooth(d, MARK, "frame", c).drop(c).withColumnRenamed("smoothed", c)
    for c, to in (("x", "vx"), ("y", "vy"), ("vx", "ax"), ("vy", "ay")):
        d = series.central_difference(d, MARK, "frame", c, "ts_s").withColumnRenamed("slope", to)
    return d.select(*MARK, "frame", "ts_s", "x", "y", "vx", "vy", "ax", "ay", "visibility", "valid")


def swing_direction(marks: DataFrame) -> DataFrame:
    """(seq_id, direction): 1 or -1, the way along x of the wrist that travels further, from where it is slowest to where it is fastest.

    The slowest frame is sought up to the fastest; the first of equals counts, the right wrist if both
    travel as far.  Standing still and sequences of one frame go to 1.
    """
    w = marks.where(F.col("landmark").isin(*WRISTS)).withColumn("pos", F.row_number().over(over(MARK, "frame"))).withColumn("speed", F.hypot("vx", "vy"))
    path = series.path_length(w, MARK, "frame", "x", "y", F.lit(True)).withColumnRenamed("length", "path")
    fast = w.groupBy(*MARK).agg(F.max(F.struct("speed", (-F.col("pos")).alias("neg"), "x")).alias("fast"))
    slow = w.join(fast, MARK).where(F.col("pos") <= -F.col("fast.neg")).groupBy(*MARK).agg(F.min(F.struct("speed", "pos", "x")).alias("slow"), F.first("fast").alias("fast"))
    best = slow.join(path, MARK).groupBy("seq_id").agg(F.max(F.struct("path", "landmark", (F.col("fast.x") - F.col("slow.x")).alias("way"))).alias("b"))
    return best.select("seq_id", F.when(F.col("b.way") < 0, -1).otherwise(1).alias("direction"))


def span_at(t: np.ndarray, anchor: int, core_s: float = CORE_S) -> tuple[int, int]:
    """[start, end) of the span about a frame's time; moved, not cut, where it passes an end of the sequence."""
    low, high = t[anchor] - core_s / 2, t[anchor] - core_s / 2 + core_s
    if low < t[0]:
        low, high = t[0], min(t[-1], t[0] + core_s)
    if high > t[-1]:
        low, high = max(t[0], t[-1] - core_s), t[-1]
    start = min(int(np.searchsorted(t, low)), len(t) - 1)
    end = len(t) if high >= t[-1] else int(np.searchsorted(t, high))
    return start, max(start + 1, end)


def place_core(t: np.ndarray, valid: np.ndarray, reach: np.ndarray, core_s: float = CORE_S, move_s: float = MOVE_S) -> tuple[int, int]:
    """[start, end) of the span in which a sequence is judged.

    It lies about the middle of the longest run of valid frames, or, where that is longer than the span,
    about the run's frame of the widest reach; then it moves by at most ``move_s`` to where it holds
    the largest share of valid frames, the nearest such place, the earlier of equals.
    """
    edge = np.flatnonzero(np.diff(np.concatenate([[0], valid.astype(np.int8), [0]])))
    if not len(edge):
        return span_at(t, len(t) // 2, core_s)
    starts, ends = edge[::2], edge[1::2]
    k = int(np.argmax(ends - starts))
    first, last = int(starts[k]), int(ends[k])
    anchor = (first + last - 1) // 2
    a, b = span_at(t, anchor, core_s)
    if last - first > b - a:
        anchor = first + int(np.argmax(reach[first:last]))
    held = np.concatenate([[0], np.cumsum(valid)])
    options = [anchor, *np.flatnonzero(np.abs(t - t[anchor]) <= move_s).tolist()]
    spans = [span_at(t, c, core_s) for c in options]
    return max(zip(spans, options, strict=True), key=lambda x: ((held[x[0][1]] - held[x[0][0]]) / (x[0][1] - x[0][0]), -abs(t[x[1]] - t[anchor])))[0]


def core_windows(fr: DataFrame) -> DataFrame:
    """(seq_id, start, end, start_s, end_s, coverage, core_gap): the span in which each sequence is judged, end exclusive.

    Coverage is its share of valid frames, core_gap its longest run of others.  The reach of a frame is
    the distance of both wrists from the hips in its own torso lengths, 0 without a torso.
    """
    out = [F.coalesce(ratio(F.hypot(F.col("body")[k]["x"], F.col("body")[k]["y"]), F.when(F.col("torso") > 0, F.col("torso"))), F.lit(0.0)) for k in WRISTS]
    kind = dict(fr.dtypes)["seq_id"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        t, valid = pdf["ts_s"].to_numpy(float), pdf["valid"].fillna(False).to_numpy(bool)
        a, b = place_core(t, valid, pdf["reach"].to_numpy(float))
        off = np.flatnonzero(np.concatenate([[True], valid[a:b], [True]]))
        return pd.DataFrame([(pdf["seq_id"].iloc[0], a, b, t[a], t[b - 1], float(valid[a:b].mean()), int(np.diff(off).max() - 1))], columns=["seq_id", "start", "end", "start_s", "end_s", "coverage", "core_gap"])

    rows = fr.select("seq_id", "frame", "ts_s", "valid", (out[0] + out[1]).alias("reach"))
    return by_key(rows, "seq_id", ["frame"], one, f"seq_id {kind}, start int, end int, start_s double, end_s double, coverage double, core_gap int")


def core_quality(fr: DataFrame, height: str = "height_px") -> DataFrame:
    """(seq_id, frames_with_pose, frames_missing, detection_rate, mean_visibility, longest_gap, interpolated, torso_px, core..., usable, flags).

    Usable are sequences with a torso whose core is covered to CORE_COVERAGE, without a gap of more than
    three frames in it; a longer gap outside is flagged, as is another body that seems to take over.
    Interpolated counts the frames that were filled on the line.
    """
    vis = sum((lm(k, "visibility") for k in CORE), F.lit(0.0)) / len(CORE)
    base = fr.withColumn("vis", vis).groupBy("seq_id").agg(
        F.count_if("valid").alias("frames_with_pose"), F.count_if(~F.coalesce("valid", F.lit(False))).alias("frames_missing"),
        F.coalesce(F.avg(F.when(F.col("valid"), F.col("vis"))), F.lit(0.0)).alias("mean_visibility"), F.max(height).alias("height"),
    )
    gaps = series.runs(fr, "seq_id", "frame", "valid").withColumn("n", F.count(F.lit(1)).over(whole("seq_id"))).where("not valid")
    inner = gaps.where((F.col("run_start") > 0) & (F.col("run_end") < F.col("n")) & (F.col("run_length") <= series.MAX_GAP)).groupBy("seq_id").agg(F.count(F.lit(1)).alias("interpolated"))
    d = base.join(core_windows(fr), "seq_id").join(torso_scale(fr), "seq_id").join(identity_unstable(fr), "seq_id").join(series.longest_gap(fr, "seq_id", "frame", "valid"), "seq_id").join(inner, "seq_id", "left")
    usable = (F.col("frames_with_pose") > 0) & (F.col("scale") > 0) & (F.col("coverage") >= CORE_COVERAGE) & (F.col("core_gap") <= series.MAX_GAP)
    flags = F.array_compact(F.array(F.when(F.col("unstable"), "subject_identity_unstable"), F.when(usable & (F.col("gap") > series.MAX_GAP), "dead_time_outside_core")))
    return d.select(
        "seq_id", "frames_with_pose", "frames_missing", (F.col("frames_with_pose") / (F.col("frames_with_pose") + F.col("frames_missing"))).alias("detection_rate"), "mean_visibility", F.col("gap").alias("longest_gap"),
        F.coalesce("interpolated", F.lit(0)).alias("interpolated"), (F.col("scale") * F.col("height")).alias("torso_px"), "start_s", "end_s", "coverage", "core_gap", usable.alias("usable"), flags.alias("flags"),
    )


def marks_of(norm: DataFrame, landmarks: tuple[int, ...] | None = None) -> DataFrame:
    """(seq_id, frame, ts_s, pos, marks): the landmarks of each frame as one array, as the measures of a swing take them; seen are those visible by themselves.

    If ``norm`` has only some ``landmarks``, the others' places are null.
    """
    mark = F.struct("landmark", "x", "y", F.coalesce(F.col("visibility") >= VISIBLE, F.lit(False)).alias("seen"))
    d = norm.groupBy("seq_id", "frame", "ts_s").agg(F.array_sort(F.collect_list(mark)).alias("m"))  # 33 of them
    d = d.withColumn("pos", F.row_number().over(over("seq_id", "frame")) - 1)
    bare = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["seen"].alias("seen"))
    if landmarks is None:
        return d.select("seq_id", "frame", "ts_s", "pos", F.transform("m", bare).alias("marks"))
    at = {k: F.get("m", F.lit(i)) for i, k in enumerate(sorted(set(landmarks)))}
    return d.select("seq_id", "frame", "ts_s", "pos", F.array(*(bare(at[k]) if k in at else F.lit(None) for k in range(33))).alias("marks"))
