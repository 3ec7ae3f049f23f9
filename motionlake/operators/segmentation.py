"""Sessions to swings: candidate peaks, windows that never overlap, status of each swing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import over
from motionlake.operators import series

#: Fixed values, in torso lengths per second and seconds.
FLOOR, RELATIVE, REFRACTORY_S, VALLEY = 3.0, 0.35, 0.6, 2.0
BEFORE_S, AFTER_S, MIN_BEFORE_S, MIN_AFTER_S = 2.0, 1.0, 0.5, 0.2


def refractory_frames(df: DataFrame, key: str, time: str) -> DataFrame:
    """(key, frames): the refractory time in median frame steps, at least one."""
    d = df.withColumn("__d", F.col(time) - F.lag(time).over(over(key, time)))
    return d.groupBy(key).agg(F.greatest(F.lit(1), F.bround(REFRACTORY_S / F.nullif(F.median("__d"), F.lit(0.0)), 0)).cast("int").alias("frames"))


def candidates(df: DataFrame, key: str, order: str, time: str, speed: str, separation: int) -> DataFrame:
    """(key, pos, time, speed, status): peaks some frames apart, and why some are no swing.

    A peak must pass a floor, a share of the 90th percentile of the peaks, and stand clear of the
    valleys towards its neighbours on both sides.
    """
    d = df.withColumn("pos", (F.row_number().over(over(key, order)) - 1).cast("long"))
    peaks = series.suppress(df, key, order, speed, separation).join(d.select(key, "pos", F.col(time).alias("time"), F.col(speed).alias("speed")), [key, "pos"])
    w = over(key, "pos")
    peaks = peaks.withColumn("prev", F.coalesce(F.lag("pos").over(w), F.lit(-1))).withColumn("next", F.coalesce(F.lead("pos").over(w), F.lit(1 << 62)))
    peaks = peaks.withColumn("p90", F.percentile("speed", 0.9).over(Window.partitionBy(key)))
    # every frame knows the peaks around it, so valleys need no range join
    marks = d.join(peaks.select(key, "pos", F.lit(1).alias("is_peak")), [key, "pos"], "left").withColumn("gap", F.sum(F.coalesce("is_peak", F.lit(0))).over(over(key, "pos")))
    valley = marks.where("is_peak is null").groupBy(key, "gap").agg(F.min(speed).alias("valley"))
    ranked = peaks.withColumn("__i", F.row_number().over(w))
    left = valley.select(key, (F.col("gap") + 1).alias("__i"), F.col("valley").alias("left"))
    right = valley.select(key, F.col("gap").alias("__i"), F.col("valley").alias("right"))
    j = ranked.join(left, [key, "__i"], "left").join(right, [key, "__i"], "left")
    clear = F.col("speed") >= VALLEY * F.greatest("left", "right")
    status = F.when(F.col("speed") < FLOOR, "below_floor").when(F.col("speed") < RELATIVE * F.col("p90"), "below_relative_floor").when(~clear, "no_valley").otherwise("accepted")
    return j.select(key, "pos", "time", "speed", F.coalesce(status, F.lit("accepted")).alias("status"))


def windows(accepted: DataFrame, key: str, bounds: DataFrame) -> DataFrame:
    """(key, pos, start, end, status): time around each peak, cut at the middle towards its neighbours.

    ``bounds`` has the first and last time of each key as t0 and t1.
    """
    w = over(key, "time")
    d = accepted.join(bounds, key)
    start = F.greatest(F.col("time") - BEFORE_S, F.col("t0"), F.coalesce((F.lag("time").over(w) + F.col("time")) / 2, F.col("t0")))
    end = F.least(F.col("time") + AFTER_S, F.col("t1"), F.coalesce((F.lead("time").over(w) + F.col("time")) / 2, F.col("t1")))
    d = d.withColumn("start", start).withColumn("end", end)
    short = (F.col("time") - F.col("start") < MIN_BEFORE_S) | (F.col("end") - F.col("time") < MIN_AFTER_S)
    return d.select(key, "pos", "start", "end", F.when(short, "window_too_short").otherwise("ok").alias("status"))


def status(confidence):
    return F.when(F.col(confidence) >= 0.45, "accepted").when(F.col(confidence) >= 0.35, "low_confidence").otherwise("rejected")


def frames_of(df: DataFrame, wins: DataFrame, key: str, time: str, bucket_s: float = 4.0) -> DataFrame:
    """Frames with the window they lie in; windows are dealt to buckets of time for an equal join."""
    b = lambda c: F.floor(F.col(c) / bucket_s)
    spread = wins.where("status = 'ok'").withColumn("__b", F.explode(F.sequence(b("start"), b("end"))))
    return df.withColumn("__b", b(time)).join(spread.select(key, "__b", F.col("pos").alias("window"), "start", "end"), [key, "__b"]).where((F.col(time) >= F.col("start")) & (F.col(time) < F.col("end"))).drop("__b", "start", "end")


def digest(df: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """(key, digest): SHA-256 over a session's rows in order, each number with four digits."""
    row = F.concat_ws(",", F.transform(values, lambda v: F.format_string("%.4f", v)))
    rows = df.select(key, F.struct(F.col(order).alias("o"), F.sha2(row, 256).alias("h")).alias("r"))
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"]), ""), 256).alias("digest"))
