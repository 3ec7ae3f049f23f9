"""Readers and writers of recorded sessions; every schema is given, none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSE_FRAMES = (
    "seq_id string, frame int, ts_s double, detected boolean, width_px int, height_px int, "
    "landmarks array<struct<x: float, y: float, z: float, visibility: float>>, world array<struct<x: float, y: float, z: float>>"
)
SWINGS = (
    "session_id string, swing_index int, contact_time_s double, shot_type string, overall_score double, metrics map<string, double>, "
    "ball_speed_mph int, status string, user_excluded boolean"
)
CANDIDATES = "clip_id string, frame_index long, time_s double, x double, y double, area float, minor float, major float, orientation_deg float, colour_score float, contrast float"
POSE_HITS = "time_s double, wrist_u double, wrist_v double, end string, confidence double, shot_type string"
LABELS = "type string, frame int, u_px double, v_px double, visible boolean, session string"
SCORE_EVENTS = "match_id string, event_id string, sequence int, kind string, winner string, source string, rally_id string, supersedes string, basis string, needs_review boolean"


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Pose frames in Parquet; those without all 33 landmarks are marked, not dropped."""
    df = spark.read.schema(POSE_FRAMES).parquet(path)
    return df.withColumn("well_formed", F.coalesce((F.size("landmarks") == 33) & (F.size("world") == 33), F.lit(False)))


def labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ball labels and session labels out of one JSON-lines file; lines of other types are left out."""
    df = spark.read.schema(LABELS).json(path)
    return df.where("type = 'ball'").select("frame", "u_px", "v_px", "visible"), df.where("type = 'session'").select("session")


def pose_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSE_HITS).option("multiLine", "true").json(path)


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").schema("file_name string, visibility int, x double, y double, status int").csv(path)


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of all files below a path; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def bucket_and_key(path: Column) -> tuple[Column, Column]:
    parts = F.split(path, "/", 2)
    return parts[0], F.try_element_at(parts, F.lit(2))


def number(document: Column, path: str) -> Column:
    """A JSON number, or a numeric string; null for anything else."""
    return F.get_json_object(document, path).try_cast("double")


def whole(document: Column, path: str) -> Column:
    """A JSON number without a fraction; null for anything else."""
    v = number(document, path)
    return F.when(v == F.floor(v), v.cast("long"))


def target_times(spark: SparkSession, start: float, end: float, fps: float, most: int) -> DataFrame:
    """(target, t): evenly spaced times from start to before end, at most so many."""
    n = max(0, min(most, int((end - start) * fps + 1e-9)))
    return spark.range(n).select(F.col("id").alias("target"), (F.lit(start) + F.col("id") / fps).alias("t"))


def nearest_frames(frames_: DataFrame, targets: DataFrame, key: str, half_step: float) -> DataFrame:
    """(key, target, frame): the frame nearest to each target time, at most half a step away; the earlier of equals."""
    b = lambda c: F.floor(F.col(c) / half_step)
    near = targets.withColumn("b", F.explode(F.array(b("t") - 1, b("t"), b("t") + 1)))
    f = frames_.select(key, "frame", "ts_s", b("ts_s").alias("b"))
    gap = F.abs(F.col("ts_s") - F.col("t"))
    return f.join(near, "b").where(gap <= half_step).groupBy(key, "target").agg(F.min_by("frame", F.struct(gap, F.col("ts_s"))).alias("frame"))


def window_bounds(duration: Column, centre: Column, window: float) -> tuple[Column, Column]:
    """A window about a centre, moved to lie within the clip."""
    low = F.greatest(F.lit(0.0), F.least(centre - window / 2, duration - window))
    return low, F.least(duration, low + window)


def scaled(width: Column, height: Column, long_edge: float) -> tuple[Column, Column]:
    """A size whose longer edge is at most ``long_edge``; nothing grows."""
    k = F.least(F.lit(1.0), long_edge / F.greatest(width, height))
    return F.bround(width * k, 0).cast("int"), F.bround(height * k, 0).cast("int")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` under other keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def append(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition or [])).parquet(path)


def documents(df: DataFrame, keys: list[str], name: str = "payload") -> DataFrame:
    """(keys, payload): the other columns of a row as one JSON document."""
    return df.select(*keys, F.to_json(F.struct(*(c for c in df.columns if c not in keys))).alias(name))
