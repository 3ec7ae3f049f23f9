"""A session on a court, from the candidates of its frames to flights, events, landings, rallies and a summary.

Sessions are analysed side by side in one plan: those that cannot be are refused before any work on
their frames, and a camera that is moved ends a session there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.functions import cut
from motionlake.operators import ballevents, court, flights, landing, rallies

#: Events by the names that landings and rallies know.
KINDS = {"net_contact": "net", "unknown_kink": "kink"}


@dataclass
class Analysis:
    """``sessions`` has a row for each; the others have rows of the sessions that are not refused."""

    sessions: DataFrame
    flights: DataFrame
    events: DataFrame
    landings: DataFrame
    rallies: DataFrame
    summary: DataFrame


def verdicts(frames: DataFrame, stability: DataFrame, maps: DataFrame, key: str, time: str = "time_s") -> DataFrame:
    """(key, fps, status, refusal_reason, analysed_until_s, bumped_at, shake_px): whether and until when each session is analysed.

    Refused are sessions of too few frames a second, with a moving or an unknown camera, and without a
    map; partial those whose camera is moved for good, until then; the others are complete.  Sessions are
    those with frames or a verdict on their camera.
    """
    seen = frames.groupBy(key).agg(F.max(time).alias("last"))
    rate = court.fps(frames, key, time)
    known = maps.select(key, F.lit(True).alias("mapped")).distinct()
    d = seen.join(rate, key, "left").join(stability.select(key, "verdict", "bumped_at", "rms"), key, "full").join(known, key, "left")
    reason = landing.refusal(F.col("fps"), F.col("verdict"), F.col("mapped"))
    status = F.when(reason.isNotNull(), "refused").when(F.col("bumped_at").isNotNull(), "partial").otherwise("complete")
    until = F.when(reason.isNull(), F.coalesce("bumped_at", "last"))
    return d.select(key, F.coalesce("fps", F.lit(0.0)).alias("fps"), status.alias("status"), reason.alias("refusal_reason"), until.alias("analysed_until_s"), "bumped_at", F.col("rms").alias("shake_px"))


def analyze(candidates: DataFrame, frames: DataFrame, stability: DataFrame, maps: DataFrame, hits: DataFrame, key: str, frame: str = "frame", doubles: bool = False) -> Analysis:
    """Flights, events, landings, rallies and the summary of every session.

    ``candidates``, ``frames`` (with time_s) and ``maps`` as flights.link takes them, ``maps`` with what landings need
    as court_maps gives it; ``stability`` as camera_stability gives it, of which rms, in pixels, widens
    places on the ground; ``hits`` as ballevents.detect takes them.  Frames, and hits of the pose, from a bump on do
    not count.  Bounces called out after which play went on become hits, and landings and calls follow.
    Flights, events and landings are tables, so that what comes after reads them once.
    """
    sessions = cut(verdicts(frames, stability, maps, key))
    good = sessions.where("status <> 'refused'").select(key, "bumped_at", "shake_px")
    before = lambda d: d.join(good.select(key, "bumped_at"), key).where(F.col("bumped_at").isNull() | (F.col("time_s") < F.col("bumped_at"))).drop("bumped_at")
    shown = before(frames)
    mapped = maps.drop("shake_px").join(good.select(key, "shake_px"), key)
    found = cut(flights.link(candidates.join(good.select(key), key, "left_semi"), shown, mapped, key, frame))
    seen = cut(ballevents.detect(found, mapped, before(hits), key))
    spans = found.where("detected").groupBy(key, "flight_id").agg(F.min("time_s").alias("t0"), F.max("time_s").alias("t1"))
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("kind")), F.col("kind"))
    events = seen.withColumnRenamed("time_s", "t").withColumn("kind", kind)
    events, _ = rallies.runs(events, spans, key)
    events, landings = landing.session_landings(events, mapped, key, doubles)
    landings = cut(landings)
    ends = landing.flight_ends(found.select(key, "flight_id", F.col("time_s").alias("t"), F.col("x").alias("u"), F.col("y").alias("v"), "detected"), mapped, key)
    ended = spans.join(ends, [key, "flight_id"], "left")
    return Analysis(sessions, found, events, landings, rallies.segment(events, landings, ended, key), landing.summary(landings, key))
