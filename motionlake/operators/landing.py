"""Landings: bounces on the ground with their uncertainty, calls, zones, and the map of a session.

Calibrations are a row for each session and join its events by key; everything after that is column
expressions, and windows over a session's runs of play.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionlake.functions import cut, over
from motionlake.operators import court
from motionlake.operators.court import CALL_Z, DOUBLES_HALF, HALF_LENGTH, PATCH_M, SERVICE_LINE, SINGLES_HALF

#: Metres of a ball's radius, of the band at the net and of the run-off around the court.
BALL_RADIUS, NET_BAND, RUNOFF_ACROSS, RUNOFF_ALONG = 0.0335, 0.25, 4.0, 8.0
#: A bounce below this confidence is weak; seconds within which play goes on; frames a second at least.
WEAK_CONFIDENCE, PLAY_ON_S, MIN_FPS = 0.5, 1.5, 24.0
ACROSS = ("near_baseline", "far_baseline", "near_service_line", "far_service_line")


def keypoints(spark: SparkSession) -> DataFrame:
    """(keypoint, x_m, y_m): the corners and crossings of a court that can be tapped."""
    rows = []
    for end, y in (("near", -1), ("far", 1)):
        for kind, half, at in (("doubles_corner", DOUBLES_HALF, HALF_LENGTH), ("singles_corner", SINGLES_HALF, HALF_LENGTH), ("service_corner", SINGLES_HALF, SERVICE_LINE)):
            rows += [(f"{end}_{side}_{kind}", sign * half, y * at) for side, sign in (("left", -1), ("right", 1))]
        rows.append((f"{end}_service_t", 0.0, y * SERVICE_LINE))
    return spark.createDataFrame(rows, "keypoint string, x_m double, y_m double")


def court_lines(spark: SparkSession) -> DataFrame:
    """(line, x0, y0, x1, y1): the lines of a court by their ends."""
    rows = []
    for end, y in (("near", -1), ("far", 1)):
        rows += [(f"{end}_baseline", -DOUBLES_HALF, y * HALF_LENGTH, DOUBLES_HALF, y * HALF_LENGTH), (f"{end}_service_line", -SINGLES_HALF, y * SERVICE_LINE, SINGLES_HALF, y * SERVICE_LINE)]
    for side, x in (("left", -1), ("right", 1)):
        rows += [(f"{side}_{kind}_sideline", x * half, -HALF_LENGTH, x * half, HALF_LENGTH) for kind, half in (("singles", SINGLES_HALF), ("doubles", DOUBLES_HALF))]
    rows.append(("centre_service_line", 0.0, -SERVICE_LINE, 0.0, SERVICE_LINE))
    return spark.createDataFrame(rows, "line string, x0 double, y0 double, x1 double, y1 double")


def half_edges(end: Column, doubles: bool) -> list[tuple[str, Column, Column, Column, Column]]:
    """Edges of the half at ``end``: (edge, line, where it is, which way is in along x, along y); the net is none."""
    kind, half = ("doubles", DOUBLES_HALF) if doubles else ("singles", SINGLES_HALF)
    near = end == "near"
    return [
        ("x_max", F.lit(f"right_{kind}_sideline"), F.lit(half), F.lit(-1.0), F.lit(0.0)),
        ("x_min", F.lit(f"left_{kind}_sideline"), F.lit(-half), F.lit(1.0), F.lit(0.0)),
        ("y", F.concat(end, F.lit("_baseline")), F.when(near, -HALF_LENGTH).otherwise(HALF_LENGTH), F.lit(0.0), F.when(near, 1.0).otherwise(-1.0)),
    ]


def box_edges(end: str, side: str) -> list[tuple[str, Column, Column, Column, Column]]:
    """Edges of the service box of a receiver at ``end``; the centre line belongs to both of its sides."""
    right = (end == "near") == (side == "deuce")
    inner = court.CENTRE_HALF
    x0, x1 = (-inner, SINGLES_HALF) if right else (-SINGLES_HALF, inner)
    lines = ("centre_service_line", "right_singles_sideline") if right else ("left_singles_sideline", "centre_service_line")
    y, way = (-SERVICE_LINE, 1.0) if end == "near" else (SERVICE_LINE, -1.0)
    return [
        ("x_max", F.lit(lines[1]), F.lit(x1), F.lit(-1.0), F.lit(0.0)),
        ("x_min", F.lit(lines[0]), F.lit(x0), F.lit(1.0), F.lit(0.0)),
        ("y", F.lit(f"{end}_service_line"), F.lit(y), F.lit(0.0), F.lit(way)),
    ]


def call(edges: list[tuple[str, Column, Column, Column, Column]], z: float = CALL_Z) -> Column:
    """(verdict, line, margin_m, sigma_m, radius_m, flags) of the bounce x, y, xx, yy, confidence, flags against edges.

    Out where an edge is missed by z deviations or more, in where all are cleared by as much, else too
    close.  An out ball is decided by the edge that it is furthest beyond, others by the edge that is
    nearest in deviations.  A weak bounce is too close whatever its place, as is one seen from one
    side only where a line across the court decides.
    """
    judged = []
    for name, line, at, wx, wy in edges:
        margin = (F.col("x") - at) * wx + (F.col("y") - at) * wy + PATCH_M
        sigma = F.sqrt(F.greatest(F.abs(wx) * F.col("xx") + F.abs(wy) * F.col("yy"), F.lit(0.0)))
        near = F.when(sigma > 0, F.abs(margin) / F.nullif(z * sigma, F.lit(0.0))).when(margin == 0, 0.0).otherwise(float("inf"))
        judged.append(F.struct(near.alias("near"), F.lit(name).alias("edge"), line.alias("line"), margin.alias("margin"), sigma.alias("sigma")))
    every = F.array(*judged)
    beyond = F.filter(every, lambda j: j["margin"] <= -z * j["sigma"])
    out = F.array_min(F.transform(beyond, lambda j: F.struct(j["margin"], j["edge"], j["line"], j["sigma"])))
    other = F.array_min(F.transform(every, lambda j: F.struct(j["near"], j["edge"], j["line"], j["margin"], j["sigma"])))
    is_out = F.size(beyond) > 0
    line, margin, sigma = (F.when(is_out, out[c]).otherwise(other[c]) for c in ("line", "margin", "sigma"))
    plain = F.when(is_out, "out").when(F.forall(every, lambda j: j["margin"] >= z * j["sigma"]), "in").otherwise("too_close")
    has = lambda flag: F.array_contains("flags", flag)
    weak = (F.col("confidence") < WEAK_CONFIDENCE) | has("weak_bounce")
    one_sided = has("one_sided_bounce") & line.isin(*ACROSS)
    flags = F.array_compact(F.array(F.when(weak, "weak_bounce"), F.when(one_sided, "one_sided_bounce")))
    return F.struct(F.when(F.size(flags) > 0, "too_close").otherwise(plain).alias("verdict"), line.alias("line"), margin.alias("margin_m"), sigma.alias("sigma_m"), (z * sigma).alias("radius_m"), flags.alias("flags"))


def on_ground(events: DataFrame, calibrations: DataFrame, key: str) -> DataFrame:
    """Adds x, y, xx, xy, yy and half of events u, v (pixels) with covariance uu, uv, vv.

    ``calibrations`` has for each key h (image to court), cam_x, cam_y, cam_z, shake_px, sigma_tap_px and
    wobble, pairs of maps with one tap moved either way and by how much in all.  A ball's centre is above the point where
    its ray meets the ground: places and deviations shrink towards the camera's foot by the same share.
    """
    d = events.join(calibrations, key)
    h = [F.element_at("h", k + 1) for k in range(9)]
    u, v = F.col("u"), F.col("v")
    x, y = court.homography(h, u, v)
    shake = F.coalesce(F.col("shake_px"), F.lit(0.0)) ** 2
    xx, xy, yy = court.propagated(court.jacobian(h, u, v), F.col("uu") + shake, F.col("uv"), F.col("vv") + shake)
    at = lambda m: court.homography([F.element_at(m, k + 1) for k in range(9)], u, v)

    def moved(w):
        (ax, ay), (bx, by) = at(w["plus"]), at(w["minus"])
        return F.struct(((ax - bx) / w["step"]).alias("dx"), ((ay - by) / w["step"]).alias("dy"))

    d = d.withColumn("__moved", F.transform("wobble", moved))
    tap = F.col("sigma_tap_px") ** 2
    total = lambda f: tap * F.aggregate("__moved", F.lit(0.0), lambda acc, m: acc + f(m))
    share = (F.col("cam_z") - BALL_RADIUS) / F.col("cam_z")
    d = d.withColumn("x", F.col("cam_x") + share * (x - F.col("cam_x"))).withColumn("y", F.col("cam_y") + share * (y - F.col("cam_y")))
    d = d.withColumn("xx", (xx + total(lambda m: m["dx"] * m["dx"])) * share**2).withColumn("xy", (xy + total(lambda m: m["dx"] * m["dy"])) * share**2)
    d = d.withColumn("yy", (yy + total(lambda m: m["dy"] * m["dy"])) * share**2).withColumn("half", court.half(F.col("y")))
    return d.select(*events.columns, "x", "y", "xx", "xy", "yy", "half")


def ground_place(h: Column, x: Column, y: Column) -> Column:
    """The court place under a hitter's feet; null where not measured or far off the court."""
    u, v = court.homography([F.element_at(h, k + 1) for k in range(9)], x, y)
    near = (F.abs(u) <= DOUBLES_HALF + RUNOFF_ACROSS) & (F.abs(v) <= HALF_LENGTH + RUNOFF_ALONG)
    return F.when(near, F.struct(u.alias("x"), v.alias("y")))


def landings(events: DataFrame, calibrations: DataFrame, key: str, doubles: bool = False) -> DataFrame:
    """One row for each bounce: its place, hitter, target, call and zones.

    ``events``: run, event_id, t, kind (hit, bounce, net), u, v, uu, uv, vv, confidence, flags, end and shot_type
    of hits.  The hitter is that of the last hit of the run before the bounce, and the target the half
    across from that end.  A bounce on the hitter's own side without a net contact between means that a hit was
    missed: then, and without any hit, the bounce is called against the half that it is in.  At the
    net, or on the hitter's side after a net contact, no call is made, nor by a calibration that does
    not allow calls (``calls_allowed``).
    """
    w = over([key, "run"], "t", "event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = on_ground(events, calibrations, key).join(calibrations.select(key, "calls_allowed"), key)
    hit = F.when(F.col("kind") == "hit", F.struct("end", "shot_type", F.col("t").alias("at"), F.col("event_id").alias("hit_id")))
    d = d.withColumn("hit", F.last(hit, True).over(before)).withColumn("net_t", F.max(F.when(F.col("kind") == "net", F.col("t"))).over(before)).where("kind = 'bounce'")
    net_first = F.coalesce((F.col("net_t") > F.col("hit.at")) & (F.col("net_t") < F.col("t")), F.lit(False))
    own = F.coalesce(F.col("hit.end") == F.col("half"), F.lit(False))
    d = d.withColumn("hit", F.when(~(own & ~net_first), F.col("hit")))
    d = d.withColumn("hitter_end", F.col("hit.end")).withColumn("shot_type", F.col("hit.shot_type"))
    across = F.when(F.col("hitter_end") == "near", "far").when(F.col("hitter_end") == "far", "near")
    d = d.withColumn("target", F.when(F.col("hitter_end").isNull(), "half_only").otherwise("doubles_half" if doubles else "singles_half")).withColumn("target_end", F.coalesce(across, "half"))
    along = F.sqrt(F.greatest("yy", F.lit(0.0)))
    d = d.withColumn("sigma_along", along).withColumn("at_net", F.abs("y") <= F.greatest(F.lit(NET_BAND), CALL_Z * along))
    uncalled = F.col("at_net") | F.coalesce(F.col("hitter_end") == F.col("half"), F.lit(False)) | ~F.col("calls_allowed")
    d = d.withColumn("call", F.when(~uncalled, call(half_edges(F.col("target_end"), doubles))))
    for end in ("near", "far"):
        for side in ("deuce", "ad"):
            d = d.withColumn(f"box_{end}_{side}", F.when(F.col("calls_allowed"), call(box_edges(end, side))["verdict"]))
    deep = F.abs(F.col("y"))
    chances = court.depth_probabilities(deep, F.col("sigma_along"))
    low, high = F.greatest(deep - CALL_Z * F.col("sigma_along"), F.lit(0.0)), deep + CALL_Z * F.col("sigma_along")
    d = d.withColumn("depth_zone", court.depth_zone(deep)).withColumn("depth_confident", (court.depth_zone(low) == F.col("depth_zone")) & (court.depth_zone(high) == F.col("depth_zone")))
    d = d.withColumn("depth", F.struct(*(p.alias(zone) for zone, p in chances.items()))).withColumn("width_zone", court.width_zone(F.col("x")))
    boxes = [f"box_{e}_{s}" for e in ("near", "far") for s in ("deuce", "ad")]
    return d.select(
        key, "run", "event_id", "t", "x", "y", "xx", "xy", "yy", "half", "confidence", "flags", "hitter_end", "shot_type", (F.coalesce(F.col("shot_type") == "serve", F.lit(False))).alias("is_serve"), F.col("hit.hit_id").alias("hit_id"),
        "target", "at_net", "call", *boxes, "depth_zone", "depth_confident", "depth", "width_zone", "sigma_along",
    )


def played_on(events: DataFrame, found: DataFrame, key: str, within: float = PLAY_ON_S) -> DataFrame:
    """(key, event_id, end): bounces called out after which play went on, so that they were hits from that end.

    The next bounce, soon and without a hit between, is in the other half.
    """
    d = events.select(key, "event_id", "t", "kind").join(found.select(key, "event_id", "half", F.col("call.verdict").alias("verdict")), [key, "event_id"], "left").where(F.col("kind").isin("hit", "bounce"))
    w = over(key, "t", "event_id")
    for c in ("kind", "t", "half"):
        d = d.withColumn(f"next_{c}", F.lead(c).over(w))
    hit = (F.col("kind") == "bounce") & (F.col("verdict") == "out") & (F.col("next_kind") == "bounce") & (F.col("next_half") != F.col("half")) & (F.col("next_t") - F.col("t") <= within)
    return d.where(hit).select(key, "event_id", F.col("half").alias("end"))


def session_landings(events: DataFrame, calibrations: DataFrame, key: str, doubles: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, landings): landings, once bounces that were hits are events of that kind.

    Landings are not written here, so that what a reader leaves out of them is not worked out.
    """
    hits = cut(played_on(events, landings(events, calibrations, key, doubles), key).withColumnRenamed("end", "__end"))
    d = events.join(hits, [key, "event_id"], "left")
    was = F.col("__end").isNotNull()
    d = d.withColumn("kind", F.when(was, "hit").otherwise(F.col("kind"))).withColumn("end", F.when(was, F.col("__end")).otherwise(F.col("end")))
    d = d.withColumn("flags", F.when(was, F.array_append(F.coalesce("flags", F.array().cast("array<string>")), "out_bounce_relabelled_hit")).otherwise(F.col("flags"))).select(events.columns)
    d = cut(d)
    return d, landings(d, calibrations, key, doubles)


def summary(found: DataFrame, key: str) -> DataFrame:
    """(key, count, in, out, too_close, expected landings of each depth zone, width counts, median_sigma_along)."""
    verdicts = [F.count_if(F.col("call.verdict") == v).alias(v) for v in court.VERDICTS]
    depth = [F.sum(F.col(f"depth.{z}")).alias(f"expected_{z}") for z in court.DEPTH_ZONES]
    width = [F.count_if(F.col("width_zone") == z).alias(z) for z in court.WIDTH_ZONES]
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("count"), *verdicts, *depth, *width, F.median("sigma_along").alias("median_sigma_along"))


def refusal(fps: Column, stability: Column, calibrated: Column) -> Column:
    """Why a session cannot be analysed, the first reason that holds; null where it can."""
    return (
        F.when(F.coalesce(fps, F.lit(0.0)) < MIN_FPS, "frame_rate_too_low").when(stability == "moving", "camera_moving")
        .when(F.coalesce(stability, F.lit("unknown")) == "unknown", "camera_unknown").when(~F.coalesce(calibrated, F.lit(False)), "not_calibrated")
    )


def flight_ends(samples: DataFrame, calibrations: DataFrame, key: str) -> DataFrame:
    """(key, flight_id, half): the side of the net where each flight was last seen; ``samples`` has flight_id, t, u, v, detected."""
    last = samples.where("detected").groupBy(key, "flight_id").agg(F.max_by(F.struct("u", "v"), "t").alias("p"))
    d = last.join(calibrations.select(key, "h"), key)
    _, y = court.homography([F.element_at("h", k + 1) for k in range(9)], F.col("p.u"), F.col("p.v"))
    return d.withColumn("__y", y).where(F.col("__y").isNotNull() & (F.abs("__y") < float("inf"))).select(key, "flight_id", court.half(F.col("__y")).alias("half"))
