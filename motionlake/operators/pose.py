"""Pose frames to swings: validity, body frame, handedness, contact, phases, angles, shot type.

A frame row has seq_id, frame, ts_s, detected and landmarks, an array of 33 structs (x, y, z,
visibility) in image shares.  All steps are column expressions and windows over (seq_id, frame).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import angle_deg, clip, cut, over, ratio, whole, wrapped_deg
from motionlake.operators import series

#: Landmark numbers, and the twelve that make the core of a body.
NOSE, SHOULDERS, ELBOWS, WRISTS, HIPS, KNEES, ANKLES = 0, (11, 12), (13, 14), (15, 16), (23, 24), (25, 26), (27, 28)
CORE = (*SHOULDERS, *ELBOWS, *WRISTS, *HIPS, *KNEES, *ANKLES)
VISIBLE, JUMP_TU, TORSO_CHANGE, CORE_COVERAGE = 0.5, 0.25, 0.35, 0.9
READY_EXIT, FOLLOW_EXIT, MIN_PHASE = 0.10, 0.15, 2
PHASES = ("ready", "takeback", "forward_swing", "contact", "follow_through")
SHOT_CLASSES = ("forehand_topspin", "forehand_slice", "backhand_one_handed", "backhand_two_handed", "serve", "volley")


def lm(k: int, field: str) -> Column:
    return F.col("landmarks")[k][field]


def frames(df: DataFrame, width: str = "width_px", height: str = "height_px") -> DataFrame:
    """Adds valid, the hip origin, torso length, and ``body``: landmarks about the hip, upright, in heights."""
    vis = sum((lm(k, "visibility") for k in CORE), F.lit(0.0)) / len(CORE)
    aspect = F.col(width) / F.col(height)
    df = df.withColumn("valid", F.col("detected") & (vis >= VISIBLE))
    flat = {"x": lambda p: p["x"] * aspect, "y": lambda p: -p["y"]}
    mid = lambda pair, c: (flat[c](F.col("landmarks")[pair[0]]) + flat[c](F.col("landmarks")[pair[1]])) / 2.0
    df = df.withColumn("ox", mid(HIPS, "x")).withColumn("oy", mid(HIPS, "y")).withColumn("torso", F.hypot(mid(SHOULDERS, "x") - mid(HIPS, "x"), mid(SHOULDERS, "y") - mid(HIPS, "y")))
    return df.withColumn("body", F.transform("landmarks", lambda p: F.struct((flat["x"](p) - F.col("ox")).alias("x"), (flat["y"](p) - F.col("oy")).alias("y"), p["visibility"].alias("v"))))


def torso_scale(fr: DataFrame) -> DataFrame:
    """(seq_id, scale): median positive torso length of the valid frames, of all if none is, else 0."""
    good = F.median(F.when(F.col("valid") & (F.col("torso") > 0), F.col("torso")))
    return fr.groupBy("seq_id").agg(F.coalesce(good, F.median(F.when(F.col("torso") > 0, F.col("torso"))), F.lit(0.0)).alias("scale"))


def identity_unstable(fr: DataFrame) -> DataFrame:
    """(seq_id, unstable): whether the hips jump or the torso changes between neighbouring valid frames."""
    w = over("seq_id", "frame")
    v = fr.where("valid").join(torso_scale(fr), "seq_id")
    jump = ratio(F.hypot(F.col("ox") - F.lag("ox").over(w), F.col("oy") - F.lag("oy").over(w)), F.col("scale")) > JUMP_TU
    change = ratio(F.abs(F.col("torso") - F.lag("torso").over(w)), F.lag("torso").over(w)) > TORSO_CHANGE
    flagged = v.withColumn("u", F.coalesce(jump, F.lit(False)) | F.coalesce(change, F.lit(False)))
    return fr.select("seq_id").distinct().join(flagged.groupBy("seq_id").agg(F.bool_or("u").alias("u")), "seq_id", "left").select("seq_id", F.coalesce("u", F.lit(False)).alias("unstable"))


def quality(fr: DataFrame) -> DataFrame:
    """(seq_id, frames, coverage, longest_gap, usable) of each sequence."""
    base = fr.groupBy("seq_id").agg(F.count(F.lit(1)).alias("frames"), F.avg(F.col("valid").cast("double")).alias("coverage"))
    out = base.join(series.longest_gap(fr, "seq_id", "frame", "valid"), "seq_id").join(torso_scale(fr), "seq_id")
    return out.select("seq_id", "frames", "coverage", F.col("gap").alias("longest_gap"), ((F.col("coverage") >= CORE_COVERAGE) & (F.col("gap") <= series.MAX_GAP) & (F.col("scale") > 0)).alias("usable"))


def track(fr: DataFrame, landmark: int) -> DataFrame:
    """(seq_id, frame, ts_s, x, y, visible) of a landmark in torso lengths: filled, then smoothed."""
    t = fr.join(torso_scale(fr), "seq_id").select("seq_id", "frame", "ts_s", ratio(F.col("body")[landmark]["x"], F.col("scale")).alias("x"), ratio(F.col("body")[landmark]["y"], F.col("scale")).alias("y"), (F.col("valid") & (F.col("body")[landmark]["v"] >= VISIBLE)).alias("visible"))
    for c in ("x", "y"):
        t = series.fill_short(t, "seq_id", "frame", c, "visible").drop(c, "pos").withColumnRenamed("filled", c)
        t = series.smooth(t, "seq_id", "frame", c).drop(c).withColumnRenamed("smoothed", c)
    return t


def speed(tr: DataFrame) -> DataFrame:
    """Adds ``speed`` and ``reliable``: length of the central difference, and seen on both sides too."""
    w = over("seq_id", "frame")
    d = series.central_difference(tr, "seq_id", "frame", "x", "ts_s").withColumnRenamed("slope", "vx")
    d = series.central_difference(d, "seq_id", "frame", "y", "ts_s").withColumnRenamed("slope", "vy").withColumn("speed", F.hypot("vx", "vy"))
    return d.withColumn("reliable", F.col("visible") & F.lag("visible", 1, True).over(w) & F.lead("visible", 1, True).over(w))


def handedness(fr: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(seq_id, hand, confidence, detected): the wrist that travels further and reaches wider; a hint overrides.

    Confidence is half the sum of both margins times the worse visibility.  Where the votes disagree,
    the wrist further out decides in the frame where either is fastest, the right one if they are level,
    and confidence stays below a half.  A hint replaces the hand and is certain.
    """
    sides = {side: track(fr, k) for side, k in (("left", WRISTS[0]), ("right", WRISTS[1]))}
    per = None
    for side, t in sides.items():
        radius = t.groupBy("seq_id").agg(F.coalesce(F.max(F.when(F.col("visible"), F.hypot("x", "y"))), F.lit(0.0)).alias(f"{side}_reach"), F.avg(F.col("visible").cast("double")).alias(f"{side}_seen"))
        one = radius.join(series.path_length(t, "seq_id", "frame", "x", "y", "visible").withColumnRenamed("length", f"{side}_path"), "seq_id")
        per = one if per is None else per.join(one, "seq_id")
    fast = [speed(t).select("seq_id", "frame", F.struct("speed", F.hypot("x", "y").alias("out")).alias(side)) for side, t in sides.items()]
    quick = F.greatest("left.speed", "right.speed")
    at_peak = fast[0].join(fast[1], ["seq_id", "frame"]).groupBy("seq_id").agg(F.max(F.struct(quick.alias("speed"), (-F.col("frame")).alias("neg"), (F.col("right.out") >= F.col("left.out")).alias("right"))).alias("peak"))
    per = per.join(at_peak, "seq_id", "left")
    margin = lambda a, b: clip(F.coalesce(2.0 * ratio(F.abs(a - b), a + b), F.lit(0.0)), 0.0, 1.0)
    path, reach = F.col("right_path") > F.col("left_path"), F.col("right_reach") > F.col("left_reach")
    sure = clip(0.5 * (margin(F.col("right_path"), F.col("left_path")) + margin(F.col("right_reach"), F.col("left_reach"))) * F.least("left_seen", "right_seen"), 0.0, 1.0)
    right = F.when(path == reach, path).otherwise(F.coalesce("peak.right", F.lit(True)))
    out = per.withColumn("detected", F.when(right, "right").otherwise("left")).withColumn("confidence", F.when(path == reach, sure).otherwise(F.least(sure, F.lit(0.49)))).withColumn("hand", F.col("detected"))
    if hints is not None:
        out = out.join(hints.select("seq_id", F.col("hand").alias("hint")), "seq_id", "left").withColumn("hand", F.coalesce("hint", "hand"))
        out = out.withColumn("confidence", F.when(F.col("hint").isNotNull(), 1.0).otherwise(F.col("confidence")))
    return cut(out.select("seq_id", "hand", "confidence", "detected"))  # read several times further on


def racket_track(fr: DataFrame, hands: DataFrame) -> DataFrame:
    """The track of each sequence's racket wrist, with speed."""
    both = track(fr, WRISTS[0]).withColumn("hand", F.lit("left")).unionByName(track(fr, WRISTS[1]).withColumn("hand", F.lit("right")))
    return cut(speed(both.join(hands.select("seq_id", "hand"), ["seq_id", "hand"], "left_semi")))


def contact(racket: DataFrame) -> DataFrame:
    """(seq_id, frame, ts_s, peak_frame, peak_speed, prominence, confidence): the end of the fast plateau.

    The peak is the fastest reliable frame (any, without one); contact is the last of up to four
    frames from it on at 45 % of its speed or more, two at least.  Confidence rises with how far the
    peak stands out, times the share of reliable frames.
    """
    w = over("seq_id", "frame")
    r = racket.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(whole("seq_id")))
    best = r.groupBy("seq_id").agg(
        F.coalesce(F.max(F.when(F.col("reliable"), F.struct("speed", (-F.col("pos")).alias("neg")))), F.max(F.struct("speed", (-F.col("pos")).alias("neg")))).alias("b"), F.avg(F.col("reliable").cast("double")).alias("observed")
    )
    best = best.select("seq_id", (-F.col("b.neg")).alias("peak_frame"), F.col("b.speed").alias("peak_speed"), "observed")
    j = r.join(best, "seq_id").withColumn("ahead", F.col("pos") - F.col("peak_frame"))
    slow = F.min(F.when((F.col("ahead") > 0) & (F.col("speed") < 0.45 * F.col("peak_speed")), F.col("ahead")))
    plateau = j.groupBy("seq_id", "peak_frame", "peak_speed", "observed").agg(slow.alias("slow"), F.max("n").alias("n"))
    at = F.col("peak_frame") + clip(F.coalesce("slow", F.lit(4)), 2, 4) - 1
    found = plateau.withColumn("at", F.least(at, F.col("n") - 1))
    prom = series.prominence(racket.where("reliable"), "seq_id", "frame", "speed").select("seq_id", "prominence")
    out = found.join(prom, "seq_id", "left").join(r.select("seq_id", F.col("pos").alias("at"), "frame", "ts_s"), ["seq_id", "at"])
    ramp = 0.35 + 0.65 * clip((F.coalesce("prominence", F.lit(1.0)) - 1.1) / 1.4, 0.0, 1.0)
    return out.select("seq_id", "frame", "ts_s", "peak_frame", "peak_speed", "prominence", (ramp * F.col("observed")).alias("confidence")).transform(cut)


def phases(racket: DataFrame, contacts: DataFrame) -> DataFrame:
    """(seq_id, phase, start, end): five spans of frame positions that follow each other, end exclusive.

    Ready ends at the first reliable frame of a tenth of the peak speed, takeback at the frame
    furthest behind, contact is the frame and its neighbours, follow-through ends where speed falls
    to 15 %.  Starts never fall, and each phase has two frames where the sequence allows it.
    """
    w = over("seq_id", "frame")
    r = racket.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(whole("seq_id")))
    c = contacts.select("seq_id", F.col("frame").alias("cf"), "peak_speed").join(r.select("seq_id", F.col("frame").alias("cf"), F.col("pos").alias("cp"), F.col("x").alias("cx")), ["seq_id", "cf"])
    first = r.where("pos = 0").select("seq_id", F.col("x").alias("x0"))
    j = r.join(c, "seq_id").join(first, "seq_id").withColumn("forward", F.signum(F.col("cx") - F.col("x0")) * F.col("x"))
    rel, pos = F.col("reliable"), F.col("pos")
    b = j.groupBy("seq_id", "cp", "n").agg(
        F.min(F.when(rel & (F.col("speed") >= READY_EXIT * F.col("peak_speed")), pos)).alias("ready"),
        F.min_by("pos", F.when(rel & (pos <= F.col("cp")), F.col("forward"))).alias("back"),
        F.min(F.when(rel & (pos > F.col("cp") + 1) & (F.col("speed") < FOLLOW_EXIT * F.col("peak_speed")), pos)).alias("follow"),
    )
    starts = F.array(F.lit(0), F.coalesce("ready", F.lit(0)), F.coalesce("back", F.lit(0)), F.col("cp") - 1, F.col("cp") + 2, F.coalesce(F.col("follow"), F.col("n")))
    rising = F.aggregate(F.transform(starts, lambda s: F.least(F.greatest(s.cast("long"), F.lit(0).cast("long")), F.col("n").cast("long"))), F.array().cast("array<bigint>"), lambda acc, s: F.concat(acc, F.array(F.greatest(s, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long"))))))
    spans = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(F.element_at(F.array(*map(F.lit, PHASES)), k + 1).alias("phase"), F.element_at("r", k + 1).alias("start"), F.element_at("r", k + 2).alias("end")))
    return b.withColumn("r", rising).select("seq_id", F.inline(spans))


def tempo(ph: DataFrame, times: DataFrame) -> DataFrame:
    """(seq_id, tempo): duration of the takeback over that of the forward swing; null without either."""
    length = lambda name: F.max(F.when(F.col("phase") == name, F.col("t1") - F.col("t0")))
    t = times.withColumn("pos", F.row_number().over(over("seq_id", "frame")) - 1).select("seq_id", "pos", "ts_s")
    j = ph.join(t.withColumnsRenamed({"pos": "start", "ts_s": "t0"}), ["seq_id", "start"], "left").join(t.select("seq_id", (F.col("pos") + 1).alias("end"), F.col("ts_s").alias("t1")), ["seq_id", "end"], "left")
    return j.groupBy("seq_id").agg(ratio(length("takeback"), F.nullif(F.greatest(length("forward_swing"), F.lit(0.0)), F.lit(0.0))).alias("tempo"))


def joint_angle(a: int, b: int, c: int) -> Column:
    """Angle at landmark b of a frame's body; null where one of the three is not seen."""
    p = F.col("body")
    seen = (p[a]["v"] >= VISIBLE) & (p[b]["v"] >= VISIBLE) & (p[c]["v"] >= VISIBLE)
    return F.when(seen, angle_deg(p[a]["x"] - p[b]["x"], p[a]["y"] - p[b]["y"], p[c]["x"] - p[b]["x"], p[c]["y"] - p[b]["y"]))


def line_angle(a: int, b: int) -> Column:
    """Direction from landmark a to b in degrees."""
    p = F.col("body")
    return F.degrees(F.atan2(p[b]["y"] - p[a]["y"], p[b]["x"] - p[a]["x"]))


def axial_mean(df: DataFrame, key: str, angle: str) -> DataFrame:
    """(key, mean): circular mean of angles of lines, for which a half turn is no change."""
    two = F.radians(F.col(angle) * 2.0)
    m = F.degrees(F.atan2(F.avg(F.sin(two)), F.avg(F.cos(two)))) / 2.0
    return df.groupBy(key).agg(F.when(F.hypot(F.avg(F.sin(two)), F.avg(F.cos(two))) > 1e-9, F.pmod(m + 90.0, F.lit(180.0)) - 90.0).alias("mean"))


def net_turn(df: DataFrame, key: str, order: str, angle: str) -> DataFrame:
    """(key, turn): sum of the shortest turns of a line from row to row."""
    ahead = F.col(angle) - F.lag(angle).over(over(key, order)) + 90.0
    # a hair below 0 stays a turn of +90: pmod would round it up to 180 and then to 0
    step = ahead - 180.0 * F.floor(ahead / 180.0) - 90.0
    return df.withColumn("__s", step).groupBy(key).agg(F.sum("__s").alias("turn"))


def fitted_line(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, angle, deviation): direction of the total-least-squares line, and the root mean square off it."""
    out = df.groupBy(key).agg(F.var_pop(x).alias("a"), F.var_pop(y).alias("b"), F.covar_pop(x, y).alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    gap = F.hypot((F.col("a") - F.col("b")) / 2, F.col("c"))
    return out.select(key, (F.degrees(F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))) / 2).alias("angle"), F.sqrt(F.greatest((F.col("a") + F.col("b")) / 2 - gap, F.lit(0.0))).alias("deviation"))


def position_spread(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, spread): root mean square distance from the mean place."""
    return df.groupBy(key).agg(F.sqrt(F.var_pop(x) + F.var_pop(y)).alias("spread"))


def swing_metrics(fr: DataFrame, hands: DataFrame, contacts: DataFrame, ph: DataFrame) -> DataFrame:
    """One row for each sequence: the metrics at and around contact; null where they are not seen."""
    body = F.col("body")
    side = lambda left, right: F.when(F.col("hand") == "left", left).otherwise(right)
    scale = torso_scale(fr)
    numbered = fr.withColumn("pos", F.row_number().over(over("seq_id", "frame")) - 1)
    at = fr.join(contacts.select("seq_id", "frame", "peak_speed"), ["seq_id", "frame"]).join(hands, "seq_id").join(scale, "seq_id")
    wrist = lambda c: side(body[WRISTS[0]][c], body[WRISTS[1]][c])
    shoulder_y = side(body[SHOULDERS[0]]["y"], body[SHOULDERS[1]]["y"])
    now = at.select(
        "seq_id",
        F.col("peak_speed").alias("peak_hand_speed_tu_s"),
        side(joint_angle(11, 13, 15), joint_angle(12, 14, 16)).alias("elbow_angle_at_contact_deg"),
        ratio(wrist("y"), shoulder_y).alias("contact_height_ratio"),
        ratio(F.abs(wrist("x")), F.col("scale")).alias("contact_point_forward_tu"),
        ratio(F.hypot(body[15]["x"] - body[16]["x"], body[15]["y"] - body[16]["y"]), F.col("scale")).alias("wrist_separation_at_contact_tu"),
        wrapped_deg(line_angle(11, 12) - line_angle(23, 24)).alias("shoulder_hip_separation_deg"),
    )
    knees = F.least(joint_angle(23, 25, 27), joint_angle(24, 26, 28))
    swing = ph.groupBy("seq_id").agg(F.min(F.when(F.col("phase") == "takeback", F.col("start"))).alias("s0"), F.max("end").alias("s1"))
    inside = numbered.join(swing, "seq_id").where("pos >= s0 and pos < s1").join(scale, "seq_id")
    body_part = inside.groupBy("seq_id").agg(F.min(knees).alias("knee_flexion_min_deg"))
    head = position_spread(inside.withColumn("hx", ratio(body[NOSE]["x"], F.col("scale"))).withColumn("hy", ratio(body[NOSE]["y"], F.col("scale"))), "seq_id", "hx", "hy").withColumnRenamed("spread", "head_stillness_tu")
    return now.join(body_part, "seq_id", "left").join(head, "seq_id", "left")


def class_scores(evidence: DataFrame, key: str) -> DataFrame:
    """(key, class, score): evidence (key, classes, amount), split evenly among its classes, as shares of all."""
    e = evidence.select(key, F.explode("classes").alias("class"), (F.col("amount") / F.size("classes")).alias("a")).groupBy(key, "class").agg(F.sum("a").alias("a"))
    return e.withColumn("score", F.coalesce(ratio(F.col("a"), F.sum("a").over(whole(key))), F.lit(0.0))).drop("a")


def accept(scores: DataFrame, key: str, least: float = 0.45, margin: float = 0.15) -> DataFrame:
    """(key, class, score): the top class if it is likely enough and clear of the next, else unknown."""
    order = F.array_position(F.array(*map(F.lit, SHOT_CLASSES)), F.col("class"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), order)
    t = scores.withColumn("next", F.lead("score", 1, 0.0).over(w)).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    good = (F.col("score") >= least) & (F.col("score") - F.col("next") >= margin - 1e-12)
    return t.select(key, F.when(good, F.col("class")).otherwise("unknown").alias("class"), "score")


def shot_evidence(metrics: DataFrame) -> DataFrame:
    """(seq_id, classes, amount) by the rules on height, hands and spin."""
    rule = lambda cond, classes, amount: F.when(cond, F.struct(F.array(*map(F.lit, classes)).alias("classes"), F.lit(amount).alias("amount")))
    high = F.col("contact_height_ratio") > 1.3
    near = F.col("wrist_separation_at_contact_tu") < 0.35
    rules = F.array(
        rule(high, ("serve",), 1.0),
        rule(~high & near, ("backhand_two_handed",), 1.0),
        rule(~high & ~near, ("forehand_topspin", "forehand_slice", "backhand_one_handed"), 1.0),
        rule(~high & ~near & (F.col("swing_path_angle_deg") > 10), ("forehand_topspin",), 0.5),
        rule(~high & ~near & (F.col("swing_path_angle_deg") < -10), ("forehand_slice",), 0.5),
    )
    return metrics.select("seq_id", F.inline(F.filter(rules, lambda r: r.isNotNull())))
