"""One swing measured: spans of its phases, the racket wrist's path, and what tells shots apart.

Frames are rows; a swing's numbers are aggregates over the rows of a span, and null where too little
was seen.  Lengths are in torso lengths, with the middle of the hips as origin and y upwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions import angle_deg, over, ratio
from motionlake.operators import series
from motionlake.operators.pose import ANKLES, ELBOWS, HIPS, KNEES, NOSE, SHOULDERS, VISIBLE, WRISTS, axial_mean, torso_scale

#: Frames before and after contact of the path's fit, points that a fit needs, frames
#: before contact where the wrist's lag is read, frames around contact for the wrists' distance.
PATH_BEFORE, PATH_AFTER, FIT_POINTS, LAG_LEAD, NEAR_CONTACT, LEAST_NORM = 6, 3, 3, 3, 3, 1e-9
#: Torso lengths that a line of the body has at least, frames that a turn needs, and those of its start.
SHOULDER_LINE_TU, HIP_LINE_TU, TURN_FRAMES, TURN_START = 0.10, 0.08, 5, 3


def in_torsos(fr: DataFrame) -> DataFrame:
    """(seq_id, frame, ts_s, pos, marks): frames numbered from 0, landmarks x, y in torso lengths and whether seen."""
    d = fr.join(torso_scale(fr), "seq_id").withColumn("pos", F.row_number().over(over("seq_id", "frame")) - 1)
    s = F.nullif(F.col("scale"), F.lit(0.0))
    marks = F.transform("body", lambda p: F.struct((p["x"] / s).alias("x"), (p["y"] / s).alias("y"), (F.col("valid") & (p["v"] >= VISIBLE)).alias("seen")))
    return d.select("seq_id", "frame", "ts_s", "pos", marks.alias("marks"))


def seen(*landmarks: int) -> Column:
    """Whether all of some landmarks are seen in a frame."""
    return F.forall(F.array(*(F.col("marks")[k]["seen"] for k in landmarks)), lambda s: F.coalesce(s, F.lit(False)))


def racket(hand: Column, field: str, pair: tuple[int, int] = WRISTS) -> Column:
    """A coordinate of the racket side's landmark; null where the hand is not known."""
    m = F.col("marks")
    return F.when(hand == "left", m[pair[0]][field]).when(hand == "right", m[pair[1]][field])


def phase_span(phases: DataFrame, name: str) -> DataFrame:
    """(seq_id, first, last), inclusive, of a phase that is not empty; ``phases`` has seq_id, phase, start, end exclusive."""
    return phases.where((F.col("phase") == name) & (F.col("end") > F.col("start"))).select("seq_id", F.col("start").alias("first"), (F.col("end") - 1).alias("last"))


def swing_span(phases: DataFrame) -> DataFrame:
    """(seq_id, first, last) from the start of the takeback to the end of the follow-through."""
    a = phase_span(phases, "takeback").select("seq_id", "first")
    return a.join(phase_span(phases, "follow_through").select("seq_id", "last"), "seq_id").where("last >= first")


def within(marks: DataFrame, span: DataFrame) -> DataFrame:
    """Frames of each sequence from ``first`` to ``last``."""
    return marks.join(span, "seq_id").where((F.col("pos") >= F.col("first")) & (F.col("pos") <= F.col("last")))


def around(contacts: DataFrame, before: int, after: int) -> DataFrame:
    """(seq_id, first, last) around a contact at ``pos``."""
    return contacts.select("seq_id", (F.col("pos") - before).alias("first"), (F.col("pos") + after).alias("last"))


def largest_signed(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the value furthest from zero, with its sign; null where one is missing or not finite."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return df.groupBy(key).agg(F.when(~F.bool_or(bad), F.max_by(value, F.abs(value))).alias(value))


def forward_fold(angle: Column) -> Column:
    """A direction of travel as rise over forward run, -90 to 90 degrees: leftward travel is mirrored."""
    return F.when(angle > 90.0, 180.0 - angle).when(angle < -90.0, -180.0 - angle).otherwise(angle)


def swing_path(marks: DataFrame, contacts: DataFrame, hands: DataFrame) -> DataFrame:
    """(seq_id, angle_deg, deviation_tu): the line through the racket wrist's path around contact, and the root mean square off it.

    The line of least perpendicular squares, turned the way that the wrist goes; positive is from low
    to high, whichever side the camera stood on.
    """
    d = within(marks, around(contacts, PATH_BEFORE, PATH_AFTER)).join(hands.select("seq_id", "hand"), "seq_id")
    d = d.select("seq_id", "pos", racket(F.col("hand"), "x").alias("x"), racket(F.col("hand"), "y").alias("y"), racket(F.col("hand"), "seen").alias("seen")).where("seen")
    g = d.groupBy("seq_id").agg(
        F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"), F.count(F.lit(1)).alias("n"),
        F.max_by(F.struct("x", "y"), "pos").alias("z"), F.min_by(F.struct("x", "y"), "pos").alias("s"),
    ).where((F.col("n") >= FIT_POINTS) & (F.col("a") + F.col("b") > LEAST_NORM**2))
    turn = F.atan2(2 * F.col("c"), F.col("a") - F.col("b")) / 2
    back = F.cos(turn) * (F.col("z.x") - F.col("s.x")) + F.sin(turn) * (F.col("z.y") - F.col("s.y")) < 0
    angle = F.degrees(F.atan2(F.when(back, -F.sin(turn)).otherwise(F.sin(turn)), F.when(back, -F.cos(turn)).otherwise(F.cos(turn))))
    least = (F.col("a") + F.col("b")) / 2 - F.hypot((F.col("a") - F.col("b")) / 2, F.col("c"))
    return g.select("seq_id", forward_fold(angle).alias("angle_deg"), F.sqrt(F.greatest(least, F.lit(0.0))).alias("deviation_tu"))


def wrist_lag(marks: DataFrame, contacts: DataFrame, hands: DataFrame) -> DataFrame:
    """(seq_id, lag_deg): angle between the forearm and the wrist's velocity shortly before contact."""
    d = marks.join(hands.select("seq_id", "hand"), "seq_id")
    d = d.withColumn("x", racket(F.col("hand"), "x")).withColumn("y", racket(F.col("hand"), "y"))
    for c in ("x", "y"):
        d = series.central_difference(d, "seq_id", "pos", c, "ts_s").withColumnRenamed("slope", f"v{c}")
    at = d.join(contacts.select("seq_id", (F.col("pos") - LAG_LEAD).alias("pos")), ["seq_id", "pos"])
    hand = F.col("hand")
    fx, fy = F.col("x") - racket(hand, "x", ELBOWS), F.col("y") - racket(hand, "y", ELBOWS)
    good = racket(hand, "seen") & racket(hand, "seen", ELBOWS) & (F.hypot(fx, fy) >= LEAST_NORM) & (F.hypot("vx", "vy") >= LEAST_NORM)
    return at.select("seq_id", F.when(good, angle_deg(fx, fy, F.col("vx"), F.col("vy"))).alias("lag_deg"))


def follow_through_height(marks: DataFrame, contacts: DataFrame, hands: DataFrame) -> DataFrame:
    """(seq_id, height_tu): how far above the middle of the shoulders the racket wrist gets after contact."""
    d = marks.join(contacts.select("seq_id", F.col("pos").alias("at")), "seq_id").where("pos > at").join(hands.select("seq_id", "hand"), "seq_id")
    m = F.col("marks")
    above = racket(F.col("hand"), "y") - (m[SHOULDERS[0]]["y"] + m[SHOULDERS[1]]["y"]) / 2
    good = racket(F.col("hand"), "seen") & seen(*SHOULDERS)
    return d.groupBy("seq_id").agg(F.max(F.when(good, above)).alias("height_tu"))


def wrist_separations(marks: DataFrame, contacts: DataFrame, half_width: int = NEAR_CONTACT) -> DataFrame:
    """(seq_id, separations): distances of the wrists in the frames around contact in which both are seen, in order."""
    d = within(marks, around(contacts, half_width, half_width)).where(seen(*WRISTS))
    m = F.col("marks")
    far = F.hypot(m[WRISTS[0]]["x"] - m[WRISTS[1]]["x"], m[WRISTS[0]]["y"] - m[WRISTS[1]]["y"])
    return d.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", far.alias("d")))), lambda s: s["d"]).alias("separations"))


def at_contact(marks: DataFrame, contacts: DataFrame, hands: DataFrame) -> DataFrame:
    """(seq_id, across_tu, above_nose): the racket wrist at contact, along the shoulders from their middle, and against the nose.

    Positive across is on the racket's side of the body, as in a forehand.  Both are null where the
    landmarks are not seen or the hand is not known.
    """
    d = marks.join(contacts.select("seq_id", "pos"), ["seq_id", "pos"]).join(hands.select("seq_id", "hand"), "seq_id")
    m, hand = F.col("marks"), F.col("hand")
    left, right = m[SHOULDERS[0]], m[SHOULDERS[1]]
    way = F.when(hand == "right", 1.0).when(hand == "left", -1.0)
    ax, ay = way * (right["x"] - left["x"]), way * (right["y"] - left["y"])
    wx, wy = racket(hand, "x") - (left["x"] + right["x"]) / 2, racket(hand, "y") - (left["y"] + right["y"]) / 2
    wrist = F.coalesce(racket(hand, "seen"), F.lit(False))
    return d.select(
        "seq_id", F.when(wrist & seen(*SHOULDERS), ratio(wx * ax + wy * ay, F.hypot(ax, ay))).alias("across_tu"), F.when(wrist & seen(NOSE), racket(hand, "y") > m[NOSE]["y"]).alias("above_nose")
    )


def swing_length(marks: DataFrame, phases: DataFrame, hands: DataFrame) -> DataFrame:
    """(seq_id, length_tu, duration_s): way of the racket wrist during the swing, of steps that are seen at both ends, and its time.

    With fewer than two frames in which the wrist is seen no way was measured.
    """
    d = within(marks, swing_span(phases)).join(hands.select("seq_id", "hand"), "seq_id")
    d = d.select("seq_id", "pos", "ts_s", racket(F.col("hand"), "x").alias("x"), racket(F.col("hand"), "y").alias("y"), F.coalesce(racket(F.col("hand"), "seen"), F.lit(False)).alias("seen"))
    way = series.path_length(d, "seq_id", "pos", "x", "y", "seen").withColumnRenamed("length", "__way")
    g = d.groupBy("seq_id").agg(F.count_if("seen").alias("n"), (F.max("ts_s") - F.min("ts_s")).alias("duration_s")).join(way, "seq_id", "left")
    return g.select("seq_id", F.when(F.col("n") >= 2, F.col("__way")).alias("length_tu"), "duration_s")


def line_turn(marks: DataFrame, phases: DataFrame, pair: tuple[int, int] = SHOULDERS, least_tu: float = SHOULDER_LINE_TU, line: str = "shoulder_line") -> DataFrame:
    """(seq_id, turn_deg, flag): how far the line between two landmarks turns during the swing, 0 to 90 degrees.

    A frame counts if both are seen and the line is not foreshortened below ``least_tu``.  The start is the mean
    direction of the first TURN_START such frames; the turn is the largest difference from it, once each has
    given way to the median of itself and its neighbours.  A line has no direction along itself, so that
    swapped landmarks change nothing.  With fewer than TURN_FRAMES such frames there is no turn, and a flag says
    whether foreshortening took any; sequences without a swing have no row.
    """
    m = F.col("marks")
    dx, dy = m[pair[1]]["x"] - m[pair[0]]["x"], m[pair[1]]["y"] - m[pair[0]]["y"]
    d = within(marks, swing_span(phases)).select("seq_id", "pos", seen(*pair).alias("both"), F.hypot(dx, dy).alias("long"), F.degrees(F.atan2(dy, dx)).alias("angle"))
    finite = F.coalesce(~F.isnan("long") & (F.col("long") < float("inf")), F.lit(False))
    d = d.withColumn("good", F.col("both") & finite & (F.col("long") >= least_tu)).withColumn("short", F.col("both") & finite & (F.col("long") < least_tu))
    per = d.groupBy("seq_id").agg(F.count_if("good").alias("n"), F.bool_or("short").alias("short"))
    g = d.where("good").withColumn("k", F.row_number().over(over("seq_id", "pos")))
    start = axial_mean(g.where(F.col("k") <= TURN_START), "seq_id", "angle").withColumnRenamed("mean", "start")
    off = F.abs(F.pmod(F.col("angle") - F.col("start") + 90.0, F.lit(180.0)) - 90.0)
    w = over("seq_id", "k")
    g = g.join(start, "seq_id").withColumn("b", off).withColumn("a", F.lag("b").over(w)).withColumn("c", F.lead("b").over(w))
    middle = F.col("a") + F.col("b") + F.col("c") - F.greatest("a", "b", "c") - F.least("a", "b", "c")
    peak = g.where("a is not null and c is not null").groupBy("seq_id").agg(F.max(middle).alias("peak"))
    few = F.col("n") < TURN_FRAMES
    flag = F.when(few & F.col("short"), f"{line}_foreshortened").when(few, f"{line}_too_few_frames")
    return per.join(peak, "seq_id", "left").select("seq_id", F.when(~few, F.least(F.greatest("peak", F.lit(0.0)), F.lit(90.0))).alias("turn_deg"), flag.alias("flag"))


def hip_turn(marks: DataFrame, phases: DataFrame) -> DataFrame:
    """The turn of the line of the hips."""
    return line_turn(marks, phases, HIPS, HIP_LINE_TU, "hip_line")


def turn_warning(metric: Column, flag: Column) -> Column:
    """The warning for a turn's flag; it begins with the flag."""
    return F.concat(flag, F.lit(": "), metric, F.lit(f" unavailable, fewer than {TURN_FRAMES} reliable frames in the swing (a frame needs both landmarks visible and the body line not foreshortened)"))


def front_leg(marks: DataFrame, contacts: DataFrame, directions: DataFrame) -> DataFrame:
    """(seq_id, side): left or right, the leg whose knee is further towards the target at contact, of those seen whole; the left if level."""
    at = marks.join(contacts.select("seq_id", "pos"), ["seq_id", "pos"]).join(directions.select("seq_id", "direction"), "seq_id")
    ahead = [F.when(seen(HIPS[k], KNEES[k], ANKLES[k]), F.col("marks")[KNEES[k]]["x"] * F.col("direction")) for k in (0, 1)]
    side = F.when(ahead[0].isNull() & ahead[1].isNull(), None).when(ahead[1].isNull() | (ahead[0] >= ahead[1]), "left").otherwise("right")
    return at.select("seq_id", side.alias("side")).where("side is not null")


def knee_flexion(marks: DataFrame, phases: DataFrame, contacts: DataFrame, directions: DataFrame) -> DataFrame:
    """(seq_id, angle_deg): the least angle at the front knee during the forward swing, of frames in which that leg is seen whole."""
    d = within(marks, phase_span(phases, "forward_swing")).join(front_leg(marks, contacts, directions), "seq_id")
    m = F.col("marks")

    def bend(k: int) -> Column:
        hip, knee, ankle = m[HIPS[k]], m[KNEES[k]], m[ANKLES[k]]
        return F.when(seen(HIPS[k], KNEES[k], ANKLES[k]), angle_deg(hip["x"] - knee["x"], hip["y"] - knee["y"], ankle["x"] - knee["x"], ankle["y"] - knee["y"]))

    return d.groupBy("seq_id").agg(F.min(F.when(F.col("side") == "left", bend(0)).otherwise(bend(1))).alias("angle_deg")).where("angle_deg is not null")
