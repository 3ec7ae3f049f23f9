"""Queries of the operators on recordings: pose, segmentation, ball, inference, evaluation, sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake import sources
from motionlake.functions import cut, normal_cdf, over
from motionlake.operators import ball, ballevents, calibration, court, courtfit, courtsession, dashboard, evaluation, history, inference, landing, pose, rallies, segmentation, sessions, swing, textguard
from motionlake.operators import contacts as contacts_
from motionlake.operators import flights as flights_
from motionlake.operators import normalized, series
from motionlake.plans.registry import C, E, W, contacts, normal_sql, query, swings


def frames(read) -> DataFrame:
    """Vectors as pose frames: forty in a row are a sequence, pairs of components are landmarks."""
    e = read("embeddings")
    point = lambda k: F.struct(
        (F.col("embedding")[2 * k % 64].cast("double") + 0.1 * (k % 3)).alias("x"),
        (F.col("embedding")[(2 * k + 1) % 64].cast("double") + 0.03 * k).alias("y"),
        F.lit(0.0).alias("z"),
        F.when(F.col("embedding")[(k + 5) % 64] > -0.25, 1.0).otherwise(0.0).alias("visibility"),
    )
    rows = e.select(
        F.floor(F.col("vec_id") / 40).cast("long").alias("seq_id"), (F.col("vec_id") % 40).cast("int").alias("frame"), ((F.col("vec_id") % 40) / 30.0).alias("ts_s"),
        F.lit(True).alias("detected"), F.lit(720).alias("width_px"), F.lit(720).alias("height_px"), F.array(*map(point, range(33))).alias("landmarks"),
    )
    return pose.frames(rows)


_VIS = " + ".join(f"(CASE WHEN embedding[{(k + 5) % 64 + 1}] > -0.25 THEN 1.0 ELSE 0.0 END)" for k in pose.CORE)
_FR = f"""fr AS (SELECT vec_id // 40 AS seq_id, vec_id % 40 AS frame, ({_VIS}) / 12 >= 0.5 AS valid FROM embeddings)"""


@query(f"""WITH {_FR}, i AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY frame) - row_number() OVER (PARTITION BY seq_id, valid ORDER BY frame) AS isl FROM fr),
g AS (SELECT seq_id, count(*) AS n FROM i WHERE NOT valid GROUP BY seq_id, isl), m AS (SELECT seq_id, max(n) AS gap FROM g GROUP BY seq_id)
SELECT f.seq_id, count(*) AS frames, round(avg(valid::INT), 6) AS coverage, coalesce(any_value(gap), 0) AS longest_gap FROM fr f LEFT JOIN m USING (seq_id) GROUP BY f.seq_id""")
def pose_quality(read):
    return pose.quality(frames(read)).drop("usable")


_AT = lambda c, k: f"(embedding[{(2 * k + (c == 'y')) % 64 + 1}]::DOUBLE + {0.1 * (k % 3) if c == 'x' else 0.03 * k})"
_MID = lambda c, pair: f"({_AT(c, pair[0])} + {_AT(c, pair[1])}) / 2"
_BODY = f"""b AS (SELECT vec_id // 40 AS seq_id, vec_id % 40 AS frame, ({_VIS}) / 12 >= 0.5 AS valid, {_MID('x', pose.HIPS)} AS ox, -({_MID('y', pose.HIPS)}) AS oy,
sqrt(power({_MID('x', pose.SHOULDERS)} - {_MID('x', pose.HIPS)}, 2) + power({_MID('y', pose.SHOULDERS)} - {_MID('y', pose.HIPS)}, 2)) AS torso FROM embeddings),
sc AS (SELECT seq_id, coalesce(median(torso) FILTER (valid AND torso > 0), median(torso) FILTER (torso > 0), 0) AS scale FROM b GROUP BY seq_id)"""


@query(f"WITH {_BODY} SELECT seq_id, round(scale, 6) AS scale FROM sc")
def torso_scale(read):
    return pose.torso_scale(frames(read))


@query(f"""WITH {_BODY}, v AS (SELECT b.*, scale FROM b JOIN sc USING (seq_id) WHERE valid), u AS (SELECT seq_id, coalesce(sqrt(power(ox - lag(ox) OVER w, 2) + power(oy - lag(oy) OVER w, 2)) / nullif(scale, 0) > 0.25, false)
OR coalesce(abs(torso - lag(torso) OVER w) / nullif(lag(torso) OVER w, 0) > 0.35, false) AS u FROM v WINDOW w AS (PARTITION BY seq_id ORDER BY frame)), g AS (SELECT seq_id, bool_or(u) AS u FROM u GROUP BY seq_id)
SELECT s.seq_id, coalesce(u, false) AS unstable FROM (SELECT DISTINCT seq_id FROM b) s LEFT JOIN g USING (seq_id)""")
def identity_unstable(read):
    return pose.identity_unstable(frames(read))


_LONG = f"""{_BODY}, lm AS (SELECT vec_id // 40 AS seq_id, vec_id % 40 AS frame, (vec_id % 40) / 30.0::DOUBLE AS t, k AS landmark, embedding[2 * k % 64 + 1]::DOUBLE + 0.1 * (k % 3) AS x, -(embedding[(2 * k + 1) % 64 + 1]::DOUBLE + 0.03 * k) AS y,
CASE WHEN embedding[(k + 5) % 64 + 1] > -0.25 THEN 1.0 ELSE 0.0 END AS visibility FROM embeddings, range(33) r(k)),
m0 AS (SELECT l.seq_id, l.frame, t, landmark, visibility, valid, (x - ox) / coalesce(nullif(scale, 0), 1) AS x, (y - oy) / coalesce(nullif(scale, 0), 1) AS y, row_number() OVER (PARTITION BY l.seq_id, landmark ORDER BY l.frame) AS pos FROM lm l JOIN b USING (seq_id, frame) JOIN sc ON sc.seq_id = l.seq_id),
m1 AS (SELECT *, last_value(CASE WHEN valid THEN {{'p': pos, 'x': x, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY seq_id, landmark ORDER BY frame ROWS UNBOUNDED PRECEDING) AS p,
first_value(CASE WHEN valid THEN {{'p': pos, 'x': x, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY seq_id, landmark ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM m0)"""


def _fill_sql(c: str) -> str:
    held = f"CASE WHEN pos - p.p <= (q.p - p.p - 1) // 2 THEN p.{c} ELSE q.{c} END"
    return f"CASE WHEN valid OR (p IS NULL AND q IS NULL) THEN {c} WHEN p IS NULL THEN q.{c} WHEN q IS NULL THEN p.{c} WHEN q.p - p.p - 1 > 3 THEN {held} ELSE p.{c} + (q.{c} - p.{c}) * (pos - p.p) / (q.p - p.p) END AS {c}"


def _smooth_sql(c: str) -> str:
    fit = lambda weights, first: "(" + " + ".join(f"{w} * " + (f"lag({c}, {-j}) OVER w" if j < 0 else f"lead({c}, {j}) OVER w") for w, j in zip(weights, first, strict=True)) + ") / 35.0"
    return f"""CASE WHEN n < 5 THEN {c} WHEN pos = 1 THEN {fit(series.SMOOTH_FIRST, range(5))} WHEN pos = 2 THEN {fit(series.SMOOTH_SECOND, range(-1, 4))} WHEN pos = n THEN {fit(series.SMOOTH_FIRST, range(0, -5, -1))}
WHEN pos = n - 1 THEN {fit(series.SMOOTH_SECOND, range(1, -4, -1))} ELSE {fit(series.SMOOTH_MIDDLE, range(-2, 3))} END AS {c}"""


def _slope_sql(c: str, to: str) -> str:
    return f"coalesce((coalesce(lead({c}) OVER w, {c}) - coalesce(lag({c}) OVER w, {c})) / nullif(coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t), 0), 0) AS {to}"


_ROW = "WINDOW w AS (PARTITION BY seq_id, landmark ORDER BY frame)"
_NORM = f"""{_LONG}, m2 AS (SELECT seq_id, landmark, frame, t, pos, visibility, valid, count(*) OVER (PARTITION BY seq_id, landmark) AS n, {_fill_sql('x')}, {_fill_sql('y')} FROM m1),
m3 AS (SELECT seq_id, landmark, frame, t, pos, visibility, valid, {_smooth_sql('x')}, {_smooth_sql('y')} FROM m2 {_ROW}), m4 AS (SELECT *, {_slope_sql('x', 'vx')}, {_slope_sql('y', 'vy')} FROM m3 {_ROW}),
norm AS (SELECT *, {_slope_sql('vx', 'ax')}, {_slope_sql('vy', 'ay')} FROM m4 {_ROW})"""


@query(f"WITH {_NORM} SELECT seq_id, landmark::INT AS landmark, frame, round(x, 6) AS x, round(y, 6) AS y, round(vx, 5) AS vx, round(vy, 5) AS vy, round(ax, 3) AS ax, round(ay, 3) AS ay, valid FROM norm")
def normalized_marks(read):
    d = normalized.normalized(frames(read))
    r = lambda c, n: F.round(c, n).alias(c)
    return d.select("seq_id", "landmark", "frame", r("x", 6), r("y", 6), r("vx", 5), r("vy", 5), r("ax", 3), r("ay", 3), "valid")


@query(f"""WITH {_NORM}, s AS (SELECT seq_id, landmark, pos, x, sqrt(vx * vx + vy * vy) AS speed, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS step FROM norm WHERE landmark IN (15, 16) {_ROW}),
f AS (SELECT seq_id, landmark, sum(step) AS path, arg_max(pos, {{'s': speed, 'p': -pos}}) AS peak, arg_max(x, {{'s': speed, 'p': -pos}}) AS px FROM s GROUP BY ALL),
g AS (SELECT s.seq_id, s.landmark, any_value(path) AS path, any_value(px) - arg_min(x, {{'s': speed, 'p': pos}}) AS way FROM s JOIN f USING (seq_id, landmark) WHERE pos <= peak GROUP BY ALL)
SELECT seq_id, CASE WHEN arg_max(way, {{'p': path, 'l': landmark}}) < 0 THEN -1 ELSE 1 END AS direction FROM g GROUP BY seq_id""")
def swing_direction(read):
    return normalized.swing_direction(normalized.normalized(frames(read), pose.WRISTS))


_ENDS = "(SELECT count(*) FROM k f WHERE f.seq_id = {0}.seq_id AND f.t < {1})"


def _span_sql(of: str) -> str:
    """Start and end of the span about each row's time t in a sequence from t0 to t1 with n frames."""
    t, t0, t1, n = (f"{of}.{c}" for c in ("t", "t0", "t1", "n"))
    low = f"CASE WHEN {t} - 1 < {t0} THEN {t0} WHEN {t} - 1 + 2 > {t1} THEN greatest({t0}, {t1} - 2) ELSE {t} - 1 END"
    high = f"CASE WHEN {t} - 1 < {t0} THEN least({t1}, {t0} + 2) WHEN {t} - 1 + 2 > {t1} THEN {t1} ELSE {t} - 1 + 2 END"
    start = f"least({_ENDS.format(of, low)}, {n} - 1)"
    return f"{start} AS a, greatest({start} + 1, CASE WHEN {high} >= {t1} THEN {n} ELSE {_ENDS.format(of, high)} END) AS z"


_REACH = " + ".join(f"sqrt(power({_AT('x', k)} - ox, 2) + power(-({_AT('y', k)}) - oy, 2))" for k in pose.WRISTS)


@query(f"""WITH {_BODY}, k AS (SELECT b.seq_id, b.frame AS pos, b.frame / 15.0::DOUBLE AS t, valid, CASE WHEN torso > 0 THEN ({_REACH}) / torso ELSE 0 END AS reach, count(*) OVER (PARTITION BY b.seq_id) AS n, min(b.frame / 15.0::DOUBLE) OVER (PARTITION BY b.seq_id) AS t0, max(b.frame / 15.0::DOUBLE) OVER (PARTITION BY b.seq_id) AS t1
FROM b JOIN embeddings ON vec_id = seq_id * 40 + frame), i AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS isl FROM k WHERE valid),
r AS (SELECT seq_id, min(pos) AS first, max(pos) + 1 AS last FROM i GROUP BY seq_id, isl QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY count(*) DESC, min(pos)) = 1),
c AS (SELECT k.*, r.first, r.last, {_span_sql('k')} FROM k LEFT JOIN r USING (seq_id) WHERE pos = coalesce((first + last - 1) // 2, n // 2)),
w AS (SELECT c.seq_id, CASE WHEN c.last - c.first > c.z - c.a THEN (SELECT arg_max(k.pos, {{'r': k.reach, 'p': -k.pos}}) FROM k WHERE k.seq_id = c.seq_id AND k.pos >= c.first AND k.pos < c.last) ELSE c.pos END AS anchor, first IS NULL AS empty FROM c),
o AS (SELECT k.*, abs(k.t - q.t) AS off, {_span_sql('k')} FROM k JOIN w USING (seq_id) JOIN k q ON q.seq_id = w.seq_id AND q.pos = w.anchor WHERE abs(k.t - q.t) <= 0.5 AND (NOT empty OR k.pos = anchor)),
v AS (SELECT o.seq_id, o.pos, o.a, o.z, o.off, (SELECT count(*) FROM k WHERE k.seq_id = o.seq_id AND k.pos >= o.a AND k.pos < o.z AND k.valid) / (o.z - o.a)::DOUBLE AS cover FROM o)
SELECT seq_id, a::INT AS start, z::INT AS "end", round(cover, 6) AS coverage FROM v QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY cover DESC, off, pos) = 1""")
def core_windows(read):
    """Frames fifteen a second, so that a sequence is longer than its core."""
    d = normalized.core_windows(frames(read).withColumn("ts_s", F.col("frame") / 15.0))
    return d.select("seq_id", "start", "end", F.round("coverage", 6).alias("coverage"))


@query()
def core_quality(read):
    return normalized.core_quality(frames(read))


def long_sessions(read) -> tuple[DataFrame, DataFrame]:
    """Sessions of 240 frames whose hips and torso hold, so that one body is followed, and the hand by the session's number."""
    e = frames(read).withColumn("frame", (F.col("seq_id") % 6 * 40 + F.col("frame")).cast("int")).withColumn("seq_id", F.floor(F.col("seq_id") / 6).cast("long")).withColumn("ts_s", F.col("frame") / 30.0)
    e = e.withColumn("ox", F.col("ox") * 0.01).withColumn("oy", F.col("oy") * 0.01).withColumn("torso", F.lit(0.5))
    return e, e.select("seq_id").distinct().withColumn("hand", F.when(F.col("seq_id") % 2 == 0, "right").otherwise("left"))


@query()
def session_windows(read):
    return sessions.swing_windows(*long_sessions(read))


@query()
def session_swings(read):
    return sessions.segment_session(*long_sessions(read))


@query()
def selected_contacts(read):
    f = frames(read)
    norm = cut(normalized.normalized(f))
    return contacts_.select(norm, pose.handedness(f), normalized.swing_direction(norm), pose.identity_unstable(f))


@query()
def handedness(read):
    return pose.handedness(frames(read))


@query()
def contact_frame(read):
    f = frames(read)
    return pose.contact(pose.racket_track(f, pose.handedness(f)))


@query()
def swing_phases(read):
    f = frames(read)
    r = pose.racket_track(f, pose.handedness(f))
    return pose.phases(r, pose.contact(r))


@query()
def tempo_ratio(read):
    f = frames(read)
    r = pose.racket_track(f, pose.handedness(f))
    return pose.tempo(pose.phases(r, pose.contact(r)), f)


@query()
def swing_metrics(read):
    f = frames(read)
    hands = pose.handedness(f)
    r = pose.racket_track(f, hands)
    c = pose.contact(r)
    return pose.swing_metrics(f, hands, c, pose.phases(r, c))


@query(f"""WITH {E}, a AS (SELECT session, 2 * radians(value) AS x FROM e), m AS (SELECT session, avg(sin(x)) AS s, avg(cos(x)) AS c FROM a GROUP BY session), d AS (SELECT session, degrees(atan2(s, c)) / 2 + 90 AS v, sqrt(s * s + c * c) AS r FROM m)
SELECT session, CASE WHEN r > 1e-9 THEN round(v - 180 * floor(v / 180) - 90, 6) END AS mean FROM d""")
def axial_mean(read):
    return pose.axial_mean(swings(read), "session", "value")


@query(f"""WITH {E}, d AS (SELECT session, value - lag(value) OVER {W} + 90 AS v FROM e) SELECT session, round(sum(v - 180 * floor(v / 180) - 90), 6) AS turn FROM d GROUP BY session""")
def net_turn(read):
    return pose.net_turn(swings(read), "session", "frame", "value")


@query(f"""WITH {E}, m AS (SELECT session, var_pop(value) AS a, var_pop(k) AS b, covar_pop(value, k) AS c FROM e GROUP BY session HAVING count(*) >= 3)
SELECT session, round(degrees(atan2(2 * c, a - b)) / 2, 6) AS angle, round(sqrt(greatest((a + b) / 2 - sqrt(power((a - b) / 2, 2) + c * c), 0)), 6) AS deviation FROM m""")
def fitted_line(read):
    return pose.fitted_line(swings(read), "session", "value", "k")


@query(f"WITH {E} SELECT session, round(sqrt(var_pop(value) + var_pop(k)), 6) AS spread FROM e GROUP BY session")
def position_spread(read):
    return pose.position_spread(swings(read), "session", "value", "k")


_SHOT = """m AS (SELECT doc_id AS seq_id, n_chars % 40 / 20.0 AS h, n_chars % 7 / 10.0 AS w, n_chars % 50 - 25.0 AS a FROM documents),
v AS (SELECT seq_id, 'serve' AS class, 1.0 AS x FROM m WHERE h > 1.3 UNION ALL SELECT seq_id, 'backhand_two_handed', 1.0 FROM m WHERE h <= 1.3 AND w < 0.35
UNION ALL SELECT seq_id, unnest(['forehand_topspin', 'forehand_slice', 'backhand_one_handed']), 1.0 / 3 FROM m WHERE h <= 1.3 AND w >= 0.35
UNION ALL SELECT seq_id, 'forehand_topspin', 0.5 FROM m WHERE h <= 1.3 AND w >= 0.35 AND a > 10 UNION ALL SELECT seq_id, 'forehand_slice', 0.5 FROM m WHERE h <= 1.3 AND w >= 0.35 AND a < -10),
s AS (SELECT seq_id, class, sum(x) AS x FROM v GROUP BY ALL), p AS (SELECT seq_id, class, (x / sum(x) OVER (PARTITION BY seq_id))::DOUBLE AS score FROM s)"""


def _shot(read):
    m = read("documents").select(
        F.col("doc_id").alias("seq_id"), (F.col("n_chars") % 40 / 20.0).alias("contact_height_ratio"), (F.col("n_chars") % 7 / 10.0).alias("wrist_separation_at_contact_tu"), (F.col("n_chars") % 50 - 25.0).alias("swing_path_angle_deg")
    )
    return pose.class_scores(pose.shot_evidence(m), "seq_id")


@query(f"WITH {_SHOT} SELECT seq_id, class, round(score, 6) AS score FROM p")
def shot_scores(read):
    return _shot(read)


@query(f"""WITH {_SHOT}, r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(score) OVER w, 0) AS nx FROM p WINDOW w AS (PARTITION BY seq_id ORDER BY round(score, 9) DESC, list_position(['forehand_topspin', 'forehand_slice', 'backhand_one_handed', 'backhand_two_handed', 'serve', 'volley'], class)))
SELECT seq_id, CASE WHEN score >= 0.45 AND score - nx >= 0.15 - 1e-12 THEN class ELSE 'unknown' END AS class, round(score, 6) AS score FROM r WHERE rn = 1""")
def shot_type(read):
    return pose.accept(_shot(read).withColumn("score", F.round("score", 9)), "seq_id")


# segmentation -------------------------------------------------------------------------------------


@query(f"WITH {E}, d AS (SELECT session, t / 100000 - lag(t / 100000) OVER (PARTITION BY session ORDER BY t) AS d FROM e) SELECT session, greatest(1, round_even(0.6 / nullif(median(d), 0), 0))::INT AS frames FROM d GROUP BY session")
def refractory_frames(read):
    return segmentation.refractory_frames(swings(read).withColumn("t", F.col("t") / 100000), "session", "t")


@query()
def swing_candidates(read):
    return segmentation.candidates(swings(read), "session", "frame", "t", "value", 3)


@query()
def swing_windows(read):
    s = swings(read).withColumn("t", F.col("t") / 10000)
    ok = segmentation.candidates(s, "session", "frame", "t", "value", 3).where("status = 'accepted'")
    return segmentation.windows(ok, "session", s.groupBy("session").agg(F.min("t").alias("t0"), F.max("t").alias("t1")))


@query(f"WITH {E} SELECT session, frame, CASE WHEN k / 100 >= 0.45 THEN 'accepted' WHEN k / 100 >= 0.35 THEN 'low_confidence' ELSE 'rejected' END AS status FROM e")
def swing_status(read):
    return swings(read).withColumn("c", F.col("k") / 100).select("session", "frame", segmentation.status("c").alias("status"))


@query(f"""WITH {E}, h AS (SELECT session, frame, sha256(printf('%.4f', value) || ',' || printf('%.4f', k)) AS h FROM e) SELECT session, sha256(string_agg(h, '' ORDER BY frame)) AS digest FROM h GROUP BY session""")
def session_digest(read):
    return segmentation.digest(swings(read).withColumn("a", F.array("value", "k")), "session", "frame", "a")


# ball ---------------------------------------------------------------------------------------------


@query(f"WITH {E} SELECT session, frame, CASE WHEN value BETWEEN 12 AND 1200 AND k / 100 >= 0.65 AND 1 + k / 50 <= 1.6 THEN 1 WHEN value BETWEEN 12 AND 1500 AND k / 100 >= 0.2 AND 1 + k / 50 BETWEEN 1.6 AND 12 THEN 2 ELSE 0 END AS tier FROM e")
def blob_tier(read):
    k, one = F.col("k"), F.lit(1.0)
    return swings(read).select("session", "frame", ball.tier(F.col("value"), k / 100, 1 + k / 50, one, one, F.lit(2.0)).alias("tier"))


@query(f"WITH {E}, c AS (SELECT session, frame, row_number() OVER (PARTITION BY session ORDER BY k DESC, value DESC, value, frame) AS r FROM e) SELECT session, frame FROM c WHERE r <= 10")
def capped_candidates(read):
    c = swings(read).withColumn("f", F.lit(0)).withColumn("colour_score", F.col("k")).withColumn("contrast", F.col("value")).withColumn("x", F.col("value")).withColumn("y", F.col("frame"))
    return ball.cap_per_frame(c, "session", "f", 10).select("session", "frame")


@query(f"WITH {E}, a AS (SELECT session, frame, value - k + 180 AS x, value - k + 90 AS y FROM e) SELECT session, frame, round(abs(x - 360 * floor(x / 360) - 180), 6) AS direction, round(abs(y - 180 * floor(y / 180) - 90), 6) AS axis FROM a")
def angle_gaps(read):
    a, b = F.col("value"), F.col("k")
    return swings(read).select("session", "frame", ball.direction_difference(a, b).alias("direction"), ball.axis_difference(a, b).alias("axis"))


@query(f"""WITH {E}, c AS (SELECT session, frame, value * 5 AS px, k / 10 AS m FROM e) SELECT session, frame, CASE WHEN px >= 60 AND px / nullif(m, 0) BETWEEN 8 AND 300 THEN round(px / m, 6) END AS px_per_m,
CASE WHEN px < 60 THEN 'segment_too_short' WHEN px / nullif(m, 0) IS NULL OR NOT px / nullif(m, 0) BETWEEN 8 AND 300 THEN 'scale_implausible' END AS reason FROM c""")
def calibration_scale(read):
    c = swings(read).withColumn("s", ball.scale_from_segment(F.col("value") * 5, F.col("k") / 10))
    return c.select("session", "frame", F.col("s.px_per_m").alias("px_per_m"), F.col("s.reason").alias("reason"))


@query()
def ball_track(read):
    c = swings(read).withColumn("x", F.col("value") * 4).withColumn("y", F.col("k") * 4).withColumn("f", F.row_number().over(over("session", "frame"))).withColumn("tier", F.lit(1)).withColumn("orientation_deg", F.lit(0.0)).withColumn("seed_x", F.lit(200.0)).withColumn("seed_y", F.lit(200.0))
    return ball.track(c.select("session", "f", "x", "y", "tier", "orientation_deg", "seed_x", "seed_y"), "session", "f", 400.0, 400.0)


@query(f"""WITH {E}, c AS (SELECT session, min(t) AS c0, avg(k) / 100 AS conf, CASE WHEN session % 7 = 0 THEN NULL ELSE 5 + session % 20 END::DOUBLE AS ppm FROM e GROUP BY session),
w AS (SELECT e.session, t / 1000000 AS t, value, k, row_number() OVER (PARTITION BY e.session ORDER BY t) AS rn FROM e JOIN c USING (session) WHERE t / 1000000 BETWEEN c0 / 1000000 AND c0 / 1000000 + 0.25),
s AS (SELECT session, sqrt(power(value - lag(value) OVER o, 2) + power(k - lag(k) OVER o, 2)) / nullif(greatest(t - lag(t) OVER o, 0), 0) AS v FROM w WHERE rn > 1 WINDOW o AS (PARTITION BY session ORDER BY t)), g AS (SELECT session, count(*) AS used, median(v) AS px FROM s GROUP BY session),
j AS (SELECT c.session, conf, ppm, coalesce(used, 0) AS used, round_even(round(px / nullif(ppm, 0) * 2.23694, 9), 0)::INT AS raw FROM c LEFT JOIN g USING (session)),
r AS (SELECT *, CASE WHEN conf < 0.35 THEN 'contact_uncertain' WHEN ppm IS NULL THEN 'not_calibrated' WHEN used < 3 THEN 'too_few_detections' WHEN raw IS NULL OR NOT raw BETWEEN 15 AND 160 THEN 'implausible_speed' END AS reason FROM j)
SELECT session, CASE WHEN reason IS NULL THEN raw END AS mph, reason, CASE WHEN reason IS NULL THEN CASE WHEN used >= 9 THEN 'high' WHEN used >= 5 THEN 'medium' ELSE 'low' END END AS confidence, used FROM r""")
def ball_speed(read):
    s = swings(read).withColumn("t", F.col("t") / 1000000)
    ctx = s.groupBy("session").agg(F.min("t").alias("contact_s"), (F.avg("k") / 100).alias("contact_confidence")).withColumn("px_per_m", F.when(F.col("session") % 7 != 0, (5 + F.col("session") % 20).cast("double")))
    return ball.ball_speed(s.select("session", "t", F.col("value").alias("x"), F.col("k").alias("y")), ctx, "session", "t")


@query(f"""WITH {E}, d AS (SELECT session, k::INT - 50 AS d FROM e), m AS (SELECT session, list(d ORDER BY d)[(count(*) + 1) // 2] AS m FROM d GROUP BY session),
a AS (SELECT session, list(abs(d - m) ORDER BY abs(d - m))[(count(*) + 1) // 2] AS m FROM d JOIN m USING (session) GROUP BY session) SELECT session, greatest(8, ceil(4.0 * m))::INT AS threshold FROM a""")
def mad_threshold(read):
    return ball.mad_threshold(swings(read).withColumn("d", F.col("k").cast("int") - 50), "session", "d")


@query()
def flight_stitch(read):
    s = swings(read).withColumn("t", F.col("t") / 100000)
    t = s.select("session", F.col("frame").alias("tracklet_id"), F.col("t").alias("t0"), F.col("value").alias("x0"), F.col("k").alias("y0"), (F.col("t") + 0.05).alias("t1"), F.col("value").alias("x1"), F.col("k").alias("y1"))
    return ball.stitch(t, "session")


@query()
def flights(read):
    return ball.accepted(swings(read).select("session", F.col("t").alias("time"), F.col("value").alias("x"), F.col("k").alias("y")), "session", "time")


@query()
def break_points(read):
    s = swings(read).withColumn("time", F.row_number().over(over("session", "frame")) / 60.0)
    return ballevents.break_points(s.select("session", "time", F.col("value").alias("x"), F.col("k").alias("y")), "session", "time")


def cameras(spark) -> DataFrame:
    """(camera, h, projection, cam_x, cam_y, cam_z, focal_px): three places behind a baseline, looking at the net."""
    rows = []
    for n, (focal, cam) in enumerate([(1500.0, (0.0, -22.0, 6.0)), (1300.0, (1.5, -20.0, 8.0)), (1700.0, (-2.0, -25.0, 5.0))]):
        ahead = -np.array(cam) / np.linalg.norm(cam)
        across = np.array([ahead[1], -ahead[0], 0.0]) / np.hypot(*ahead[:2])
        turn = np.stack([across, np.cross(ahead, across), ahead])
        p = np.array([[focal, 0, 960.0], [0, focal, 540.0], [0, 0, 1]]) @ np.column_stack([turn, -turn @ cam])
        rows.append((n, np.linalg.inv(p[:, [0, 1, 3]]).ravel().tolist(), p.ravel().tolist(), *cam, focal))
    return spark.createDataFrame(rows, "camera int, h array<double>, projection array<double>, cam_x double, cam_y double, cam_z double, focal_px double")


def session_maps(read) -> DataFrame:
    s = swings(read).select("session").distinct().withColumn("camera", (F.col("session") % 3).cast("int"))
    return s.join(F.broadcast(cameras(s.sparkSession)), "camera").drop("camera")  # three rows


def seen_balls(read) -> tuple[DataFrame, DataFrame]:
    """Candidates and frames of each session: a ball that flies from event to event in six frames, every eleventh flight unseen, among clutter."""
    w = over("session", "frame")
    s = swings(read).select("session", "frame", (500 + F.col("value")).alias("x"), (350 + 2 * F.col("k")).alias("y"), "value", F.row_number().over(w).alias("rn"))
    s = s.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).where("nx is not null")
    each = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j")).withColumn("at", ((F.col("rn") - 1) * 6 + F.col("j")).cast("int")).withColumn("s", F.col("j") / 6.0)
    number = lambda name, v: v.cast("double").alias(name)
    shape = lambda size, colour: (number("minor", F.lit(size)), number("major", F.lit(size)), number("orientation_deg", F.lit(0.0)), number("colour_score", F.lit(colour)), number("contrast", F.col("value")))
    arc = F.col("y") + F.col("s") * (F.col("ny") - F.col("y")) - 60 * F.col("s") * (1 - F.col("s"))
    balls = each.where("rn % 11 <> 0").select("session", "at", (F.col("x") + F.col("s") * (F.col("nx") - F.col("x"))).alias("x"), arc.alias("y"), *shape(5.0, 0.9))
    noise = F.pmod(F.hash("session", "at"), F.lit(1_000_003))
    clutter = each.where(F.pmod(F.hash("at", "session"), F.lit(3)) == 0).select("session", "at", (noise % 1900).cast("double").alias("x"), (noise % 1051).cast("double").alias("y"), *shape(4.0, 0.2))
    return balls.unionByName(clutter), each.select("session", "at", (F.col("at") / 30.0).alias("time_s"))


@query()
def linked_flights(read):
    candidates, shown = seen_balls(read)
    return flights_.link(candidates, shown, session_maps(read), "session", "at")


@query()
def ball_events(read):
    candidates, shown = seen_balls(read)
    maps = session_maps(read)
    found = flights_.link(candidates, shown, maps, "session", "at")
    w = over("session", "frame")
    clicks = swings(read).withColumn("rn", F.row_number().over(w)).where("kind = 'click'")
    nothing = F.lit(None).cast("double")
    hits = clicks.select(
        "session", ((F.col("rn") - 1) / 5.0).alias("time_s"), F.when(F.col("frame") % 2 == 0, 500 + F.col("value")).alias("wrist_u"), F.when(F.col("frame") % 2 == 0, 350 + 2 * F.col("k")).alias("wrist_v"),
        F.when(F.col("k") < 30, "near").when(F.col("k") > 60, "far").alias("end"), (F.col("k") / 100).alias("confidence"), F.lit("forehand").alias("shot_type"), nothing.alias("feet_u"), nothing.alias("feet_v"),
    )
    return ballevents.detect(found, maps, hits, "session")


@query()
def event_grammar(read):
    return ball.grammar(swings(read).select("session", "frame", (F.col("value") / 30).alias("b"), (F.col("k") / 50).alias("h")), "session", "frame", "b", "h").select("session", "frame", "kind")


@query(f"""WITH {C}, i AS (SELECT *, coalesce(sum((kind = 'hit')::INT) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isl, CASE WHEN lead(kind) OVER w = 'bounce' THEN lead(half) OVER w END AS nh FROM c WINDOW w AS (PARTITION BY session ORDER BY t)),
b AS (SELECT *, last_value(CASE WHEN kind = 'bounce' THEN half END IGNORE NULLS) OVER (PARTITION BY session, isl ORDER BY t ROWS UNBOUNDED PRECEDING) AS bh FROM i) SELECT session, frame, coalesce(bh, CASE nh WHEN 'near' THEN 'far' WHEN 'far' THEN 'near' END) AS end FROM b WHERE kind = 'hit'""")
def hit_ends(read):
    return ball.hit_ends(contacts(read), "session", "t", "kind", "half").select("session", "frame", "end")


@query(f"WITH {E}, n AS (SELECT session, frame, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM e) SELECT session, frame FROM n WHERE EXISTS (SELECT 1 FROM range(5) r(j) WHERE round_even(j * (n - 1) / 4.0::DOUBLE, 0)::BIGINT = i)")
def background_samples(read):
    return ball.even_samples(swings(read), "session", "frame", 5).select("session", "frame")


def court_segments(read) -> DataFrame:
    """Segments of a frame for each vector: the court's lines from one of three cameras, each in two pieces, shaken by the vector, and clutter."""
    e = read("embeddings")
    v = lambda k: F.col("embedding")[k % 64].cast("double")
    pieces = []
    for n in range(3):
        m = np.array(cameras(e.sparkSession).where(F.col("camera") == n).first().h).reshape(3, 3)
        to_image = np.linalg.inv(m)
        own = []
        for k, (x0, y0, x1, y1) in enumerate(courtfit.LINES.tolist()):
            for j, (a, b) in enumerate(((0.0, 0.48), (0.52, 1.0))):
                ends = []
                for c, share in enumerate((a, b)):
                    p = to_image @ [x0 + share * (x1 - x0), y0 + share * (y1 - y0), 1.0]
                    ends += [F.lit(float(p[0] / p[2])) + v(4 * k + 2 * j + c), F.lit(float(p[1] / p[2])) + v(4 * k + 2 * j + c + 7)]
                own.append(F.struct(*(x.alias(name) for x, name in zip(ends, ("x0", "y0", "x1", "y1"), strict=True))))
        pieces.append(F.array(*own))
    clutter = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(*(((F.element_at("embedding", (i * 4 + c) % 64 + 1).cast("double") + 1) * half).alias(n) for c, (n, half) in enumerate((("x0", 960), ("y0", 540), ("x1", 960), ("y1", 540))))))
    lines = F.when(F.col("vec_id") % 4 == 0, pieces[0]).when(F.col("vec_id") % 4 == 1, pieces[1]).when(F.col("vec_id") % 4 == 2, pieces[2]).otherwise(F.slice(pieces[0], 1, 3))
    return e.select("vec_id", F.inline(F.concat(lines, clutter)))


@query()
def court_hypotheses(read):
    return courtfit.fit_courts(court_segments(read), "vec_id", 1920, 1080)


def whole_sessions(read) -> courtsession.Analysis:
    """Sessions of the ball's flights: every seventh has a moving camera, every fifth is bumped half way, every eleventh has no map."""
    candidates, shown = seen_balls(read)
    last = shown.groupBy("session").agg(F.max("time_s").alias("last"))
    verdict = F.when(F.col("session") % 7 == 3, "moving").when(F.col("session") % 13 == 5, "unknown").otherwise("stable")
    stability = last.select("session", verdict.alias("verdict"), F.when(F.col("session") % 5 == 1, F.col("last") / 2).alias("bumped_at"), F.lit(1.0).alias("rms"))
    wobble = F.array().cast("array<struct<plus: array<double>, minus: array<double>, step: double>>")
    maps = session_maps(read).where("session % 11 <> 4").withColumn("sigma_tap_px", F.lit(1.0)).withColumn("wobble", wobble).withColumn("calls_allowed", F.lit(True))
    w = over("session", "frame")
    nothing = F.lit(None).cast("double")
    hits = swings(read).withColumn("rn", F.row_number().over(w)).where("kind = 'click'").select(
        "session", ((F.col("rn") - 1) / 5.0).alias("time_s"), nothing.alias("wrist_u"), nothing.alias("wrist_v"), F.when(F.col("k") < 50, "near").otherwise("far").alias("end"), (F.col("k") / 100).alias("confidence"),
        F.lit("forehand").alias("shot_type"), nothing.alias("feet_u"), nothing.alias("feet_v"),
    )
    return courtsession.analyze(candidates, shown, stability, maps, hits, "session", "at")


@query(f"""WITH {E}, n AS (SELECT session, count(*) - 1 AS n FROM e GROUP BY session HAVING count(*) > 1), v AS (SELECT *, (n * 6 - 1) / 30.0::DOUBLE AS last, CASE WHEN session % 5 = 1 THEN (n * 6 - 1) / 30.0::DOUBLE / 2 END AS bump,
CASE WHEN session % 7 = 3 THEN 'camera_moving' WHEN session % 13 = 5 THEN 'camera_unknown' WHEN session % 11 = 4 THEN 'not_calibrated' END AS reason FROM n)
SELECT session, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN bump IS NOT NULL THEN 'partial' ELSE 'complete' END AS status, reason AS refusal_reason, round(CASE WHEN reason IS NULL THEN coalesce(bump, last) END, 6) AS analysed_until_s FROM v""")
def session_verdicts(read):
    _, shown = seen_balls(read)
    last = shown.groupBy("session").agg(F.max("time_s").alias("last"))
    verdict = F.when(F.col("session") % 7 == 3, "moving").when(F.col("session") % 13 == 5, "unknown").otherwise("stable")
    stability = last.select("session", verdict.alias("verdict"), F.when(F.col("session") % 5 == 1, F.col("last") / 2).alias("bumped_at"), F.lit(1.0).alias("rms"))
    d = courtsession.verdicts(shown, stability, session_maps(read).where("session % 11 <> 4"), "session")
    return d.select("session", "status", "refusal_reason", F.round("analysed_until_s", 6).alias("analysed_until_s"))


@query()
def court_sessions(read):
    """Rallies of whole sessions, from candidates on."""
    return whole_sessions(read).rallies


# court --------------------------------------------------------------------------------------------


@query(f"""WITH {C}, v AS (SELECT session, frame, value / 100 AS xx, (k - 50) / 500 AS xy, k / 100 AS yy FROM c), g AS (SELECT *, (xx + yy) / 2 AS m, sqrt(power((xx - yy) / 2, 2) + xy * xy) AS d FROM v)
SELECT session, frame, round(1.96 * sqrt(greatest(m + d, 0)), 6) AS major, round(1.96 * sqrt(greatest(m - d, 0)), 6) AS minor, round(degrees(atan2(2 * xy, xx - yy)) / 2, 6) AS angle FROM g""")
def uncertainty_ellipse(read):
    major, minor, angle = court.ellipse(F.col("value") / 100, (F.col("k") - 50) / 500, F.col("k") / 100, court.CALL_Z)
    return contacts(read).select("session", "frame", major.alias("major"), minor.alias("minor"), angle.alias("angle"))


@query()
def calibrate_court(read):
    ground = [(-5.485, -11.885), (5.485, -11.885), (-5.485, 11.885), (5.485, 11.885), (-4.115, 6.4), (4.115, 6.4)]
    v = lambda k: F.col("embedding")[k].cast("double")
    taps = F.array(*(F.struct(F.lit(x).alias("x_m"), F.lit(y).alias("y_m"), (F.lit(640 + 55 * x) + 3 * y + v(2 * k)).alias("u_px"), (F.lit(360 - 20 * y) + v(2 * k + 1)).alias("v_px")) for k, (x, y) in enumerate(ground)))
    rows = read("embeddings").select("vec_id", F.inline(taps)).withColumn("frame_w", F.lit(1280)).withColumn("frame_h", F.lit(720))
    return calibration.calibrate(rows, "vec_id").select("vec_id", "ok", "reason", "rms_px", "taps")


@query(f"WITH {C}, z AS (SELECT session, frame, (11.885 - k / 7) / (value / 100) AS z FROM c) SELECT session, frame, round({normal_sql('z')}, 6) AS p FROM z")
def in_court_probability(read):
    room, sigma = F.lit(court.HALF_LENGTH) - F.col("k") / 7, F.col("value") / 100
    # without deviation all is on one side
    z = F.when(sigma == 0, room * float("inf")).otherwise(room / F.nullif(sigma, F.lit(0.0)))
    return contacts(read).select("session", "frame", normal_cdf(z).alias("p"))


def bounces(read) -> DataFrame:
    """Contacts as events in an image: places by value and JSON number, one run a session."""
    c = contacts(read)
    flags = F.array_compact(F.array(F.when(F.col("frame") % 5 == 0, "weak_bounce"), F.when(F.col("frame") % 7 == 0, "one_sided_bounce")))
    return c.select(
        "session", F.lit(1).alias("run"), F.col("frame").alias("event_id"), "t", "kind", (F.col("value") * 10).alias("u"), (F.col("k") * 5).alias("v"), F.lit(4.0).alias("uu"), F.lit(0.5).alias("uv"), F.lit(9.0).alias("vv"),
        (F.col("k") / 100 + 0.4).alias("confidence"), flags.alias("flags"), F.col("half").alias("end"), F.when(F.col("frame") % 4 == 0, "serve").otherwise("forehand").alias("shot_type"),
    )


def flat_maps(read) -> DataFrame:
    """A map without perspective for each session."""
    h = F.array(*(F.lit(float(x)) for x in (1 / 45, 0, -300 / 45, 0, 1 / 18, -250 / 18, 0, 0, 1)))
    nothing = F.array().cast("array<struct<plus: array<double>, minus: array<double>, step: double>>")
    return swings(read).select("session").distinct().select("session", h.alias("h"), F.lit(0.0).alias("cam_x"), F.lit(-20.0).alias("cam_y"), F.lit(8.0).alias("cam_z"), F.lit(0.0).alias("shake_px"), F.lit(1.0).alias("sigma_tap_px"), nothing.alias("wobble"), F.lit(True).alias("calls_allowed"))


_SHARE = "((8.0 - 0.0335) / 8.0)::DOUBLE"
LANDINGS = f"""{C}, g AS (SELECT *, {_SHARE} * ({1 / 45!r}::DOUBLE * (value * 10) + {-300 / 45!r}::DOUBLE) AS x, -20.0::DOUBLE + {_SHARE} * (({1 / 18!r}::DOUBLE * (k * 5) + {-250 / 18!r}::DOUBLE) + 20.0::DOUBLE) AS y, k / 100 + 0.4 AS conf, frame % 5 = 0 AS weak, frame % 7 = 0 AS one, 2.0::DOUBLE / 45 * {_SHARE} AS sx, 3.0::DOUBLE / 18 * {_SHARE} AS sy,
last_value(CASE WHEN kind = 'hit' THEN {{'e': half, 't': t, 'serve': frame % 4 = 0}} END IGNORE NULLS) OVER w AS hit, max(CASE WHEN kind = 'net' THEN t END) OVER w AS net_t FROM c WINDOW w AS (PARTITION BY session ORDER BY t, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, CASE WHEN y < 0 THEN 'near' ELSE 'far' END AS ground FROM g WHERE kind = 'bounce'), h AS (SELECT *, CASE WHEN hit.e = ground AND NOT coalesce(net_t > hit.t, false) THEN NULL ELSE hit.e END AS hitter FROM b),
ev AS (SELECT *, CASE hitter WHEN 'near' THEN 'far' WHEN 'far' THEN 'near' ELSE ground END AS side, abs(y) <= greatest(0.25, 1.96 * sy) AS at_net FROM h),
m AS (SELECT *, [{{'e': 'x_max', 'l': 'right_singles_sideline', 'm': 4.115 - x + 0.02, 's': sx}}, {{'e': 'x_min', 'l': 'left_singles_sideline', 'm': x + 4.115 + 0.02, 's': sx}}, {{'e': 'y', 'l': side || '_baseline', 'm': CASE side WHEN 'near' THEN y + 11.885 ELSE 11.885 - y END + 0.02, 's': sy}}] AS j FROM ev),
o AS (SELECT *, list_sort(list_transform(list_filter(j, lambda q: q.m <= -1.96 * q.s), lambda q: {{'m': q.m, 'e': q.e, 'l': q.l}})) AS beyond, list_sort(list_transform(j, lambda q: {{'n': abs(q.m) / (1.96 * q.s), 'e': q.e, 'l': q.l, 'm': q.m}})) AS near, len(list_filter(j, lambda q: q.m < 1.96 * q.s)) = 0 AS clear FROM m),
d AS (SELECT *, CASE WHEN len(beyond) > 0 THEN beyond[1].l ELSE near[1].l END AS line, CASE WHEN len(beyond) > 0 THEN beyond[1].m ELSE near[1].m END AS margin, at_net OR coalesce(hitter = ground, false) AS uncalled FROM o),
l AS (SELECT *, CASE WHEN uncalled THEN NULL WHEN conf < 0.5 OR weak OR (one AND line LIKE '%base%') THEN 'too_close' WHEN len(beyond) > 0 THEN 'out' WHEN clear THEN 'in' ELSE 'too_close' END AS ruling FROM d)"""


@query(f"""WITH {LANDINGS} SELECT session, frame AS event_id, round(x, 3) AS x, round(y, 3) AS y, hitter AS hitter_end, at_net, ruling AS verdict, CASE WHEN NOT uncalled THEN line END AS line, round(CASE WHEN NOT uncalled THEN margin END, 3) AS margin_m,
CASE WHEN hitter IS NOT NULL THEN hit.serve ELSE false END AS is_serve, CASE WHEN abs(y) <= 6.4 THEN 'short' WHEN abs(y) <= 9.1425 THEN 'mid' WHEN abs(y) <= 11.885 THEN 'deep' ELSE 'beyond' END AS depth_zone FROM l""")
def court_landings(read):
    found = landing.landings(bounces(read), flat_maps(read), "session")
    return found.select("session", "event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "hitter_end", "at_net", F.col("call.verdict").alias("verdict"), F.col("call.line").alias("line"), F.round("call.margin_m", 3).alias("margin_m"), "is_serve", "depth_zone")


@query(f"""WITH {LANDINGS} SELECT session, count(*) AS count, count(*) FILTER (ruling = 'in') AS "in", count(*) FILTER (ruling = 'out') AS out, count(*) FILTER (ruling = 'too_close') AS too_close,
count(*) FILTER (x < -4.115 / 3) AS "left", count(*) FILTER (x BETWEEN -4.115 / 3 AND 4.115 / 3) AS centre, count(*) FILTER (x > 4.115 / 3) AS "right", round(median(sy), 6) AS median_sigma_along FROM l GROUP BY session""")
def landing_summary(read):
    found = landing.summary(landing.landings(bounces(read), flat_maps(read), "session"), "session")
    return found.drop(*(f"expected_{z}" for z in court.DEPTH_ZONES))


@query(f"""WITH {LANDINGS}, n AS (SELECT session, frame, t, kind, lead(kind) OVER w AS nk, lead(t) OVER w AS nt, lead(frame) OVER w AS nf FROM c WHERE kind <> 'net' WINDOW w AS (PARTITION BY session ORDER BY t, frame))
SELECT n.session, n.frame AS event_id, a.ground AS "end" FROM n JOIN l a ON a.frame = n.frame JOIN l b ON b.frame = n.nf WHERE n.kind = 'bounce' AND n.nk = 'bounce' AND a.ruling = 'out' AND a.ground <> b.ground AND n.nt - n.t <= 36000.0""")
def played_on(read):
    e = bounces(read)
    return landing.played_on(e, landing.landings(e, flat_maps(read), "session"), "session", 36000.0)


@query()
def session_rallies(read):
    e, found = landing.session_landings(bounces(read).withColumn("t", F.col("t") / 36000), flat_maps(read), "session")
    f = swings(read).select("session", F.col("frame").alias("flight_id"), (F.col("t") / 36000).alias("t0"), (F.col("t") / 36000 + F.col("value") / 50).alias("t1"), F.when(F.col("k") < 50, "near").otherwise("far").alias("half"))
    return rallies.segment(e, found, f, "session").withColumn("flags", F.array_join("flags", ","))


# inference and evaluation -------------------------------------------------------------------------


@query()
def point_inference(read):
    s = swings(read).withColumn("n", F.row_number().over(over("session", "frame")))
    k, v = F.col("k").cast("int"), F.col("value")
    pick = lambda at, *names: F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))
    calls = ("in", "out", "too_close", None)
    r = s.select(
        "session", "n", (k % 6).alias("strokes"), pick(k, "net", "ball_out", "double_bounce", "timeout", "lost_track").alias("reason"), (k % 4).alias("landings"),
        pick(v, "near", "far", None).alias("first_end"), pick(v * 3, *calls).alias("first_call"), pick(v * 7, "near", "far", None).alias("last_end"), pick(v * 5, *calls).alias("last_call"),
        *(pick(v * (2 * j + 9), *calls[:3]).alias(f"box_{end}_{half}") for j, (end, half) in enumerate((e, h) for e in ("near", "far") for h in ("deuce", "ad"))),
    )
    fixed = s.where("kind = 'error'").select(F.col("session").alias("session"), F.col("n").alias("n"), F.lit("A").alias("winner"))
    return inference.infer_points(r, fixed, "session", "n")


@query()
def match_times(read):
    s = swings(read)
    found = s.where("kind = 'view'").select(F.col("session").alias("session"), F.col("t").alias("t"))
    return evaluation.match_times(s.where("kind = 'click'"), found, "session", "t", 36000.0)


@query(f"""WITH {C}, v AS (SELECT verdict, value > 20 AS truth_in, value / 10 AS margin, k / 10 AS tm, 2.5 AS r FROM c), w AS (SELECT *, (verdict = 'in') <> truth_in AS wrong FROM v)
SELECT round(avg((NOT wrong)::INT) FILTER (abs(tm) > r), 6) AS accuracy, round(1000.0 * count(*) FILTER (wrong) / count(*), 6) AS confident_wrong_per_1000, round(avg((abs(margin - tm) <= r)::INT), 6) AS coverage FROM w""")
def call_scores(read):
    return evaluation.call_scores(contacts(read).select("verdict", (F.col("value") > 20).alias("truth_in"), (F.col("value") / 10).alias("margin"), (F.col("k") / 10).alias("true_margin"), F.lit(2.5).alias("radius")))


@query(f"WITH {E}, r AS (SELECT (k % 7) AS t, (value % 7)::INT AS x FROM (SELECT k, floor(value) AS value FROM e)) SELECT round(avg((x = t)::INT), 6) AS exact, round(avg((abs(x - t) <= 1)::INT), 6) AS within_one, round(avg((t BETWEEN x - 2 AND x + 1)::INT), 6) AS in_range FROM r")
def rally_length_scores(read):
    x = F.floor("value") % 7
    return evaluation.length_scores(swings(read).select((F.col("k") % 7).alias("truth"), x.alias("estimate"), (x - 2).alias("least"), (x + 1).alias("most")))


@query(f"WITH {E} SELECT round(median(sqrt(power(value - k, 2) + power(value / 2 - k / 3, 2))), 6) AS median_error FROM e")
def median_error(read):
    return evaluation.median_error(swings(read).select(F.col("value").alias("x"), (F.col("value") / 2).alias("y"), F.col("k").alias("tx"), (F.col("k") / 3).alias("ty")))


# sources and sinks --------------------------------------------------------------------------------


@query("SELECT o_orderkey, 'x' AS v FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0")
def upsert(read):
    old = read("orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    return sources.upsert(old, old.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("x").alias("v")), ["o_orderkey"])


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(json_extract_string(props, '$.missing') AS BIGINT) AS none FROM events")
def json_fields(read):
    return read("events").select("event_id", sources.number(F.col("props"), "$.k").alias("k"), sources.whole(F.col("props"), "$.missing").alias("none"))


@query(f"WITH {E}, t AS (SELECT session, frame, round(greatest(0.0, least(k - 1, value - 2)), 6) AS low, value FROM e) SELECT session, frame, low, round(least(value, greatest(0.0, low) + 2), 6) AS high FROM t")
def window_bounds(read):
    low, high = sources.window_bounds(F.col("value"), F.col("k"), 2.0)
    return swings(read).select("session", "frame", low.alias("low"), high.alias("high"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'done' WHEN o_orderstatus = 'P' THEN 'running' ELSE o_orderstatus END AS status FROM orders""")
def job_transitions(read):
    jobs = read("orders").select("o_orderkey", F.when(F.col("o_orderstatus").isin("O", "P"), "queued").otherwise(F.col("o_orderstatus")).alias("status"))
    steps = read("orders").select("o_orderkey", F.explode(F.when(F.col("o_orderstatus") == "O", F.array(F.struct(F.lit(1).alias("at"), F.lit("running").alias("to")), F.struct(F.lit(2).alias("at"), F.lit("done").alias("to")))).otherwise(F.array(F.struct(F.lit(1).alias("at"), F.lit("running").alias("to")), F.struct(F.lit(0).alias("at"), F.lit("done").alias("to"))))).alias("s")).select("o_orderkey", "s.at", "s.to")
    return history.transition(jobs, steps, "o_orderkey", {"running": ("queued",), "done": ("running",)}, "at").select("o_orderkey", "status")


@query("SELECT o_orderkey, (round_even(100.0::DOUBLE * (o_orderkey % 7) / nullif(o_orderkey % 11, 0), 0))::BIGINT AS p, CASE WHEN o_orderkey % 7 = 1 THEN '1 swing' ELSE (o_orderkey % 7) || ' swings' END AS label FROM orders WHERE o_orderkey % 11 <> 0")
def percents_and_labels(read):
    from motionlake.operators.dashboard import plural

    k = F.col("o_orderkey")
    return read("orders").where("o_orderkey % 11 <> 0").select("o_orderkey", textguard.percent(k % 7, k % 11).alias("p"), plural(k % 7, "swing").alias("label"))


@query("""WITH g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 HOUR)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, run::INT AS run, count(*) AS n FROM r GROUP BY user_id, run""")
def point_windows(read):
    """Runs of point events by Spark's own session windows: an hour of quiet ends one."""
    e = read("events")
    s = e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("session_window.start")).alias("run"), "n")


# composition of dashboards, advice and evaluation ---------------------------------------------------


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P')")
def active_jobs(read):
    return history.count_by_status(read("orders"), "o_orderstatus", ("O", "P"))


@query(f"""WITH RECURSIVE {E}, g AS (SELECT session, kind, floor(k / 25)::INT AS band, min(k) AS mn, max(k) AS mx FROM e GROUP BY ALL), s AS (SELECT session, kind, band, floor(mn / 10) * 10 AS lo, ceil(mx / 10) * 10 AS h0 FROM g),
r AS (SELECT session, kind, band, lo, CASE WHEN h0 = lo THEN h0 + 10 ELSE h0 END AS hi, 0 AS n FROM s UNION ALL
SELECT session, kind, band, l2, CASE WHEN (hi - lo < 20 AND (lo > 0 OR hi < 100)) AND hi - l2 < 20 AND hi < 100 THEN hi + 10 ELSE hi END, n + 1 FROM (SELECT *, CASE WHEN hi - lo < 20 AND lo > 0 THEN lo - 10 ELSE lo END AS l2 FROM r WHERE n < 20))
SELECT session, kind, band, greatest(lo, 0) AS min, least(hi, 100) AS max, CASE WHEN least(hi, 100) - greatest(lo, 0) > 40 THEN 20.0 ELSE 10.0 END::DOUBLE AS step FROM r WHERE n = 20""")
def score_axis(read):
    g = swings(read).groupBy("session", "kind", F.floor(F.col("k") / 25).cast("int").alias("band")).agg(F.collect_list("k").alias("v"))
    return g.select("session", "kind", "band", dashboard.score_axis(F.col("v")).alias("a")).select("session", "kind", "band", "a.*")


_SIDE = lambda x: f"CASE WHEN {x} < 20.0 THEN -1 WHEN {x} > 34.5 THEN 1 ELSE 0 END"


@query(f"""WITH {E} SELECT session, frame, CASE WHEN {_SIDE('round(value, 0)')} = {_SIDE('value')} THEN printf('%.0f', round(value, 0)) WHEN {_SIDE('round(value, 1)')} = {_SIDE('value')} THEN printf('%.1f', round(value, 1)) ELSE printf('%.2f', round(value, 2)) END AS shown,
coalesce(CASE WHEN value < 20.0 THEN 20.0 - value WHEN value > 34.5 THEN value - 34.5 ELSE 0 END >= 14.5, false) AS far, CASE WHEN k = round(k) THEN printf('%.0f', k) ELSE printf('%.1f', round(k, 1)) END AS bound FROM e""")
def shown_values(read):
    low, high = F.lit(20.0), F.lit(34.5)
    return swings(read).select("session", "frame", dashboard.shown_value(F.round("value", 2), low, high, F.lit(0)).alias("shown"), dashboard.far_outside(F.col("value"), low, high).alias("far"), dashboard.shown_bound(F.col("k")).alias("bound"))


RULES = [("clean", "near below", "far below", "good", "near above", "far above"), ("swing_path_angle_deg", "lift a little", "lift more", "good path", "flatten a little", "flatten more"), ("swing_path_angle_deg:slice", "less down", "much less down", "good slice", "more down", "much more down")]


@query(f"""WITH {E}, m AS (SELECT session, frame, CASE kind WHEN 'click' THEN 'clean' WHEN 'view' THEN 'swing_path_angle_deg' WHEN 'error' THEN 'odd' ELSE 'hidden' END AS metric, value * 2 AS value, CASE WHEN frame % 3 = 0 THEN -40.0 WHEN frame % 3 = 1 THEN 10.0 ELSE -5.0 END AS low, CASE WHEN frame % 3 = 0 THEN -2.0 WHEN frame % 3 = 1 THEN 30.0 ELSE 25.0 END AS high FROM e),
v AS (SELECT *, CASE WHEN value < low THEN 'low' WHEN value > high THEN 'high' ELSE 'ideal' END AS verdict, CASE WHEN value < low THEN low - value WHEN value > high THEN value - high ELSE 0 END >= high - low AS far, metric = 'swing_path_angle_deg' AS path FROM m)
SELECT session, frame, CASE WHEN metric NOT IN ('clean', 'swing_path_angle_deg') OR (path AND low < 0 AND high > 0) THEN NULL WHEN verdict = 'ideal' THEN CASE WHEN NOT path THEN 'good' WHEN low < 0 THEN 'good slice' ELSE 'good path' END WHEN path AND abs(value) > 90 THEN NULL
WHEN verdict = 'low' THEN CASE WHEN NOT path THEN CASE WHEN far THEN 'far below' ELSE 'near below' END WHEN low < 0 THEN CASE WHEN far THEN 'much less down' ELSE 'less down' END ELSE CASE WHEN far THEN 'lift more' ELSE 'lift a little' END END
ELSE CASE WHEN NOT path THEN CASE WHEN far THEN 'far above' ELSE 'near above' END WHEN low < 0 THEN CASE WHEN far THEN 'much more down' ELSE 'more down' END ELSE CASE WHEN far THEN 'flatten more' ELSE 'flatten a little' END END END AS advice, verdict = 'ideal' AS is_praise FROM v""")
def swing_advice(read):
    s = swings(read)
    rest = F.col("frame") % 3
    d = s.select("session", "frame", F.when(F.col("kind") == "click", "clean").when(F.col("kind") == "view", "swing_path_angle_deg").when(F.col("kind") == "error", "odd").otherwise("hidden").alias("metric"), (F.col("value") * 2).alias("value"), F.when(rest == 0, -40.0).when(rest == 1, 10.0).otherwise(-5.0).alias("low"), F.when(rest == 0, -2.0).when(rest == 1, 30.0).otherwise(25.0).alias("high"))
    d = d.withColumn("verdict", F.when(F.col("value") < F.col("low"), "low").when(F.col("value") > F.col("high"), "high").otherwise("ideal"))
    rules = s.sparkSession.createDataFrame(RULES, "metric string, below_near string, below_far string, in_range string, above_near string, above_far string")
    return dashboard.advice(d, rules, ("hidden",)).select("session", "frame", "advice", "is_praise")


@query(f"""WITH {E}, l AS (SELECT kind, session, frame, value AS u, k AS v FROM e WHERE k > 20 AND session IN (SELECT session FROM e WHERE value > 90)), d AS (SELECT l.kind, l.frame, min(sqrt(power(c.t % 97 / 1.5 - u, 2) + power(c.k / 1.5 - v, 2))) AS far FROM l JOIN e c ON c.kind = l.kind AND c.session = l.session GROUP BY l.kind, l.frame)
SELECT kind, count(*) AS total, count(*) FILTER (far <= 12) AS matched FROM d GROUP BY kind""")
def label_match(read):
    s = swings(read)
    labels = s.select("kind", F.col("session").alias("f"), F.col("value").alias("u"), F.col("k").alias("v"), (F.col("k") > 20).alias("visible"))
    frames_ = s.where("value > 90").select(F.col("session").alias("f")).distinct().crossJoin(s.select("kind").distinct())
    return evaluation.label_match(labels, s.select("kind", F.col("session").alias("f"), (F.col("t") % 97).alias("x"), F.col("k").alias("y")), frames_, "kind", "f", 1.5, 12.0)


@query(f"""WITH {E}, c AS (SELECT kind, session, count(*) AS n FROM e GROUP BY ALL) SELECT kind, count(*) AS frames_evaluated, sum(n)::BIGINT AS total, round(avg(n), 3) AS mean, quantile_cont(n, 0.5) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS max FROM c GROUP BY kind""")
def candidate_counts(read):
    return evaluation.count_summary(swings(read).groupBy("kind", "session").agg(F.count(F.lit(1)).alias("n")), "kind", "n")


@query(f"""WITH {E}, c AS (SELECT session, session % 5 AS game, count(*) FILTER (kind = 'click') AS a, count(*) FILTER (kind = 'view') AS b, count(*) FILTER (kind = 'error') AS x, count(*) FILTER (kind = 'purchase') AS y, list(value / 20) AS er FROM e GROUP BY session), f AS (SELECT *, unnest(er) AS er1 FROM c),
g AS (SELECT game, count(*) AS clips, round(sum(least(a, b)) / greatest(sum(a), 1)::DOUBLE, 2) AS bounce_recall, round(sum(least(a, b)) / greatest(sum(b), 1)::DOUBLE, 2) AS bounce_precision, round(sum(least(x, y)) / greatest(sum(x), 1)::DOUBLE, 2) AS hit_recall, round(sum(least(x, y)) / greatest(sum(y), 1)::DOUBLE, 2) AS hit_precision FROM c GROUP BY ROLLUP (game)),
h AS (SELECT game, round(median(er1) FILTER (er1 < 3), 2) AS median_error, count(*) FILTER (er1 >= 3)::INT AS gross, count(*)::INT AS errors FROM f GROUP BY ROLLUP (game)) SELECT g.*, median_error, gross, errors FROM g JOIN h ON g.game IS NOT DISTINCT FROM h.game""")
def clip_summary(read):
    n = lambda k: F.count_if(F.col("kind") == k)
    clips = swings(read).groupBy("session").agg(n("click").alias("truth_bounces"), n("view").alias("found_bounces"), n("error").alias("truth_hits"), n("purchase").alias("found_hits"), F.collect_list(F.col("value") / 20).alias("errors"))
    clips = clips.withColumn("matched_bounces", F.least("truth_bounces", "found_bounces")).withColumn("matched_hits", F.least("truth_hits", "found_hits")).withColumn("game", F.col("session") % 5)
    return evaluation.summarize(clips, "game")


# swing metrics --------------------------------------------------------------------------------------


_TURN_SPAN = "pos BETWEEN 5 AND 30"


def turned(read, *landmarks: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Normalised marks of some landmarks, phases at fixed frames, a contact and, given the wrists, a direction for each sequence."""
    norm = cut(normalized.normalized(frames(read), landmarks))
    each = norm.select("seq_id").distinct()
    spans = F.array(*(F.struct(F.lit(n).alias("phase"), F.lit(a).alias("start"), F.lit(z).alias("end")) for n, a, z in (("takeback", 5, 12), ("forward_swing", 12, 20), ("follow_through", 22, 31))))
    return normalized.marks_of(norm, landmarks), each.select("seq_id", F.inline(spans)), each.withColumn("pos", F.lit(19)), normalized.swing_direction(norm)


def _turn_sql(a: int, b: int, least: float, line: str) -> str:
    half = lambda x: f"({x}) + 90 - 180 * floor((({x}) + 90) / 180) - 90"
    return f"""WITH {_NORM}, p AS (SELECT seq_id, frame AS pos, max(x) FILTER (landmark = {b}) - max(x) FILTER (landmark = {a}) AS dx, max(y) FILTER (landmark = {b}) - max(y) FILTER (landmark = {a}) AS dy,
min(visibility) FILTER (landmark IN ({a}, {b})) >= 0.5 AS shown FROM norm GROUP BY ALL), q AS (SELECT *, shown AND sqrt(dx * dx + dy * dy) >= {least} AS good, shown AND sqrt(dx * dx + dy * dy) < {least} AS short, degrees(atan2(dy, dx)) AS angle FROM p WHERE {_TURN_SPAN} AND seq_id IN (SELECT seq_id FROM p GROUP BY seq_id HAVING max(pos) >= 5)),
g AS (SELECT seq_id, angle, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS k FROM q WHERE good), s AS (SELECT seq_id, degrees(atan2(avg(sin(radians(2 * angle))), avg(cos(radians(2 * angle))))) / 2 AS start FROM g WHERE k <= 3 GROUP BY seq_id),
o AS (SELECT seq_id, k, abs({half('angle - start')}) AS v FROM g JOIN s USING (seq_id)), m AS (SELECT seq_id, lag(v) OVER w AS a, v AS b, lead(v) OVER w AS c FROM o WINDOW w AS (PARTITION BY seq_id ORDER BY k)),
t AS (SELECT seq_id, max(a + b + c - greatest(a, b, c) - least(a, b, c)) AS peak FROM m WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY seq_id), n AS (SELECT seq_id, count(*) FILTER (good) AS n, bool_or(short) AS short FROM q GROUP BY seq_id)
SELECT seq_id, round(CASE WHEN n >= 5 THEN least(greatest(peak, 0), 90) END, 6) AS turn_deg, CASE WHEN n < 5 AND short THEN '{line}_foreshortened' WHEN n < 5 THEN '{line}_too_few_frames' END AS flag FROM n LEFT JOIN t USING (seq_id)"""


@query(_turn_sql(11, 12, swing.SHOULDER_LINE_TU, "shoulder_line"))
def shoulder_turn(read):
    marks, ph, _, _ = turned(read, *pose.SHOULDERS)
    return swing.line_turn(marks, ph).withColumn("turn_deg", F.round("turn_deg", 6))


@query(_turn_sql(23, 24, swing.HIP_LINE_TU, "hip_line"))
def hip_turn(read):
    marks, ph, _, _ = turned(read, *pose.HIPS)
    return swing.hip_turn(marks, ph).withColumn("turn_deg", F.round("turn_deg", 6))


@query()
def knee_flexion(read):
    marks, ph, at, ways = turned(read, *pose.WRISTS, *pose.HIPS, *pose.KNEES, *pose.ANKLES)
    return swing.knee_flexion(marks, ph, at, ways)


def posed(read) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marks of the pose frames, a racket hand and a contact for each sequence."""
    marks = swing.in_torsos(frames(read))
    each = marks.select("seq_id").distinct()
    hands = each.withColumn("hand", F.when(F.col("seq_id") % 2 == 0, "right").otherwise("left"))
    return marks, hands, each.withColumn("pos", (10 + F.col("seq_id") % 20).cast("int"))


_X = lambda k: f"(({_AT('x', k)} - ox) / scale)"
_Y = lambda k: f"((-{_AT('y', k)} - oy) / scale)"
_S = lambda k: f"(valid AND embedding[{(k + 5) % 64 + 1}] > -0.25)"
_OWN = lambda f, pair: f"CASE WHEN seq_id % 2 = 0 THEN {f(pair[1])} ELSE {f(pair[0])} END"
_POSED = f"{_BODY}, q AS (SELECT b.*, embedding, scale, frame - (10 + b.seq_id % 20) AS rel FROM b JOIN embeddings e ON b.seq_id = e.vec_id // 40 AND b.frame = e.vec_id % 40 JOIN sc ON sc.seq_id = b.seq_id)"
_WAY = "CASE WHEN seq_id % 2 = 0 THEN 1 ELSE -1 END"


@query(f"""WITH {_POSED}, a AS (SELECT seq_id, {_WAY} * ({_X(12)} - {_X(11)}) AS ax, {_WAY} * ({_Y(12)} - {_Y(11)}) AS ay, {_OWN(_X, pose.WRISTS)} - ({_X(11)} + {_X(12)}) / 2 AS wx, {_OWN(_Y, pose.WRISTS)} - ({_Y(11)} + {_Y(12)}) / 2 AS wy,
{_OWN(_S, pose.WRISTS)} AS w, {_S(11)} AND {_S(12)} AS sh, {_S(0)} AS ns, {_OWN(_Y, pose.WRISTS)} > {_Y(0)} AS up FROM q WHERE rel = 0)
SELECT seq_id, round(CASE WHEN w AND sh THEN (wx * ax + wy * ay) / sqrt(ax * ax + ay * ay) END, 6) AS across_tu, CASE WHEN w AND ns THEN up END AS above_nose FROM a""")
def wrist_at_contact(read):
    marks, hands, contacts_ = posed(read)
    return swing.at_contact(marks, contacts_, hands)


@query(f"""WITH {_POSED} SELECT seq_id, round(max(CASE WHEN {_OWN(_S, pose.WRISTS)} AND {_S(11)} AND {_S(12)} THEN {_OWN(_Y, pose.WRISTS)} - ({_Y(11)} + {_Y(12)}) / 2 END), 6) AS height_tu FROM q WHERE rel > 0 GROUP BY seq_id""")
def follow_through_height(read):
    marks, hands, contacts_ = posed(read)
    return swing.follow_through_height(marks, contacts_, hands)


@query(f"""WITH {_POSED} SELECT seq_id, count(*) AS n, round(min(sqrt(power({_X(15)} - {_X(16)}, 2) + power({_Y(15)} - {_Y(16)}, 2))), 6) AS least FROM q WHERE abs(rel) <= 3 AND {_S(15)} AND {_S(16)} GROUP BY seq_id""")
def wrist_separations(read):
    marks, _, contacts_ = posed(read)
    found = swing.wrist_separations(marks, contacts_)
    return found.select("seq_id", F.size("separations").cast("long").alias("n"), F.array_min("separations").alias("least"))


@query(f"""WITH {_POSED}, p AS (SELECT seq_id, frame, {_OWN(_X, pose.WRISTS)} AS x, {_OWN(_Y, pose.WRISTS)} AS y FROM q WHERE rel BETWEEN -6 AND 3 AND {_OWN(_S, pose.WRISTS)}),
g AS (SELECT seq_id, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c, arg_max(x, frame) - arg_min(x, frame) AS dx, arg_max(y, frame) - arg_min(y, frame) AS dy FROM p GROUP BY seq_id HAVING count(*) >= 3),
t AS (SELECT *, atan2(2 * c, a - b) / 2 AS t FROM g), d AS (SELECT *, CASE WHEN cos(t) * dx + sin(t) * dy < 0 THEN degrees(atan2(-sin(t), -cos(t))) ELSE degrees(atan2(sin(t), cos(t))) END AS d FROM t)
SELECT seq_id, round(CASE WHEN d > 90 THEN 180 - d WHEN d < -90 THEN -180 - d ELSE d END, 6) AS angle_deg, round(sqrt(greatest((a + b) / 2 - sqrt(power((a - b) / 2, 2) + c * c), 0)), 6) AS deviation_tu FROM d""")
def swing_path(read):
    marks, hands, contacts_ = posed(read)
    return swing.swing_path(marks, contacts_, hands)


@query()
def wrist_lag(read):
    marks, hands, contacts_ = posed(read)
    return swing.wrist_lag(marks, contacts_, hands)
