"""A synthetic swing through the whole chain."""

import math

import pytest
from pyspark.sql import functions as F

from motionlake import sources
from motionlake.operators import pose, segmentation, series


def landmarks(wrist_r, wrist_l, seen=1.0):
    base = {0: (0.5, 0.2), 11: (0.45, 0.35), 12: (0.55, 0.35), 13: (0.42, 0.45), 14: (0.58, 0.45), 23: (0.47, 0.6), 24: (0.53, 0.6), 25: (0.47, 0.75), 26: (0.53, 0.75), 27: (0.47, 0.9), 28: (0.53, 0.9), 15: wrist_l, 16: wrist_r}
    return [(*base.get(k, (0.5, 0.5)), 0.0, seen) for k in range(33)]


@pytest.fixture(scope="module")
def swing(spark):
    rows = []
    for f in range(40):
        # the right wrist rests, goes back, swings through around frame 24, rests again
        s = 1 / (1 + math.exp(-(f - 24) * 0.9))
        back = -0.1 * math.exp(-((f - 14) ** 2) / 18)
        rows.append(("a", f, f / 30, True, 720, 720, landmarks((0.55 + back + 0.3 * s, 0.5 - 0.2 * s), (0.45, 0.5), 0.0 if f == 7 else 1.0)))
    df = spark.createDataFrame(rows, "seq_id string, frame int, ts_s double, detected boolean, width_px int, height_px int, landmarks array<struct<x: double, y: double, z: double, visibility: double>>")
    return pose.frames(df)


def test_quality_and_scale(swing):
    q = pose.quality(swing).first()
    assert q.usable and q.longest_gap == 1 and q.frames == 40
    assert abs(pose.torso_scale(swing).first().scale - 0.25) < 1e-9
    assert not pose.identity_unstable(swing).first().unstable


def test_hand_contact_phases_metrics(spark, swing):
    hands = pose.handedness(swing)
    h = hands.first()
    assert h.hand == "right" and 0 < h.confidence <= 1
    hinted = pose.handedness(swing, spark.createDataFrame([("a", "left")], "seq_id string, hand string")).first()
    assert (hinted.hand, hinted.confidence) == ("left", 1.0)
    racket = pose.racket_track(swing, hands)
    c = pose.contact(racket)
    at = c.first()
    assert 22 <= at.peak_frame <= 26 and at.peak_frame <= at.frame <= at.peak_frame + 3 and at.confidence > 0.35
    ph = pose.phases(racket, c).collect()
    assert [p.phase for p in ph] == list(pose.PHASES)
    assert all(a.end == b.start for a, b in zip(ph, ph[1:])) and ph[0].start == 0 and all(p.start <= p.end for p in ph)
    t = pose.tempo(pose.phases(racket, c), swing).first().tempo
    assert t is not None and t > 0
    m = pose.swing_metrics(swing, hands, c, pose.phases(racket, c)).first()
    assert m.head_stillness_tu == 0.0 and abs(m.knee_flexion_min_deg - 180) < 1e-6 and 0 < m.elbow_angle_at_contact_deg < 180


def test_shot_type(spark):
    m = spark.createDataFrame([("s", 1.5, 0.9, 0.0), ("b", 0.9, 0.1, 0.0), ("f", 0.9, 0.9, 20.0), ("n", 0.9, 0.9, 0.0)], "seq_id string, contact_height_ratio double, wrist_separation_at_contact_tu double, swing_path_angle_deg double")
    scores = pose.class_scores(pose.shot_evidence(m), "seq_id")
    got = {r.seq_id: r["class"] for r in pose.accept(scores, "seq_id").collect()}
    assert got == {"s": "serve", "b": "backhand_two_handed", "f": "forehand_topspin", "n": "unknown"}


def test_lines(spark):
    df = spark.createDataFrame([("k", i, math.cos(0.5) * i, math.sin(0.5) * i, a) for i, a in enumerate([80.0, 89.0, -82.0, -73.0])], "k string, f int, x double, y double, a double")
    line = pose.fitted_line(df, "k", "x", "y").first()
    assert abs(line.angle - math.degrees(0.5)) < 1e-9 and line.deviation < 1e-7
    assert abs(pose.net_turn(df, "k", "f", "a").first().turn - 27) < 1e-9
    assert abs(abs(pose.axial_mean(df, "k", "a").first()["mean"]) - 86.5) < 0.2


def test_net_turn_a_hair_below_a_quarter(spark):
    # 83.58 - 173.58 + 90 is a hair below 0: a turn by +90, as its SQL says
    df = spark.createDataFrame([("k", 0, 173.58), ("k", 1, 83.58)], "k string, f int, a double")
    assert 83.58 - 173.58 + 90 < 0 and abs(pose.net_turn(df, "k", "f", "a").first().turn - 90) < 1e-9


def test_segmentation(spark):
    speed = [0.5 + 9 * math.exp(-((f - 60) ** 2) / 20) + 8 * math.exp(-((f - 150) ** 2) / 20) + 1.2 * math.exp(-((f - 100) ** 2) / 20) for f in range(200)]
    df = spark.createDataFrame([("s", f, f / 30, v) for f, v in enumerate(speed)], "k string, f int, t double, v double")
    assert segmentation.refractory_frames(df, "k", "t").first().frames == 18
    c = segmentation.candidates(df, "k", "f", "t", "v", 18)
    got = {r.pos: r.status for r in c.collect()}
    assert got[60] == got[150] == "accepted" and got[100] == "below_floor"
    ok = c.where("status = 'accepted'")
    bounds = df.groupBy("k").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    w = segmentation.windows(ok, "k", bounds)
    wins = w.orderBy("start").collect()
    assert [x.status for x in wins] == ["ok", "ok"] and wins[0].end <= wins[1].start
    cut = segmentation.frames_of(df, w, "k", "t")
    assert cut.groupBy("f").count().agg(F.max("count")).first()[0] == 1 and set(r.window for r in cut.collect()) == {60, 150}
    a = segmentation.digest(df.withColumn("a", F.array("v", "t")), "k", "f", "a").first().digest
    assert a == segmentation.digest(df.orderBy(F.desc("f")).withColumn("a", F.array("v", "t")), "k", "f", "a").first().digest and len(a) == 64


def test_sources(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"type":"session","session":"s1"}\n{"type":"ball","frame":3,"u_px":1.5,"v_px":2,"visible":true}\n{"type":"x"}\n')
    balls, sessions = sources.labels(spark, f"file://{tmp_path}/l.jsonl")
    assert [tuple(r) for r in balls.collect()] == [(3, 1.5, 2.0, True)] and sessions.first().session == "s1"
    assert [r.length for r in sources.objects(spark, f"file://{tmp_path}").collect()] == [(tmp_path / "l.jsonl").stat().st_size]
    js = spark.createDataFrame([('{"a": 3, "b": "4.5", "c": [1]}',)], "d string")
    assert tuple(js.select(sources.number(F.col("d"), "$.a"), sources.number(F.col("d"), "$.b"), sources.number(F.col("d"), "$.c"), sources.whole(F.col("d"), "$.b"), sources.whole(F.col("d"), "$.a")).first()) == (3.0, 4.5, None, None, 3)
    f = spark.createDataFrame([("s", i, i * 0.04) for i in range(10)], "k string, frame int, ts_s double")
    near = sources.nearest_frames(f, sources.target_times(spark, 0.0, 0.3, 10.0, 5), "k", 0.05).orderBy("target").collect()
    assert sorted(r.frame for r in near) == [0, 3, 5]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, sources.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert series.MAX_GAP == 3
