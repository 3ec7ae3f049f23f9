"""Streams against the batch operators."""

from pyspark.sql import functions as F

from motionlake import streaming
from motionlake.operators import history, match


def run(query_df, name):
    q = query_df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_replay_equals_batch(spark, tmp_path):
    rows = [(m, n, "AB"[(n * 7 + len(m)) % 3 % 2]) for m in ("m1", "m22") for n in range(40)]
    df = spark.createDataFrame(rows, "match_id string, sequence long, winner string")
    df.where("sequence < 25").write.parquet(f"file://{tmp_path}/in", mode="append")
    df.where("sequence >= 25").write.parquet(f"file://{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(f"file://{tmp_path}/in")
    run(streaming.replay_stream(stream), "replayed")
    want = match.replay(df, "match_id", "sequence", "winner")
    assert sorted(map(tuple, spark.table("replayed").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_throttle_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(u, float(t * t % 97)) for u in (1, 2) for t in range(30)], "user_id long, at_s double").dropDuplicates()
    df.write.parquet(f"file://{tmp_path}/in")
    run(streaming.throttle_stream(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), 10.0), "throttled")
    assert sorted(map(tuple, spark.table("throttled").collect())) == sorted(map(tuple, history.throttle(df, "user_id", "at_s", 10.0).collect()))


def test_quiet_sessions(spark, tmp_path):
    df = spark.createDataFrame([("s", t, 1.0) for t in (0.0, 2.0, 4.5, 7.1, 60.0)], "k string, t double, value double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.write.parquet(f"file://{tmp_path}/in")
    run(streaming.quiet_sessions(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), "k", "ts"), "quiet")
    assert sorted(r.n for r in spark.table("quiet").collect()) == [1, 3]
