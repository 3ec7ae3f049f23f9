import random

import numpy as np
from pyspark.sql import functions as F

from motionlake.operators import series


def frame(spark, values, valid=None):
    return spark.createDataFrame([("s", i, float(i) * 0.1, None if v is None else float(v), bool(valid[i]) if valid else True) for i, v in enumerate(values)], "k string, f int, t double, v double, ok boolean")


def column(df, name):
    return [r[name] for r in df.orderBy("f").collect()]


def test_longest_gap(spark):
    assert series.longest_gap(frame(spark, [0] * 9, [1, 0, 0, 1, 0, 0, 0, 0, 1]), "k", "f", "ok").first().gap == 4
    assert series.longest_gap(frame(spark, [0] * 3), "k", "f", "ok").first().gap == 0


def test_fill_equals_interpolation(spark):
    r = random.Random(1)
    values, valid = [r.random() for _ in range(40)], [r.random() < 0.5 for _ in range(40)]
    at = [i for i, v in enumerate(valid) if v]
    want = np.interp(range(40), at, [values[i] for i in at])
    assert np.allclose(column(series.fill_linear(frame(spark, values, valid), "k", "f", "v", "ok"), "filled"), want)
    assert column(series.fill_linear(frame(spark, [1, 2], [0, 0]), "k", "f", "v", "ok"), "filled") == [1.0, 2.0]


def test_smoothing_keeps_parabolas(spark):
    want = [0.5 * i * i - 3 * i + 1 for i in range(12)]
    assert np.allclose(column(series.smooth(frame(spark, want), "k", "f", "v"), "smoothed"), want)
    assert column(series.smooth(frame(spark, [3, 1, 2, 9]), "k", "f", "v"), "smoothed") == [3, 1, 2, 9]
    noisy = list(np.random.default_rng(2).normal(size=30))
    fit = [np.polyval(np.polyfit(range(-2, 3), noisy[i - 2 : i + 3], 2), 0) for i in range(2, 28)]
    assert np.allclose(column(series.smooth(frame(spark, noisy), "k", "f", "v"), "smoothed")[2:28], fit)


def test_derivative(spark):
    df = spark.createDataFrame([("s", i, t, 3 * t) for i, t in enumerate([0.0, 0.1, 0.35, 0.36, 0.36])], "k string, f int, t double, v double")
    assert np.allclose(column(series.central_difference(df, "k", "f", "v", "t"), "slope"), [3, 3, 3, 3, 0])


def test_suppression_equals_greedy(spark):
    r = random.Random(3)
    v = [r.randrange(50) for _ in range(60)]
    peaks = sorted((i for i in range(60) if (i == 0 or v[i] > v[i - 1]) and (i == 59 or v[i] >= v[i + 1])), key=lambda i: (-v[i], i))
    kept = []
    for i in peaks:
        if all(abs(i - j) >= 6 for j in kept):
            kept.append(i)
    assert sorted(x.pos for x in series.suppress(frame(spark, v), "k", "f", "v", 6).collect()) == sorted(kept)


def test_rolling_median(spark):
    r = random.Random(4)
    v = [r.random() for _ in range(30)]
    want = [float(np.median([v[j] for j in range(30) if abs(j - i) <= 3])) for i in range(30)]
    df = frame(spark, v).withColumn("t", F.col("f").cast("double"))
    assert np.allclose(column(series.rolling_median(df, "k", "t", "v", 3), "rolling"), want)


def test_monotone_and_path(spark):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate([0.0, 0.0004, 0.0004, 0.01, 0.009])], "k string, f int, t double")
    assert column(series.monotone_ms(df, "k", "f", "t"), "ms") == [0, 1, 2, 10, 11]
    xy = spark.createDataFrame([("s", 0, 0.0, 0.0, True), ("s", 1, 3.0, 4.0, True), ("s", 2, 9.0, 9.0, False), ("s", 3, 9.0, 10.0, True)], "k string, f int, x double, y double, ok boolean")
    assert series.path_length(xy, "k", "f", "x", "y", "ok").first().length == 5.0
