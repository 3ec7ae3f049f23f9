import pytest
from pyspark.sql import functions as F

from motionlake.operators import dashboard, scorecard, stats


def rows(spark, values, key="s"):
    return spark.createDataFrame([(key, float(i), v) for i, v in enumerate(values)], "k string, t double, v double")


def test_robust_spread(spark):
    r = stats.robust_spread(rows(spark, [1.0, 2.0, 3.0, 4.0, 100.0, float("nan"), None, float("inf")]), "k", "v").first()
    assert (r.n, r.median, r["mad"], round(r.robust_sd, 4)) == (5, 3.0, 1.0, 1.4826)
    assert stats.robust_spread(rows(spark, [1.0, None]), "k", "v").first().median is None


def test_theil_sen(spark):
    assert stats.theil_sen(rows(spark, [0.0, 2.0, 4.0, 6.0, 100.0]), "k", "t", "v").first().slope == 2.0
    same = spark.createDataFrame([("s", 1.0, 0.0), ("s", 1.0, 5.0)], "k string, t double, v double")
    assert stats.theil_sen(same, "k", "t", "v").first().slope == 0.0


@pytest.mark.parametrize("values,want", [([1.5 + 0.05 * i for i in range(21)], "rising"), ([2.0] * 19 + [40.0, 50.0], "steady")])
def test_within_trend(spark, values, want):
    df = rows(spark, values).withColumn("t", F.col("t") * 45)
    assert stats.within_trend(df, "k", "t", "v").first().direction == want


def test_trend_needs_rows_and_span(spark):
    assert stats.within_trend(rows(spark, [float(i) for i in range(14)]).withColumn("t", F.col("t") * 100), "k", "t", "v").count() == 0
    assert stats.within_trend(rows(spark, [float(i) for i in range(21)]).withColumn("t", F.col("t") * 10), "k", "t", "v").count() == 0


@pytest.mark.parametrize("scores,want", [([60.0, 66.0], "rising"), ([60.0, 61.5], "steady"), ([66.0, 60.0], "falling")])
def test_between_trend(spark, scores, want):
    df = spark.createDataFrame([("u", 0, "old", 40.0)] + [("u", i + 1, "new", s) for i, s in enumerate(scores)], "k string, t int, version string, v double")
    r = stats.between_trend(df, "k", "t", "version", "v").first()
    assert (r.sessions, r.first_value, r.direction) == (2, scores[0], want)


@pytest.mark.parametrize("counts,want", [([5, 4, 2], [46, 36, 18]), ([5, 3, 1], [56, 33, 11]), ([7, 2, 1], [70, 20, 10]), ([3, 3, 2], [37, 37, 25]), ([0, 0], [0, 0])])
def test_whole_percents(spark, counts, want):
    df = spark.createDataFrame([("k", chr(97 + i), c) for i, c in enumerate(counts)], "k string, name string, n long")
    assert [r.percent for r in dashboard.whole_percents(df, "k", "name", "n").orderBy("name").collect()] == want


def test_score_ramp(spark):
    band = (0.0, 0.06, 0.0, 0.12)
    df = spark.createDataFrame([(-0.5,), (0.12,), (0.09,), (None,), (float("nan"),), (float("inf"),)], "v double").selectExpr("v", *(f"{x}D AS {n}" for x, n in zip(band, ("ideal_min", "ideal_max", "hard_min", "hard_max"))))
    points, verdict = scorecard.score(F.col("v"), F.lit(True))
    assert [tuple(r) for r in df.select(points, verdict).collect()] == [(100.0, "ideal"), (0.0, "high"), (50.0, "high")] + [(None, "unavailable")] * 3


def test_bands_fall_back(spark):
    bands = spark.createDataFrame([("base", "m", 1.0), ("serve", "m", 2.0)], "kind string, metric string, x double")
    got = scorecard.bands_for(bands, spark.createDataFrame([("serve",), ("lob",)], "kind string"), "kind").collect()
    assert sorted((r.kind, r.x) for r in got) == [("lob", 1.0), ("serve", 2.0)]


def test_overall_needs_three_categories(spark):
    cats = spark.createDataFrame([("a", "contact", 50.0), ("a", "balance", 100.0), ("a", "swing_path", 60.0), ("a", "preparation", None), ("b", "contact", 50.0), ("b", "balance", 50.0)], "k string, category string, score double")
    got = {r.k: r.overall for r in scorecard.overall(cats, "k").collect()}
    assert got == {"a": round((0.3 * 50 + 0.15 * 100 + 0.25 * 60) / 0.7, 1), "b": None}
