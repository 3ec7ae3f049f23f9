"""Cards refuse what they would have dropped; summaries of clips without lists of all errors."""

import pytest

from motionlake.operators import evaluation, scorecard

BANDS = "metric string, category string, weight double, lower_is_better boolean, ideal_min double, ideal_max double, hard_min double, hard_max double"


def band(metric, low, high):
    return metric, "contact", 1.0, False, low, high, low - 1, high + 1


def test_card_refuses_several_bands_of_a_metric(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "m1 double, m2 double")
    good = spark.createDataFrame([band("m1", 0.0, 2.0), band("m2", 0.0, 1.0)], BANDS)
    card = scorecard.card(df, ["m1", "m2", "m3"], good).first()
    assert [(s.metric, s.score) for s in card.scores] == [("m1", 100.0), ("m2", 0.0)] and {c.category: c.score for c in card.categories}["contact"] == 50.0
    several = spark.createDataFrame([band("m1", 0.0, 2.0), band("m1", 5.0, 6.0), band("m1", 7.0, 8.0), band("m2", 0.0, 1.0)], BANDS)
    with pytest.raises(ValueError, match="several bands"):
        scorecard.card(df, ["m1", "m2"], several)


def test_categories_refuse_too_many_names(spark, monkeypatch):
    monkeypatch.setattr(scorecard, "MOST_CATEGORIES", 2)
    scored = spark.createDataFrame([(1, "a", 1.0, 50.0)], "k int, category string, weight double, score double")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "category string")
    with pytest.raises(ValueError, match="over 2"):
        scorecard.categories(scored, "k", names)
    assert scorecard.categories(scored, "k", names.limit(2)).count() == 2


def test_clip_summaries(spark):
    counts = (4, 4, 2, 2, 2, 1)
    rows = [("x", *counts, [0.1, 0.3, 5.0]), ("x", *counts, [0.2]), (None, *counts, []), ("y", *counts, None), (None, *counts, [9.0, 1.0])]
    schema = "game string, truth_bounces int, found_bounces int, matched_bounces int, truth_hits int, found_hits int, matched_hits int, errors array<double>"
    got = sorted((r.game or "", r.clips, r.median_error, r.gross, r.errors) for r in evaluation.summarize(spark.createDataFrame(rows, schema), "game").collect())
    assert got == sorted([("x", 2, 0.2, 1, 4), ("y", 1, None, 0, 0), ("", 2, 1.0, 1, 2), ("", 5, 0.25, 2, 6)])
