"""Evaluation of detections against labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_times(truth: DataFrame, found: DataFrame, key: str, time: str, tolerance: float) -> DataFrame:
    """(key, matched, missed, extra): one-to-one matching in time, nearest pairs first, per key."""
    kinds = dict(truth.dtypes)

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = sorted(a[time]), sorted(b[time])
        near, j = [], 0
        for i, t in enumerate(x):
            while j < len(y) and y[j] < t - tolerance:
                j += 1
            k = j
            while k < len(y) and y[k] <= t + tolerance:
                near.append((abs(y[k] - t), i, k))
                k += 1
        left, right = set(), set()
        for _, i, k in sorted(near):
            if i not in left and k not in right:
                left.add(i)
                right.add(k)
        name = (a if len(a) else b)[key].iloc[0]
        return pd.DataFrame([(name, len(left), len(x) - len(left), len(y) - len(right))], columns=[key, "matched", "missed", "extra"])

    return truth.select(key, time).groupBy(key).cogroup(found.select(key, time).groupBy(key)).applyInPandas(pair, f"`{key}` {kinds[key]}, matched long, missed long, extra long")


def recall_precision(matches: DataFrame) -> DataFrame:
    m, s, e = F.sum("matched"), F.sum("missed"), F.sum("extra")
    return matches.agg((m / F.nullif(m + s, F.lit(0))).alias("recall"), (m / F.nullif(m + e, F.lit(0))).alias("precision"))


def frame_recall(truth: DataFrame, found: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(recall): share of labelled places with a detection near, frame by frame."""
    near = truth.join(found.select(*keys, F.col("x").alias("fx"), F.col("y").alias("fy")), keys).where(F.hypot(F.col("x") - F.col("fx"), F.col("y") - F.col("fy")) <= tolerance).select(*keys, "x", "y").distinct()
    return truth.join(near.withColumn("hit", F.lit(1)), [*keys, "x", "y"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def call_scores(df: DataFrame) -> DataFrame:
    """(accuracy, confident_wrong_per_1000, coverage) of verdicts with margins and their radii."""
    sure = F.col("verdict") != "too_close"
    wrong = sure & ((F.col("verdict") == "in") != F.col("truth_in"))
    outside = F.abs("true_margin") > F.col("radius")
    return df.agg(
        F.avg(F.when(outside & sure, (~wrong).cast("double"))).alias("accuracy"),
        (1000.0 * F.count_if(wrong) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("confident_wrong_per_1000"),
        F.avg((F.abs(F.col("margin") - F.col("true_margin")) <= F.col("radius")).cast("double")).alias("coverage"),
    )


def length_scores(df: DataFrame) -> DataFrame:
    """(exact, within_one, in_range) shares of rally lengths."""
    share = lambda c: F.avg(c.cast("double"))
    gap = F.abs(F.col("estimate") - F.col("truth"))
    return df.agg(share(gap == 0).alias("exact"), share(gap <= 1).alias("within_one"), share(F.col("truth").between(F.col("least"), F.col("most"))).alias("in_range"))


def median_error(df: DataFrame) -> DataFrame:
    return df.agg(F.median(F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))).alias("median_error"))


def label_match(labels: DataFrame, candidates: DataFrame, frames: DataFrame, key: str, frame: str, scale: float, tolerance_px: float = 3.0) -> DataFrame:
    """(key, total, matched): visible labels (u, v) on evaluated frames, and those with a candidate (x, y) near enough.

    Distances are in the labels' pixels, of which a candidate's are ``scale`` each.
    """
    seen = labels.where("visible").join(frames.select(key, frame).distinct(), [key, frame]).withColumn("__label", F.monotonically_increasing_id())
    far = F.hypot(F.col("x") / scale - F.col("u"), F.col("y") / scale - F.col("v"))
    near = seen.join(candidates.select(key, frame, "x", "y"), [key, frame], "left").groupBy(key, frame, "u", "v", "__label").agg(F.min(far).alias("far"))
    return near.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("far") <= tolerance_px).alias("matched"))


def count_summary(per_frame: DataFrame, key: str, count: str) -> DataFrame:
    """(key, frames_evaluated, total, mean, median, p95, max) of counts of each evaluated frame."""
    c = F.col(count)
    return per_frame.groupBy(key).agg(
        F.count(c).alias("frames_evaluated"), F.coalesce(F.sum(c), F.lit(0)).alias("total"), F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3).alias("mean"),
        F.coalesce(F.percentile(c, 0.5), F.lit(0.0)).alias("median"), F.coalesce(F.percentile(c, 0.95), F.lit(0.0)).alias("p95"), F.coalesce(F.max(c), F.lit(0)).alias("max"),
    )


def summarize(clips: DataFrame, game: str, gross_m: float = 3.0) -> DataFrame:
    """(game, clips, recalls and precisions of bounces and hits, median_error, gross, errors): of each game and, under null, of all.

    ``clips``: truth_, found_ and matched_ bounces and hits, errors (array).  Errors from ``gross_m`` on are counted, not averaged.
    """
    share = lambda a, b: F.round(F.sum(a) / F.greatest(F.sum(b), F.lit(1)), 2)
    total = F.grouping(game).alias("__total")  # tells the row of all from that of clips without a game
    base = clips.rollup(game).agg(
        total, F.count(F.lit(1)).alias("clips"), share("matched_bounces", "truth_bounces").alias("bounce_recall"), share("matched_bounces", "found_bounces").alias("bounce_precision"),
        share("matched_hits", "truth_hits").alias("hit_recall"), share("matched_hits", "found_hits").alias("hit_precision"),
    )
    e = F.col("__e")
    each = clips.select(game, F.explode("errors").alias("__e")).rollup(game).agg(total, F.round(F.percentile(F.when(e < gross_m, e), 0.5), 2).alias("median_error"), F.count_if(e >= gross_m).alias("gross"), F.count(F.lit(1)).alias("errors"))
    each = each.withColumnsRenamed({game: "__game", "__total": "__all"})
    met = base.join(each, F.col(game).eqNullSafe(F.col("__game")) & (F.col("__total") == F.col("__all")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return met.select(game, "clips", "bounce_recall", "bounce_precision", "hit_recall", "hit_precision", "median_error", zero("gross"), zero("errors"))
