"""Band-based scorecards: metric scores, categories, overall, deviations and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import finite, half_even

#: Share of each category in the overall score, and categories it needs.
CATEGORY_WEIGHTS = {"preparation": 0.20, "contact": 0.30, "swing_path": 0.25, "balance": 0.15, "follow_through": 0.10}
MIN_CATEGORIES = 3
#: Categories that are spread out as columns of one aggregate.
MOST_CATEGORIES = 1000


def hard_bounds(bands: DataFrame) -> DataFrame:
    """Adds hard_min and hard_max: the ideal range widened by its own width, within what is physical."""
    width = F.col("ideal_max") - F.col("ideal_min")
    low, high = F.col("ideal_min") - width, F.col("ideal_max") + width
    return bands.withColumn("hard_min", F.coalesce(F.greatest(low, F.col("physical_min")), low)).withColumn("hard_max", F.coalesce(F.least(high, F.col("physical_max")), high))


def bands_for(bands: DataFrame, kinds: DataFrame, kind: str, fallback: str = "base") -> DataFrame:
    """The bands of each kind; a kind without any has those of ``fallback``."""
    own = kinds.join(bands, kind, "inner")
    missing = kinds.join(bands.select(kind).distinct(), kind, "left_anti")
    default = bands.where(F.col(kind) == fallback).drop(kind)  # one row for each metric
    return own.unionByName(missing.join(default, F.lit(True)))


def score(value: Column, lower_is_better: Column | None = None, band: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """(score, verdict) of a value against its band: the columns of that name, or those given.

    100 within the ideal range, 0 outside the hard one, on a straight line between; rounded to one
    digit with ties to even.  Where lower is better, nothing is too low.  Null and non-finite values
    have no score.
    """
    v = finite(value)
    at = lambda name: F.col(name) if band is None else band[name]
    lower = F.coalesce(lower_is_better, F.lit(False)) if lower_is_better is not None else F.lit(False)
    below = ~lower & (v < at("ideal_min"))
    above = v > at("ideal_max")
    fall = F.when(v >= at("hard_max"), 0.0).otherwise(100.0 * (at("hard_max") - v) / F.nullif(at("hard_max") - at("ideal_max"), F.lit(0.0)))
    rise = F.when(v <= at("hard_min"), 0.0).otherwise(100.0 * (v - at("hard_min")) / F.nullif(at("ideal_min") - at("hard_min"), F.lit(0.0)))
    points = F.when(v.isNull(), F.lit(None).cast("double")).when(below, rise).when(above, fall).otherwise(100.0)
    verdict = F.when(v.isNull(), "unavailable").when(below, "low").when(above, "high").otherwise("ideal")
    return half_even(points, 1), verdict


def card(df: DataFrame, metrics: list[str], bands: DataFrame, weights: dict[str, float] | None = None, least: int = MIN_CATEGORIES) -> DataFrame:
    """Adds ``scores`` (metric, category, value, score, verdict), ``categories`` (category, score, available, total) and ``overall``.

    All metrics of a row are columns of it, so nothing is shuffled: the bands, one for each metric, are
    read once and become constants of the expressions.  Every category of ``weights`` has an entry;
    weights are renormalised over what has a score.  Bands with several rows of a metric, as those of
    several kinds of shot together, are refused; a metric without a band is left out.
    """
    weights = weights or CATEGORY_WEIGHTS
    read = bands.where(F.col("metric").isin(*metrics)).limit(len(metrics) + 1).collect()
    found = {r.metric: r for r in read}
    if len(found) < len(read):
        raise ValueError("several bands for a metric: choose those of one kind first")
    rows, of = [], {c: [] for c in weights}
    for m in metrics:
        if (r := found.get(m)) is None:
            continue
        band = {c: F.lit(None if r[c] is None else float(r[c])).cast("double") for c in ("ideal_min", "ideal_max", "hard_min", "hard_max")}
        points, verdict = score(F.col(m).cast("double"), F.lit(bool(r.lower_is_better)), band)
        df = df.withColumn(f"__s_{m}", points)
        rows.append(F.struct(F.lit(m).alias("metric"), F.lit(r.category).alias("category"), F.col(m).cast("double").alias("value"), F.col(f"__s_{m}").alias("score"), verdict.alias("verdict")))
        of.setdefault(r.category, []).append((F.col(f"__s_{m}"), float(r.weight)))

    def mean(parts):
        total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0))
        return total / F.nullif(sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts), F.lit(0.0)), F.lit(0.0))

    for c in weights:
        df = df.withColumn(f"__c_{c}", half_even(mean(of[c]), 1) if of[c] else F.lit(None).cast("double"))
    count = lambda xs: sum((x.isNotNull().cast("long") for x in xs), F.lit(0).cast("long"))
    cats = [F.struct(F.lit(c).alias("category"), F.col(f"__c_{c}").alias("score"), count([s for s, _ in of[c]]).alias("available"), F.lit(len(of[c])).cast("long").alias("total")) for c in weights]
    whole = [(F.col(f"__c_{c}"), w) for c, w in weights.items()]
    overall_ = F.when(count([s for s, _ in whole]) >= least, half_even(F.round(mean(whole), 9), 1))
    df = df.withColumn("scores", F.array(*rows)).withColumn("categories", F.array(*cats)).withColumn("overall", overall_)
    return df.drop(*(f"__s_{m}" for m in metrics), *(f"__c_{c}" for c in weights))


def metric_scores(df: DataFrame, key: str, metrics: list[str], bands: DataFrame) -> DataFrame:
    """Metric columns as rows (key, metric, value) joined to their bands, with score and verdict."""
    rows = df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*(F.col(m).cast("double") for m in metrics)))).alias("metric", "value"))
    joined = rows.join(bands, "metric")
    points, verdict = score(F.col("value"), F.col("lower_is_better"))
    return joined.withColumn("score", points).withColumn("verdict", verdict)


def categories(scored: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """(key, category, score, available, total): weights renormalised over the metrics that have a score.

    ``names`` lists every category, so that one without metrics has a row too; more than MOST_CATEGORIES
    of them are refused.
    """
    has, cats = F.col("score").isNotNull(), [r[0] for r in names.limit(MOST_CATEGORIES + 1).collect()]
    if len(cats) > MOST_CATEGORIES:
        raise ValueError(f"over {MOST_CATEGORIES} categories")
    aggregates = []
    for k, c in enumerate(cats):
        own = F.col("category") == c
        raw = F.sum(F.when(own & has, F.col("weight") * F.col("score"))) / F.sum(F.when(own & has, F.col("weight")))
        aggregates.append(F.struct(F.lit(c).alias("category"), half_even(raw, 1).alias("score"), F.count(F.when(own, F.col("score"))).alias("available"), F.count_if(own).alias("total")).alias(f"c{k}"))
    # one shuffle by key, whatever the number of categories
    return scored.groupBy(key).agg(*aggregates).select(key, F.inline(F.array(*(f"c{k}" for k in range(len(cats))))))


def overall(cats: DataFrame, key: str, weights: dict[str, float] | None = None, least: int = MIN_CATEGORIES) -> DataFrame:
    """(key, overall): renormalised over the categories with a score, null for too few of them."""
    w = F.create_map(*(x for k, v in (weights or CATEGORY_WEIGHTS).items() for x in (F.lit(k), F.lit(v))))[F.col("category")]
    has = F.col("score").isNotNull()
    raw = F.sum(F.when(has, w * F.col("score"))) / F.sum(F.when(has, w))
    return cats.groupBy(key).agg(F.when(F.count("score") >= least, half_even(F.round(raw, 9), 1)).alias("overall"))


def deviations(scored: DataFrame, key: str) -> DataFrame:
    """Measured metrics outside their ideal range, with direction and distance."""
    out = scored.where("verdict in ('low', 'high')")
    far = F.when(F.col("verdict") == "low", F.col("ideal_min") - F.col("value")).otherwise(F.col("value") - F.col("ideal_max"))
    return out.select(key, "metric", "verdict", far.alias("distance"))


def priorities(scored: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, rank, metric): the worst metrics outside their range, then the heavier, then by name."""
    w = Window.partitionBy(key).orderBy("score", F.desc("weight"), "metric")
    return scored.where("verdict in ('low', 'high')").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(key, "rank", "metric", "score")


def coachable(scored: DataFrame, excluded: DataFrame) -> DataFrame:
    """Scores without those of excluded metrics."""
    return scored.join(excluded, "metric", "left_anti")


def metric_names_for(bands: DataFrame, kind: str, shot, category) -> DataFrame:
    """(metric) of a category that a kind of shot is scored by, in the order of ``place`` where the bands have one."""
    own = bands.where((F.col(kind) == shot) & (F.col("category") == category))
    return own.orderBy("place" if "place" in bands.columns else "metric").select("metric")


def flagged(metric: Column, names: tuple[str, ...]) -> Column:
    """Whether a metric is one of those, such as the view-sensitive ones."""
    return F.coalesce(metric.isin(*names), F.lit(False)) if names else F.lit(False)


def is_unscored_warning(warning: Column, flags: tuple[str, ...]) -> Column:
    """Whether a warning, up to its colon, is about a metric that is never scored."""
    return flagged(F.trim(F.substring_index(warning, ":", 1)), flags)


def reference_ranges(bands: DataFrame, kind: str, shot) -> DataFrame:
    """(metric, ideal_min, ideal_max, unit) that a shot's values are held against."""
    return bands.where(F.col(kind) == shot).select("metric", "ideal_min", "ideal_max", *(c for c in ("unit",) if c in bands.columns))
