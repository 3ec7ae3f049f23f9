"""Dashboard numbers: trends, versions that may be compared, mixes, percents, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import col, over, running, whole


def direction(delta: Column, steady: float = 2.0) -> Column:
    return F.when(delta.isNull(), "unknown").when(F.abs(delta) < steady, "steady").when(delta > 0, "improving").otherwise("declining")


def trend(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, measured, earliest, latest, delta, direction) of the values that are there; delta needs two."""
    at = F.when(F.col(value).isNotNull(), F.col(order))
    out = df.groupBy(*keys).agg(F.count(value).alias("measured"), F.min_by(value, at).alias("earliest"), F.max_by(value, at).alias("latest"))
    out = out.withColumn("delta", F.when(F.col("measured") >= 2, F.col("latest") - F.col("earliest")))
    return out.withColumn("direction", direction(F.col("delta")))


def spread_band(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, spread, deviation, band): range and population deviation of two values or more."""
    two = F.count(value) >= 2
    out = df.groupBy(key).agg(F.when(two, F.max(value) - F.min(value)).alias("spread"), F.when(two, F.stddev_pop(value)).alias("deviation"))
    return out.withColumn("band", F.when(F.col("spread") < 8, "tight").when(F.col("spread") <= 20, "moderate").when(F.col("spread").isNotNull(), "wide"))


def version_boundaries(df: DataFrame, key: str, order: str, version: str) -> DataFrame:
    """Rows whose version is another than the previous one's; null is a version like others."""
    w = over(key, order)
    d = df.withColumn("idx", F.row_number().over(w) - 1).withColumn("__p", F.lag(version).over(w))
    return d.where((F.col("idx") > 0) & ~F.col(version).eqNullSafe(F.col("__p"))).drop("__p")


def comparable(df: DataFrame, key: str, order: str, version: str) -> DataFrame:
    """Rows of the version that the newest row of their key has."""
    newest = F.max_by(F.struct(version), F.col(order)).over(whole(key))
    return df.withColumn("__n", newest[version]).where(F.col(version).eqNullSafe(F.col("__n"))).drop("__n")


def latest_delta(df: DataFrame, key: str, order: str, version: str, value: str) -> DataFrame:
    """(key, delta): newest value less the one before, if both are there and of one version."""
    w = over(key, F.desc(order))
    d = df.withColumn("rn", F.row_number().over(w)).withColumn("pv", F.lead(version).over(w)).withColumn("px", F.lead(value).over(w)).where("rn = 1")
    return d.select(key, F.when(F.col(version).eqNullSafe(F.col("pv")), F.col(value) - F.col("px")).alias("delta"))


def best_and_average(df: DataFrame, key: str, order: str, version: str, value: str, speed: str) -> DataFrame:
    """(key, best, average, top_speed): scores within the newest version, speed over all rows."""
    scores = comparable(df, key, order, version).groupBy(key).agg(F.max(value).alias("best"), F.avg(value).alias("average"))
    return scores.join(df.groupBy(key).agg(F.max(speed).alias("top_speed")), key)


def focus(trends: DataFrame, key: str, name: str) -> DataFrame:
    """(key, focus): the part with the lowest latest value, the first by name of equals."""
    return trends.where("latest is not null").groupBy(key).agg(F.min(F.struct("latest", name)).alias("m")).select(key, F.col(f"m.{name}").alias("focus"))


def mix_slices(df: DataFrame, key: str, kind: str, most: int = 4) -> DataFrame:
    """(key, slice, n): the commonest kinds; if more than one is left over, these fold into Other."""
    c = df.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("rn", F.row_number().over(over(key, F.desc("n"), kind))).withColumn("kinds", F.count(F.lit(1)).over(whole(key)))
    fold = (F.col("rn") > most) & (F.col("kinds") > most + 1)
    return c.withColumn("slice", F.when(fold, "Other").otherwise(F.col(kind))).groupBy(key, "slice").agg(F.sum("n").alias("n"))


def whole_percents(df: DataFrame, key: str, name: str, count: str) -> DataFrame:
    """(key, name, percent): whole percents by the largest remainder, equal counts always alike.

    Points left over from rounding down go to the counts with the largest remainders; counts that
    are equal get one each or none, so a total of 99 or less may remain.
    """
    total = F.sum(count).over(whole(key))
    base = df.withColumn("floor", F.coalesce(F.floor(100 * F.col(count) / F.nullif(total, F.lit(0))), F.lit(0)).cast("long"))
    base = base.withColumn("rest", F.coalesce((100 * F.col(count)) % F.nullif(total, F.lit(0)), F.lit(0)))
    ties = base.groupBy(key, count).agg(F.first("rest").alias("rest"), F.first("floor").alias("floor"), F.count(F.lit(1)).alias("ties"))
    shares = ties.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("rest")).alias("neg"), (-F.col(count)).alias("size"), "ties"))).alias("a"), (100 - F.sum(F.col("floor") * F.col("ties"))).alias("left"), F.sum(F.col(count) * F.col("ties")).alias("sum")
    )
    # the budget falls as groups of equals are served whole; one that does not fit is passed over
    fold = "aggregate(a, named_struct('left', left, 'won', cast(array() as array<bigint>)), (s, x) -> if(x.ties <= s.left and x.neg < 0, named_struct('left', s.left - x.ties, 'won', concat(s.won, array(-x.size))), s)).won"
    won = shares.select(key, F.expr(fold).alias("won"), "sum")
    return base.join(won, key).select(key, name, (F.col("floor") + F.when(F.array_contains("won", F.col(count).cast("long")) & (F.col("sum") > 0), 1).otherwise(0)).alias("percent"))


def detail_ids(df: DataFrame, key: str, row_id: str, kind: str, order: str, recent: int = 6, per_kind: int = 3, budget: int = 12) -> DataFrame:
    """(key, id): the newest rows and the newest of each kind, dealt in turns, each once, within a budget."""
    d = df.withColumn("nr", F.row_number().over(over(key, F.desc(order), F.desc(row_id)))).withColumn("nk", F.row_number().over(over([key, kind], F.desc(order), F.desc(row_id))))
    d = d.withColumn("turn", F.when(F.col("nr") <= recent, F.col("nr")).otherwise(recent + F.col("nk"))).where((F.col("nr") <= recent) | (F.col("nk") <= per_kind))
    d = d.withColumn("place", F.row_number().over(over(key, "turn", "nr")))
    return d.where(F.col("place") <= budget).select(key, F.col(row_id).alias("id"), "place")


def comparison(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, newest, earlier_mean, delta): the newest value against the mean of all earlier ones."""
    d = df.where(F.col(value).isNotNull())
    before = over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("earlier_mean", F.avg(value).over(before)).withColumn("rn", F.row_number().over(over(keys, F.desc(order)))).where("rn = 1")
    return d.select(*keys, F.col(value).alias("newest"), "earlier_mean", (F.col(value) - F.col("earlier_mean")).alias("delta"))


def not_recorded(df: DataFrame, keys: DataFrame, key: str, kind: str, kinds: DataFrame) -> DataFrame:
    """(key, kind): kinds of a fixed list that a key never has."""
    grid = keys.join(F.broadcast(kinds), F.lit(True))  # a fixed handful of kinds
    return grid.join(df.select(key, kind).distinct(), [key, kind], "left_anti")


def category_series(df: DataFrame, key: str, order: str, kinds: list[str], kind: str, value: str) -> DataFrame:
    """One column for each kind, a row for each key and time: null where it was not measured."""
    return df.groupBy(key, order).pivot(kind, kinds).agg(F.max(value))


def running_best(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``record``: whether the row beats all earlier ones of its key."""
    before = F.max(value).over(over(key, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("record", F.coalesce(F.col(value) > before, F.col(value).isNotNull()))


def coverage(df: DataFrame, key: str, available: str, total: str) -> DataFrame:
    """(key, ratio, has_gaps) of parts that could be measured; null without parts."""
    out = df.groupBy(key).agg(F.sum(available).alias("available"), F.sum(total).alias("total"))
    return out.select(key, (F.col("available") / F.nullif(F.col("total"), F.lit(0))).alias("ratio"), (F.col("available") < F.col("total")).alias("has_gaps"))


def key_numbers(scored: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(key, rank, metric): off target first (worst first), then in range (best first), then unmeasured."""
    off = F.col("verdict").isin("low", "high")
    group = F.when(off, 0).when(F.col("verdict") == "ideal", 1).otherwise(2)
    w = over(key, group, F.when(off, F.col("score")).otherwise(-F.col("score")), "metric")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(key, "rank", "metric")


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many or f"{one}s"))


def short_date(ts) -> Column:
    return F.date_format(col(ts), "d MMM")


def seen_so_far(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``n_so_far``: measured rows up to the current one."""
    return df.withColumn("n_so_far", F.count(value).over(running(key, order)))


def score_axis(values: Column, least_span: float = 20.0) -> Column:
    """(min, max, step) of an axis from 0 to 100 for an array of scores: whole tens around them.

    It grows downwards, then upwards, by ten until it spans ``least_span`` or everything; an empty
    array has the whole scale in quarters.
    """
    shown = F.filter(values, lambda v: v.isNotNull())
    lo = (F.floor(F.array_min(shown) / 10) * 10).cast("double")
    hi = (F.ceil(F.array_max(shown) / 10) * 10).cast("double")
    start = F.struct(lo.alias("lo"), (hi + F.when(hi == lo, 10.0).otherwise(0.0)).alias("hi"))

    def grow(s, _):
        short = (s["hi"] - s["lo"] < least_span) & ((s["lo"] > 0) | (s["hi"] < 100))
        lower = F.when(short & (s["lo"] > 0), s["lo"] - 10.0).otherwise(s["lo"])
        higher = F.when(short & (s["hi"] - lower < least_span) & (s["hi"] < 100), s["hi"] + 10.0).otherwise(s["hi"])
        return F.struct(lower.alias("lo"), higher.alias("hi"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, grow)
    low, high = (F.least(F.greatest(end[c], F.lit(0.0)), F.lit(100.0)) for c in ("lo", "hi"))
    axis = F.struct(low.alias("min"), high.alias("max"), F.when(high - low > 40, 20.0).otherwise(10.0).alias("step"))
    return F.when(F.size(shown) > 0, axis).otherwise(F.struct(F.lit(0.0).alias("min"), F.lit(100.0).alias("max"), F.lit(25.0).alias("step")))


def version_at(versions: Column, index: Column) -> Column:
    """The version of a place in an array, null beyond it."""
    return F.get(versions, index)


def band_side(value: Column, low: Column, high: Column) -> Column:
    """-1 below a band, 1 above it, else 0."""
    return F.when(F.coalesce(value < low, F.lit(False)), -1).when(F.coalesce(value > high, F.lit(False)), 1).otherwise(0)


def shown_value(value: Column, low: Column, high: Column, decimals: Column) -> Column:
    """A value with the fewest decimals, from ``decimals`` up to two, that leave it on its side of the band."""
    side = band_side(value, low, high)
    text = F.format_string("%.2f", value)
    for d in (2, 1, 0):
        rounded = F.round(value, d)
        text = F.when((decimals <= d) & (band_side(rounded, low, high) == side), F.format_string(f"%.{d}f", rounded)).otherwise(text)
    return text


def shown_bound(value: Column) -> Column:
    """A bound of a band: whole where it is whole, else with one decimal."""
    return F.when(value == F.round(value), F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", F.round(value, 1)))


def far_outside(value: Column, low: Column, high: Column, widths: float = 1.0) -> Column:
    """Whether a value is outside its band by ``widths`` times the band's width at least."""
    outside = F.when(value < low, low - value).when(value > high, value - high).otherwise(0.0)
    return F.coalesce((high > low) & (outside >= (high - low) * widths), F.lit(False))


def advice(metrics: DataFrame, rules: DataFrame, unscored: tuple[str, ...] = (), widths: float = 1.0) -> DataFrame:
    """Adds ``advice`` and ``is_praise`` to rows metric, value, low, high, verdict; null where nothing is to be said.

    ``rules`` has for each metric the sentences below_near, below_far, in_range, above_near, above_far.  The
    path's angle has two rules, the second under ``swing_path_angle_deg:slice`` for bands that are not above flat;
    across flat there is none, nor for a path beyond a right angle, whose way is not known.
    """
    path = F.col("metric") == "swing_path_angle_deg"
    flat = path & (F.col("low").isNull() | F.col("high").isNull() | ((F.col("low") < 0) & (F.col("high") > 0)))
    key = F.when(flat, F.lit(None)).when(path & (F.col("low") < 0), "swing_path_angle_deg:slice").otherwise(F.col("metric"))
    said = ("below_near", "below_far", "in_range", "above_near", "above_far")
    d = metrics.withColumn("__rule", key).join(rules.select(F.col("metric").alias("__rule"), *(F.col(c).alias(f"__{c}") for c in said)), "__rule", "left")
    far = far_outside(F.col("value"), F.col("low"), F.col("high"), widths)
    lost = path & (F.abs("value") > 90)
    text = (
        F.when(F.col("value").isNull() | F.col("metric").isin(*unscored), F.lit(None).cast("string"))
        .when(F.col("verdict") == "ideal", F.col("__in_range"))
        .when(lost, F.lit(None))
        .when(F.col("verdict") == "low", F.when(far, F.col("__below_far")).otherwise(F.col("__below_near")))
        .when(F.col("verdict") == "high", F.when(far, F.col("__above_far")).otherwise(F.col("__above_near")))
    )
    return d.withColumn("advice", text).withColumn("is_praise", F.col("verdict") == "ideal").drop("__rule", *(f"__{c}" for c in said))


def advice_bullets(advised: DataFrame, key: str, rank: str, most_praise: int, most_fixes: int | None = None) -> DataFrame:
    """(key, place, metric, advice, is_praise): what to change first, in the order of ``rank``, then what is good."""
    own = F.row_number().over(over([key, "is_praise"], rank))
    most = F.when(F.col("is_praise"), F.lit(most_praise)).otherwise(F.lit(most_fixes if most_fixes is not None else 1 << 30))
    d = advised.where(F.col("advice").isNotNull()).withColumn("__n", own).where(F.col("__n") <= most)
    place = F.row_number().over(over(key, F.col("is_praise").cast("int"), "__n"))
    return d.select(key, place.alias("place"), "metric", "advice", "is_praise")


def skill_profile(categories: DataFrame, key: str, shot: str, previous: DataFrame) -> DataFrame:
    """(key, category, current, previous): an axis for each category of an analysis, over that of a previous one.

    ``categories`` and ``previous`` have rows key, shot, category, score; ``previous`` names under the key the
    other analysis' scores.  It counts if it is of the same shot and has three scores at least on these axes.
    """
    before = previous.select(key, F.col(shot).alias("__shot"), "category", F.col("score").alias("previous"))
    d = categories.join(before, [key, "category"], "left").withColumn("previous", F.when(F.col("__shot") == F.col(shot), F.col("previous")))
    drawn = F.count("previous").over(whole(key)) >= 3
    return d.select(key, "category", F.col("score").alias("current"), F.when(drawn, F.col("previous")).alias("previous"))


def insights(sessions: DataFrame, user: str, shot: str, at: str, version: str, score: str, speed: str) -> DataFrame:
    """(user, shot, sessions, versions, score_points, speed_points, dates, comparable): the series of each shot, oldest first.

    ``comparable`` counts the sessions of the newest one's version, the only ones that categories are compared over.
    """
    d = sessions.groupBy(user, shot).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(version).alias("v"), F.col(score).alias("s"), F.col(speed).alias("m")))).alias("r"))
    newest = F.element_at("r", -1)["v"]
    return d.select(
        user, shot, F.size("r").alias("sessions"), F.col("r.v").alias("versions"), F.col("r.s").alias("score_points"), F.col("r.m").alias("speed_points"), F.col("r.at").alias("dates"),
        F.size(F.filter("r", lambda x: x["v"].eqNullSafe(newest))).alias("comparable"),
    )
