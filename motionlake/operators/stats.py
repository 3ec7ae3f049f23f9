"""Session statistics over swing tables: robust spread, mix, consistency and trends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.functions import col, finite, over, ratio, whole

#: Scale of the median absolute deviation, and the row counts that gate labels.
MAD_SCALE, RANGE_N, LABEL_N, FULL_N = 1.4826, 5, 8, 20
TREND_MIN_N, TREND_MIN_SPAN_S, TREND_SD_FRACTION, TREND_SECONDS = 15, 300.0, 0.5, 600.0


def counted(swings: DataFrame) -> DataFrame:
    """Accepted swings that the user kept."""
    return swings.where("status = 'accepted' and not user_excluded")


def robust_spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median, mad, robust_sd): exact medians of the finite values, null for fewer than two.

    One shuffle: the median is exact and unframed, so both passes share the partitioning by key.
    """
    rows = df.select(key, finite(value).alias("v")).where("v is not null")
    rows = rows.withColumn("m", F.median("v").over(whole(key)))
    out = rows.groupBy(key).agg(F.count("v").alias("n"), F.first("m").alias("median"), F.median(F.abs(F.col("v") - F.col("m"))).alias("mad"))
    enough = F.col("n") >= 2
    return out.select(key, "n", F.when(enough, F.col("median")).alias("median"), F.when(enough, F.col("mad")).alias("mad"), F.when(enough, F.col("mad") * MAD_SCALE).alias("robust_sd"))


def shot_mix(df: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, kind, n, percent): share of each kind that a key has."""
    out = df.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(whole(key)))


def treatment(n):
    """How a spread over n values is shown."""
    n = col(n)
    return F.when(n < RANGE_N, "count").when(n < LABEL_N, "range").when(n < FULL_N, "label_with_n").otherwise("label")


def spread_label(sd, band_width):
    """tight, moderate or wide by the band's width; null without a usable band."""
    share = ratio(sd, band_width)
    return F.when(col(band_width) > 0, F.when(share <= 0.5, "tight").when(share <= 1.0, "moderate").otherwise("wide"))


def consistency(df: DataFrame, key: str, value: str, band_width: float) -> DataFrame:
    """Spread with range, variation and a label, each only where enough values support it."""
    ends = df.select(key, finite(value).alias("v")).groupBy(key).agg(F.min("v").alias("least"), F.max("v").alias("most"))
    out = robust_spread(df, key, value).join(ends, key)
    n = F.col("n")
    return out.select(
        key, "n", "median", "robust_sd", ratio("robust_sd", F.abs(F.col("median"))).alias("robust_cv"),
        F.when(n >= RANGE_N, F.col("least")).alias("least"), F.when(n >= RANGE_N, F.col("most")).alias("most"),
        treatment("n").alias("treatment"), F.when(n >= LABEL_N, spread_label("robust_sd", F.lit(band_width))).alias("label"),
    )


#: Pairs of rows whose slopes are listed; of more, the median is found by counting.
LISTED_PAIRS = 2_000_000


def _pairs_below(t: np.ndarray, v: np.ndarray, slope: float) -> int:
    """Pairs with t1 < t2 whose slope is at most ``slope``: inversions of v - slope * t, rows sorted by time.

    A merge sort from the bottom up; rows of one time never count, as they come in falling order of v.
    """
    x = v - slope * t
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((-np.arange(len(x)), x))] = np.arange(len(x))  # of equal values the later row is the lower
    total, width, n = 0, 1, len(x)
    while width < n:
        block = np.arange(n) // (2 * width)
        right = np.arange(n) // width % 2 == 1
        order = np.lexsort((rank, block))
        lefts = np.cumsum(~right[order])
        start = np.searchsorted(block, np.arange(block[-1] + 1))
        in_block = lefts - np.append(0, lefts)[start[block[order]]]
        size = np.bincount(block[~right], minlength=block[-1] + 1)[block[order]]
        total += int((size - in_block)[right[order]].sum())
        rank, width = rank[order], 2 * width
    return total


def _median_slope(t: np.ndarray, v: np.ndarray) -> float:
    """Median slope of all pairs of rows with different times; 0 without one."""
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    n = len(t)
    if n * (n - 1) // 2 <= LISTED_PAIRS:
        i, j = np.triu_indices(n, 1)
        apart = t[j] > t[i]
        return float(np.median((v[j[apart]] - v[i[apart]]) / (t[j[apart]] - t[i[apart]]))) if apart.any() else 0.0
    # equal times in an order in which they are never inverted, whatever the slope
    doubles = lambda counts: int((counts.astype(np.int64) * (counts - 1) // 2).sum())
    pairs = n * (n - 1) // 2 - doubles(np.unique(t, return_counts=True)[1])
    twins = doubles(np.unique(np.stack([t, v]), axis=1, return_counts=True)[1])  # equal rows count as inverted
    if not pairs:
        return 0.0
    steps = np.diff(t)
    limit = float((v.max() - v.min()) / steps[steps > 0].min())

    def smallest(k: int) -> float:
        lo, hi = -limit, limit
        while (mid := (lo + hi) / 2) not in (lo, hi) and hi - lo > 1e-13 * max(1.0, abs(lo), abs(hi)):
            lo, hi = (lo, mid) if _pairs_below(t, v, mid) - twins >= k else (mid, hi)
        return hi

    return (smallest((pairs + 1) // 2) + smallest(pairs // 2 + 1)) / 2


def _trend(t: np.ndarray, v: np.ndarray) -> tuple:
    """(n, span, first_median, last_median, slope, robust_sd) of the rows of one key."""
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    n = len(v)
    third = n // 3
    ends = [float(np.median(x)) if len(x) else None for x in (v[:third], v[n - third :])]
    spread = float(np.median(np.abs(v - np.median(v)))) * MAD_SCALE if n >= 2 else None
    return n, float(t[-1] - t[0]), *ends, _median_slope(t, v), spread


def _by_key(df: DataFrame, key: str, time: str, value: str, schema: str, of) -> DataFrame:
    """``of(t, v)`` for the rows with a time and a finite value of each key, in one shuffle."""
    kind = dict(df.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf[key].iloc[0], *of(pdf["t"].to_numpy(float), pdf["v"].to_numpy(float)))], columns=[key, *(x.split()[0] for x in schema.split(", "))])

    rows = df.select(key, col(time).cast("double").alias("t"), finite(value).cast("double").alias("v")).where("t is not null and v is not null")
    return rows.groupBy(key).applyInPandas(run, f"`{key}` {kind}, {schema}")


def theil_sen(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, slope): median slope of all pairs with different times, 0 where there is none.

    A key's rows are one group of two numbers each; up to LISTED_PAIRS slopes are listed, and of more
    the median is found by counting those below a bound, in n log n steps a bound, without listing any.
    """
    return _by_key(df, key, time, value, "slope double", lambda t, v: (_median_slope(t, v),))


def within_trend(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, n, first_median, last_median, slope, direction) of long sessions.

    Thirds of the rows in time order are compared; a direction needs half a robust deviation between
    their medians and a slope of the same sign.  Keys with too few rows or too short a span are left out.
    """
    schema = "n long, span double, first_median double, last_median double, slope double, robust_sd double"
    out = _by_key(df, key, time, value, schema, _trend).where((F.col("n") >= TREND_MIN_N) & (F.col("span") >= TREND_MIN_SPAN_S))
    gap, least = F.col("last_median") - F.col("first_median"), F.col("robust_sd") * TREND_SD_FRACTION
    direction = F.when((gap > least) & (F.col("slope") > 0), "rising").when((gap < -least) & (F.col("slope") < 0), "falling").otherwise("steady")
    return out.select(key, "n", "first_median", "last_median", (F.col("slope") * TREND_SECONDS).alias("slope"), direction.alias("direction"))


def between_trend(points: DataFrame, key: str, time: str, version: str, value: str, steady: float = 2.0) -> DataFrame:
    """(key, sessions, first, last, direction) over the rows of the newest version, two at least."""
    newest = F.max_by(version, time).over(whole(key))
    rows = points.withColumn("newest", newest).where(F.col(version).eqNullSafe(F.col("newest")))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("sessions"), F.min_by(value, time).alias("first_value"), F.max_by(value, time).alias("last_value")).where("sessions >= 2")
    gap = F.col("last_value") - F.col("first_value")
    return out.withColumn("direction", F.when(gap >= steady, "rising").when(gap <= -steady, "falling").otherwise("steady"))


def speed_summary(df: DataFrame, kind: str, speed: str) -> DataFrame:
    """(kind, measured, missing, median, fastest) of an optional measure."""
    v = finite(speed)
    return df.groupBy(kind).agg(F.count(v).alias("measured"), (F.count(F.lit(1)) - F.count(v)).alias("missing"), F.median(v).alias("median"), F.max(v).alias("fastest"))
