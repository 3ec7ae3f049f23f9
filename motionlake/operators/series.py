"""Frame-indexed series: runs, gap filling, smoothing, derivatives, peaks.

Every operator partitions by the series key and orders by frame, so a chain of them shares one
shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import col, over, ratio, running, whole

#: Longest gap that is interpolated, and the five-point quadratic smoother (over 35):
#: the middle of five rows, then the first and second of them; the mirror image ends a series.
MAX_GAP = 3
SMOOTH_MIDDLE = (-3, 12, 17, 12, -3)
SMOOTH_FIRST = (31, 9, -3, -5, 3)
SMOOTH_SECOND = (9, 13, 12, 6, -5)


def runs(df: DataFrame, key: str, order: str, flag) -> DataFrame:
    """Adds ``run`` (number of the run of equal flags within the key), and its length and bounds."""
    w = over(key, order)
    flag = col(flag)
    fresh = (~flag.eqNullSafe(F.lag(flag).over(w))) | (F.row_number().over(w) == 1)
    out = df.withColumn("pos", F.row_number().over(w) - 1).withColumn("run", F.sum(fresh.cast("int")).over(running(key, order)))
    r = Window.partitionBy(key, "run")
    return out.withColumn("run_start", F.min("pos").over(r)).withColumn("run_end", F.max("pos").over(r) + 1).withColumn("run_length", F.col("run_end") - F.col("run_start"))


def longest_run(df: DataFrame, key: str, order: str, flag) -> DataFrame:
    """(key, start, end) of the longest run where the flag holds, the earliest of equals; 0, 0 without one."""
    r = runs(df, key, order, flag).withColumn("on", F.coalesce(col(flag), F.lit(False)))
    best = F.max(F.when(F.col("on"), F.struct("run_length", (-F.col("run_start")).alias("neg"), "run_end")))
    out = r.groupBy(key).agg(best.alias("b"))
    return out.select(key, F.coalesce(-F.col("b.neg"), F.lit(0)).cast("long").alias("start"), F.coalesce("b.run_end", F.lit(0)).cast("long").alias("end"))


def longest_gap(df: DataFrame, key: str, order: str, flag) -> DataFrame:
    """(key, gap): length of the longest run without the flag, 0 where it always holds."""
    r = runs(df, key, order, flag)
    return r.groupBy(key).agg(F.coalesce(F.max(F.when(~col(flag), F.col("run_length"))), F.lit(0)).cast("long").alias("gap"))


def fill_linear(df: DataFrame, key: str, order: str, value: str, valid) -> DataFrame:
    """Adds ``filled``: the value where valid, else on the line between its valid neighbours by row.

    Before the first and after the last valid row that row's value holds; a key without valid rows
    keeps its values.
    """
    w = over(key, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = df.withColumn("pos", F.row_number().over(w))
    good = F.when(col(valid), F.struct("pos", F.col(value).alias("v")))
    d = d.withColumn("p", F.last(good, True).over(before)).withColumn("q", F.first(good, True).over(after))
    line = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("pos") - F.col("p.pos")) / F.nullif(F.col("q.pos") - F.col("p.pos"), F.lit(0))
    filled = F.when(col(valid), F.col(value)).otherwise(F.coalesce(line, "p.v", "q.v", F.col(value)))
    return d.withColumn("filled", filled).drop("p", "q")


def fill_short(df: DataFrame, key: str, order: str, value: str, valid, most: int = 3) -> DataFrame:
    """Adds ``filled``, as fill_linear, but on the line only across gaps of at most ``most`` rows.

    In a longer gap nothing is made up: its first half, less the middle row of an odd one, holds the
    value before it, the rest the value after it.
    """
    w = over(key, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = fill_linear(df, key, order, value, valid)
    good = F.when(col(valid), F.struct("pos", F.col(value).alias("v")))
    d = d.withColumn("p", F.last(good, True).over(before)).withColumn("q", F.first(good, True).over(after))
    gap = F.col("q.pos") - F.col("p.pos") - 1
    held = F.when(F.col("pos") - F.col("p.pos") <= F.floor(gap / 2), F.col("p.v")).otherwise(F.col("q.v"))
    return d.withColumn("filled", F.when(~col(valid) & (gap > most), held).otherwise(F.col("filled"))).drop("p", "q")


def smooth(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``smoothed``: the quadratic least-squares fit of five rows; shorter series stay as they are."""
    w = over(key, order)
    n, k = F.count(F.lit(1)).over(whole(key)), F.row_number().over(w)
    at = lambda j: F.lag(value, -j).over(w) if j < 0 else F.lead(value, j).over(w) if j else F.col(value)

    def fit(weights, offsets):
        total = None
        for c, j in zip(weights, offsets, strict=True):
            term = F.lit(float(c)) * at(j)
            total = term if total is None else total + term
        return total / 35.0

    d = df.withColumn("__n", n).withColumn("__k", k)
    d = d.withColumn(
        "smoothed",
        F.when(F.col("__n") < 5, F.col(value))
        .when(F.col("__k") == 1, fit(SMOOTH_FIRST, range(0, 5)))
        .when(F.col("__k") == 2, fit(SMOOTH_SECOND, range(-1, 4)))
        .when(F.col("__k") == F.col("__n"), fit(SMOOTH_FIRST, range(0, -5, -1)))
        .when(F.col("__k") == F.col("__n") - 1, fit(SMOOTH_SECOND, range(1, -4, -1)))
        .otherwise(fit(SMOOTH_MIDDLE, range(-2, 3))),
    )
    return d.drop("__n", "__k")


def central_difference(df: DataFrame, key: str, order: str, value: str, time) -> DataFrame:
    """Adds ``slope``: (next - previous) / (their times); one-sided at the ends, 0 where time stands still."""
    w, t = over(key, order), col(time)
    v0, v1 = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    t0, t1 = F.coalesce(F.lag(t).over(w), t), F.coalesce(F.lead(t).over(w), t)
    slope = F.coalesce(ratio(v1 - v0, t1 - t0), F.lit(0.0))
    return df.withColumn("slope", F.when(F.isnan(slope) | (F.abs(slope) == float("inf")), 0.0).otherwise(slope))


def path_length(df: DataFrame, key: str, order: str, x: str, y: str, visible) -> DataFrame:
    """(key, length): steps between adjacent rows of which both are visible."""
    w = over(key, order)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    d = df.withColumn("step", F.when(col(visible) & F.lag(col(visible)).over(w), step))
    return d.groupBy(key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def rolling_median(df: DataFrame, key: str, time: str, value: str, half_window: float) -> DataFrame:
    """Adds ``rolling``: exact median of the values within ``half_window`` of the row's time, ends included."""
    held = F.expr(f"array_sort(collect_list(`{value}`) over (partition by `{key}` order by `{time}` range between {half_window}D preceding and {half_window}D following))")
    d = df.withColumn("__s", held)
    n = F.size("__s")
    middle = (F.element_at("__s", F.floor((n + 1) / 2).cast("int")) + F.element_at("__s", F.floor(n / 2).cast("int") + 1)) / 2.0
    return d.withColumn("rolling", F.when(n > 0, middle)).drop("__s")


def local_maxima(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows that are higher than the one before and not lower than the one after; ends count one side."""
    w = over(key, order)
    d = df.withColumn("__p", F.lag(value).over(w)).withColumn("__n", F.lead(value).over(w))
    return d.where(f"(__p is null or `{value}` > __p) and (__n is null or `{value}` >= __n)").drop("__p", "__n")


def prominence(df: DataFrame, key: str, order: str, value: str, separation: int = 5, cap: float = 10.0) -> DataFrame:
    """(key, peak_pos, peak, prominence): the highest row over the highest local maximum some rows away.

    Without another maximum, or with one that is not positive, prominence is ``cap``.
    """
    d = df.withColumn("pos", F.row_number().over(over(key, order)) - 1)
    peak = d.groupBy(key).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("pos")).alias("neg"))).alias("b"))
    peak = peak.select(key, (-F.col("b.neg")).cast("long").alias("peak_pos"), F.col("b.v").alias("peak"))
    rival = local_maxima(d, key, "pos", value).join(peak, key).where(F.abs(F.col("pos") - F.col("peak_pos")) >= separation).groupBy(key).agg(F.max(value).alias("rival"))
    out = peak.join(rival, key, "left")
    return out.select(key, "peak_pos", "peak", F.when(F.col("rival") > 0, F.least(F.col("peak") / F.col("rival"), F.lit(cap))).otherwise(F.lit(cap)).alias("prominence"))


def suppress(df: DataFrame, key: str, order: str, value: str, separation: int, most: int | None = None) -> DataFrame:
    """(key, pos): greedy non-maximum suppression, highest first, the earlier of equals.

    The fold runs over one array for each series, whose length the session bounds.
    """
    d = df.withColumn("pos", (F.row_number().over(over(key, order)) - 1).cast("long"))
    ranked = local_maxima(d, key, "pos", value).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("neg"), "pos"))).alias("a"))
    full = f"size(acc) >= {most} or " if most else ""
    picked = F.expr(f"aggregate(a, cast(array() as array<bigint>), (acc, x) -> if({full}exists(acc, y -> abs(y - x.pos) < {separation}), acc, concat(acc, array(x.pos))))")
    return ranked.select(key, F.explode(picked).alias("pos"))


def monotone_ms(df: DataFrame, key: str, order: str, time) -> DataFrame:
    """Adds ``ms``: whole milliseconds that rise strictly, each at least one above the one before."""
    w = over(key, order)
    d = df.withColumn("__j", F.row_number().over(w) - 1)
    raw = F.bround(col(time) * 1000.0, 0).cast("long")
    return d.withColumn("ms", F.max(raw - F.col("__j")).over(running(key, order)) + F.col("__j")).drop("__j")


def segments(df: DataFrame, key: str, order: str, breaks) -> DataFrame:
    """Adds ``segment``, which counts the rows up to here at which a break lies."""
    return df.withColumn("segment", F.sum(F.coalesce(col(breaks), F.lit(False)).cast("int")).over(running(key, order)))
