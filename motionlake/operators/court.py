"""Court geometry: zones, line calls with three values, landing summaries, camera stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionlake.functions import normal_cdf, over, ratio

#: Metres of a tennis court, and the number of deviations of a sure call.
SERVICE_LINE, HALF_LENGTH, SINGLES_HALF, DOUBLES_HALF, CENTRE_HALF = 6.40, 11.885, 4.115, 5.485, 0.025
DEEP_EDGE = (SERVICE_LINE + HALF_LENGTH) / 2
CALL_Z, PATCH_M = 1.96, 0.02
STABLE_P95, SHAKY_P95, MIN_FEATURES, MIN_SAMPLES = 0.001, 0.003, 30.0, 2
#: Fixed values of a bump: shares of the frame's long side, and seconds.
BUMP, SETTLE, BUMP_S, SETTLE_IN_S, TICK_S = 0.002, 0.001, 1.0, 1.0, 0.05
DEPTH_ZONES, WIDTH_ZONES, VERDICTS = ("short", "mid", "deep", "beyond"), ("left", "centre", "right"), ("in", "out", "too_close")


def half(y: Column) -> Column:
    return F.when(y < 0, "near").otherwise("far")


def depth_zone(d: Column) -> Column:
    """Zone of a distance from the net; edges belong to the zone nearer to it."""
    return F.when(d <= SERVICE_LINE, "short").when(d <= DEEP_EDGE, "mid").when(d <= HALF_LENGTH, "deep").otherwise("beyond")


def width_zone(x: Column) -> Column:
    """Third of the singles court; inner edges are centre."""
    third = 2 * SINGLES_HALF / 3
    return F.when(x < -third / 2, "left").when(x <= third / 2, "centre").otherwise("right")


def service_boxes(spark: SparkSession) -> DataFrame:
    """(end, side, x0, x1, y0, y1): the four boxes, the centre line belonging to both of its sides."""
    rows = [
        (end, side, -SINGLES_HALF if left else -CENTRE_HALF, CENTRE_HALF if left else SINGLES_HALF, -SERVICE_LINE if end == "near" else 0.0, 0.0 if end == "near" else SERVICE_LINE)
        for end in ("near", "far")
        for side, left in (("deuce", end == "far"), ("ad", end == "near"))
    ]
    return spark.createDataFrame(rows, "end string, side string, x0 double, x1 double, y0 double, y1 double")


def homography(h: list[float] | tuple, x: Column, y: Column) -> tuple[Column, Column]:
    """A point under the projective map with nine coefficients by row; null on the horizon."""
    w = F.nullif(h[6] * x + h[7] * y + h[8], F.lit(0.0))
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def jacobian(h: list[float] | tuple, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """Partial derivatives (dX/dx, dX/dy, dY/dx, dY/dy) of the projective map."""
    w = F.nullif(h[6] * x + h[7] * y + h[8], F.lit(0.0))
    p, q = homography(h, x, y)
    return (h[0] - h[6] * p) / w, (h[1] - h[7] * p) / w, (h[3] - h[6] * q) / w, (h[4] - h[7] * q) / w


def propagated(j: tuple, xx: Column, xy: Column, yy: Column) -> tuple[Column, Column, Column]:
    """Covariance (xx, xy, yy) carried through a map with the given derivatives."""
    a, b, c, d = j
    return a * a * xx + 2 * a * b * xy + b * b * yy, a * c * xx + (a * d + b * c) * xy + b * d * yy, c * c * xx + 2 * c * d * xy + d * d * yy


def ellipse(xx: Column, xy: Column, yy: Column, z: float = 1.0) -> tuple[Column, Column, Column]:
    """(major, minor, angle in degrees) of a covariance at z deviations."""
    mean, gap = (xx + yy) / 2, F.hypot((xx - yy) / 2, xy)
    return z * F.sqrt(F.greatest(mean + gap, F.lit(0.0))), z * F.sqrt(F.greatest(mean - gap, F.lit(0.0))), F.degrees(F.atan2(2 * xy, xx - yy)) / 2


def line_call(x: Column, y: Column, sx: Column, sy: Column, region: tuple, z: float = CALL_Z) -> tuple[Column, Column]:
    """(verdict, margin): in where every edge is cleared by z deviations, out where one is missed by as much.

    ``region`` is (x0, x1, y0, y1); the ball's patch may touch a line from outside.
    """
    x0, x1, y0, y1 = region
    edges = [(x - x0, sx), (x1 - x, sx), (y - y0, sy), (y1 - y, sy)]
    edges = [(d + PATCH_M, s) for d, s in edges]
    inside, outside = None, None
    for d, s in edges:
        inside = d >= z * s if inside is None else inside & (d >= z * s)
        outside = d < -z * s if outside is None else outside | (d < -z * s)
    return F.when(outside, "out").when(inside, "in").otherwise("too_close"), F.least(*(d for d, _ in edges))


def depth_probabilities(d: Column, sigma: Column) -> dict[str, Column]:
    """Chance of each depth zone; all on one zone without deviation."""
    cuts = [SERVICE_LINE, DEEP_EDGE, HALF_LENGTH]
    below = [F.when(sigma > 0, normal_cdf((F.lit(c) - d) / F.nullif(sigma, F.lit(0.0)))).otherwise((d <= c).cast("double")) for c in cuts]
    return {"short": below[0], "mid": below[1] - below[0], "deep": below[2] - below[1], "beyond": 1.0 - below[2]}


def depth_confident(d: Column, sigma: Column, z: float = CALL_Z) -> Column:
    """Whether the zone stays the same z deviations either way."""
    return depth_zone(d - z * sigma) == depth_zone(d + z * sigma)


def shot_map(landings: DataFrame, key: str, zone: str, zones: DataFrame) -> DataFrame:
    """(key, zone, n): counts of each zone of a fixed list, those with none too."""
    grid = landings.select(key).distinct().join(F.broadcast(zones), F.lit(True))  # a fixed handful of zones
    return grid.join(landings.groupBy(key, zone).agg(F.count(F.lit(1)).alias("n")), [key, zone], "left").select(key, zone, F.coalesce("n", F.lit(0)).alias("n"))


def filter_landings(landings: DataFrame, **wanted) -> DataFrame:
    """Landings that match every given value; None filters nothing."""
    for column, value in wanted.items():
        if value is not None:
            landings = landings.where(F.col(column) == value)
    return landings


def bumps(samples: DataFrame, key: str, time: str, dx: str, dy: str, long_edge: float) -> DataFrame:
    """(key, bumped_at): when the camera was first moved for good.

    An excursion is a run of samples at least BUMP of the frame's long side away from the first one, for
    BUMP_S seconds or more.  It counts if it settles: within SETTLE_IN_S of its start a window of BUMP_S
    begins in which no sample is further than SETTLE from the window's median.
    """
    far = F.hypot(F.col(dx), F.col(dy)) >= BUMP * long_edge
    w = over(key, time)
    d = samples.select(key, time, dx, dy, far.alias("far"), F.round(F.col(time) * 1e6).cast("long").alias("__us"))
    fresh = (F.col("far") != F.lag("far").over(w)).cast("int")
    d = d.withColumn("run", F.coalesce(F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).where("far")
    island = Window.partitionBy(key, "run")
    second = island.orderBy("__us").rangeBetween(0, round(1e6 * (BUMP_S + TICK_S)))
    middle = lambda a: (lambda s, n: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)(F.array_sort(a), F.size(a))
    d = d.withColumn("start", F.min(time).over(island)).withColumn("end", F.max(time).over(island)).withColumn("last", F.max(time).over(second))
    d = d.withColumn("xs", F.collect_list(dx).over(second)).withColumn("ys", F.collect_list(dy).over(second))
    d = d.withColumn("mx", middle(F.col("xs"))).withColumn("my", middle(F.col("ys")))
    spread = F.array_max(F.zip_with("xs", "ys", lambda x, y: F.hypot(x - F.col("mx"), y - F.col("my"))))
    settled = (F.col("last") - F.col(time) >= BUMP_S - TICK_S) & (F.col(time) <= F.col("start") + SETTLE_IN_S + TICK_S) & (spread <= SETTLE * long_edge)
    return d.where((F.col("end") - F.col("start") >= BUMP_S - TICK_S) & settled).groupBy(key).agg(F.min("start").alias("bumped_at"))


def camera_stability(samples: DataFrame, key: str, time: str, dx: str, dy: str, features: str, long_edge: float) -> DataFrame:
    """(key, samples, verdict, p95_fraction, rms, bumped_at): how far the camera moved for 95 % of the samples before a bump.

    Samples whose shift or time is not finite count for the number of samples and the median of features
    alone.  With too few features or samples, or a bump right at the start, nothing is known.
    """
    ok = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    good = samples.where(ok(F.col(time).cast("double")) & ok(F.col(dx)) & ok(F.col(dy)))
    base = samples.groupBy(key).agg(F.count(F.lit(1)).alias("samples"), F.median(features).alias("features"))
    d = good.join(bumps(good, key, time, dx, dy, long_edge), key, "left")
    size, before = F.hypot(F.col(dx), F.col(dy)), F.col("bumped_at").isNull() | (F.col(time) < F.col("bumped_at"))
    kept = F.when(before, size)
    per = d.groupBy(key).agg((F.percentile(kept, 0.95) / long_edge).alias("p"), F.sqrt(F.avg(kept * kept)).alias("r"), F.count(kept).alias("n"), F.max("bumped_at").alias("at"))
    j = base.join(per, key, "left")
    known = (F.col("features") >= MIN_FEATURES) & (F.coalesce("n", F.lit(0)) >= MIN_SAMPLES)
    verdict = F.when(F.col("p") <= STABLE_P95, "stable").when(F.col("p") <= SHAKY_P95, "shaky").otherwise("moving")
    only = lambda c, v: F.when(known, v).alias(c)
    return j.select(key, "samples", F.when(known, verdict).otherwise("unknown").alias("verdict"), only("p95_fraction", F.col("p")), only("rms", F.col("r")), only("bumped_at", F.col("at")))


def sampler(df: DataFrame, key: str, time: str, interval: float, row_id: str) -> DataFrame:
    """First row of each interval of time."""
    d = df.withColumn("__b", F.floor(F.col(time) / interval))
    return d.withColumn("__r", F.row_number().over(over([key, "__b"], time, row_id))).where("__r = 1").drop("__b", "__r")


def fps(df: DataFrame, key: str, time: str) -> DataFrame:
    """(key, fps): one over the median time between rows."""
    d = df.withColumn("__d", F.col(time) - F.lag(time).over(over(key, time)))
    return d.groupBy(key).agg(ratio(F.lit(1.0), F.median("__d")).alias("fps"))


def out_then_played(events: DataFrame, key: str, order: str, kind: str, half_: str, verdict: str, within: float = 1.5) -> DataFrame:
    """Bounces called out after which the next contact is a bounce in the other half, soon."""
    w = over(key, order)
    d = events.where(F.col(kind).isin("hit", "bounce"))
    for c in (kind, half_, order):
        d = d.withColumn(f"__{c}", F.lead(c).over(w))
    keep = (F.col(kind) == "bounce") & (F.col(verdict) == "out") & (F.col(f"__{kind}") == "bounce") & (F.col(f"__{half_}") != F.col(half_)) & (F.col(f"__{order}") - F.col(order) <= within)
    return d.where(keep).select(*events.columns)
