"""Column functions shared by the operators; all of them stay inside Catalyst."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """The value, with NaN and infinities as null: Spark's aggregates would keep them."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def ratio(a, b) -> Column:
    """a / b, null where b is 0 or null."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def half_even(c, digits: int) -> Column:
    """Rounded with ties to the even digit."""
    return F.bround(col(c), digits)


def seconds(ts) -> Column:
    """A timestamp as seconds since the epoch, with its fraction; without a zone, whatever the session's."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(ts).cast("timestamp_ntz")) / F.lit(1e6)


def clip(c, low, high) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def over(keys, *order):
    """A window of all rows of a key, in order."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys).orderBy(*order)


def running(keys, *order):
    """A window from the first row of a key to the current one."""
    return over(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(keys):
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys)


def angle_deg(ax, ay, bx, by) -> Column:
    """Angle between two vectors, 0 to 180 degrees; null where one of them is zero."""
    dot = col(ax) * col(bx) + col(ay) * col(by)
    size = F.hypot(col(ax), col(ay)) * F.hypot(col(bx), col(by))
    return F.degrees(F.acos(clip(ratio(dot, size), -1.0, 1.0)))


def wrapped_deg(c) -> Column:
    """An angle brought to -180 up to 180 degrees."""
    return F.pmod(col(c) + 180.0, F.lit(360.0)) - 180.0


def normal_cdf(z) -> Column:
    """Standard normal distribution function, by a rational approximation with an error below 7.5e-8."""
    z = col(z)
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    # Abramowitz and Stegun 26.2.17.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-z * z / 2.0) * poly
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the folder in spark.checkpoint.dir, where lineage ends.

    Where that is unset, only a local master gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or f"file://{tempfile.mkdtemp(prefix='checkpoints-')}")
    return df.checkpoint()
