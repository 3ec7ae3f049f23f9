"""Stored history: keyset pages, cursors, queue positions, stale jobs, last-seen marks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import col, cut, over, seconds


def pages(df: DataFrame, user: str, created: str, row_id: str, size: int) -> DataFrame:
    """The newest page of each user, with ``has_more`` and the cursor of its last row where there is more."""
    w = over(user, F.desc(created), F.desc(row_id))
    rows = df.withColumn("rn", F.row_number().over(w)).withColumn("later", F.lead(row_id).over(w)).where(F.col("rn") <= size)
    last = F.col("rn") == size
    return rows.withColumn("next_cursor", F.when(last & F.col("later").isNotNull(), encode_cursor(F.col(created), F.col(row_id)))).drop("later")


def page_after(df: DataFrame, user: str, created: str, row_id: str, who, after_created, after_id, size: int) -> DataFrame:
    """One user's page after a cursor: the row comparison keeps equal times apart, and top-k needs no full sort."""
    before = F.struct(F.col(created), F.col(row_id)) < F.struct(after_created, after_id)
    return df.where((F.col(user) == who) & before).orderBy(F.desc(created), F.desc(row_id)).limit(size)


def encode_cursor(created: Column, row_id: Column) -> Column:
    """Unpadded base64url of time|id."""
    text = F.concat_ws("|", F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), row_id.cast("string"))
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """(created, id) of a cursor; null parts for what is none."""
    plain = F.translate(cursor, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.char_length(plain) / 4) * 4).cast("int"), F.lit("="))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    parts = F.split(text, r"\|")
    good = F.size(parts) == 2
    return F.struct(F.when(good, F.try_to_timestamp(parts[0])).alias("created"), F.when(good, F.try_element_at(parts, F.lit(2))).alias("id"))


def queue_positions(jobs: DataFrame, created: str, active, shard: str | None = None) -> DataFrame:
    """Adds ``ahead``: active jobs created strictly earlier; equal times do not count.

    Counts per time are summed first.  Without a shard, times are dealt by range; each range sums its
    own, and what lies in the ranges before, a number for each of them, is added.
    """
    times = jobs.where(active).groupBy(*([shard] if shard else []), created).agg(F.count(F.lit(1)).alias("c"))
    before = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if shard:
        ahead = times.withColumn("ahead", before(over(shard, created))).drop("c")
        return jobs.where(active).join(ahead, [shard, created])
    ranged = cut(times.repartitionByRange(created).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum("c").alias("c"))
    starts = sums.select("__part", before(Window.partitionBy(F.lit(0)).orderBy("__part")).alias("__start"))  # a row for each range
    ahead = ranged.withColumn("ahead", before(over("__part", created))).join(starts, "__part").select(created, (F.col("ahead") + F.col("__start")).alias("ahead"))
    return jobs.where(active).join(ahead, created)


def is_stale(status: Column, heartbeat: Column, now: Column, after_s: float = 180.0) -> Column:
    """Running, with a heartbeat older than ``after_s``; one that never beat is not stale."""
    age = seconds(now) - seconds(heartbeat)
    return F.coalesce((status == "running") & (age > after_s), F.lit(False))


def orphans(children: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """Children without a parent."""
    return children.join(parents.select(on).distinct(), on, "left_anti")


def last_seen(opens: DataFrame, user: str, at: str, platform: str) -> DataFrame:
    """(user, last_opened_at, platform): newest open, and the newest platform that was given (32 characters)."""
    given = F.when(F.col(platform).isNotNull(), F.col(at))
    return opens.groupBy(user).agg(F.max(at).alias("last_opened_at"), F.substring(F.max_by(platform, given), 1, 32).alias("platform"))


def throttle(df: DataFrame, key: str, at_s: str, least_gap_s: float) -> DataFrame:
    """(key, at): the events that are recorded when each must follow the last recorded one by a gap.

    What is kept depends on what was kept before: rows are dealt by key and sorted, and each task
    folds over its stream with one time in hand.  Rows without a time are never recorded.
    """

    def fold(batches):
        last, held = object(), None
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fresh = k != last
                good = fresh or t - held >= least_gap_s
                if good:
                    last, held = k, t
                keep.append(good)
            yield batch.filter(pa.array(keep, pa.bool_()))

    times = df.select(key, F.col(at_s).cast("double").alias("at")).where("at is not null").repartition(key).sortWithinPartitions(key, "at")
    return times.mapInArrow(fold, times.schema)


def transition(jobs: DataFrame, changes: DataFrame, on: str, allowed: dict[str, tuple[str, ...]], order: str) -> DataFrame:
    """Jobs with the status that their changes lead to; a change counts only from a status that allows it."""
    steps = changes.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(order, "to"))).alias("steps"))
    rule = F.create_map(*(x for to, froms in allowed.items() for x in (F.lit(to), F.array(*map(F.lit, froms)))))
    joined = jobs.join(steps, on, "left").withColumn("__rule", rule)
    folded = F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), col("status"), lambda s, x: F.when(F.array_contains(F.coalesce(F.try_element_at(col("__rule"), x["to"]), F.array().cast("array<string>")), s), x["to"]).otherwise(s))
    return joined.withColumn("status", folded).drop("steps", "__rule")


def delete_user(parents: DataFrame, children: DataFrame, user: str, who) -> tuple[DataFrame, DataFrame]:
    """Both tables without a user's rows."""
    keep = lambda d: d.where(~F.col(user).eqNullSafe(who))
    return keep(parents), keep(children)


def json_median(df: DataFrame, payload: str, path: str, divisor: str) -> DataFrame:
    """Median over rows of one JSON number divided by another; rows without both, or with a zero divisor, do not count."""
    number = lambda p: F.get_json_object(F.col(payload), p).cast("double")
    v = number(path) / F.nullif(number(divisor), F.lit(0.0))
    return df.agg(F.median(v).alias("median"), F.count(v).alias("n"))


def own_row(df: DataFrame, row_id: str, user: str, wanted, who) -> DataFrame:
    """The row of an id, if it is the user's; at most one."""
    return df.where((F.col(row_id) == wanted) & (F.col(user) == who)).limit(1)


def count_by_status(jobs: DataFrame, status: str, statuses: tuple[str, ...]) -> DataFrame:
    """(n): how many jobs have one of the statuses; what a queue's depth and its admission check read."""
    return jobs.where(F.col(status).isin(*statuses)).agg(F.count(F.lit(1)).alias("n"))


def range_total(header: Column) -> Column:
    """The total in a range header such as 0-0/12; null where it has none."""
    return F.regexp_extract(header, r"^[^/]*/\s*([+-]?\d+)\s*$", 1).try_cast("long")
