"""Rallies: activity runs, preceding hits, implausible contacts, gaps and point ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import over, running

#: Fixed values, in seconds and metres.
MAX_QUIET_S, MIN_CROSS_S, LOST_GAP_S, RESTART_S, CONFIRM_S, NEAR_NET_M = 2.5, 0.3, 0.2, 1.5, 0.4, 1.0


def activity_runs(spans: DataFrame, key: str, start: str, end: str, quiet: float = MAX_QUIET_S) -> DataFrame:
    """Adds ``run``: intervals merge while the gap to the latest end so far is at most ``quiet``."""
    w = over(key, start, end)
    latest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = latest.isNull() | (F.col(start) - latest > quiet)
    return spans.withColumn("__f", fresh.cast("int")).withColumn("run", F.sum("__f").over(running(key, start, end))).drop("__f")


def merged_runs(spans: DataFrame, key: str, start: str, end: str, quiet: float = MAX_QUIET_S) -> DataFrame:
    """(key, run, start, end, n) of the merged intervals."""
    return activity_runs(spans, key, start, end, quiet).groupBy(key, "run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"))


def preceding(events: DataFrame, key: str, order: str, kind: str, of: str, before: str, event_id: str) -> DataFrame:
    """Rows of kind ``before`` with the id of the last row of kind ``of`` ahead of them."""
    last = F.last(F.when(F.col(kind) == of, F.col(event_id)), True).over(over(key, order, event_id).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("preceding_id", last).where(F.col(kind) == before)


def split_strokes(contacts: DataFrame, key: str, order: str, kind: str, end: str, least: float = MIN_CROSS_S) -> DataFrame:
    """Second of two hits in a row at the same end less than ``least`` apart."""
    w = over(key, order)
    d = contacts.withColumn("__k", F.lag(kind).over(w)).withColumn("__e", F.lag(end).over(w)).withColumn("__t", F.lag(order).over(w))
    return d.where((F.col(kind) == "hit") & (F.col("__k") == "hit") & F.col(end).eqNullSafe(F.col("__e")) & (F.col(order) - F.col("__t") < least)).drop("__k", "__e", "__t")


def implausible_hits(contacts: DataFrame, key: str, order: str, kind: str, half: str, least: float = MIN_CROSS_S) -> DataFrame:
    """Hits that a bounce in the other half follows too soon, or one in their own half without a net between."""
    d = contacts.withColumn("nets", F.sum((F.col(kind) == "net").cast("int")).over(running(key, order)))
    live = d.where(F.col(kind) != "net")
    w = over(key, order)
    for c in (kind, half, order, "nets"):
        live = live.withColumn(f"__{c}", F.lead(c).over(w))
    soon = (F.col(f"__{half}") != F.col(half)) & (F.col(f"__{order}") - F.col(order) < least)
    own = (F.col(f"__{half}") == F.col(half)) & (F.col("__nets") == F.col("nets"))
    return live.where((F.col(kind) == "hit") & (F.col(f"__{kind}") == "bounce") & (soon | own)).select(*contacts.columns)


def unconfirmed_hits(contacts: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Hits after the last bounce or net of their key."""
    last = F.max(F.when(F.col(kind).isin("bounce", "net"), F.col(order))).over(Window.partitionBy(key))
    return contacts.withColumn("__l", last).where((F.col(kind) == "hit") & (F.col("__l").isNull() | (F.col(order) > F.col("__l")))).drop("__l")


def lost_gaps(spans: DataFrame, joins: DataFrame, key: str, start: str, end: str, at: str, gap: float = LOST_GAP_S, tolerance: float = 0.05) -> DataFrame:
    """(key, gaps): gaps longer than ``gap`` between spans, in which no event joins them."""
    w = over(key, start, end)
    g = spans.withColumn("next", F.lead(start).over(w)).where(F.col("next") - F.col(end) > gap).select(key, F.col(end).alias("g0"), F.col("next").alias("g1"))
    met = g.join(joins.select(key, F.col(at).alias("at")), key).where((F.col("at") >= F.col("g0") - tolerance) & (F.col("at") <= F.col("g1") + tolerance)).select(key, "g0", "g1").distinct()
    left = g.join(met, [key, "g0", "g1"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("gaps"))
    return spans.select(key).distinct().join(left, key, "left").select(key, F.coalesce("gaps", F.lit(0)).alias("gaps"))


def overlapping(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, two_balls): whether two spans of a key overlap."""
    latest = F.max(end).over(over(key, start, end).rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("__o", F.coalesce(F.col(start) < latest, F.lit(False))).groupBy(key).agg(F.bool_or("__o").alias("two_balls"))


def length_confidence(least: Column, most: Column) -> Column:
    width = most - least
    return F.when(width == 0, "high").when(width == 1, "medium").otherwise("low")


#: Fixed value: metres from the net within which a bounce may as well be the ball falling back from it.
NEAR_NET_M = 1.0


def stroke_counts(contacts: DataFrame, key: str, order: str, kind: str, half: str, net_m: str | None = None) -> DataFrame:
    """(key, observed, inferred, ambiguous): strokes seen, strokes that must have been, strokes that may have been.

    Hits are seen.  The first contact, if it is a bounce, was launched by one; a bounce after a bounce
    in the other half implies one, as does one near the net (``net_m``, metres from it, less than
    NEAR_NET_M) after a bounce that is not; after a bounce near the net one is only possible, where the
    half of the next is known.  Kinks (kind 'kink') between contacts may each be a hit that was not
    named, those after the last contact one together.
    """
    w = over(key, order)
    near = F.lit(False) if net_m is None else F.coalesce(F.abs(F.col(net_m)) < NEAR_NET_M, F.lit(False))
    d = contacts.select(key, order, kind, half, near.alias("__near")).where(F.col(kind).isin("hit", "bounce", "kink"))
    is_contact = F.col(kind) != "kink"
    d = d.withColumn("__c", F.when(is_contact, F.struct(F.col(kind).alias("k"), F.col(half).alias("h"), F.col("__near").alias("near"))))
    d = d.withColumn("__p", F.last("__c", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__q", F.first("__c", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    twice = (F.col(kind) == "bounce") & (F.col("__p.k") == "bounce")
    sure = twice & ~F.col("__p.near") & (F.col("__near") | F.coalesce(F.col(half) != F.col("__p.h"), F.lit(False)))
    maybe = twice & F.col("__p.near") & F.col(half).isNotNull()
    kink = (F.col(kind) == "kink") & F.col("__p").isNotNull()
    launched = (F.col(kind) == "bounce") & F.col("__p").isNull()
    per = d.groupBy(key).agg(
        F.count_if(F.col(kind) == "hit").alias("observed"),
        (F.count_if(sure) + F.count_if(launched)).alias("inferred"),
        (F.count_if(maybe) + F.count_if(kink & F.col("__q").isNotNull()) + F.coalesce(F.bool_or(kink & F.col("__q").isNull()), F.lit(False)).cast("long")).alias("ambiguous"),
    )
    return per


def end_reason(contacts: DataFrame, key: str, order: str, kind: str, half: str, verdict: str, hitter: str | None = None) -> DataFrame:
    """(key, reason): how a run of events ended, judged by what follows its last hit.

    In this order: net, if the ball touched it or first bounced in its hitter's own half (``hitter``, an
    end); timeout, if it did not bounce; ball_out, if its first bounce was called out; double_bounce,
    if the first two bounces were in one half; else, and without any contact, lost_track.
    """
    contact = contacts.where(F.col(kind).isin("hit", "bounce", "net"))
    last = F.max(F.when(F.col(kind) == "hit", F.col(order))).over(Window.partitionBy(key))
    after = contact.withColumn("__l", last).withColumn("__after", F.col("__l").isNull() | (F.col(order) > F.col("__l")))
    bounce = F.col("__after") & (F.col(kind) == "bounce")
    own = F.lit(None).cast("string") if hitter is None else F.col(hitter)
    after = after.withColumn("__b", F.when(bounce, F.struct(F.col(order).alias("t"), F.col(half).alias("half"), F.col(verdict).alias("call"), own.alias("own"))))
    after = after.withColumn("__n", F.when(bounce, F.count("__b").over(over(key, order))))
    per = after.groupBy(key).agg(
        F.bool_or(F.col("__after") & (F.col(kind) == "net")).alias("net"), F.min_by("__b", F.col("__n")).alias("first"), F.max(F.when(F.col("__n") == 2, F.col("__b.half"))).alias("second")
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(F.col("net"), "net")
        .when(F.col("first").isNull(), "timeout")
        .when(yes(F.col("first.half") == F.col("first.own")), "net")
        .when(yes(F.col("first.call") == "out"), "ball_out")
        .when(yes(F.col("first.half") == F.col("second")), "double_bounce")
        .otherwise("lost_track")
    )
    return contacts.select(key).distinct().join(per.select(key, reason.alias("reason")), key, "left").select(key, F.coalesce("reason", F.lit("lost_track")).alias("reason"))


def split_at_point_ends(events: DataFrame, key: str, order: str, kind: str, ends: str, restart: float = RESTART_S) -> DataFrame:
    """Adds ``point``: the ball is dead after an event that ends a point, until a hit some time later.

    A state machine over one run of events at a time; runs are bounded by the quiet that closes them.
    """
    schema = events.withColumn("point", F.lit(0)).schema

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        point, dead, out = 0, None, []
        for t, k, e in zip(pdf[order], pdf[kind], pdf[ends]):
            if dead is not None and k == "hit" and t - dead >= restart:
                point, dead = point + 1, None
            out.append(point)
            if dead is None and bool(e):
                dead = t
        return pdf.assign(point=out)

    return events.groupBy(key).applyInPandas(walk, schema)


def merged_events(events: DataFrame, key: str, order: str, kind: str, tolerance: float) -> DataFrame:
    """Events without those of the same kind that follow another within ``tolerance``."""
    w = over([key, kind], order)
    return events.withColumn("__t", F.lag(order).over(w)).where(F.col("__t").isNull() | (F.col(order) - F.col("__t") > tolerance)).drop("__t")


def nearest(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, within: float, right_id: str) -> DataFrame:
    """Left rows with the id of the nearest right row in time, at most ``within`` away; the earlier of equals.

    Both sides are dealt to buckets of that width, and a left row looks into three of them, so the
    join is on equal keys.
    """
    l = left.withColumn("__b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col(lt) / within) + k)))
    r = right.select(F.col(key), F.floor(F.col(rt) / within).alias("__b"), F.col(rt).alias("__rt"), F.col(right_id).alias("__id"))
    gap = F.abs(F.col(lt) - F.col("__rt"))
    hit = F.when(gap <= within, F.struct(gap.alias("gap"), F.col("__rt").alias("t"), F.col("__id").alias("id")))
    out = l.join(r, [key, "__b"], "left").groupBy(*left.columns).agg(F.min(hit).alias("m"))
    return out.select(*left.columns, F.col("m.id").alias("nearest_id"), F.col("m.gap").alias("gap"))
