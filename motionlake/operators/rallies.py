"""Rallies of a session: runs of activity, points within them, lengths with their range, how each ended.

Every step is a window or an aggregate over one rally's rows; the walk that finds where points end
streams over a session's rows in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from motionlake.functions import cut, over
from motionlake.operators import rally
from motionlake.operators.groups import dealt
from motionlake.operators.rally import MAX_QUIET_S, NEAR_NET_M, RESTART_S

#: Fixed values, in seconds: how long a ball is followed after a hit that counts, and how far an event may be from a track's end.
FOLLOWED_S, JOIN_S = 0.4, 0.05
#: The flags of a rally.
AFTER_POINT, AT_NET, IMPLAUSIBLE, UNCONFIRMED, LOST_TRACK, TWO_BALLS = "contacts_after_point_end", "bounce_at_net", "implausible_hit_dropped", "last_hit_unconfirmed", "lost_track_gap", "two_balls"


def runs(events: DataFrame, flights: DataFrame, key: str, quiet: float = MAX_QUIET_S) -> tuple[DataFrame, DataFrame]:
    """Events and flights (flight_id, t0, t1) with ``run``: activity without a longer silence than ``quiet``.

    Both travel whole through one window over a session, so that nothing is joined back; rows without a key
    or an id are left out.
    """
    e, f = events.where(F.col(key).isNotNull() & F.col("event_id").isNotNull()), flights.where(F.col(key).isNotNull() & F.col("flight_id").isNotNull())
    spans = e.select(key, F.col("t").alias("__t0"), F.col("t").alias("__t1"), F.struct(*events.columns).alias("__event"))
    spans = spans.unionByName(f.select(key, F.col("t0").alias("__t0"), F.col("t1").alias("__t1"), F.struct(*flights.columns).alias("__flight")), allowMissingColumns=True)
    found = cut(rally.activity_runs(spans, key, "__t0", "__t1", quiet).select(key, "__event", "__flight", "run"))
    own = lambda c, d: found.where(F.col(c).isNotNull()).select(key, *(F.col(c)[x].alias(x) for x in d.columns if x != key), "run")
    return own("__event", events), own("__flight", flights)


def points(events: DataFrame, key: str, restart: float = RESTART_S) -> DataFrame:
    """Events of a run with ``point``, null for those of a dead ball, and ``dropped``, whether the point has such.

    ``events``: run, event_id, t, kind, half, verdict.  A bounce called out, or a second one in the same half without a
    hit between, ends a point; a hit some time later begins the next.  A bounce in the other half soon
    after means that play went on, and the end did not count.  Rows come dealt by key and sorted, and the walk
    keeps nothing but its place in the run.
    """
    walked = StructType(list(events.schema.fields)).add("__number", IntegerType()).add("__live", BooleanType()).add("__lost", BooleanType())

    def walk(batches):
        at = number = dead = dead_half = prior = None
        for pdf in batches:
            numbers, live, lost = [], [], []
            for where, t, kind, half, verdict in zip(zip(pdf[key].tolist(), pdf["run"].tolist()), pdf["t"].tolist(), pdf["kind"].tolist(), pdf["half"].tolist(), pdf["verdict"].tolist()):
                if where != at:
                    at, number, dead, dead_half, prior = where, 0, None, None, None
                half = half if half in ("near", "far") else None
                soon = dead is not None and t - dead < restart
                if soon and kind == "bounce" and None not in (dead_half, half) and half != dead_half:
                    dead = None
                if dead is not None:
                    if soon or kind != "hit":
                        numbers.append(number)
                        live.append(False)
                        lost.append(kind != "kink")
                        continue
                    number, dead, prior = number + 1, None, None
                numbers.append(number)
                live.append(True)
                lost.append(False)
                again = prior is not None and prior[0] == "bounce" and half is not None and prior[1] == half
                if kind == "bounce" and (verdict == "out" or again):
                    dead, dead_half = t, half
                if kind in ("hit", "bounce"):
                    prior = kind, half
            yield pdf.assign(__number=numbers, __live=live, __lost=lost)

    d = dealt(events, key, "run", F.col("t").asc_nulls_last(), F.col("event_id").asc_nulls_last()).mapInPandas(walk, walked)
    dropped = F.max("__lost").over(Window.partitionBy(key, "run", "__number"))
    return d.select(*events.columns, F.when(F.col("__live"), F.col("__number")).alias("point"), (F.col("__live") & dropped).alias("dropped"))


def segment(events: DataFrame, landings: DataFrame, flights: DataFrame, key: str) -> DataFrame:
    """(key, rally, start, end, observed, inferred, length_min, length_max, confidence, reason, flags): a row for each rally.

    ``events``: event_id, t, kind (hit, bounce, net, kink), end; ``landings``: event_id, y, half, hitter_end, call;
    ``flights``: flight_id, t0, t1, half, where each was last seen.  A point without a hit or bounce is none.  The
    first point of a run begins with it, flights included, and the last ends with it; others by their events.
    """
    found = landings.select(key, "event_id", "half", "hitter_end", F.col("call.verdict").alias("verdict"), F.abs("y").alias("net_m"))
    e, f = runs(events.select(key, "event_id", "t", "kind", "end").join(found, [key, "event_id"], "left"), flights, key)
    around = e.select(key, "run", F.col("t").alias("t0"), F.col("t").alias("t1")).unionByName(f.select(key, "run", "t0", "t1")).groupBy(key, "run").agg(F.min("t0").alias("__from"), F.max("t1").alias("__to"))
    e = cut(points(e, key).where("point is not null").withColumn("rally", F.concat_ws(":", F.col(key), "run", "point")))
    contact = F.col("kind").isin("hit", "bounce")
    span = e.groupBy(key, "run", "rally", "point").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.bool_or(contact).alias("any"), F.bool_or("dropped").alias("dropped"), F.bool_or(F.coalesce(F.col("net_m") < NEAR_NET_M, F.lit(False))).alias("near_net"))
    # the first point begins with its run and the last ends with it
    every = Window.partitionBy(key, "run")
    first, last = F.col("point") == F.min("point").over(every), F.col("point") == F.max("point").over(every)
    span = span.withColumn("__first", first).withColumn("__last", last).join(around, [key, "run"])
    span = span.withColumn("start", F.when(F.col("__first"), F.col("__from")).otherwise(F.col("start"))).withColumn("end", F.when(F.col("__last"), F.col("__to")).otherwise(F.col("end")))
    span = cut(span.where("any").drop("any", "point", "__from", "__to"))
    e = cut(e.join(span.select("rally"), "rally", "left_semi").withColumn("side", F.coalesce("half", "end")))
    # flights of a rally: all of its run where that is one point, else those that reach into it
    reach = (F.col("__first") & F.col("__last")) | (F.col("t1") >= F.col("__s") - JOIN_S) & (F.col("t0") <= F.col("__z") + JOIN_S)
    f = f.join(span.select(key, "run", "rally", "__first", "__last", F.col("start").alias("__s"), F.col("end").alias("__z")), [key, "run"]).where(reach).select("rally", "flight_id", "t0", "t1", "half").transform(cut)

    gone = cut(rally.implausible_hits(e.where(contact | (F.col("kind") == "net")), "rally", "t", "kind", "side").select("rally", "event_id"))
    left = e.where(contact).join(gone, ["rally", "event_id"], "left_anti")
    again = lambda d: rally.split_strokes(d, "rally", "t", "kind", "end").select("rally", "event_id")
    flagged = cut(gone.unionByName(again(e.where(contact))).distinct())  # repeats among all hits are flagged, those among the others dropped
    gone = cut(gone.unionByName(again(left)))
    kept = cut(e.join(gone, ["rally", "event_id"], "left_anti"))
    late = rally.unconfirmed_hits(kept, "rally", "t", "kind").select("rally", "event_id", F.col("t").alias("hit_t"), F.col("end").alias("hit_end"))
    followed = late.join(f, "rally").where((F.col("t1") >= F.col("hit_t") + FOLLOWED_S) & (F.col("t0") <= F.col("hit_t") + JOIN_S) & (F.col("half") != F.col("hit_end"))).select("rally", "event_id").distinct()
    late = cut(late.join(followed, ["rally", "event_id"], "left_anti"))
    open_hits = late.join(flagged.withColumn("__gone", F.lit(1)), ["rally", "event_id"], "left").groupBy("rally").agg(F.count(F.lit(1)).alias("unconfirmed"), F.count_if(F.col("__gone").isNull()).alias("open"))
    last = kept.where(contact).groupBy("rally").agg(F.max(F.struct("t", "event_id", "kind", "half")).alias("c")).where("c.kind = 'bounce' and c.half is not null")
    after = last.join(f, "rally").where((F.col("t1") > F.col("c.t") + JOIN_S) & F.col("half").isNotNull()).groupBy("rally").agg(F.max(F.struct("t1", "flight_id", "half")).alias("f"), F.first("c.half").alias("own"))
    crossed = after.where("f.half <> own").select("rally", F.col("f.half").alias("crossed"))
    unconfirmed = late.select("rally", "event_id", F.lit(True).alias("__late"))
    counted = kept.join(unconfirmed, ["rally", "event_id"], "left").withColumn("__late", F.coalesce("__late", F.lit(False)))
    counts = rally.stroke_counts(kept, "rally", "t", "kind", "half", "net_m").drop("observed")
    seen = counted.groupBy("rally").agg(F.count_if((F.col("kind") == "hit") & ~F.col("__late")).alias("observed"))
    gaps = rally.lost_gaps(f, e, "rally", "t0", "t1", "t", tolerance=JOIN_S)
    two = rally.overlapping(f, "rally", "t0", "t1")
    reason = rally.end_reason(e, "rally", "t", "kind", "half", "verdict", "hitter_end")
    lost = flagged.groupBy("rally").agg(F.count(F.lit(1)).alias("implausible"))
    d = span
    for more in (counts, seen, gaps, two, reason, open_hits, crossed, lost):
        d = d.join(more, "rally", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    inferred = zero("inferred") + F.coalesce((F.col("crossed") == "near").cast("long"), F.lit(0))
    wide = zero("ambiguous") + zero("unconfirmed") + zero("gaps") + F.coalesce((F.col("crossed") == "far").cast("long"), F.lit(0))
    d = d.withColumn("observed", zero("observed")).withColumn("inferred", inferred).withColumn("__wide", wide)
    flag = lambda name, of: F.when(F.coalesce(of, F.lit(False)), name)
    flags = F.array_compact(
        F.array(
            flag(AFTER_POINT, F.col("dropped")), flag(AT_NET, F.col("near_net")), flag(IMPLAUSIBLE, zero("implausible") > 0), flag(UNCONFIRMED, zero("open") > 0),
            flag(LOST_TRACK, zero("gaps") > 0), flag(TWO_BALLS, F.col("two_balls")),
        )
    )
    least = F.col("observed") + F.col("inferred")
    most = least + F.col("__wide")
    number = F.row_number().over(over(key, "start", "rally")) - 1
    return d.select(key, number.alias("rally"), "start", "end", "observed", "inferred", least.alias("length_min"), most.alias("length_max"), rally.length_confidence(least, most).alias("confidence"), "reason", flags.alias("flags"))
