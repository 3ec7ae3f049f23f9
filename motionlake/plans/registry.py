"""Queries of the operators over the driver's tables, with their DuckDB SQL.

The tables stand in for recorded sessions: an event's user is the session, its id the frame, its
value a measure; a line item's order is the session and its amounts are the metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionlake.functions import angle_deg, seconds
from motionlake.operators import court, dashboard, history, match, rally, scorecard, series, stats, textguard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "robust_spread"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL; doubles are rounded to 6 digits."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            return out.select(*(F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def swings(read) -> DataFrame:
    """Events as swings: session, frame, time, kind, value, and a second measure out of the JSON."""
    e = read("events")
    return e.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("frame"), seconds("ts").alias("t"), F.col("event_type").alias("kind"), "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


#: The same in SQL.
E = "e AS (SELECT user_id AS session, event_id AS frame, epoch_us(ts) / 1e6 AS t, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"
W = "(PARTITION BY session ORDER BY frame)"


@query(f"""WITH {E}, m AS (SELECT session, value, median(value) OVER (PARTITION BY session) AS med FROM e)
SELECT session, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(any_value(med), 6) END AS median, CASE WHEN count(*) >= 2 THEN round(median(abs(value - med)), 6) END AS mad,
CASE WHEN count(*) >= 2 THEN round(median(abs(value - med)) * 1.4826, 6) END AS robust_sd FROM m GROUP BY session""")
def robust_spread(read):
    return stats.robust_spread(swings(read), "session", "value")


@query(f"WITH {E}, c AS (SELECT session, kind, count(*) AS n FROM e GROUP BY ALL) SELECT session, kind, n, round(100.0 * n / sum(n) OVER (PARTITION BY session), 6) AS percent FROM c")
def shot_mix(read):
    return stats.shot_mix(swings(read), "session", "kind")


@query(f"""WITH {E}, m AS (SELECT session, value, median(value) OVER (PARTITION BY session) AS med FROM e),
s AS (SELECT session, count(*) AS n, any_value(med) AS md, median(abs(value - med)) * 1.4826 AS sd, min(value) AS lo, max(value) AS hi FROM m GROUP BY session HAVING true)
SELECT session, n, CASE WHEN n >= 2 THEN round(md, 6) END AS median, CASE WHEN n >= 2 THEN round(sd, 6) END AS robust_sd, CASE WHEN n >= 2 THEN round(sd / nullif(abs(md), 0), 6) END AS robust_cv,
CASE WHEN n >= 5 THEN round(lo, 6) END AS least, CASE WHEN n >= 5 THEN round(hi, 6) END AS most,
CASE WHEN n < 5 THEN 'count' WHEN n < 8 THEN 'range' WHEN n < 20 THEN 'label_with_n' ELSE 'label' END AS treatment,
CASE WHEN n >= 8 THEN CASE WHEN sd / 60.0 <= 0.5 THEN 'tight' WHEN sd / 60.0 <= 1.0 THEN 'moderate' ELSE 'wide' END END AS label FROM s""")
def consistency_labels(read):
    return stats.consistency(swings(read), "session", "value", 60.0)


@query(f"WITH {E} SELECT a.session, round(median((b.value - a.value) / (b.t - a.t)) * 1000, 6) AS slope FROM e a JOIN e b ON a.session = b.session AND a.t < b.t GROUP BY a.session UNION ALL SELECT session, 0.0 FROM e GROUP BY session HAVING count(DISTINCT t) < 2")
def theil_sen(read):
    return stats.theil_sen(swings(read), "session", "t", "value").withColumn("slope", F.col("slope") * 1000)


@query(f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, value) AS i, count(*) OVER (PARTITION BY session) AS n, median(value) OVER (PARTITION BY session) AS med FROM e),
q AS (SELECT session, any_value(n) AS n, max(t) - min(t) AS span, median(value) FILTER (i <= n // 3) AS f, median(value) FILTER (i > n - n // 3) AS l, median(abs(value - med)) * 1.4826 AS sd FROM r GROUP BY session),
s AS (SELECT a.session, median((b.value - a.value) / (b.t - a.t)) AS slope FROM e a JOIN e b ON a.session = b.session AND a.t < b.t GROUP BY a.session)
SELECT session, n, round(f, 6) AS first_median, round(l, 6) AS last_median, round(slope * 600, 6) AS slope,
CASE WHEN l - f > sd * 0.5 AND slope > 0 THEN 'rising' WHEN l - f < -sd * 0.5 AND slope < 0 THEN 'falling' ELSE 'steady' END AS direction FROM q JOIN s USING (session) WHERE n >= 15 AND span >= 300""")
def within_trend(read):
    return stats.within_trend(swings(read), "session", "t", "value")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, arg_max(o_orderstatus, o_orderkey) OVER (PARTITION BY o_custkey) AS newest FROM orders),
g AS (SELECT o_custkey, count(*) AS sessions, arg_min(o_totalprice, o_orderkey) AS first_value, arg_max(o_totalprice, o_orderkey) AS last_value FROM o WHERE o_orderstatus IS NOT DISTINCT FROM newest GROUP BY 1 HAVING count(*) >= 2)
SELECT o_custkey, sessions, round(first_value, 6) AS first_value, round(last_value, 6) AS last_value, CASE WHEN last_value - first_value >= 2 THEN 'rising' WHEN last_value - first_value <= -2 THEN 'falling' ELSE 'steady' END AS direction FROM g""")
def between_trend(read):
    return stats.between_trend(read("orders"), "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"WITH {E} SELECT kind, count(v) AS measured, count(*) - count(v) AS missing, round(median(v), 6) AS median, round(max(v), 6) AS fastest FROM (SELECT kind, CASE WHEN k >= 20 THEN value END AS v FROM e) GROUP BY kind")
def speed_summary(read):
    return stats.speed_summary(swings(read).withColumn("v", F.when(F.col("k") >= 20, F.col("value"))), "kind", "v")


@query(f"WITH {E} SELECT session, count(*) AS n, round(count(*) / nullif((max(t) - min(t)) / 60, 0), 6) AS per_minute FROM e GROUP BY session")
def swings_per_minute(read):
    minutes = (F.max("t") - F.min("t")) / 60.0
    return swings(read).groupBy("session").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.nullif(minutes, F.lit(0.0))).alias("per_minute"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER w AS rn, lead(o_orderkey) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))
SELECT o_custkey, o_orderkey, rn::INT AS rn, CASE WHEN rn = 5 AND later IS NOT NULL THEN rtrim(translate(base64(encode(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '|' || o_orderkey)), '+/', '-_'), '=') END AS next_cursor FROM r WHERE rn <= 5""")
def history_page(read):
    return history.pages(read("orders"), "o_custkey", "o_orderdate", "o_orderkey", 5).select("o_custkey", "o_orderkey", "rn", "next_cursor")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created, o_orderkey::VARCHAR AS id FROM orders")
def cursor_round_trip(read):
    o = read("orders").withColumn("c", history.decode_cursor(history.encode_cursor(F.col("o_orderdate"), F.col("o_orderkey"))))
    return o.select("o_orderkey", F.date_format("c.created", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), F.col("c.id").alias("id"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND (o_orderdate, o_orderkey) < (TIMESTAMP '1997-01-01', 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def history_page_after(read):
    return history.page_after(read("orders"), "o_orderpriority", "o_orderdate", "o_orderkey", F.lit("1-URGENT"), F.lit("1997-01-01").cast("timestamp_ntz"), F.lit(5000).cast("long"), 50).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) - 1 AS ahead FROM orders WHERE o_orderstatus IN ('O', 'P')")
def queue_position(read):
    return history.queue_positions(read("orders"), "o_orderdate", F.col("o_orderstatus").isin("O", "P"), "o_custkey").select("o_orderkey", "o_custkey", F.col("ahead").cast("long").alias("ahead"))


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_orderdate) - 1 AS ahead FROM orders WHERE o_orderstatus IN ('O', 'P')")
def queue_position_of_all(read):
    return history.queue_positions(read("orders"), "o_orderdate", F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", F.col("ahead").cast("long").alias("ahead"))


@query("SELECT event_id, event_type = 'view' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 180 SECOND AS stale FROM events")
def stale_jobs(read):
    return read("events").select("event_id", history.is_stale(F.when(F.col("event_type") == "view", "running").otherwise("done"), F.col("ts"), F.to_timestamp(F.lit("2024-01-20"))).alias("stale"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphans_anti(read):
    return history.orphans(read("customer"), read("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


@query("SELECT user_id, max(ts) AS last_opened_at, arg_max(event_type, ts) FILTER (event_type <> 'error') AS platform FROM events GROUP BY user_id")
def last_seen(read):
    e = read("events").withColumn("p", F.when(F.col("event_type") != "error", F.col("event_type")))
    return history.last_seen(e, "user_id", "ts", "p")


@query("""WITH RECURSIVE a AS (SELECT session, list(t ORDER BY t) AS ts FROM (SELECT user_id AS session, epoch_us(ts) / 1e6 AS t FROM events) GROUP BY session),
k AS (SELECT session, ts, ts[1] AS held FROM a UNION ALL SELECT session, ts, list_filter(ts, lambda x: x - held >= 86400.0)[1] FROM k WHERE list_filter(ts, lambda x: x - held >= 86400.0)[1] IS NOT NULL) SELECT session, round(held, 6) AS "at" FROM k""")
def throttle(read):
    return history.throttle(swings(read), "session", "t", 86400.0)


@query("SELECT n_name, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def activity_join(read):
    return read("customer").join(F.broadcast(read("nation")), F.col("c_nationkey") == F.col("n_nationkey")).where("c_acctbal > 0").select("n_name", "c_custkey", "c_acctbal")


@query("SELECT count(*) AS n, round(median(CAST(json_extract_string(props, '$.k') AS DOUBLE) / nullif(CAST(json_extract_string(props, '$.k') AS DOUBLE) - 10, 0)), 6) AS median FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) <> 10")
def json_median(read):
    e = read("events").withColumn("k", F.get_json_object("props", "$.k").cast("double")).withColumn("j", F.to_json(F.struct(F.col("k").alias("a"), (F.col("k") - 10).alias("b"))))
    return history.json_median(e, "j", "$.a", "$.b").select("n", "median")


# series -------------------------------------------------------------------------------------------


@query(f"""WITH {E}, f AS (SELECT *, value >= 30 AS on_, row_number() OVER {W} - 1 AS pos FROM e), g AS (SELECT *, on_ IS DISTINCT FROM lag(on_) OVER {W} OR pos = 0 AS fresh FROM f),
r AS (SELECT *, sum(fresh::INT) OVER {W} AS run FROM g)
SELECT session, run::BIGINT AS run, any_value(on_) AS on_, min(pos)::BIGINT AS run_start, max(pos)::BIGINT + 1 AS run_end FROM r GROUP BY session, run""")
def islands(read):
    r = series.runs(swings(read).withColumn("on_", F.col("value") >= 30), "session", "frame", "on_")
    return r.groupBy("session", "run").agg(F.first("on_").alias("on_"), F.first("run_start").cast("long").alias("run_start"), F.first("run_end").cast("long").alias("run_end"))


@query(f"""WITH {E}, f AS (SELECT *, value >= 30 AS on_, row_number() OVER {W} - 1 AS pos FROM e), g AS (SELECT *, pos - row_number() OVER (PARTITION BY session, on_ ORDER BY frame) AS isl FROM f),
r AS (SELECT session, min(pos) AS s, max(pos) + 1 AS t FROM g WHERE on_ GROUP BY session, isl), b AS (SELECT session, arg_max({{'s': s, 't': t}}, (t - s) * 1000000 - s) AS x FROM r GROUP BY session)
SELECT session, coalesce(x.s, 0)::BIGINT AS start, coalesce(x.t, 0)::BIGINT AS end FROM (SELECT DISTINCT session FROM e) LEFT JOIN b USING (session)""")
def longest_run(read):
    return series.longest_run(swings(read), "session", "frame", F.col("value") >= 30)


@query(f"""WITH {E}, f AS (SELECT *, value >= 30 AS on_, row_number() OVER {W} - 1 AS pos FROM e), g AS (SELECT *, pos - row_number() OVER (PARTITION BY session, on_ ORDER BY frame) AS isl FROM f),
r AS (SELECT session, count(*) AS c FROM g WHERE NOT on_ GROUP BY session, isl) SELECT session, coalesce(max(c), 0)::BIGINT AS gap FROM (SELECT DISTINCT session FROM e) LEFT JOIN r USING (session) GROUP BY session""")
def longest_gap(read):
    return series.longest_gap(swings(read).withColumn("on_", F.col("value") >= 30), "session", "frame", "on_")


@query(f"""WITH {E}, f AS (SELECT *, k >= 30 AS ok, row_number() OVER {W} AS pos FROM e),
g AS (SELECT *, last_value(CASE WHEN ok THEN pos END IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS p, last_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS UNBOUNDED PRECEDING) AS pv,
first_value(CASE WHEN ok THEN pos END IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q, first_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qv FROM f)
SELECT session, frame, round(CASE WHEN ok THEN value ELSE coalesce(pv + (qv - pv) * (pos - p) / nullif(q - p, 0), pv, qv, value) END, 6) AS filled FROM g""")
def fill_linear(read):
    return series.fill_linear(swings(read), "session", "frame", "value", F.col("k") >= 30).select("session", "frame", "filled")


def _taps(weights, offsets):
    return " + ".join(f"({c}) * {'value' if j == 0 else ('lead' if j > 0 else 'lag') + f'(value, {abs(j)}) OVER w'}" for c, j in zip(weights, offsets))


@query(f"""WITH {E}, s AS (SELECT session, frame, value, count(*) OVER (PARTITION BY session) AS n, row_number() OVER w AS i, ({_taps((-3, 12, 17, 12, -3), range(-2, 3))}) / 35.0 AS m, ({_taps((31, 9, -3, -5, 3), range(5))}) / 35.0 AS a, ({_taps((9, 13, 12, 6, -5), range(-1, 4))}) / 35.0 AS b,
({_taps((31, 9, -3, -5, 3), range(0, -5, -1))}) / 35.0 AS z, ({_taps((9, 13, 12, 6, -5), range(1, -4, -1))}) / 35.0 AS y FROM e WINDOW w AS {W})
SELECT session, frame, round(CASE WHEN n < 5 THEN value WHEN i = 1 THEN a WHEN i = 2 THEN b WHEN i = n THEN z WHEN i = n - 1 THEN y ELSE m END, 6) AS smoothed FROM s""")
def savgol(read):
    return series.smooth(swings(read), "session", "frame", "value").select("session", "frame", "smoothed")


@query(f"""WITH {E} SELECT session, frame, round(coalesce((coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value)) / nullif(coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t), 0), 0) * 1000, 6) AS slope FROM e WINDOW w AS {W}""")
def central_difference(read):
    return series.central_difference(swings(read), "session", "frame", "value", "t").select("session", "frame", (F.col("slope") * 1000).alias("slope"))


@query(f"""WITH {E}, s AS (SELECT session, CASE WHEN k >= 20 AND lag(k) OVER w >= 20 THEN sqrt(power(value - lag(value) OVER w, 2) + power(k - lag(k) OVER w, 2)) END AS step FROM e WINDOW w AS {W})
SELECT session, round(coalesce(sum(step), 0), 6) AS length FROM s GROUP BY session""")
def path_length(read):
    return series.path_length(swings(read), "session", "frame", "value", "k", F.col("k") >= 20)


@query(f"WITH {E} SELECT session, frame, round(median(value) OVER (PARTITION BY session ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 86400 FOLLOWING), 6) AS rolling FROM e")
def rolling_median(read):
    return series.rolling_median(swings(read), "session", "t", "value", 86400).select("session", "frame", "rolling")


@query(f"WITH {E}, s AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS n FROM e WINDOW w AS {W}) SELECT session, frame, value FROM s WHERE (p IS NULL OR value > p) AND (n IS NULL OR value >= n)")
def local_maxima(read):
    return series.local_maxima(swings(read), "session", "frame", "value").select("session", "frame", "value")


@query(f"""WITH {E}, s AS (SELECT *, row_number() OVER w - 1 AS pos, lag(value) OVER w AS p, lead(value) OVER w AS n FROM e WINDOW w AS {W}), b AS (SELECT session, max(value) AS peak, arg_max(pos, value * 1000000 - pos) AS peak_pos FROM s GROUP BY session),
r AS (SELECT session, max(value) AS rival FROM s JOIN b USING (session) WHERE (p IS NULL OR value > p) AND (n IS NULL OR value >= n) AND abs(pos - peak_pos) >= 5 GROUP BY session)
SELECT session, peak_pos::BIGINT AS peak_pos, round(peak, 6) AS peak, round(CASE WHEN rival > 0 THEN least(peak / rival, 10) ELSE 10 END, 6) AS prominence FROM b LEFT JOIN r USING (session)""")
def prominence(read):
    return series.prominence(swings(read), "session", "frame", "value")


@query()
def nms_peaks(read):
    return series.suppress(swings(read), "session", "frame", "value", 3)


@query(f"WITH {E}, j AS (SELECT session, frame, round_even(t / 60 * 1000, 0)::BIGINT AS ms, row_number() OVER {W} - 1 AS j FROM e) SELECT session, frame, (max(ms - j) OVER {W} + j)::BIGINT AS ms FROM j")
def monotone_ms(read):
    return series.monotone_ms(swings(read), "session", "frame", F.col("t") / 60).select("session", "frame", "ms")


@query(f"WITH {E}, b AS (SELECT session, frame, coalesce(t - lag(t) OVER {W} > 86400, false) AS br FROM e) SELECT session, frame, sum(br::INT) OVER {W}::BIGINT AS segment FROM b")
def tracking_segments(read):
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("session").orderBy("frame")) > 86400
    return series.segments(swings(read).withColumn("b", gap), "session", "frame", "b").select("session", "frame", "segment")


@query(f"WITH {E} SELECT session, frame, round(coalesce(avg((value >= 20)::INT) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0), 6) AS coverage FROM e")
def approach_coverage(read):
    w = Window.partitionBy("session").orderBy("frame").rowsBetween(-6, -1)
    return swings(read).select("session", "frame", F.coalesce(F.avg((F.col("value") >= 20).cast("int")).over(w), F.lit(0.0)).alias("coverage"))


# scorecard ----------------------------------------------------------------------------------------

#: Stand-in bands: (metric, category, weight, lower_is_better, ideal_min, ideal_max, physical_min, physical_max).
BANDS = (
    ("l_quantity", "contact", 0.6, False, 10.0, 30.0, 0.0, 50.0),
    ("l_extendedprice", "contact", 0.4, False, 20000.0, 50000.0, 0.0, None),
    ("l_discount", "swing_path", 1.0, True, 0.0, 0.04, 0.0, None),
    ("l_tax", "balance", 1.0, True, 0.0, 0.03, 0.0, None),
)
BAND_COLUMNS = "metric string, category string, weight double, lower_is_better boolean, ideal_min double, ideal_max double, physical_min double, physical_max double"
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if isinstance(v, str) else str(v).lower() for v in b) + ")" for b in BANDS)
SCORED = f"""b0(metric, category, weight, lib, imin, imax, pmin, pmax) AS (VALUES {_VALUES}),
b AS (SELECT *, coalesce(greatest(imin - (imax - imin), pmin), imin - (imax - imin))::DOUBLE AS hmin, coalesce(least(imax + (imax - imin), pmax), imax + (imax - imin))::DOUBLE AS hmax FROM b0),
u AS (UNPIVOT (SELECT l_orderkey * 10 + l_linenumber AS item, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE value),
s AS (SELECT item, l_partkey, l_suppkey, metric, category, weight::DOUBLE AS weight, value, imin, imax, CASE WHEN NOT lib AND value < imin THEN 'low' WHEN value > imax THEN 'high' ELSE 'ideal' END AS verdict,
round_even(CASE WHEN NOT lib AND value < imin THEN CASE WHEN value <= hmin THEN 0 ELSE 100.0::DOUBLE * (value - hmin) / (imin - hmin) END WHEN value > imax THEN CASE WHEN value >= hmax THEN 0 ELSE 100.0::DOUBLE * (hmax - value) / (hmax - imax) END ELSE 100 END, 1) AS score FROM u JOIN b USING (metric))"""


def scored_items(read) -> DataFrame:
    items = read("lineitem")
    bands = scorecard.hard_bounds(items.sparkSession.createDataFrame(BANDS, BAND_COLUMNS))
    items = items.withColumn("item", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return scorecard.metric_scores(items, "item", [b[0] for b in BANDS], bands)


def carded_items(read) -> DataFrame:
    items = read("lineitem")
    return scorecard.card(items, [b[0] for b in BANDS], scorecard.hard_bounds(items.sparkSession.createDataFrame(BANDS, BAND_COLUMNS)))


_ITEM = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
SCORED = SCORED.replace("l_orderkey * 10 + l_linenumber AS item, l_orderkey, l_partkey, l_suppkey", _ITEM).replace("SELECT item, l_partkey, l_suppkey,", f"SELECT {_ITEM},")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("item.l_orderkey", "item.l_linenumber", "item.l_partkey", "item.l_suppkey", *(c for c in df.columns if c != "item"))


@query(f"WITH {SCORED} SELECT {_ITEM}, metric, round(score, 6) AS score, verdict FROM s")
def metric_scores(read):
    return _flat(scored_items(read).select("item", "metric", "score", "verdict"))




@query(f"""WITH {SCORED}, k(category) AS (VALUES ('preparation'), ('contact'), ('swing_path'), ('balance'), ('follow_through')),
p AS (SELECT {_ITEM}, category, sum(weight * score) / sum(weight) AS raw, count(score) AS available, count(*) AS total FROM s GROUP BY ALL), i AS (SELECT DISTINCT {_ITEM} FROM s)
SELECT {_ITEM}, category, round(round_even(raw, 1), 6) AS score, coalesce(available, 0) AS available, coalesce(total, 0) AS total FROM i CROSS JOIN k LEFT JOIN p USING ({_ITEM}, category)""")
def category_scores(read):
    # every item has all categories; inline would have the optimiser ask for that by working them out once more
    return carded_items(read).select(*_ITEM.split(", "), F.inline_outer("categories"))


@query(f"""WITH {SCORED}, p AS (SELECT {_ITEM}, category, round_even(sum(weight * score) / sum(weight), 1) AS sc FROM s GROUP BY ALL), w AS (SELECT *, CASE category WHEN 'contact' THEN 0.30 WHEN 'swing_path' THEN 0.25 ELSE 0.15 END::DOUBLE AS cw FROM p)
SELECT {_ITEM}, CASE WHEN count(sc) >= 3 THEN round(round_even(round(sum(cw * sc) / sum(cw), 9), 1), 6) END AS overall FROM w GROUP BY {_ITEM}""")
def overall_score(read):
    return carded_items(read).select(*_ITEM.split(", "), "overall")


@query(f"WITH {SCORED} SELECT {_ITEM}, metric, verdict, round(CASE WHEN verdict = 'low' THEN imin - value ELSE value - imax END, 6) AS distance FROM s WHERE verdict <> 'ideal'")
def deviations(read):
    return _flat(scorecard.deviations(scored_items(read), "item"))


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY {_ITEM} ORDER BY score, weight DESC, metric) AS rank FROM s WHERE verdict <> 'ideal') SELECT {_ITEM}, rank::INT AS rank, metric, round(score, 6) AS score FROM r WHERE rank <= 3")
def priority_metrics(read):
    return _flat(scorecard.priorities(scored_items(read), "item"))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY {_ITEM} ORDER BY CASE verdict WHEN 'ideal' THEN 1 ELSE 0 END, CASE verdict WHEN 'ideal' THEN -score ELSE score END, metric) AS rank FROM s) SELECT {_ITEM}, rank::INT AS rank, metric FROM r WHERE rank <= 2""")
def key_numbers(read):
    return _flat(dashboard.key_numbers(scored_items(read), "item", 2))


# dashboard ----------------------------------------------------------------------------------------


@query(f"""WITH {E}, g AS (SELECT session, kind, count(v) AS measured, arg_min(v, frame) AS earliest, arg_max(v, frame) AS latest FROM (SELECT *, CASE WHEN k >= 20 THEN value END AS v FROM e) GROUP BY ALL), d AS (SELECT *, CASE WHEN measured >= 2 THEN latest - earliest END AS delta FROM g)
SELECT session, kind, measured, round(earliest, 6) AS earliest, round(latest, 6) AS latest, round(delta, 6) AS delta, CASE WHEN delta IS NULL THEN 'unknown' WHEN abs(delta) < 2 THEN 'steady' WHEN delta > 0 THEN 'improving' ELSE 'declining' END AS direction FROM d""")
def trend_direction(read):
    return dashboard.trend(swings(read).withColumn("v", F.when(F.col("k") >= 20, F.col("value"))), ["session", "kind"], "frame", "v")


@query(f"""WITH {E}, g AS (SELECT session, CASE WHEN count(*) >= 2 THEN max(k) - min(k) END AS spread, CASE WHEN count(*) >= 2 THEN stddev_pop(k) END AS deviation FROM e GROUP BY session)
SELECT session, round(spread, 6) AS spread, round(deviation, 6) AS deviation, CASE WHEN spread < 8 THEN 'tight' WHEN spread <= 20 THEN 'moderate' WHEN spread IS NOT NULL THEN 'wide' END AS band FROM g""")
def spread_band(read):
    return dashboard.spread_band(swings(read), "session", "k")


@query("WITH o AS (SELECT o_custkey, o_orderkey, nullif(o_orderstatus, 'P') AS v, row_number() OVER w - 1 AS idx, lag(nullif(o_orderstatus, 'P')) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, o_orderkey, idx::INT AS idx FROM o WHERE idx > 0 AND v IS DISTINCT FROM p")
def version_boundaries(read):
    o = read("orders").withColumn("v", F.nullif("o_orderstatus", F.lit("P")))
    return dashboard.version_boundaries(o, "o_custkey", "o_orderkey", "v").select("o_custkey", "o_orderkey", "idx")


@query("WITH o AS (SELECT o_custkey, nullif(o_orderstatus, 'P') AS v, lead(nullif(o_orderstatus, 'P')) OVER w AS pv, o_totalprice AS x, lead(o_totalprice) OVER w AS px, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey DESC)) SELECT o_custkey, CASE WHEN v IS NOT DISTINCT FROM pv THEN round(x - px, 6) END AS delta FROM o WHERE rn = 1")
def latest_delta(read):
    o = read("orders").withColumn("v", F.nullif("o_orderstatus", F.lit("P")))
    return dashboard.latest_delta(o, "o_custkey", "o_orderkey", "v", "o_totalprice")


@query("""WITH l AS (SELECT o_custkey, o_orderstatus AS nv FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT o_custkey, round(max(o_totalprice) FILTER (o_orderstatus = nv), 6) AS best, round(avg(o_totalprice) FILTER (o_orderstatus = nv), 6) AS average, max(o_orderkey) AS top_speed FROM orders JOIN l USING (o_custkey) GROUP BY o_custkey""")
def comparable_scores(read):
    return dashboard.best_and_average(read("orders"), "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderkey")


@query(f"WITH {E}, g AS (SELECT session, kind, arg_max(value, frame) AS latest FROM e GROUP BY ALL) SELECT session, arg_min(kind, {{'a': latest, 'b': kind}}) AS focus FROM g GROUP BY session")
def focus(read):
    return dashboard.focus(dashboard.trend(swings(read), ["session", "kind"], "frame", "value"), "session", "kind")


@query(f"WITH {E}, c AS (SELECT session, kind, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, kind) AS rn, count(*) OVER (PARTITION BY session) AS kinds FROM c) SELECT session, CASE WHEN rn > 3 AND kinds > 4 THEN 'Other' ELSE kind END AS slice, sum(n)::BIGINT AS n FROM r GROUP BY ALL")
def shot_mix_slices(read):
    return dashboard.mix_slices(swings(read), "session", "kind", 3)


@query(f"""WITH RECURSIVE {E}, t AS (SELECT session, kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY session) AS total FROM e GROUP BY session, kind),
g AS (SELECT session, n, count(*) AS ties, any_value(100 * n // total) AS fl, any_value((100 * n) % total) AS rest FROM t GROUP BY session, n),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rest DESC, n DESC) AS rn, 100 - sum(fl * ties) OVER (PARTITION BY session) AS free FROM g),
r AS (SELECT session, rn, n, (ties <= free AND rest > 0)::INT AS won, free - CASE WHEN ties <= free AND rest > 0 THEN ties ELSE 0 END AS free FROM o WHERE rn = 1
UNION ALL SELECT o.session, o.rn, o.n, (o.ties <= r.free AND o.rest > 0)::INT, r.free - CASE WHEN o.ties <= r.free AND o.rest > 0 THEN o.ties ELSE 0 END FROM r JOIN o ON o.session = r.session AND o.rn = r.rn + 1)
SELECT t.session, t.kind, (100 * t.n // total + won)::BIGINT AS percent FROM t JOIN r ON r.session = t.session AND r.n = t.n""")
def whole_percents(read):
    return dashboard.whole_percents(swings(read).groupBy("session", "kind").agg(F.count(F.lit(1)).alias("n")), "session", "kind", "n")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nr, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS nk FROM orders),
p AS (SELECT o_custkey, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN nr <= 6 THEN nr ELSE 6 + nk END, nr) AS place FROM r WHERE nr <= 6 OR nk <= 3) SELECT o_custkey, id, place::INT AS place FROM p WHERE place <= 12""")
def detail_ids(read):
    return dashboard.detail_ids(read("orders"), "o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")


@query(f"WITH {E}, d AS (SELECT *, avg(value) OVER (PARTITION BY session, kind ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, row_number() OVER (PARTITION BY session, kind ORDER BY frame DESC) AS rn FROM e) SELECT session, kind, round(value, 6) AS newest, round(m, 6) AS earlier_mean, round(value - m, 6) AS delta FROM d WHERE rn = 1")
def category_comparison(read):
    return dashboard.comparison(swings(read), ["session", "kind"], "frame", "value")


@query("SELECT c_custkey, p AS o_orderpriority FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = p)")
def not_recorded(read):
    o = read("orders").withColumnRenamed("o_custkey", "c_custkey")
    return dashboard.not_recorded(o, read("customer").select("c_custkey"), "c_custkey", "o_orderpriority", o.select("o_orderpriority").distinct())


@query(f"WITH {E} SELECT session, frame, max(value) FILTER (kind = 'click') AS click, max(value) FILTER (kind = 'view') AS view, max(value) FILTER (kind = 'error') AS error FROM e GROUP BY ALL")
def category_series(read):
    return dashboard.category_series(swings(read), "session", "frame", ["click", "view", "error"], "kind", "value")


@query(f"WITH {E}, b AS (SELECT session, frame, value > max(value) OVER (PARTITION BY session ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e) SELECT session, frame, coalesce(r, true) AS record FROM b")
def records(read):
    return dashboard.running_best(swings(read), "session", "frame", "value").select("session", "frame", "record")


# rallies and court --------------------------------------------------------------------------------


def contacts(read) -> DataFrame:
    """Events as contacts: kind hit, bounce or net; half by the value; called out by the JSON number."""
    kind = F.when(F.col("kind").isin("click", "view"), "hit").when(F.col("kind") == "error", "net").otherwise("bounce")
    return swings(read).select("session", "frame", "t", kind.alias("kind"), F.when(F.col("value") < 30, "near").otherwise("far").alias("half"), F.when(F.col("k") > 70, "out").otherwise("in").alias("verdict"), "value", "k")


C = E + """, c AS (SELECT session, frame, t, CASE WHEN kind IN ('click', 'view') THEN 'hit' WHEN kind = 'error' THEN 'net' ELSE 'bounce' END AS kind, CASE WHEN value < 30 THEN 'near' ELSE 'far' END AS half, CASE WHEN k > 70 THEN 'out' ELSE 'in' END AS verdict, value, k FROM e)"""
SPANS = C + ", sp AS (SELECT session, frame, t AS a, t + value * 600 AS z FROM c)"


def spans(read) -> DataFrame:
    return contacts(read).select("session", "frame", F.col("t").alias("a"), (F.col("t") + F.col("value") * 600).alias("z"))


@query(f"WITH {C}, p AS (SELECT *, lag(kind) OVER w AS pk, lag(half) OVER w AS ph, lag(t) OVER w AS pt FROM c WINDOW w AS (PARTITION BY session ORDER BY t)) SELECT session, frame FROM p WHERE kind = 'hit' AND pk = 'hit' AND half = ph AND t - pt < 20000")
def split_strokes(read):
    return rally.split_strokes(contacts(read), "session", "t", "kind", "half", 20000.0).select("session", "frame")


@query(f"""WITH {C}, n AS (SELECT *, sum((kind = 'net')::INT) OVER (PARTITION BY session ORDER BY t) AS nets FROM c), p AS (SELECT *, lead(kind) OVER w AS nk, lead(half) OVER w AS nh, lead(t) OVER w AS nt, lead(nets) OVER w AS nn FROM n WHERE kind <> 'net' WINDOW w AS (PARTITION BY session ORDER BY t))
SELECT session, frame FROM p WHERE kind = 'hit' AND nk = 'bounce' AND ((nh <> half AND nt - t < 20000) OR (nh = half AND nn = nets))""")
def implausible_hits(read):
    return rally.implausible_hits(contacts(read), "session", "t", "kind", "half", 20000.0).select("session", "frame")


@query(f"WITH {C}, p AS (SELECT *, max(t) FILTER (kind IN ('bounce', 'net')) OVER (PARTITION BY session) AS l FROM c) SELECT session, frame FROM p WHERE kind = 'hit' AND (l IS NULL OR t > l)")
def unconfirmed_hits(read):
    return rally.unconfirmed_hits(contacts(read), "session", "t", "kind").select("session", "frame")


@query(f"""WITH {SPANS}, g AS (SELECT session, z AS g0, lead(a) OVER (PARTITION BY session ORDER BY a, z) AS g1 FROM sp), h AS (SELECT * FROM g WHERE g1 - g0 > 7200),
x AS (SELECT session, count(*) AS gaps FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session = h.session AND c.kind = 'net' AND c.t BETWEEN h.g0 - 60 AND h.g1 + 60) GROUP BY session)
SELECT session, coalesce(gaps, 0) AS gaps FROM (SELECT DISTINCT session FROM c) LEFT JOIN x USING (session)""")
def lost_gaps(read):
    return rally.lost_gaps(spans(read), contacts(read).where("kind = 'net'"), "session", "a", "z", "t", 7200.0, 60.0)


@query(f"WITH {SPANS}, l AS (SELECT *, max(z) OVER (PARTITION BY session ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pz FROM sp) SELECT session, bool_or(coalesce(a < pz, false)) AS two_balls FROM l GROUP BY session")
def two_balls(read):
    return rally.overlapping(spans(read), "session", "a", "z")


@query(f"""WITH {SPANS}, l AS (SELECT *, max(z) OVER (PARTITION BY session ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pz FROM sp),
r AS (SELECT *, sum((pz IS NULL OR a - pz > 3600)::INT) OVER (PARTITION BY session ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT session, run::BIGINT AS run, round(min(a), 6) AS start, round(max(z), 6) AS end, count(*) AS n FROM r GROUP BY session, run""")
def activity_runs(read):
    return rally.merged_runs(spans(read), "session", "a", "z", 3600.0)


@query(f"WITH {C}, p AS (SELECT *, last_value(CASE WHEN kind = 'hit' THEN frame END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS preceding_id FROM c) SELECT session, frame, preceding_id FROM p WHERE kind = 'bounce'")
def preceding_hit(read):
    return rally.preceding(contacts(read), "session", "t", "kind", "hit", "bounce", "frame").select("session", "frame", "preceding_id")


@query(f"""WITH {C}, x AS (SELECT session, t, half, k < 20 AS near, CASE kind WHEN 'net' THEN 'kink' ELSE kind END AS kind FROM c), z AS (SELECT *, CASE WHEN kind <> 'kink' THEN {{'k': kind, 'h': half, 'n': near}} END AS s FROM x),
y AS (SELECT *, last_value(s IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(s IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM z WINDOW w AS (PARTITION BY session ORDER BY t))
SELECT session, count(*) FILTER (kind = 'hit') AS observed, count(*) FILTER (kind = 'bounce' AND p IS NULL) + count(*) FILTER (kind = 'bounce' AND p.k = 'bounce' AND NOT p.n AND (near OR half <> p.h)) AS inferred,
count(*) FILTER (kind = 'bounce' AND p.k = 'bounce' AND p.n) + count(*) FILTER (kind = 'kink' AND p IS NOT NULL AND q IS NOT NULL) + coalesce(bool_or(kind = 'kink' AND p IS NOT NULL AND q IS NULL), false)::BIGINT AS ambiguous FROM y GROUP BY session""")
def stroke_counts(read):
    c = contacts(read).withColumn("kind", F.when(F.col("kind") == "net", "kink").otherwise(F.col("kind"))).withColumn("net_m", F.col("k") / 20)
    return rally.stroke_counts(c, "session", "t", "kind", "half", "net_m")


@query(f"""WITH {C}, l AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'near' ELSE 'far' END AS own, max(t) FILTER (kind = 'hit') OVER (PARTITION BY session) AS lh FROM c), a AS (SELECT * FROM l WHERE lh IS NULL OR t > lh),
b AS (SELECT session, list({{'half': half, 'verdict': verdict, 'own': own}} ORDER BY t) AS b FROM a WHERE kind = 'bounce' GROUP BY session), n AS (SELECT session, bool_or(kind = 'net') AS net FROM a GROUP BY session)
SELECT session, CASE WHEN net THEN 'net' WHEN b IS NULL THEN 'timeout' WHEN b[1].half = b[1].own THEN 'net' WHEN b[1].verdict = 'out' THEN 'ball_out' WHEN b[1].half = b[2].half THEN 'double_bounce' ELSE 'lost_track' END AS reason
FROM (SELECT DISTINCT session FROM c) LEFT JOIN n USING (session) LEFT JOIN b USING (session)""")
def rally_end_reason(read):
    c = contacts(read).withColumn("own", F.when(F.col("k") % 3 == 0, "near").otherwise("far"))
    return rally.end_reason(c, "session", "t", "kind", "half", "verdict", "own")


@query()
def split_at_point_ends(read):
    c = contacts(read).withColumn("ends", (F.col("kind") == "net") | (F.col("verdict") == "out"))
    return rally.split_at_point_ends(c, "session", "t", "kind", "ends", 20000.0).select("session", "frame", "point")


@query(f"""WITH {C}, x AS (SELECT a.session, a.frame, b.frame AS id, abs(a.t - b.t) AS gap, b.t AS bt FROM c a JOIN c b ON a.session = b.session AND b.kind = 'net' AND abs(a.t - b.t) <= 36000 WHERE a.kind = 'bounce'),
m AS (SELECT session, frame, arg_min(id, {{'g': gap, 't': bt}}) AS nearest_id, min(gap) AS gap FROM x GROUP BY ALL) SELECT c.session, c.frame, nearest_id, round(gap, 6) AS gap FROM c LEFT JOIN m USING (session, frame) WHERE c.kind = 'bounce'""")
def nearest_event(read):
    c = contacts(read)
    return rally.nearest(c.where("kind = 'bounce'").select("session", "frame", "t"), c.where("kind = 'net'"), "session", "t", "t", 36000.0, "frame").select("session", "frame", "nearest_id", "gap")


@query(f"""WITH {C}, g AS (SELECT session, frame, value / 10 - 5 AS x, k / 8 AS y, 0.05 + k / 200 AS s FROM c),
m AS (SELECT *, x + 4.115 + 0.02 AS d1, 4.115 - x + 0.02 AS d2, y + 0.02 AS d3, 11.885 - y + 0.02 AS d4 FROM g)
SELECT session, frame, CASE WHEN least(d1, d2, d3, d4) < -1.96 * s THEN 'out' WHEN least(d1, d2, d3, d4) >= 1.96 * s THEN 'in' ELSE 'too_close' END AS verdict, round(least(d1, d2, d3, d4), 6) AS margin FROM m""")
def line_call(read):
    g = contacts(read).select("session", "frame", (F.col("value") / 10 - 5).alias("x"), (F.col("k") / 8).alias("y"), (0.05 + F.col("k") / 200).alias("s"))
    verdict, margin = court.line_call(F.col("x"), F.col("y"), F.col("s"), F.col("s"), (-court.SINGLES_HALF, court.SINGLES_HALF, 0.0, court.HALF_LENGTH))
    return g.select("session", "frame", verdict.alias("verdict"), margin.alias("margin"))


@query(f"WITH {C} SELECT session, frame, CASE WHEN k / 7 <= 6.40 THEN 'short' WHEN k / 7 <= 9.1425 THEN 'mid' WHEN k / 7 <= 11.885 THEN 'deep' ELSE 'beyond' END AS depth, CASE WHEN value / 10 - 5 < -8.23 / 6 THEN 'left' WHEN value / 10 - 5 <= 8.23 / 6 THEN 'centre' ELSE 'right' END AS width FROM c")
def depth_zone(read):
    return contacts(read).select("session", "frame", court.depth_zone(F.col("k") / 7).alias("depth"), court.width_zone(F.col("value") / 10 - 5).alias("width"))


@query(f"""WITH {C}, z(depth) AS (VALUES ('short'), ('mid'), ('deep'), ('beyond')), d AS (SELECT session, CASE WHEN k / 7 <= 6.40 THEN 'short' WHEN k / 7 <= 9.1425 THEN 'mid' WHEN k / 7 <= 11.885 THEN 'deep' ELSE 'beyond' END AS depth FROM c), g AS (SELECT session, depth, count(*) AS n FROM d GROUP BY ALL)
SELECT session, depth, coalesce(n, 0) AS n FROM (SELECT DISTINCT session FROM c) CROSS JOIN z LEFT JOIN g USING (session, depth)""")
def shot_map(read):
    c = contacts(read).select("session", court.depth_zone(F.col("k") / 7).alias("depth"))
    zones = c.sparkSession.createDataFrame([(z,) for z in court.DEPTH_ZONES], "depth string")
    return court.shot_map(c, "session", "depth", zones)


def normal_sql(z: str) -> str:
    """The normal distribution function in SQL: Abramowitz and Stegun 26.2.17, as the operator has it."""
    t = f"(1.0::DOUBLE / (1.0 + 0.2316419 * abs({z})))"
    poly = f"{t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    return f"CASE WHEN {z} >= 0 THEN 1.0 - 0.3989422804014327::DOUBLE * exp(-{z} * {z} / 2.0) * {poly} ELSE 0.3989422804014327::DOUBLE * exp(-{z} * {z} / 2.0) * {poly} END"


_BELOW = ", ".join(f"CASE WHEN s > 0 THEN {normal_sql(f'((({c} - d) / s)::DOUBLE)')} ELSE (d <= {c})::INT END AS b{j}" for j, c in enumerate((6.4, 9.1425, 11.885)))


@query(f"WITH {C}, p AS (SELECT session, frame, k / 7 AS d, value / 100 AS s FROM c), b AS (SELECT session, frame, {_BELOW} FROM p) SELECT session, frame, round(b0, 6) AS short, round(b1 - b0, 6) AS mid, round(b2 - b1, 6) AS deep, round(1.0 - b2, 6) AS beyond FROM b")
def depth_probabilities(read):
    p = court.depth_probabilities(F.col("k") / 7, F.col("value") / 100)
    return contacts(read).select("session", "frame", *(v.alias(k) for k, v in p.items()))


@query(f"""WITH {C}, m AS (SELECT session, sqrt(power(value / 100, 2) + power(k / 100, 2)) AS s, k FROM c), g AS (SELECT session, count(*) AS samples, quantile_cont(s, 0.95) / 1280.0 AS p, sqrt(avg(s * s)) AS rms, median(k) AS f FROM m GROUP BY session)
SELECT session, samples, CASE WHEN samples < 2 OR f < 30 THEN 'unknown' WHEN p <= 0.001 THEN 'stable' WHEN p <= 0.003 THEN 'shaky' ELSE 'moving' END AS verdict, CASE WHEN samples >= 2 AND f >= 30 THEN round(p, 6) END AS p95_fraction, CASE WHEN samples >= 2 AND f >= 30 THEN round(rms, 6) END AS rms, NULL::DOUBLE AS bumped_at FROM g""")
def camera_stability(read):
    c = contacts(read).select("session", "t", (F.col("value") / 100).alias("dx"), (F.col("k") / 100).alias("dy"), "k")
    return court.camera_stability(c, "session", "t", "dx", "dy", "k", 1280.0)


@query(f"WITH {C} SELECT session, frame FROM c QUALIFY row_number() OVER (PARTITION BY session, floor(t / 86400) ORDER BY t, frame) = 1")
def camera_sampler(read):
    return court.sampler(contacts(read), "session", "t", 86400.0, "frame").select("session", "frame")


@query(f"WITH {C}, d AS (SELECT session, t - lag(t) OVER (PARTITION BY session ORDER BY t) AS d FROM c) SELECT session, round(1 / nullif(median(d), 0) * 1000, 6) AS fps FROM d GROUP BY session")
def median_fps(read):
    return court.fps(contacts(read), "session", "t").withColumn("fps", F.col("fps") * 1000)


@query(f"""WITH {C}, p AS (SELECT *, lead(kind) OVER w AS nk, lead(half) OVER w AS nh, lead(t) OVER w AS nt FROM c WHERE kind <> 'net' WINDOW w AS (PARTITION BY session ORDER BY t))
SELECT session, frame FROM p WHERE kind = 'bounce' AND verdict = 'out' AND nk = 'bounce' AND nh <> half AND nt - t <= 36000""")
def out_then_played(read):
    return court.out_then_played(contacts(read), "session", "t", "kind", "half", "verdict", 36000.0).select("session", "frame")


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings) SELECT vec_id, round((1.2 * x + 0.1 * y + 3) / nullif(0.01 * x + 0.02 * y + 1, 0), 6) AS u, round((0.05 * x + 0.9 * y - 2) / nullif(0.01 * x + 0.02 * y + 1, 0), 6) AS v FROM p""")
def homography(read):
    p = read("embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 10).alias("x"), (F.col("embedding")[1].cast("double") * 10).alias("y"))
    u, v = court.homography((1.2, 0.1, 3.0, 0.05, 0.9, -2.0, 0.01, 0.02, 1.0), F.col("x"), F.col("y"))
    return p.select("vec_id", u.alias("u"), v.alias("v"))


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings)
SELECT vec_id, round(degrees(acos(greatest(-1, least(1, (a * c + b * d) / nullif(sqrt(a * a + b * b) * sqrt(c * c + d * d), 0))))), 6) AS angle FROM p""")
def joint_angle(read):
    v = [F.col("embedding")[k].cast("double") for k in range(4)]
    return read("embeddings").select("vec_id", angle_deg(*v).alias("angle"))


# match score --------------------------------------------------------------------------------------


@query()
def score_replay(read):
    e = swings(read).select("session", "frame", F.when(F.col("kind") == "error", None).when(F.col("value") < 25, "A").otherwise("B").alias("winner"))
    return match.replay(e, "session", "frame", "winner")


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id AS id, CASE WHEN event_type = 'view' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS up, CASE WHEN event_type IN ('view', 'click') THEN 'user' ELSE 'inferred' END AS source FROM events),
h AS (SELECT user_id, id, id AS head FROM s WHERE up IS NULL UNION ALL SELECT s.user_id, s.id, h.head FROM s JOIN h ON s.user_id = h.user_id AND s.up = h.id),
r AS (SELECT h.user_id, h.id, head, row_number() OVER (PARTITION BY h.user_id, head ORDER BY source = 'user' DESC, h.id DESC) AS rn FROM h JOIN s ON s.id = h.id) SELECT user_id, id, head AS slot FROM r WHERE rn = 1""")
def effective_events(read):
    prior = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = read("events").select("user_id", F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", prior).alias("up"), F.when(F.col("event_type").isin("view", "click"), "user").otherwise("inferred").alias("source"))
    return match.effective_events(e.withColumn("seq", F.col("id")), "user_id", "id", "seq", "up", "source").select("user_id", "id", "slot")


# text ---------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[-+]?\p{Nd}+(?:\.\p{Nd}+)?%?'))::BIGINT AS n, regexp_extract_all(text, '[-+]?\p{Nd}+(?:\.\p{Nd}+)?%?')[1] AS first FROM documents")
def numeric_tokens(read):
    t = textguard.numeric_tokens(F.col("text"))
    return read("documents").select("doc_id", F.size(t).cast("long").alias("n"), F.try_element_at(t, F.lit(1)).alias("first"))


@query("SELECT conv_id, turn, array_to_string(list_sort(list_filter(['km/h', 'm/s', 'kph', 'rpm', 'rally', 'spin rate', 'revolutions', 'meters', 'metres', 'feet', 'inches', 'on the'], lambda w: contains(lower(text), w))), ',') AS found FROM conversations")
def banned_terms(read):
    return read("conversations").select("conv_id", "turn", F.array_join(textguard.banned(F.col("text"), (*textguard.BANNED_UNITS, "on the")), ",").alias("found"))


@query(r"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '[-+]?\p{Nd}+(?:\.\p{Nd}+)?%?'), lambda x: x NOT IN ('1', '2', '3', '4', '5', '7', '7.0', '7.00'))))::BIGINT AS n FROM documents")
def guard_violations(read):
    allowed = textguard.allowlist(F.array(F.lit(7.0)))
    return read("documents").select("doc_id", F.size(F.array_except(textguard.numeric_tokens(F.col("text")), allowed)).cast("long").alias("n"))


@query("WITH x AS (SELECT event_type, user_id, value FROM events) SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 6) AS click, round(sum(value) FILTER (event_type = 'view'), 6) AS view, round(sum(value) FILTER (event_type = 'error'), 6) AS error FROM x GROUP BY user_id")
def stage_timings(read):
    return textguard.stage_timings(read("events"), "user_id", "event_type", "value", ["click", "view", "error"])


@query("WITH s AS (SELECT user_id, list_sort(list(value)) AS s FROM events GROUP BY user_id) SELECT user_id, round(s[(len(s) + 1) // 2], 6) AS median_low FROM s")
def median_low(read):
    return textguard.median_low(read("events"), "user_id", "value")
