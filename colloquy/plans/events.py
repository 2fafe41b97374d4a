"""Queries over events: histograms, bursts, recovery cycles, semi-structured fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal
from ..session import table
from .catalogue import query
from .shared_sql import quantile


def _hours(offset: int) -> str:
    return f"SELECT h::int AS hour, coalesce(n, 0) AS n FROM range(24) r(h) LEFT JOIN (SELECT extract(hour FROM ts + INTERVAL {offset} HOUR) AS hr, count(*) AS n FROM events GROUP BY 1) ON h = hr"


@query("hour_histogram", _hours(0))
def hour_histogram(spark, d):
    return temporal.hour_histogram(table(spark, d, "events"))


@query("tz_shifted_histogram", _hours(9))
def tz_shifted_histogram(spark, d):
    return temporal.hour_histogram(table(spark, d, "events"), offset_hours=9)


@query("dow_histogram", "SELECT k::int AS day, coalesce(n, 0) AS n FROM range(7) r(k) LEFT JOIN (SELECT isodow(ts) - 1 AS w, count(*) AS n FROM events GROUP BY 1) ON k = w")
def dow_histogram(spark, d):
    return temporal.day_histogram(table(spark, d, "events"))


@query(
    "peak_hour_day",
    """WITH h AS (SELECT extract(hour FROM ts)::int AS s, count(*) AS n, min(ts) AS f FROM events GROUP BY 1 ORDER BY n DESC, f LIMIT 1), w AS (SELECT (isodow(ts) - 1)::int AS s, count(*) AS n, min(ts) AS f FROM events GROUP BY 1 ORDER BY n DESC, f LIMIT 1)
       SELECT h.s AS peak_hour, h.n AS peak_hour_n, w.s AS peak_day, w.n AS peak_day_n FROM h, w""",
)
def peak_hour_day(spark, d):
    return temporal.peaks(table(spark, d, "events"))


@query("activity_range", "SELECT count(ts) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def activity_range(spark, d):
    return temporal.activity_range(table(spark, d, "events"))


def _burst_sql(minutes: int, part: str) -> str:
    over = f"OVER ({part} ORDER BY ts, event_id)"
    key = "user_id, " if part else ""
    return f"""g AS (SELECT {key}ts, event_id, CASE WHEN lag(ts) {over} IS NULL OR ts - lag(ts) {over} > INTERVAL {minutes} MINUTE THEN 1 ELSE 0 END AS f FROM events),
        b AS (SELECT {key}sum(f) {over} AS burst FROM g), s AS (SELECT {key}burst, count(*) AS size FROM b GROUP BY ALL)"""


_SIZES = f"SELECT count(*) AS n, {quantile('size', 0.5)} AS p50_size, {quantile('size', 0.9)} AS p90_size, coalesce(max(size), 0)::bigint AS max_size FROM s"


@query("work_bursts", f"WITH {_burst_sql(5, '')} {_SIZES}")
def work_bursts(spark, d):
    return temporal.size_stats(temporal.bursts(table(spark, d, "events"), gap_minutes=5), "size", 0.5, 0.9)


@query("work_bursts_by_user", f"WITH {_burst_sql(120, 'PARTITION BY user_id')} {_SIZES}")
def work_bursts_by_user(spark, d):
    return temporal.size_stats(temporal.bursts_by(table(spark, d, "events"), "user_id"), "size", 0.5, 0.9)


@query(
    "recovery_cycles",
    f"""WITH i AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'b' WHEN 'purchase' THEN 'e' END AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        m AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY i) AS p FROM i WHERE c IS NOT NULL),
        s AS (SELECT *, last_value(CASE WHEN c = 'b' AND (p IS NULL OR p = 'e') THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i) AS b FROM m),
        t AS (SELECT (i - b) AS turns FROM s WHERE c = 'e' AND p = 'b')
        SELECT count(*) AS n, {quantile('turns', 0.5)} AS p50_turns, {quantile('turns', 0.75)} AS p75_turns, {quantile('turns', 0.9)} AS p90_turns, coalesce(max(turns), 0)::bigint AS max_turns FROM t""",
)
def recovery_cycles(spark, d):
    cycles = temporal.recovery_cycles(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase")
    return temporal.size_stats(cycles, "turns", 0.5, 0.75, 0.9)


@query("variant_extract", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::bigint AS total, count(*) AS n FROM events GROUP BY event_type")
def variant_extract(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))
