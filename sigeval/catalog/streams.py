"""Streaming queries: events that arrive by instalments, a tenth of them one instalment late."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigeval.catalog import fixtures as fx
from sigeval.catalog.registry import query, seed32
from sigeval.functions.columns import stable_seed
from sigeval.session import stage
from sigeval.streaming import live as L

INSTALMENTS = range(5)
DELAY = "2 hours"


def events(spark, d):
    """Events of one user parity are positives; eight days of a month make an instalment."""
    slot = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)) + (stable_seed("event_id") % 10 == 0).cast("int")
    e = fx.table(spark, d, "events").where("ts IS NOT NULL")
    return stage(
        e.select(
            F.col("user_id").alias("rec"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"), F.col("value").alias("score"),
            (F.col("user_id") % 2).alias("label"), slot.cast("int").alias("part"),
        )
    )


def named(t, *rest):
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), *rest)


# a row counts in a window unless the watermark of earlier instalments has passed the window's end
ARRIVED = f"""ev AS (SELECT user_id AS rec, ts, value AS v, user_id % 2 AS label,
    least((day(ts) - 1) // 8, 3) + CASE WHEN {seed32("cast(event_id AS varchar)")} % 10 = 0 THEN 1 ELSE 0 END AS part FROM events WHERE ts IS NOT NULL),
  tops AS (SELECT part, max(ts) AS top FROM ev GROUP BY part),
  marks AS (SELECT part, max(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOUR AS mark FROM tops),
  hourly AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS s FROM ev JOIN marks USING (part)),
  kept AS (SELECT *, mark IS NULL OR s + INTERVAL 1 HOUR > mark AS ok FROM hourly)"""
START = "strftime(s, '%Y-%m-%d %H:%M:%S') AS start"


@query(
    "stream_confusion",
    f"""WITH {ARRIVED} SELECT {START}, count(*) FILTER (WHERE label = 1 AND v >= 50) AS tp, count(*) FILTER (WHERE label = 0 AND v < 50) AS tn,
        count(*) FILTER (WHERE label = 0 AND v >= 50) AS fp, count(*) FILTER (WHERE label = 1 AND v < 50) AS fn FROM kept WHERE ok GROUP BY s""",
)
def _(spark, d):
    t = L.by_instalments(events(spark, d), INSTALMENTS, "part", "ts", lambda x: L.stream_confusion(x, "ts", "1 hour", DELAY, 50.0))
    return named(t, "tp", "tn", "fp", "fn")


@query(
    "stream_windows",
    f"""WITH {ARRIVED}, sl AS (SELECT rec, v, mark, s FROM (SELECT *, unnest([0, 2, 4]) AS back FROM (SELECT rec, ts, v, mark FROM hourly)) x,
          LATERAL (SELECT time_bucket(INTERVAL 2 HOUR, x.ts) - to_hours(x.back) AS s))
        SELECT rec, {START}, count(*) AS n, round(avg(v), 6) AS mean, round(max(abs(v)), 6) AS peak FROM sl
        WHERE mark IS NULL OR s + INTERVAL 6 HOUR > mark GROUP BY rec, s""",
)
def _(spark, d):
    t = L.by_instalments(events(spark, d), INSTALMENTS, "part", "ts", lambda x: L.stream_windows(x, "ts", "6 hours", "2 hours", DELAY))
    return named(t, "rec", "n", F.round("mean", 6).alias("mean"), F.round("peak", 6).alias("peak"))


@query(
    "stream_late",
    f"WITH {ARRIVED} SELECT {START}, count(*) AS arrived, count(*) FILTER (WHERE ok) AS counted, count(*) FILTER (WHERE NOT ok) AS late FROM kept GROUP BY s",
)
def _(spark, d):
    e = events(spark, d)
    t = L.by_instalments(e, INSTALMENTS, "part", "ts", lambda x: L.stream_confusion(x, "ts", "1 hour", DELAY, 50.0))
    counted = t.select("start", (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n"))
    return named(L.late_rows(e, counted, "ts", "1 hour"), "arrived", "counted", "late")
