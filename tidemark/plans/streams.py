"""Streaming queries: each drains a stream over the events table and returns what its sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import rounded, safe_div
from ..functions.temporal import next_session_of
from ..session import shared_dir
from ..sources import views
from ..streaming import jobs
from .events import event_calendar
from .registry import TABLES, query


def _drained(spark, sf_dir, build, mode):
    schema = views.read(spark, sf_dir, "events").schema
    root = f"{shared_dir(spark)}/tidemark-stream-{uuid.uuid4().hex}"
    jobs.drain(build(jobs.source(spark, f"{sf_dir}/events.parquet", schema)), f"{root}/out", f"{root}/state", mode=mode)
    out = spark.read.parquet(f"{root}/out")
    if mode == "complete":  # the last batch holds the whole table
        out = out.join(out.agg(F.max("batch").alias("batch")), "batch", "left_semi")
    return out.drop("batch")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return _drained(spark, sf_dir, jobs.tumbling, "complete").select(F.to_date("window.start").alias("day"), "event_type", "n", rounded("total", 4).alias("total"))


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day FROM events) SELECT CAST(day - k AS DATE) AS first_day, count(*) AS n FROM d, (SELECT unnest(range(7))::INTEGER AS k) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    return _drained(spark, sf_dir, jobs.sliding, "complete").select(F.to_date("window.start").alias("first_day"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k) GROUP BY user_id""")
def stream_session(spark, sf_dir):
    return _drained(spark, sf_dir, jobs.sessions, "complete").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_dedupe(spark, sf_dir):
    twice = lambda rows: jobs.deduplicated(rows.withColumn("_again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_again"))
    return _drained(spark, sf_dir, twice, "append").select("event_id", "user_id")


@query("SELECT event_id, knowable_date FROM knowable")
def stream_knowable(spark, sf_dir):
    days = views.read(spark, sf_dir, "events").select(F.explode(F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), 1))).alias("day")).distinct()
    calendar = next_session_of(days, event_calendar(spark, sf_dir), "day").withColumnRenamed("_next", "session")
    return _drained(spark, sf_dir, lambda rows: jobs.knowable(rows, calendar), "append").select("event_id", "knowable_date")


@query("SELECT user_id, count(*) AS n, round(coalesce(max(gap), 0), 2) AS longest_gap_s FROM (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) GROUP BY user_id")
def stream_heartbeat(spark, sf_dir):
    """The stateful operator's last word on each key."""
    from ..workers import ship

    ship(spark)
    out = _drained(spark, sf_dir, jobs.heartbeat, "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), rounded(F.max("longest_gap_s"), 2).alias("longest_gap_s"))


TABLES["stream_orders"] = "SELECT event_id AS order_id, ts AS ordered_at, 1 + event_id % 9 AS quantity, value AS price FROM events WHERE event_id % 2 = 0"
TABLES["stream_fills"] = """SELECT order_id, ordered_at + to_minutes(CAST(order_id * 37 % 180 AS INTEGER)) AS filled_at, quantity AS fill_quantity, price * (1 + (order_id % 11 - 5) / 1000.0) AS fill_price FROM stream_orders WHERE order_id % 10 <> 0"""


@query("""SELECT o.order_id, CAST(count(f.order_id) AS BIGINT) AS n_fills, round(coalesce(max(epoch(f.filled_at) - epoch(o.ordered_at)), -1), 2) AS delay_s, round(avg((f.fill_price / o.price - 1) * 1e4), 4) + 0.0 AS slippage_bps
    FROM stream_orders o LEFT JOIN stream_fills f ON f.order_id = o.order_id AND f.filled_at BETWEEN o.ordered_at AND o.ordered_at + INTERVAL 2 HOURS GROUP BY o.order_id""")
def stream_order_fills(spark, sf_dir):
    """Orders and fills, two streams of the events table, joined as they come: fills of more than two hours later do not count. Orders that are open when
    the streams are drained are told as unfilled."""

    def build(rows):
        orders = rows.where("event_id % 2 = 0").select(F.col("event_id").alias("order_id"), F.col("ts").alias("ordered_at"), (1 + F.col("event_id") % 9).alias("quantity"), F.col("value").alias("price"))
        fills = orders.where("order_id % 10 <> 0").select("order_id", (F.col("ordered_at") + F.make_dt_interval(mins=(F.col("order_id") * 37 % 180).cast("int"))).alias("filled_at"), F.col("quantity").alias("fill_quantity"), (F.col("price") * (1 + (F.col("order_id") % 11 - 5) / 1000.0)).alias("fill_price"))
        return jobs.order_fills(orders, fills)

    told = _drained(spark, sf_dir, build, "append")
    every = views.read(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("order_id"))
    delay = F.unix_micros(F.col("filled_at")) / 1e6 - F.unix_micros(F.col("ordered_at")) / 1e6
    ratio = F.coalesce(safe_div("fill_price", "price"), F.col("fill_price") * float("inf"))  # as in SQL, NaN for an order at price 0 that fills at 0
    filled = told.where("filled_at is not null").groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.max(delay).alias("d"), F.avg((ratio - 1) * 1e4).alias("s"))
    return every.join(filled, "order_id", "left").select("order_id", F.coalesce("n", F.lit(0)).alias("n_fills"), rounded(F.coalesce("d", F.lit(-1.0)), 2).alias("delay_s"), rounded("s", 4).alias("slippage_bps"))
