"""Structured Streaming jobs over announcements: windowed counts, sessions, idempotent orders and knowability."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.temporal import CLOSE_MINUTE


def source(spark: SparkSession, path: str, schema, time: str = "ts") -> DataFrame:
    """A file stream with its event time as a timestamp, which watermarks need. path may be one file or a folder."""
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(rows: DataFrame, *, size: str = "1 day", late: str = "1 day", key: str = "event_type", time: str = "ts") -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(rows: DataFrame, *, size: str = "7 days", step: str = "1 day", late: str = "1 day", time: str = "ts") -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.window(time, size, step)).agg(F.count(F.lit(1)).alias("n"))


def sessions(rows: DataFrame, *, gap: str = "6 hours", late: str = "1 hour", key: str = "user_id", time: str = "ts") -> DataFrame:
    """Runs of a key's rows with gaps under `gap`."""
    return rows.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(rows: DataFrame, *, key: str = "event_id", late: str = "2 days", time: str = "ts") -> DataFrame:
    """The first row of each key within the watermark: orders are taken once however often they are sent."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def knowable(rows: DataFrame, calendar: DataFrame, time: str = "ts") -> DataFrame:
    """Stream-static join with the day each announcement becomes known: late ones roll to the next session.

    calendar: day, session (the first session at or after the day)."""
    minute = F.hour(time) * 60 + F.minute(time)
    day = F.when(minute < CLOSE_MINUTE, F.to_date(time)).otherwise(F.date_add(F.to_date(time), 1))
    return rows.withColumn("day", day).join(calendar, "day").drop("day").withColumnRenamed("session", "knowable_date")


def heartbeat(rows: DataFrame, *, key: str = "user_id", time: str = "ts") -> DataFrame:
    """Per key the running count and the longest silence so far, by a stateful operator: (key, n, longest_gap_s) on every batch."""
    kind = rows.schema[key].dataType.simpleString()

    def step(k, batches, state: GroupState):
        n, last, longest = state.get if state.exists else (0, None, 0.0)
        times = sorted(t.timestamp() for b in batches for t in b[time])
        for t in times:
            if last is not None:
                longest = max(longest, t - last)
            last = t if last is None else max(last, t)
        n += len(times)
        state.update((n, last, longest))
        yield pd.DataFrame({key: [k[0]], "n": [n], "longest_gap_s": [longest]})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, longest_gap_s double", "n long, last double, longest double", "update", GroupStateTimeout.NoTimeout)


def order_fills(orders: DataFrame, fills: DataFrame, *, within: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Each order with its fills of at most `within` after it: (order_id, ordered_at, quantity, price, filled_at, fill_quantity, fill_price), fills null for
    an order that none came for in time.

    orders: order_id, ordered_at, quantity, price; fills: order_id, filled_at, fill_quantity, fill_price. Both are watermarked by `late`: a fill that
    arrives later than that is not taken, and state is kept for within + late only. An unfilled order is told once no fill can come any more."""
    o = orders.withWatermark("ordered_at", late)
    f = fills.select(F.col("order_id").alias("_of"), "filled_at", "fill_quantity", "fill_price").withWatermark("filled_at", late)
    near = (F.col("order_id") == F.col("_of")) & (F.col("filled_at") >= F.col("ordered_at")) & (F.col("filled_at") <= F.col("ordered_at") + F.expr(f"INTERVAL {within}"))
    return o.join(f, near, "left_outer").drop("_of")


def drain(stream: DataFrame, out: str, checkpoint: str, *, mode: str = "append") -> None:
    """Runs the stream over what is there and stops; the sink is a folder of Parquet files, batch by batch."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
