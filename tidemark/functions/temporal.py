"""Sessions, weekly grids, as-of joins and knowability dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE_MINUTE = 15 * 60 + 30


def sessions(panel: DataFrame, date: str = "trade_date") -> DataFrame:
    """The distinct dates with their index from 0. The calendar is observed, never assumed; it has one row a session."""
    return panel.select(date).distinct().withColumn("idx", (F.row_number().over(Window.orderBy(date)) - 1).cast("long"))


def weekly_grid(calendar: DataFrame, date: str = "trade_date") -> DataFrame:
    """The last session of each ISO week."""
    return calendar.groupBy(F.date_trunc("week", date).alias("_week")).agg(F.max(date).alias(date)).drop("_week")


def neighbours(calendar: DataFrame, date: str = "trade_date") -> DataFrame:
    """Each session with the previous and next one."""
    w = Window.orderBy(date)
    return calendar.select(date, F.lag(date).over(w).alias("prev_session"), F.lead(date).over(w).alias("next_session"))


def _asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], forward: bool) -> DataFrame:
    """Each left row with the columns of the nearest right row of its keys at or before (after) its time.

    Both sides are unioned and carried along one sorted window: one shuffle, no range join. `right` has one row per key and time."""
    own = left.columns
    payload = F.struct(F.col(right_time).alias("_at"), *columns)
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_time).cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_pay"))
    b = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_time).cast("timestamp_ntz").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), payload.alias("_pay"))
    order = F.col("_t").desc() if forward else F.col("_t").asc()
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_hit", F.last("_pay", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_row.*", F.col("_hit._at").alias(f"{right_time}_matched" if right_time in own else right_time), *[F.col(f"_hit.{c}") for c in columns])


def asof_backward(left, right, keys, left_time, right_time, columns):
    return _asof(left, right, keys, left_time, right_time, columns, forward=False)


def asof_forward(left, right, keys, left_time, right_time, columns):
    return _asof(left, right, keys, left_time, right_time, columns, forward=True)


def knowable_dates(events: DataFrame, calendar: DataFrame, announced_at: str = "announced_at", date: str = "trade_date", *, beyond: str = "drop") -> DataFrame:
    """Events with knowable_date: their own day if it is a session and they came before the close, else the next session.

    Events beyond the calendar drop, or raise with beyond="raise". The calendar is one short row a session, so its snap table is joined by day."""
    day = F.to_date(announced_at)
    minute = F.hour(announced_at) * 60 + F.minute(announced_at)
    start = F.when(minute < CLOSE_MINUTE, day).otherwise(F.date_add(day, 1))
    nearest = next_session_of(events.select(start.alias("_start")).distinct(), calendar, "_start", date)
    known = events.withColumn("_start", start).join(nearest, "_start", "left" if beyond == "raise" else "inner")
    if beyond == "raise":
        known = known.withColumn("_next", F.when(F.col("_next").isNull() & F.col("_start").isNotNull(), F.raise_error(F.concat(F.lit("no session at or after "), F.col("_start").cast("string"))).cast("date")).otherwise(F.col("_next")))
    return known.drop("_start").withColumnRenamed("_next", "knowable_date")


def next_session_of(days: DataFrame, calendar: DataFrame, day: str, date: str = "trade_date") -> DataFrame:
    """Distinct days with _next, the first session at or after each; days beyond the calendar drop."""
    both = days.select(F.col(day).alias("_d"), F.lit(1).alias("_side")).unionByName(calendar.select(F.col(date).alias("_d"), F.lit(0).alias("_side")))
    w = Window.orderBy(F.desc("_d"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_next", F.last(F.when(F.col("_side") == 0, F.col("_d")), ignorenulls=True).over(w))
    return hit.where("_side = 1 and _next is not null").select(F.col("_d").alias(day), "_next")


def fiscal_year(d: Column | str) -> Column:
    """The year in which the fiscal year that starts in April began."""
    d = F.col(d) if isinstance(d, str) else d
    return (F.year(d) - F.when(F.month(d) < 4, 1).otherwise(0)).cast("int")


def date_spine(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """Every calendar day from first to last."""
    return bounds.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias("day"))
