"""Ranks over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .expr import safe_div

BUCKETS = 1024


def global_rank(df: DataFrame, value: str, *ties: str, name: str = "rank") -> DataFrame:
    """The row's number from 1 in the order of value (null last) and ties.

    Rows are dealt into BUCKETS equal ranges of the value; a row's rank is its number within its bucket plus the rows of lower
    buckets, whose counts are one short table."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.floor(safe_div((F.col(value) - F.col("_lo")) * BUCKETS, F.col("_hi") - F.col("_lo")))
    dealt = df.join(F.broadcast(bounds)).withColumn("_bucket", F.when(F.col(value).isNull(), BUCKETS + 1).otherwise(F.coalesce(F.least(place, F.lit(BUCKETS)), F.lit(0)))).drop("_lo", "_hi")  # one row
    counts = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    lower = counts.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # BUCKETS + 2 rows at most
    within = Window.partitionBy("_bucket").orderBy(value, *ties)
    return dealt.withColumn("_k", F.row_number().over(within)).join(F.broadcast(lower), "_bucket").withColumn(name, F.col("_k") + F.col("_before")).drop("_bucket", "_k", "_before")
