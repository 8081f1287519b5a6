"""Point-in-time universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import average_rank, change
from .sliding import Row, quantile, slide


def pit_universe(panel: DataFrame, *, min_traded_value: float = 5e7, min_price: float = 20.0, min_listed_days: int = 126, liquidity_window: int = 63, top_n: int = 500) -> DataFrame:
    """median_traded_value, listed_days, liquidity_rank and in_universe for every bar, from what its date knows.

    The rank is taken among eligible names only; equal medians go by symbol."""
    w = Window.partitionBy("trade_date", "eligible").orderBy(F.desc("median_traded_value"), "symbol")
    told = slide(panel, {"median_traded_value": ("traded_value", quantile(liquidity_window)), "listed_days": ("traded_value", Row)})
    base = told.withColumn("listed_days", F.col("listed_days").cast("int"))
    ok = (F.col("median_traded_value") >= min_traded_value) & (F.col("listed_days") >= min_listed_days) & (F.col("close") >= min_price)
    ranked = base.withColumn("eligible", F.coalesce(ok, F.lit(False))).withColumn("liquidity_rank", F.when(F.col("eligible"), F.row_number().over(w)))
    return ranked.withColumn("in_universe", F.coalesce(F.col("liquidity_rank") <= top_n, F.lit(False))).drop("eligible")


def survivors(panel: DataFrame, *, days: int = 30) -> DataFrame:
    """Rows of names that still trade within `days` of the panel's end: the biased filter that a point-in-time universe avoids."""
    end = panel.agg(F.max("trade_date").alias("end"))
    alive = panel.groupBy("symbol").agg(F.max("trade_date").alias("last")).join(F.broadcast(end)).where(F.col("last") >= F.date_sub("end", days))  # `end` is one row
    return panel.join(alive.select("symbol"), "symbol", "left_semi")


def ticker_screen(panel: DataFrame, *, tail: int = 21, min_rows: int = 252) -> DataFrame:
    """Names by a composite of liquidity, history and calmness ranks (0.4, 0.4, 0.2), among the liquid half with mid-band volatility."""
    last = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    rows = panel.withColumns({"ret": change("close"), "back": F.row_number().over(last)})
    stats = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("ret").alias("vol"), F.percentile(F.when(F.col("back") <= tail, F.col("traded_value")), F.lit(0.5)).alias("liquidity"),
    ).where(F.col("n") >= min_rows)
    bands = stats.agg(F.percentile("liquidity", F.lit(0.5)).alias("liquid"), F.percentile("vol", F.lit(0.25)).alias("low"), F.percentile("vol", F.lit(0.75)).alias("high"))
    kept = stats.join(F.broadcast(bands)).where("liquidity >= liquid and vol between low and high")  # `bands` is one row
    one = kept.withColumn("all", F.lit(1))
    score = 0.4 * average_rank("liquidity", "all") + 0.4 * average_rank("n", "all") + 0.2 * average_rank(-F.col("vol"), "all")
    return one.withColumn("score", score).select("symbol", "n", "vol", "liquidity", "score")
