"""Data-quality checks: structural errors block, the others warn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-6
OUTLIER = 0.30
THIN = 0.5


def structural(panel: DataFrame) -> DataFrame:
    """One row with the counts of rows that break each structural rule, and of duplicate keys."""
    low, high, close = F.col("low"), F.col("high"), F.col("close")
    rules = {
        "non_positive_price": (F.col("open") <= 0) | (high <= 0) | (low <= 0) | (close <= 0), "high_below_low": high < low - TOLERANCE,
        "close_outside_range": (close > high + TOLERANCE) | (close < low - TOLERANCE), "negative_volume": F.col("volume") < 0,
    }
    keys = panel.groupBy("symbol", "trade_date").agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(r).alias(n) for n, r in rules.items()])
    return keys.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in rules], F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"))


def return_outliers(panel_returns: DataFrame, limit: float = OUTLIER) -> DataFrame:
    return panel_returns.where(F.abs("ret") > limit)


def thin_dates(panel: DataFrame, share: float = THIN) -> DataFrame:
    """Dates with fewer than `share` of their year's median row count."""
    daily = panel.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    return daily.withColumn("median_n", F.percentile("n", F.lit(0.5)).over(Window.partitionBy(F.year("trade_date")))).where(F.col("n") < share * F.col("median_n"))


def prev_close_mismatch(panel: DataFrame, reported: str = "reported_prev") -> DataFrame:
    """Rows whose reported previous close is off their own by more than 0.02 and 0.5 %."""
    gap = F.abs(F.col(reported) - F.col("prev_close"))
    return panel.where((gap > 0.02) & (gap > 0.005 * F.abs("prev_close")))


def report(panel: DataFrame) -> dict:
    """ok, errors and row count as a small dict; a gate raises on not ok."""
    counts = structural(panel).first().asDict()
    rows = counts.pop("n_rows")
    return {"ok": not any(counts.values()), "errors": counts, "rows": rows}
