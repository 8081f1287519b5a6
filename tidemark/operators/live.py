"""Live operations and smaller reports: heartbeats, divergence, checklists, coverage, caches, spines and candidate screens."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import rolling, safe_div
from ..functions.temporal import asof_forward
from ..workers import ship
from .gram import correlations
from .risk import days, so_far
from .sliding import quantile as sliding_quantile
from .sliding import slide


def month_spine(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """The first day of every month from first to last, and whether the month is complete by `last`."""
    months = bounds.select(F.explode(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))).alias("month"), F.col(last).alias("_last"))
    return months.select("month", (F.last_day("month") <= F.col("_last")).alias("complete"))


def sample_within(samples: DataFrame, prices: DataFrame, tolerance: int = 7) -> DataFrame:
    """The first price on or at most `tolerance` days after each sample date."""
    hit = asof_forward(samples, prices, ["symbol"], "sample_date", "trade_date", ["close"])
    return hit.where(F.datediff("trade_date", "sample_date") <= tolerance)


def coverage(events: DataFrame, *, at: str, floor: int = 1000, null_limit: float = 0.10) -> DataFrame:
    """Per year the rows, null-symbol share and after-close share of an event corpus, and whether it passes."""
    late = (F.hour(at) * 60 + F.minute(at) >= 930).cast("double")
    c = events.groupBy(F.year(at).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("symbol").isNull().cast("double")).alias("null_share"), F.avg(late).alias("after_close"))
    return c.withColumn("ok", (F.col("n") >= floor) & (F.col("null_share") <= null_limit))


def cached_labels(events: DataFrame, cache: DataFrame, fallback: DataFrame) -> DataFrame:
    """Labels by the hash of the subject from a cache, else the rule's own."""
    keyed = fallback.withColumn("_h", F.sha2(F.coalesce("subject", F.lit("")), 256))
    hit = keyed.join(cache.select(F.col("subject_hash").alias("_h"), F.col("label").alias("_label")), "_h", "left")
    return hit.withColumn("source", F.when(F.col("_label").isNull(), "rule").otherwise("cache")).withColumn("category", F.coalesce("_label", "category")).drop("_h", "_label")


def period_summary(daily: DataFrame, period: Column) -> DataFrame:
    """Mean, volatility and Sharpe by period; a Sharpe needs 20 days."""
    n = F.count("r")
    sharpe = F.when(n >= 20, safe_div(F.avg("r"), F.stddev_samp("r")) * math.sqrt(252)).otherwise(0.0)
    return daily.groupBy(period.alias("period")).agg(n.alias("days"), (F.avg("r") * 252).alias("mean"), (F.stddev_samp("r") * math.sqrt(252)).alias("vol"), sharpe.alias("sharpe"))


def vol_band(daily: DataFrame, *, window: int = 63, top: float = 0.17) -> DataFrame:
    """The median of trailing annual volatility and the share of days at or under the band's top."""
    v = daily.select((rolling("r", window, "std", by=days()) * math.sqrt(252)).alias("vol")).where("vol is not null")
    return v.agg(F.count("vol").alias("days"), F.percentile("vol", F.lit(0.5)).alias("median_vol"), F.avg((F.col("vol") <= top).cast("double")).alias("in_band"))


def gated(daily: DataFrame, gate: DataFrame) -> DataFrame:
    """Returns times the gross exposure in force the session before."""
    g = daily.join(gate.select("trade_date", "gross"), "trade_date", "left")
    return g.withColumn("r", F.col("r") * F.coalesce(F.lag("gross").over(days()), F.lit(1.0))).drop("gross")


def heartbeat(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """One row: the last session and the last logged one, how many sessions the log is behind, and how many it missed before."""
    last = log.agg(F.max("trade_date").alias("logged"))
    s = sessions.join(log.select("trade_date", F.lit(1).alias("_have")).distinct(), "trade_date", "left").join(F.broadcast(last))  # one row
    behind = F.coalesce(F.col("trade_date") > F.col("logged"), F.lit(True))
    return s.agg(F.max("trade_date").alias("last_session"), F.max("logged").alias("last_logged"), F.count_if(behind).alias("behind"), F.count_if(~behind & F.col("_have").isNull()).alias("missed"))


def divergence(live: DataFrame, research: DataFrame) -> DataFrame:
    """Weekly compounded live and research returns and their gap; of repeated days the last logged row counts."""
    last = Window.partitionBy("trade_date").orderBy(F.desc("logged_at"))
    kept = live.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("trade_date", F.col("r").alias("live"))
    both = kept.join(research.select("trade_date", F.col("r").alias("research")), "trade_date")
    w = both.groupBy(F.to_date(F.date_trunc("week", "trade_date")).alias("week")).agg(F.count(F.lit(1)).alias("days"), *[(F.product(1 + F.col(c)) - 1).alias(c) for c in ("live", "research")])
    return w.withColumn("gap", F.col("live") - F.col("research"))


def checklist(log: DataFrame, *keys: str, clean: int = 30, reconciled: int = 5) -> DataFrame:
    """Go-live booleans from a run log (reconcile_ok, orders_rejected), for each of its keys."""
    ok = F.count_if((F.col("orders_rejected") == 0) & F.col("reconcile_ok"))
    return log.groupBy(*keys).agg(ok.alias("clean_sessions"), F.count_if("reconcile_ok").alias("reconciled_days"), (ok >= clean).alias("enough_clean"), (F.count_if("reconcile_ok") >= reconciled).alias("enough_reconciled"))


def illiquidity(panel_returns: DataFrame, *, window: int = 21, quantile_rows: int = 252, quantile: float = 0.8) -> DataFrame:
    """Days on which the median name's trailing price impact is at or over its rolling quantile."""
    impact = panel_returns.select("trade_date", (F.abs("ret") / (F.col("traded_value") + 1.0)).alias("x")).where("x is not null")
    daily = impact.groupBy("trade_date").agg(F.percentile("x", F.lit(0.5)).alias("median")).withColumn("level", rolling("median", window, "mean", by=days()))
    told = slide(daily, {"_limit": ("level", sliding_quantile(quantile_rows, quantile))}, keys=())
    return told.select("trade_date", "level", F.coalesce(F.col("level") >= F.col("_limit"), F.lit(False)).alias("illiquid"))


def month_ends(daily: DataFrame) -> DataFrame:
    """The last equity and drawdown of each month."""
    c = daily.withColumn("equity", F.product(1 + F.col("r")).over(so_far())).withColumn("drawdown", F.col("equity") / F.max("equity").over(so_far()) - 1)
    return c.groupBy(F.trunc("trade_date", "MM").alias("month")).agg(F.max_by("equity", "trade_date").alias("equity"), F.max_by("drawdown", "trade_date").alias("drawdown"))


def action_rewards(paths: DataFrame, rows: int = 5) -> DataFrame:
    """Counterfactual rewards: per action the compounded return over the next `rows` sessions."""
    frame = Window.partitionBy("action").orderBy("trade_date").rowsBetween(1, rows)
    full = F.count("r").over(frame) == rows
    return paths.select("action", "trade_date", F.when(full, F.product(1 + F.col("r")).over(frame) - 1).alias("reward")).where("reward is not null")


def screen(candidates: DataFrame, labels: DataFrame, *, min_names: int = 10) -> DataFrame:
    """Mean daily rank correlation with the label, its t and the days, by candidate (name, symbol, trade_date, x)."""
    return rank_correlations(candidates.join(labels, ["symbol", "trade_date"]), min_names=min_names)


def rank_correlations(scored: DataFrame, *, min_names: int = 10) -> DataFrame:
    """As screen, of candidates beside their labels (name, trade_date, x, label). A date's rows of a candidate, as many as the market has names, are
    ranked together."""
    ship(scored.sparkSession)

    def daily_ic(rows: pa.Table) -> pa.Table:
        x, label = (rows.column(c).to_numpy() for c in ("x", "label"))
        ic = correlations(x[:, None], label[:, None])
        return pa.Table.from_arrays([rows.column("name").slice(0, 1), rows.column("trade_date").slice(0, 1), pa.array([len(x)], pa.int64()), pa.array(ic, pa.float64(), mask=np.isnan(ic))], ["name", "trade_date", "n", "ic"])

    both = scored.where("x is not null and label is not null").select("name", "trade_date", F.col("x").cast("double").alias("x"), F.col("label").cast("double").alias("label"))
    daily = both.groupBy("name", "trade_date").applyInArrow(daily_ic, "name string, trade_date date, n long, ic double").where(F.col("n") >= min_names)
    return daily.groupBy("name").agg(F.count("ic").alias("days"), F.avg("ic").alias("mean_ic"), (F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("ic"))).alias("t"))
