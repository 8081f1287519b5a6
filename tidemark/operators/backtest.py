"""Equal-weight style backtests in closed form: weights that do not depend on the prior book make the day loop relational.

Between executions a name's value is its weight times the product of its returns, cash earns nothing, so the book's value, its
daily return and the drifted weights at the next execution follow from window products; trades are the full outer join of the drifted
book with the new target."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import TRADING_DAYS, cost_rate, rolling, safe_div
from ..functions.temporal import sessions
from ..stages import Stage
from .actions import alias_series


def average_volume(panel: DataFrame) -> DataFrame:
    """The 21-row median of traded value, from the first row on."""
    return panel.select("symbol", "trade_date", rolling("traded_value", 21, "median", min_rows=1).alias("adv"))


def top_n(signal: DataFrame, universe: DataFrame, grid: DataFrame, n: int = 25) -> DataFrame:
    """(rebalance_date, symbol, score, weight): the n best of the universe on each grid date, equally weighted."""
    best = Window.partitionBy("trade_date").orderBy(F.desc("score"), "symbol")
    inside = signal.join(universe.where("in_universe").select("symbol", "trade_date"), ["symbol", "trade_date"]).join(grid, "trade_date", "left_semi")
    picks = inside.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= n)
    return picks.select(F.col("trade_date").alias("rebalance_date"), "symbol", "score", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("trade_date"))).alias("weight"))


def book(panel: DataFrame, targets: DataFrame, calendar: DataFrame, *, lag: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, spans, dated): each target's value by session after its execution, the executions, and the targets with theirs.

    paths: k, until, symbol, idx, weight, adv, value; spans: k (the execution's session), until (the next one's, or the last session). All but
    the panel are short: rows a rebalance times names of a book."""
    dated = targets.join(calendar.withColumnRenamed("trade_date", "rebalance_date"), "rebalance_date").withColumn("k", F.col("idx") + lag).drop("idx")
    last = calendar.agg(F.max("idx").alias("last"))
    spans = dated.select("k").distinct().join(F.broadcast(last)).where("k <= last").withColumn("until", F.coalesce(F.lead("k").over(Window.orderBy("k")), F.col("last"))).drop("last")  # one row a rebalance
    days = dated.join(spans, "k").where("until > k").withColumn("idx", F.explode(F.sequence(F.col("k") + 1, F.col("until"))))
    moves = panel.select("symbol", "trade_date", "ret").join(calendar, "trade_date").select("symbol", "idx", "ret")
    path = Window.partitionBy("k", "symbol").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    paths = days.join(moves, ["symbol", "idx"], "left").withColumn("value", F.col("weight") * F.product(1 + F.coalesce("ret", F.lit(0.0))).over(path))
    return paths.select("k", "until", "symbol", "idx", "weight", "adv", "value"), spans, dated


def run(panel: DataFrame, targets: DataFrame, *, lag: int = 1, capital: float = 2.5e6, impact_multiplier: float = 1.0, market: str = "delivery") -> DataFrame:
    """Daily results: trade_date, gross_return, cost, net_return, turnover. targets: rebalance_date, symbol, weight, adv.

    The calendar, the dated targets and their paths are written once, as several steps use each."""
    stage = Stage(panel.sparkSession, "backtest")
    calendar = stage.write(sessions(panel))
    kept = stage.write(targets.select("rebalance_date", "symbol", "weight", "adv"))
    paths, spans, dated = book(panel, kept, calendar, lag=lag)
    return costed(stage.write(paths), stage.write(spans), stage.write(dated), calendar, capital=capital, impact_multiplier=impact_multiplier, market=market)


def costed(paths: DataFrame, spans: DataFrame, dated: DataFrame, calendar: DataFrame, *, capital: float = 2.5e6, impact_multiplier: float = 1.0, market: str = "delivery") -> DataFrame:
    """The daily results of a book. A departing name's volume is the last one known of it, from any earlier pick."""
    by_k = Window.partitionBy("k").orderBy("idx")
    whole = Window.partitionBy("k", "idx")
    cash = dated.groupBy("k").agg((1 - F.sum("weight")).alias("cash"))
    valued = paths.join(cash, "k").withColumn("v", F.sum("value").over(whole) + F.col("cash"))
    daily = valued.groupBy("k", "idx").agg(F.first("v").alias("v")).withColumn("gross_return", F.col("v") / F.coalesce(F.lag("v").over(by_k), F.lit(1.0)) - 1)
    drifted = valued.where("idx = until").select(F.col("idx").alias("x"), "symbol", (F.col("value") / F.col("v")).alias("was"), F.col("adv").alias("old_adv"))
    fresh = dated.select(F.col("k").alias("x"), "symbol", F.col("weight").alias("to"), F.col("adv").alias("new_adv"))
    trades = fresh.join(drifted, ["x", "symbol"], "full_outer").join(spans.select(F.col("k").alias("x")), "x", "left_semi")
    delta = F.coalesce("to", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))
    order, adv = F.abs(delta) * capital, F.coalesce("new_adv", "old_adv")
    rate = F.when(delta > 0, cost_rate("buy", order, adv, market=market, impact_multiplier=impact_multiplier)).otherwise(cost_rate("sell", order, adv, market=market, impact_multiplier=impact_multiplier, dp_order_value=order))
    costs = trades.groupBy(F.col("x").alias("idx")).agg(F.sum(F.abs(delta) * rate).alias("cost"), (F.sum(F.abs(delta)) / 2).alias("turnover"))
    out = daily.select("idx", "gross_return").join(costs, "idx", "full_outer").join(calendar, "idx")
    gross, cost = F.coalesce("gross_return", F.lit(0.0)), F.coalesce("cost", F.lit(0.0))
    return out.select("trade_date", gross.alias("gross_return"), cost.alias("cost"), (gross - cost).alias("net_return"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def equity_curve(daily: DataFrame, column: str = "net_return") -> DataFrame:
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # one row a session
    return daily.withColumn("equity", F.product(1 + F.col(column)).over(w))


def summarise(daily: DataFrame, column: str = "net_return") -> DataFrame:
    """One row: days, cagr, vol, sharpe, max_drawdown (the peak starts at the first equity value), hit_rate over non-zero days, turnover a year."""
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    curve = equity_curve(daily, column).withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)
    r, n = F.col(column), F.count(F.lit(1))
    turn = F.sum("turnover") if "turnover" in daily.columns else F.lit(None).cast("double")
    years = n / TRADING_DAYS
    return curve.agg(
        n.alias("days"), (F.pow(F.max_by("equity", "trade_date"), TRADING_DAYS / n) - 1).alias("cagr"), (F.stddev_samp(r) * F.sqrt(F.lit(252.0))).alias("vol"),
        (safe_div(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.min("dd").alias("max_drawdown"),
        safe_div(F.count_if(r > 0), F.count_if(r != 0)).alias("hit_rate"), (turn / years).alias("turnover_a_year"),
    )


def benchmark_returns(indices: DataFrame, aliases: list[str], start: date) -> DataFrame:
    """(trade_date, net_return) of a price index under any of its names, from its level; the first day from `start` on has none and drops.
    summarise gives its metrics."""
    level = alias_series(indices, aliases).where(F.col("trade_date") >= F.lit(start))
    return level.select("trade_date", (safe_div("close", F.lag("close").over(Window.orderBy("trade_date"))) - 1).alias("net_return")).where("net_return is not null")  # one row a session


def long_flat(preds: DataFrame, *, buy: float, sell: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Costed long/flat returns of single names: (keys, trade_date, pred, target) -> position, net. Costs fall on each change of position. Without keys
    there is one name, with one row a session."""
    by = Window.partitionBy(*keys).orderBy("trade_date")
    pos = F.when(F.col("pred") > 0, 1.0).otherwise(0.0)
    p = preds.withColumn("position", pos).withColumn("before", F.coalesce(F.lag("position").over(by), F.lit(0.0)))
    cost = F.when(F.col("position") > F.col("before"), buy).when(F.col("position") < F.col("before"), sell).otherwise(0.0)
    return p.withColumn("net", F.col("position") * F.col("target") - cost).drop("before")


def participation(value: Column, adv: Column, limit: float) -> Column:
    """The allowed move of a weight under a participation limit; unknown volume fails open."""
    return F.when(adv.isNull() | (adv <= 0), F.lit(float("inf"))).otherwise(limit * adv / value)
