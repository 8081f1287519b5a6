"""Backtest and cost queries. Unit prices of line items jump by multiples, so returns are scaled by 0.01 throughout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import cost_rate, rounded
from ..functions.temporal import sessions, weekly_grid
from ..operators import backtest, features, universe
from ..sources import views
from ..stages import Stage
from .panel import SCALED
from .registry import TABLES, query

SCALE = 0.01
TABLES["adv"] = "SELECT symbol, trade_date, quantile_cont(traded_value, 0.5) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS adv FROM bars"
TABLES["targets"] = """SELECT rebalance_date, symbol, score, 1.0 / count(*) OVER (PARTITION BY rebalance_date) AS weight, adv, idx + 1 AS k FROM (SELECT m.trade_date AS rebalance_date, m.symbol, score, a.adv, s.idx,
    row_number() OVER (PARTITION BY m.trade_date ORDER BY score DESC, m.symbol) AS n FROM momentum m JOIN universe u ON u.symbol = m.symbol AND u.trade_date = m.trade_date AND u.liquidity_rank <= 20
    JOIN weekly w ON w.trade_date = m.trade_date JOIN sessions s ON s.trade_date = m.trade_date JOIN adv a ON a.symbol = m.symbol AND a.trade_date = m.trade_date) WHERE n <= 5"""
TABLES["spans"] = "SELECT k, coalesce(lead(k) OVER (ORDER BY k), (SELECT max(idx) FROM sessions)) AS until FROM (SELECT DISTINCT k FROM targets) WHERE k <= (SELECT max(idx) FROM sessions)"
TABLES["moves"] = "SELECT r.symbol, s.idx, r.ret * 0.01 AS ret FROM rets r JOIN sessions s ON s.trade_date = r.trade_date"
TABLES["paths"] = """SELECT t.k, t.symbol, s.idx, t.weight, t.adv, t.weight * product(1 + coalesce(m.ret, 0.0)) OVER (PARTITION BY t.k, t.symbol ORDER BY s.idx) AS value
    FROM targets t JOIN spans p ON p.k = t.k JOIN sessions s ON s.idx > p.k AND s.idx <= p.until LEFT JOIN moves m ON m.symbol = t.symbol AND m.idx = s.idx"""
TABLES["book_value"] = "SELECT k, idx, v, v / coalesce(lag(v) OVER (PARTITION BY k ORDER BY idx), 1.0) - 1 AS gross FROM (SELECT p.k, p.idx, sum(p.value) + any_value(c.cash) AS v FROM paths p JOIN (SELECT k, 1 - sum(weight) AS cash FROM targets GROUP BY k) c ON c.k = p.k GROUP BY p.k, p.idx)"
TABLES["trades"] = """SELECT coalesce(t.x, d.x) AS x, coalesce(t.symbol, d.symbol) AS symbol, coalesce(t.w, 0) - coalesce(d.was, 0) AS delta, coalesce(t.adv, d.adv) AS adv FROM
    (SELECT k AS x, symbol, weight AS w, adv FROM targets) t FULL JOIN (SELECT p.idx AS x, p.symbol, p.value / b.v AS was, p.adv FROM paths p JOIN spans s ON s.k = p.k AND s.until = p.idx JOIN book_value b ON b.k = p.k AND b.idx = p.idx) d
    ON t.x = d.x AND t.symbol = d.symbol WHERE coalesce(t.x, d.x) IN (SELECT k FROM spans)"""


def daily_sql(capital: float = 2.5e6, multiplier: float = 1.0, market: str = "delivery") -> str:
    """The daily results in SQL, for one capital, impact multiplier and market."""
    if market == "delivery":
        buy, sell, base, slope = 0.001 + (3.07e-5 + 1e-6) * 1.18 + 1.5e-4, 0.001 + (3.07e-5 + 1e-6) * 1.18, 3.0, 10.0
        flat = f"+ CASE WHEN delta <= 0 AND abs(delta) > 0 THEN 15.34 / (abs(delta) * {capital}) ELSE 0 END"
    else:
        buy, sell, base, slope, flat = 0.0, 2.78e-5, 1.0, 8.0, ""
    impact = f"CASE WHEN abs(delta) > 0 AND adv > 0 THEN ({base} + {slope} * sqrt(abs(delta) * {capital} / adv)) * {multiplier} / 1e4 ELSE 0 END"
    costs = f"SELECT x, sum(abs(delta) * (CASE WHEN delta > 0 THEN {buy} ELSE {sell} END {flat} + {impact})) AS cost, sum(abs(delta)) / 2 AS turnover FROM trades GROUP BY x"
    return f"""SELECT s.trade_date, coalesce(b.gross, 0) AS gross_return, coalesce(c.cost, 0) AS cost, coalesce(b.gross, 0) - coalesce(c.cost, 0) AS net_return, coalesce(c.turnover, 0) AS turnover
        FROM sessions s LEFT JOIN book_value b ON b.idx = s.idx LEFT JOIN ({costs}) c ON c.x = s.idx WHERE b.idx IS NOT NULL OR c.x IS NOT NULL"""


def scaled(spark, sf_dir):
    r = views.returns(views.bars(spark, sf_dir))
    return r.withColumn("ret", F.col("ret") * SCALE)


def targets(panel, n=5):
    u = universe.pit_universe(panel, **SCALED)
    picks = backtest.top_n(features.score(panel, features.momentum_12_1()), u, weekly_grid(sessions(panel)), n)
    adv = backtest.average_volume(panel).withColumnRenamed("trade_date", "rebalance_date")
    return picks.join(adv, ["symbol", "rebalance_date"])


def staged(spark, sf_dir):
    """The scaled panel, written once: signals, universe, calendar and returns all come from it."""
    return Stage(spark, "panel").write(scaled(spark, sf_dir).select("symbol", "trade_date", "close", "traded_value", "ret"))


def daily(spark, sf_dir, **kw):
    panel = staged(spark, sf_dir)
    return backtest.run(panel, targets(panel), **kw)


_SUMMARY = """SELECT count(*) AS days, round(pow(arg_max(equity, trade_date), 252.0 / count(*)) - 1, 6) + 0.0 AS cagr, round(stddev_samp(net_return) * sqrt(252.0), 6) AS vol, round(avg(net_return) / stddev_samp(net_return) * sqrt(252.0), 6) + 0.0 AS sharpe,
    round(min(equity / peak - 1), 6) + 0.0 AS max_drawdown, round(count(*) FILTER (WHERE net_return > 0)::DOUBLE / count(*) FILTER (WHERE net_return <> 0), 6) AS hit_rate, round(sum(turnover) / (count(*) / 252.0), 6) AS turnover_a_year
    FROM (SELECT *, max(equity) OVER (ORDER BY trade_date) AS peak FROM (SELECT *, product(1 + net_return) OVER (ORDER BY trade_date) AS equity FROM d))"""
_ROUND = ["cagr", "vol", "sharpe", "max_drawdown", "hit_rate", "turnover_a_year"]


def _rounded_summary(d):
    return backtest.summarise(d).select("days", *[rounded(c).alias(c) for c in _ROUND])


@query("SELECT rebalance_date, symbol, round(weight, 8) AS weight, round(adv, 4) AS adv FROM targets")
def backtest_holdings(spark, sf_dir):
    return targets(scaled(spark, sf_dir)).select("rebalance_date", "symbol", rounded("weight", 8).alias("weight"), rounded("adv", 4).alias("adv"))


@query(f"SELECT trade_date, round(gross_return, 8) + 0.0 AS gross_return, round(net_return, 8) + 0.0 AS net_return FROM ({daily_sql()})")
def backtest_equal_weight_daily(spark, sf_dir):
    return daily(spark, sf_dir).select("trade_date", rounded("gross_return", 8).alias("gross_return"), rounded("net_return", 8).alias("net_return"))


@query(f"SELECT trade_date, round(cost, 8) AS cost, round(turnover, 8) AS turnover FROM ({daily_sql()}) WHERE turnover > 0")
def backtest_turnover_costs(spark, sf_dir):
    return daily(spark, sf_dir).where("turnover > 0").select("trade_date", rounded("cost", 8).alias("cost"), rounded("turnover", 8).alias("turnover"))


@query(f"WITH d AS ({daily_sql()}) {_SUMMARY}")
def backtest_summary(spark, sf_dir):
    return _rounded_summary(daily(spark, sf_dir))


@query(f"WITH d AS ({daily_sql(market='overseas')}) {_SUMMARY}")
def backtest_overseas_market(spark, sf_dir):
    return _rounded_summary(daily(spark, sf_dir, market="overseas"))


def _sweep(spark, sf_dir, column, values, run_one):
    """One book, costed once for each value."""
    panel, stage = staged(spark, sf_dir), Stage(spark, "sweep")
    calendar = stage.write(sessions(panel))
    paths, spans, dated = (stage.write(x) for x in backtest.book(panel, stage.write(targets(panel).select("rebalance_date", "symbol", "weight", "adv")), calendar))
    out = None
    for v in values:
        one = _rounded_summary(run_one((paths, spans, dated, calendar), v)).withColumn(column, F.lit(v)).select(column, "cagr", "sharpe", "max_drawdown")
        out = one if out is None else out.unionByName(one)
    return out


def _sweep_sql(column, runs):
    return "WITH " + ", ".join(f"d{i} AS ({s})" for i, (_, s) in enumerate(runs)) + " " + " UNION ALL ".join(f"SELECT {v}::DOUBLE AS {column}, cagr, sharpe, max_drawdown FROM ({_SUMMARY.replace('FROM d)', f'FROM d{i})')})" for i, (v, _) in enumerate(runs))


@query(_sweep_sql("multiplier", [(m, daily_sql(multiplier=m)) for m in (0.0, 0.5, 1.0, 2.0)]))
def cost_sensitivity(spark, sf_dir):
    return _sweep(spark, sf_dir, "multiplier", [0.0, 0.5, 1.0, 2.0], lambda book, m: backtest.costed(*book, impact_multiplier=m))


@query(_sweep_sql("capital", [(c, daily_sql(capital=c)) for c in (5e5, 2.5e6, 1e7)]))
def capacity_curve(spark, sf_dir):
    return _sweep(spark, sf_dir, "capital", [5e5, 2.5e6, 1e7], lambda book, c: backtest.costed(*book, capital=c))


@query("""SELECT o_orderkey AS order_id, round(0.001 + (3.07e-5 + 1e-6) * 1.18 + 1.5e-4 + (3 + 10 * sqrt(o_totalprice / 1e6)) / 1e4, 10) AS buy_rate,
    round(0.001 + (3.07e-5 + 1e-6) * 1.18 + 15.34 / o_totalprice + (3 + 10 * sqrt(o_totalprice / 1e6)) / 1e4, 10) AS sell_rate, round((1 + 8 * sqrt(o_totalprice / 1e6)) / 1e4, 10) AS overseas_rate FROM orders""")
def cost_curve(spark, sf_dir):
    o, adv = F.col("o_totalprice"), F.lit(1e6)
    return views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), rounded(cost_rate("buy", o, adv), 10).alias("buy_rate"), rounded(cost_rate("sell", o, adv, dp_order_value=o), 10).alias("sell_rate"), rounded(cost_rate("buy", o, adv, market="overseas"), 10).alias("overseas_rate"))


@query("""WITH e AS (SELECT max(trade_date) AS hi FROM bars), s AS (SELECT symbol FROM bars GROUP BY symbol HAVING max(trade_date) >= (SELECT hi FROM e) - 1),
    x AS (SELECT trade_date, avg(ret) * 0.01 AS all_names, avg(ret) FILTER (WHERE symbol IN (SELECT symbol FROM s)) * 0.01 AS survivors FROM rets WHERE ret IS NOT NULL GROUP BY trade_date)
    SELECT count(*) AS days, round(avg(survivors) * 252, 6) AS survivor_mean, round(avg(all_names) * 252, 6) AS full_mean, round((avg(survivors) - avg(all_names)) * 252, 6) + 0.0 AS bias FROM x""")
def survivorship_gap(spark, sf_dir):
    p = scaled(spark, sf_dir).where("ret is not null")
    full = p.groupBy("trade_date").agg(F.avg("ret").alias("all_names"))
    kept = universe.survivors(views.returns(views.bars(spark, sf_dir)), days=1).where("ret is not null").groupBy("trade_date").agg((F.avg("ret") * SCALE).alias("survivors"))
    both = full.join(kept, "trade_date", "left")
    return both.agg(F.count(F.lit(1)).alias("days"), rounded(F.avg("survivors") * 252).alias("survivor_mean"), rounded(F.avg("all_names") * 252).alias("full_mean"), rounded((F.avg("survivors") - F.avg("all_names")) * 252).alias("bias"))
