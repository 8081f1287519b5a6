"""Safety queries: names stand for books, suppliers for accounts, line items for their trades and orders for the entries of the switch's log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risk, safety
from ..sources import views
from .registry import TABLES, query

#: Each channel with the least severity that it takes.
CHANNELS = [("log", "info"), ("chat", "warning"), ("phone", "critical")]

TABLES["state_changes"] = """SELECT symbol, trade_date, state, was, CASE state WHEN 'flat' THEN 3 WHEN 'half_gross' THEN 2 ELSE 1 END AS grade FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY symbol ORDER BY trade_date), 'normal') AS was FROM (
    SELECT symbol, trade_date, CASE WHEN dd <= -0.15 THEN 'flat' WHEN dd <= -0.10 THEN 'half_gross' ELSE 'normal' END AS state FROM (SELECT symbol, trade_date, equity / max(equity) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS dd FROM (
    SELECT symbol, trade_date, product(1 + ret * 0.01) OVER (PARTITION BY symbol ORDER BY trade_date) AS equity FROM rets WHERE ret IS NOT NULL)))) WHERE state <> was"""
TABLES["switch_log"] = "SELECT o_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS account, CAST(o_orderdate AS TIMESTAMP) AS entered, CASE o_orderpriority WHEN '1-URGENT' THEN 'freeze' WHEN '2-HIGH' THEN 'unfreeze' ELSE 'note' END AS action, o_orderstatus AS reason FROM orders"
TABLES["switch"] = "SELECT account, action = 'freeze' AS frozen, CASE WHEN action = 'freeze' THEN reason END AS reason, CAST(entered AS DATE) AS since FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY entered DESC, action, reason NULLS LAST) AS n FROM switch_log WHERE action <> 'note' AND entered IS NOT NULL) WHERE n = 1"
TABLES["positions"] = "SELECT l_suppkey AS account, max(CAST(l_shipdate AS DATE)) AS trade_date, l_partkey AS symbol, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS BIGINT) AS quantity FROM lineitem GROUP BY l_suppkey, l_partkey"


@query("""SELECT symbol, trade_date, CASE grade WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'info' END AS severity, channel, substr(sha256(concat_ws(':', symbol, trade_date, 'drawdown state ' || was || ' -> ' || state)), 1, 12) AS alert_id
    FROM state_changes JOIN (VALUES ('log', 1), ('chat', 2), ('phone', 3)) c(channel, least) ON grade >= least WHERE NOT (channel = 'log' AND trade_date < DATE '1995-01-01')""")
def alert_deliveries(spark, sf_dir):
    """Drawdown alerts of every name by channel, when the log got those before 1995 already."""
    r = views.returns(views.bars(spark, sf_dir)).where("ret is not null").select("symbol", "trade_date", (F.col("ret") * 0.01).alias("r"))
    alerts = safety.state_alerts(risk.drawdown_state(r, by=("symbol",)), "symbol")
    sent = alerts.where("trade_date < date'1995-01-01'").select("alert_id", F.lit("log").alias("channel"))
    due = safety.to_deliver(alerts, spark.createDataFrame(CHANNELS, "channel string, least string"), sent)
    return due.select("symbol", "trade_date", "severity", "channel", "alert_id")


def _switches(spark, sf_dir):
    p = F.col("o_orderpriority")
    action = F.when(p == "1-URGENT", "freeze").when(p == "2-HIGH", "unfreeze").otherwise("note")
    return safety.switches(views.read(spark, sf_dir, "orders").select(views.order_symbol(spark, sf_dir).alias("account"), F.to_timestamp("o_orderdate").alias("at"), action.alias("action"), F.col("o_orderstatus").alias("reason")))


@query("SELECT account, frozen, reason, since FROM switch")
def kill_switches(spark, sf_dir):
    return _switches(spark, sf_dir).withColumn("since", F.to_date("since"))


@query("""SELECT account, trade_date, symbol, quantity, substr(sha256(concat_ws(':', account, trade_date, symbol, 'sell', quantity)), 1, 12) AS client_order_id FROM positions JOIN switch USING (account) WHERE frozen AND quantity > 0""")
def emergency_flatten(spark, sf_dir):
    """The sells that close all long positions of frozen accounts; positions are summed up before they meet the switches."""
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    held = views.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("symbol")).agg(F.max(F.to_date("l_shipdate")).alias("trade_date"), F.sum(signed).cast("long").alias("quantity"))
    frozen = _switches(spark, sf_dir).where("frozen").select("account")
    return safety.flatten(held.join(frozen, "account", "left_semi")).drop("side")
