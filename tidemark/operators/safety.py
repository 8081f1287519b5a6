"""Operational safety: alerts and their delivery, the kill switch as a log, and the orders that flatten a book.

Alerts have ids that their content gives, so a rerun raises and sends none twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from the least to the gravest.
SEVERITIES = ["info", "warning", "critical"]


def level(severity: str) -> Column:
    """A severity's place among SEVERITIES; an unknown or missing one counts as the gravest, so that it reaches every channel."""
    known = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity))
    return F.when(known > 0, known).otherwise(len(SEVERITIES))


def digest(*columns: str) -> Column:
    """The first 12 hex digits of the SHA-256 of the columns as text, joined by colons; nulls are left out."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in columns]), 256), 1, 12)


def state_alerts(states: DataFrame, *by: str) -> DataFrame:
    """(by, trade_date, severity, message, alert_id): an alert for each change of a drawdown state (by, trade_date, state), and for a first state other than
    normal. Flat is critical, half_gross a warning, a return to normal for information. A key has one row a day; without keys the series has one row a session."""
    before = F.lag("state").over(Window.partitionBy(*by or [F.lit(1)]).orderBy("trade_date"))
    changed = states.withColumn("_was", F.coalesce(before, F.lit("normal"))).where("state <> _was")
    severity = F.when(F.col("state") == "flat", "critical").when(F.col("state") == "half_gross", "warning").otherwise("info")
    told = changed.select(*by, "trade_date", severity.alias("severity"), F.concat_ws(" ", F.lit("drawdown state"), "_was", F.lit("->"), "state").alias("message"))
    return told.withColumn("alert_id", digest(*by, "trade_date", "message"))


def to_deliver(alerts: DataFrame, channels: DataFrame, sent: DataFrame) -> DataFrame:
    """alerts, once for each channel (channel, least: its least severity) that takes them and that has not got them before, by sent (alert_id, channel).

    Channels are a short list and go along with the alerts; a channel's own failure leaves no row in sent, so that it is tried again, and the others' stay."""
    taken = alerts.dropDuplicates(["alert_id"]).withColumn("_level", level("severity")).join(F.broadcast(channels.withColumn("_least", level("least"))), F.col("_level") >= F.col("_least"))
    return taken.drop("_level", "_least", "least").join(sent.select("alert_id", "channel").distinct(), ["alert_id", "channel"], "left_anti")


def switches(log: DataFrame) -> DataFrame:
    """(account, frozen, reason, since) by the last entry of each account in a log (account, at, action: freeze or unfreeze, reason). Of entries of one moment a
    freeze counts, and of freezes the least reason; an account without entries has no row and is not frozen."""
    entries = log.where(F.col("action").isin("freeze", "unfreeze") & F.col("at").isNotNull())
    last = Window.partitionBy("account").orderBy(F.desc("at"), "action", F.asc_nulls_last("reason"))  # freeze comes before unfreeze
    now = entries.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    frozen = F.col("action") == "freeze"
    return now.select("account", frozen.alias("frozen"), F.when(frozen, F.col("reason")).alias("reason"), F.col("at").alias("since"))


def permitted(orders: DataFrame, switch: DataFrame) -> DataFrame:
    """Orders (account, side, ...) that may be sent: all of accounts that are not frozen, and none but sells of frozen ones."""
    held = switch.select("account", F.col("frozen").alias("_frozen"))
    return orders.join(held, "account", "left").where(~F.coalesce("_frozen", F.lit(False)) | (F.col("side") == "sell")).drop("_frozen")


def flatten(positions: DataFrame) -> DataFrame:
    """(account, trade_date, symbol, side, quantity, client_order_id): the sells that close every long position (account, trade_date, symbol, quantity), without
    checks of size, band or number, as an emergency exit must not be refused. Ids repeat in a rerun of the day."""
    sells = positions.where("quantity > 0").withColumn("side", F.lit("sell"))
    return sells.select("account", "trade_date", "symbol", "side", "quantity", digest("account", "trade_date", "symbol", "side", "quantity").alias("client_order_id"))
