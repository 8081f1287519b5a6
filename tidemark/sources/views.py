"""Typed views of the star-schema tables in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: one row per (symbol, trade_date) from line items. Equal trades in another order make equal bars.

    Trades are dealt by symbol and sorted once: a symbol trades about once a session, so sums before the exchange would save no rows, and windows by
    symbol and date find the bars dealt and sorted as they need them."""
    from ..functions.expr import exact_sum

    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("u"),
        "l_quantity", "l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("k"),
    )
    return rows.repartition("symbol").groupBy("symbol", "trade_date").agg(
        F.min_by("u", "k").alias("open"), F.max("u").alias("high"), F.min("u").alias("low"), F.max_by("u", "k").alias("close"),
        exact_sum("l_quantity").alias("volume"), exact_sum("l_extendedprice").alias("traded_value"), F.count(F.lit(1)).alias("trades"),
    )


def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates (trade_date) on which there are bars, without making these."""
    return read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct()


def returns(panel: DataFrame) -> DataFrame:
    """The panel with prev_close and ret, row to row."""
    from ..functions.expr import change, shift

    return panel.withColumns({"prev_close": shift("close", 1), "ret": change("close")})


def market(panel_returns: DataFrame) -> DataFrame:
    """The equal-weight mean return by date."""
    return panel_returns.where("ret is not null").groupBy("trade_date").agg(F.avg("ret").alias("mret"))


#: The subjects that announcements are given in turn; the last is missing.
SUBJECTS = [
    "Bags order worth Rs 50 crore from a state utility", "Order bagged for metro coaches", "Company has won a contract; order received from railways", "Contract awarded for highway section",
    "Financial Results for the quarter ended March", "Unaudited standalone result of the half year", "Intimation of results for the quarter", "Declaration of interim dividend",
    "Proposal of stock split and bonus issue", "Buy-back of equity shares", "Creation of pledge of shares by promoters", "Group pledges to be carbon neutral by 2040",
    "Resignation of independent director", "Change in KMP", "Key managerial personnel: appointment of a chief financial officer", "Change in directorate after cessation of term",
    "Intimation of credit rating upgrade", "Rating upgraded to AA by ICRA", "Reaffirmed by CRISIL", "Receipt of tax demand order under GST",
    "Order received from GST department", "Show cause notice from the exchange", "SEBI order in the matter of trading", "Investigation closed; search and seizure of records",
    "Petition admitted by NCLT under the insolvency code", "NCLT-convened meeting of secured creditors", "Court convened meeting of shareholders", "Scheme of amalgamation with subsidiary",
    "Company acquires stake in a start-up", "To acquire 51% stake in a logistics firm", "Disclosure under Substantial Acquisition of Shares and Takeovers", "Acquisition of a chemicals unit; takeover completed",
    "Raising of funds through NCDs", "Issue of Commercial Paper", "Rights issue at a premium", "Allotment by QIP and preferential issue",
    "New facility in Pune begins trial runs", "Capex of Rs 900 crore for capacity expansion", "Commissioning of the second plant", "General update to shareholders",
    "", "Newspaper publication of a notice", None,
]


def subject(key: Column) -> Column:
    """The subject in turn of a whole number."""
    return F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.pmod(key, F.lit(len(SUBJECTS))) + 1).cast("int"))


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements of January 2024: event_id, symbol, announced_at, subject."""
    return read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("symbol"), F.col("ts").alias("announced_at"), subject(F.col("event_id")).alias("subject"))


def order_symbol(spark: SparkSession, sf_dir: str) -> Column:
    """The symbol, one of the suppliers from 0 on, that an order of a customer is told of."""
    return F.col("o_custkey") % (read(spark, sf_dir, "supplier").agg(F.max("s_suppkey") + 1).scalar())


def order_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements along the bars: one an order, at a minute that its key gives."""
    minute = F.col("o_orderkey") * 37 % 1440
    at = F.to_timestamp(F.to_date("o_orderdate")) + F.make_dt_interval(mins=minute.cast("int"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), order_symbol(spark, sf_dir).alias("symbol"), at.alias("announced_at"), subject(F.col("o_orderkey")).alias("subject"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol -> industry: supplier, nation and region. Nation and region are fixed tables of 25 and 5 rows."""
    nation = F.broadcast(read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    return read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("company"), F.col("r_name").alias("industry"))
