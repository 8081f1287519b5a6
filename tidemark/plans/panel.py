"""Panel, calendar, universe and quality queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..functions.temporal import date_spine, neighbours, sessions, weekly_grid
from ..operators import quality, universe
from ..operators.actions import security_master as master
from ..sources import views
from .registry import query

SCALED = {"min_traded_value": 20000.0, "min_price": 1.0, "min_listed_days": 126, "liquidity_window": 63, "top_n": 20}


@query("SELECT symbol, trade_date, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 4) AS volume, round(traded_value, 4) AS traded_value, trades FROM bars")
def bars(spark, sf_dir):
    b = views.bars(spark, sf_dir)
    return b.select("symbol", "trade_date", *[rounded(c, 8).alias(c) for c in ("open", "high", "low", "close")], *[rounded(c, 4).alias(c) for c in ("volume", "traded_value")], "trades")


@query("SELECT trade_date, CAST(date_trunc('week', trade_date) AS DATE) AS week FROM weekly")
def sessions_weekly_grid(spark, sf_dir):
    return weekly_grid(sessions(views.bars(spark, sf_dir))).select("trade_date", F.to_date(F.date_trunc("week", "trade_date")).alias("week"))


@query("SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev_session, lead(trade_date) OVER (ORDER BY trade_date) AS next_session FROM sessions")
def next_prev_session(spark, sf_dir):
    return neighbours(sessions(views.bars(spark, sf_dir)))


@query("SELECT trade_date, idx FROM sessions WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def session_range(spark, sf_dir):
    return sessions(views.bars(spark, sf_dir)).where("trade_date between date'1996-01-01' and date'1996-12-31'").select("trade_date", "idx")


@query("SELECT symbol, trade_date, round(mtv, 4) AS median_traded_value, listed_days, liquidity_rank, coalesce(liquidity_rank <= 20, false) AS in_universe FROM universe")
def pit_universe(spark, sf_dir):
    u = universe.pit_universe(views.bars(spark, sf_dir), **SCALED)
    return u.select("symbol", "trade_date", rounded("median_traded_value", 4).alias("median_traded_value"), F.col("listed_days").cast("long").alias("listed_days"), F.col("liquidity_rank").cast("long").alias("liquidity_rank"), "in_universe")


@query("""SELECT b.symbol, min(trade_date) AS first_trade_date, max(trade_date) AS last_trade_date, arg_max(trades, trade_date) AS last_trades, any_value(s_name) AS company, any_value(r_name) AS industry
    FROM bars b LEFT JOIN supplier ON s_suppkey = b.symbol LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY b.symbol""")
def security_master(spark, sf_dir):
    return master(views.bars(spark, sf_dir), views.sectors(spark, sf_dir))


@query("""SELECT trade_date, round(mret, 8) AS pr_return, round(mret + 1.5 / 100 / 252, 8) AS tr_return,
    round(ln(1000) + sum(ln(1 + mret + 1.5 / 100 / 252)) OVER (ORDER BY trade_date), 5) + 0.0 AS log_tr_index FROM market""")
def benchmark_total_return(spark, sf_dir):
    """Total return of an index with a dividend yield of 1.5 %; the level, base 1000, as a logarithm."""
    m = views.market(views.returns(views.bars(spark, sf_dir)))
    tr = F.col("mret") + 1.5 / 100 / 252
    by = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # one row a session
    return m.select("trade_date", rounded("mret", 8).alias("pr_return"), rounded(tr, 8).alias("tr_return"), rounded(F.log(F.lit(1000.0)) + F.sum(F.log(1 + tr)).over(by), 5).alias("log_tr_index"))


@query("""SELECT count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS non_positive_price, count(*) FILTER (WHERE high < low - 1e-6) AS high_below_low,
    count(*) FILTER (WHERE close > high + 1e-6 OR close < low - 1e-6) AS close_outside_range, count(*) FILTER (WHERE volume < 0) AS negative_volume,
    count(*) - count(DISTINCT (symbol, trade_date)) AS duplicate_keys, count(*) AS n_rows FROM bars""")
def qa_structural(spark, sf_dir):
    return quality.structural(views.bars(spark, sf_dir))


@query("SELECT symbol, trade_date, round(ret, 8) AS ret FROM rets WHERE abs(ret) > 0.30")
def qa_return_outliers(spark, sf_dir):
    return quality.return_outliers(views.returns(views.bars(spark, sf_dir))).select("symbol", "trade_date", rounded("ret", 8).alias("ret"))


@query("""SELECT * FROM (SELECT trade_date, n, quantile_cont(n, 0.5) OVER (PARTITION BY year(trade_date)) AS median_n FROM
    (SELECT trade_date, count(*) AS n FROM bars GROUP BY trade_date)) WHERE n < 0.5 * median_n""")
def qa_thin_dates(spark, sf_dir):
    return quality.thin_dates(views.bars(spark, sf_dir))


@query("""SELECT symbol, trade_date, round(reported_prev, 6) AS reported_prev, round(prev_close, 6) AS prev_close FROM
    (SELECT symbol, trade_date, prev_close, prev_close + CASE WHEN trades > 1 THEN 7.0 ELSE 0.01 END AS reported_prev FROM rets)
    WHERE abs(reported_prev - prev_close) > 0.02 AND abs(reported_prev - prev_close) > 0.005 * abs(prev_close)""")
def qa_prev_close_mismatch(spark, sf_dir):
    """Bars of several trades report a previous close that is off by 7."""
    r = views.returns(views.bars(spark, sf_dir)).withColumn("reported_prev", F.col("prev_close") + F.when(F.col("trades") > 1, 7.0).otherwise(0.01))
    return quality.prev_close_mismatch(r).select("symbol", "trade_date", rounded("reported_prev").alias("reported_prev"), rounded("prev_close").alias("prev_close"))


@query("""WITH b AS (SELECT min(trade_date) AS lo, max(trade_date) AS hi FROM sessions), d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
    SELECT day FROM d WHERE day NOT IN (SELECT trade_date FROM sessions)""")
def date_spine_missing(spark, sf_dir):
    """The work list of a backfill: calendar days without a session."""
    s = sessions(views.bars(spark, sf_dir))
    spine = date_spine(s.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi")), "lo", "hi")
    return spine.join(s, F.col("day") == F.col("trade_date"), "left_anti")


@query("""WITH raw AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), built AS (SELECT DISTINCT trade_date AS d FROM bars WHERE year(trade_date) <> 1999 OR month(trade_date) < 12)
    SELECT year(raw.d) AS year, max(raw.d) AS raw_max, count(*) AS raw_days, max(built.d) AS built_max, count(built.d) AS built_days, coalesce(max(raw.d) = max(built.d) AND count(*) = count(built.d), false) AS is_current
    FROM raw LEFT JOIN built USING (d) GROUP BY 1""")
def incremental_currency(spark, sf_dir):
    """Which years of a curated store are current: last date and number of dates equal the raw files'. December 1999 is missing here."""
    raw = views.read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    built = views.bars(spark, sf_dir).where("year(trade_date) <> 1999 or month(trade_date) < 12").select(F.col("trade_date").alias("d")).distinct().withColumn("b", F.col("d"))
    out = raw.join(built, "d", "left").groupBy(F.year("d").cast("long").alias("year")).agg(F.max("d").alias("raw_max"), F.count(F.lit(1)).alias("raw_days"), F.max("b").alias("built_max"), F.count("b").alias("built_days"))
    return out.withColumn("is_current", F.coalesce((F.col("raw_max") == F.col("built_max")) & (F.col("raw_days") == F.col("built_days")), F.lit(False)))


@query("""WITH e AS (SELECT max(trade_date) AS hi FROM bars), s AS (SELECT symbol FROM bars GROUP BY symbol HAVING max(trade_date) >= (SELECT hi FROM e) - 30)
    SELECT symbol, count(*) AS n FROM bars WHERE symbol IN (SELECT symbol FROM s) GROUP BY symbol""")
def survivor_universe(spark, sf_dir):
    return universe.survivors(views.bars(spark, sf_dir)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT symbol, ret, traded_value, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM rets),
    s AS (SELECT symbol, count(*) AS n, stddev_samp(ret) AS vol, quantile_cont(traded_value, 0.5) FILTER (WHERE back <= 21) AS liquidity FROM t GROUP BY symbol HAVING count(*) >= 252),
    b AS (SELECT quantile_cont(liquidity, 0.5) AS liquid, quantile_cont(vol, 0.25) AS low, quantile_cont(vol, 0.75) AS high FROM s),
    k AS (SELECT s.* FROM s, b WHERE liquidity >= liquid AND vol BETWEEN low AND high)
    SELECT symbol, n, round(vol, 6) AS vol, round(liquidity, 4) AS liquidity, round(0.4 * (rank() OVER (ORDER BY liquidity) + (count(*) OVER (PARTITION BY liquidity) - 1) / 2.0)
    + 0.4 * (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) + 0.2 * (rank() OVER (ORDER BY vol DESC) + (count(*) OVER (PARTITION BY vol) - 1) / 2.0), 6) AS score FROM k""")
def ticker_screen(spark, sf_dir):
    return universe.ticker_screen(views.bars(spark, sf_dir)).select("symbol", "n", rounded("vol").alias("vol"), rounded("liquidity", 4).alias("liquidity"), rounded("score").alias("score"))
