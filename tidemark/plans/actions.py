"""Corporate-action queries. Declared actions are built from orders, with subjects by key arithmetic."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import actions, incremental
from ..sources import views
from ..stages import Stage
from .registry import TABLES, query

TABLES["ca"] = """SELECT symbol, CAST(o_orderdate AS DATE) AS ex_date, CASE o_orderkey % 40
    WHEN 0 THEN 'Bonus ' || CAST(o_orderkey % 3 + 1 AS VARCHAR) || ':' || CAST(o_orderkey % 7 + 1 AS VARCHAR) WHEN 1 THEN 'Face Value Split From Rs 10/- To Rs 9/- Per Share'
    WHEN 2 THEN 'Rights 1:5 @ Premium Rs 20' WHEN 3 THEN 'Demerger' ELSE 'Interim Dividend - Rs 2 Per Share' END AS subject FROM order_symbols"""
TABLES["ca_parsed"] = """SELECT symbol, ex_date, product(factor) AS factor FROM (SELECT DISTINCT symbol, ex_date, subject,
    CASE WHEN subject LIKE 'Bonus%' THEN CAST(regexp_extract(subject, ':(\\d+)', 1) AS DOUBLE) / (CAST(regexp_extract(subject, '(\\d+):', 1) AS DOUBLE) + CAST(regexp_extract(subject, ':(\\d+)', 1) AS DOUBLE))
    WHEN subject LIKE '%Split%' THEN 0.9::DOUBLE END AS factor FROM ca) WHERE factor IS NOT NULL GROUP BY symbol, ex_date"""
TABLES["ca_gap"] = """SELECT DISTINCT symbol, d AS ex_date, factor FROM (SELECT g.symbol, b.trade_date AS d, b.open / b.prev_close AS factor FROM
    (SELECT DISTINCT symbol, ex_date FROM ca WHERE subject LIKE 'Rights%' OR subject = 'Demerger') g ASOF JOIN rets b ON g.symbol = b.symbol AND g.ex_date <= b.trade_date) WHERE factor > 0 AND factor < 0.995"""
TABLES["ca_all"] = "SELECT * FROM ca_parsed p WHERE NOT EXISTS (SELECT 1 FROM ca_gap g WHERE g.symbol = p.symbol AND g.ex_date = p.ex_date) UNION ALL SELECT * FROM ca_gap"
TABLES["ca_snapped"] = "SELECT symbol, d AS trade_date, product(factor) AS factor FROM (SELECT e.symbol, b.trade_date AS d, e.factor FROM ca_all e ASOF JOIN rets b ON e.symbol = b.symbol AND e.ex_date <= b.trade_date) GROUP BY symbol, d"
TABLES["ca_gated"] = """SELECT *, coalesce((factor < 0.8 OR factor > 1.25) AND (ratio > 1.6 OR ratio < 0.55), false) AS rejected FROM
    (SELECT s.symbol, s.trade_date, s.factor, b.close, b.prev_close, b.close / nullif(b.prev_close, 0) / s.factor AS ratio FROM ca_snapped s JOIN rets b USING (symbol, trade_date))"""


def declared(spark, sf_dir):
    text = lambda n, d: (F.col("o_orderkey") % n + d).cast("string")
    kind = F.col("o_orderkey") % 40
    subject = F.when(kind == 0, F.concat(F.lit("Bonus "), text(3, 1), F.lit(":"), text(7, 1))).when(kind == 1, "Face Value Split From Rs 10/- To Rs 9/- Per Share").when(kind == 2, "Rights 1:5 @ Premium Rs 20").when(kind == 3, "Demerger").otherwise("Interim Dividend - Rs 2 Per Share")
    return views.read(spark, sf_dir, "orders").select(views.order_symbol(spark, sf_dir).alias("symbol"), F.to_date("o_orderdate").alias("ex_date"), subject.alias("subject"))


def _events(spark, sf_dir):
    ca, b = declared(spark, sf_dir), views.bars(spark, sf_dir)
    return b, actions.combine(actions.factor_product(actions.declared_factors(ca)), actions.gap_factors(b, actions.declared_gaps(ca)))


@query(r"""SELECT symbol, ex_date, subject, round(f, 8) AS factor FROM (SELECT DISTINCT symbol, ex_date, subject, CASE WHEN subject LIKE 'Bonus%' THEN CAST(regexp_extract(subject, ':(\d+)', 1) AS DOUBLE) /
    (CAST(regexp_extract(subject, '(\d+):', 1) AS DOUBLE) + CAST(regexp_extract(subject, ':(\d+)', 1) AS DOUBLE)) WHEN subject LIKE '%Split%' THEN 0.9::DOUBLE END AS f FROM ca) WHERE f IS NOT NULL""")
def ca_factor_parse(spark, sf_dir):
    return actions.declared_factors(declared(spark, sf_dir)).select("symbol", "ex_date", "subject", rounded("factor", 8).alias("factor"))


@query("SELECT DISTINCT symbol, ex_date FROM ca WHERE subject LIKE 'Rights%' OR subject = 'Demerger'")
def ca_gap_flag(spark, sf_dir):
    return actions.declared_gaps(declared(spark, sf_dir))


@query("SELECT symbol, ex_date, round(factor, 8) AS factor FROM ca_parsed")
def ca_events_product(spark, sf_dir):
    return actions.factor_product(actions.declared_factors(declared(spark, sf_dir))).select("symbol", "ex_date", rounded("factor", 8).alias("factor"))


@query("SELECT symbol, ex_date, round(factor, 8) AS factor FROM ca_gap")
def ca_gap_factor_asof(spark, sf_dir):
    return actions.gap_factors(views.bars(spark, sf_dir), actions.declared_gaps(declared(spark, sf_dir))).select("symbol", "ex_date", rounded("factor", 8).alias("factor"))


@query("SELECT symbol, ex_date, round(factor, 8) AS factor FROM ca_all")
def ca_combine_anti(spark, sf_dir):
    return _events(spark, sf_dir)[1].select("symbol", "ex_date", rounded("factor", 8).alias("factor"))


@query("SELECT symbol, trade_date, round(factor, 8) AS factor FROM ca_snapped")
def ca_snap_forward(spark, sf_dir):
    return actions.snap(*_events(spark, sf_dir)).select("symbol", "trade_date", rounded("factor", 8).alias("factor"))


@query("SELECT symbol, trade_date, round(factor, 8) AS factor, round(ratio, 6) AS ratio FROM ca_gated WHERE rejected")
def ca_plausibility_rejects(spark, sf_dir):
    b, e = _events(spark, sf_dir)
    return actions.gate(b, actions.snap(b, e)).where("rejected").select("symbol", "trade_date", rounded("factor", 8).alias("factor"), rounded("ratio").alias("ratio"))


_ADJUSTED = """WITH j AS (SELECT b.*, coalesce(g.factor, 1.0) AS f FROM bars b LEFT JOIN ca_gated g ON g.symbol = b.symbol AND g.trade_date = b.trade_date AND NOT g.rejected),
    c AS (SELECT *, coalesce(exp(sum(ln(f)) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1.0) AS cum FROM j)
    SELECT symbol, trade_date, round(ln(cum), 6) + 0.0 AS log_factor, round(ln(close * cum), 6) + 0.0 AS log_adj_close, round(ln(volume / cum), 6) + 0.0 AS log_adj_volume FROM c"""


@query(_ADJUSTED)
def adjusted_panel(spark, sf_dir):
    """Backward-adjusted bars, as logarithms since products of many factors span magnitudes."""
    a = actions.adjust(views.bars(spark, sf_dir), declared(spark, sf_dir))
    return a.select("symbol", "trade_date", rounded(F.log("cum_adj_factor")).alias("log_factor"), rounded(F.log("adj_close")).alias("log_adj_close"), rounded(F.log("adj_volume")).alias("log_adj_volume"))


RENAMES = [("S3", "S4X", date(1996, 6, 3)), ("S4X", "S4Y", date(1998, 1, 5)), ("S7", "S8", date(1997, 3, 3)), ("S9", "S3", date(1999, 2, 1))]


@query("""SELECT symbol, trade_date, CASE
    WHEN symbol = 'S3' AND trade_date < DATE '1996-06-03' THEN 'S4Y' WHEN symbol = 'S7' AND trade_date < DATE '1997-03-03' THEN 'S8'
    WHEN symbol = 'S9' AND trade_date < DATE '1996-06-03' THEN 'S4Y' WHEN symbol = 'S9' AND trade_date < DATE '1999-02-01' THEN 'S3' ELSE symbol END AS canon_symbol
    FROM (SELECT 'S' || CAST(symbol AS VARCHAR) AS symbol, trade_date FROM bars)""")
def rename_canonicalise(spark, sf_dir):
    b = views.bars(spark, sf_dir).select(F.concat(F.lit("S"), F.col("symbol").cast("string")).alias("symbol"), "trade_date")
    return actions.canonicalise(b, RENAMES)


@query("""WITH x AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, CASE l_returnflag WHEN 'A' THEN 'EQ' WHEN 'N' THEN 'BE' ELSE 'GS' END AS series, l_extendedprice AS value FROM lineitem)
    SELECT symbol, trade_date, series, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY CASE series WHEN 'EQ' THEN 1 ELSE 2 END, value) AS n FROM x WHERE series IN ('EQ', 'BE', 'BZ')) WHERE n = 1""")
def series_priority_dedupe(spark, sf_dir):
    series = F.when(F.col("l_returnflag") == "A", "EQ").when(F.col("l_returnflag") == "N", "BE").otherwise("GS")
    raw = views.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), series.alias("series"), F.col("l_extendedprice").alias("value"))
    return actions.equity_panel(raw).select("symbol", "trade_date", "series", "value")


_FUTURES = """SELECT trade_date, last_day(trade_date + INTERVAL 1 MONTH * k) AS expiry, 1000 * (1 + 0.01 * k) + idx AS settle FROM sessions, (SELECT unnest([0, 1, 2]) AS k)"""


@query(f"""WITH f AS (SELECT trade_date, CAST(expiry AS DATE) AS expiry, settle FROM ({_FUTURES})), r AS (SELECT *, settle / lag(settle) OVER (PARTITION BY expiry ORDER BY trade_date) - 1 AS ret FROM f)
    SELECT trade_date, expiry, round(settle, 4) AS settle, round(ret, 8) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY expiry) AS n FROM r WHERE expiry >= trade_date) WHERE n = 1""")
def front_month_roll(spark, sf_dir):
    from ..functions.temporal import sessions

    s = sessions(views.bars(spark, sf_dir)).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    f = s.select("trade_date", F.last_day(F.add_months("trade_date", F.col("k"))).alias("expiry"), (1000 * (1 + 0.01 * F.col("k")) + F.col("idx")).alias("settle"))
    return actions.front_month(f).select("trade_date", "expiry", rounded("settle", 4).alias("settle"), rounded("ret", 8).alias("ret"))


@query(_ADJUSTED)
def incremental_rebuild(spark, sf_dir):
    """The adjusted panel of a store that was filled in three batches: history, later sessions, and late bars of both."""
    b, ca = views.bars(spark, sf_dir), declared(spark, sf_dir)
    late = F.pmod(F.xxhash64("symbol", "trade_date"), F.lit(50)) == 0
    store = incremental.AdjustedStore(spark, f"{Stage(spark, 'adjusted-store').root}", buckets=2)
    edge = F.lit("1997-06-30").cast("date")
    spans = [lambda d: F.col(d) <= edge, lambda d: F.col(d) > edge]
    for within in spans:
        store.append(b.where(within("trade_date") & ~late), ca.where(within("ex_date")))
    store.append(b.where(late), ca.limit(0))
    a = store.read()
    return a.select("symbol", "trade_date", rounded(F.log("cum_adj_factor")).alias("log_factor"), rounded(F.log("adj_close")).alias("log_adj_close"), rounded(F.log("adj_volume")).alias("log_adj_volume"))
