"""Corporate actions: renames, declared and observed factors, the plausibility gate and backward adjustment."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div, shift
from ..functions.temporal import asof_forward

SERIES = ["EQ", "BE", "BZ"]  # fixed values: tradable series, best first
MAX_PASSES = 6
GAP_BELOW = 0.995
MATERIAL = (0.8, 1.25)
PLAUSIBLE = (0.55, 1.6)


def equity_panel(bhav: DataFrame, renames: list[tuple[str, str, date]] = ()) -> DataFrame:
    """One row per (symbol, trade_date): the best series wins; symbols are canonicalised."""
    priority = F.array_position(F.array(*map(F.lit, SERIES)), F.col("series"))
    best = Window.partitionBy("symbol", "trade_date").orderBy(priority, *[c for c in bhav.columns if c not in ("symbol", "trade_date", "series")])
    kept = bhav.where(F.col("series").isin(SERIES)).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return canonicalise(kept, renames)


def rename_intervals(renames: list[tuple[str, str, date]]) -> list[tuple[str, date, date, str]]:
    """(symbol, valid_from, valid_to, canonical) for every renamed symbol between change dates.

    A rename on day d applies to rows before d. The list of renames is a small reference file: each (symbol, interval) is folded
    through it in date order until nothing changes; over MAX_PASSES passes raise."""
    ordered = sorted(renames, key=lambda r: r[2])
    edges = [date.min, *sorted({r[2] for r in ordered}), date.max]
    out = []
    for symbol in {r[0] for r in ordered}:
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            now, passes = symbol, 0
            while True:
                before = now
                for old, new, on in ordered:
                    if now == old and lo < on:
                        now = new
                if now == before:
                    break
                passes += 1
                if passes > MAX_PASSES:
                    raise ValueError(f"renames of {symbol} do not settle in {MAX_PASSES} passes")
            if now != symbol:
                out.append((symbol, lo, hi, now))
    return out


def canonicalise(frame: DataFrame, renames: list[tuple[str, str, date]], on: str = "trade_date") -> DataFrame:
    """canon_symbol by the renames in force at each row's date."""
    spans = rename_intervals(list(renames))
    if not spans:
        return frame.withColumn("canon_symbol", F.col("symbol"))
    table = frame.sparkSession.createDataFrame(spans, "_s string, _from date, _to date, _canon string")
    hit = (F.col("symbol") == F.col("_s")) & (F.col(on) >= F.col("_from")) & (F.col(on) < F.col("_to"))
    return frame.join(F.broadcast(table), hit, "left").withColumn("canon_symbol", F.coalesce("_canon", "symbol")).drop("_s", "_from", "_to", "_canon")  # at most renames x dates rows


#: How subjects of any era state a bonus, a split and the events whose factor shows in prices only.
BONUS = r"(?i)\bbonus\b\D{0,8}?(\d+)\s*:\s*(\d+)"
SPLIT = r"(?i)\bsplit\b\D*?(\d+(?:\.\d+)?)\D*?\bto\b\D*?(\d+(?:\.\d+)?)"
GAP = r"(?i)\b(demerger|rights|capital reduction|scheme of arrangement)\b"


def expected_factor(subject: Column) -> Column:
    """The price factor that a subject declares: bonus a:b gives b / (a + b), a split from x down to y gives y / x; null unless below 1."""
    number = lambda p, g: F.nullif(F.regexp_extract(subject, p, g), F.lit("")).cast("double")
    a, b, x, y = number(BONUS, 1), number(BONUS, 2), number(SPLIT, 1), number(SPLIT, 2)
    factor = F.when((a > 0) & (b > 0), b / (a + b)).otherwise(1.0) * F.when((x > 0) & (y > 0) & (y < x), y / x).otherwise(1.0)
    return F.when(factor < 1, factor)


def is_gap(subject: Column) -> Column:
    """Subjects whose factor must be observed."""
    return F.coalesce(subject.rlike(GAP), F.lit(False))


def declared_factors(ca: DataFrame) -> DataFrame:
    return ca.dropDuplicates(["symbol", "ex_date", "subject"]).withColumn("factor", expected_factor(F.col("subject"))).where("factor is not null")


def declared_gaps(ca: DataFrame) -> DataFrame:
    return ca.where(is_gap(F.col("subject"))).select("symbol", "ex_date").distinct()


def factor_product(events: DataFrame, on: str = "ex_date") -> DataFrame:
    return events.groupBy("symbol", on).agg(F.product("factor").alias("factor"))


def gap_factors(panel: DataFrame, gaps: DataFrame) -> DataFrame:
    """Observed factors: the open of the first session at or after the ex-date over the previous close, where it fell."""
    day = panel.select("symbol", "trade_date", safe_div("open", shift("close", 1)).alias("factor"))
    hit = asof_forward(gaps, day, ["symbol"], "ex_date", "trade_date", ["factor"])
    return hit.where((F.col("factor") > 0) & (F.col("factor") < GAP_BELOW)).select("symbol", F.col("trade_date").alias("ex_date"), "factor").distinct()


def combine(parsed: DataFrame, gaps: DataFrame) -> DataFrame:
    """Both kinds of events; an observed factor wins over a declared one of the same key."""
    return parsed.join(gaps, ["symbol", "ex_date"], "left_anti").select("symbol", "ex_date", "factor").unionByName(gaps.select("symbol", "ex_date", "factor"))


def snap(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Factors by (symbol, trade_date): ex-dates snapped to the next session, products of what meets there; later ones drop."""
    days = panel.select("symbol", "trade_date", F.lit(1).alias("_one"))
    hit = asof_forward(events, days, ["symbol"], "ex_date", "trade_date", ["_one"]).where("trade_date is not null")
    return hit.groupBy("symbol", "trade_date").agg(F.product("factor").alias("factor"))


def _gated(priced: DataFrame) -> DataFrame:
    """Rows with close, prev_close and factor get ratio and `rejected`: a material factor that the day's move contradicts."""
    ratio = safe_div(safe_div("close", F.when(F.col("prev_close") > 0, F.col("prev_close"))), "factor")
    material = (F.col("factor") < MATERIAL[0]) | (F.col("factor") > MATERIAL[1])
    return priced.withColumn("ratio", ratio).withColumn("rejected", F.coalesce(material & ((F.col("ratio") > PLAUSIBLE[1]) | (F.col("ratio") < PLAUSIBLE[0])), F.lit(False)))


def gate(panel: DataFrame, snapped: DataFrame) -> DataFrame:
    """The snapped factors with `rejected`: a material factor that the day's move contradicts. An unknown move passes."""
    priced = panel.select("symbol", "trade_date", "close", shift("close", 1).alias("prev_close"))
    return _gated(snapped.join(priced, ["symbol", "trade_date"]))


def with_declared(panel: DataFrame, declared: DataFrame) -> DataFrame:
    """The panel's rows with prev_close and the factor that takes effect there (null without one), from declared actions (symbol, ex_date,
    subject): what combine, gap_factors and snap give, by one exchange of bars and actions by symbol.

    Bars and actions of a symbol are one sorted frame. Each action learns the next session, its open and the close before; observed factors
    take that session as their ex-date, and win over what is declared for it."""
    acts = declared.dropDuplicates(["symbol", "ex_date", "subject"]).withColumns({"_f": expected_factor(F.col("subject")), "_g": is_gap(F.col("subject"))}).where("_f is not null or _g")
    acts = acts.groupBy("symbol", F.col("ex_date").alias("trade_date")).agg(F.product("_f").alias("_f"), F.max("_g").alias("_g"))
    own = panel.columns
    bars = panel.select("symbol", "trade_date", F.lit(0).alias("_side"), F.struct(*[c for c in own if c not in ("symbol", "trade_date")]).alias("_bar"))
    shape = bars.schema["_bar"].dataType
    both = bars.withColumns({"_f": F.lit(None).cast("double"), "_g": F.lit(False)}).unionByName(acts.select("symbol", "trade_date", F.lit(1).alias("_side"), F.lit(None).cast(shape).alias("_bar"), "_f", "_g"))
    # the exchange by symbol comes after the union, which would undo one before it
    is_bar = F.col("_side") == 0
    before = Window.partitionBy("symbol").orderBy("trade_date", "_side").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("prev_close", F.when(is_bar, F.last(F.when(is_bar, F.struct("_bar.close")), ignorenulls=True).over(before)["close"]))
    ahead = Window.partitionBy("symbol").orderBy(F.desc("trade_date"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_next", F.last(F.when(is_bar, F.struct(F.col("trade_date").alias("day"), safe_div("_bar.open", "prev_close").alias("gap"))), ignorenulls=True).over(ahead))
    seen = seen.withColumn("_gap", F.when(F.col("_g") & (F.col("_next.gap") > 0) & (F.col("_next.gap") < GAP_BELOW), F.col("_next.gap")))
    # per session: its observed factor once, and declared ones but for those dated on a session that has an observed one
    one = Window.partitionBy("symbol", F.when(is_bar, F.col("trade_date")).otherwise(F.col("_next.day")))
    day = seen.withColumns({"_observed": F.max("_gap").over(one)})
    told = F.when((F.col("_side") == 1) & ~(F.col("_observed").isNotNull() & (F.col("trade_date") == F.col("_next.day"))), F.col("_f"))
    product = F.product(told).over(one)
    factor = F.when(product.isNotNull() | F.col("_observed").isNotNull(), F.coalesce(product, F.lit(1.0)) * F.coalesce("_observed", F.lit(1.0)))
    return day.withColumn("_factor", factor).where("_side = 0").select(*[F.col(c if c in ("symbol", "trade_date") else f"_bar.{c}").alias(c) for c in own], "prev_close", F.col("_factor").alias("factor"))  # dealt by symbol still


def adjust(panel: DataFrame, declared: DataFrame) -> DataFrame:
    """The panel with cum_adj_factor, the product of accepted factors strictly after each row, and adjusted prices and volume."""
    kept = _gated(with_declared(panel, declared)).withColumn("_kept", F.when(F.col("factor").isNotNull() & ~F.col("rejected"), F.col("factor")).otherwise(1.0))
    # backwards in time, so that the frame grows by a row: one that runs on to the end is multiplied anew at each row
    after = Window.partitionBy("symbol").orderBy(F.desc("trade_date")).rowsBetween(Window.unboundedPreceding, -1)
    joined = kept.withColumn("cum_adj_factor", F.coalesce(F.product("_kept").over(after), F.lit(1.0)))
    return joined.select(*panel.columns, "cum_adj_factor", *[(F.col(c) * F.col("cum_adj_factor")).alias(f"adj_{c}") for c in ("open", "high", "low", "close")], (F.col("volume") / F.col("cum_adj_factor")).alias("adj_volume"))


def front_month(futures: DataFrame) -> DataFrame:
    """The nearest expiry at or after each date, with its return against the same contract's previous settlement."""
    by_contract = Window.partitionBy("expiry").orderBy("trade_date")
    ranked = futures.withColumn("ret", safe_div("settle", F.lag("settle").over(by_contract)) - 1).where("expiry >= trade_date")
    nearest = Window.partitionBy("trade_date").orderBy("expiry")
    return ranked.withColumn("_n", F.row_number().over(nearest)).where("_n = 1").drop("_n")


def security_master(panel: DataFrame, companies: DataFrame) -> DataFrame:
    """First and last date and last trade count of each symbol, with company and industry."""
    spans = panel.groupBy("symbol").agg(F.min("trade_date").alias("first_trade_date"), F.max("trade_date").alias("last_trade_date"), F.max_by("trades", "trade_date").alias("last_trades"))
    return spans.join(companies, "symbol", "left")


def total_return(series: DataFrame) -> DataFrame:
    """pr_return, tr_return and tr_index (base 1000) of an index series (trade_date, close, div_yield in percent)."""
    by = Window.orderBy("trade_date")  # one row a session
    pr = series.withColumn("pr_return", safe_div("close", F.lag("close").over(by)) - 1)
    tr = pr.withColumn("tr_return", F.col("pr_return") + F.coalesce("div_yield", F.lit(0.0)) / 100 / 252)
    return tr.withColumn("tr_index", 1000 * F.coalesce(F.product(1 + F.coalesce("tr_return", F.lit(0.0))).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))


def alias_series(indices: DataFrame, aliases: list[str]) -> DataFrame:
    """One row a date of an index that changed its name; the first alias wins."""
    rank = F.array_position(F.array(*map(F.lit, aliases)), F.col("index_name"))
    w = Window.partitionBy("trade_date").orderBy(rank)
    return indices.where(F.col("index_name").isin(aliases)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
