"""Announcements: taxonomy, event studies, event features and sentiment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS, by_symbol, correlation, rolling, safe_div, zscore
from ..functions.ranking import global_rank
from ..functions.temporal import next_session_of
from ..workers import ship
from .backtest import long_flat
from .sliding import mean, quantile, slide
from .valence import valence

#: Fixed values: (pattern, category, direction, materiality) of subjects in any case; the first match wins.
RULES = [
    (r"substantial acquisition of shares|banking companies \(acquisition", "other", 0, 0),
    (r"(gst|tax|demand|assessment|penalty)\s+order|order received.*(gst|tax|penalty)", "litigation_regulatory", -1, 1),
    (r"(nclt|court)[- ]convened", "m_and_a", 0, 1),
    (r"pledges? to\b|pledges? substantial", "other", 0, 0),
    (r"financial result|unaudited.*result|audited.*result|results for the quarter", "earnings_result", 0, 2),
    (r"\border(s)? (win|won|received|book|bagged)|bagging|contract (award|won|received)", "order_win", 1, 1),
    (r"capacity expansion|capex|commissioning|new (plant|facility|unit)", "capex_expansion", 1, 1),
    (r"pledge", "pledge", -1, 1),
    (r"credit rating|rating.*(upgrade|downgrade|reaffirm|revised)|icra|crisil|care ratings", "rating_action", 0, 1),
    (r"amalgamation|merger|acquisition|acquire|demerger|scheme of arrangement|takeover", "m_and_a", 0, 2),
    (r"rights issue|qip|preferential (issue|allotment)|fund.?raising|raising of funds|ncd|commercial paper", "fundraising", 0, 1),
    (r"litigation|penalty|show cause|sebi order|investigation|search and seizure|insolvency|nclt", "litigation_regulatory", -1, 2),
    (r"resignation|appointment|cessation|change in (director|management|kmp)|key managerial", "board_change", 0, 0),
    (r"dividend|buyback|buy-back|bonus issue|stock split", "dividend_distribution", 1, 1),
]
CLOSE_WINDOWS = [(0, 1), (0, 5), (2, 20), (2, 60)]
CAP_DAYS = 126


def classify(frame: DataFrame, subject: str = "subject") -> DataFrame:
    """category, direction and materiality by the first matching rule; null and unmatched subjects are other."""
    text = F.lower(F.col(subject))
    kind = F.struct(F.lit("other").alias("category"), F.lit(0).alias("direction"), F.lit(0).alias("materiality"))
    for pattern, category, direction, materiality in reversed(RULES):
        kind = F.when(text.rlike(pattern), F.struct(F.lit(category).alias("category"), F.lit(direction).alias("direction"), F.lit(materiality).alias("materiality"))).otherwise(kind)
    return frame.withColumn("_kind", kind).select(*frame.columns, "_kind.*")


def dedupe(events: DataFrame, universe: DataFrame) -> DataFrame:
    """One event per (symbol, knowable_date, category) of names in the universe on that day."""
    days = universe.where("in_universe").select("symbol", F.col("trade_date").alias("knowable_date"))
    return events.dropDuplicates(["symbol", "knowable_date", "category"]).join(days, ["symbol", "knowable_date"], "left_semi")


def market_model(panel_returns: DataFrame, market: DataFrame, *, window: int = 120, min_rows: int = 60) -> DataFrame:
    """(symbol, trade_date, ar): abnormal returns against a beta from the rows strictly before."""
    rows = panel_returns.where("ret is not null").join(market, "trade_date").select("symbol", "trade_date", "ret", "mret", (F.col("ret") * F.col("mret")).alias("_rm"), (F.col("mret") * F.col("mret")).alias("_mm"))
    before = mean(window, min_rows=min_rows, lag=1)
    m = slide(rows, {"_x": ("mret", before), "_y": ("ret", before), "_xy": ("_rm", before), "_xx": ("_mm", before)})
    beta = (F.col("_xy") - F.col("_x") * F.col("_y")) / (F.col("_xx") - F.col("_x") * F.col("_x") + EPS)
    return m.withColumn("beta", beta).withColumn("ar", F.col("ret") - (F.col("_y") - F.col("beta") * F.col("_x")) - F.col("beta") * F.col("mret")).where("ar is not null").select("symbol", "trade_date", "ar")


def car(abnormal: DataFrame, events: DataFrame, windows: list[tuple[int, int]] = CLOSE_WINDOWS, extra: tuple[str, ...] = ("category",)) -> DataFrame:
    """Cumulative abnormal returns by event and window; incomplete windows drop.

    The sum over rows [s, e] after the event is that of a window which slides from the last row back, so no interval join is needed."""
    spans = {f"_{s}_{e}": ("ar", mean(e - s + 1, lag=s)) for s, e in windows}
    slid = slide(abnormal, spans, order=[F.desc("trade_date")])
    sums = slid.withColumns({f"_{s}_{e}": F.col(f"_{s}_{e}") * (e - s + 1) for s, e in windows})
    hit = events.join(sums, (events["symbol"] == sums["symbol"]) & (events["knowable_date"] == sums["trade_date"])).drop(sums["symbol"])
    each = F.explode(F.array(*[F.struct(F.lit(f"[{s},{e}]").alias("window"), F.col(f"_{s}_{e}").alias("car")) for s, e in windows]))
    return hit.select("symbol", "knowable_date", *extra, each.alias("w")).select("symbol", "knowable_date", *extra, "w.window", "w.car").where("car is not null")


def car_table(cars: DataFrame, *, min_events: int = 30) -> DataFrame:
    """Mean, t and count by category and window."""
    t = safe_div(F.avg("car") * F.sqrt(F.count("car")), F.stddev_samp("car"))
    return cars.groupBy("category", "window").agg(F.count("car").alias("n"), F.avg("car").alias("mean_car"), t.alias("t")).where(F.col("n") >= min_events)


def car_bootstrap(cars: DataFrame, *, n_boot: int = 2000, seed: int = 11) -> DataFrame:
    """Two-sided bootstrap p-values of the mean by category and window. No group is gathered: each of its 64 parts draws Poisson(1)
    weights for every replicate, and the replicates' sums are added up."""
    ship(cars.sparkSession)
    means = cars.groupBy("category", "window").agg(F.avg("car").alias("mean"))
    rows = cars.withColumn("part", F.pmod(F.xxhash64("symbol", "knowable_date"), F.lit(64))).join(means, ["category", "window"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(g["part"].iloc[0])])
        x = (g["car"] - g["mean"]).to_numpy()
        sums, counts = np.zeros(n_boot), np.zeros(n_boot)
        for k in range(0, len(x), 256):
            w = rng.poisson(1.0, (n_boot, len(x[k : k + 256])))
            sums += w @ x[k : k + 256]
            counts += w.sum(1)
        return pd.DataFrame({"category": g["category"].iloc[0], "window": g["window"].iloc[0], "draw": np.arange(n_boot), "s": sums, "n": counts})

    parts = rows.groupBy("category", "window", "part").applyInPandas(run, "category string, window string, draw long, s double, n double")
    draws = parts.groupBy("category", "window", "draw").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1.0))).alias("m"))
    return draws.join(means, ["category", "window"]).groupBy("category", "window").agg(F.first("mean").alias("mean_car"), F.avg((F.abs("m") >= F.abs("mean")).cast("double")).alias("p_value"))


def quintiles(day0: DataFrame, value: str = "ar") -> DataFrame:
    """quintile 0..4 = floor(rank * 5 / (n + 1)) of the day-0 abnormal return; ties go by symbol and day."""
    n = day0.agg(F.count(F.lit(1)).alias("_all"))
    ranked = global_rank(day0, value, "symbol", "knowable_date").join(F.broadcast(n))  # one row
    return ranked.withColumn("quintile", F.floor(F.col("rank") * 5 / (F.col("_all") + 1)).cast("int")).drop("rank", "_all")


def event_features(grid: DataFrame, events: DataFrame, meetings: DataFrame, abnormal: DataFrame) -> DataFrame:
    """Nine point-in-time event features on a (symbol, trade_date) grid.

    events: symbol, knowable_date, category, direction, materiality, at most one per (symbol, day, category); meetings: symbol,
    meeting_date, known_date. Grid days, events by day and meetings by day are one frame by (symbol, day), and all features are
    windows over it, so that rows are dealt by symbol once."""
    capped = lambda d: F.log1p(F.least(F.greatest(F.coalesce(d, F.lit(CAP_DAYS)), F.lit(0)), F.lit(CAP_DAYS)).cast("double"))
    kinds = {"n_events_63d": F.lit(True), "n_negative_63d": F.col("direction") < 0, "n_positive_63d": F.col("direction") > 0, "n_pledge_63d": F.col("category") == "pledge", "n_litigation_63d": F.col("category") == "litigation_regulatory"}
    none = F.lit(None)
    facts = {"on_grid": none.cast("boolean"), "ar": none.cast("double"), "material": none.cast("boolean"), "earnings": none.cast("boolean"), "known_date": none.cast("date"), **{k: none.cast("long") for k in kinds}}

    def rows(df: DataFrame, day: str, **have: Column) -> DataFrame:
        return df.select("symbol", F.col(day).alias("trade_date"), *[have.get(c, empty).alias(c) for c, empty in facts.items()])

    told = events.groupBy("symbol", "knowable_date").agg(F.max(F.col("materiality") >= 1).alias("material"), F.max(F.col("category") == "earnings_result").alias("earnings"), *[F.count_if(c).alias(n) for n, c in kinds.items()])
    parts = [
        rows(grid, "trade_date", on_grid=F.lit(True)), rows(abnormal, "trade_date", ar=F.col("ar")), rows(meetings, "meeting_date", known_date=F.col("known_date")),
        rows(told, "knowable_date", material=F.col("material"), earnings=F.col("earnings"), **{k: F.col(k) for k in kinds}),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    days = every.groupBy("symbol", "trade_date").agg(*[(F.min(c) if c == "known_date" else F.max(c)).alias(c) for c in facts])
    days = days.where("on_grid or n_events_63d is not null or known_date is not null")  # a return counts on an event's own day only
    before = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("symbol").orderBy(F.desc("trade_date")).rowsBetween(Window.unboundedPreceding, 0)  # from the end: one step a row
    span = Window.partitionBy("symbol").orderBy(F.datediff("trade_date", F.lit("1970-01-01"))).rangeBetween(-62, 0)
    day = F.col("trade_date")
    event = F.last(F.when(F.col("material"), F.struct(day.alias("day"), F.coalesce("ar", F.lit(0.0)).alias("ar"))), ignorenulls=True).over(before)
    meeting = F.last(F.when(F.col("known_date").isNotNull(), F.struct(day.alias("day"), "known_date")), ignorenulls=True).over(ahead)
    carried = days.withColumns({"_event": event, "_earnings": F.last(F.when(F.col("earnings"), day), ignorenulls=True).over(before), "_meeting": meeting, **{n: F.coalesce(F.sum(n).over(span), F.lit(0)) for n in kinds}}).where("on_grid")
    known = F.when(F.col("_meeting.known_date") <= day, F.datediff("_meeting.day", "trade_date"))
    return carried.select("symbol", "trade_date", capped(F.datediff("trade_date", "_event.day")).alias("days_since_event"), capped(F.datediff("trade_date", "_earnings")).alias("days_since_earnings"), F.coalesce("_event.ar", F.lit(0.0)).alias("last_event_ar"), *kinds, capped(known).alias("days_to_board_meeting"))


def normalise(features: DataFrame) -> DataFrame:
    names = [c for c in features.columns if c not in ("symbol", "trade_date")]
    return features.select("symbol", "trade_date", *[F.coalesce(zscore(F.col(n).cast("double")), F.lit(0.0)).alias(n) for n in names])


#: Words with their valence. A short list for corporate news of our own; a longer one, as graded lists of thousands of words, is a parameter.
LEXICON = {
    2.0: "approval approved award awarded awards bagged bags benefit best bonus buy-back completed completes completion dividend gain gains growth higher improved improvement increase increased launch launches new "
    "opens partnership profit profits record reaffirmed recovery rise rises secures strong success successful surplus upgrade upgraded win wins won",
    -2.0: "breach cancellation cancelled cessation charge closed closure decline declined decrease default defaults delay delayed demand deficit downgrade downgraded dispute fall falls fine fined fraud insolvency investigation "
    "litigation loss losses lower notice penalty petition pledge resignation resigned seizure shortage strike suspended suspension terminated termination violation weak withdrawal withdrawn",
}
NEWS_CUTOFF_MINUTE = 15 * 60 + 30


def sentiment(subject: Column, lexicon: dict[float, str] = LEXICON) -> Column:
    """A text's compound score by valence rules with the lexicon's words; 0 for a missing or empty text."""
    return F.coalesce(valence(subject, {w: v for v, words in lexicon.items() for w in words.split()}), F.lit(0.0))


def daily_sentiment(announcements: DataFrame, calendar: DataFrame, *, zone: str | None = None, lexicon: dict[float, str] = LEXICON) -> DataFrame:
    """(trade_date, sentiment, n): texts after the cutoff count for the next day, and each day's mean for the next session; sessions
    that several days roll to get the mean of their means. Days beyond the calendar drop. Times are local, or UTC if `zone` names where
    the cutoff holds."""
    ship(announcements.sparkSession)
    at = F.col("announced_at") if zone is None else F.from_utc_timestamp("announced_at", zone)
    day = F.date_add(F.to_date(at), F.when(F.hour(at) * 60 + F.minute(at) >= NEWS_CUTOFF_MINUTE, 1).otherwise(0))
    scored = announcements.select(day.alias("day"), sentiment(F.col("subject"), lexicon).alias("s"))
    daily = scored.groupBy("day").agg(F.avg("s").alias("sentiment"), F.count(F.lit(1)).alias("n"))
    rolled = daily.join(next_session_of(daily.select("day"), calendar, "day"), "day")
    return rolled.groupBy(F.col("_next").alias("trade_date")).agg(F.avg("sentiment").alias("sentiment"), F.sum("n").alias("n"))


def sentiment_gate(prices: DataFrame, index: DataFrame, *, short: int = 5, long: int = 252) -> DataFrame:
    """Per session sent_5d, sent_med, whether the first is above the second, and the returns of the next one and five sessions.

    prices: trade_date, ret, level. sent_5d is the mean of the last `short` sessions, 0 where there was no text; sent_med its median over
    `long` sessions, all of them there; of an even number the upper middle value."""
    by = Window.orderBy("trade_date")  # one row a session
    j = prices.join(index, "trade_date", "left").withColumn("sent_5d", rolling(F.coalesce("sentiment", F.lit(0.0)), short, "mean", by=by))
    j = slide(j, {"sent_med": ("sent_5d", quantile(long, upper=True))}, keys=())
    j = j.withColumns({"fwd1": F.lead("ret").over(by), "fwd5": safe_div(F.lead("level", 5).over(by), "level") - 1})
    return j.where("sent_5d is not null and sent_med is not null and fwd1 is not null").withColumn("risk_on", F.col("sent_5d") > F.col("sent_med"))


def sentiment_study(gate: DataFrame, index: DataFrame, *, buy: float, sell: float, min_days: int = 500) -> DataFrame:
    """One row: usable and covered days, correlations with the next returns, and the Sharpe ratios, after costs, of being long where the
    gate is on and always; the figures are null under min_days."""
    run = lambda pred, n: long_flat(gate.select("trade_date", pred.alias("pred"), F.col("fwd1").alias("target")), buy=buy, sell=sell).select("trade_date", F.col("net").alias(n), F.col("position").alias(f"{n}_position"))
    both = gate.join(run(F.when(F.col("risk_on"), 1.0).otherwise(-1.0), "gated"), "trade_date").join(run(F.lit(1.0), "always"), "trade_date")
    sharpe = lambda c: F.coalesce(safe_div(F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0))) * F.sqrt(F.lit(252.0)), F.lit(0.0))
    enough = F.count(F.lit(1)) >= min_days
    has5 = F.col("fwd5").isNotNull()
    figures = {
        "ic_next_day": correlation(F.col("sent_5d"), F.col("fwd1")), "ic_next_5d": correlation(F.when(has5, F.col("sent_5d")), F.col("fwd5")), "gated_sharpe": sharpe("gated"), "always_long_sharpe": sharpe("always"),
        "gated_minus_always": sharpe("gated") - sharpe("always"), "time_in_market": F.avg("gated_position"),
    }
    out = both.agg(F.count(F.lit(1)).alias("n_days"), *[F.when(enough, v).alias(n) for n, v in figures.items()])
    return out.join(F.broadcast(index.agg(F.count(F.lit(1)).alias("coverage_days"))))  # one row each


def audit_sample(events: DataFrame, *, per_category: int = 27, total: int = 300, chars: int = 200) -> DataFrame:
    """At most `per_category` events of each category, `total` in all, with short subjects."""
    w = Window.partitionBy("category").orderBy("event_id")
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_category).orderBy("category", "event_id").limit(total).select("event_id", "category", F.substring("subject", 1, chars).alias("subject"))
