"""Risk, monitoring and live-operation reports over daily returns (trade_date, r) and logs."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.expr import EPS, average_rank, correlation, excess_kurtosis, rolling, safe_div, skew
from ..functions.temporal import fiscal_year
from .sliding import quantile as sliding_quantile
from .sliding import slide



def days() -> WindowSpec:
    """A series' rows by date; series have one row a session."""
    return Window.orderBy("trade_date")


def so_far() -> WindowSpec:
    return days().rowsBetween(Window.unboundedPreceding, 0)


def var_report(daily: DataFrame, *, min_rows: int = 60) -> DataFrame:
    """Historical and Cornish-Fisher value at risk and expected shortfall at 95 and 99 %, as losses; fewer than min_rows rows raise."""
    cuts = daily.agg(F.percentile("r", F.lit(0.05)).alias("q95"), F.percentile("r", F.lit(0.01)).alias("q99"))
    tails = daily.join(F.broadcast(cuts))  # one row
    n = F.count("r")
    tail = lambda q: -F.avg(F.when(F.col("r") <= F.col(q), F.col("r")))
    out = tails.agg(
        F.when(n >= min_rows, n).otherwise(F.raise_error(F.lit(f"value at risk needs {min_rows} observations"))).alias("n"), (-F.first("q95")).alias("var95"), (-F.first("q99")).alias("var99"), tail("q95").alias("cvar95"), tail("q99").alias("cvar99"),
        F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), skew("r").alias("skew"), excess_kurtosis("r").alias("kurtosis"),
    )

    def expanded(p: float) -> Column:
        z, s, k = NormalDist().inv_cdf(p), F.col("skew"), F.col("kurtosis")
        return -(F.col("m") + F.col("sd") * (z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36))

    return out.withColumns({"cf_var95": expanded(0.05), "cf_var99": expanded(0.01)})


def sortino_calmar(daily: DataFrame) -> DataFrame:
    """Sortino over the root mean square of the losing days, infinite without any; CAGR over the worst drawdown, 0 without one."""
    c = daily.withColumn("equity", F.product(1 + F.col("r")).over(so_far())).withColumn("dd", F.col("equity") / F.max("equity").over(so_far()) - 1)
    down = F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r"))))
    cagr = F.pow(F.max_by("equity", "trade_date"), 252 / F.count(F.lit(1))) - 1
    sortino = F.when(down.isNull(), F.lit(float("inf"))).otherwise(safe_div(F.avg("r"), down) * math.sqrt(252))
    return c.agg(sortino.alias("sortino"), F.when(F.min("dd") < 0, cagr / F.abs(F.min("dd"))).otherwise(0.0).alias("calmar"))


def rolling_sharpe(daily: DataFrame, window: int = 252) -> DataFrame:
    s = safe_div(rolling("r", window, "mean", by=days()), rolling("r", window, "std", by=days())) * math.sqrt(252)
    return daily.select("trade_date", s.alias("sharpe")).where("sharpe is not null")


def drawdown_state(daily: DataFrame, half: float = -0.10, flat: float = -0.15, *, by: tuple[str, ...] = ()) -> DataFrame:
    """equity, peak, drawdown and the action that its rails call for; with keys `by`, of each key's own series."""
    past = Window.partitionBy(*by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0) if by else so_far()
    c = daily.withColumn("equity", F.product(1 + F.col("r")).over(past)).withColumn("peak", F.max("equity").over(past)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
    return c.withColumn("state", F.when(F.col("drawdown") <= flat, "flat").when(F.col("drawdown") <= half, "half_gross").otherwise("normal"))


def worst_windows(daily: DataFrame, window: int = 21, n: int = 5) -> DataFrame:
    total = F.exp(rolling(F.log1p("r"), window, "sum", by=days())) - 1
    return daily.select("trade_date", total.alias("total")).where("total is not null").orderBy("total", "trade_date").limit(n)


def latest_adv(panel: DataFrame, rows: int = 21) -> DataFrame:
    """Each name's median traded value over its last rows."""
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return panel.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows).groupBy("symbol").agg(F.percentile("traded_value", F.lit(0.5)).alias("adv"))


def days_to_liquidate(holdings: DataFrame, adv: DataFrame, *, capital: float, participation: float = 0.2) -> DataFrame:
    """Days that each name of the latest book takes to sell at a share of its volume."""
    last = holdings.agg(F.max("rebalance_date").alias("rebalance_date"))
    book = holdings.join(F.broadcast(last), "rebalance_date").select("symbol", "weight")  # one row
    return book.join(adv, "symbol", "left").withColumn("days", F.col("weight") * capital / (F.coalesce("adv", F.lit(0.0)) * participation + 1e-9))


def alpha_beta(daily: DataFrame, market: DataFrame) -> DataFrame:
    """beta, annual alpha, its t statistic and the correlation against a market series (trade_date, m)."""
    x = daily.join(market, "trade_date")
    n, sxx = F.count(F.lit(1)), F.var_pop("m") * F.count(F.lit(1))
    beta = safe_div(F.covar_pop("r", "m"), F.nullif(F.var_pop("m"), F.lit(0.0)))
    alpha = F.avg("r") - beta * F.avg("m")
    rss = n * (F.var_pop("r") - beta * F.covar_pop("r", "m"))
    se = F.sqrt(rss / (n - 2) * (1 / n + safe_div(F.avg("m") * F.avg("m"), sxx)))
    return x.agg(n.alias("n"), beta.alias("beta"), (alpha * 252).alias("alpha"), safe_div(alpha, se).alias("alpha_t"), correlation(F.col("r"), F.col("m")).alias("corr"))


def capture(daily: DataFrame, market: DataFrame) -> DataFrame:
    """Tracking error, information ratio and the shares of the market's up and down days that are captured."""
    x = daily.join(market, "trade_date")
    gap = F.col("r") - F.col("m")
    side = lambda c: safe_div(F.avg(F.when(c, F.col("r"))), F.avg(F.when(c, F.col("m"))))
    return x.agg((F.stddev_samp(gap) * math.sqrt(252)).alias("tracking_error"), (safe_div(F.avg(gap), F.stddev_samp(gap)) * math.sqrt(252)).alias("information_ratio"), side(F.col("m") > 0).alias("up_capture"), side(F.col("m") < 0).alias("down_capture"))


def monthly(daily: DataFrame) -> DataFrame:
    """Compounded return, days and last equity of each month."""
    c = daily.withColumn("equity", F.product(1 + F.col("r")).over(so_far()))
    return c.groupBy(F.trunc("trade_date", "MM").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("ret"), F.count(F.lit(1)).alias("days"), F.max_by("equity", "trade_date").alias("equity"))


def underwater(daily: DataFrame) -> DataFrame:
    """Runs of consecutive days below the running peak (gaps and islands), with their length and depth."""
    d = drawdown_state(daily).withColumn("under", F.col("drawdown") < -EPS)
    island = F.sum(F.when(F.col("under"), 0).otherwise(1)).over(so_far())
    return d.withColumn("island", island).where("under").groupBy("island").agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end"), F.count(F.lit(1)).alias("days"), F.min("drawdown").alias("depth")).drop("island")


def regimes(market: DataFrame, *, bear_rows: int = 504, vol_rows: int = 63, quantile_rows: int = 756, quantile: float = 0.8) -> DataFrame:
    """bear: the level is at or under that of bear_rows ago; stress: volatility is at or over its rolling quantile."""
    c = market.withColumn("level", F.sum(F.log1p("m")).over(so_far())).withColumn("vol", rolling("m", vol_rows, "std", by=days()))
    c = slide(c, {"_limit": ("vol", sliding_quantile(quantile_rows, quantile))}, keys=())
    limit = F.col("_limit")
    return c.withColumn("bear", F.coalesce(F.col("level") <= F.lag("level", bear_rows).over(days()), F.lit(False))).withColumn("stress", F.coalesce(F.col("vol") >= limit, F.lit(False))).drop("_limit")


def regime_gate(flags: DataFrame) -> DataFrame:
    """Gross exposure: .5 in a stressed bear market, .75 under either, 1 else."""
    return flags.withColumn("gross", F.when(F.col("bear") & F.col("stress"), 0.5).when(F.col("bear") | F.col("stress"), 0.75).otherwise(1.0))


def rolling_beta(daily: DataFrame, futures: DataFrame, window: int = 60) -> DataFrame:
    """Beta by moments over the `window` rows before each day."""
    x = daily.join(futures, "trade_date")
    mean = lambda c: rolling(c, window, "mean", by=days(), lag=1)
    x = x.withColumns({"_r": mean("r"), "_m": mean("m"), "_rm": mean(F.col("r") * F.col("m")), "_mm": mean(F.col("m") * F.col("m"))})
    return x.select("trade_date", "r", "m", ((F.col("_rm") - F.col("_r") * F.col("_m")) / (F.col("_mm") - F.col("_m") * F.col("_m") + EPS)).alias("beta")).where("beta is not null")


def hedged(daily: DataFrame, futures: DataFrame, *, side_bps: float = 2.0, rolls: float = 12.0) -> DataFrame:
    """Returns less beta times the future's, less 2 bps of each change of beta and of the rolls."""
    b = rolling_beta(daily, futures)
    cost = side_bps / 1e4 * F.abs(F.col("beta") - F.coalesce(F.lag("beta").over(days()), F.lit(0.0))) + 2 * side_bps / 1e4 * rolls / 252 * F.abs("beta")
    return b.withColumn("cost", cost).withColumn("hedged", F.col("r") - F.col("beta") * F.col("m") - F.col("cost"))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability of a column over the reference's quantile bins, shares floored at 1e-6."""
    edges = reference.agg(F.percentile(column, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("edges"))
    at = F.size(F.filter("edges", lambda e: e < F.col(column)))
    both = reference.select(column, F.lit(1).alias("ref")).unionByName(current.select(column, F.lit(0).alias("ref"))).where(F.col(column).isNotNull()).join(F.broadcast(edges))  # one row
    shares = both.groupBy(at.alias("bin")).agg(F.sum("ref").alias("a"), F.sum(1 - F.col("ref")).alias("b"))
    total = Window.partitionBy(F.lit(1))
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(total), F.lit(1e-6))
    return shares.withColumns({"p": share("a"), "q": share("b")}).agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def rank_ic_by(scored: DataFrame, *keys: str, min_names: int = 20) -> DataFrame:
    """Spearman correlation of score and label by keys and date; null without variance."""
    r = scored.withColumns({"_a": average_rank("score", *keys, "trade_date"), "_b": average_rank("label", *keys, "trade_date")})
    return r.groupBy(*keys, "trade_date").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("_a"), F.col("_b")).alias("ic")).where(F.col("n") >= min_names)


def rank_ic(scored: DataFrame, min_names: int = 20) -> DataFrame:
    return rank_ic_by(scored, min_names=min_names)


def decile_spread(scored: DataFrame) -> DataFrame:
    """Mean label of the top less that of the bottom tenth by date: floor((rank - 1) * 10 / n)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("trade_date"))
    rank = F.row_number().over(Window.partitionBy("trade_date").orderBy("score", "symbol"))
    d = scored.withColumn("decile", F.floor((rank - 1) * 10 / n).cast("int"))
    mean = lambda k: F.avg(F.when(F.col("decile") == k, F.col("label")))
    return d.groupBy("trade_date").agg((mean(9) - mean(0)).alias("spread")).where("spread is not null")


def ic_alarm(ics: DataFrame, run: int = 21) -> DataFrame:
    """Trailing means of 63 and 252 rows, and an alarm after `run` negative rows in a row."""
    worst = F.when(F.count("ic").over(days().rowsBetween(-run + 1, 0)) == run, F.max("ic").over(days().rowsBetween(-run + 1, 0)) < 0)
    return ics.select("trade_date", "ic", rolling("ic", 63, "mean", by=days()).alias("ic_63"), rolling("ic", 252, "mean", by=days()).alias("ic_252"), F.coalesce(worst, F.lit(False)).alias("alarm"))


def post_tax(daily: DataFrame, rate: float = 0.208) -> DataFrame:
    """Tax by fiscal year with losses carried forward: what is taxed is the rise of the running maximum of cumulated profit over 0.

    Without the carry's floor that is a recurrence; with it, the taxed base to date is the running maximum of the sum, so windows do."""
    years = daily.groupBy(fiscal_year("trade_date").alias("fy")).agg(F.sum("r").alias("profit"))
    w = Window.orderBy("fy").rowsBetween(Window.unboundedPreceding, 0)  # one row a year
    base = years.withColumn("total", F.sum("profit").over(w)).withColumn("top", F.greatest(F.max("total").over(w), F.lit(0.0)))
    return base.withColumn("taxed", F.col("top") - F.coalesce(F.lag("top").over(Window.orderBy("fy")), F.lit(0.0))).select("fy", "profit", "taxed", (F.col("taxed") * rate).alias("tax"), (F.col("top") - F.col("total")).alias("carried_loss"))


def slippage(orders: DataFrame) -> DataFrame:
    """Signed slippage in bps of each order's last row, and whether it is within twice the modelled cost."""
    last = Window.partitionBy("order_id").orderBy(F.desc("at"))
    o = orders.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    bps = sign * (safe_div("fill_price", "ref_price") - 1) * 1e4
    return o.withColumn("slippage_bps", bps).withColumn("within", F.coalesce(F.col("slippage_bps") <= 2 * F.col("model_bps"), F.lit(False)))


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Positions that differ between two books (symbol, quantity); a missing one counts as 0."""
    both = expected.withColumnRenamed("quantity", "expected").join(actual.withColumnRenamed("quantity", "actual"), "symbol", "full_outer")
    e, a = F.coalesce("expected", F.lit(0)), F.coalesce("actual", F.lit(0))
    return both.select("symbol", e.alias("expected"), a.alias("actual")).where("expected <> actual")


def plan_orders(targets: DataFrame, positions: DataFrame, quotes: DataFrame, equity: float, *, band: float = 0.2, cap: float = 1e6) -> DataFrame:
    """Whole-share orders from target weights, sells first, with their deterministic id and the pre-trade verdict."""
    both = targets.join(positions, "symbol", "full_outer").join(quotes, "symbol")
    want = F.floor(F.coalesce("weight", F.lit(0.0)) * equity / F.col("price")).cast("long")
    o = both.withColumn("quantity", want - F.coalesce("held", F.lit(0))).where("quantity <> 0")
    o = o.withColumn("side", F.when(F.col("quantity") > 0, "buy").otherwise("sell")).withColumn("quantity", F.abs("quantity"))
    bad = F.when(F.col("quantity") * F.col("price") > cap, "over_cap").when(F.abs(safe_div("price", "prev_close") - 1) > band, "price_band").otherwise("ok")
    key = F.substring(F.sha2(F.concat_ws(":", F.col("symbol").cast("string"), "side", F.col("quantity").cast("string")), 256), 1, 12)
    return o.select("symbol", "side", "quantity", "price", key.alias("client_order_id"), bad.alias("verdict"), F.when(F.col("side") == "sell", 0).otherwise(1).alias("stage"))


def to_send(orders: DataFrame, history: DataFrame, *, killed: bool = False) -> DataFrame:
    """The orders that passed their checks and that the history (client_order_id) does not hold, so that a rerun sends nothing twice; none
    but sells while the kill switch is on."""
    fit = orders.where("verdict = 'ok'").join(history.select("client_order_id"), "client_order_id", "left_anti")
    return fit.where("side = 'sell'") if killed else fit


def sharpe_moments(daily: DataFrame) -> DataFrame:
    """n, mean, per-period Sharpe (n - 1 under the root), population skew and kurtosis."""
    return daily.agg(F.count("r").alias("n"), F.avg("r").alias("mean"), safe_div(F.avg("r"), F.stddev_samp("r")).alias("sr"), skew("r").alias("skew"), (excess_kurtosis("r") + 3).alias("kurtosis"))


ERF_TERMS = 120
ERF_FLAT = 6.0


def erf(x: Column) -> Column:
    """The error function: exp(-x^2) times a series of positive terms, which is exact to rounding; beyond ERF_FLAT it is 1."""
    def of(v: Column) -> Column:
        start = F.struct(v.alias("term"), v.alias("total"))
        step = lambda t, i: F.struct((t["term"] * 2 * v * v / (2 * i + 1)).alias("term"), (t["total"] + t["term"] * 2 * v * v / (2 * i + 1)).alias("total"))
        total = F.aggregate(F.sequence(F.lit(1), F.lit(ERF_TERMS)), start, step, lambda t: t["total"])
        return F.element_at(F.transform(F.array(total), lambda t: 2 / math.sqrt(math.pi) * F.exp(-v * v) * t), 1)

    near = F.greatest(F.least(x, F.lit(ERF_FLAT)), F.lit(-ERF_FLAT))
    return F.element_at(F.transform(F.array(near.cast("double")), of), 1)


def normal_cdf(x: Column) -> Column:
    return (1 + erf(x / math.sqrt(2))) / 2


def _sharpe_spread(sr: Column, skewness: Column, kurtosis: Column) -> Column:
    return 1 - skewness * sr + (kurtosis - 1) / 4 * sr * sr


def probabilistic_sharpe(n: Column, sr: Column, skewness: Column, kurtosis: Column, benchmark: float = 0.0) -> Column:
    """The probability that the true Sharpe exceeds the benchmark; a half under three observations."""
    z = (sr - benchmark) * F.sqrt(n - 1) / F.sqrt(F.greatest(_sharpe_spread(sr, skewness, kurtosis), F.lit(1e-12)))
    return F.when(n < 3, 0.5).otherwise(normal_cdf(z))


def min_track_record(sr: Column, skewness: Column, kurtosis: Column, benchmark: float = 0.0, confidence: float = 0.95) -> Column:
    """Observations after which the Sharpe exceeds the benchmark with the confidence; infinite if it does not exceed it."""
    return F.when(sr <= benchmark, F.lit(float("inf"))).otherwise(1 + _sharpe_spread(sr, skewness, kurtosis) * F.pow(NormalDist().inv_cdf(confidence) / (sr - benchmark), F.lit(2.0)))


def kupiec(n: Column, hits: Column, level: float) -> Column:
    """Likelihood ratio of the exception rate against its level, 0 at least."""
    xlogy = lambda x, y: F.when(x > 0, x * F.log(F.greatest(y, F.lit(1e-300)))).otherwise(0.0)
    p = safe_div(hits, n)
    ratio = -2 * (xlogy(n - hits, F.lit(1 - level)) + xlogy(hits, F.lit(level)) - xlogy(n - hits, 1 - p) - xlogy(hits, p))
    return F.when(n > 0, F.greatest(ratio, F.lit(0.0))).otherwise(0.0)


def kupiec_p(ratio: Column) -> Column:
    """The chi-squared probability (one degree of freedom) of a ratio as large: small values reject the model."""
    return 1 - erf(F.sqrt(ratio / 2))


def expected_max_sharpe(variance: float, trials: int) -> float:
    """The expected best of `trials` Sharpe ratios without skill."""
    if trials < 2:
        return 0.0
    g, inv = 0.5772156649015329, NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - g) * inv(1 - 1 / trials) + g * inv(1 - 1 / (trials * math.e)))


def deflated_sharpe(n: Column, sr: Column, skewness: Column, kurtosis: Column, trials: int, variance: float = (0.5 / math.sqrt(252)) ** 2) -> Column:
    return probabilistic_sharpe(n, sr, skewness, kurtosis, expected_max_sharpe(variance, trials))


def hedge_gate(hedged: DataFrame, index: DataFrame, *, limit: float = 0.1, window: int = 60) -> DataFrame:
    """One row: the mean residual beta of the later half of a hedged series (trade_date, r, cost), whether it is within the limit, and the
    yearly cost drag. index: trade_date, m."""
    beta = rolling_beta(hedged.select("trade_date", "r"), index, window)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    late = beta.withColumns({"_k": F.row_number().over(days()), "_n": n}).where("_k > _n - floor(_n / 2)")
    drag = hedged.agg((F.avg("cost") * 252).alias("cost_drag"))
    gate = late.agg(F.avg("beta").alias("residual_beta"))
    return gate.withColumn("passes", F.abs("residual_beta") < limit).join(F.broadcast(drag))  # one row each


def live_returns(log: DataFrame) -> DataFrame:
    """(trade_date, r) between the logged equities (trade_date, equity); days after an equity of 0 or less drop."""
    before = F.lag("equity").over(days())
    return log.select("trade_date", "equity", F.when(before > 0, F.col("equity") / before - 1).alias("r")).where("r is not null").select("trade_date", "r")


def live_risk(log: DataFrame, *, target_vol: float = 0.135, band: tuple[float, float] = (0.10, 0.17), min_rows: int = 21) -> DataFrame:
    """One row of a live log (trade_date, equity): days, yearly volatility and whether it is in the band, the worst drawdown, exceptions of
    the value at risk at the target volatility, and their Kupiec ratio and p-value; nothing under min_rows returns."""
    limit = 1.645 * target_vol / math.sqrt(252)
    r = live_returns(log).agg(F.count("r").alias("days"), (F.stddev_samp("r") * math.sqrt(252)).alias("vol"), F.count_if(F.col("r") < -limit).alias("exceptions"))
    dd = log.select((F.col("equity") / F.max("equity").over(so_far()) - 1).alias("dd")).agg(F.least(F.min("dd"), F.lit(0.0)).alias("max_drawdown"))
    out = r.join(F.broadcast(dd)).where(F.col("days") >= min_rows)  # one row each
    ratio = kupiec(F.col("days").cast("double"), F.col("exceptions").cast("double"), 0.05)
    return out.withColumn("in_band", F.col("vol").between(*band)).withColumn("lr", ratio).withColumn("p_value", kupiec_p(F.col("lr")))


def trailing_book_vol(log: DataFrame, *, fast: int = 21, slow: int = 63, least: float = 0.05) -> DataFrame:
    """One row: the larger of the fast and slow trailing yearly volatilities of the fully invested book's returns, from a log (trade_date,
    equity, cash); days invested by less than `least` drop, and without `fast` days it is null."""
    before, invested = F.lag("equity").over(days()), safe_div(F.col("equity") - F.col("cash"), "equity")
    book = log.select("trade_date", F.when((before > 0) & (invested > least), (F.col("equity") / before - 1) / invested).alias("r")).where("r is not null")
    back = F.row_number().over(Window.orderBy(F.desc("trade_date")))
    last = book.withColumn("_b", back)
    vol = lambda w: F.when(F.count_if(F.col("_b") <= w) == w, F.stddev_samp(F.when(F.col("_b") <= w, F.col("r"))) * math.sqrt(252))
    return last.agg(F.when(vol(fast).isNotNull(), F.greatest(vol(fast), vol(slow))).alias("vol"))


def book_vol(daily: DataFrame, *, fast: int = 21, slow: int = 63) -> DataFrame:
    """(trade_date, vol): by day the larger of the fast and slow trailing yearly volatilities of a fully invested book's returns (trade_date, r)."""
    vol = lambda w: rolling("r", w, "std", by=days()) * math.sqrt(252)
    return daily.select("trade_date", F.when(vol(fast).isNotNull(), F.greatest(vol(fast), vol(slow))).alias("vol"))
