"""Risk, monitoring and live-operation queries over the daily returns of a top-five momentum book, scaled by 0.01."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import features, risk
from ..sources import views
from .backtests import SCALE
from .backtests import scaled as _scaled
from .backtests import targets as _targets
from .registry import TABLES, query

TABLES["series"] = "SELECT trade_date, r * 0.01 AS r FROM strategy"
TABLES["index_series"] = "SELECT trade_date, mret * 0.01 AS m FROM market"
TABLES["pairs"] = "SELECT trade_date, r, m FROM series JOIN index_series USING (trade_date)"
TABLES["curve"] = "SELECT *, max(equity) OVER (ORDER BY trade_date) AS peak FROM (SELECT trade_date, r, product(1 + r) OVER (ORDER BY trade_date) AS equity FROM series)"


def series(spark, sf_dir):
    p = views.returns(views.bars(spark, sf_dir))
    p = p.withColumn("score", features.momentum_12_1()).where("score is not null and ret is not null")
    w = Window.partitionBy("trade_date").orderBy(F.desc("score"), "symbol")
    return p.withColumn("n", F.row_number().over(w)).where("n <= 5").groupBy("trade_date").agg((F.avg("ret") * SCALE).alias("r"))


def index(spark, sf_dir):
    return views.market(views.returns(views.bars(spark, sf_dir))).select("trade_date", (F.col("mret") * SCALE).alias("m"))


def scored(spark, sf_dir):
    b = views.bars(spark, sf_dir)
    s = features.score(b, features.momentum_12_1())
    return s.join(features.forward_return_z(b).where("label is not null"), ["symbol", "trade_date"])


def _r(df, *names, digits=6):
    return df.select(*[rounded(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


_M = "avg(r) AS m, stddev_samp(r) AS sd, (avg(r*r*r) - 3 * avg(r) * avg(r*r) + 2 * pow(avg(r), 3)) / pow(stddev_pop(r), 3) AS s, (avg(r*r*r*r) - 4 * avg(r) * avg(r*r*r) + 6 * avg(r) * avg(r) * avg(r*r) - 3 * pow(avg(r), 4)) / pow(var_pop(r), 2) - 3 AS k"


@query("""WITH q AS (SELECT quantile_cont(r, 0.05) AS v95, quantile_cont(r, 0.01) AS v99 FROM series) SELECT count(*) AS n, round(-any_value(v95), 8) + 0.0 AS var95, round(-any_value(v99), 8) + 0.0 AS var99,
    round(-avg(r) FILTER (WHERE r <= v95), 8) + 0.0 AS cvar95, round(-avg(r) FILTER (WHERE r <= v99), 8) + 0.0 AS cvar99 FROM series, q""")
def var_cvar(spark, sf_dir):
    return _r(risk.var_report(series(spark, sf_dir)).select("n", "var95", "var99", "cvar95", "cvar99"), "var95", "var99", "cvar95", "cvar99", digits=8)


def _cf(z: float) -> str:
    return f"round(-(m + sd * ({z} + {z * z - 1} * s / 6 + {z**3 - 3 * z} * k / 24 - {2 * z**3 - 5 * z} * s * s / 36)), 6) + 0.0"


@query(f"WITH x AS (SELECT {_M} FROM series) SELECT round(s, 4) + 0.0 AS skew, round(k, 4) + 0.0 AS kurtosis, {_cf(risk.NormalDist().inv_cdf(0.05))} AS cf_var95, {_cf(risk.NormalDist().inv_cdf(0.01))} AS cf_var99 FROM x")
def cornish_fisher_var(spark, sf_dir):
    v = risk.var_report(series(spark, sf_dir)).select("skew", "kurtosis", "cf_var95", "cf_var99")
    return _r(_r(v, "skew", "kurtosis", digits=4), "cf_var95", "cf_var99")


@query("SELECT round(avg(r) * 252 / sqrt(avg(r * r) FILTER (WHERE r < 0) * 252), 6) AS sortino, round((pow(arg_max(equity, trade_date), 252.0 / count(*)) - 1) / abs(min(equity / peak - 1)), 4) + 0.0 AS calmar FROM curve")
def sortino_calmar(spark, sf_dir):
    return _r(_r(risk.sortino_calmar(series(spark, sf_dir)), "sortino"), "calmar", digits=4)


@query("SELECT * FROM (SELECT trade_date, CASE WHEN count(*) OVER w = 252 THEN round(avg(r) OVER w / stddev_samp(r) OVER w * sqrt(252.0), 6) + 0.0 END AS sharpe FROM series WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) WHERE sharpe IS NOT NULL")
def rolling_sharpe(spark, sf_dir):
    return _r(risk.rolling_sharpe(series(spark, sf_dir)), "sharpe")


@query("SELECT trade_date, round(equity / peak - 1, 8) + 0.0 AS drawdown, CASE WHEN equity / peak - 1 <= -0.15 THEN 'flat' WHEN equity / peak - 1 <= -0.10 THEN 'half_gross' ELSE 'normal' END AS state FROM curve")
def drawdown_state(spark, sf_dir):
    return _r(risk.drawdown_state(series(spark, sf_dir)).select("trade_date", "drawdown", "state"), "drawdown", digits=8)


@query("SELECT trade_date, round(total, 6) + 0.0 AS total FROM (SELECT trade_date, CASE WHEN count(*) OVER w = 21 THEN exp(sum(ln(1 + r)) OVER w) - 1 END AS total FROM series WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) WHERE total IS NOT NULL ORDER BY total, trade_date LIMIT 5")
def worst_windows(spark, sf_dir):
    return _r(risk.worst_windows(series(spark, sf_dir)), "total")


@query("""WITH a AS (SELECT symbol, quantile_cont(traded_value, 0.5) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS n FROM bars) WHERE n <= 21 GROUP BY symbol)
    SELECT t.symbol, round(t.weight, 8) AS weight, round(a.adv, 4) AS adv, round(t.weight * 2.5e6 / (coalesce(a.adv, 0) * 0.2 + 1e-9), 6) AS days FROM targets t LEFT JOIN a USING (symbol) WHERE rebalance_date = (SELECT max(rebalance_date) FROM targets)""")
def days_to_liquidate(spark, sf_dir):
    p = _scaled(spark, sf_dir)
    d = risk.days_to_liquidate(_targets(p).select("rebalance_date", "symbol", "weight"), risk.latest_adv(p), capital=2.5e6)
    return _r(_r(_r(d, "weight", digits=8), "adv", digits=4), "days")


@query("""SELECT n, round(b, 6) + 0.0 AS beta, round(a * 252, 6) + 0.0 AS alpha, round(a / sqrt(n * (vr - b * c) / (n - 2) * (1.0 / n + mm * mm / (n * vm))), 4) + 0.0 AS alpha_t, round(c / sqrt(vr * vm), 6) + 0.0 AS corr FROM
    (SELECT *, c / vm AS b, mr - c / vm * mm AS a FROM (SELECT count(*) AS n, covar_pop(r, m) AS c, var_pop(m) AS vm, var_pop(r) AS vr, avg(r) AS mr, avg(m) AS mm FROM pairs))""")
def alpha_beta(spark, sf_dir):
    return _r(_r(risk.alpha_beta(series(spark, sf_dir), index(spark, sf_dir)), "beta", "alpha", "corr"), "alpha_t", digits=4)


@query("""SELECT round(stddev_samp(r - m) * sqrt(252.0), 6) AS tracking_error, round(avg(r - m) / stddev_samp(r - m) * sqrt(252.0), 6) + 0.0 AS information_ratio,
    round(avg(r) FILTER (WHERE m > 0) / avg(m) FILTER (WHERE m > 0), 4) + 0.0 AS up_capture, round(avg(r) FILTER (WHERE m < 0) / avg(m) FILTER (WHERE m < 0), 4) + 0.0 AS down_capture FROM pairs""")
def up_down_capture(spark, sf_dir):
    return _r(_r(risk.capture(series(spark, sf_dir), index(spark, sf_dir)), "tracking_error", "information_ratio"), "up_capture", "down_capture", digits=4)


@query("SELECT CAST(date_trunc('month', trade_date) AS DATE) AS month, round(product(1 + r) - 1, 6) + 0.0 AS ret, count(*) AS days, round(ln(arg_max(equity, trade_date)), 6) + 0.0 AS log_equity FROM curve GROUP BY 1")
def monthly_stats(spark, sf_dir):
    m = risk.monthly(series(spark, sf_dir)).withColumn("log_equity", F.log("equity")).drop("equity")
    return _r(m, "ret", "log_equity")


@query("""SELECT min(trade_date) AS start, max(trade_date) AS "end", count(*) AS days, round(min(dd), 6) + 0.0 AS depth FROM (SELECT *, sum(CASE WHEN dd < -1e-12 THEN 0 ELSE 1 END) OVER (ORDER BY trade_date) AS island FROM
    (SELECT trade_date, equity / peak - 1 AS dd FROM curve)) WHERE dd < -1e-12 GROUP BY island""")
def underwater_runs(spark, sf_dir):
    return _r(risk.underwater(series(spark, sf_dir)), "depth")


TABLES["regime_rows"] = """SELECT trade_date, coalesce(level <= lag(level, 504) OVER w, false) AS bear, coalesce(vol >= CASE WHEN count(vol) OVER q >= 756 THEN quantile_cont(vol, 0.8) OVER q END, false) AS stress FROM
    (SELECT trade_date, sum(ln(1 + m)) OVER (ORDER BY trade_date) AS level, CASE WHEN count(*) OVER v = 63 THEN stddev_samp(m) OVER v END AS vol FROM index_series WINDOW v AS (ORDER BY trade_date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
    WINDOW w AS (ORDER BY trade_date), q AS (ORDER BY trade_date ROWS BETWEEN 755 PRECEDING AND CURRENT ROW)"""


@query("SELECT * FROM regime_rows")
def regime_flags(spark, sf_dir):
    return risk.regimes(index(spark, sf_dir)).select("trade_date", "bear", "stress")


@query("SELECT gross, count(*) AS days, round(avg(r * gross), 8) + 0.0 AS mean_r FROM (SELECT CASE WHEN bear AND stress THEN 0.5 WHEN bear OR stress THEN 0.75 ELSE 1.0 END::DOUBLE AS gross, r FROM regime_rows JOIN series USING (trade_date)) GROUP BY gross")
def regime_gate(spark, sf_dir):
    g = risk.regime_gate(risk.regimes(index(spark, sf_dir))).join(series(spark, sf_dir), "trade_date")
    return g.groupBy("gross").agg(F.count(F.lit(1)).alias("days"), rounded(F.avg(F.col("r") * F.col("gross")), 8).alias("mean_r"))


TABLES["betas"] = """SELECT trade_date, r, m, (rm - ar * am) / (mm - am * am + 1e-12) AS beta FROM (SELECT trade_date, r, m, count(*) OVER w AS n, avg(r) OVER w AS ar, avg(m) OVER w AS am, avg(r * m) OVER w AS rm, avg(m * m) OVER w AS mm
    FROM pairs WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE n = 60"""


@query("""SELECT trade_date, round(beta, 4) + 0.0 AS beta, round(cost, 6) AS cost, round(r - beta * m - cost, 6) + 0.0 AS hedged FROM (SELECT *, 2e-4 * abs(beta - coalesce(lag(beta) OVER (ORDER BY trade_date), 0)) + 2 * 2e-4 * 12 / 252 * abs(beta) AS cost FROM betas)""")
def rolling_beta_hedge(spark, sf_dir):
    h = risk.hedged(series(spark, sf_dir), index(spark, sf_dir)).select("trade_date", "beta", "cost", "hedged")
    return _r(_r(h, "beta", digits=4), "cost", "hedged")


@query("""WITH f AS (SELECT trade_date, score FROM momentum), e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM f WHERE trade_date < DATE '1999-01-01'),
    b AS (SELECT len(list_filter(edges, lambda x: x < score)) AS bin, trade_date < DATE '1999-01-01' AS ref FROM f, e), s AS (SELECT bin, count(*) FILTER (WHERE ref) AS a, count(*) FILTER (WHERE NOT ref) AS c FROM b GROUP BY bin),
    p AS (SELECT greatest(a / sum(a) OVER (), 1e-6) AS p, greatest(c / sum(c) OVER (), 1e-6) AS q FROM s) SELECT round(sum((q - p) * ln(q / p)), 8) AS psi FROM p""")
def psi_drift(spark, sf_dir):
    f = features.score(views.bars(spark, sf_dir), features.momentum_12_1())
    cut = F.col("trade_date") < F.lit("1999-01-01").cast("date")
    return _r(risk.psi(f.where(cut), f.where(~cut), "score"), "psi", digits=8)


_LABEL = "SELECT symbol, trade_date, (fwd - avg(fwd) OVER d) / (stddev_samp(fwd) OVER d + 1e-12) AS label FROM (SELECT symbol, trade_date, lead(close, 5) OVER w / close - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) WHERE fwd IS NOT NULL WINDOW d AS (PARTITION BY trade_date)"
TABLES["labels5"] = _LABEL
TABLES["scored"] = "SELECT symbol, trade_date, score, label FROM momentum JOIN labels5 USING (symbol, trade_date) WHERE label IS NOT NULL"
TABLES["ics"] = """SELECT trade_date, count(*) AS n, CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS ic FROM (SELECT trade_date,
    rank() OVER (PARTITION BY trade_date ORDER BY score) + (count(*) OVER (PARTITION BY trade_date, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY trade_date ORDER BY label) + (count(*) OVER (PARTITION BY trade_date, label) - 1) / 2.0 AS b FROM scored) GROUP BY trade_date HAVING count(*) >= 20"""


@query("SELECT trade_date, n, round(ic, 6) + 0.0 AS ic FROM ics")
def rank_ic_daily(spark, sf_dir):
    return _r(risk.rank_ic(scored(spark, sf_dir)), "ic")


@query("""SELECT trade_date, round(spread, 6) + 0.0 AS spread FROM (SELECT trade_date, avg(label) FILTER (WHERE d = 9) - avg(label) FILTER (WHERE d = 0) AS spread FROM (SELECT trade_date, label, floor((row_number() OVER (PARTITION BY trade_date ORDER BY score, symbol) - 1) * 10 / count(*) OVER (PARTITION BY trade_date)) AS d FROM scored) GROUP BY trade_date) WHERE spread IS NOT NULL""")
def decile_spread(spark, sf_dir):
    return _r(risk.decile_spread(scored(spark, sf_dir)), "spread")


@query("""SELECT trade_date, round(ic, 6) + 0.0 AS ic, CASE WHEN count(ic) OVER a = 63 THEN round(avg(ic) OVER a, 6) + 0.0 END AS ic_63, CASE WHEN count(ic) OVER b = 252 THEN round(avg(ic) OVER b, 6) + 0.0 END AS ic_252,
    coalesce(CASE WHEN count(ic) OVER c = 21 THEN max(ic) OVER c < 0 END, false) AS alarm FROM ics WINDOW a AS (ORDER BY trade_date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), b AS (ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), c AS (ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def ic_decay_alarm(spark, sf_dir):
    return _r(risk.ic_alarm(risk.rank_ic(scored(spark, sf_dir))), "ic", "ic_63", "ic_252")


@query("""WITH y AS (SELECT CAST(year(trade_date) - CASE WHEN month(trade_date) < 4 THEN 1 ELSE 0 END AS INTEGER) AS fy, sum(r) AS profit FROM series GROUP BY 1), t AS (SELECT *, sum(profit) OVER (ORDER BY fy) AS total FROM y),
    x AS (SELECT *, greatest(max(total) OVER (ORDER BY fy), 0) AS top FROM t) SELECT fy, round(profit, 6) + 0.0 AS profit, round(top - coalesce(lag(top) OVER (ORDER BY fy), 0), 6) + 0.0 AS taxed, round((top - coalesce(lag(top) OVER (ORDER BY fy), 0)) * 0.208, 6) + 0.0 AS tax, round(top - total, 6) + 0.0 AS carried_loss FROM x""")
def post_tax_walk(spark, sf_dir):
    return _r(risk.post_tax(series(spark, sf_dir)), "profit", "taxed", "tax", "carried_loss")


@query("""WITH o AS (SELECT o_custkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, o_orderkey, o_totalprice AS ref_price, o_totalprice * (1 + (o_orderkey % 41 - 20) / 1e4) AS fill_price FROM orders)
    SELECT order_id, side, round(bps, 4) + 0.0 AS slippage_bps, bps <= 16 AS within FROM (SELECT *, CASE side WHEN 'buy' THEN 1 ELSE -1 END * (fill_price / ref_price - 1) * 1e4 AS bps, row_number() OVER (PARTITION BY order_id ORDER BY o_orderkey DESC) AS n FROM o) WHERE n = 1""")
def slippage_report(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("order_id"), F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("ref_price"), (F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 41 - 20) / 1e4)).alias("fill_price"), F.lit(8.0).alias("model_bps"))
    return _r(risk.slippage(rows).select("order_id", "side", "slippage_bps", "within"), "slippage_bps", digits=4)


@query("SELECT CAST(date_trunc('month', trade_date) AS DATE) AS month, round(stddev_samp(r - m) * sqrt(252.0), 6) AS tracking_error, round(sum(r - m), 6) + 0.0 AS gap FROM pairs GROUP BY 1 HAVING count(*) > 1")
def tracking_error(spark, sf_dir):
    gap = F.col("r") - F.col("m")
    x = series(spark, sf_dir).join(index(spark, sf_dir), "trade_date")
    return x.groupBy(F.trunc("trade_date", "MM").alias("month")).agg(rounded(F.stddev_samp(gap) * F.sqrt(F.lit(252.0))).alias("tracking_error"), rounded(F.sum(gap)).alias("gap"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


@query("""WITH e AS (SELECT l_suppkey AS symbol, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_suppkey % 10 <> 3 GROUP BY 1), a AS (SELECT l_suppkey AS symbol, CAST(sum(l_quantity) AS BIGINT) + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS q FROM lineitem WHERE l_suppkey % 10 <> 4 GROUP BY 1)
    SELECT coalesce(e.symbol, a.symbol) AS symbol, coalesce(e.q, 0) AS expected, coalesce(a.q, 0) AS actual FROM e FULL JOIN a ON e.symbol = a.symbol WHERE coalesce(e.q, 0) <> coalesce(a.q, 0)""")
def reconcile_full_outer(spark, sf_dir):
    q = views.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.sum("l_quantity").cast("long").alias("quantity"))
    actual = q.where("symbol % 10 <> 4").withColumn("quantity", F.col("quantity") + F.when(F.col("symbol") % 7 == 0, 1).otherwise(0))
    return risk.reconcile(q.where("symbol % 10 <> 3"), actual)


@query("SELECT trade_date FROM sessions WHERE trade_date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_custkey % 5 = 0)")
def missed_sessions_anti(spark, sf_dir):
    """Expected sessions without a logged run."""
    log = views.read(spark, sf_dir, "orders").where("o_custkey % 5 = 0").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    return views.bars(spark, sf_dir).select("trade_date").distinct().join(log, "trade_date", "left_anti")


@query("""WITH t AS (SELECT symbol, close AS price, prev_close FROM rets WHERE trade_date = (SELECT max(trade_date) FROM bars)), h AS (SELECT symbol, symbol % 4 AS held, CASE WHEN symbol % 3 = 0 THEN 0.02 ELSE 0 END AS weight, price, prev_close FROM t),
    o AS (SELECT symbol, CAST(floor(weight * 1e6 / price) AS BIGINT) - held AS q, price, prev_close FROM h)
    SELECT symbol, CASE WHEN q > 0 THEN 'buy' ELSE 'sell' END AS side, abs(q) AS quantity, substr(sha256(concat_ws(':', symbol, CASE WHEN q > 0 THEN 'buy' ELSE 'sell' END, abs(q))), 1, 12) AS client_order_id,
    CASE WHEN abs(q) * price > 1e6 THEN 'over_cap' WHEN abs(price / prev_close - 1) > 0.2 THEN 'price_band' ELSE 'ok' END AS verdict FROM o WHERE q <> 0""")
def order_plan(spark, sf_dir):
    r = views.returns(views.bars(spark, sf_dir))
    last = r.join(F.broadcast(r.agg(F.max("trade_date").alias("trade_date"))), "trade_date")  # one row
    quotes = last.select("symbol", F.col("close").alias("price"), "prev_close")
    t = last.select("symbol", F.when(F.col("symbol") % 3 == 0, 0.02).otherwise(0.0).alias("weight"))
    held = last.select("symbol", (F.col("symbol") % 4).alias("held"))
    return risk.plan_orders(t, held, quotes, 1e6).select("symbol", "side", "quantity", "client_order_id", "verdict")


_ORDERS = """WITH t AS (SELECT symbol, close AS price, prev_close FROM rets WHERE trade_date = (SELECT max(trade_date) FROM bars)), h AS (SELECT symbol, symbol % 4 AS held, CASE WHEN symbol % 3 = 0 THEN 0.02 ELSE 0 END AS weight, price, prev_close FROM t),
    o AS (SELECT symbol, CAST(floor(weight * 1e6 / price) AS BIGINT) - held AS q, price, prev_close FROM h)
    SELECT symbol, CASE WHEN q > 0 THEN 'buy' ELSE 'sell' END AS side, abs(q) AS quantity, CASE WHEN abs(q) * price > 1e6 THEN 'over_cap' WHEN abs(price / prev_close - 1) > 0.2 THEN 'price_band' ELSE 'ok' END AS verdict FROM o WHERE q <> 0"""


@query(f"SELECT symbol, side, quantity FROM ({_ORDERS}) WHERE verdict = 'ok' AND symbol % 2 = 1")
def idempotent_orders(spark, sf_dir):
    """What a rerun still sends when the orders of even symbols were sent before."""
    orders = order_plan(spark, sf_dir)
    return risk.to_send(orders, orders.where("symbol % 2 = 0")).select("symbol", "side", "quantity")


@query("SELECT count(*) AS n, round(avg(r), 8) AS mean, round(avg(r) / stddev_samp(r), 6) AS sr, round((avg(r*r*r) - 3 * avg(r) * avg(r*r) + 2 * pow(avg(r), 3)) / pow(stddev_pop(r), 3), 4) AS skew, round((avg(r*r*r*r) - 4 * avg(r) * avg(r*r*r) + 6 * avg(r) * avg(r) * avg(r*r) - 3 * pow(avg(r), 4)) / pow(var_pop(r), 2), 4) AS kurtosis FROM series")
def psr_mintrl_moments(spark, sf_dir):
    return _r(_r(_r(risk.sharpe_moments(series(spark, sf_dir)), "mean", digits=8), "sr"), "skew", "kurtosis", digits=4)


#: The normal distribution by its series: erf(x) = exp(-x^2) * sum of x^(2n+1) / gamma(n + 3/2).
_ERF = "CASE WHEN abs({x}) > 6 THEN sign({x}) ELSE exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 120), lambda n: pow({x}, 2 * n + 1) / gamma(n + 1.5))) END"
_MOMENTS = "SELECT count(*) AS n, avg(r) / stddev_samp(r) AS sr, (avg(r*r*r) - 3 * avg(r) * avg(r*r) + 2 * pow(avg(r), 3)) / pow(stddev_pop(r), 3) AS s, (avg(r*r*r*r) - 4 * avg(r) * avg(r*r*r) + 6 * avg(r) * avg(r) * avg(r*r) - 3 * pow(avg(r), 4)) / pow(var_pop(r), 2) AS k FROM series"
_BEST10 = risk.expected_max_sharpe((0.5 / 252**0.5) ** 2, 10)
_Z95 = risk.NormalDist().inv_cdf(0.95)


@query(f"""WITH m AS ({_MOMENTS}), z AS (SELECT *, sr * sqrt(n - 1) / sqrt(1 - s * sr + (k - 1) / 4 * sr * sr) / sqrt(2.0) AS x, (sr - {_BEST10}) * sqrt(n - 1) / sqrt(1 - s * sr + (k - 1) / 4 * sr * sr) / sqrt(2.0) AS y FROM m)
    SELECT round((1 + {_ERF.format(x="x")}) / 2, 8) AS psr, round((1 + {_ERF.format(x="y")}) / 2, 8) AS dsr, CASE WHEN sr <= 0 THEN 'infinity'::DOUBLE ELSE round(1 + (1 - s * sr + (k - 1) / 4 * sr * sr) * pow({_Z95} / sr, 2), 4) END AS min_track_record FROM z""")
def probabilistic_sharpe(spark, sf_dir):
    """PSR, deflated Sharpe over 10 trials and the minimum track record."""
    a = [F.col(c) for c in ("n", "sr", "skew", "kurtosis")]
    return risk.sharpe_moments(series(spark, sf_dir)).select(rounded(risk.probabilistic_sharpe(*a), 8).alias("psr"), rounded(risk.deflated_sharpe(*a, 10), 8).alias("dsr"), rounded(risk.min_track_record(*a[1:]), 4).alias("min_track_record"))


def _lr(n: str, x: str) -> str:
    return f"greatest(0, -2 * (({n} - {x}) * ln(0.95) + {x} * ln(0.05) - CASE WHEN {n} > {x} THEN ({n} - {x}) * ln(1 - {x} / {n}) ELSE 0 END - CASE WHEN {x} > 0 THEN {x} * ln({x} / {n}) ELSE 0 END))"


@query(f"""WITH v AS (SELECT trade_date, r, -1.645 * CASE WHEN count(*) OVER w = 63 THEN stddev_samp(r) OVER w END AS limit_r FROM series WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
    k AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE r < limit_r)::DOUBLE AS x FROM v WHERE limit_r IS NOT NULL), l AS (SELECT n, x, {_lr("n", "x")} AS lr FROM k)
    SELECT CAST(n AS BIGINT) AS n, CAST(x AS BIGINT) AS exceptions, round(lr, 6) + 0.0 AS lr, round(1 - {_ERF.format(x="sqrt(lr / 2)")}, 8) + 0.0 AS p_value FROM l""")
def kupiec_pof(spark, sf_dir):
    """Exceptions of a trailing parametric VaR, their likelihood ratio and its p-value."""
    from ..functions.expr import rolling

    v = series(spark, sf_dir).withColumn("limit_r", -1.645 * rolling("r", 63, "std", by=risk.days(), lag=1)).where("limit_r is not null")
    c = v.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") < F.col("limit_r")).alias("exceptions"))
    lr = risk.kupiec(F.col("n").cast("double"), F.col("exceptions").cast("double"), 0.05)
    return c.withColumn("lr", lr).select("n", "exceptions", rounded("lr").alias("lr"), rounded(risk.kupiec_p(F.col("lr")), 8).alias("p_value"))


@query("""WITH h AS (SELECT trade_date, cost, r - beta * m - cost AS r FROM (SELECT *, 2e-4 * abs(beta - coalesce(lag(beta) OVER (ORDER BY trade_date), 0)) + 2 * 2e-4 * 12 / 252 * abs(beta) AS cost FROM betas)), b AS (SELECT trade_date, (rm - ar * am) / (mm - am * am + 1e-12) AS beta FROM
    (SELECT trade_date, count(*) OVER w AS n, avg(r) OVER w AS ar, avg(m) OVER w AS am, avg(r * m) OVER w AS rm, avg(m * m) OVER w AS mm FROM (SELECT trade_date, h.r, m FROM h JOIN index_series USING (trade_date)) WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE n = 60),
    l AS (SELECT beta FROM (SELECT *, row_number() OVER (ORDER BY trade_date) AS i, count(*) OVER () AS n FROM b) WHERE i > n - n // 2)
    SELECT round(avg(beta), 6) + 0.0 AS residual_beta, abs(avg(beta)) < 0.1 AS passes, round((SELECT avg(cost) * 252 FROM h), 8) AS cost_drag FROM l""")
def hedge_gate(spark, sf_dir):
    """The residual beta of the hedged book in the later half, and the hedge's yearly cost."""
    i = index(spark, sf_dir)
    h = risk.hedged(series(spark, sf_dir), i).select("trade_date", F.col("hedged").alias("r"), "cost")
    return risk.hedge_gate(h, i).select(rounded("residual_beta").alias("residual_beta"), "passes", rounded("cost_drag", 8).alias("cost_drag"))


TABLES["live_log"] = "SELECT trade_date, 2.5e6 * product(1 + r) OVER (ORDER BY trade_date) AS equity, 2.5e6 * product(1 + r) OVER (ORDER BY trade_date) * (0.05 + 0.01 * (dayofmonth(trade_date) % 7)) AS cash FROM series"


def live_log(spark, sf_dir):
    """A live log as the series would have written it: equity from a capital, and cash of 5 to 11 %."""
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # one row a session
    e = series(spark, sf_dir).withColumn("equity", 2.5e6 * F.product(1 + F.col("r")).over(w))
    return e.select("trade_date", "equity", (F.col("equity") * (0.05 + 0.01 * (F.dayofmonth("trade_date") % 7))).alias("cash"))


@query("SELECT * FROM (SELECT trade_date, round(equity / lag(equity) OVER (ORDER BY trade_date) - 1, 8) + 0.0 AS r FROM live_log) WHERE r IS NOT NULL")
def live_returns(spark, sf_dir):
    return risk.live_returns(live_log(spark, sf_dir)).select("trade_date", rounded("r", 8).alias("r"))


@query(f"""WITH r AS (SELECT equity / lag(equity) OVER (ORDER BY trade_date) - 1 AS r FROM live_log), k AS (SELECT count(r)::DOUBLE AS n, stddev_samp(r) * sqrt(252.0) AS vol, count(*) FILTER (WHERE r < -1.645 * 0.135 / sqrt(252.0))::DOUBLE AS x FROM r), l AS (SELECT *, {_lr("n", "x")} AS lr FROM k)
    SELECT CAST(n AS BIGINT) AS days, round(vol, 8) AS vol, vol BETWEEN 0.10 AND 0.17 AS in_band, round((SELECT min(equity / peak - 1) FROM (SELECT equity, max(equity) OVER (ORDER BY trade_date) AS peak FROM live_log)), 8) + 0.0 AS max_drawdown, CAST(x AS BIGINT) AS exceptions, round(lr, 4) + 0.0 AS lr, round(1 - {_ERF.format(x="sqrt(lr / 2)")}, 8) + 0.0 AS p_value FROM l""")
def live_risk(spark, sf_dir):
    v = risk.live_risk(live_log(spark, sf_dir))
    return v.select("days", rounded("vol", 8).alias("vol"), "in_band", rounded("max_drawdown", 8).alias("max_drawdown"), "exceptions", rounded("lr", 4).alias("lr"), rounded("p_value", 8).alias("p_value"))


@query("""WITH b AS (SELECT trade_date, (equity / lag(equity) OVER (ORDER BY trade_date) - 1) / ((equity - cash) / equity) AS r FROM live_log), l AS (SELECT r, row_number() OVER (ORDER BY trade_date DESC) AS b FROM b WHERE r IS NOT NULL)
    SELECT round(greatest(stddev_samp(r) FILTER (WHERE b <= 21), stddev_samp(r) FILTER (WHERE b <= 63)) * sqrt(252.0), 8) AS vol FROM l""")
def trailing_book_vol(spark, sf_dir):
    return risk.trailing_book_vol(live_log(spark, sf_dir)).select(rounded("vol", 8).alias("vol"))
