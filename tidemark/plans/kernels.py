"""Path-dependent kernels, construction stages, the expression language and single-name tools."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dsl
from ..functions.expr import by_symbol, rolling, rounded, zscore
from ..functions.temporal import sessions
from ..operators import backtest, books, emd, engine, portfolio, risk, sliding, universe, wavelet
from ..sources import views
from ..stages import Stage
from . import backtests
from .panel import SCALED
from .registry import TABLES, query

CONFIGS = [portfolio.Config(capital=2.5e6), portfolio.Config(scheme="ivol", tau=0.5), portfolio.production(2.5e6)]
TABLES["vols"] = "SELECT symbol, trade_date, CASE WHEN count(ret) OVER w = 63 THEN stddev_samp(ret * 0.01) OVER w * sqrt(252.0) END AS vol FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
TABLES["vol_book"] = "SELECT t.rebalance_date, t.symbol, (1 / v.vol) / sum(1 / v.vol) OVER (PARTITION BY t.rebalance_date) AS weight, r_name AS industry FROM targets t JOIN vols v ON v.symbol = t.symbol AND v.trade_date = t.rebalance_date LEFT JOIN supplier ON s_suppkey = t.symbol LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"


def picked(spark, sf_dir):
    """The target book with each name's volatility, volume, industry and trailing returns over a risk window of sessions."""
    panel = backtests.staged(spark, sf_dir)
    picks = backtests.targets(panel).join(views.sectors(spark, sf_dir).select("symbol", "industry"), "symbol", "left")
    return portfolio.risk_windows(panel, picks, sessions(panel)), panel


def vol_book(spark, sf_dir):
    """The target book with 63-row volatilities."""
    panel = backtests.scaled(spark, sf_dir)
    risk_in = panel.select("symbol", F.col("trade_date").alias("rebalance_date"), (rolling("ret", 63, "std") * F.sqrt(F.lit(252.0))).alias("vol"))
    return backtests.targets(panel).join(risk_in, ["symbol", "rebalance_date"]).join(views.sectors(spark, sf_dir).select("symbol", "industry"), "symbol", "left")


@query("SELECT rebalance_date, symbol, round(weight, 8) AS weight FROM vol_book")
def inverse_vol_weights(spark, sf_dir):
    return portfolio.inverse_vol(vol_book(spark, sf_dir)).select("rebalance_date", "symbol", rounded("weight", 8).alias("weight"))


@query("SELECT rebalance_date, symbol, round(CASE WHEN industry IS NULL THEN weight ELSE weight * least(1, 0.4 / sum(weight) OVER (PARTITION BY rebalance_date, industry)) END, 8) AS weight FROM vol_book")
def sector_cap(spark, sf_dir):
    return portfolio.cap_sectors(portfolio.inverse_vol(vol_book(spark, sf_dir)), 0.4).select("rebalance_date", "symbol", rounded("weight", 8).alias("weight"))


_ROUND_SQL = "SELECT rebalance_date, symbol, least(weight, 0.22) + least(sum(greatest(weight - 0.22, 0)) OVER d, sum(greatest(0.22 - weight, 0)) OVER d) * coalesce(greatest(0.22 - weight, 0) / nullif(sum(greatest(0.22 - weight, 0)) OVER d, 0), 0) AS weight FROM {} WINDOW d AS (PARTITION BY rebalance_date)"


@query(f"WITH a AS ({_ROUND_SQL.format('vol_book')}), b AS ({_ROUND_SQL.format('a')}), c AS ({_ROUND_SQL.format('b')}) SELECT rebalance_date, symbol, round(weight, 8) AS weight FROM c")
def position_cap(spark, sf_dir):
    return portfolio.cap_positions(portfolio.inverse_vol(vol_book(spark, sf_dir)), 0.22, rounds=3).select("rebalance_date", "symbol", rounded("weight", 8).alias("weight"))


@query("""WITH p AS (SELECT symbol, rebalance_date, weight, coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY rebalance_date), 0) AS prior FROM vol_book), n AS (SELECT *, CASE WHEN weight > 0 AND abs(weight - prior) < 0.25 * weight THEN prior ELSE weight END AS held FROM p)
    SELECT symbol, rebalance_date, round(held, 8) AS held, round(CASE WHEN held = 0 AND prior + 0.5 * (held - prior) < 0.005 THEN 0 ELSE prior + 0.5 * (held - prior) END, 8) AS weight FROM n""")
def no_trade_band(spark, sf_dir):
    """One step of band and partial adjustment against the name's last weight."""
    w = Window.partitionBy("symbol").orderBy("rebalance_date")
    b = portfolio.inverse_vol(vol_book(spark, sf_dir)).withColumn("prior", F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    b = b.withColumn("held", portfolio.no_trade(F.col("weight"), F.col("prior"), 0.25))
    return b.select("symbol", "rebalance_date", rounded("held", 8).alias("held"), rounded(portfolio.partial(F.col("held"), F.col("prior"), 0.5, 0.005), 8).alias("weight"))


TABLES["book_names"] = "SELECT r.symbol, r.trade_date, r.ret * 0.01 AS ret FROM rets r WHERE r.ret IS NOT NULL AND r.symbol IN (SELECT symbol FROM universe WHERE liquidity_rank <= 20)"
TABLES["demeaned"] = "SELECT symbol, trade_date, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM book_names"


def book_names(spark, sf_dir):
    """All returns of the names that were ever in the point-in-time universe."""
    panel = backtests.scaled(spark, sf_dir)
    names = universe.pit_universe(panel, **SCALED).where("in_universe").select("symbol").distinct()
    return Stage(spark, "book-names").write(panel.where("ret is not null").select("symbol", "trade_date", "ret").join(names, "symbol", "left_semi"))  # read several times


@query("SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(covar_pop(a.ret, b.ret), 8) + 0.0 AS cov FROM book_names a JOIN book_names b ON a.trade_date = b.trade_date AND a.symbol <= b.symbol GROUP BY 1, 2")
def pairwise_covariance(spark, sf_dir):
    return portfolio.pair_moments(book_names(spark, sf_dir)).select("a", "b", "n", rounded("cov", 8).alias("cov"))


@query("""WITH g AS (SELECT trade_date, pow(0.94, row_number() OVER (ORDER BY trade_date DESC) - 1) AS w FROM (SELECT DISTINCT trade_date FROM demeaned))
    SELECT a.symbol AS a, b.symbol AS b, round(sum(w * a.x * b.x) / (SELECT sum(w) FROM g), 8) + 0.0 AS cov FROM demeaned a JOIN demeaned b ON a.trade_date = b.trade_date AND a.symbol <= b.symbol JOIN g ON g.trade_date = a.trade_date GROUP BY 1, 2""")
def ewma_covariance(spark, sf_dir):
    return portfolio.ewma_moments(book_names(spark, sf_dir)).select("a", "b", rounded("cov", 8).alias("cov"))


@query("""WITH t AS (SELECT count(DISTINCT trade_date)::DOUBLE AS t FROM demeaned), s AS (SELECT a.symbol AS a, b.symbol AS b, sum(a.x * b.x) / any_value(t) AS s, sum(a.x * a.x * b.x * b.x) / any_value(t) AS q FROM demeaned a JOIN demeaned b ON a.trade_date = b.trade_date, t GROUP BY 1, 2),
    m AS (SELECT sum(s) FILTER (WHERE a = b) / count(*) FILTER (WHERE a = b) AS mu, count(*) FILTER (WHERE a = b) AS p, sum(s * s) AS ss, sum(q) AS qs FROM s), k AS (SELECT mu, least((qs - ss) / t, ss - p * mu * mu) / (ss - p * mu * mu) AS d FROM m, t)
    SELECT a, b, round(CASE WHEN a = b THEN d * mu ELSE 0 END + (1 - d) * s, 8) + 0.0 AS cov FROM s, k WHERE a <= b""")
def ledoit_wolf_covariance(spark, sf_dir):
    return portfolio.ledoit_wolf(book_names(spark, sf_dir)).select("a", "b", rounded("cov", 8).alias("cov"))


@query("""WITH p AS (SELECT t.rebalance_date, t.symbol, s.idx FROM targets t JOIN sessions s ON s.trade_date = t.rebalance_date)
    SELECT p.rebalance_date, p.symbol, count(r.ret) AS obs, CASE WHEN count(r.ret) >= 63 THEN round(stddev_samp(r.ret * 0.01) * sqrt(252.0), 8) END AS vol FROM p LEFT JOIN (SELECT r.*, s.idx FROM rets r JOIN sessions s USING (trade_date) WHERE ret IS NOT NULL) r
    ON r.symbol = p.symbol AND r.idx > p.idx - 252 AND r.idx <= p.idx GROUP BY p.rebalance_date, p.symbol""")
def risk_inputs(spark, sf_dir):
    return picked(spark, sf_dir)[0].select("rebalance_date", "symbol", "obs", rounded("vol", 8).alias("vol"))


def _realised(panel):
    """By day the volatility of the fully invested equal-weight book, which the volatility target reads."""
    return risk.book_vol(backtest.run(panel, backtests.targets(panel)).select("trade_date", F.col("gross_return").alias("r")))


@query(f"""WITH d AS ({backtests.daily_sql()}) SELECT trade_date, CASE WHEN count(*) OVER f = 21 THEN round(greatest(stddev_samp(gross_return) OVER f, CASE WHEN count(*) OVER s = 63 THEN stddev_samp(gross_return) OVER s END) * sqrt(252.0), 8) END AS vol
    FROM d WINDOW f AS (ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), s AS (ORDER BY trade_date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def book_volatility(spark, sf_dir):
    return _realised(backtests.staged(spark, sf_dir)).select("trade_date", rounded("vol", 8).alias("vol"))


@query()
def construct_books(spark, sf_dir):
    """Equal with bands, inverse-vol with tau, and min-variance with tau."""
    rows, panel = picked(spark, sf_dir)
    return portfolio.construct(rows, CONFIGS, _realised(panel))


@query()
def construction_study(spark, sf_dir):
    """The eight configurations as daily books with drift, trading rules, costs and their own volatility target."""
    rows, panel = picked(spark, sf_dir)
    daily = Stage(spark, "study").write(books.run_books(panel, rows, sessions(panel), books.study(capital=2500.0)))
    r = F.col("net_return")
    return daily.groupBy("config").agg(F.count(F.lit(1)).alias("days"), (F.avg(r) / F.stddev_samp(r) * F.sqrt(F.lit(252.0))).alias("sharpe"), (F.stddev_samp(r) * F.sqrt(F.lit(252.0))).alias("vol"), (F.product(1 + r) - 1).alias("total"), F.sum("cost").alias("cost"), (F.sum("turnover") / (F.count(F.lit(1)) / 252.0)).alias("turnover_a_year"), F.avg("target_gross").alias("gross"))


@query(f"SELECT trade_date, round(gross_return, 8) + 0.0 AS gross_return, round(cost, 8) + 0.0 AS cost, round(turnover, 8) + 0.0 AS turnover FROM ({backtests.daily_sql()})")
def book_fold_daily(spark, sf_dir):
    """The equal-weight book by the fold: without caps, bands and volatility target it is the closed form's."""
    rows, panel = picked(spark, sf_dir)
    free = portfolio.Config(position_cap=1.0, sector_cap=1.0, adv_limit=1e9, band=0.0, target_vol=1e9)
    d = books.run_books(panel, rows, sessions(panel), [free])
    first = d.where("turnover > 0").agg(F.min("idx").alias("first"))
    return d.join(F.broadcast(first)).where("idx >= first").select("trade_date", *[rounded(c, 8).alias(c) for c in ("gross_return", "cost", "turnover")])  # one row


def _dsl_sql() -> str:
    d = "ret"
    body = {
        "vol_ratio_21_63": "sd21 / (sd63 + 1e-6)", "range_pos_21d": "(close - lo) / (hi - lo + 1e-6)", "illiq_trend_5_63": "il5 / (il63 + 1e-12)",
        "rev_gap_2d": "-r2 + 0.05 * r126", "turnover_shock_5d": "tv5 / (tv63 + 1.0)", "month_turn_drift": "r21 - r5",
    }
    full = lambda n, w, x, c="*": f"CASE WHEN count({c}) OVER w{w} = {w} THEN {x} OVER w{w} END AS {n}"
    cols = ", ".join([full("sd21", 21, f"stddev_samp({d})", d), full("sd63", 63, f"stddev_samp({d})", d), full("lo", 21, "min(close)"), full("hi", 21, "max(close)"), full("il5", 5, f"avg(abs({d}) / (traded_value + 1.0))", d), full("il63", 63, f"avg(abs({d}) / (traded_value + 1.0))", d), full("r2", 2, f"avg({d})", d), full("r126", 126, f"avg({d})", d), full("tv5", 5, "avg(traded_value)"), full("tv63", 63, "avg(traded_value)"), full("r21", 21, f"avg({d})", d), full("r5", 5, f"avg({d})", d)])
    frames = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (2, 5, 21, 63, 126))
    return f"SELECT symbol, trade_date, {', '.join(f'round({v}, 6) + 0.0 AS {k}' for k, v in body.items())} FROM (SELECT symbol, trade_date, close, {cols} FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY trade_date), {frames})"


@query(_dsl_sql())
def dsl_seed_features(spark, sf_dir):
    b = views.bars(spark, sf_dir)
    return sliding.evaluate(b, dsl.arrays(dsl.SEEDS)).select("symbol", "trade_date", *[rounded(n).alias(n) for n in dsl.SEEDS])


TABLES["dsl_x"] = "SELECT symbol, trade_date, a / (b + 1e-6) AS x FROM (SELECT symbol, trade_date, CASE WHEN count(ret) OVER f = 21 THEN stddev_samp(ret) OVER f END AS a, CASE WHEN count(ret) OVER s = 63 THEN stddev_samp(ret) OVER s END AS b FROM rets WINDOW f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) WHERE a IS NOT NULL AND b IS NOT NULL"


@query("SELECT symbol, trade_date, round((x - avg(x) OVER d) / (stddev_samp(x) OVER d + 1e-12), 4) + 0.0 AS z FROM dsl_x WINDOW d AS (PARTITION BY trade_date)")
def dsl_candidate(spark, sf_dir):
    """A candidate feature, z-scored by date."""
    c = views.bars(spark, sf_dir).select("symbol", "trade_date", dsl.compile_expression(dsl.SEEDS["vol_ratio_21_63"]).alias("x")).where("x is not null")
    return c.select("symbol", "trade_date", rounded(zscore("x"), 4).alias("z"))


@query()
def causal_denoise(spark, sf_dir):
    return wavelet.causal_denoise(views.bars(spark, sf_dir).select("symbol", "trade_date", "close"), "close")


@query()
def emd_denoise(spark, sf_dir):
    """Closes without the first mode of each whole series; it looks ahead."""
    return emd.emd_denoise(views.bars(spark, sf_dir), "close")


@query()
def ceemdan_denoise(spark, sf_dir):
    """Closes without the first mode of the complete ensemble."""
    return emd.ceemdan_denoise(views.bars(spark, sf_dir), "close", trials=20)


@query("""SELECT symbol, trade_date, round(ln(quantile_cont(close, 0.5) OVER w), 6) AS log_median_252, round(ln(quantile_cont(close, 0.9) OVER w), 6) AS log_q90_252, round(max(close) OVER v, 8) AS max_63, round(min(close) OVER v, 8) AS min_63
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), v AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def sliding_order_statistics(spark, sf_dir):
    """Medians, a quantile and extremes of closes over sliding rows, by kernels that move one step a row."""
    k = {"median_252": ("close", sliding.quantile(252, min_rows=1)), "q90_252": ("close", sliding.quantile(252, 0.9, min_rows=1)), "max_63": ("close", sliding.extreme("max", 63, min_rows=1)), "min_63": ("close", sliding.extreme("min", 63, min_rows=1))}
    return sliding.slide(views.bars(spark, sf_dir).select("symbol", "trade_date", "close"), k).select("symbol", "trade_date", *[rounded(F.log(n)).alias(f"log_{n}") if n.endswith("252") else rounded(n, 8).alias(n) for n in k])


@query("""WITH p AS (SELECT symbol, trade_date, lag(ret) OVER w AS pred, ret * 0.01 AS target FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)), q AS (SELECT *, CASE WHEN pred > 0 THEN 1.0 ELSE 0.0 END AS pos FROM p WHERE target IS NOT NULL)
    SELECT symbol, trade_date, pos::DOUBLE AS position, round(pos * target - CASE WHEN pos > b THEN 0.0012 WHEN pos < b THEN 0.001 ELSE 0 END, 8) + 0.0 AS net FROM (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY trade_date), 0) AS b FROM q)""")
def long_flat_single_name(spark, sf_dir):
    """Long or flat by the sign of the last return, each name by itself."""
    p = views.returns(views.bars(spark, sf_dir)).select("symbol", "trade_date", F.lag("ret").over(by_symbol()).alias("pred"), (F.col("ret") * 0.01).alias("target")).where("target is not null")
    return backtest.long_flat(p, buy=0.0012, sell=0.001, keys=("symbol",)).select("symbol", "trade_date", "position", rounded("net", 8).alias("net"))


ARMS = {"quarter": 0.25, "half": 0.5, "full": 1.0}
TABLES["weekly_rewards"] = "SELECT symbol AS run, week, row_number() OVER w AS step, coalesce(lag(r) OVER w, 0.0) AS before, r FROM (SELECT symbol, CAST(date_trunc('week', trade_date) AS DATE) AS week, avg(ret * 0.01) AS r FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY symbol ORDER BY week)"


def _arms(spark, sf_dir):
    """Weekly rewards of three exposures to each symbol, which is a run of its own, with the week before as context."""
    s = backtests.scaled(spark, sf_dir).where("ret is not null").groupBy(F.col("symbol").alias("run"), F.to_date(F.date_trunc("week", "trade_date")).alias("week")).agg(F.avg("ret").alias("r"))
    w = Window.partitionBy("run").orderBy("week")
    return s.select("run", "week", F.row_number().over(w).cast("long").alias("step"), F.lit(1.0).alias("bias"), F.coalesce(F.lag("r").over(w), F.lit(0.0)).alias("before"), *[(F.col("r") * x).alias(n) for n, x in ARMS.items()])


@query()
def linucb_policy(spark, sf_dir):
    return engine.linucb(_arms(spark, sf_dir), list(ARMS), ["bias", "before"])


@query("SELECT run, step, 'half' AS arm, round(r * 0.5, 8) + 0.0 AS reward FROM weekly_rewards")
def fixed_policy(spark, sf_dir):
    return engine.fixed_policy(_arms(spark, sf_dir), "half").select("run", "step", "arm", rounded("reward", 8).alias("reward"))


@query("""WITH d AS (SELECT run, week + 6 AS decided_on, CASE WHEN before > 0 THEN 1.0 ELSE 0.25 END AS x FROM weekly_rewards), t AS (SELECT symbol AS run, trade_date, ret * 0.01 AS ret, trade_date - 1 AS prior FROM rets WHERE ret IS NOT NULL)
    SELECT t.run, t.trade_date, round(coalesce(t.ret * d.x, 0.0), 8) + 0.0 AS r FROM t ASOF LEFT JOIN d ON d.run = t.run AND t.prior >= d.decided_on""")
def stitched_policy_returns(spark, sf_dir):
    """Full exposure after a week that followed a rising one, else a quarter: decided on the week's last day, held until the next decision."""
    decisions = _arms(spark, sf_dir).select("run", F.date_add("week", 6).alias("decided_on"), F.when(F.col("before") > 0, "full").otherwise("quarter").alias("arm"))
    daily = backtests.scaled(spark, sf_dir).where("ret is not null").select(F.col("symbol").alias("run"), "trade_date", F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), (F.col("ret") * x).alias("r")) for n, x in ARMS.items()])).alias("x")).select("run", "trade_date", "x.*")
    return engine.policy_returns(decisions, daily).select("run", "trade_date", rounded("r", 8).alias("r"))


@query()
def thompson_memory(spark, sf_dir):
    arms = _arms(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(x).alias("arm"), F.col(x).alias("reward")) for x in ARMS])).alias("e")).select("e.*")
    return engine.thompson(arms.groupBy("arm").agg(F.count("reward").alias("n"), F.avg("reward").alias("mean"), F.var_samp("reward").alias("var")))


_FAMILIES = "CASE WHEN contains(s, 'vol') THEN 'volatility' WHEN contains(s, 'turnover') OR contains(s, 'illiq') THEN 'liquidity' WHEN contains(s, 'pullback') OR contains(s, 'reversal') THEN 'reversal' ELSE 'trend' END"


@query(f"WITH l AS (SELECT p_partkey AS run, lower(p_type) || CASE p_partkey % 4 WHEN 0 THEN ' vol' WHEN 1 THEN ' turnover' WHEN 2 THEN ' pullback' ELSE '' END AS s, 'screened delta_ic=' || CAST(p_size AS VARCHAR) || 'e-3 ok' AS notes FROM part) SELECT {_FAMILIES} AS family, count(*) AS n, round(avg(CAST(regexp_extract(notes, 'delta_ic=(-?[0-9.]+e-3)', 1) AS DOUBLE)), 8) AS mean_delta FROM l GROUP BY 1")
def ledger_memory(spark, sf_dir):
    """Rebuilds the memory of feature families from a trial ledger's notes."""
    k = F.col("p_partkey") % 4
    name = F.concat(F.lower("p_type"), F.when(k == 0, " vol").when(k == 1, " turnover").when(k == 2, " pullback").otherwise(""))
    log = views.read(spark, sf_dir, "part").select(name.alias("s"), F.concat(F.lit("screened delta_ic="), F.col("p_size").cast("string"), F.lit("e-3 ok")).alias("notes"))
    has = lambda *w: F.greatest(*[F.col("s").contains(x) for x in w], F.lit(False))
    family = F.when(has("vol"), "volatility").when(has("turnover", "illiq"), "liquidity").when(has("pullback", "reversal"), "reversal").otherwise("trend")
    delta = F.regexp_extract("notes", r"delta_ic=(-?[0-9.]+e-3)", 1).cast("double")
    return log.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(delta), 8).alias("mean_delta"))
