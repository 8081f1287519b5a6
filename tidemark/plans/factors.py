"""Factor, feature, label and blend queries, and the flagship."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..functions.temporal import sessions, weekly_grid
from ..operators import features
from ..sources import views
from .registry import query

BY_SYMBOL_SQL = "WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)"


def frame(n: int, name: str) -> str:
    return f"{name} AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("""WITH picks AS (SELECT * FROM (SELECT m.trade_date, symbol, score, row_number() OVER (PARTITION BY m.trade_date ORDER BY score DESC, symbol) AS pick
    FROM momentum m JOIN weekly USING (trade_date)) WHERE pick <= 5)
    SELECT p.trade_date, n.trade_date AS exec_date, symbol, pick, round(score, 8) AS score, round(1.0 / count(*) OVER (PARTITION BY p.trade_date), 8) AS weight
    FROM picks p JOIN sessions s ON s.trade_date = p.trade_date JOIN sessions n ON n.idx = s.idx + 1""")
def flagship_momentum_topn(spark, sf_dir):
    """Bars, weekly grid, 12-1 momentum, top five names, equal weights, executed at the next session's close."""
    b = views.bars(spark, sf_dir)
    cal = sessions(b)
    grid = weekly_grid(cal)
    signal = features.score(b, features.momentum_12_1()).join(grid, "trade_date", "left_semi")
    best = Window.partitionBy("trade_date").orderBy(F.desc("score"), "symbol")
    picks = signal.withColumn("pick", F.row_number().over(best)).where("pick <= 5")
    following = cal.select("trade_date", F.lead("trade_date").over(Window.orderBy("trade_date")).alias("exec_date")).where("exec_date is not null")
    out = picks.join(following, "trade_date")
    return out.select("trade_date", "exec_date", "symbol", F.col("pick").cast("long").alias("pick"), rounded("score", 8).alias("score"), rounded(1.0 / F.count(F.lit(1)).over(Window.partitionBy("trade_date")), 8).alias("weight"))


@query("SELECT symbol, trade_date, round(score, 8) AS score FROM momentum")
def momentum_12_1(spark, sf_dir):
    return features.score(views.bars(spark, sf_dir), features.momentum_12_1()).select("symbol", "trade_date", rounded("score", 8).alias("score"))


@query(f"SELECT * FROM (SELECT symbol, trade_date, round(-(close / lag(close, 5) OVER w - 1), 8) AS score FROM bars {BY_SYMBOL_SQL}) WHERE score IS NOT NULL")
def reversal_5d(spark, sf_dir):
    return features.score(views.bars(spark, sf_dir), features.reversal_5d()).select("symbol", "trade_date", rounded("score", 8).alias("score"))


@query(f"SELECT * FROM (SELECT symbol, trade_date, CASE WHEN count(ret) OVER w = 63 THEN round(-stddev_samp(ret) OVER w, 8) END AS score FROM rets WINDOW {frame(63, 'w')}) WHERE score IS NOT NULL")
def low_vol_63d(spark, sf_dir):
    return features.score(views.returns(views.bars(spark, sf_dir)), features.low_vol_63d()).select("symbol", "trade_date", rounded("score", 8).alias("score"))


_LIBRARY = f"""SELECT symbol, trade_date, {', '.join(f'close / lag(close, {n}) OVER w - 1 AS ret_{n}d' for n in (5, 21, 63, 126, 252))},
    lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS mom_12_1, -(close / lag(close, 1) OVER w - 1) AS rev_1d, -(close / lag(close, 5) OVER w - 1) AS rev_5d,
    CASE WHEN count(ret) OVER w21 = 21 THEN stddev_samp(ret) OVER w21 END AS vol_21d, CASE WHEN count(ret) OVER w63 = 63 THEN stddev_samp(ret) OVER w63 END AS vol_63d,
    CASE WHEN count(ret) OVER w21 = 21 THEN stddev_samp(CASE WHEN ret < 0 THEN ret WHEN ret IS NOT NULL THEN 0.0 END) OVER w21 END AS downside_vol_21d,
    CASE WHEN count(ret) OVER w63 = 63 THEN stddev_samp(CASE WHEN ret < 0 THEN ret WHEN ret IS NOT NULL THEN 0.0 END) OVER w63 END AS downside_vol_63d,
    CASE WHEN count(*) OVER w252 = 252 THEN close / (max(close) OVER w252 + 1e-12) - 1 END AS dist_52w_high, CASE WHEN count(*) OVER w252 = 252 THEN close / (min(close) OVER w252 + 1e-12) - 1 END AS dist_52w_low,
    CASE WHEN count(ret) OVER w21 = 21 THEN avg(abs(ret) / (traded_value + 1.0)) OVER w21 END AS amihud_21d,
    CASE WHEN count(*) OVER w21 = 21 THEN (traded_value - avg(traded_value) OVER w21) / (stddev_samp(traded_value) OVER w21 + 1e-12) END AS turnover_z_21d,
    CASE WHEN count(*) OVER w21 = 21 THEN avg((high - low) / (close + 1e-12)) OVER w21 END AS atr_range_21d,
    CASE WHEN count(*) OVER w63 = 63 THEN close / (max(close) OVER w63 + 1e-12) - 1 END AS maxdd_63d, CASE WHEN day(trade_date) >= 25 THEN 1.0 ELSE 0.0 END AS month_end
    FROM rets {BY_SYMBOL_SQL}, {frame(21, 'w21')}, {frame(63, 'w63')}, {frame(252, 'w252')}"""
_NAMES = [f.name for f in features.REGISTRY]


def _raw(*names):
    body = f"WITH f AS ({_LIBRARY}) SELECT symbol, trade_date, {', '.join(f'round(CAST({n} AS DOUBLE), 8) + 0.0 AS {n}' for n in names)} FROM f WHERE ret_252d IS NOT NULL"

    def run(spark, sf_dir):
        panel = views.returns(views.bars(spark, sf_dir))
        return features.raw_features(panel, list(names)).select("symbol", "trade_date", *[rounded(n, 8).alias(n) for n in names])

    return body, run


for _key, _some in {
    "fea_returns": _NAMES[:5], "fea_momentum_reversal": _NAMES[5:8], "fea_volatility": _NAMES[8:10], "fea_downside_volatility": _NAMES[10:12], "fea_52w_distance": _NAMES[12:14],
    "fea_amihud": ["amihud_21d"], "fea_turnover_z": ["turnover_z_21d"], "fea_atr_range": ["atr_range_21d"], "fea_maxdd": ["maxdd_63d"], "fea_month_end": ["month_end"],
}.items():
    _sql, _run = _raw(*_some)
    query(_sql, _key)(_run)


def _z(n: str) -> str:
    return f"round(coalesce((CAST({n} AS DOUBLE) - avg({n}) OVER d) / (stddev_samp({n}) OVER d + 1e-12), 0.0), 4) + 0.0 AS {n}"


# With one name a date, and with equal values, the deviation is 0 or missing; those few dates are left out as rounding noise over 1e-12 has no meaning.
@query(f"WITH f AS ({_LIBRARY}), g AS (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM f WHERE ret_252d IS NOT NULL) SELECT symbol, trade_date, {', '.join(map(_z, _NAMES))} FROM g WHERE n >= 5 WINDOW d AS (PARTITION BY trade_date)")
def feature_library_zscored(spark, sf_dir):
    f = features.build_features(views.returns(views.bars(spark, sf_dir)))
    n = F.count(F.lit(1)).over(Window.partitionBy("trade_date"))
    return f.withColumn("n", n).where("n >= 5").select("symbol", "trade_date", *[rounded(x, 4).alias(x) for x in _NAMES])


_LABEL = "SELECT symbol, trade_date, (fwd - avg(fwd) OVER d) / (stddev_samp(fwd) OVER d + 1e-12) AS label FROM (SELECT symbol, trade_date, lead(close, 5) OVER w / close - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) WHERE fwd IS NOT NULL WINDOW d AS (PARTITION BY trade_date)"


@query(f"SELECT symbol, trade_date, round(label, 6) + 0.0 AS label FROM ({_LABEL})")
def forward_return_z(spark, sf_dir):
    return features.forward_return_z(views.bars(spark, sf_dir)).select("symbol", "trade_date", rounded("label").alias("label"))


@query(f"WITH f AS ({_LIBRARY}), l AS ({_LABEL}) SELECT f.symbol, trade_date, round(mom_12_1, 8) AS mom_12_1, round(vol_63d, 8) AS vol_63d, round(label, 6) + 0.0 AS label FROM f JOIN l USING (symbol, trade_date) JOIN weekly USING (trade_date) WHERE ret_252d IS NOT NULL")
def weekly_design_matrix(spark, sf_dir):
    b = views.bars(spark, sf_dir)
    f = features.build_features(views.returns(b), normalise=False)
    out = f.join(features.forward_return_z(b), ["symbol", "trade_date"]).join(weekly_grid(sessions(b)), "trade_date", "left_semi")
    return out.select("symbol", "trade_date", rounded("mom_12_1", 8).alias("mom_12_1"), rounded("vol_63d", 8).alias("vol_63d"), rounded("label").alias("label"))


def _blend_sql(w: float) -> str:
    rank = lambda c: f"(rank() OVER (PARTITION BY trade_date ORDER BY {c}) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0)"
    return f"""WITH v AS (SELECT * FROM (SELECT symbol, trade_date, CASE WHEN count(ret) OVER w = 63 THEN -stddev_samp(ret) OVER w END AS b FROM rets WINDOW {frame(63, 'w')}) WHERE b IS NOT NULL)
        SELECT symbol, trade_date, round({1 - w} * {rank('score')} + {w} * {rank('b')}, 6) AS score FROM momentum JOIN v USING (symbol, trade_date)"""


def _blend(spark, sf_dir, w):
    r = views.returns(views.bars(spark, sf_dir))
    return features.blend(features.score(r, features.momentum_12_1()), features.score(r, features.low_vol_63d()), w).select("symbol", "trade_date", rounded("score").alias("score"))


@query(_blend_sql(0.5))
def rank_blend(spark, sf_dir):
    return _blend(spark, sf_dir, 0.5)


@query(_blend_sql(0.25))
def weighted_rank_blend(spark, sf_dir):
    return _blend(spark, sf_dir, 0.25)


@query("SELECT symbol, trade_date, 1.0::DOUBLE AS score FROM universe WHERE liquidity_rank <= 20")
def equal_weight_signal(spark, sf_dir):
    from ..operators.universe import pit_universe
    from .panel import SCALED

    return features.uniform(pit_universe(views.bars(spark, sf_dir), **SCALED))


@query(f"""WITH f AS (SELECT symbol, trade_date, close / lag(close, 21) OVER w - 1 AS x FROM bars {BY_SYMBOL_SQL}), m AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY trade_date) AS med FROM f WHERE x IS NOT NULL)
    SELECT symbol, trade_date, round((x - med) / (1.4826 * mad + 1e-9), 4) + 0.0 AS x FROM (SELECT *, quantile_cont(abs(x - med), 0.5) OVER (PARTITION BY trade_date) AS mad, count(*) OVER (PARTITION BY trade_date) AS n FROM m) WHERE n >= 5""")
def robust_rescale(spark, sf_dir):
    f = views.bars(spark, sf_dir).select("symbol", "trade_date", features.change("close", 21).alias("x")).where("x is not null")
    n = F.count(F.lit(1)).over(Window.partitionBy("trade_date"))
    return features.robust_rescale(f, ["x"]).withColumn("n", n).where("n >= 5").select("symbol", "trade_date", rounded("x", 4).alias("x"))
