"""Split, overfitting, bootstrap and model queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dsl
from ..functions.expr import rounded
from ..functions.temporal import sessions, weekly_grid
from ..operators import boost, events, features, network, proposal, risk, validation
from ..sources import views
from ..stages import Stage
from .registry import TABLES, query
from .risk import index, series


@query("WITH n AS (SELECT max(idx) + 1 AS n FROM sessions) SELECT CAST(f AS BIGINT) AS fold, CAST(782 + f * 63 AS BIGINT) AS test_start, CAST(782 + f * 63 + 62 AS BIGINT) AS test_end, CAST(782 + f * 63 - 27 AS BIGINT) AS train_end FROM (SELECT unnest(range(0, CAST(floor((n - 782) / 63) AS BIGINT))) AS f FROM n)")
def walk_forward_folds(spark, sf_dir):
    f = validation.walk_forward(sessions(views.bars(spark, sf_dir)))
    return f.select(*[F.col(c).cast("long").alias(c) for c in f.columns])


@query("""WITH n AS (SELECT max(idx) + 1 AS n FROM sessions), c AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS combo FROM (SELECT unnest(range(8)) AS a), (SELECT unnest(range(8)) AS b) WHERE a < b), x AS (SELECT combo, unnest([a, b]) AS block FROM c)
    SELECT combo, block, CAST(block * (n // 8) AS BIGINT) AS first, CAST(CASE WHEN block = 7 THEN n ELSE (block + 1) * (n // 8) END - 1 AS BIGINT) AS last,
    CAST(greatest(block * (n // 8) - 5, 0) AS BIGINT) AS banned_from, CAST(least(CASE WHEN block = 7 THEN n ELSE (block + 1) * (n // 8) END + 4, n - 1) AS BIGINT) AS banned_to FROM x, n""")
def cpcv_splits(spark, sf_dir):
    s = validation.combinatorial(sessions(views.bars(spark, sf_dir)))
    return s.select(*[F.col(c).cast("long").alias(c) for c in s.columns])


TABLES["cells"] = "SELECT o_orderpriority AS config, o_custkey % 28 AS combo, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS is_score, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) AS oos_score FROM orders GROUP BY 1, 2"


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY is_score DESC, config) AS b, row_number() OVER (PARTITION BY combo ORDER BY oos_score, config) / (count(*) OVER (PARTITION BY combo) + 1.0) AS omega FROM cells)
    SELECT count(*) AS combos, round(avg(CASE WHEN ln(omega / (1 - omega)) <= 0 THEN 1.0 ELSE 0.0 END), 8) + 0.0 AS pbo FROM r WHERE b = 1""")
def pbo(spark, sf_dir):
    """Configs are order priorities, combos customer groups, scores mean prices of even and odd orders."""
    half = lambda k: F.avg(F.when(F.col("o_orderkey") % 2 == k, F.col("o_totalprice")))
    s = views.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("config"), (F.col("o_custkey") % 28).alias("combo")).agg(half(0).alias("is_score"), half(1).alias("oos_score"))
    return validation.overfitting(s).select("combos", rounded("pbo", 8).alias("pbo"))


TABLES["configs"] = """SELECT 'momentum' AS config, trade_date, r FROM series UNION ALL SELECT 'half', trade_date, r * 0.5 FROM series UNION ALL SELECT 'lagged', trade_date, lag(r) OVER (ORDER BY trade_date) FROM series"""


def _configs(spark, sf_dir):
    s = series(spark, sf_dir)
    row = lambda n, v: F.struct(F.lit(n).alias("config"), v.alias("r"))
    both = s.withColumn("before", F.lag("r").over(Window.orderBy("trade_date")))
    return both.select("trade_date", F.explode(F.array(row("momentum", F.col("r")), row("half", F.col("r") * 0.5), row("lagged", F.col("before")))).alias("c")).select("c.config", "trade_date", "c.r")


@query("""WITH days AS (SELECT trade_date FROM configs WHERE r IS NOT NULL GROUP BY trade_date HAVING count(*) = 3), e AS (SELECT config, r - m AS d FROM configs JOIN days USING (trade_date) JOIN index_series USING (trade_date))
    SELECT config, count(*) AS n, round(avg(d), 8) + 0.0 AS mean, round(stddev_pop(d), 8) AS sd, round(sqrt(count(*)) * avg(d) / nullif(stddev_pop(d), 0), 4) + 0.0 AS t FROM e GROUP BY config""")
def spa_statistics(spark, sf_dir):
    s = validation.spa_statistic(validation.family(_configs(spark, sf_dir), index(spark, sf_dir)))
    return s.select("config", "n", rounded("mean", 8).alias("mean"), rounded("sd", 8).alias("sd"), rounded("t", 4).alias("t"))


@query()
def spa_bootstrap(spark, sf_dir):
    return validation.spa_bootstrap(validation.family(_configs(spark, sf_dir), index(spark, sf_dir)))


_FEATURES = ["ret_21d", "mom_12_1", "vol_63d", "dist_52w_high"]
_TWO = ["ret_21d", "vol_63d"]
_FOLDS = {"test": 126, "min_train": 1000}


def design(spark, sf_dir, names=tuple(_FEATURES)):
    """The weekly design matrix and the calendar, each written once, as every fold and model reads them."""
    stage = Stage(spark, "design")
    cal = stage.write(sessions(views.trading_days(spark, sf_dir)))
    rows = features.labelled(views.returns(views.bars(spark, sf_dir)), weekly_grid(cal), list(names))
    return stage.write(rows.join(F.broadcast(cal), "trade_date")), cal  # one row a session


@query()
def ridge_walk_forward(spark, sf_dir):
    rows, cal = design(spark, sf_dir)
    return validation.ridge_walk_forward(rows, cal, validation.walk_forward(cal, **_FOLDS), _FEATURES)


@query()
def ridge_fold_ic(spark, sf_dir):
    """Rank IC by date of stitched out-of-sample predictions."""
    rows, cal = design(spark, sf_dir)
    p = validation.ridge_walk_forward(rows, cal, validation.walk_forward(cal, **_FOLDS), _FEATURES)
    return risk.rank_ic(p.withColumnRenamed("pred", "score"), min_names=10)


TABLES["two"] = """WITH f AS (SELECT symbol, trade_date, close / lag(close, 252) OVER w - 1 AS r252, close / lag(close, 21) OVER w - 1 AS r21, CASE WHEN count(ret) OVER v = 63 THEN stddev_samp(ret) OVER v END AS v63 FROM rets
    WINDOW w AS (PARTITION BY symbol ORDER BY trade_date), v AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
    z AS (SELECT symbol, trade_date, coalesce((r21 - avg(r21) OVER d) / (stddev_samp(r21) OVER d + 1e-12), 0) AS a, coalesce((v63 - avg(v63) OVER d) / (stddev_samp(v63) OVER d + 1e-12), 0) AS b FROM f WHERE r252 IS NOT NULL WINDOW d AS (PARTITION BY trade_date))
    SELECT z.symbol, z.trade_date, a, b, l.label AS y, s.idx FROM z JOIN labels5 l USING (symbol, trade_date) JOIN weekly USING (trade_date) JOIN sessions s USING (trade_date) WHERE l.label IS NOT NULL"""


@query("""WITH n AS (SELECT max(idx) + 1 AS n FROM sessions), k AS (SELECT f AS fold, 1026 + f * 126 AS t0, 1026 + f * 126 + 125 AS t1, 1026 + f * 126 - 27 AS t2 FROM (SELECT unnest(range(0, CAST(floor((n - 1026) / 126) AS BIGINT))) AS f FROM n)),
    m AS (SELECT fold, any_value(t0) AS t0, any_value(t1) AS t1, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS b_y FROM k JOIN two ON idx <= t2 GROUP BY fold),
    w AS (SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS wa, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)
    SELECT symbol, trade_date, fold, round(my + wa * (a - ma) + wb * (b - mb), 6) + 0.0 AS pred FROM two JOIN w ON idx BETWEEN t0 AND t1""")
def ridge_two_features(spark, sf_dir):
    """The walk-forward ridge on two features, whose solution has a closed form."""
    rows, cal = design(spark, sf_dir, tuple(_TWO))
    p = validation.ridge_walk_forward(rows, cal, validation.walk_forward(cal, **_FOLDS), _TWO)
    return p.select("symbol", "trade_date", "fold", rounded("pred").alias("pred"))


MODELS = {"trend": ["ret_21d", "mom_12_1"], "risk": ["vol_63d", "dist_52w_high"], "all": _FEATURES, "one": ["mom_12_1"]}


@query()
def cpcv_model_sweep(spark, sf_dir):
    """In- and out-of-sample rank correlations of four ridge models, boosted trees and a network over all combinatorial splits of the sessions."""
    rows, cal = design(spark, sf_dir)
    sweep = validation.cpcv_sweep(rows, cal, MODELS, min_names=10)
    for name, learner, options in (("boosted", boost, boost.Options(trees=4, depth=2, bins=32)), ("network", network, network.Options(hidden=8, epochs=8, rate=0.02))):
        sweep = sweep.unionByName(validation.cpcv_learner(rows, cal, name, _FEATURES, learner, options, min_names=10))
    return sweep


@query()
def boosted_walk_forward(spark, sf_dir):
    """Out-of-sample predictions of boosted trees."""
    rows, cal = design(spark, sf_dir)
    return boost.walk_forward(rows, cal, validation.walk_forward(cal, **_FOLDS), _FEATURES, options=boost.Options(trees=8, depth=3, bins=32))


@query()
def learner_ensemble(spark, sf_dir):
    """Rank correlations of the walk-forward predictions of ridge, boosted trees and a network, and of their mean."""
    rows, cal = design(spark, sf_dir)
    folds = validation.walk_forward(cal, **_FOLDS)
    learners = {
        "ridge": validation.ridge_walk_forward(rows, cal, folds, _FEATURES),
        "boosted": boost.walk_forward(rows, cal, folds, _FEATURES, options=boost.Options(trees=8, depth=3, bins=32)),
        "network": network.walk_forward(rows, cal, folds, _FEATURES, options=network.Options(hidden=8, epochs=20, rate=0.02)),
    }
    return validation.mean_rank_ic(network.ensemble(learners), "learner", min_names=10)


@query()
def sequence_walk_forward(spark, sf_dir):
    """Walk-forward predictions of all names' next returns by recurrent networks over the last five, by kind of cell."""
    stage = Stage(spark, "sequences")
    cal = stage.write(sessions(views.trading_days(spark, sf_dir)))
    lags = validation.lagged(views.returns(views.bars(spark, sf_dir)).where("ret is not null").select("symbol", "trade_date", (F.col("ret") * 0.01).alias("ret")), 5)
    rows = stage.write(lags.drop("idx").join(F.broadcast(cal), "trade_date"))  # one row a session
    folds = validation.walk_forward(cal, test=504, min_train=1000)
    names = [f"lag_{k}" for k in reversed(range(5))]  # oldest first
    kinds = {k: network.walk_forward(rows, cal, folds, names, options=network.Options(k, hidden=8, epochs=8, rate=0.02)) for k in ("gru", "lstm")}
    return network.ensemble(kinds)


@query()
def cpcv_model_pbo(spark, sf_dir):
    """The probability of overfitting of choosing among the models of the sweep."""
    return validation.overfitting(Stage(spark, "sweep").write(cpcv_model_sweep(spark, sf_dir)))


@query()
def increment_test(spark, sf_dir):
    """Price features (A), with event features (B), and these alone (C), by walk-forward ridge."""
    from .events import event_features_full

    rows, cal = design(spark, sf_dir)
    extra = ["days_since_event", "n_events_63d", "last_event_ar"]
    more = events.normalise(event_features_full(spark, sf_dir)).select("symbol", "trade_date", *extra)
    both = Stage(spark, "increment").write(rows.join(more, ["symbol", "trade_date"], "left").fillna(0.0, extra))
    sets = {"A_price": _FEATURES, "B_price_plus_events": [*_FEATURES, *extra], "C_events_only": extra}
    return validation.increment(both, cal, validation.walk_forward(cal, **_FOLDS), sets, against=("mom_12_1",), min_names=10)


@query()
def screen_increment(spark, sf_dir):
    """Candidate features by the ridge's mean rank correlation with and without them; names that collide or that the language refuses are
    rejected with the reason."""
    b = views.bars(spark, sf_dir)
    rows, cal = design(spark, sf_dir)
    folds = validation.walk_forward(cal, **_FOLDS)
    proposals = [proposal.Proposal(n, "a seed", dsl.SEEDS[n], 126) for n in ("turnover_shock_5d", "rev_gap_2d")] + [proposal.Proposal("mom_12_1", "collides", "dret()", 1), proposal.Proposal("peeks_ahead", "not allowed", "shift(dret(), -1)", 1)]
    return proposal.screen(b, rows, cal, folds, _FEATURES, proposals, min_names=10)


@query()
def lag_ridge_single_names(spark, sf_dir):
    """Walk-forward ridge of each name's own lagged returns."""
    return validation.lag_walk_forward(views.returns(views.bars(spark, sf_dir)).where("ret is not null").select("symbol", "trade_date", (F.col("ret") * 0.01).alias("ret")), lags=5, burn_in=126, every=21, least=63)
