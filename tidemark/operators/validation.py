"""Cross-validation splits, overfitting statistics, bootstrap tests and walk-forward models."""

from __future__ import annotations

from itertools import combinations
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from ..stages import Stage
from ..workers import ship
from . import boost, gram, network


def walk_forward(calendar: DataFrame, *, test: int = 63, min_train: int = 756, horizon: int = 5, embargo: int = 21) -> DataFrame:
    """Purged expanding folds: (fold, test_start, test_end, train_end) as session indices; training ends horizon + embargo before a test."""
    n = calendar.agg((F.max("idx") + 1).alias("n"))
    first = min_train + horizon + embargo
    folds = n.where(F.col("n") - first >= test).withColumn("fold", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - first) / test) - 1)))
    start = F.lit(first) + F.col("fold") * test
    return folds.select("fold", start.alias("test_start"), (start + test - 1).alias("test_end"), (start - horizon - embargo - 1).alias("train_end"))


def combinatorial(calendar: DataFrame, *, blocks: int = 8, pick: int = 2, gap: int = 5) -> DataFrame:
    """Every choice of `pick` test blocks out of `blocks` of equal size, the last with the rest: (combo, block, first, last, banned_from,
    banned_to) session indices."""
    combos = [(c, int(b)) for c, some in enumerate(combinations(range(blocks), pick)) for b in some]
    chosen = calendar.sparkSession.createDataFrame(combos, "combo long, block long")  # C(blocks, pick) x pick rows
    n = calendar.agg((F.max("idx") + 1).alias("n"))
    size, b = F.floor(F.col("n") / blocks), F.col("block")
    last = F.when(b == blocks - 1, F.col("n")).otherwise((b + 1) * size) - 1
    spans = chosen.join(F.broadcast(n)).select("combo", "block", "n", (b * size).alias("first"), last.alias("last"))  # one row
    return spans.withColumns({"banned_from": F.greatest(F.col("first") - gap, F.lit(0)), "banned_to": F.least(F.col("last") + gap, F.col("n") - 1)}).drop("n")


def overfitting(scores: DataFrame) -> DataFrame:
    """Probability of backtest overfitting: (combo, config, is_score, oos_score) -> share of combos whose best in-sample config ranks in the
    lower half out of sample (logit of its relative rank at or under 0)."""
    best = Window.partitionBy("combo").orderBy(F.desc("is_score"), "config")
    oos = Window.partitionBy("combo").orderBy("oos_score", "config")
    n = F.count(F.lit(1)).over(Window.partitionBy("combo"))
    r = scores.withColumns({"_b": F.row_number().over(best), "omega": F.row_number().over(oos) / (n + 1.0)}).where("_b = 1")
    logit = F.log(F.col("omega") / (1 - F.col("omega")))
    return r.agg(F.count(F.lit(1)).alias("combos"), F.avg((logit <= 0).cast("double")).alias("pbo"))


def family(daily: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Excess returns (config, trade_date, d) on the days that every config and the benchmark have."""
    n = daily.select("config").distinct().agg(F.count(F.lit(1)).alias("n"))
    days = daily.where("r is not null").groupBy("trade_date").agg(F.count(F.lit(1)).alias("have")).join(F.broadcast(n)).where("have = n").select("trade_date")  # one row
    return daily.join(days, "trade_date", "left_semi").join(benchmark, "trade_date").select("config", "trade_date", (F.col("r") - F.col("m")).alias("d"))


def spa_statistic(excess: DataFrame) -> DataFrame:
    """Per config: n, mean excess, its standard deviation and sqrt(n) mean / sd."""
    return excess.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd")).withColumn("t", safe_div(F.sqrt("n") * F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0))))


DRAWS_A_TASK = 100


def spa_bootstrap(excess: DataFrame, *, draws: int = 2000, mean_block: int = 21, seed: int = 7) -> DataFrame:
    """Reality-check and SPA p-values by the stationary bootstrap.

    A config's series has one row a session and goes to every part of DRAWS_A_TASK draws, which are made side by side. A draw's blocks
    depend on its number alone, so configs are resampled alike. Studentised means over draws are compared by their maximum."""
    ship(excess.sparkSession)
    series = excess.groupBy("config").agg(F.sort_array(F.collect_list(F.struct("trade_date", "d"))).alias("rows"))
    parts = series.select("config", F.col("rows.d").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(-(-draws // DRAWS_A_TASK) - 1))).alias("part")).repartition("config", "part")

    def run(batches):
        for g in batches:
            for config, x, part in zip(g["config"], g["x"], g["part"], strict=True):
                x, n = np.asarray(x), len(x)
                numbers, means = np.arange(part * DRAWS_A_TASK, min(draws, (part + 1) * DRAWS_A_TASK)), []
                for b in numbers:
                    rng = np.random.default_rng([seed, b])
                    jump = rng.random(n) < 1 / mean_block
                    jump[0] = True
                    starts, at = rng.integers(0, n, n), np.flatnonzero(jump)
                    block = at[np.cumsum(jump) - 1]
                    means.append(x[(starts[block] + np.arange(n) - block) % n].mean())
                yield pd.DataFrame({"config": config, "draw": numbers, "m": means, "n": n, "mean": x.mean()})

    drawn = parts.mapInPandas(run, "config string, draw long, m double, n long, mean double")
    root, whole = F.sqrt(F.col("n").cast("double")), Window.partitionBy("config")
    sd = F.greatest(root * F.stddev_pop("m").over(whole), F.lit(1e-12))
    keep = F.when(root * F.col("mean") / F.col("sd") >= -F.sqrt(2 * F.log(F.log(F.greatest(F.col("n"), F.lit(3)).cast("double")))), F.col("mean")).otherwise(0.0)
    d = drawn.withColumn("sd", sd).select("draw", (root * (F.col("m") - F.col("mean"))).alias("rc"), (root * (F.col("m") - keep) / F.col("sd")).alias("spa"), (root * F.col("mean")).alias("rc_seen"), (root * F.col("mean") / F.col("sd")).alias("spa_seen"))
    seen = d.agg(F.max("rc_seen").alias("rc_top"), F.greatest(F.max("spa_seen"), F.lit(0.0)).alias("spa_top"))
    best = d.groupBy("draw").agg(F.max("rc").alias("rc"), F.greatest(F.max("spa"), F.lit(0.0)).alias("spa"))
    return best.join(F.broadcast(seen)).agg(F.avg((F.col("rc") >= F.col("rc_top")).cast("double")).alias("rc_p"), F.avg((F.col("spa") >= F.col("spa_top")).cast("double")).alias("spa_p"))  # one row


def session_sums(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Per session (idx) the sums of products of features, 1 and label: all that ridge needs of any set of sessions."""
    names = [*features, "_one"]
    x = rows.withColumn("_one", F.lit(1.0))
    return x.groupBy("idx").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate([*names, label]) if j >= i])


def expanding_sessions(calendar: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, idx) of every fold's training sessions, from one row a session and one a fold."""
    return calendar.select("idx").join(folds.select("fold", "train_end"), F.col("idx") <= F.col("train_end")).select("fold", "idx")


def ridge_weights(sums: DataFrame, training: DataFrame, features: list[str], *, penalty: float = 1.0) -> DataFrame:
    """(fold, w): the coefficients and, last, the intercept of each fold, whose sessions `training` (fold, idx) lists."""
    ship(sums.sparkSession)
    k = len(features)
    names = [c for c in sums.columns if c != "idx"]
    gram = training.join(sums, "idx").groupBy("fold").agg(*[F.sum(c).alias(c) for c in names])

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in g.to_dict("records"):
            a = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) + penalty * np.diag([1.0] * k + [0.0])
            b = np.array([r[f"{i}_{k + 1}"] for i in range(k + 1)])
            out.append((r["fold"], np.linalg.lstsq(a, b, rcond=None)[0].tolist()))
        return pd.DataFrame(out, columns=["fold", "w"])

    return gram.mapInPandas(lambda it: map(solve, it), "fold long, w array<double>")


def ridge_predict(rows: DataFrame, weights: DataFrame, sessions: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(symbol, trade_date, fold, pred, label) of the rows of the sessions (fold, idx), which are equi-joined with the folds' weights."""
    at = sessions.join(weights, "fold")  # a row for each fold and session
    pred = sum((F.col(f) * F.col("w")[i] for i, f in enumerate(features)), F.col("w")[len(features)])
    return rows.join(at, "idx").select("symbol", "trade_date", "fold", pred.alias("pred"), label)


def test_sessions(calendar: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, idx) of every fold's test sessions."""
    return calendar.select("idx").join(folds, F.col("idx").between(F.col("test_start"), F.col("test_end"))).select("fold", "idx")


def ridge_walk_forward(rows: DataFrame, calendar: DataFrame, folds: DataFrame, features: list[str], *, label: str = "label", penalty: float = 1.0) -> DataFrame:
    """Out-of-sample ridge predictions: (symbol, trade_date, fold, pred, label).

    Rows are summed up once by session; folds add up sessions, and only their coefficients, a row a fold, go back to the rows."""
    stage = Stage(rows.sparkSession, "ridge")
    folds = stage.write(folds)
    w = stage.write(ridge_weights(session_sums(rows, features, label), expanding_sessions(calendar, folds), features, penalty=penalty))
    return ridge_predict(rows, w, test_sessions(calendar, folds), features, label)


def mean_rank_ic(scored: DataFrame, *keys: str, min_names: int = 20) -> DataFrame:
    """Days, mean daily rank correlation of pred and label, and its t, by keys."""
    from .risk import rank_ic_by

    daily = rank_ic_by(scored.withColumnRenamed("pred", "score"), *keys, min_names=min_names)
    t = safe_div(F.avg("ic"), F.nullif(F.stddev_samp("ic"), F.lit(0.0)) / F.sqrt(F.count("ic")))
    return daily.groupBy(*keys).agg(F.count("ic").alias("days"), F.avg("ic").alias("mean_ic"), F.coalesce(t, F.lit(0.0)).alias("t"))


def cpcv_sessions(calendar: DataFrame, stage: Stage, *, blocks: int, pick: int, gap: int) -> tuple[DataFrame, DataFrame]:
    """(fold, idx) of every split's training sessions, those outside its blocks and their gaps, and (fold, idx, part) of what it is scored on."""
    spans = combinatorial(calendar, blocks=blocks, pick=pick, gap=gap).withColumnRenamed("combo", "fold")
    out_of = calendar.select("idx").join(spans, F.col("idx").between(F.col("first"), F.col("last"))).select("fold", "idx").distinct()
    banned = calendar.select("idx").join(spans, F.col("idx").between(F.col("banned_from"), F.col("banned_to"))).select("fold", "idx").distinct()
    inside = spans.select("fold").distinct().crossJoin(calendar.select("idx")).join(banned, ["fold", "idx"], "left_anti")  # a row for each split and session
    inside = stage.write(inside)
    return inside, stage.write(inside.withColumn("part", F.lit("is_score")).unionByName(out_of.withColumn("part", F.lit("oos_score"))))


def cpcv_sweep(rows: DataFrame, calendar: DataFrame, models: dict[str, list[str]], *, blocks: int = 8, pick: int = 2, gap: int = 5, penalty: float = 1.0, min_names: int = 20) -> DataFrame:
    """(combo, config, is_score, oos_score): mean rank correlations in and out of sample of each model, a list of features, over all
    combinatorial purged splits."""
    stage = Stage(rows.sparkSession, "cpcv")
    inside, kinds = cpcv_sessions(calendar, stage, blocks=blocks, pick=pick, gap=gap)
    features = list(dict.fromkeys(f for some in models.values() for f in some))
    solve = gram.by_sets([[features.index(f) for f in some] for some in models.values()], len(features), 0, penalty)
    weights = stage.write(gram.fold_weights(stage.write(gram.session_grams(rows, features, [], full=True)), inside, solve))
    ics = gram.session_ics(rows, weights, kinds, features, list(models), min_names=min_names)
    return ics.groupBy(F.col("fold").alias("combo"), "config").pivot("part", ["is_score", "oos_score"]).agg(F.avg("ic"))


def cpcv_learner(rows: DataFrame, calendar: DataFrame, name: str, features: list[str], learner: ModuleType, options: boost.Options | network.Options, *, blocks: int = 8, pick: int = 2, gap: int = 5, min_names: int = 20) -> DataFrame:
    """As cpcv_sweep, of a learner (the module boost or network) under the config `name`: the models of all splits grow in the same passes."""
    stage = Stage(rows.sparkSession, "cpcv")
    inside, kinds = cpcv_sessions(calendar, stage, blocks=blocks, pick=pick, gap=gap)
    model = learner.fit(rows, inside, features, options=options)
    scored = learner.predict(rows, model, kinds.select("fold", "idx", "part"), keep=("part",))
    ic = mean_rank_ic(scored, "fold", "part", min_names=min_names)
    return ic.groupBy(F.col("fold").alias("combo")).pivot("part", ["is_score", "oos_score"]).agg(F.first("mean_ic")).select("combo", F.lit(name).alias("config"), "is_score", "oos_score")


def summary(ics: DataFrame, base: str, label: str = "label", against: tuple[str, ...] = ()) -> DataFrame:
    """Per config: days, mean rank correlation with the label, t, the mean correlation with each feature in `against`, and the excess over the mean of
    the config `base`."""
    own = F.when(F.col("target") == label, F.col("ic"))
    t = safe_div(F.avg(own), F.nullif(F.stddev_samp(own), F.lit(0.0)) / F.sqrt(F.count(own)))
    told = ics.groupBy("config").agg(F.count(own).alias("days"), F.avg(own).alias("mean_ic"), F.coalesce(t, F.lit(0.0)).alias("t"), *[F.avg(F.when(F.col("target") == f, F.col("ic"))).alias(f"with_{f}") for f in against])
    first = F.max(F.when(F.col("config") == base, F.col("mean_ic"))).over(Window.partitionBy(F.lit(1)))  # one row a config
    return told.withColumn("delta_ic", F.col("mean_ic") - first)


def increment(rows: DataFrame, calendar: DataFrame, folds: DataFrame, sets: dict[str, list[str]], *, against: tuple[str, ...] = (), penalty: float = 1.0, min_names: int = 20) -> DataFrame:
    """Per feature set of the walk-forward ridge: days, mean rank correlation, t, its excess over the first set's mean, and the mean rank
    correlation of its predictions with each feature in `against`. All sets share the sessions' sums and one pass of predictions."""
    stage = Stage(rows.sparkSession, "increment")
    folds = stage.write(folds)
    features = list(dict.fromkeys(f for some in sets.values() for f in some))
    solve = gram.by_sets([[features.index(f) for f in some] for some in sets.values()], len(features), 0, penalty)
    weights = stage.write(gram.fold_weights(gram.session_grams(rows, features, [], full=True), expanding_sessions(calendar, folds), solve))
    tests = test_sessions(calendar, folds).withColumn("part", F.lit("test"))
    return summary(gram.session_ics(rows, weights, tests, features, list(sets), against=against, min_names=min_names), next(iter(sets)), against=against)


def candidates(rows: DataFrame, calendar: DataFrame, folds: DataFrame, library: list[str], names: list[str], *, penalty: float = 1.0, min_names: int = 20) -> DataFrame:
    """Per candidate, a column of rows: days, mean rank correlation of the walk-forward ridge on the library with it, t, and its excess over the library's
    alone (config ""). Any number of candidates are borders of one Gram matrix a session."""
    stage = Stage(rows.sparkSession, "candidates")
    folds = stage.write(folds)
    weights = stage.write(gram.fold_weights(gram.session_grams(rows, library, names), expanding_sessions(calendar, folds), gram.by_borders(len(library), len(names), penalty)))
    tests = test_sessions(calendar, folds).withColumn("part", F.lit("test"))
    return summary(gram.session_ics(rows, weights, tests, [*library, *names], ["", *names], min_names=min_names), "")


def lagged(series: DataFrame, lags: int, value: str = "ret") -> DataFrame:
    """(symbol, trade_date, idx, lag_0.., label): a name's last `lags` values, oldest last, and the next one; rows that lack one drop."""
    by = Window.partitionBy("symbol").orderBy("trade_date")
    names = [f"lag_{k}" for k in range(lags)]
    rows = series.withColumns({n: F.lag(value, k).over(by) for k, n in enumerate(names)}).withColumn("label", F.lead(value).over(by))
    full = rows.withColumn("idx", (F.row_number().over(by) - 1).cast("long")).dropna(subset=names)
    return full.select("symbol", "trade_date", "idx", *names, "label")


def lag_walk_forward(series: DataFrame, *, lags: int = 20, burn_in: int = 504, every: int = 63, embargo: int = 1, window: int | None = None, penalty: float = 1.0, least: int = 252) -> DataFrame:
    """Single-name predictions (symbol, trade_date, idx, pred, label) of ridge on lagged values, trained anew every `every` rows on the rows
    at least `embargo` before, all of them or the last `window`. A name without `least` training rows has no prediction.

    Each name is a partition; its rows are summed up by stretches of `every` rows and the stretches' sums are added up by windows, so no
    row is read once a fold."""
    ship(series.sparkSession)
    names = [f"lag_{k}" for k in range(lags)]
    rows = lagged(series, lags)
    terms = [*names, "_one"]
    # row i may train the models of row i + 1 + embargo on
    train = rows.where("label is not null").withColumns({"_one": F.lit(1.0), "_fold": F.ceil((F.col("idx") + 1 + embargo - burn_in) / every).cast("long")})
    pairs = {f"{i}_{j}": F.sum(F.col(a) * F.col(b)) for i, a in enumerate(terms) for j, b in enumerate([*terms, "label"]) if j >= i}
    sums = train.groupBy("symbol", "_fold").agg(*[v.alias(k) for k, v in pairs.items()])
    before = Window.partitionBy("symbol").orderBy("_fold").rangeBetween(Window.unboundedPreceding if window is None else -(window // every) + 1, 0)
    folds = rows.where(F.col("idx") >= burn_in).select("symbol", F.floor((F.col("idx") - burn_in) / every).alias("_fold")).distinct()
    every_fold = folds.join(sums, ["symbol", "_fold"], "full_outer")
    grown = every_fold.select("symbol", "_fold", *[F.sum(c).over(before).alias(c) for c in pairs])
    k = len(names)
    one = f"{k}_{k}"

    def solve(batches):
        for g in batches:
            out = []
            for r in g.to_dict("records"):
                a = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) + penalty * np.diag([1.0] * k + [0.0])
                out.append((r["symbol"], r["_fold"], np.linalg.lstsq(a, np.array([r[f"{i}_{k + 1}"] for i in range(k + 1)]), rcond=None)[0].tolist()))
            yield pd.DataFrame(out, columns=["symbol", "_fold", "w"])

    w = grown.where((F.col("_fold") >= 0) & (F.col(one) >= least)).mapInPandas(solve, f"symbol {series.schema['symbol'].dataType.simpleString()}, _fold long, w array<double>")
    asked = rows.where(F.col("idx") >= burn_in).withColumn("_fold", F.floor((F.col("idx") - burn_in) / every))
    pred = sum((F.col(n) * F.col("w")[i] for i, n in enumerate(names)), F.col("w")[k])
    return asked.join(w, ["symbol", "_fold"]).select("symbol", "trade_date", "idx", pred.alias("pred"), "label")
