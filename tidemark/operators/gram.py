"""Many ridge models in one pass over the rows.

All that ridge needs of any set of sessions are sums of products, so each session becomes one Gram row: the library with itself and the label, the
library with each further feature, and those features' own products. A fold adds up its sessions' rows; then

- a model on any features is a sub-matrix of the fold's sums (`sets`);
- a candidate is one border around the library's matrix: with A the library's (penalised, with intercept), b its products with the candidate and d the
  candidate's own, the candidate's weight is (e - b'w) / (d - b'A^-1 b) with e its product with the label and w the library's solution, whose weights
  lose A^-1 b times that. A is factorised once a fold, and candidates are never multiplied with each other.

Predictions of all models of a session are one matrix product, and their rank correlations are taken together, by a second pass that groups rows by
session. A task holds one session's rows: as many as the market has names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ship

Solver = Callable[[np.ndarray], np.ndarray]


def _layout(k: int, c: int, full: bool) -> list[tuple[int, ...]]:
    """Shapes of a Gram row's blocks: library x library, library x label, library x extra, extra x extra (or its diagonal), extra x label."""
    return [(k + 1, k + 1), (k + 1,), (k + 1, c), (c, c) if full else (c,), (c,)]


def _blocks(g: np.ndarray, k: int, c: int, full: bool) -> list[np.ndarray]:
    shapes = _layout(k, c, full)
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [x.reshape(s) for x, s in zip(np.split(g, ends[:-1]), shapes, strict=True)]


def session_grams(rows: DataFrame, library: list[str], extra: list[str], *, label: str = "label", full: bool = False) -> DataFrame:
    """(idx, g): one Gram row a session, summed while its rows stream by. full: with all products among the extra features."""
    ship(rows.sparkSession)
    k, c = len(library), len(extra)

    def gram(part: pd.DataFrame) -> np.ndarray:
        x = np.column_stack([part[library].to_numpy(float), np.ones(len(part))])
        e, y = part[extra].to_numpy(float).reshape(len(part), c), part[label].to_numpy(float)
        return np.concatenate([(x.T @ x).ravel(), x.T @ y, (x.T @ e).ravel(), (e.T @ e).ravel() if full else (e * e).sum(0), e.T @ y])

    def run(batches):
        now, total = None, None
        for b in batches:
            out = []
            for idx, part in b.groupby("idx", sort=False):
                if idx != now:
                    if now is not None:
                        out.append((now, total.tolist()))
                    now, total = idx, 0.0
                total = total + gram(part)
            yield pd.DataFrame(out, columns=["idx", "g"])
        if now is not None:
            yield pd.DataFrame([(now, total.tolist())], columns=["idx", "g"])

    needed = rows.where(F.col(label).isNotNull()).select(F.col("idx").cast("long").alias("idx"), *[F.col(f).cast("double").alias(f) for f in (*library, *extra, label)])
    return needed.repartition("idx").sortWithinPartitions("idx").mapInPandas(run, "idx long, g array<double>")


def by_sets(sets: list[list[int]], k: int, c: int, penalty: float) -> Solver:
    """Solves each model of feature numbers (library first, then extras) as a sub-matrix; weights over all features, intercept last."""

    def solve(g: np.ndarray) -> np.ndarray:
        a, b, cross, own, e = _blocks(g, k, c, True)
        # order: library, extras, intercept
        order = [*range(k), *range(k + 1, k + 1 + c), k]
        whole = np.block([[a, cross], [cross.T, own]])[np.ix_(order, order)]
        right = np.concatenate([b, e])[order]
        out = np.zeros((len(sets), k + c + 1))
        for i, chosen in enumerate(sets):
            at = [*chosen, k + c]
            out[i, at] = np.linalg.lstsq(whole[np.ix_(at, at)] + penalty * np.diag([1.0] * len(chosen) + [0.0]), right[at], rcond=None)[0]
        return out

    return solve


def by_borders(k: int, c: int, penalty: float) -> Solver:
    """The library's model, then the library with each extra feature, by one factorisation."""

    def solve(g: np.ndarray) -> np.ndarray:
        a, b, cross, own, e = _blocks(g, k, c, False)
        solved = np.linalg.lstsq(a + penalty * np.diag([1.0] * k + [0.0]), np.column_stack([b, cross]), rcond=None)[0]
        w, along = solved[:, 0], solved[:, 1:]
        weight = (e - cross.T @ w) / (own + penalty - (cross * along).sum(0))
        out = np.zeros((c + 1, k + c + 1))
        base = np.vstack([w, w - (along * weight).T])
        out[:, :k], out[:, -1] = base[:, :k], base[:, k]
        out[np.arange(1, c + 1), k + np.arange(c)] = weight
        return out

    return solve


def fold_weights(grams: DataFrame, training: DataFrame, solve: Solver) -> DataFrame:
    """(fold, w): every model's weights, row by row, for the sessions that `training` (fold, idx) lists."""

    def run(batches):
        now, total = None, None
        for b in batches:
            out = []
            for fold, g in zip(b["fold"], b["g"], strict=True):
                if fold != now:
                    if now is not None:
                        out.append((now, solve(total).ravel().tolist()))
                    now, total = fold, 0.0
                total = total + np.asarray(g, float)
            yield pd.DataFrame(out, columns=["fold", "w"])
        if now is not None:
            yield pd.DataFrame([(now, solve(total).ravel().tolist())], columns=["fold", "w"])

    ship(grams.sparkSession)
    some = training.select(F.col("fold").cast("long").alias("fold"), F.col("idx").cast("long").alias("idx")).join(grams, "idx")
    return some.select("fold", "g").repartition("fold").sortWithinPartitions("fold").mapInPandas(run, "fold long, w array<double>")


def correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spearman's correlation of each column of x with y, ties at their average rank; NaN without variance."""
    ranks = lambda v: (r := pd.DataFrame(v).rank().to_numpy()) - r.mean(0)
    a, b = ranks(x), ranks(y)
    spread = np.sqrt((a * a).sum(0) * (b * b).sum(0))
    return np.divide((a * b).sum(0), spread, out=np.full(a.shape[1], np.nan), where=spread > 1e-9)


def session_ics(rows: DataFrame, weights: DataFrame, sessions: DataFrame, features: list[str], configs: list[str], *, label: str = "label", against: tuple[str, ...] = (), min_names: int = 20) -> DataFrame:
    """(fold, part, config, target, idx, ic): rank correlations of every model's predictions with the label, and with the features in `against`.

    sessions (fold, idx, part) says where which fold's models predict."""
    targets, m, names = [label, *against], len(configs), ["fold", "part", "config", "target", "idx", "ic"]

    def run(own: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        own = own[own[label].notna()]
        if len(own) < min_names or not len(models):
            return pd.DataFrame(columns=names)
        x, n = np.column_stack([own[features].to_numpy(float), np.ones(len(own))]), len(models)
        pred = x @ np.concatenate([np.asarray(w, float).reshape(m, -1) for w in models["w"]]).T  # a column for each fold and model
        each = {c: np.repeat(models[c].to_numpy(), m) for c in ("fold", "part", "idx")} | {"config": np.tile(np.array(configs, object), n)}
        return pd.concat([pd.DataFrame(each | {"target": t, "ic": pd.Series(correlations(pred, own[[t]].to_numpy(float))).astype(object).where(lambda v: v.notna(), None)}) for t in targets])[names]

    ship(rows.sparkSession)
    at = sessions.select(F.col("fold").cast("long").alias("fold"), F.col("idx").cast("long").alias("idx"), "part").join(weights, "fold")
    used = list(dict.fromkeys([*features, *targets]))
    left = rows.select(F.col("idx").cast("long").alias("idx"), *[F.col(f).cast("double").alias(f) for f in used])
    return left.groupBy("idx").cogroup(at.groupBy("idx")).applyInPandas(run, "fold long, part string, config string, target string, idx long, ic double")
