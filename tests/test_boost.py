"""Boosted trees against a plain greedy booster over the same bins."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boost, validation

D0 = date(2020, 1, 1)


def made(spark, sessions=30, names=20, seed=1):
    rng = np.random.default_rng(seed)
    n = sessions * names
    x = np.round(rng.normal(0, 1, (n, 3)), 1)
    y = np.where(x[:, 0] > 0.3, 1.0, -0.5) * np.where(x[:, 1] > 0, 1, 2) + 0.1 * rng.normal(size=n)
    idx = np.repeat(np.arange(sessions), names)
    rows = [(int(i % names), D0 + timedelta(int(k)), int(k), *map(float, v), float(t)) for i, (k, v, t) in enumerate(zip(idx, x, y, strict=True))]
    return x, y, idx, spark.createDataFrame(rows, "symbol long, trade_date date, idx long, a double, b double, c double, label double").repartition(4)


def plain(bins, y, o):
    """Trees as nested tuples (feature, bin, left, right) or leaf values, and the predictions on the rows themselves."""
    pred, out = np.full(len(y), y.mean()), []

    def grow(rows, depth):
        r = y[rows] - pred[rows]
        value = o.rate * r.sum() / (len(rows) + o.penalty)
        best = None
        if depth < o.depth:
            for f in range(bins.shape[1]):
                for c in sorted(set(bins[rows, f])):
                    left = bins[rows, f] <= c
                    nl, nr = left.sum(), (~left).sum()
                    if nl < o.least_rows or nr < o.least_rows:
                        continue
                    gain = r[left].sum() ** 2 / (nl + o.penalty) + r[~left].sum() ** 2 / (nr + o.penalty) - r.sum() ** 2 / (len(rows) + o.penalty)
                    if gain > o.least_gain and (best is None or round(gain, 9) > best[0]):
                        best = (round(gain, 9), f, c)
        if best is None:
            step[rows] = value
            return value
        left = bins[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

    for _ in range(o.trees):
        step = np.zeros(len(y))
        out.append(grow(np.arange(len(y)), 0))
        pred = pred + step
    return out, pred


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return pytest.approx(tree.value[node], abs=1e-9)
    return tree.feature[node], tree.bin[node], nested(tree, 2 * node + 1), nested(tree, 2 * node + 2)


@pytest.mark.parametrize("keep", [10, 2])
def test_trees_equal_the_plain_booster(spark, monkeypatch, keep):
    """Splits, leaves and predictions of every fold, with and without rows written between trees."""
    monkeypatch.setattr(boost, "KEEP", keep)
    x, y, idx, df = made(spark)
    o = boost.Options(trees=5, depth=3, bins=16, rate=0.3, least_rows=8)
    training = spark.createDataFrame([(f, i) for f, n in ((0, 12), (4, 25)) for i in range(n)], "fold long, idx long")
    model = boost.fit(df, training, ["a", "b", "c"], options=o)
    bins = model.cut(list(x.T))
    assert bins.max() == 15 and len(np.unique(bins[:, 0])) == 16
    for f, n in ((0, 12), (4, 25)):
        at = idx < n
        want, pred = plain(bins[at], y[at], o)
        assert [nested(t) for t in model.trees[f]] == want
        assert np.allclose(model.predict(f, bins[at]), pred)
        assert ((y[at] - pred) ** 2).mean() < 0.5 * y[at].var()


def test_walk_forward_predicts_later_sessions_only(spark):
    x, y, idx, df = made(spark, 60, 15)
    cal = spark.range(60).select(F.col("id").alias("idx"))
    folds = validation.walk_forward(cal, test=15, min_train=20, horizon=2, embargo=3)
    o = boost.Options(trees=4, depth=2, bins=8, least_rows=5, rate=0.5)
    rows = boost.walk_forward(df, cal, folds, ["a", "b", "c"], options=o).collect()
    spans = {r.fold: r for r in folds.collect()}
    assert len(rows) == sum(15 * (r.test_end - r.test_start + 1) for r in spans.values())
    model = boost.fit(df, validation.expanding_sessions(cal, folds), ["a", "b", "c"], options=o)
    bins = model.cut(list(x.T))
    for f, s in spans.items():
        at = idx <= s.train_end
        want, _ = plain(bins[at], y[at], o)
        assert [nested(t) for t in model.trees[f]] == want
    assert np.corrcoef([r.pred for r in rows], [r.label for r in rows])[0, 1] > 0.7


def test_odd_rows(spark):
    """Nulls go to the lowest bin, constant features never split, rows without label take no part, folds without rows have no model."""
    rows = [(1, D0, i % 5, None if i % 3 == 0 else float(i), 1.0, None if i == 7 else float(i > 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol long, trade_date date, idx long, a double, b double, label double")
    training = spark.createDataFrame([(0, i) for i in range(5)] + [(9, 77)], "fold long, idx long")
    model = boost.fit(df, training, ["a", "b"], options=boost.Options(trees=2, depth=2, least_rows=3))
    assert set(model.trees) == {0} and all(t.feature.max() <= 0 for t in model.trees[0])
    got = boost.predict(df, model, training).collect()
    assert len(got) == 40 and all(r.pred is not None for r in got)
    nothing = boost.fit(df.limit(0), training, ["a", "b"])
    assert nothing.trees == {} and all(r.pred is None for r in boost.predict(df, nothing, training).collect())
