"""Distributed network training against one process on the same rows."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boost, network, validation

D0 = date(2020, 1, 1)
KINDS = ["dense", "gru", "lstm"]


def made(spark, sessions=30, names=20, seed=1, parts=5):
    rng = np.random.default_rng(seed)
    n = sessions * names
    x = rng.normal(3, 2, (n, 3))
    y = 5 + np.tanh(x[:, 0] - 3) * 2 - 0.5 * (x[:, 1] - 3) + 0.05 * rng.normal(size=n)
    idx = np.repeat(np.arange(sessions), names)
    rows = [(int(i % names), D0 + timedelta(int(k)), int(k), *map(float, v), float(t)) for i, (k, v, t) in enumerate(zip(idx, x, y, strict=True))]
    return x, y, idx, spark.createDataFrame(rows, "symbol long, trade_date date, idx long, a double, b double, c double, label double").repartition(parts)


@pytest.mark.parametrize("kind", KINDS)
def test_gradients_equal_differences(kind):
    rng = np.random.default_rng(3)
    o = network.Options(kind, hidden=3)
    w, x, y = network.start(o, 4, 0), rng.normal(size=(7, 4)), rng.normal(size=7)
    loss = lambda w: 0.5 * ((network.forward(w, x, o)[0] - y) ** 2).sum()
    slow = [(loss(w + e) - loss(w - e)) / 2e-6 for e in np.eye(len(w)) * 1e-6]
    assert np.allclose(network.gradient(w, x, y, o), slow, atol=1e-6)


def scalar_gru(w, x, o):
    """One row at a time, each gate by its own formula."""
    wi, u, b, c, head, bias = network.split(w, o, len(x))
    s, h = o.hidden, np.zeros(o.hidden)
    for v in x:
        r = 1 / (1 + np.exp(-(v * wi[0, :s] + h @ u[:, :s] + b[:s])))
        z = 1 / (1 + np.exp(-(v * wi[0, s : 2 * s] + h @ u[:, s : 2 * s] + b[s : 2 * s])))
        n = np.tanh(v * wi[0, 2 * s :] + b[2 * s :] + r * (h @ u[:, 2 * s :] + c))
        h = (1 - z) * n + z * h
    return h @ head + bias[0]


def scalar_lstm(w, x, o):
    wi, u, b, head, bias = network.split(w, o, len(x))
    s, h, c = o.hidden, np.zeros(o.hidden), np.zeros(o.hidden)
    gate = lambda k, f: f(v * wi[0, k * s : (k + 1) * s] + h @ u[:, k * s : (k + 1) * s] + b[k * s : (k + 1) * s])
    logistic = lambda a: 1 / (1 + np.exp(-a))
    for v in x:
        i, f, g, out = gate(0, logistic), gate(1, logistic), gate(2, np.tanh), gate(3, logistic)
        c = f * c + i * g
        h = out * np.tanh(c)
    return h @ head + bias[0]


@pytest.mark.parametrize(("kind", "scalar"), [("gru", scalar_gru), ("lstm", scalar_lstm)])
def test_sequences_equal_scalar_recursions(kind, scalar):
    o = network.Options(kind, hidden=4)
    x, w = np.random.default_rng(5).normal(size=(6, 5)), network.start(o, 5, 2)
    assert np.allclose(network.forward(w, x, o)[0], [scalar(w, v, o) for v in x])


def alone(x, y, o, fold):
    """The same descent in one process: all rows at once, the optimiser written out."""
    mx, sx, my, sy = x.mean(0), x.std(0), y.mean(), y.std()
    xs, ys = (x - mx) / sx, (y - my) / sy
    w = network.start(o, x.shape[1], fold)
    m = v = np.zeros(len(w))
    for t in range(1, o.epochs + 1):
        g = network.gradient(w, xs, ys, o) / len(y) + o.decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - o.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, lambda some: network.forward(w, (some - mx) / sx, o)[0] * sy + my


@pytest.mark.parametrize(("kind", "fan_in", "piece"), [("dense", 64, 1024), ("dense", 2, 7), ("gru", 2, 1024), ("lstm", 64, 50)])
def test_training_equals_one_process(spark, monkeypatch, kind, fan_in, piece):
    """All folds' weights and predictions, however many exchanges and slices the sums take."""
    monkeypatch.setattr(network, "FAN_IN", fan_in)
    monkeypatch.setattr(network, "SLICE", piece)
    x, y, idx, df = made(spark)
    o = network.Options(kind, hidden=4, epochs=6, rate=0.05, decay=0.01)
    training = spark.createDataFrame([(f, i) for f, n in ((0, 12), (4, 25)) for i in range(n)], "fold long, idx long")
    model = network.fit(df, training, ["a", "b", "c"], options=o)
    for f, n in ((0, 12), (4, 25)):
        w, predicted = alone(x[idx < n], y[idx < n], o, f)
        assert np.allclose(model.weights[f], w, atol=1e-8)
        assert np.allclose(model.predict(f, x), predicted(x), atol=1e-7)


def test_walk_forward_learns_and_predicts_later_sessions_only(spark):
    x, y, idx, df = made(spark, 60, 15)
    cal = spark.range(60).select(F.col("id").alias("idx"))
    folds = validation.walk_forward(cal, test=15, min_train=20, horizon=2, embargo=3)
    o = network.Options(hidden=8, epochs=40, rate=0.05)
    rows = network.walk_forward(df, cal, folds, ["a", "b", "c"], options=o).collect()
    spans = {r.fold: r for r in folds.collect()}
    assert len(rows) == sum(15 * (r.test_end - r.test_start + 1) for r in spans.values())
    for f, s in spans.items():
        _, predicted = alone(x[idx <= s.train_end], y[idx <= s.train_end], o, f)
        want = dict(zip(zip((np.arange(len(y)) % 15).tolist(), idx.tolist(), strict=True), predicted(x), strict=True))
        assert all(r.pred == pytest.approx(want[r.symbol, (r.trade_date - D0).days], abs=1e-6) for r in rows if r.fold == f)
    assert np.corrcoef([r.pred for r in rows], [r.label for r in rows])[0, 1] > 0.95


def test_odd_rows(spark):
    """Missing features count as the mean, constants are scaled by 1, rows without a finite label train nothing, folds without rows have no model."""
    nan, inf = float("nan"), float("inf")
    odd = {3: None, 5: nan, 8: inf}
    rows = [(1, D0, i % 5, odd.get(i, float(i)), 1.0, {7: None, 9: nan, 11: -inf}.get(i, float(i > 20))) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol long, trade_date date, idx long, a double, b double, label double")
    training = spark.createDataFrame([(0, i) for i in range(5)] + [(9, 77)], "fold long, idx long")
    o = network.Options(hidden=3, epochs=3)
    model = network.fit(df, training, ["a", "b"], options=o)
    assert set(model.weights) == {0} and model.scale[0][1] == 1.0
    held = [(r[3], r[5]) for r in rows if r[5] is not None and np.isfinite(r[5])]
    seen = np.array([a for a, _ in held if a is not None and np.isfinite(a)])
    assert model.centre[0][0] == pytest.approx(seen.mean()) and model.scale[0][0] == pytest.approx(seen.std()) and model.centre[0][2] == pytest.approx(np.mean([y for _, y in held]))
    got = network.predict(df, model, training).collect()
    at_mean = model.predict(0, np.array([[seen.mean(), 1.0]]))[0]
    assert len(got) == 40 and all(r.pred is not None and np.isfinite(r.pred) for r in got)
    assert sum(abs(r.pred - at_mean) < 1e-12 for r in got) >= 3
    nothing = network.fit(df.limit(0), training, ["a", "b"], options=o)
    assert nothing.weights == {} and all(r.pred is None for r in network.predict(df, nothing, training).collect())
    assert network.fit(df, training.limit(0), ["a", "b"], options=o).weights == {}
    with pytest.raises(ValueError, match="unknown kind"):
        network.fit(df, training, ["a"], options=network.Options("conv"))


def test_repeated_fits_are_equal_and_seeds_differ(spark):
    *_, df = made(spark, 10, 10)
    training = spark.createDataFrame([(0, i) for i in range(10)], "fold long, idx long")
    o = network.Options(hidden=4, epochs=2)
    one, two, other = (network.fit(df, training, ["a", "b", "c"], options=x).weights[0] for x in (o, o, network.Options(hidden=4, epochs=2, seed=8)))
    assert np.allclose(one, two, atol=1e-12) and not np.allclose(one, other, atol=1e-3)


def test_ensemble_is_the_mean_where_all_predict(spark):
    make = lambda preds: spark.createDataFrame([(s, D0, 0, p, 1.0) for s, p in preds], "symbol long, trade_date date, fold long, pred double, label double")
    got = network.ensemble({"a": make([(1, 1.0), (2, 2.0), (3, None)]), "b": make([(1, 3.0), (3, 5.0)])})
    assert {(r.learner, r.symbol): r.pred for r in got.collect()} == {("a", 1): 1.0, ("a", 2): 2.0, ("a", 3): None, ("b", 1): 3.0, ("b", 3): 5.0, ("ensemble", 1): 2.0}


def test_sweep_scores_each_kind_of_learner(spark):
    x, y, idx, df = made(spark, 24, 12)
    cal = spark.range(24).select(F.col("id").alias("idx"))
    for learner, o in ((boost, boost.Options(trees=2, depth=2, bins=8, least_rows=5, rate=0.5)), (network, network.Options(hidden=4, epochs=10, rate=0.1))):
        got = validation.cpcv_learner(df, cal, "one", ["a", "b", "c"], learner, o, blocks=4, pick=1, gap=1, min_names=5).collect()
        assert [r.combo for r in sorted(got)] == [0, 1, 2, 3] and all(r.config == "one" and r.is_score > 0.3 and r.oos_score > 0.3 for r in got)


def test_passes_read_blocks(spark):
    """A pass hands on a few blocks with all values, not a row at a time."""
    x, y, idx, df = made(spark, parts=2)
    rows = df.select("idx", F.col("label").alias("y"), *[F.when(F.col("idx") != 3, F.col(c)).alias(f"x{i}") for i, c in enumerate("abc")])
    blocks = network.packed(rows, 3).collect()
    assert len(blocks) == 2
    got = np.hstack([np.frombuffer(b.block).reshape(5, -1) for b in blocks])
    want = np.vstack([idx, y, np.where(idx == 3, np.nan, x.T)])
    order = lambda m: m[:, np.lexsort(m[:2])]
    assert np.array_equal(order(got), order(want), equal_nan=True)


@pytest.mark.parametrize("kind", ["gru", "lstm"])
def test_recurrent_cells_take_any_size_and_slice(kind):
    """Gradients of slices add up, also where gates are far out and a smaller slice follows a larger one."""
    rng = np.random.default_rng(8)
    o = network.Options(kind, hidden=4)
    w, x, y = 40 * network.start(o, 5, 1), rng.normal(size=(50, 5)) * 100, rng.normal(size=50)
    whole = network.gradient(w, x, y, o)
    parts = sum(network.gradient(w, x[a:b], y[a:b], o) for a, b in ((0, 37), (37, 38), (38, 50)))
    assert np.isfinite(whole).all() and np.allclose(whole, parts)
