"""Models from shared Gram rows against models that are fitted alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gram, validation

from .test_backtest_risk import spearman


def alone(x, y, penalty=1.0):
    a = np.column_stack([x, np.ones(len(x))])
    return np.linalg.lstsq(a.T @ a + penalty * np.diag([1.0] * x.shape[1] + [0.0]), a.T @ y, rcond=None)[0]


def made(spark, n_candidates, sessions=70, names=12):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (sessions * names, 3 + n_candidates))
    x[:, 4] = x[:, 0] * 2 - x[:, 1]  # a candidate that the library already holds
    x[:, 5] = 0.0
    y = x[:, 0] * 0.2 + x[:, 3] * 0.3 + rng.normal(0, 1, len(x))
    idx = np.repeat(np.arange(sessions), names)
    columns = ["a", "b", "c", *[f"x{i}" for i in range(n_candidates)]]
    df = spark.createDataFrame([(int(i), *map(float, r), float(v)) for i, r, v in zip(idx, x, y, strict=True)], ["idx", *columns, "label"])
    return x, y, idx, columns, df.repartition(5)


def test_two_hundred_candidates_equal_single_fits(spark):
    """One pass, each candidate's out-of-sample correlations as if it were fitted alone with the library, fold by fold."""
    x, y, idx, columns, df = made(spark, 200)
    cal = spark.range(70).select(F.col("id").alias("idx"))
    folds = validation.walk_forward(cal, test=15, min_train=30, horizon=2, embargo=3)
    got = {r.config: r for r in validation.candidates(df, cal, folds, columns[:3], columns[3:], min_names=5).collect()}
    assert len(got) == 201
    spans = folds.collect()

    def ic(chosen):
        out = []
        for f in spans:
            w = alone(x[idx <= f.train_end][:, chosen], y[idx <= f.train_end])
            for i in range(f.test_start, f.test_end + 1):
                at = idx == i
                out.append(spearman(x[at][:, chosen] @ w[:-1] + w[-1], y[at]))
        return out

    base = ic([0, 1, 2])
    assert (got[""].days, got[""].mean_ic, got[""].delta_ic) == (len(base), pytest.approx(np.mean(base)), 0.0)
    for c in (0, 1, 2, 3, 50, 199):
        own = ic([0, 1, 2, 3 + c])
        r = got[f"x{c}"]
        assert (r.mean_ic, r.delta_ic) == (pytest.approx(np.mean(own), abs=1e-9), pytest.approx(np.mean(own) - np.mean(base), abs=1e-9))
        assert r.t == pytest.approx(np.mean(own) / (np.std(own, ddof=1) / np.sqrt(len(own))), abs=1e-7)


def test_borders_equal_sub_matrices(spark):
    """Both solvers on the same sums, and on sessions that come in many batches."""
    x, y, idx, columns, df = made(spark, 6)
    training = spark.createDataFrame([(f, i) for f in (0, 1) for i in range(20 + 30 * f)], "fold long, idx long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        border = {r.fold: np.reshape(r.w, (7, 10)) for r in gram.fold_weights(gram.session_grams(df, columns[:3], columns[3:]), training, gram.by_borders(3, 6, 1.0)).collect()}
        sets = [[0, 1, 2], *[[0, 1, 2, 3 + c] for c in range(6)]]
        whole = {r.fold: np.reshape(r.w, (7, 10)) for r in gram.fold_weights(gram.session_grams(df, columns[:3], columns[3:], full=True), training, gram.by_sets(sets, 3, 6, 1.0)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for f in (0, 1):
        assert np.allclose(border[f], whole[f], atol=1e-9)
        at = idx < 20 + 30 * f
        assert np.allclose(whole[f][3][[0, 1, 2, 5, 9]], alone(x[at][:, [0, 1, 2, 5]], y[at]), atol=1e-9)


def test_odd_sessions(spark):
    """Rows without a label take no part; sessions with few names or without variance have no correlation; no rows give none."""
    rows = [(0, 1.0, 2.0), (0, 2.0, 1.0), (0, 3.0, None), (1, 1.0, 1.0), (1, 1.0, 2.0), (2, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "idx long, a double, label double")
    w = spark.createDataFrame([(0, [1.0, 0.0])], "fold long, w array<double>")
    at = spark.createDataFrame([(0, i, "p") for i in range(4)], "fold long, idx long, part string")
    got = {r.idx: r.ic for r in gram.session_ics(df, w, at, ["a"], ["m"], min_names=2).collect()}
    assert got == {0: pytest.approx(-1.0), 1: None}
    assert gram.session_grams(df.limit(0), ["a"], []).count() == 0
    assert np.allclose(gram.correlations(np.array([[1.0, 1.0], [1.0, 2.0], [2.0, 3.0]]), np.array([[1.0], [2.0], [2.0]])), [0.5, np.sqrt(3) / 2])
