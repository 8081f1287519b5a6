"""Sliding kernels, wavelets and mode decomposition against plain versions."""

import math
import re
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import emd, sliding, wavelet

D0 = date(2020, 1, 1)
SMALL = "/root/testdata/sf0.001"


def frame(spark, series, column="close"):
    rows = [(s, D0 + timedelta(i), None if v is None else float(v)) for s, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"symbol long, trade_date date, {column} double").repartition(5)


def by_name(df, column):
    out = {}
    for r in df.orderBy("symbol", "trade_date").collect():
        out.setdefault(r.symbol, []).append(r[column])
    return out


def approx(x):
    return [None if v is None or v != v else pytest.approx(v, abs=1e-9) for v in x]


@pytest.mark.parametrize("rows_a_batch", ["7", "10000"])
def test_order_statistics_equal_rolling_ones(spark, rows_a_batch):
    """Ties, nulls, a null name and names shorter than the window, whole and in batches that cut names apart."""
    rng = np.random.default_rng(1)
    series = {1: rng.integers(0, 9, 80).tolist(), 2: [None if rng.random() < 0.3 else float(v) for v in rng.normal(0, 1, 60)], 3: [1, 2, 3], None: rng.normal(0, 1, 20).tolist(), 4: [None] * 12}
    kernels = {
        "median": ("close", sliding.quantile(10)), "low": ("close", sliding.quantile(10, 0.2, min_rows=2)), "late": ("close", sliding.quantile(5, lag=3, min_rows=1)), "far": ("close", sliding.quantile(None, 0.9)),
        "max": ("close", sliding.extreme("max", 10)), "min": ("close", sliding.extreme("min", 6, min_rows=1)), "upper": ("close", sliding.quantile(10, upper=True)), "row": ("close", sliding.Row),
    }
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = sliding.slide(frame(spark, series), kernels)
        rows = {n: by_name(got, n) for n in kernels}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s, x in series.items():
        v = pd.Series(x, dtype=float)
        want = {
            "median": v.rolling(10).median(), "low": v.rolling(10, min_periods=2).quantile(0.2), "late": v.rolling(5, min_periods=1).median().shift(3), "far": v.expanding().quantile(0.9), "max": v.rolling(10).max(),
            "min": v.rolling(6, min_periods=1).min(), "upper": v.rolling(10).quantile(0.5, interpolation="higher"), "row": pd.Series(range(1, len(v) + 1)),
        }
        for n, w in want.items():
            assert rows[n][s] == approx(w), (s, n)
    assert sliding.slide(frame(spark, {}), kernels).count() == 0


def test_one_series_without_keys(spark):
    df = frame(spark, {1: [3, 1, 2, 5]}).drop("symbol")
    got = [r.m for r in sliding.slide(df, {"m": ("close", sliding.quantile(2))}, keys=()).orderBy("trade_date").collect()]
    assert got == [None, 2.0, 1.5, 3.5]


def test_filters_are_orthogonal_and_kill_polynomials():
    for order in (1, 2, 4, 6):
        h = wavelet.scaling_filter(order)
        g = np.array([(-1) ** (j + 1) * h[j] for j in range(2 * order)])
        assert h.sum() == pytest.approx(math.sqrt(2)) and all(h[2 * k :] @ h[: len(h) - 2 * k] == pytest.approx(float(k == 0), abs=1e-9) for k in range(order))
        assert all(abs((g * np.arange(2 * order) ** k).sum()) < 1e-6 for k in range(order))
    assert wavelet.scaling_filter(1) == pytest.approx([1 / math.sqrt(2)] * 2)
    assert wavelet.levels(252, 8) == 5 and wavelet.levels(6, 8) == 0


@pytest.mark.parametrize("n", [8, 9, 31, 64, 252, 255])
def test_analysis_is_undone(n):
    analysis, synthesis, sizes = wavelet.maps(n)
    assert np.allclose(synthesis @ analysis, np.eye(n), atol=1e-10) and sum(sizes) == len(analysis)


def plain(x):
    """Level by level, by loops over the circular convolution."""
    h = wavelet.scaling_filter(4)
    a, details, lengths = list(x), [], []
    for _ in range(wavelet.levels(len(x), 8)):
        lengths.append(len(a))
        a = a + [a[-1]] * (len(a) % 2)
        n = len(a)
        at = [[(4 + 2 * o - j) % n for j in range(8)] for o in range(n // 2)]
        details.append([sum((-1) ** (j + 1) * h[j] * a[p] for j, p in enumerate(row)) for row in at])
        a = [sum(h[7 - j] * a[p] for j, p in enumerate(row)) for row in at]
    limit = np.median(np.abs(details[0])) / 0.6745 * math.sqrt(2 * math.log(len(x)))
    for d, n in zip(reversed(details), reversed(lengths), strict=True):
        size = n + n % 2
        out = [0.0] * size
        for o in range(size // 2):
            v = math.copysign(max(abs(d[o]) - limit, 0), d[o])
            for j in range(8):
                out[(4 + 2 * o - j) % size] += h[7 - j] * a[o] + (-1) ** (j + 1) * h[j] * v
        a = out[:n]
    return np.array(a)


def test_shrinkage_equals_the_filter_bank():
    rng = np.random.default_rng(3)
    w = np.cumsum(rng.normal(0, 1, (5, 252)), 1)
    assert np.allclose(wavelet.denoise(w), [plain(x) for x in w], atol=1e-8)
    assert np.allclose(wavelet.last_denoised(w), wavelet.denoise(w)[:, -1])


def test_causal_denoising_sees_no_future(spark):
    rng = np.random.default_rng(5)
    series = {1: (100 + np.cumsum(rng.normal(0, 1, 300))).tolist(), 2: (50 + np.cumsum(rng.normal(0, 1, 262))).tolist(), 3: [1.0] * 20}
    series[2][3] = None
    got = by_name(wavelet.causal_denoise(frame(spark, series), "close"), "denoised")
    assert got[1] == [None] * 251 + [pytest.approx(plain(series[1][i - 251 : i + 1])[-1], abs=1e-8) for i in range(251, 300)]
    assert got[2][:255] == [None] * 255 and got[2][255] == pytest.approx(plain(series[2][4:256])[-1], abs=1e-8) and got[3] == [None] * 20
    short = by_name(wavelet.causal_denoise(frame(spark, {1: series[1][:280]}), "close"), "denoised")
    assert short[1] == approx(got[1][:280])


def test_spline_is_natural_and_exact():
    at, v = np.array([0.0, 1, 2.5, 4, 7]), np.array([0.0, 2, 1, 3, 0])
    assert np.allclose(emd.spline(at, v, at), v)
    fine = emd.spline(at, v, np.linspace(0, 7, 7001))
    second = np.diff(fine, 2) / 1e-6
    assert abs(second[0]) < 0.05 and abs(second[-1]) < 0.05 and np.abs(np.diff(second)).max() < 0.05
    assert np.allclose(emd.spline(at[:2], v[:2], np.array([0.5])), 1.0) and np.allclose(emd.spline(at[:1], v[:1], at), 0.0)


def test_modes_add_up_and_part_quick_from_slow():
    t = np.arange(400)
    slow, quick = 3 * np.sin(2 * np.pi * t / 100) + t / 50, np.sin(2 * np.pi * t / 8)
    modes = emd.decompose(slow + quick)
    assert np.allclose(sum(modes), slow + quick) and len(modes) >= 3
    inner = slice(20, -20)
    assert np.corrcoef(modes[0][inner], quick[inner])[0, 1] > 0.99 and np.abs(emd.without_first_mode(slow + quick)[inner] - slow[inner]).max() < 0.3
    for x in (np.zeros(9), np.ones(1), np.arange(50.0), np.array([1.0, 2, 1, 2])):
        assert np.allclose(sum(emd.decompose(x)), x)
    high, low = emd.extrema(np.array([0, 1, 1, 1, 0, -1, -1, 2.0]))
    assert high.tolist() == [2] and low.tolist() == [5]


def test_series_sifted_together_have_their_own_first_modes():
    rng = np.random.default_rng(8)
    series = [np.cumsum(rng.normal(0, 1, n)) for n in (90, 7, 1, 300, 2, 40)] + [np.ones(20), np.sin(np.arange(60)), np.round(np.cumsum(rng.normal(0, 1, 120)))]
    modes = np.split(emd.first_modes(np.concatenate(series), [len(x) for x in series]), np.cumsum([len(x) for x in series])[:-1])
    for x, mode in zip(series, modes, strict=True):
        alone = emd.first_mode(x)
        assert np.allclose(mode, np.zeros(len(x)) if alone is None else alone, atol=1e-9)


def test_decompositions_by_name(spark):
    rng = np.random.default_rng(6)
    series = {1: (10 + np.cumsum(rng.normal(0, 1, 90))).tolist(), 2: [1.0, None, 2.0, 1.0], 3: np.sin(np.arange(60)).tolist()}
    df = frame(spark, series)
    whole = by_name(emd.emd_denoise(df, "close"), "denoised")
    assert whole[1] == approx(emd.without_first_mode(np.array(series[1]))) and whole[2][1] is None
    ensemble = by_name(emd.ceemdan_denoise(df, "close", trials=4), "denoised")
    x = np.array(series[1])
    modes = [emd.first_mode(x + 0.2 * x.std() * np.random.default_rng([7, k]).standard_normal(90)) for k in range(4)]
    assert ensemble[1] == approx(x - np.mean(modes, 0)) and len(ensemble[2]) == 3
    causal = by_name(emd.causal_emd(df, "close", window=30), "denoised")
    assert causal[1] == [None] * 29 + approx([emd.without_first_mode(x[i - 29 : i + 1])[-1] for i in range(29, 90)])


def test_event_windows_slide_and_agree_with_brute_force(spark):
    """Means before, sums after and the next meeting are one step a row: no window expression builds a frame anew for each row."""
    import re

    from tidemark.operators import events

    rng = np.random.default_rng(3)
    days = [date(2020, 1, 1) + timedelta(i) for i in range(200)]
    ret = {s: rng.normal(0, 1, len(days)) for s in ("A", "B")}
    mret = rng.normal(0, 1, len(days))
    panel = spark.createDataFrame([(s, d, float(r)) for s, x in ret.items() for d, r in zip(days, x, strict=True)], "symbol string, trade_date date, ret double")
    market = spark.createDataFrame([(d, float(m)) for d, m in zip(days, mret, strict=True)], "trade_date date, mret double")
    ab = events.market_model(panel, market)
    ev = spark.createDataFrame([(s, d) for s in ret for d in days], "symbol string, knowable_date date")
    cars = events.car(ab, ev, [(0, 1), (2, 20)], ())
    grid = panel.select("symbol", "trade_date")
    told = ev.selectExpr("symbol", "knowable_date", "'pledge' as category", "-1 as direction", "1 as materiality")
    made = events.event_features(grid, told, ev.selectExpr("symbol", "knowable_date as meeting_date", "knowable_date as known_date"), ab)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (ab, cars, made)]
    assert not [f for p in plans for f in re.findall(r"specifiedwindowframe\(RowFrame, [^)]*\)", p) if "unboundedpreceding$()" not in f]
    got = {(r.symbol, r.trade_date): r.ar for r in ab.collect()}
    want = {}
    for s, x in ret.items():
        for i in range(60, len(days)):
            y, m = x[max(0, i - 120) : i], mret[max(0, i - 120) : i]
            beta = (np.mean(y * m) - y.mean() * m.mean()) / (np.mean(m * m) - m.mean() ** 2 + 1e-12)
            want[s, days[i]] = x[i] - (y.mean() - beta * m.mean()) - beta * mret[i]
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    for r in cars.collect():
        lo, hi = (0, 1) if r.window == "[0,1]" else (2, 20)
        at = days.index(r.knowable_date)
        assert abs(r.car - sum(want[r.symbol, d] for d in days[at + lo : at + hi + 1])) < 1e-9
    assert cars.count() == 2 * (139 + 120)


def test_array_formulas_equal_the_column_expressions(spark):
    """Over names shorter and longer than the windows, with missing and equal values, in batches shorter than a window."""
    from tidemark.functions import dsl
    from tidemark.operators import features
    from tidemark.sources import views

    rows = [(s, date(2020, 1, 1) + timedelta(i), None if (i * s) % 97 == 5 else 50.0 if s == 3 else 100.0 + (i * (5 + s)) % 31 + i * 0.1, 7.0 if s == 3 else 1e4 * s + i % 13) for s, n in ((1, 400), (2, 20), (3, 300), (4, 1)) for i in range(n)]
    panel = spark.createDataFrame(rows, "symbol long, trade_date date, close double, traded_value double").withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1})
    panel = views.returns(panel)
    names = list(features.formulas())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = sliding.evaluate(panel, lambda on: features.formulas(on=on) | dsl.arrays(dsl.SEEDS)(on)).orderBy("symbol", "trade_date").collect()
        year = features.raw_features(panel, [f.name for f in features.REGISTRY]).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = features.library() | {n: dsl.compile_expression(s) for n, s in dsl.SEEDS.items()}
    want = panel.withColumns(made).orderBy("symbol", "trade_date").collect()
    assert len(got) == len(want) == 721 and year == sum(r.ret_252d is not None for r in want) > 0
    for a, b in zip(got, want, strict=True):
        for n in [*names, *dsl.SEEDS]:
            assert (a[n] is None) == (b[n] is None) and (a[n] is None or a[n] == pytest.approx(b[n], rel=1e-9, abs=1e-9)), (n, a, b)


def test_feature_frames_do_not_grow_with_the_window(spark):
    """The feature library and the seeds have no frame of many rows that is added up anew for each row."""
    from tidemark.plans import kernels
    from tidemark.plans.factors import feature_library_zscored

    for made in (feature_library_zscored(spark, SMALL), kernels.dsl_seed_features(spark, SMALL)):
        assert not re.search(r"RowFrame, -\d\d", made._jdf.queryExecution().optimizedPlan().toString())
