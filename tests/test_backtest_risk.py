import math
import random
from datetime import date, timedelta
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.expr import cost_rate
from tidemark.operators import backtest, engine, portfolio, risk, validation

D0 = date(2020, 1, 6)


def world(names=4, days=40, seed=3):
    rnd, px, out = random.Random(seed), {}, []
    for i in range(days):
        for s in range(1, names + 1):
            old = px.get(s)
            px[s] = (old or 100.0) * math.exp(rnd.gauss(0, 0.02))
            out.append((s, D0 + timedelta(i), px[s], px[s] / old - 1 if old else None, 1e9))
    return out


def test_closed_form_equals_the_day_loop(spark):
    rows = world()
    targets = [(D0 + timedelta(5), 1, 0.5, 1e8), (D0 + timedelta(5), 2, 0.3, 1e8), (D0 + timedelta(12), 2, 0.6, 1e8), (D0 + timedelta(12), 3, 0.4, 1e8), (D0 + timedelta(39), 4, 1.0, 1e8)]
    panel = spark.createDataFrame(rows, "symbol long, trade_date date, close double, ret double, traded_value double")
    t = spark.createDataFrame(targets, "rebalance_date date, symbol long, weight double, adv double")
    got = {r.trade_date: r for r in backtest.run(panel, t, capital=1e6).collect()}
    ret = {(s, d): r or 0.0 for s, d, _, r, _ in rows}
    w, pending = {}, None
    for i in range(40):
        d = D0 + timedelta(i)
        gross = sum(x * ret[s, d] for s, x in w.items())
        w = {s: x * (1 + ret[s, d]) / (1 + gross) for s, x in w.items()}
        turn = 0.0
        if pending is not None:
            turn = sum(abs(pending.get(s, 0) - w.get(s, 0)) for s in pending.keys() | w.keys()) / 2
            w, pending = pending, None
        if d in {x[0] for x in targets}:
            pending = {s: x for day, s, x, _ in targets if day == d}
        if d in got:
            assert got[d].gross_return == pytest.approx(gross, abs=1e-12) and got[d].turnover == pytest.approx(turn, abs=1e-12)
        else:
            assert gross == 0 and turn == 0


def test_a_jump_between_signal_and_execution_is_not_earned(spark):
    rows = [(1, D0 + timedelta(i), 100.0 if i < 3 else 200.0, (1.0 if i == 3 else 0.0) if i else None, 1e9) for i in range(6)]
    panel = spark.createDataFrame(rows, "symbol long, trade_date date, close double, ret double, traded_value double")
    t = spark.createDataFrame([(D0 + timedelta(2), 1, 1.0, 1e9)], "rebalance_date date, symbol long, weight double, adv double")
    assert all(r.gross_return == 0 for r in backtest.run(panel, t).collect())


def test_costs(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    base = 0.001 + (3.07e-5 + 1e-6) * 1.18 + 1.5e-4
    assert one(cost_rate("buy", F.lit(1e6), F.lit(1e8))) == pytest.approx(base + 4e-4)
    assert one(cost_rate("buy", F.lit(4e6), F.lit(1e8))) == pytest.approx(base + 5e-4)
    assert one(cost_rate("buy", F.lit(1e6), F.lit(1e8), impact_multiplier=0.5)) == pytest.approx(base + 2e-4)
    assert one(cost_rate("buy", F.lit(1e6), F.lit(0.0))) == pytest.approx(base)


def series(spark, values):
    return spark.createDataFrame([(D0 + timedelta(i), float(v)) for i, v in enumerate(values)], "trade_date date, r double")


def test_drawdown_rails(spark):
    s = risk.drawdown_state(series(spark, [0.0] + [-0.05] * 4)).orderBy("trade_date").collect()
    assert s[-1].drawdown == pytest.approx(0.95**4 - 1) and s[-1].state == "flat" and s[2].state == "normal"


def test_liquidation_days(spark):
    h = spark.createDataFrame([(D0, 1, 1.0)], "rebalance_date date, symbol long, weight double")
    adv = spark.createDataFrame([(1, 1e6)], "symbol long, adv double")
    assert risk.days_to_liquidate(h, adv, capital=5e6).first().days == pytest.approx(25)


def test_var_needs_60_rows_and_other_reports_none(spark):
    with pytest.raises(Exception, match="60 observations"):
        risk.var_report(series(spark, [0.01] * 59)).collect()
    with pytest.raises(Exception, match="60 observations"):
        risk.var_report(series(spark, [])).collect()
    assert backtest.summarise(series(spark, []), "r").first().days == 0


def test_tax_carries_losses(spark):
    rows = spark.createDataFrame([(date(2020, 5, 1), -10.0), (date(2021, 5, 1), 6.0), (date(2022, 5, 1), 9.0)], "trade_date date, r double")
    got = [(r.fy, r.taxed, r.carried_loss) for r in risk.post_tax(rows).orderBy("fy").collect()]
    assert got == [(2020, 0.0, 10.0), (2021, 0.0, 4.0), (2022, 5.0, 0.0)]


def test_walk_forward_and_combinatorial(spark):
    cal = spark.range(400).select(F.col("id").alias("idx"))
    f = validation.walk_forward(cal, test=50, min_train=200, horizon=5, embargo=10).orderBy("fold").collect()
    assert len(f) == 3 and f[0].test_start == 215 and f[0].test_start - f[0].train_end == 16
    assert validation.combinatorial(cal).select("combo").distinct().count() == 28


def test_overfitting_extremes(spark):
    rows = lambda flip: spark.createDataFrame([(c, k, float(k), float(-k if flip else k)) for c in range(6) for k in range(5)], "combo long, config long, is_score double, oos_score double")
    assert validation.overfitting(rows(False)).first().pbo == 0.0
    assert validation.overfitting(rows(True)).first().pbo == 1.0


def test_construction_kernels(spark):
    assert portfolio.min_variance(np.diag([0.01, 0.04])) == pytest.approx([0.8, 0.2], rel=1e-6)
    b = spark.createDataFrame([(D0, 1, 0.1), (D0, 2, 0.2)], "rebalance_date date, symbol long, vol double")
    assert sorted(r.weight for r in portfolio.inverse_vol(b).collect()) == pytest.approx([1 / 3, 2 / 3])
    w = spark.createDataFrame([(D0, 1, 0.7), (D0, 2, 0.2), (D0, 3, 0.1)], "rebalance_date date, symbol long, weight double")
    capped = {r.symbol: r.weight for r in portfolio.cap_positions(w, 0.4).collect()}
    assert max(capped.values()) <= 0.4 + 1e-9 and sum(capped.values()) == pytest.approx(1.0)
    trade = lambda t, p: spark.range(1).select(portfolio.no_trade(F.lit(t), F.lit(p), 0.25)).first()[0]
    assert trade(0.5, 0.45) == 0.45 and trade(0.5, 0.1) == 0.5
    assert portfolio.violations(w, portfolio.Config()).first().constraint == "position_cap"


def numbers(n=400, seed=5):
    return np.random.default_rng(seed).normal(0.0005, 0.012, n)


def test_var_report_gives_losses(spark):
    x = numbers()
    r = risk.var_report(series(spark, x)).first()
    z, mu, sd = NormalDist().inv_cdf(0.05), x.mean(), x.std(ddof=1)
    d = (x - mu) / x.std()
    s, k = (d**3).mean(), (d**4).mean() - 3
    cf = z + (z**2 - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s**2 / 36
    q = np.quantile(x, 0.05)
    assert (r.var95, r.cvar95, r.cf_var95) == pytest.approx((-q, -x[x <= q].mean(), -(mu + sd * cf)), rel=1e-9) and r.var99 > r.var95 > 0


def test_sortino_is_over_losing_days(spark):
    x = numbers()
    r = risk.sortino_calmar(series(spark, x)).first()
    eq = np.cumprod(1 + x)
    worst = (eq / np.maximum.accumulate(eq) - 1).min()
    assert r.sortino == pytest.approx(x.mean() * 252 / np.sqrt((x[x < 0] ** 2).mean() * 252)) and r.calmar == pytest.approx((eq[-1] ** (252 / len(x)) - 1) / -worst)
    gains = risk.sortino_calmar(series(spark, [0.01] * 5)).first()
    assert gains.sortino == math.inf and gains.calmar == 0.0


def test_normal_distribution(spark):
    points = [-9.0, -6.5, -3.2, -1.0, -1e-9, 0.0, 0.3, 1.96, 4.0, 8.3, 40.0]
    df = spark.createDataFrame([(x,) for x in points], "x double")
    for r in df.select("x", risk.normal_cdf(F.col("x")).alias("p"), risk.erf(F.col("x")).alias("e")).collect():
        assert r.p == pytest.approx(NormalDist().cdf(r.x), abs=1e-14) and r.e == pytest.approx(math.erf(r.x), abs=1e-14)


def test_statistics(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(risk.probabilistic_sharpe(*lit(2, 1.0, 0.0, 3.0))) == 0.5
    z = (0.1 - 0.02) * math.sqrt(999) / math.sqrt(1 + 0.3 * 0.1 + (4 - 1) / 4 * 0.01)
    assert one(risk.probabilistic_sharpe(*lit(1000, 0.1, -0.3, 4.0), benchmark=0.02)) == pytest.approx(NormalDist().cdf(z), abs=1e-12)
    assert one(risk.min_track_record(*lit(0.0, 0.0, 3.0))) == math.inf
    assert one(risk.deflated_sharpe(*lit(1000, 0.1, 0.0, 3.0), 50)) < one(risk.deflated_sharpe(*lit(1000, 0.1, 0.0, 3.0), 2))


@pytest.mark.parametrize(("n", "x"), [(0, 0), (250, 0), (250, 12), (250, 40), (20, 20)])
def test_kupiec(spark, n, x):
    p, rate = 0.05, x / n if n else 0.0
    log = lambda a, b: a * math.log(b) if a else 0.0
    want = max(0.0, -2 * (log(n - x, 1 - p) + log(x, p) - log(n - x, 1 - rate) - log(x, rate))) if n else 0.0
    lr = risk.kupiec(F.lit(float(n)), F.lit(float(x)), p)
    got = spark.range(1).select(lr.alias("lr"), risk.kupiec_p(lr).alias("p")).first()
    assert got.lr == pytest.approx(want, abs=1e-9) and got.p == pytest.approx(math.erfc(math.sqrt(want / 2)), abs=1e-12)


def test_live_risk_and_book_vol(spark):
    x = numbers(120)
    eq = 1e6 * np.cumprod(1 + np.concatenate([[0.0], x]))
    cash = eq * np.where(np.arange(121) % 9 == 3, 0.97, 0.2)
    log = spark.createDataFrame([(D0 + timedelta(i), float(a), float(b)) for i, (a, b) in enumerate(zip(eq, cash, strict=True))], "trade_date date, equity double, cash double")
    r = risk.live_risk(log).first()
    limit = 1.645 * 0.135 / math.sqrt(252)
    assert (r.days, r.exceptions, r.vol) == (120, int((x < -limit).sum()), pytest.approx(x.std(ddof=1) * math.sqrt(252)))
    assert r.max_drawdown == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min()) and r.in_band == (0.10 <= r.vol <= 0.17)
    exposure = 1 - cash[1:] / eq[1:]
    book = (x / exposure)[exposure > 0.05]
    assert risk.trailing_book_vol(log).first().vol == pytest.approx(max(book[-21:].std(ddof=1), book[-63:].std(ddof=1)) * math.sqrt(252))
    assert risk.trailing_book_vol(log.limit(10)).first().vol is None and risk.live_risk(log.limit(10)).count() == 0


def returns_frame(spark, t=70, n=7, gaps=True, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.01, (t, n)) + rng.normal(0, 0.005, (t, 1))
    if gaps:
        x[rng.random((t, n)) < 0.3] = np.nan
    rows = [(k, D0 + timedelta(i), float(x[i, k])) for i in range(t) for k in range(n) if not np.isnan(x[i, k])]
    return x, spark.createDataFrame(rows, "symbol long, trade_date date, ret double")


@pytest.mark.parametrize("block", [128, 3])
def test_covariances_equal_the_matrix_forms(spark, monkeypatch, block):
    monkeypatch.setattr(portfolio, "NAMES_A_BLOCK", block)
    x, df = returns_frame(spark)
    filled = np.where(np.isnan(x), np.nanmean(x, 0), x)
    d = filled - filled.mean(0)
    w = 0.94 ** np.arange(len(x) - 1, -1, -1)
    ewma = (d * (w / w.sum())[:, None]).T @ d
    wanted = {"ewma": ewma, "shrunk": portfolio.shrunk_covariance(x)}
    for name, got in (("ewma", portfolio.ewma_moments(df)), ("shrunk", portfolio.ledoit_wolf(df))):
        found = {(r.a, r.b): r["cov"] for r in got.collect()}
        assert found == {(i, j): pytest.approx(wanted[name][i, j], abs=1e-15) for i in range(7) for j in range(i, 7)}
    pairs = {(r.a, r.b): (r.n, r["cov"]) for r in portfolio.pair_moments(df).collect()}
    for (i, j), (n, c) in pairs.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert n == both.sum() and c == pytest.approx(np.cov(x[both, i], x[both, j], bias=True)[0, 1], abs=1e-15)


def slow_shrunk(x):
    """Ledoit-Wolf by its definition, one day's outer product at a time."""
    x = np.where(np.isnan(x), np.nanmean(x, 0), x)
    x = x - x.mean(0)
    s = x.T @ x / len(x)
    target = np.trace(s) / len(s) * np.eye(len(s))
    d2 = ((s - target) ** 2).sum()
    if d2 <= 0:
        return s
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / len(x) ** 2, d2)
    return b2 / d2 * target + (1 - b2 / d2) * s


def test_shrinkage_equals_its_definition(spark):
    x, _ = returns_frame(spark)
    assert np.allclose(portfolio.shrunk_covariance(x), slow_shrunk(x), atol=1e-16)


def test_construction_equals_a_loop_over_dates(spark):
    """Base weights, caps, volatility target and trading rules of every scheme against one book after another."""
    x, df = returns_frame(spark, 90, 6, seed=4)
    days = [D0 + timedelta(i) for i in (30, 50, 70, 89)]
    picks = [(d, s, 1e7 * (s + 1), "a" if s < 4 else None) for k, d in enumerate(days) for s in range(6) if (s + k) % 6]
    cal = df.select("trade_date").distinct().withColumn("idx", F.datediff("trade_date", F.lit(D0)).cast("long"))
    p = spark.createDataFrame(picks, "rebalance_date date, symbol long, adv double, industry string")
    rows = portfolio.risk_windows(df, p, cal, window=60, min_obs=25)
    realised = spark.createDataFrame([(d, v) for d, v in zip(days, (None, 0.1, 0.3, 0.27), strict=True)], "trade_date date, vol double")
    configs = [portfolio.Config(position_cap=0.22, sector_cap=0.5), portfolio.Config(scheme="ivol", tau=0.5, position_cap=0.22, sector_cap=0.5), portfolio.Config(scheme="minvar", tau=0.25, capital=5e6, position_cap=0.22, sector_cap=0.5)]
    got = {(r.config, r.rebalance_date, r.symbol): r.weight for r in portfolio.construct(rows, configs, realised).collect()}
    want = {}
    for c in configs:
        book = {}
        for d, vol in zip(days, (None, 0.1, 0.3, 0.27), strict=True):
            i = (d - D0).days
            own = [(s, a, ind) for day, s, a, ind in picks if day == d]
            hist = {s: x[max(0, i - 59) : i + 1, s] for s, _, _ in own}
            covered = [s for s, _, _ in own if (~np.isnan(hist[s])).sum() >= 25]
            w = {s: 1 / len(own) for s, _, _ in own}
            if c.scheme == "ivol" and covered:
                inv = {s: 1 / np.nanstd(hist[s], ddof=1) for s in covered}
                w |= {s: v / sum(inv.values()) * len(covered) / len(own) for s, v in inv.items()}
            if c.scheme == "minvar" and covered:
                m = np.array([hist[s] for s in covered]).T
                solved = portfolio.min_variance(slow_shrunk(m[~np.isnan(m).all(1)]))
                w |= {s: v * len(covered) / len(own) for s, v in zip(covered, solved, strict=True)}
            cap = max(c.position_cap, 1 / len(own))
            for _ in range(4):
                excess, room = sum(max(v - cap, 0) for v in w.values()), {s: max(cap - v, 0) for s, v in w.items()}
                total = sum(room.values())
                w = {s: min(v, cap) + (min(excess, total) * room[s] / total if total else 0) for s, v in w.items()}
            in_sector = sum(w[s] for s, _, ind in own if ind == "a")
            w = {s: w[s] * (min(1, c.sector_cap / in_sector) if ind == "a" else 1) * (min(1, c.target_vol / vol) if vol else 1) for s, _, ind in own}
            new = {}
            for s in w.keys() | book.keys():
                to, was = w.get(s, 0.0), book.get(s, 0.0)
                if c.tau < 1:
                    to = 0.0 if to <= 1e-12 and was < c.full_exit else was + c.tau * (to - was)
                elif to > 0 and abs(to - was) < c.band * to:
                    to = was
                most = c.adv_limit * 1e7 * (s + 1) / c.capital
                to = was + max(-most, min(most, to - was))
                if to > 1e-12:
                    new[s] = to
            total = sum(new.values())
            book = {s: v / max(1.0, total) for s, v in new.items()}
            want |= {(f"{c.scheme}_tau{c.tau:g}", d, s): v for s, v in book.items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def design(spark, days=80, names=12, seed=9):
    rng = np.random.default_rng(seed)
    rows = [(s, D0 + timedelta(i), i, *map(float, rng.normal(size=3)), float(rng.normal())) for i in range(days) for s in range(names)]
    return rows, spark.createDataFrame(rows, "symbol long, trade_date date, idx long, a double, b double, c double, label double")


def ridge(rows, at, features, penalty=1.0):
    x, y = np.array([[r[3 + f] for f in features] for r in rows if r[2] in at]), np.array([r[6] for r in rows if r[2] in at])
    m = x.mean(0)
    w = np.linalg.solve((x - m).T @ (x - m) + penalty * np.eye(len(features)), (x - m).T @ (y - y.mean()))
    return lambda r: y.mean() + (np.array([r[3 + f] for f in features]) - m) @ w


def test_ridge_walk_forward_equals_solving_each_fold(spark):
    rows, df = design(spark)
    cal = spark.range(80).select(F.col("id").alias("idx"))
    folds = validation.walk_forward(cal, test=20, min_train=30, horizon=2, embargo=3)
    got = {(r.symbol, r.trade_date): (r.fold, r.pred) for r in validation.ridge_walk_forward(df, cal, folds, ["a", "b", "c"]).collect()}
    want = {}
    for f in folds.collect():
        model = ridge(rows, set(range(f.train_end + 1)), [0, 1, 2])
        want |= {(r[0], r[1]): (f.fold, pytest.approx(model(r), abs=1e-10)) for r in rows if f.test_start <= r[2] <= f.test_end}
    assert got == want and got


def spearman(a, b):
    rank = lambda v: np.array([(np.array(v) < x).sum() + ((np.array(v) == x).sum() + 1) / 2 for x in v])
    return np.corrcoef(rank(a), rank(b))[0, 1]


def test_cpcv_sweep_equals_solving_each_split(spark):
    rows, df = design(spark, 40, 8)
    cal = spark.range(40).select(F.col("id").alias("idx"))
    got = {(r.combo, r.config): (r.is_score, r.oos_score) for r in validation.cpcv_sweep(df, cal, {"ab": ["a", "b"], "c": ["c"]}, blocks=4, pick=2, gap=2, min_names=5).collect()}
    assert len(got) == 12
    for n, blocks in enumerate(combinations(range(4), 2)):
        out = {i for b in blocks for i in range(b * 10, b * 10 + 10)}
        near = {i for b in blocks for i in range(b * 10 - 2, b * 10 + 12)}
        inside = set(range(40)) - near
        for name, features in (("ab", [0, 1]), ("c", [2])):
            model = ridge(rows, inside, features)
            ic = lambda at: np.mean([spearman([model(r) for r in rows if r[2] == i], [r[6] for r in rows if r[2] == i]) for i in at])  # noqa: B023, E731
            assert got[n, name] == pytest.approx((ic(inside), ic(out)), abs=1e-10)


def test_increment_is_over_the_first_set(spark):
    _, df = design(spark)
    cal = spark.range(80).select(F.col("id").alias("idx"))
    folds = validation.walk_forward(cal, test=20, min_train=30, horizon=2, embargo=3)
    got = {r.config: r for r in validation.increment(df, cal, folds, {"A": ["a"], "B": ["a", "b"], "C": ["b"]}, against=("a",), min_names=5).collect()}
    assert got["A"].delta_ic == 0 and got["B"].delta_ic == pytest.approx(got["B"].mean_ic - got["A"].mean_ic) and abs(got["A"].with_a) == pytest.approx(1.0)


@pytest.mark.parametrize("window", [None, 60])
def test_lag_walk_forward_equals_solving_each_retrain(spark, window):
    rng = np.random.default_rng(3)
    series_ = {s: rng.normal(0, 0.01, n) for s, n in ((1, 150), (2, 130), (3, 20))}
    df = spark.createDataFrame([(s, D0 + timedelta(i), float(v)) for s, x in series_.items() for i, v in enumerate(x)], "symbol long, trade_date date, ret double")
    got = {(r.symbol, r.idx): r.pred for r in validation.lag_walk_forward(df, lags=3, burn_in=60, every=20, embargo=1, window=window, least=30).collect()}
    want = {}
    for s, x in series_.items():
        for t in range(60, len(x)):
            k = (t - 60) // 20
            start = 60 + 20 * k
            first = 2 if window is None else max(2, 60 + 20 * (k - window // 20) - 1)
            some = range(first, start - 1)
            if len(some) < 30:
                continue
            f, y = np.array([[x[i - j] for j in range(3)] for i in some]), np.array([x[i + 1] for i in some])
            m = f.mean(0)
            w = np.linalg.solve((f - m).T @ (f - m) + np.eye(3), (f - m).T @ (y - y.mean()))
            want[s, t] = pytest.approx(y.mean() + (np.array([x[t - j] for j in range(3)]) - m) @ w, abs=1e-12)
    assert got == want and want


def test_spa_bootstrap_equals_one_loop(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = {"good": rng.normal(0.002, 0.01, 90), "bad": rng.normal(-0.001, 0.01, 90)}
    df = spark.createDataFrame([(c, D0 + timedelta(i), float(v)) for c, x in data.items() for i, v in enumerate(x)], "config string, trade_date date, d double")
    got = validation.spa_bootstrap(df, draws=250, mean_block=10).first()
    n, rc, spa, seen_rc, seen_spa = 90, [], [], [], []
    for x in data.values():
        m = np.empty(250)
        for b in range(250):
            r = np.random.default_rng([7, b])
            jump = r.random(n) < 0.1
            jump[0] = True
            starts, at = r.integers(0, n, n), 0
            total = 0.0
            for i in range(n):
                at = starts[i] if jump[i] else at + 1
                total += x[at % n]
            m[b] = total / n
        sd = np.sqrt(n) * m.std()
        keep = x.mean() if np.sqrt(n) * x.mean() / sd >= -np.sqrt(2 * np.log(np.log(n))) else 0.0
        rc.append(np.sqrt(n) * (m - x.mean()))
        spa.append(np.sqrt(n) * (m - keep) / sd)
        seen_rc.append(np.sqrt(n) * x.mean())
        seen_spa.append(np.sqrt(n) * x.mean() / sd)
    assert got.rc_p == pytest.approx((np.max(rc, 0) >= max(seen_rc)).mean()) and got.spa_p == pytest.approx((np.maximum(np.max(spa, 0), 0) >= max(*seen_spa, 0)).mean())


def test_car_bootstrap_is_near_the_normal_p_value(spark):
    rng = np.random.default_rng(6)
    rows = [(c, "[0,1]", i, D0, float(v)) for c, m in (("a", 0.0), ("b", 0.004)) for i, v in enumerate(rng.normal(m, 0.02, 300))]
    df = spark.createDataFrame(rows, "category string, window string, symbol long, knowable_date date, car double")
    from tidemark.operators import events

    for r in events.car_bootstrap(df, n_boot=1000).collect():
        x = np.array([v for c, _, _, _, v in rows if c == r.category])
        z = x.mean() / (x.std() / math.sqrt(300))
        assert r.mean_car == pytest.approx(x.mean()) and r.p_value == pytest.approx(2 * NormalDist().cdf(-abs(z)), abs=0.05)


def test_runs_of_other_lengths_are_learned_side_by_side_as_alone(spark, monkeypatch):
    monkeypatch.setattr(engine, "RUNS", 3)
    rng = np.random.default_rng(4)
    rows = [(run, step, 1.0, *rng.normal(0, 0.05, 3).tolist()) for run, n in enumerate((5, 40, 1, 17, 40, 2, 9)) for step in range(1, n + 1)]
    make = lambda some: spark.createDataFrame(some, "run long, step long, bias double, before double, x double, y double").coalesce(1)
    whole = sorted(map(tuple, engine.linucb(make(rows[::-1]), ["x", "y"], ["bias", "before"]).collect()))
    assert [r[:2] for r in whole] == [r[:2] for r in rows]
    for run in (1, 3):
        assert sorted(map(tuple, engine.linucb(make([r for r in rows if r[0] == run]), ["x", "y"], ["bias", "before"]).collect())) == [r for r in whole if r[0] == run]


def test_policies(spark):
    rewards = [(run, step, 1.0, float(step % 2), 0.1 * step, -0.05 * step, 0.02) for run in (1, 2) for step in range(1, 30)]
    df = spark.createDataFrame(rewards, "run long, step long, bias double, before double, x double, y double, z double")
    assert [(r.arm, r.reward) for r in engine.fixed_policy(df.where("run = 1 and step = 3"), "z").collect()] == [("z", 0.02)]
    got = {(r.run, r.step): (r.arm, r.reward) for r in engine.linucb(df, ["x", "y", "z"], ["bias", "before"]).collect()}
    for run in (1, 2):
        a, b = {m: np.eye(2) for m in "xyz"}, {m: np.zeros(2) for m in "xyz"}
        for _, step, bias, before, *r in [x for x in rewards if x[0] == run]:
            ctx, reward = np.array([bias, before]), dict(zip("xyz", r, strict=True))
            score = {m: np.linalg.inv(a[m]) @ b[m] @ ctx + 0.3 * math.sqrt(ctx @ np.linalg.inv(a[m]) @ ctx) for m in "xyz"}
            arm = max("xyz", key=lambda m: score[m])  # noqa: B023
            assert got[run, step] == (arm, pytest.approx(reward[arm]))
            a[arm] += np.outer(ctx, ctx)
            b[arm] += reward[arm] * ctx
    daily = spark.createDataFrame([(1, arm, D0 + timedelta(i), v * i) for i in range(6) for arm, v in (("x", 1.0), ("y", 10.0))], "run long, arm string, trade_date date, r double")
    decided = spark.createDataFrame([(1, D0 + timedelta(1), "x"), (1, D0 + timedelta(3), "y")], "run long, decided_on date, arm string")
    assert [r.r for r in engine.policy_returns(decided, daily).orderBy("trade_date").collect()] == [0, 0, 2, 3, 40, 50]


def test_thompson_draws_by_arm(spark):
    df = spark.createDataFrame([("a", 100, 0.5, 0.01), ("b", 100, -0.5, 0.01), ("c", 1, 0.0, None)], "arm string, n long, mean double, var double")
    got = {r.arm: r for r in engine.thompson(df).collect()}
    assert got["a"].draw == pytest.approx(0.5, abs=0.06) and got["b"].draw == pytest.approx(-0.5, abs=0.06) and sum(r.picked for r in got.values()) == 1
    assert max(got.values(), key=lambda r: r.draw).picked


def test_hedge_gate(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(0, 0.01, 300)
    r = 0.4 * m + rng.normal(0, 0.001, 300)
    index = spark.createDataFrame([(D0 + timedelta(i), float(v)) for i, v in enumerate(m)], "trade_date date, m double")
    row = lambda x: spark.createDataFrame([(D0 + timedelta(i), float(v), 0.0001) for i, v in enumerate(x)], "trade_date date, r double, cost double")
    open_, closed = risk.hedge_gate(row(r), index).first(), risk.hedge_gate(row(r - 0.4 * m), index).first()
    assert open_.residual_beta == pytest.approx(0.4, abs=0.02) and not open_.passes and closed.passes and closed.cost_drag == pytest.approx(0.0252)


def test_price_benchmark(spark):
    rows = [("OLD", D0, 90.0), ("OLD", D0 + timedelta(1), 100.0), ("NEW", D0 + timedelta(1), 101.0), ("NEW", D0 + timedelta(2), 111.1), ("OTHER", D0, 5.0)]
    i = spark.createDataFrame(rows, "index_name string, trade_date date, close double")
    got = backtest.benchmark_returns(i, ["NEW", "OLD"], D0)
    assert [r.net_return for r in got.orderBy("trade_date").collect()] == pytest.approx([101 / 90 - 1, 0.1])
    assert [r.net_return for r in backtest.benchmark_returns(i, ["NEW", "OLD"], D0 + timedelta(1)).collect()] == pytest.approx([0.1])
    assert backtest.summarise(got).first().days == 2


def test_stateless_stages(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = lambda x: F.lit(x).cast("double")
    assert one(portfolio.vol_target(lit(0.1), lit(0.27), 0.135)) == pytest.approx(0.05) and one(portfolio.vol_target(lit(0.1), lit(0.05), 0.135)) == 0.1 and one(portfolio.vol_target(lit(0.1), lit(None), 0.135)) == 0.1
    cap = lambda t, p, a: one(portfolio.participation_cap(lit(t), lit(p), lit(a), limit=0.02, capital=1e6))
    assert cap(0.5, 0.0, 1e7) == pytest.approx(0.2) and cap(0.0, 0.5, 1e7) == pytest.approx(0.3) and cap(0.5, 0.0, None) == 0.5 and cap(0.01, 0.0, 1e7) == 0.01
    orders = spark.createDataFrame([("a", "ok", "buy"), ("b", "over_cap", "buy"), ("c", "ok", "sell")], "client_order_id string, verdict string, side string")
    sent = orders.where("client_order_id = 'a'")
    assert [r.client_order_id for r in risk.to_send(orders, sent).collect()] == ["c"]
    assert [r.client_order_id for r in risk.to_send(orders, sent.limit(0), killed=True).collect()] == ["c"]


def test_covariances_read_the_names_returns_written(spark):
    """The returns of the universe's names are a written table, which no step makes anew from the trades."""
    from tidemark.plans.kernels import book_names

    assert "lineitem" not in book_names(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
