"""Books with memory against one loop over days and names."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.expr import cost_rate
from tidemark.operators import books, portfolio

D0 = date(2020, 1, 1)


def market(spark, days=150, names=7, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.02, (days, names))
    x[rng.random(x.shape) < 0.05] = np.nan
    panel = spark.createDataFrame([(s, D0 + timedelta(i), None if np.isnan(x[i, s]) else float(x[i, s])) for i in range(days) for s in range(names)], "symbol long, trade_date date, ret double")
    cal = spark.createDataFrame([(i, D0 + timedelta(i)) for i in range(days)], "idx long, trade_date date")
    dates = list(range(20, days - 1, 6))
    picks = [(D0 + timedelta(i), s, None if s == 5 and k < 3 else 2e5 * (1 + s), "a" if s < 3 else "b" if s < 5 else None) for k, i in enumerate(dates) for s in range(names) if (s * 5 + k) % 7 > 1]
    p = spark.createDataFrame(picks, "rebalance_date date, symbol long, adv double, industry string")
    rows = portfolio.risk_windows(panel, p, cal, window=60, min_obs=25)
    return x, panel, cal, picks, rows


def plain(x, picks, weights, c, lag=1):
    """(gross, cost, turnover) by day."""
    book, adv, pending, invested, out = {}, {}, None, [], []
    for i in range(len(x)):
        gross = cost = turnover = 0.0
        if book:
            r = {s: 0.0 if np.isnan(x[i, s]) else x[i, s] for s in book}
            gross, exposure = sum(book[s] * r[s] for s in book), sum(book.values())
            invested.append(gross / exposure if exposure > 1e-9 else 0.0)
            book = {s: book[s] * (1 + r[s]) / (1 + gross) for s in book}
        if pending and pending[0] == i:
            for s in set(book) | set(pending[1]):
                d = pending[1].get(s, 0) - book.get(s, 0)
                if abs(d) < 1e-12:
                    continue
                order = abs(d) * c.capital
                rate = 0.001 + (3.07e-5 + 1e-6) * 1.18 + (1.5e-4 if d > 0 else 15.34 / order)
                if adv.get(s):
                    rate += (3 + 10 * math.sqrt(order / adv[s])) / 1e4
                cost += abs(d) * rate
                turnover += abs(d) / 2
            book, pending = pending[1], None
        today = [(s, a) for d, s, a, _ in picks if d == D0 + timedelta(i)]
        if today:
            adv |= {s: a for s, a in today if a is not None}
            vol = None
            if len(invested) >= 21:
                vol = np.std(invested[-21:], ddof=1) * math.sqrt(252)
                if len(invested) >= 63:
                    vol = max(vol, np.std(invested[-63:], ddof=1) * math.sqrt(252))
            scale = min(1, c.target_vol / vol) if vol else 1
            new = {}
            for s in {s for s, _ in today} | set(book):
                to, was = weights.get((D0 + timedelta(i), s), 0.0) * scale, book.get(s, 0.0)
                if c.tau < 1:
                    v = 0 if to <= 1e-12 and was < 0.005 else was + c.tau * (to - was)
                else:
                    v = was if to > 0 and abs(to - was) < 0.25 * to else to
                if s in adv:
                    most = 0.02 * adv[s] / c.capital
                    v = min(max(v, was - most), was + most)
                if v > 1e-12:
                    new[s] = v
            total = sum(new.values())
            pending = (i + lag, {s: v / total for s, v in new.items()} if total > 1 + 1e-12 else new)
        out.append((gross, cost, turnover))
    return out


def test_eight_configurations_equal_the_loop(spark):
    x, panel, cal, picks, rows = market(spark)
    configs = books.study(capital=6e4, position_cap=0.3, sector_cap=0.5, target_vol=0.12)
    names = [portfolio.config_name(c) for c in configs]
    base = {}
    for r in portfolio.base_weights(rows, configs, names).collect():
        base.setdefault(r.config, {})[r.rebalance_date, r.symbol] = r.weight
    got = {}
    for r in books.run_books(panel, rows, cal, configs).orderBy("config", "idx").collect():
        got.setdefault(r.config, []).append((r.gross_return, r.cost, r.turnover))
        assert r.net_return == pytest.approx(r.gross_return - r.cost)
    assert got.keys() == set(names) and len(names) == 8
    for c, n in zip(configs, names, strict=True):
        want = plain(x, picks, base[n], c)
        assert np.allclose(got[n], want, atol=1e-12), n
        assert sum(t for _, _, t in want) > 0.5


def test_a_later_day_resumes_from_the_state(spark):
    """Up to a rebalance, then from its state on with later rows only: the same days as in one go, and the same states."""
    _, panel, cal, _, rows = market(spark, 110, 5, 8)
    configs = books.study(capital=6e4)[:6:5]
    whole = books.run_books(panel, rows, cal, configs)
    row = lambda r: (r.config, r.idx, round(r.net_return, 12), round(r.turnover, 12), r.state)
    want = sorted(map(row, whole.collect()), key=lambda r: r[:2])
    cut = 60
    until = D0 + timedelta(cut)
    first = books.run_books(panel.where(F.col("trade_date") <= F.lit(until)), rows.where(F.col("rebalance_date") <= F.lit(until)), cal.where(f"idx <= {cut}"), configs)
    kept = books.last_states(first).collect()
    states = spark.createDataFrame([tuple(r) for r in kept], "config string, idx long, state string")
    at = {r.idx for r in kept}
    rest = books.run_books(panel, rows, cal, configs, states=states)
    got = sorted(map(row, rest.collect()), key=lambda r: r[:2])
    assert len(at) == 1 and got == [r for r in want if r[1] > min(at)]


def test_costs_are_the_columns(spark):
    for buy in (True, False):
        for order, adv in ((5e4, 1e6), (5e4, None), (0.0, 1e6)):
            for m in ("delivery", "overseas"):
                o = F.lit(order)
                (v,) = spark.range(1).select(cost_rate("buy" if buy else "sell", o, F.lit(adv).cast("double"), market=m, dp_order_value=o)).first()
                assert books.cost_fraction(buy, order, adv, market=m) == pytest.approx(v, abs=1e-15)


def test_nothing_picked_and_nothing_traded(spark):
    _, panel, cal, _, rows = market(spark, 60, 3)
    c = [portfolio.Config()]
    none = books.run_books(panel, rows.limit(0), cal, c).collect()
    assert len(none) == 60 and all(r.net_return == 0 and r.state is None for r in none)
    assert books.run_books(panel.limit(0), rows.limit(0), cal.limit(0), c).count() == 0
