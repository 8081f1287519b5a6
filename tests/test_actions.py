import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import actions


def panel(spark, closes, opens=None, start=date(2024, 1, 1)):
    rows = [("A", start + timedelta(i), float((opens or closes)[i]), float(c), float(c), float(c), 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume double")


def events(spark, *rows):
    return spark.createDataFrame(list(rows), "symbol string, ex_date date, factor double")


def declared(spark, *rows):
    return spark.createDataFrame(list(rows), "symbol string, ex_date date, subject string")


def adjusted(spark, p, *e):
    """e: (symbol, ex_date, subject)."""
    return [(r.cum_adj_factor, r.adj_close, r.adj_volume) for r in actions.adjust(p, declared(spark, *e)).orderBy("trade_date").collect()]


def test_backward_adjustment(spark):
    got = adjusted(spark, panel(spark, [100, 102, 52, 53]), ("A", date(2024, 1, 3), "Bonus 1:1"))
    assert [g[0] for g in got] == [0.5, 0.5, 1.0, 1.0]
    assert [g[1] for g in got] == [50, 51, 52, 53]
    assert [g[2] for g in got] == [200, 200, 100, 100]


def test_events_compound(spark):
    got = adjusted(spark, panel(spark, [100, 50, 25]), ("A", date(2024, 1, 2), "Bonus 1:1"), ("A", date(2024, 1, 3), "Split From Rs 10 To Rs 5"))
    assert [g[0] for g in got] == [0.25, 0.5, 1.0]


def test_gate_rejects_what_the_price_contradicts(spark):
    p = panel(spark, [100, 101, 100])
    assert [g[0] for g in adjusted(spark, p, ("A", date(2024, 1, 2), "Bonus 1:1"))] == [1, 1, 1]
    crash = panel(spark, [100, 26, 26])
    assert adjusted(spark, crash, ("A", date(2024, 1, 2), "Split From Rs 10 To Rs 2"))[0][0] == pytest.approx(0.2)


def test_ex_date_on_a_holiday_snaps_forward_and_late_ones_drop(spark):
    p = panel(spark, [100, 50]).unionByName(panel(spark, [51], start=date(2024, 1, 5)))
    s = actions.snap(p, events(spark, ("A", date(2024, 1, 3), 0.9), ("A", date(2024, 2, 1), 0.5))).collect()
    assert [(r.trade_date, r.factor) for r in s] == [(date(2024, 1, 5), 0.9)]


def test_gap_factor(spark):
    p = panel(spark, [100, 96], opens=[100, 96.5])
    gaps = spark.createDataFrame([("A", date(2024, 1, 2))], "symbol string, ex_date date")
    assert [r.factor for r in actions.gap_factors(p, gaps).collect()] == [0.965]
    up = panel(spark, [100, 101], opens=[100, 101])
    assert actions.gap_factors(up, gaps).count() == 0


@pytest.mark.parametrize(("subject", "factor"), [("Bonus 1:1", 0.5), ("Bonus issue 2:3", 0.6), ("Face Value Split From Rs 10/- To Rs 2/-", 0.2), ("Bonus 1:1 And Split From Rs 10 To Rs 5", 0.25), ("Fv Split Rs.10 To Re.1", 0.1), ("Bonus-1:2", 2 / 3), ("Split From Rs 2 To Rs 10", None), ("Bonus 0:1", None), ("Bonus 1:1 And Split From Rs 2 To Rs 4", 0.5), ("Interim Dividend - Rs 12 Per Share", None), (None, None)])
def test_declared_factor(spark, subject, factor):
    got = spark.createDataFrame([(subject,)], "s string").select(actions.expected_factor(F.col("s"))).first()[0]
    assert got == (pytest.approx(factor) if factor else None)


def test_gap_subjects(spark):
    rows = [("Demerger", True), ("Rights 1:5", True), ("capital reduction", True), ("Scheme of Arrangement", True), ("scheme of amalgamation", False), ("copyrights", False), (None, False)]
    df = spark.createDataFrame([(s,) for s, _ in rows], "s string").select("s", actions.is_gap(F.col("s")).alias("g"))
    assert {r.s: r.g for r in df.collect()} == dict(rows)


def test_one_window_equals_the_separate_steps(spark):
    """with_declared against parsing, gaps, combining and snapping one after another, on random bars and actions."""
    rnd = random.Random(3)
    days = [date(2024, 1, 1) + timedelta(i) for i in range(60) if rnd.random() < 0.7]
    bars = [(s, d, px * rnd.choice([0.8, 0.97, 1.02]), px, px, px * rnd.choice([0.5, 1.0, 1.1]), 10.0) for s in "ABC" for d in days if rnd.random() < 0.8 for px in [rnd.uniform(50, 150)]]
    p = spark.createDataFrame(bars, "symbol string, trade_date date, open double, high double, low double, close double, volume double")
    kinds = ["Bonus 1:1", "Split From Rs 10 To Rs 9", "Rights 1:5", "Demerger", "Interim Dividend", "Demerger and bonus 1:3", None]
    rows = [(s, date(2023, 12, 28) + timedelta(rnd.randint(0, 70)), rnd.choice(kinds)) for s in "ABCD" for _ in range(40)]
    d = declared(spark, *rows, *rows[:9])
    e = actions.combine(actions.factor_product(actions.declared_factors(d)), actions.gap_factors(p, actions.declared_gaps(d)))
    want = {(r.symbol, r.trade_date): (pytest.approx(r.factor), r.rejected) for r in actions.gate(p, actions.snap(p, e)).collect()}
    got = {(r.symbol, r.trade_date): (r.factor, r.rejected) for r in actions._gated(actions.with_declared(p, d)).where("factor is not null").collect()}
    assert got == want and len(want) > 40


def test_renames_chain_and_reused_tickers_stay(spark):
    rename = [("OLD", "MID", date(2020, 1, 1)), ("MID", "NEW", date(2021, 1, 1))]
    rows = spark.createDataFrame([("OLD", date(2019, 5, 1)), ("MID", date(2020, 5, 1)), ("OLD", date(2022, 5, 1)), ("NEW", date(2022, 5, 1))], "symbol string, trade_date date")
    got = [r.canon_symbol for r in actions.canonicalise(rows, rename).orderBy("trade_date", "symbol").collect()]
    assert got == ["NEW", "NEW", "NEW", "OLD"]


def test_renames_that_do_not_settle_raise():
    backwards = [(f"N{i}", f"N{i + 1}", date(2024, 1, 20 - i)) for i in range(9)]
    with pytest.raises(ValueError, match="do not settle"):
        actions.rename_intervals(backwards)


def test_series_priority(spark):
    rows = spark.createDataFrame([("A", date(2024, 1, 1), "BE", 1.0), ("A", date(2024, 1, 1), "EQ", 2.0), ("B", date(2024, 1, 1), "GS", 3.0)], "symbol string, trade_date date, series string, close double")
    assert [(r.symbol, r.series) for r in actions.equity_panel(rows).collect()] == [("A", "EQ")]


def test_front_month_return_is_of_one_contract(spark):
    rows = [(date(2024, 1, 30), date(2024, 1, 31), 100.0), (date(2024, 1, 30), date(2024, 2, 29), 107.0), (date(2024, 1, 31), date(2024, 1, 31), 101.0), (date(2024, 1, 31), date(2024, 2, 29), 108.07), (date(2024, 2, 1), date(2024, 2, 29), 109.1507)]
    f = spark.createDataFrame(rows, "trade_date date, expiry date, settle double")
    got = [r.ret for r in actions.front_month(f).orderBy("trade_date").collect()]
    assert got[0] is None and got[1:] == [pytest.approx(0.01), pytest.approx(0.01)]


def test_adjusted_panel_deals_bars_once_and_has_no_frame_to_the_end(spark):
    """Bars cross one exchange, a union with actions a second; products run over growing frames, not over one made anew for each row."""
    from tidemark.plans.actions import adjusted_panel
    from tidemark.sources import views

    sf = "/root/testdata/sf0.001"
    assert "rowframe, 1, unboundedfollowing" not in adjusted_panel(spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
    returns = views.returns(views.bars(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert returns.count("Exchange") == 1 and returns.count("Sort [") == 1
