from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dsl
from tidemark.functions.temporal import asof_backward, asof_forward, knowable_dates, sessions, weekly_grid
from tidemark.operators import features, universe
from tidemark.sources import views

D0 = date(2020, 1, 1)


def walk(spark, names=3, days=300):
    rows = [(s, D0 + timedelta(i), 100.0 + s * 3 + ((i * (7 + s)) % 23) + i * 0.1, 1e4 * s + i) for s in range(1, names + 1) for i in range(days)]
    p = spark.createDataFrame(rows, "symbol long, trade_date date, close double, traded_value double")
    return views.returns(p.withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1, "open": F.col("close")}))


def test_momentum_and_reversal(spark):
    p = walk(spark, 1)
    px = [r.close for r in p.orderBy("trade_date").collect()]
    got = features.score(p, features.momentum_12_1()).orderBy("trade_date").collect()
    assert len(got) == 300 - 252 and got[0].score == pytest.approx(px[231] / px[0] - 1)
    assert features.score(p, features.reversal_5d()).orderBy("trade_date").first().score == pytest.approx(-(px[5] / px[0] - 1))


def test_library_has_19_centred_features(spark):
    f = features.build_features(walk(spark, 5))
    assert len(f.columns) == 21 and f.count() == 5 * 48
    assert abs(f.groupBy("trade_date").agg(F.avg("vol_21d").alias("m")).agg(F.max(F.abs("m"))).first()[0]) < 1e-9


def test_the_future_cannot_change_the_past(spark):
    """Every feature, universe and compiled expression of a row is the same when later rows are cut off."""
    cut = D0 + timedelta(270)
    p = walk(spark)
    build = lambda x: universe.pit_universe(x, min_traded_value=1.0, min_price=1.0, top_n=2).withColumns(features.library() | {"dsl_" + k: dsl.compile_expression(v) for k, v in dsl.SEEDS.items()})
    whole = build(p).where(F.col("trade_date") <= F.lit(cut)).orderBy("symbol", "trade_date").collect()
    part = build(p.where(F.col("trade_date") <= F.lit(cut))).orderBy("symbol", "trade_date").collect()
    assert whole == part


def test_labels_do_look_ahead(spark):
    p = walk(spark)
    assert features.forward_return_z(p, 5).agg(F.max("trade_date")).first()[0] == D0 + timedelta(294)


def test_registry_matches_library():
    assert [f.name for f in features.REGISTRY if f.lookback > 252 or f.knowable_at != "close"] == []
    assert {f.name: f.lookback for f in features.REGISTRY}["vol_63d"] == 63


def test_universe_ranks_only_eligible_names(spark):
    rows = [(s, D0 + timedelta(i), px, tv) for i in range(8) for s, px, tv in (("BIG", 100.0, 9e8), ("MID", 100.0, 8e8), ("SMALL", 100.0, 7e8), ("THIN", 100.0, 1.0), ("PENNY", 1.0, 9e9))]
    p = spark.createDataFrame(rows, "symbol string, trade_date date, close double, traded_value double")
    u = universe.pit_universe(p, min_listed_days=3, liquidity_window=3, top_n=2)
    last = {r.symbol: (r.liquidity_rank, r.in_universe) for r in u.where(F.col("trade_date") == F.lit(D0 + timedelta(7))).collect()}
    assert last == {"BIG": (1, True), "MID": (2, True), "SMALL": (3, False), "THIN": (None, False), "PENNY": (None, False)}
    assert u.where("trade_date < date'2020-01-03' and in_universe").count() == 0


def test_equal_trades_in_another_order_make_equal_bars(spark, tmp_path):
    """Names with the same trades tie in the universe's ranks, whatever order their rows come in."""
    from tidemark.sources import views

    rows = [(k, 1, s, k, 1.0, p, D0) for s, prices in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1)), (3, (float("inf"), 1.0)), (4, (1e300, 1.0))) for k, p in enumerate(prices)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate date"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.symbol: r.traded_value for r in views.bars(spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == 0.6 and got[3] == float("inf") and got[4] == 1e300


def test_weekly_grid_with_holiday(spark):
    days = [date(2024, 1, d) for d in (1, 2, 4, 5, 8, 9, 10, 11, 12)]
    cal = sessions(spark.createDataFrame([(d,) for d in days], "trade_date date"))
    assert sorted(r[0] for r in weekly_grid(cal).collect()) == [date(2024, 1, 5), date(2024, 1, 12)]


def test_knowable_dates(spark):
    cal = sessions(spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 4, 5)], "trade_date date"))
    e = spark.sql("select * from values (1, timestamp_ntz'2024-01-01 09:00:00'), (2, timestamp_ntz'2024-01-01 15:30:00'), (3, timestamp_ntz'2024-01-02 16:00:00'), (4, timestamp_ntz'2024-01-03 10:00:00'), (5, timestamp_ntz'2024-01-05 16:00:00') as t(id, announced_at)")
    got = {r.id: r.knowable_date.day for r in knowable_dates(e, cal).collect()}
    assert got == {1: 1, 2: 2, 3: 4, 4: 4}  # 15:30 is after the close; beyond the calendar drops


def test_asof_both_ways(spark):
    left = spark.createDataFrame([("A", date(2024, 1, 5)), ("A", date(2024, 1, 1)), ("B", date(2024, 1, 5))], "symbol string, d date")
    right = spark.createDataFrame([("A", date(2024, 1, 2), 1), ("A", date(2024, 1, 5), 2), ("A", date(2024, 1, 9), 3)], "symbol string, at date, v int")
    back = {(r.symbol, r.d.day): r.v for r in asof_backward(left, right, ["symbol"], "d", "at", ["v"]).collect()}
    assert back == {("A", 5): 2, ("A", 1): None, ("B", 5): None}
    ahead = {(r.symbol, r.d.day): r.v for r in asof_forward(left, right, ["symbol"], "d", "at", ["v"]).collect()}
    assert ahead == {("A", 5): 2, ("A", 1): 1, ("B", 5): None}


@pytest.mark.parametrize("source", ["__import__('os')", "col('open')", "dret().x", "shift(dret(), 0)", "roll_mean(dret(), 253)", "roll_mean(dret(), 2.0)", "dret() if 1 else 2", "[1]", "col('close'", "roll_mean(e=1)", "True + 1"])
def test_sandbox_refuses(spark, source):
    with pytest.raises(dsl.SandboxError):
        dsl.compile_expression(source)


@pytest.mark.parametrize("values", [[3.0, 1.0, None, 2.0, 2.0, -5.0], [7.0, 7.0], [None], []])
def test_global_rank(spark, values):
    from tidemark.functions.ranking import global_rank

    df = spark.createDataFrame(list(enumerate(values)), "symbol int, x double")
    got = {r.symbol: r["rank"] for r in global_rank(df, "x", "symbol").collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0.0, i))
    nulls = [i for i in order if values[i] is None]
    assert [got[i] for i in [i for i in order if values[i] is not None] + nulls] == list(range(1, len(values) + 1))


#: Subjects as exchanges word them, with the category, direction and materiality of the first rule that they match.
SUBJECTS = [
    ("Raising of funds", "fundraising", 0, 1), ("Allotment of NCDs", "fundraising", 0, 1), ("Commercial Paper", "fundraising", 0, 1), ("Show cause notice", "litigation_regulatory", -1, 2), ("SEBI order", "litigation_regulatory", -1, 2),
    ("Investigation", "litigation_regulatory", -1, 2), ("Search and seizure", "litigation_regulatory", -1, 2), ("Change in KMP", "board_change", 0, 0), ("Key managerial personnel", "board_change", 0, 0), ("Order bagged", "order_win", 1, 1),
    ("Company acquires stake", "m_and_a", 0, 2), ("to acquire 51% stake", "m_and_a", 0, 2), ("Unaudited standalone result", "earnings_result", 0, 2), ("Rating upgraded", "rating_action", 0, 1), ("New facility", "capex_expansion", 1, 1),
    ("Disclosure under Substantial Acquisition of Shares", "other", 0, 0), ("GST order of demand", "litigation_regulatory", -1, 1), ("NCLT-convened meeting", "m_and_a", 0, 1), ("Company pledges to plant trees", "other", 0, 0),
    ("Creation of PLEDGE", "pledge", -1, 1), ("Interim dividend", "dividend_distribution", 1, 1), ("Weather is fine", "other", 0, 0), ("", "other", 0, 0), (None, "other", 0, 0),
]


def test_taxonomy_on_subjects(spark):
    from tidemark.operators import events

    df = spark.createDataFrame([(i, s) for i, (s, *_) in enumerate(SUBJECTS)], "i int, subject string")
    got = {r.i: (r.category, r.direction, r.materiality) for r in events.classify(df).collect()}
    assert got == {i: tuple(k) for i, (_, *k) in enumerate(SUBJECTS)}


def test_generated_subjects_reach_every_rule():
    import re

    from tidemark.operators import events

    first = {next((i for i, (p, *_) in enumerate(events.RULES) if re.search(p, s, re.I)), None) for s in views.SUBJECTS if s}
    assert set(range(len(events.RULES))) <= first and None in first


def test_sentiment_gate_needs_a_year_and_sees_the_past_only(spark):
    from tidemark.operators import events

    days = [D0 + timedelta(i) for i in range(400)]
    prices = spark.createDataFrame([(d, 0.01 * ((i * 7) % 5 - 2), 100.0 + i) for i, d in enumerate(days)], "trade_date date, ret double, level double")
    index = spark.createDataFrame([(d, float((i * 13) % 11 - 5), 1) for i, d in enumerate(days) if i % 3], "trade_date date, sentiment double, n long")
    got = events.sentiment_gate(prices, index).orderBy("trade_date").collect()
    s = [float((i * 13) % 11 - 5) if i % 3 else 0.0 for i in range(400)]
    mean = [sum(s[i - 4 : i + 1]) / 5 if i >= 4 else None for i in range(400)]
    assert [r.trade_date for r in got] == days[255:399]
    for k, r in enumerate(got):
        i = 255 + k
        assert r.sent_5d == pytest.approx(mean[i]) and r.sent_med == pytest.approx(sorted(mean[i - 251 : i + 1])[126]) and r.fwd1 == pytest.approx(0.01 * (((i + 1) * 7) % 5 - 2))
    assert events.sentiment_study(events.sentiment_gate(prices, index), index, buy=0.001, sell=0.001).first().ic_next_day is None  # under 500 days


def test_proposals(spark):
    from tidemark.operators import proposal

    bad = {"name": ("A!", "why", "dret()", 5), "rationale": ("good_name", "", "dret()", 5), "expression": ("good_name", "why", "", 5), "lookback_days": ("good_name", "why", "dret()", 300)}
    for field, p in bad.items():
        assert proposal.Proposal(*p).problem() == field
    assert proposal.Proposal("good_name", "why", "shift(dret(), 1)", 5).problem() is None and proposal.Proposal("good_name", "why", "col('open')", 5).problem().startswith("sandbox")
    df = spark.createDataFrame([*bad.values(), ("fine_one", "why", "dret()", 1), (None, "why", "dret()", 1)], "name string, rationale string, expression string, lookback_days int")
    assert [r.problem for r in proposal.invalid(df).collect()] == [*bad, None, "name"]
    some = spark.createDataFrame([(0, "trend"), (1, "liquidity"), (2, "new"), (3, "trend")], "position int, family string")
    memory = spark.createDataFrame([("liquidity", 1), ("trend", 2)], "family string, rank int")
    assert [r.position for r in proposal.by_memory(some, memory).orderBy("turn").collect()] == [1, 0, 3, 2]


def test_screen_gives_reasons_and_deltas(spark):
    from tidemark.operators import proposal, validation

    p = walk(spark, 6, 330)
    cal = sessions(p)
    rows = features.build_features(p).select("symbol", "trade_date", "ret_21d").join(features.forward_return_z(p).where("label is not null"), ["symbol", "trade_date"]).join(cal, "trade_date")
    folds = validation.walk_forward(cal, test=20, min_train=260)
    some = [proposal.Proposal("dret_two", "new", "roll_mean(dret(), 2)", 2), proposal.Proposal("ret_21d", "taken", "dret()", 1), proposal.Proposal("open_one", "refused", "col('open')", 1)]
    got = {r.name: r for r in proposal.screen(p, rows, cal, folds, ["ret_21d"], some, min_names=3).collect()}
    assert got["dret_two"].status == "ok" and got["dret_two"].delta_ic is not None
    assert got["ret_21d"].detail.startswith("name collides") and got["open_one"].detail.startswith("sandbox")


def test_events_beyond_the_calendar_raise_when_asked(spark):
    cal = sessions(spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2)], "trade_date date"))
    e = spark.sql("select * from values (1, timestamp_ntz'2024-01-01 09:00:00'), (2, timestamp_ntz'2024-01-02 16:00:00') as t(id, announced_at)")
    assert knowable_dates(e, cal).count() == 1
    with pytest.raises(Exception, match="no session at or after 2024-01-03"):
        knowable_dates(e, cal, beyond="raise").collect()


def test_news_in_utc_rolls_by_local_time(spark):
    from tidemark.operators import events

    cal = sessions(spark.createDataFrame([(date(2024, 1, d),) for d in (2, 3)], "trade_date date"))
    e = spark.sql("select * from values ('win', timestamp'2024-01-02 09:59:00'), ('loss', timestamp'2024-01-02 10:00:00') as t(subject, announced_at)")
    got = {r.trade_date.day: (r.sentiment, r.n) for r in events.daily_sentiment(e, cal, zone="Asia/Kolkata").collect()}
    score = 2 / (4 + 15) ** 0.5
    assert got == {2: (pytest.approx(score), 1), 3: (pytest.approx(-score), 1)}  # 15:29 and 15:30


def test_markets(spark):
    from tidemark.functions.expr import market

    m = market("overseas")
    assert m.settlement_days == 1 and spark.range(1).select(m.cost("buy", F.lit(1e6), F.lit(1e8))).first()[0] == pytest.approx(1.8e-4)
    with pytest.raises(ValueError, match="no market"):
        market("moon")


def test_labelled_days_equal_features_joined_with_labels(spark):
    p = walk(spark, 5, 320)
    days = p.where("day(trade_date) in (3, 11, 19)").select("trade_date").distinct()
    names = ["ret_21d", "mom_12_1", "month_end"]
    got = features.labelled(p, days, names)
    want = features.build_features(p).join(features.forward_return_z(p).where("label is not null"), ["symbol", "trade_date"]).join(days, "trade_date", "left_semi").select(got.columns)
    a, b = (x.orderBy("symbol", "trade_date").collect() for x in (got, want))
    assert len(a) == len(b) > 0 and all(list(x)[:2] == list(y)[:2] and list(x)[2:] == pytest.approx(list(y)[2:], abs=1e-9) for x, y in zip(a, b, strict=True))
