"""Event queries. Announcements come from events; event studies take their events from orders, whose dates overlap the bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..functions.temporal import fiscal_year, knowable_dates, sessions
from ..operators import events, universe, valence
from ..sources import views
from ..stages import Stage
from .panel import SCALED
from .registry import TABLES, query

_CASES = " ".join(f"WHEN regexp_matches(s, '{p}') THEN {{'category': '{c}', 'direction': {d}, 'materiality': {m}}}" for p, c, d, m in events.RULES)
TABLES["classified"] = f"SELECT event_id, symbol, announced_at, subject, k.category AS category, k.direction AS direction, k.materiality AS materiality FROM (SELECT *, CASE {_CASES} ELSE {{'category': 'other', 'direction': 0, 'materiality': 0}} END AS k FROM (SELECT *, lower(subject) AS s FROM announcements))"
TABLES["ev_sessions"] = "SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events WHERE isodow(ts) < 6 AND CAST(ts AS DATE) <> DATE '2024-01-17'"
TABLES["knowable"] = """SELECT c.*, n.trade_date AS knowable_date FROM (SELECT *, CASE WHEN hour(announced_at) * 60 + minute(announced_at) < 930 THEN CAST(announced_at AS DATE) ELSE CAST(announced_at AS DATE) + 1 END AS start FROM classified) c
    ASOF JOIN ev_sessions n ON c.start <= n.trade_date"""
TABLES["study_events"] = """SELECT DISTINCT symbol, CAST(o_orderdate AS DATE) AS knowable_date, CASE o_orderpriority WHEN '1-URGENT' THEN 'earnings_result' WHEN '2-HIGH' THEN 'pledge' WHEN '3-MEDIUM' THEN 'order_win' ELSE 'litigation_regulatory' END AS category,
    CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN -1 WHEN '3-MEDIUM' THEN 1 ELSE -1 END AS direction, CASE o_orderpriority WHEN '1-URGENT' THEN 2 ELSE 1 END AS materiality FROM order_symbols"""
TABLES["abnormal"] = """SELECT symbol, trade_date, ar FROM (SELECT symbol, trade_date, ret - (y - beta * x) - beta * mret AS ar FROM (SELECT *, (xy - x * y) / (xx - x * x + 1e-12) AS beta FROM
    (SELECT symbol, trade_date, ret, mret, CASE WHEN count(*) OVER w >= 60 THEN avg(mret) OVER w END AS x, avg(ret) OVER w AS y, avg(ret * mret) OVER w AS xy, avg(mret * mret) OVER w AS xx
    FROM rets JOIN market USING (trade_date) WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)))) WHERE ar IS NOT NULL"""
TABLES["cars"] = "SELECT e.symbol, e.knowable_date, e.category, w.window, w.car FROM study_events e JOIN (SELECT symbol, trade_date, unnest([" + ", ".join(
    f"{{'window': '[{s},{e}]', 'car': CASE WHEN count(*) OVER w{i} = {e - s + 1} THEN sum(ar) OVER w{i} END}}" for i, (s, e) in enumerate(events.CLOSE_WINDOWS)
) + "]) AS w FROM abnormal WINDOW " + ", ".join(f"w{i} AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {s} FOLLOWING AND {e} FOLLOWING)" for i, (s, e) in enumerate(events.CLOSE_WINDOWS)) + ") a ON a.symbol = e.symbol AND a.trade_date = e.knowable_date WHERE w.car IS NOT NULL"


def study_events(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    pick = lambda a, b, c, d: F.when(p == "1-URGENT", a).when(p == "2-HIGH", b).when(p == "3-MEDIUM", c).otherwise(d)
    return o.select(views.order_symbol(spark, sf_dir).alias("symbol"), F.to_date("o_orderdate").alias("knowable_date"), pick("earnings_result", "pledge", "order_win", "litigation_regulatory").alias("category"), pick(0, -1, 1, -1).alias("direction"), pick(2, 1, 1, 1).alias("materiality")).distinct()


def event_calendar(spark, sf_dir):
    days = views.read(spark, sf_dir, "events").select(F.to_date("ts").alias("trade_date")).distinct()
    return days.where("weekday(trade_date) < 5 and trade_date <> date'2024-01-17'")


def _known(spark, sf_dir):
    return knowable_dates(events.classify(views.announcements(spark, sf_dir)), event_calendar(spark, sf_dir))


def _abnormal(spark, sf_dir, bars=None):
    r = views.returns(views.bars(spark, sf_dir) if bars is None else bars)
    return events.market_model(r, views.market(r))


@query("SELECT event_id, subject, category, direction, materiality FROM classified")
def taxonomy_classify(spark, sf_dir):
    return events.classify(views.announcements(spark, sf_dir)).select("event_id", "subject", "category", "direction", "materiality")


@query("SELECT event_id, symbol, announced_at, knowable_date FROM knowable")
def knowable_date(spark, sf_dir):
    return _known(spark, sf_dir).select("event_id", "symbol", "announced_at", "knowable_date")


@query("SELECT category, count(*) AS n, round(avg(CASE WHEN hour(announced_at) * 60 + minute(announced_at) >= 930 THEN 1.0 ELSE 0.0 END), 6) AS after_close_share, round(avg(CASE WHEN symbol IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS null_symbol_share FROM classified GROUP BY category")
def after_close_share(spark, sf_dir):
    late = (F.hour("announced_at") * 60 + F.minute("announced_at") >= 930).cast("double")
    return events.classify(views.announcements(spark, sf_dir)).groupBy("category").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(late)).alias("after_close_share"), rounded(F.avg(F.col("symbol").isNull().cast("double"))).alias("null_symbol_share"))


@query("SELECT DISTINCT e.symbol, e.knowable_date, e.category FROM study_events e JOIN universe u ON u.symbol = e.symbol AND u.trade_date = e.knowable_date WHERE u.liquidity_rank <= 20")
def event_dedupe_semi(spark, sf_dir):
    u = universe.pit_universe(views.bars(spark, sf_dir), **SCALED)
    return events.dedupe(study_events(spark, sf_dir), u).select("symbol", "knowable_date", "category")


@query("SELECT symbol, trade_date, round(ar, 6) + 0.0 AS ar FROM abnormal")
def market_model_ar(spark, sf_dir):
    return _abnormal(spark, sf_dir).select("symbol", "trade_date", rounded("ar").alias("ar"))


@query('SELECT symbol, knowable_date, category, "window", round(car, 6) + 0.0 AS car FROM cars')
def car_by_window(spark, sf_dir):
    return events.car(_abnormal(spark, sf_dir), study_events(spark, sf_dir)).select("symbol", "knowable_date", "category", "window", rounded("car").alias("car"))


@query('SELECT category, "window", count(*) AS n, round(avg(car), 6) + 0.0 AS mean_car, round(avg(car) * sqrt(count(*)) / stddev_samp(car), 4) + 0.0 AS t FROM cars GROUP BY category, "window" HAVING count(*) >= 30')
def car_t_stats(spark, sf_dir):
    return events.car_table(events.car(_abnormal(spark, sf_dir), study_events(spark, sf_dir))).select("category", "window", "n", rounded("mean_car").alias("mean_car"), rounded("t", 4).alias("t"))


@query()
def car_bootstrap(spark, sf_dir):
    return events.car_bootstrap(events.car(_abnormal(spark, sf_dir), study_events(spark, sf_dir)))


@query("""WITH d AS (SELECT e.symbol, e.knowable_date, a.ar, sum(a.ar) OVER w AS drift, count(*) OVER w AS n FROM abnormal a LEFT JOIN (SELECT DISTINCT symbol, knowable_date FROM study_events WHERE category = 'earnings_result') e ON e.symbol = a.symbol AND e.knowable_date = a.trade_date
    WINDOW w AS (PARTITION BY a.symbol ORDER BY a.trade_date ROWS BETWEEN 2 FOLLOWING AND 20 FOLLOWING)), q AS (SELECT *, CAST(floor(row_number() OVER (ORDER BY ar, symbol, knowable_date) * 5 / (count(*) OVER () + 1)) AS INTEGER) AS quintile FROM d WHERE symbol IS NOT NULL AND n = 19)
    SELECT quintile, count(*) AS n, round(avg(ar), 6) + 0.0 AS day0, round(avg(drift), 6) + 0.0 AS drift FROM q GROUP BY quintile""")
def pead_quintiles(spark, sf_dir):
    """Drift over rows 2 to 20 after earnings by quintile of the day-0 abnormal return."""
    e = study_events(spark, sf_dir).where("category = 'earnings_result'").select("symbol", "knowable_date").distinct()
    both = events.car(_abnormal(spark, sf_dir), e, [(0, 0), (2, 20)], ())
    wide = both.groupBy("symbol", "knowable_date").pivot("window", ["[0,0]", "[2,20]"]).agg(F.first("car")).toDF("symbol", "knowable_date", "ar", "drift").where("drift is not null")
    return events.quintiles(wide).groupBy("quintile").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("ar")).alias("day0"), rounded(F.avg("drift")).alias("drift"))


_FEATURES = """WITH ev AS (SELECT symbol, knowable_date, category, direction, materiality FROM study_events), grid AS (SELECT symbol, trade_date FROM bars JOIN weekly USING (trade_date)),
    m AS (SELECT DISTINCT symbol, knowable_date + 14 AS meeting_date, knowable_date AS known_date FROM ev WHERE category = 'earnings_result'),
    le AS (SELECT e.symbol, e.knowable_date AS event_date, coalesce(a.ar, 0.0) AS last_event_ar FROM (SELECT DISTINCT symbol, knowable_date FROM ev) e LEFT JOIN abnormal a ON a.symbol = e.symbol AND a.trade_date = e.knowable_date),
    g AS (SELECT grid.*, le.event_date, le.last_event_ar FROM grid ASOF LEFT JOIN le ON grid.symbol = le.symbol AND grid.trade_date >= le.event_date),
    ee AS (SELECT DISTINCT symbol, knowable_date AS earnings_date FROM ev WHERE category = 'earnings_result'),
    h AS (SELECT g.*, ee.earnings_date FROM g ASOF LEFT JOIN ee ON g.symbol = ee.symbol AND g.trade_date >= ee.earnings_date),
    b AS (SELECT h.*, m.meeting_date, m.known_date FROM h ASOF LEFT JOIN m ON h.symbol = m.symbol AND h.trade_date <= m.meeting_date)
    SELECT b.symbol, b.trade_date, round(ln(1 + least(greatest(coalesce(b.trade_date - event_date, 126), 0), 126)), 6) AS days_since_event, round(ln(1 + least(greatest(coalesce(b.trade_date - earnings_date, 126), 0), 126)), 6) AS days_since_earnings,
    round(coalesce(last_event_ar, 0.0), 6) + 0.0 AS last_event_ar, count(ev.symbol) AS n_events_63d, count(ev.symbol) FILTER (WHERE direction < 0) AS n_negative_63d, count(ev.symbol) FILTER (WHERE direction > 0) AS n_positive_63d,
    count(ev.symbol) FILTER (WHERE category = 'pledge') AS n_pledge_63d, count(ev.symbol) FILTER (WHERE category = 'litigation_regulatory') AS n_litigation_63d,
    round(ln(1 + least(greatest(coalesce(CASE WHEN known_date <= b.trade_date THEN meeting_date - b.trade_date END, 126), 0), 126)), 6) AS days_to_board_meeting
    FROM b LEFT JOIN ev ON ev.symbol = b.symbol AND ev.knowable_date > b.trade_date - 63 AND ev.knowable_date <= b.trade_date GROUP BY ALL"""


@query(_FEATURES)
def event_features_full(spark, sf_dir):
    from ..functions.temporal import weekly_grid

    b = Stage(spark, "events").write(views.bars(spark, sf_dir))  # read for the grid, the calendar, the market and the names
    grid = b.select("symbol", "trade_date").join(weekly_grid(sessions(b)), "trade_date", "left_semi")
    e = study_events(spark, sf_dir)
    m = e.where("category = 'earnings_result'").select("symbol", F.date_add("knowable_date", 14).alias("meeting_date"), F.col("knowable_date").alias("known_date")).distinct()
    f = events.event_features(grid, e, m, _abnormal(spark, sf_dir, b))
    logs = ("days_since_event", "days_since_earnings", "last_event_ar", "days_to_board_meeting")
    return f.select(*[rounded(c).alias(c) if c in logs else F.col(c) for c in f.columns])


@query("SELECT event_id, category, substr(subject, 1, 200) AS subject FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY event_id) AS n FROM classified) WHERE n <= 27 ORDER BY category, event_id LIMIT 300")
def audit_sample_per_category(spark, sf_dir):
    return events.audit_sample(events.classify(views.announcements(spark, sf_dir)))


@query("SELECT fy, count(*) AS n FROM (SELECT CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS INTEGER) AS fy FROM orders) GROUP BY fy")
def fiscal_years(spark, sf_dir):
    return views.read(spark, sf_dir, "orders").groupBy(fiscal_year("o_orderdate").alias("fy")).agg(F.count(F.lit(1)).alias("n"))


_words = lambda text: ", ".join("'" + w + "'" for w in text.split())
_STEP = """SELECT * REPLACE ((s + CASE WHEN active{k} AND b{k} <> 0 THEN {share} * sign(s) * (b{k} + CASE WHEN up{k} AND mixed THEN 0.733 ELSE 0 END) ELSE 0 END) * CASE WHEN active{k} AND not{k} THEN -0.74 ELSE 1 END AS s) FROM ({rows})"""
TABLES["subject_words"] = r"""SELECT subject, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS w FROM (SELECT subject, list_transform(list_filter(string_split_regex(subject, '\s+'), lambda x: x <> ''),
    lambda x: CASE WHEN len(regexp_replace(x, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) > 2 THEN regexp_replace(x, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') ELSE x END) AS t FROM (SELECT DISTINCT subject FROM order_announcements WHERE subject IS NOT NULL))"""
TABLES["subject_facts"] = f"""SELECT subject, i, lower(w) AS l, x.v, CASE WHEN lower(w) IN ({_words(valence.MORE)}) THEN 0.293 WHEN lower(w) IN ({_words(valence.LESS)}) THEN -0.293 ELSE 0 END AS b, lower(w) IN ({_words(valence.NOT)}) OR lower(w) LIKE '%n''t' AS neg,
    w = upper(w) AND w <> lower(w) AS up, avg(CASE WHEN w = upper(w) AND w <> lower(w) THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY subject) AS share, min(CASE WHEN lower(w) = 'but' THEN i END) OVER (PARTITION BY subject) AS turn
    FROM subject_words LEFT JOIN (VALUES {", ".join(f"('{w}', {v}::DOUBLE)" for v, words in events.LEXICON.items() for w in words.split())}) x(word, v) ON x.word = lower(w)"""
TABLES["subject_near"] = """SELECT subject, i, turn, share > 0 AND share < 1 AS mixed, v + CASE WHEN up AND share < 1 THEN 0.733 * sign(v) ELSE 0 END AS s, v, b, """ + ", ".join(
    f"lag(v, {k}) OVER o IS NULL AND i > {k} AS active{k}, lag(b, {k}) OVER o AS b{k}, lag(neg, {k}) OVER o AS not{k}, lag(up, {k}) OVER o AS up{k}" for k in (1, 2, 3)) + """,
    coalesce(lag(l) OVER o = 'least' AND lag(v) OVER o IS NULL AND NOT coalesce(lag(l, 2) OVER o IN ('at', 'very'), false), false) AS least FROM subject_facts WINDOW o AS (PARTITION BY subject ORDER BY i)"""
_steps = "SELECT * FROM subject_near"
for _k, _share in ((1, "1.0"), (2, "0.95"), (3, "0.9")):
    _steps = _STEP.format(k=_k, share=_share, rows=_steps)
TABLES["subject_scores"] = f"""SELECT subject, t / sqrt(t * t + 15) AS score FROM (SELECT subject, s + sign(s) * CASE WHEN s = 0 THEN 0 ELSE 0.292 * least(len(subject) - len(replace(subject, '!', '')), 4) + CASE WHEN q < 2 THEN 0 WHEN q <= 3 THEN 0.18 * q ELSE 0.96 END END AS t FROM
    (SELECT subject, len(subject) - len(replace(subject, '?', '')) AS q, sum(CASE WHEN least THEN s * -0.74 ELSE s END * CASE WHEN turn IS NULL THEN 1 WHEN i < turn THEN 0.5 ELSE 1.5 END) AS s FROM ({_steps}) WHERE v IS NOT NULL AND b = 0 GROUP BY subject))"""
TABLES["sentiment_index"] = """SELECT x.trade_date, avg(sentiment) AS sentiment, CAST(sum(n) AS BIGINT) AS n FROM
    (SELECT CAST(announced_at AS DATE) + CASE WHEN hour(announced_at) * 60 + minute(announced_at) >= 930 THEN 1 ELSE 0 END AS day, avg(coalesce(score, 0.0)) AS sentiment, count(*) AS n FROM order_announcements LEFT JOIN subject_scores USING (subject) GROUP BY 1) d
    ASOF JOIN sessions x ON d.day <= x.trade_date GROUP BY x.trade_date"""
TABLES["sentiment_rows"] = """SELECT trade_date, n, sentiment, sent_5d, sent_med, fwd1, fwd5, sent_5d > sent_med AS risk_on FROM (
    SELECT *, CASE WHEN count(sent_5d) OVER w = 252 THEN list_sort(list(sent_5d) OVER w)[127] END AS sent_med, lead(mret) OVER o AS fwd1, lead(level, 5) OVER o / level - 1 AS fwd5 FROM (
    SELECT *, CASE WHEN count(*) OVER w5 = 5 THEN avg(coalesce(sentiment, 0.0)) OVER w5 END AS sent_5d FROM (SELECT trade_date, mret, product(1 + mret) OVER (ORDER BY trade_date) AS level FROM (SELECT trade_date, mret * 0.01 AS mret FROM market)) LEFT JOIN sentiment_index USING (trade_date)
    WINDOW w5 AS (ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WINDOW o AS (ORDER BY trade_date), w AS (ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) WHERE sent_5d IS NOT NULL AND sent_med IS NOT NULL AND fwd1 IS NOT NULL"""


def _sentiment(spark, sf_dir):
    """The market's price series and the sentiment index of announcements along it."""
    b = views.bars(spark, sf_dir)
    m = views.market(views.returns(b)).select("trade_date", (F.col("mret") * 0.01).alias("ret"))
    prices = m.withColumn("level", F.product(1 + F.col("ret")).over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)))  # one row a session
    return prices, events.daily_sentiment(views.order_announcements(spark, sf_dir), sessions(b))


@query("SELECT trade_date, n, round(sentiment, 8) + 0.0 AS sentiment FROM sentiment_index")
def sentiment_daily(spark, sf_dir):
    return _sentiment(spark, sf_dir)[1].select("trade_date", "n", rounded("sentiment", 8).alias("sentiment"))


@query("SELECT trade_date, n, round(sent_5d, 8) + 0.0 AS sent_5d, round(sent_med, 8) + 0.0 AS sent_med, round(fwd1, 8) + 0.0 AS fwd1, round(fwd5, 8) + 0.0 AS fwd5 FROM sentiment_rows")
def sentiment_roll_gate(spark, sf_dir):
    g = events.sentiment_gate(*_sentiment(spark, sf_dir))
    return g.select("trade_date", "n", *[rounded(c, 8).alias(c) for c in ("sent_5d", "sent_med", "fwd1", "fwd5")])


@query("""WITH r AS (SELECT *, CASE WHEN sent_5d - sent_med > 1e-12 THEN 1.0 ELSE 0.0 END AS pos FROM sentiment_rows), c AS (SELECT *, coalesce(lag(pos) OVER (ORDER BY trade_date), 0) AS was, lag(trade_date) OVER (ORDER BY trade_date) IS NULL AS first FROM r),
    x AS (SELECT *, pos * fwd1 - CASE WHEN pos > was THEN 0.0012 WHEN pos < was THEN 0.001 ELSE 0 END AS gated, fwd1 - CASE WHEN first THEN 0.0012 ELSE 0 END AS always FROM c), f AS (SELECT count(*) AS n_days, corr(sent_5d, fwd1) AS ic1, corr(sent_5d, fwd5) FILTER (WHERE fwd5 IS NOT NULL) AS ic5,
    avg(gated) / stddev_samp(gated) * sqrt(252.0) AS g, avg(always) / stddev_samp(always) * sqrt(252.0) AS a, avg(pos) AS t FROM x)
    SELECT n_days, (SELECT count(*) FROM sentiment_index) AS coverage_days, round(ic1, 6) + 0.0 AS ic_next_day, round(ic5, 6) + 0.0 AS ic_next_5d, round(g, 6) + 0.0 AS gated_sharpe, round(a, 6) + 0.0 AS always_long_sharpe, round(g - a, 6) + 0.0 AS gated_minus_always, round(t, 6) + 0.0 AS time_in_market FROM f""")
def sentiment_study(spark, sf_dir):
    prices, index = _sentiment(spark, sf_dir)
    gate = events.sentiment_gate(prices, index).withColumn("risk_on", F.col("sent_5d") - F.col("sent_med") > 1e-12)  # equal means that were summed in another order
    s = events.sentiment_study(gate, index, buy=0.0012, sell=0.001)
    return s.select("n_days", "coverage_days", *[rounded(c).alias(c) for c in ("ic_next_day", "ic_next_5d", "gated_sharpe", "always_long_sharpe", "gated_minus_always", "time_in_market")])
