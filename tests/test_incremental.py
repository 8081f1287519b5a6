"""The store filled by batches against one rebuild of everything."""

import random
from datetime import date, timedelta
from pathlib import Path

import pytest

from tidemark.operators.actions import adjust
from tidemark.operators.incremental import AdjustedStore

BARS = "symbol string, trade_date date, open double, high double, low double, close double, volume double"
ACTIONS = "symbol string, ex_date date, subject string"
DAYS = [date(2019, 11, 1) + timedelta(days=3 * i) for i in range(60)]


def panel(seed):
    rnd, rows = random.Random(seed), []
    for s in ["A", "B", "C", "D"]:
        price = 100.0
        for d in DAYS:
            if rnd.random() < 0.9:
                price *= rnd.choice([1.0, 1.02, 0.97, 0.5, 1.01])
                rows.append((s, d, price * 0.98, price * 1.01, price * 0.95, price, float(rnd.randint(1, 99))))
    actions = [("A", DAYS[20], "Bonus 1:1"), ("A", DAYS[20], "Bonus 1:1"), ("B", DAYS[31] + timedelta(days=1), "Demerger"), ("C", DAYS[45], "Split from Rs 10 to Rs 5"), ("C", DAYS[10], "Rights 1:5"), ("D", DAYS[-1] + timedelta(days=40), "Bonus 1:2"), ("E", DAYS[5], "Bonus 1:1"), ("A", DAYS[50], "Dividend"), (None, DAYS[3], None)]
    return rows, actions


def same(store, spark, rows, actions):
    key = lambda df: {(r.symbol, r.trade_date): tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}
    want = adjust(spark.createDataFrame(rows, BARS), spark.createDataFrame(actions, ACTIONS))
    got = store.read()
    assert got.count() == len(rows) and key(got.select(want.columns)) == key(want)


def files(path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("adjusted/**/*.parquet")}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_into_batches_equals_a_rebuild(spark, tmp_path, seed):
    """Random stretches of days, actions before, with or after their session, late bars, and corrections of stored ones."""
    rows, actions = panel(seed)
    rnd, store = random.Random(seed), AdjustedStore(spark, str(tmp_path / "s"), period="yyyy-MM", buckets=3)
    cut = sorted(rnd.sample(range(5, 58), 3))
    edges = [DAYS[0], *[DAYS[i] for i in cut], date.max]
    held = [r for r in rows if rnd.random() < 0.04]
    shown_early = [a for a in actions if rnd.random() < 0.4]
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        now = [r for r in rows if lo <= r[1] < hi and r not in held]
        wrong = [(*r[:2], *[v * 3 for v in r[2:]]) if k == 1 and i % 7 == 0 else r for i, r in enumerate(now)]
        told = (shown_early if k == 0 else []) + [a for a in actions if a not in shown_early and lo <= a[1] < hi and a[0] != "C"]
        assert store.append(spark.createDataFrame(wrong, BARS), spark.createDataFrame(told, ACTIONS)) == k + 1
    late = [a for a in actions if a[0] == "C" and a not in shown_early]
    fixed = held + [r for r in rows if edges[1] <= r[1] < edges[2] and r not in held]
    store.append(spark.createDataFrame(fixed, BARS), spark.createDataFrame(late, ACTIONS))
    same(store, spark, rows, actions)
    assert [r.version for r in store.versions().orderBy("version").collect()] == [1, 2, 3, 4, 5]


def test_a_new_day_leaves_other_partitions_files(spark, tmp_path):
    """A day without actions rewrites its own month; one with an action of one symbol rewrites that symbol's bucket alone."""
    rows, actions = panel(3)
    store = AdjustedStore(spark, str(tmp_path / "s"), period="yyyy-MM", buckets=64)
    bars = lambda some: spark.createDataFrame(some, BARS)
    acts = lambda some: spark.createDataFrame(some, ACTIONS)
    day = DAYS[-2]
    store.append(bars([r for r in rows if r[1] < day]), acts([a for a in actions if a[1] < day]))
    before = files(tmp_path)
    store.append(bars([r for r in rows if r[1] == day]), acts([]))
    after = files(tmp_path)
    gone = {p for p in before if after.get(p) != before[p]}
    assert all(f"period={day:%Y-%m}" in p for p in gone) and len(gone) < len(before) / 3
    split = ("B", DAYS[-1], "Split from Rs 10 to Rs 9")
    store.append(bars([r for r in rows if r[1] > day]), acts([split]))
    last = files(tmp_path)
    changed = {p.split("bucket=")[1].split("/")[0] for p in after if last.get(p) != after[p] and f"period={day:%Y-%m}" not in p and f"period={DAYS[-1]:%Y-%m}" not in p}
    assert len(changed) == 1
    same(store, spark, rows, [*[a for a in actions if a[1] <= DAYS[-1] and not (a[1] >= day)], split])


def test_a_batch_may_be_applied_again(spark, tmp_path):
    rows, actions = panel(4)
    store = AdjustedStore(spark, str(tmp_path / "s"))
    half = DAYS[30]
    for batch in (lambda d: d < half, lambda d: d >= half):
        for _ in range(2):
            store.append(spark.createDataFrame([r for r in rows if batch(r[1])], BARS), spark.createDataFrame([a for a in actions if batch(a[1])], ACTIONS))
    same(store, spark, rows, actions)
    before = files(tmp_path)
    store.append(spark.createDataFrame([], BARS), spark.createDataFrame([], ACTIONS))
    assert files(tmp_path) == before


def test_periods_that_read_as_numbers_are_not_rewritten(spark, tmp_path):
    """By year, whose partitions Spark reads as numbers: a late action that changes no price leaves every file."""
    rows, actions = panel(5)
    store = AdjustedStore(spark, str(tmp_path / "s"), buckets=2)
    store.append(spark.createDataFrame(rows, BARS), spark.createDataFrame(actions, ACTIONS))
    before = files(store.path)
    store.append(spark.createDataFrame([], BARS), spark.createDataFrame([("B", DAYS[7], "Dividend")], ACTIONS))
    assert files(store.path) == before
