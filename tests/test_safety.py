"""Alerts, delivery, kill switch, flattening, and backfills with their reports."""

import hashlib
import json
from datetime import date, datetime

import pytest

from tidemark.operators import safety
from tidemark.sources import backfill, stores

STATES = ["normal", "half_gross", "half_gross", "flat", "half_gross", "normal", "normal"]


def states(spark):
    rows = [("a", date(2024, 1, k + 1), s) for k, s in enumerate(STATES)] + [("b", date(2024, 1, 1), "flat"), ("b", date(2024, 1, 2), "flat"), ("c", date(2024, 1, 1), "normal")]
    return spark.createDataFrame(rows, "book string, trade_date date, state string")


def test_alerts_follow_changes_of_state(spark):
    got = {(r.book, r.trade_date.day): (r.severity, r.message) for r in safety.state_alerts(states(spark), "book").collect()}
    assert got == {
        ("a", 2): ("warning", "drawdown state normal -> half_gross"), ("a", 4): ("critical", "drawdown state half_gross -> flat"),
        ("a", 5): ("warning", "drawdown state flat -> half_gross"), ("a", 6): ("info", "drawdown state half_gross -> normal"), ("b", 1): ("critical", "drawdown state normal -> flat"),
    }
    one = safety.state_alerts(states(spark).where("book = 'a'").drop("book")).collect()
    assert len(one) == 4 and len({r.alert_id for r in one}) == 4


def test_each_channel_gets_an_alert_once(spark):
    alerts = safety.state_alerts(states(spark), "book")
    channels = spark.createDataFrame([("log", "info"), ("chat", "warning"), ("phone", "critical"), ("odd", "no such")], "channel string, least string")
    none = spark.createDataFrame([], "alert_id string, channel string")
    first = safety.to_deliver(alerts.union(alerts), channels, none).collect()
    count = lambda rows: {c: sum(r.channel == c for r in rows) for c in ("log", "chat", "phone", "odd")}
    assert count(first) == {"log": 5, "chat": 4, "phone": 2, "odd": 2}
    done = spark.createDataFrame([(r.alert_id, r.channel) for r in first if r.channel != "phone"] * 2, "alert_id string, channel string")
    assert count(safety.to_deliver(alerts, channels, done).collect()) == {"log": 0, "chat": 0, "phone": 2, "odd": 0}
    odd = spark.createDataFrame([("x", None), ("y", "unheard of")], "alert_id string, severity string")
    assert count(safety.to_deliver(odd, channels, none).collect()) == {"log": 2, "chat": 2, "phone": 2, "odd": 2}


def test_switch_is_the_last_entry(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [(1, at(9), "freeze", "loss"), (1, at(10), "unfreeze", "ok"), (2, at(9), "unfreeze", None), (2, at(9), "freeze", "break"), (2, at(9), "freeze", None), (3, at(8), "freeze", "x"), (3, at(9), "note", "n"), (3, None, "unfreeze", "n")]
    switch = safety.switches(spark.createDataFrame(rows, "account int, at timestamp, action string, reason string"))
    assert sorted((r.account, r.frozen, r.reason) for r in switch.collect()) == [(1, False, None), (2, True, "break"), (3, True, "x")]
    orders = spark.createDataFrame([(k, s) for k in (1, 2, 3, 4) for s in ("buy", "sell")], "account int, side string")
    assert sorted(map(tuple, safety.permitted(orders, switch).collect())) == [(1, "buy"), (1, "sell"), (2, "sell"), (3, "sell"), (4, "buy"), (4, "sell")]


def test_flatten_sells_all_longs(spark):
    day = date(2024, 1, 5)
    held = spark.createDataFrame([(1, day, "A", 5), (1, day, "B", 0), (2, day, "A", -3), (2, day, "C", 10**9), (2, day, "D", None)], "account int, trade_date date, symbol string, quantity long")
    got = safety.flatten(held).collect()
    assert sorted((r.account, r.symbol, r.side, r.quantity) for r in got) == [(1, "A", "sell", 5), (2, "C", "sell", 10**9)]
    assert {r.client_order_id for r in got} == {hashlib.sha256(t.encode()).hexdigest()[:12] for t in ("1:2024-01-05:A:sell:5", "2:2024-01-05:C:sell:1000000000")}


def test_backfill_stores_once_and_reports(spark, tmp_path):
    good, root = b"PK\x03\x04zip", f"file://{tmp_path}/raw"
    days = [date(2024, 1, k) for k in range(1, 8)]

    def fetch(day, path):
        if day.day == 6:
            return None
        if day.day == 7:
            raise TimeoutError("no answer")
        return b"<html>blocked" if day.day == 5 else good

    (tmp_path / "raw" / "2024").mkdir(parents=True)
    (tmp_path / "raw" / "2024" / "1.zip").write_bytes(b"earlier")
    items = spark.createDataFrame([(d, f"2024/{d.day}.zip") for d in days + days[1:3]], "day date, path string")
    got = {r.day.day: r for r in backfill.backfill(items, root, fetch, lanes=3, pause=0).collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "skipped", 2: "downloaded", 3: "downloaded", 4: "downloaded", 5: "failed", 6: "not_found", 7: "failed"}
    assert got[2].sha256 == hashlib.sha256(good).hexdigest() and got[2].size == len(good) and got[7].error == "TimeoutError: no answer"
    assert (tmp_path / "raw" / "2024" / "1.zip").read_bytes() == b"earlier"
    assert sorted(p.name for p in (tmp_path / "raw" / "2024").iterdir()) == ["1.zip", "2.zip", "3.zip", "4.zip"]
    assert stores.corrupt(spark, f"{tmp_path}/raw/2024/[234].zip").count() == 0
    again = backfill.backfill(items, root, fetch, lanes=2, pause=0)
    assert {r.day.day: r.outcome for r in again.collect()} == {1: "skipped", 2: "skipped", 3: "skipped", 4: "skipped", 5: "failed", 6: "not_found", 7: "failed"}
    backfill.write_backfill_report(again, str(tmp_path / "report"))
    lines = [json.loads(x) for p in (tmp_path / "report").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 1 and (lines[0]["items"], lines[0]["skipped"], lines[0]["downloaded"], lines[0]["ok"]) == (7, 4, 0, False)
    assert lines[0]["not_found_days"] == ["2024-01-06"] and [(f["day"], f["path"]) for f in lines[0]["failures"]] == [("2024-01-05", "2024/5.zip"), ("2024-01-07", "2024/7.zip")]


def test_backfill_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "day date, path string")
    (r,) = backfill.report(backfill.backfill(none, f"file://{tmp_path}", lambda d, p: b"", pause=0)).collect()
    assert (r["items"], r.ok, r.not_found_days, r.failures) == (0, True, [], [])


@pytest.mark.parametrize("content", [b"", b"PK", b"{}"])
def test_what_is_no_zip_is_not_stored(tmp_path, content):
    assert backfill.store_once(f"file://{tmp_path}", "a/b.zip", lambda: content)[0] == "failed"
    assert not list(tmp_path.rglob("*.*"))
