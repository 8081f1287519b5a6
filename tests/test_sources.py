import json
import zipfile
from datetime import date, datetime

import pytest

from tidemark.sources import market_files as m
from tidemark.sources import stores

OLD = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP"
NEW = "TradDt,ISIN,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,LastPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd"


def put(folder, name, text):
    p = folder / name
    p.write_text(text)
    return str(p)


def test_both_daily_formats_agree(spark, tmp_path):
    a = put(tmp_path, "cm05JUL2024bhav.csv", f"{OLD},TOTALTRADES,ISIN,\nAAA,EQ,1,2,1,1.5,1.5,1.4,100,150.5,5-Jul-24,7,INE1,\n")
    b = put(tmp_path, "BhavCopy_NSE_CM_0_0_0_20240705_F_0000.csv", f"{NEW}\n2024-07-05,INE1,AAA,EQ,1,2,1,1.5,1.5,1.4,100,150.5,7\n")
    assert m.daily_bars(spark, a).collect() == m.daily_bars(spark, b).collect()


def test_old_file_without_isin_and_trades(spark, tmp_path):
    r = m.daily_bars(spark, put(tmp_path, "cm04JAN2010bhav.csv", f"{OLD},\nAAA,EQ,1,2,1,1.5,1.5,1.4,100,150.5,4-JAN-2010,\n")).first()
    assert (r.trade_date, r.isin, r.trades, r.volume) == (date(2010, 1, 4), None, None, 100)


def test_wrong_dates_and_missing_columns_fail(spark, tmp_path):
    with pytest.raises(Exception, match="not dated"):
        m.daily_bars(spark, put(tmp_path, "cm05JAN2010bhav.csv", f"{OLD},\nAAA,EQ,1,2,1,1.5,1.5,1.4,100,150.5,4-JAN-2010,\n")).collect()
    with pytest.raises(m.FormatError):
        m.daily_bars(spark, put(tmp_path, "cm06JAN2010bhav.csv", "SYMBOL,SERIES\nA,EQ\n"))


def test_index_dates_by_name(spark, tmp_path):
    head = ",".join(m._INDEX)
    for text in ("05-01-2024", "01-05-2024"):
        r = m.index_closes(spark, put(tmp_path, "ind_close_all_05012024.csv", f"{head}\nX,{text},1,2,1,2,-,.5,10,1,2,3,1.2\n")).first()
        assert r.trade_date == date(2024, 1, 5) and r.points_change is None


def test_renames_split_from_the_right(spark, tmp_path):
    r = m.renames(spark, put(tmp_path, "s.csv", " A, B Co,OLD,NEW,30-OCT-2019\n\n")).collect()
    assert [(x.company, x.old_symbol, x.new_symbol, x.change_date) for x in r] == [("A, B Co", "OLD", "NEW", date(2019, 10, 30))]
    with pytest.raises(Exception, match="bad rename"):
        m.renames(spark, put(tmp_path, "bad.csv", "a,b,c\n")).collect()


def test_json_feeds(spark, tmp_path):
    ca = m.corporate_actions(spark, put(tmp_path, "ca.json", json.dumps([{"symbol": "A", "exDate": "28-Oct-2024", "recDate": "-", "faceVal": 10}]))).first()
    assert (ca.ex_date, ca.record_date, ca.face_value) == (date(2024, 10, 28), None, "10")
    an = m.announcements(spark, put(tmp_path, "an.json", json.dumps([{"symbol": "A", "an_dt": "05-Jul-2026 22:48:03", "seq_id": None}]))).first()
    assert an.announced_at == datetime(2026, 7, 5, 22, 48, 3)
    with pytest.raises(Exception, match="without a time"):
        m.announcements(spark, put(tmp_path, "an2.json", json.dumps([{"symbol": "A"}]))).collect()
    bm = m.board_meetings(spark, put(tmp_path, "bm.json", json.dumps([{"bm_symbol": "A", "bm_date": "30-Jun-2026", "bm_timestamp": None}]))).first()
    assert bm.meeting_date == date(2026, 6, 30) and bm.intimated_at is None
    assert m.corporate_actions(spark, put(tmp_path, "none.json", "[]")).count() == 0


def test_futures_from_a_zip(spark, tmp_path):
    p = tmp_path / "fo04JAN2021bhav.csv.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("x.csv", "INSTRUMENT,SYMBOL,EXPIRY_DT,OPEN,CLOSE,SETTLE_PR,CONTRACTS,OPEN_INT\nFUTIDX,NIFTY,28-Jan-2021,1,2,3,4,5\nFUTSTK,AAA,28-Jan-2021,1,2,3,4,5\n")
    r = m.futures(m.unzipped(spark, str(p))).collect()
    assert [(x.trade_date, x.expiry, x.settle) for x in r] == [(date(2021, 1, 4), date(2021, 1, 28), 3.0)]
    assert stores.corrupt(spark, [put(tmp_path, "b.zip", "<html>"), str(p)]).count() == 1


def test_file_names():
    assert m.file_name(date(2024, 6, 28)) == "cm28JUN2024bhav.csv.zip"
    assert m.file_name(date(2024, 7, 1), "futures") == "BhavCopy_NSE_FO_0_0_0_20240701_F_0000.csv.zip"


def test_stores(spark, tmp_path):
    days = spark.createDataFrame([(date(2023, 1, 2),), (date(2024, 1, 2),), (date(2024, 1, 3),)], "trade_date date")
    path = str(tmp_path / "curated")
    stores.write_years(days, path)
    stores.write_years(days.where("year(trade_date) = 2024").limit(2), path)
    assert spark.read.parquet(path).count() == 3
    assert [r.year for r in stores.stale_years(days, days.where("trade_date <> date'2024-01-03'")).collect()] == [2024]
    stores.append_log(days, str(tmp_path / "log"))
    stores.append_log(days, str(tmp_path / "log"))
    assert m.log_rows(spark, str(tmp_path / "log"), "trade_date date").count() == 6
    with pytest.raises(stores.ImmutableError, match="already exists"):
        stores.write_raw(days, path)


def test_paths_and_windows(spark, tmp_path):
    old, new = date(2020, 3, 5), date(2024, 7, 5)
    assert m.remote_path(old) == "content/historical/EQUITIES/2020/MAR/cm05MAR2020bhav.csv.zip" and m.remote_path(new) == "content/cm/BhavCopy_NSE_CM_0_0_0_20240705_F_0000.csv.zip"
    assert m.remote_path(old, "fo").endswith("DERIVATIVES/2020/MAR/fo05MAR2020bhav.csv.zip") and m.remote_path(old, "index") == "content/indices/ind_close_all_05032020.csv"
    assert m.relative_path(old, "index") == "indexclose/2020/ind_close_all_05032020.csv" and m.month_path(old, "announcements") == "events/announcements/2020/ann_202003.json"
    assert m.month_window(date(2024, 2, 9)) == ("01-02-2024", "29-02-2024") and m.month_window(date(2023, 12, 31)) == ("01-12-2023", "31-12-2023")
    for d in (old, new):
        put(tmp_path, m.snapshot_path(d, "renames").split("/")[1], "A,B,C,1-JAN-2020\n")
    assert m.newest(spark, str(tmp_path / "symbolchange_*.csv")).endswith("symbolchange_2024-07-05.csv")
    with pytest.raises(Exception, match="(?i)path.not.*exist|no-such"):
        m.newest(spark, str(tmp_path / "no-such-*.csv"))


def test_year_reader_prunes(spark, tmp_path):
    days = spark.createDataFrame([(date(y, 1, 2), y) for y in (2021, 2022, 2023)], "trade_date date, v int")
    stores.write_years(days, str(tmp_path / "t"))
    some = stores.read_years(spark, str(tmp_path / "t"), 2022, 2022)
    assert [(r.trade_date, r.v) for r in some.collect()] == [(date(2022, 1, 2), 2022)]
    assert "PartitionFilters: [isnotnull(year" in some._jdf.queryExecution().executedPlan().toString()
    assert stores.read_years(spark, str(tmp_path / "t")).count() == 3


def test_ledger_reports_and_reruns(spark, tmp_path):
    trials = spark.createDataFrame([("ridge", 0.1)], "model string, mean_ic double")
    assert stores.trial_count(spark, str(tmp_path / "ledger")) == 0
    stores.append_log(trials, str(tmp_path / "ledger"))
    stores.append_log(trials, str(tmp_path / "ledger"))
    assert stores.trial_count(spark, str(tmp_path / "ledger")) == 2
    for kind, read in (("parquet", spark.read.parquet), ("json", spark.read.json), ("csv", lambda p: spark.read.option("header", True).csv(p))):
        for _ in range(2):
            stores.write_report(trials, str(tmp_path / kind), kind)
        assert [r.model for r in read(str(tmp_path / kind)).collect()] == ["ridge"]
    log = spark.createDataFrame([(date(2024, 1, 1), False), (date(2024, 1, 2), True)], "trade_date date, dry_run boolean")
    days = spark.createDataFrame([(date(2024, 1, k),) for k in (1, 2, 3)], "trade_date date")
    assert sorted(r.trade_date.day for r in stores.not_yet_run(days, log).collect()) == [2, 3]


def test_settings(monkeypatch):
    from tidemark.session import settings

    monkeypatch.setenv("TIDEMARK_DATA", "/data/x/")
    assert (settings().raw, settings().curated, settings().reports) == ("/data/x/raw", "/data/x/curated", "/data/x/reports")
    monkeypatch.delenv("TIDEMARK_DATA")
    assert settings().root.endswith("/tidemark-data")
