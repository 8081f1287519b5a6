"""The exchange archives as a data source, and the join of order and fill streams."""

import zipfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import exchange
from tidemark.sources.market_files import file_name, relative_path
from tidemark.streaming import jobs

OLD = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN,"
NEW = "TradDt,ISIN,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,LastPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd"


def put(root, day, text, name=None):
    path = root / relative_path(day)
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for n in [name] if isinstance(name, str) else name or [file_name(day)[:-4]]:
            z.writestr(n, text)
    return path


def old(day, close="1.5", symbol="AAA"):
    return f"{OLD}\n{symbol},EQ,1,2,1,{close},1.5,1.4,100,150.5,{day:%d-%b-%Y},7,INE1,\n\n"


def new(day, symbol="AAA"):
    return f"{NEW}\n{day:%Y-%m-%d},INE1,{symbol},EQ,1,2,1,1.5,1.5,1.4,100,150.5,7\n"


@pytest.fixture
def folder(spark, tmp_path):
    for d in (date(2019, 12, 30), date(2020, 1, 2), date(2020, 1, 3)):
        put(tmp_path, d, old(d))
    put(tmp_path, date(2024, 7, 8), new(date(2024, 7, 8)))
    (tmp_path / "bhavcopy" / "notes.txt").write_text("not an archive")
    return tmp_path


def test_rows_of_both_formats(spark, folder):
    df = exchange.archives(spark, str(folder))
    assert df.schema.simpleString() == spark.createDataFrame([], exchange.SCHEMA).schema.simpleString()
    rows = df.orderBy("trade_date").collect()
    assert [r.trade_date for r in rows] == [date(2019, 12, 30), date(2020, 1, 2), date(2020, 1, 3), date(2024, 7, 8)]
    assert {tuple(r)[1:] for r in rows} == {("AAA", "EQ", "INE1", 1.0, 2.0, 1.0, 1.5, 1.5, 1.4, 100, 150.5, 7)}


def test_a_date_predicate_opens_only_its_archives(spark, folder):
    """An archive that can't be read harms no query on other days."""
    broken = folder / relative_path(date(2020, 1, 6))
    broken.write_bytes(b"<html>blocked</html>")
    df = exchange.archives(spark, str(folder))
    days = lambda x: sorted(r.trade_date.isoformat() for r in x.collect())
    day = F.col("trade_date")
    assert days(df.where(day == date(2020, 1, 2))) == ["2020-01-02"]
    assert days(df.where((day >= date(2019, 12, 31)) & (day < date(2020, 1, 6)))) == ["2020-01-02", "2020-01-03"]
    assert days(df.where(day > date(2020, 1, 6))) == ["2024-07-08"] and days(df.where(day.isin(date(2019, 12, 30), date(2024, 7, 8)))) == ["2019-12-30", "2024-07-08"]
    assert days(df.where(day == date(2031, 1, 1))) == []
    assert days(df.where((day <= date(2020, 1, 2)) & (F.col("symbol") == "BBB"))) == []
    with pytest.raises(Exception, match="[Zz]ip"):
        df.collect()
    broken.unlink()
    df = exchange.archives(spark, str(folder))
    assert days(df.where(day > date(2020, 1, 6))) == ["2024-07-08"]  # the frame then is used without that predicate
    assert days(df) == ["2019-12-30", "2020-01-02", "2020-01-03", "2024-07-08"] and days(df.where(day > date(2020, 1, 6))) == ["2024-07-08"] and len(days(df)) == 4


def test_bad_records_and_archives(spark, tmp_path):
    read = lambda p, **o: exchange.archives(spark, str(p), **o).collect()
    d = date(2020, 1, 2)
    put(tmp_path / "a", d, old(d, close="n/a"))
    assert read(tmp_path / "a")[0].close is None
    with pytest.raises(Exception, match="is no number"):
        read(tmp_path / "a", mode="failfast")
    put(tmp_path / "b", d, old(d + timedelta(1)))
    with pytest.raises(Exception, match="not dated as their file"):
        read(tmp_path / "b")
    put(tmp_path / "c", d, old(d), ["one.csv", "two.csv"])
    with pytest.raises(Exception, match="holds 2 CSV files"):
        read(tmp_path / "c")
    put(tmp_path / "d", d, "SYMBOL,SERIES\nA,EQ\n")
    with pytest.raises(Exception, match="are missing"):
        read(tmp_path / "d")
    (tmp_path / "e").mkdir()
    assert read(tmp_path / "e") == []
    put(tmp_path / "f", d, OLD)
    assert read(tmp_path / "f") == []


ORDERS = "order_id long, ordered_at timestamp, quantity long, price double"
FILLS = "order_id long, filled_at timestamp, fill_quantity long, fill_price double"
T0 = datetime(2024, 1, 2, 9, 0)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_late_and_missing_fills(spark, tmp_path):
    """File by file: partial fills, a fill past the window, one that comes past the watermark, an order without any."""
    for n, schema in (("orders", ORDERS), ("fills", FILLS)):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / n / "part-0"))
    stream = lambda n, schema: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / n))

    def feed(number, orders=(), fills=()):
        spark.createDataFrame(list(orders), ORDERS).coalesce(1).write.parquet(str(tmp_path / "orders" / f"part-{number}"))
        spark.createDataFrame(list(fills), FILLS).coalesce(1).write.parquet(str(tmp_path / "fills" / f"part-{number}"))
        jobs.drain(jobs.order_fills(stream("orders", ORDERS), stream("fills", FILLS), within="2 hours", late="1 hour"), str(tmp_path / f"out-{number}"), str(tmp_path / "state"))
        try:
            rows = spark.read.option("basePath", str(tmp_path / f"out-{number}")).parquet(str(tmp_path / f"out-{number}")).collect()
        except Exception as e:
            assert "UNABLE_TO_INFER_SCHEMA" in str(e) or "PATH_NOT_FOUND" in str(e)
            rows = []
        return sorted((r.order_id, None if r.filled_at is None else int((r.filled_at - T0).total_seconds() // 60), r.fill_quantity) for r in rows)

    order = lambda k, m: (k, at(m), 10, 100.0)
    fill = lambda k, m, q=10: (k, at(m), q, 101.0)
    assert feed(1, [order(1, 0), order(2, 5), order(3, 10), order(4, 15)], [fill(1, 3, 4), fill(1, 30, 6)]) == [(1, 3, 4), (1, 30, 6)]
    assert feed(2, [order(5, 90)], [fill(2, 124), fill(3, 131)]) == [(2, 124, 10)]  # order 3's fill is a minute past its window
    told = feed(3, [order(6, 600)], [fill(6, 601)])
    assert (6, 601, 10) in told
    told += feed(4, [order(7, 900)], [fill(4, 20), fill(7, 905)])  # order 4's fill is hours late
    told += feed(5, [order(8, 1500)], [fill(8, 1500)])
    assert sorted(told) == [(3, None, None), (4, None, None), (5, None, None), (6, 601, 10), (7, 905, 10), (8, 1500, 10)]


def test_fills_of_orders_at_price_zero(spark, tmp_path):
    """An order at price 0 has no finite slippage: the query goes on and tells what its SQL tells."""
    import math

    import duckdb
    from tidemark.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"""COPY (SELECT k AS event_id, TIMESTAMP '2024-01-01 10:00:00' + to_minutes(CAST(k AS INTEGER)) AS ts, k % 5 AS user_id, 'view' AS event_type, CASE k WHEN 2 THEN 0.0 WHEN 6 THEN NULL ELSE 10.0 + k END::DOUBLE AS value, '' AS props
        FROM range(40) r(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    told = lambda rows: sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows)
    got = told(QUERIES["stream_order_fills"](spark, str(tmp_path)).select("order_id", "n_fills", "delay_s", "slippage_bps").collect())
    assert got == told(con.sql(ORACLE_SQL["stream_order_fills"]).fetchall())
    assert [r[3] for r in got if r[0] == 2] == ["nan"]
