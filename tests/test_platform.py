"""Sources, tables, quarantine, retention, lake files and texts."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import text
from tradeloom.functions.clock import normalise_timestamps
from tradeloom.operators import indicators, lake, marts, quality, retention, semantic
from tradeloom.operators.table import SnapshotTable
from tradeloom.sources import fixtures, flight, rest


def test_pages_and_waits(spark):
    rows = [{"id": i, "price": "2.5", "qty": "2", "quoteQty": "", "time": 1000 * i, "isBuyerMaker": True, "isBestMatch": True} for i in range(1, 8)]
    asked, waits, busy = [], [], iter([429, 418])

    def fetch(params):
        asked.append(params)
        if (code := next(busy, 200)) != 200:
            return code, {"Retry-After": "3"}, ""
        return 200, {}, json.dumps([r for r in rows if r["id"] >= params.get("fromId", 1)][: params["limit"]])

    got = list(rest.paged(fetch, limit=3, sleep=waits.append))
    assert [len(json.loads(b)) for b in got] == [3, 3, 1] and [a.get("fromId") for a in asked[2:]] == [None, 4, 7]
    assert all(3 <= w <= 4 for w in waits) and len(waits) == 2
    stuck = lambda p: (200, {}, json.dumps(rows[:3]))
    assert len(list(rest.paged(stuck, limit=3))) == 2
    x = rest.pull(spark, {" a": fetch, "b": fetch}, limit=3)
    assert x.count() == 14 and {r["symbol"] for r in x.collect()} == {"A", "B"}
    with pytest.raises(RuntimeError):
        rest.pull(spark, {"a": lambda p: (500, {}, "")}, sleep=lambda s: None)


def test_tables_seeds_and_views(spark):
    semantic.create_database(spark, "desk")
    try:
        semantic.create_table(spark, "desk.assets", "symbol string, base string")
        semantic.create_table(spark, "desk.assets", "symbol string, base string")
        seeds = spark.createDataFrame([("A", "a"), ("A", "b"), ("B", None), (None, "x")], "symbol string, base string")
        assert [semantic.seed(seeds, "desk.assets", ["symbol"]) for _ in range(2)] == [2, 0]
        out = semantic.create_table_as(seeds.where("symbol is not null"), "desk.copy")
        assert semantic.create_table_as(seeds.where("base is null"), "desk.copy").count() == 1 and out.columns == ["symbol", "base"]
    finally:
        spark.sql("drop database desk cascade")


def test_quarantine_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "price")], "id int, why string")
    assert [r["id"] for r in quality.quarantine(df, "why", str(tmp_path / "q"), "gate").collect()] == [1]
    both = df.withColumn("all", F.when(F.col("why").isNotNull(), F.array("why")).otherwise(F.array().cast("array<string>"))).drop("why")
    assert quality.quarantine(both, "all", str(tmp_path / "q"), "gate").count() == 1
    assert {json.loads(r["row"])["id"] for r in spark.read.json(str(tmp_path / "q")).collect()} == {2} and spark.read.json(str(tmp_path / "q")).count() == 2
    for n in (2, 1):
        quality.write_lines(df.limit(n), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 1


def test_full_sweep(spark, tmp_path):
    now = datetime(2026, 5, 10)
    ago = lambda h: now - timedelta(hours=h)
    trades = spark.createDataFrame([(1, ago(25)), (2, ago(24)), (3, None)], "id int, trade_timestamp timestamp")
    candles = spark.createDataFrame([(1, ago(169)), (2, ago(1))], "id int, window_start timestamp")
    letters = spark.createDataFrame([(1, ago(721)), (2, ago(720)), (3, None)], "id int, failed_at_utc timestamp")
    t = SnapshotTable(spark, str(tmp_path / "t"), "id int")
    for n in range(2):
        t.overwrite(spark.createDataFrame([(n,)], "id int"))
    at = F.timestamp_micros(F.lit(int((now - datetime(1970, 1, 1)).total_seconds()) * 1_000_000))
    r = retention.full_sweep(trades, candles, t, letters, at, str(tmp_path / "old"), str(tmp_path / "kept"))
    assert (r["trades"][0], r["candles"][0], r["letters_archived"], r["letters_kept"], r["expired_snapshots"]) == (1, 1, 1, 2, [])
    assert sorted(x["id"] for x in r["trades"][1].collect()) == [2, 3]
    assert [x["id"] for x in spark.read.json(str(tmp_path / "old")).collect()] == [1]


def test_lake_files_fit_their_rows(spark, tmp_path):
    x = fixtures.unit_rows(spark, 90).repartition(6)
    lake.write_trades(x, str(tmp_path / "a"), rows_per_file=100)
    assert len(lake.file_sizes(spark, str(tmp_path / "a"))) == 3  # one for each symbol
    lake.write_trades(x, str(tmp_path / "b"), rows_per_file=10)
    assert 6 <= len(lake.file_sizes(spark, str(tmp_path / "b"))) <= 15
    got = lake.compact_directory(spark, str(tmp_path / "b"), str(tmp_path / "c"))
    assert got["files_after"] == 3 and lake.read_trades(spark, str(tmp_path / "c")).where("symbol = 'BTCUSDT' and cast(month as int) = 3").count() == 30
    x.coalesce(1).write.parquet(str(tmp_path / "flat"))
    assert lake.compact_directory(spark, str(tmp_path / "flat"), str(tmp_path / "d"))["files_after"] == 1
    assert lake.compact_directory(spark, str(tmp_path / "none"), str(tmp_path / "e"))["files_before"] == 0


def test_eight_decimals_count(spark):
    day = datetime(2026, 1, 1)
    df = spark.createDataFrame([("A", i, 0.00001234, 0.00005, 1e-8, day, False, i) for i in range(3)], "symbol string, trade_id long, price double, quantity double, quote_quantity double, trade_timestamp timestamp, is_buyer_maker boolean, s long")
    r = marts.daily_metrics(df, quantity_digits=8, quote_digits=8, price_digits=8).first()
    assert (r["base_volume"], r["quote_volume"], r["vwap"]) == (0.00015, 3e-8, 0.00001234)
    assert indicators.rolling_vwap(df, "symbol", "s").where("s = 2").first()["rolling_volume"] == 0.00015


def test_long_timestamps(spark):
    zones = spark.createDataFrame([("f", "UTC", "YMD")], "feed string, tz_name string, date_order string")
    long = "2024-05-06T07:08:09.123456789 [America/Argentina/ComodRivadavia]"
    rows = [("f", long), ("f", "2024-05-06T07:08:09Z" + "x" * 5000), ("f", "9" * 200), ("f", "")]
    got = [r["utc_us"] for r in normalise_timestamps(spark.createDataFrame(rows, "feed string, trade_timestamp string"), zones).collect()]
    assert sorted(got, key=str) == [1_714_990_089_123_456, None, None, None]
    count = spark.createDataFrame([("f", "946684800")], "feed string, trade_timestamp string")
    assert [normalise_timestamps(count, zones, **kw).first()["utc_us"] for kw in ({}, {"count_years": (2000, 2001)})] == [None, 946_684_800_000_000]


def test_texts(spark):
    df = spark.createDataFrame([(0, 1234567.891, bytearray(b"\x0f\xa0")), (1536, None, None), (5 << 30, -0.5, bytearray())], "n long, m double, b binary")
    got = [tuple(r) for r in df.select(text.bytes_text(F.col("n")), text.money_text(F.col("m")), text.hex_text(F.col("b"))).collect()]
    assert got == [("0 B", "1,234,567.89", "0fa0"), ("1.50 KB", None, None), ("5.00 GB", "-0.50", "")]
    assert spark.createDataFrame([(datetime(2026, 1, 1, 3, 4, 5, 678000),)], "t timestamp").select(text.clock_text(F.col("t"))).first()[0] == "03:04:05.678"


def test_catalogue_and_fixtures(spark):
    c = flight.Catalogue(most_rows=100)
    c.swap("trades", fixtures.sample_trades(spark, "A", 20, 50.0))
    with pytest.raises(KeyError):
        c.get("nothing")
    with pytest.raises(ValueError):
        c.swap("large", spark.range(101))
    assert c.names() == ["trades"] and all(49 <= p <= 51 for p in c.get("trades")["price"].to_pylist())
    if flight.fl:
        with flight.server(c) as s:
            at = f"grpc://127.0.0.1:{s.port}"
            assert flight.fetch(at, "trades").num_rows == 20
            with flight.fl.connect(at) as client:
                assert [f.total_records for f in client.list_flights()] == [20]
            with pytest.raises(flight.fl.FlightError):
                flight.fetch(at, "nothing")
    x = fixtures.steady_stream(6)
    assert len(x) == 7 and [r["price"] > 0 for r in x] == [True] * 6 + [False]
