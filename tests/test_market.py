"""Market operators against golden values and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import blocks, indicators, lake, marts, merge, quality, retention, slices
from tradeloom.sources import files, fixtures, rest

RAW = "symbol string, trade_id string, price string, quantity string, quote_quantity string, trade_timestamp string, is_buyer_maker string"


@pytest.fixture(scope="module")
def unit(spark):
    return fixtures.unit_rows(spark).cache()


def test_daily_golden(unit):
    x = unit.withColumns({"partition_year": F.lit(2026), "partition_month": F.lit(3), "partition_day": F.lit(1)})
    t = marts.deduplicated(marts.staged(x.union(x)))
    got = {r["symbol"]: r for r in marts.daily_metrics(t).collect()}
    assert sum(r["trade_count"] for r in got.values()) == 50
    # ids with id % 3 = 0 (BTCUSDT): 3, 6, ..., 48
    ids = range(3, 51, 3)
    q, p = [0.1 + i * 0.01 for i in ids], [65000 + i * 0.5 for i in ids]
    assert got["BTCUSDT"]["base_volume"] == pytest.approx(sum(q))
    assert got["BTCUSDT"]["vwap"] == pytest.approx(sum(a * b for a, b in zip(p, q, strict=True)) / sum(q), abs=1e-4)
    assert (got["BTCUSDT"]["maker_count"], got["BTCUSDT"]["taker_ratio"]) == (8, 50.0)
    dim = marts.assets(t)
    assert {(r["symbol"], r["base_asset"], r["quote_asset"]) for r in dim.collect()} == {("BTCUSDT", "BTC", "USDT"), ("ETHUSDT", "ETH", "USDT"), ("SOLUSDT", "SOL", "USDT")}
    assert marts.facts(t, dim).count() == 50
    assert marts.orphans(t, dim.where("symbol <> 'BTCUSDT'"), "symbol").count() == 16


def test_staging_nulls(spark):
    df = spark.createDataFrame([(None, "A", 1.0, 1.0), (1, None, 1.0, 1.0), (2, "A", None, 1.0), (3, " a\t", 0.0, 1.0), (4, " a\t", 1.0, 1.0)], "trade_id long, symbol string, price double, quantity double")
    x = df.withColumns({c: F.lit(None).cast(t) for c, t in {"quote_quantity": "double", "trade_timestamp": "timestamp", "is_buyer_maker": "boolean", "partition_year": "int", "partition_month": "int", "partition_day": "int"}.items()})
    assert [(r["trade_id"], r["symbol"]) for r in marts.staged(x).orderBy("trade_id").collect()] == [(1, None), (4, "A")]
    assert marts.daily_metrics(marts.deduplicated(marts.staged(x.where("false")))).count() == 0


def test_sanitize(spark):
    data = [
        ("  btcusdt  ", "1", "3.55e3", "1", "", "1772452800000", "T"), ("BTCUSDT", "-5", "1", "1", "", "1772452800000", "no"), ("BTCUSDT", "1", "-100", "1", "", "1772452800000", ""), ("BTCUSDT", "12.0", "1", "1", "", "1772452800000", ""),
        ("BTCUSDT", "1_000", "1", "1", "", "1772452800000", ""), ("BTCUSDT", "1", "nan", "1", "", "1772452800000", ""), ("BTCUSDT", "1", "1", "inf", "", "1772452800000", ""), ("BTCUSDT", "1", "1", "1", "x", "1772452800000", ""),
        ("BTCUSDT", "1", "2", "3", "0", "2026-03-01T12:00:00+05:30", "yes"), ("BTCUSDT", "1", "2", "3", "", "yesterday", ""), (None, "1", "2", "3", "", "1", ""), ("X" * 21, "1", "2", "3", "", "1", ""), ("B", None, None, None, None, None, None),
    ]
    got = quality.sanitized(spark.createDataFrame(data, RAW)).collect()
    assert [r["reject_reason"] for r in got] == [None, "trade_id", "price", "trade_id", "trade_id", "price", "quantity", "quote_quantity", None, "trade_timestamp", "symbol", "symbol", "trade_id"]
    assert (got[0]["symbol"], got[0]["price"], got[0]["quote_quantity"], got[0]["is_buyer_maker"], len(got[0]["record_hash"])) == ("BTCUSDT", 3550.0, 3550.0, True, 64)
    assert (got[8]["quote_quantity"], got[8]["trade_timestamp"].isoformat()) == (0.0, "2026-03-01T06:30:00")


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running_max_and_previous(spark, block):
    r = random.Random(block)
    data = [(i, r.choice("ab"), r.choice([None, r.randint(0, 99)])) for i in range(80)]
    df = spark.createDataFrame(data, "seq long, k string, v int").repartition(3)
    top, want = None, {}
    for i, _, v in data:
        top = v if top is None else top if v is None else max(top, v)
        want[i] = top
    assert {x["seq"]: x["m"] for x in blocks.running_max(df, "seq", F.col("v"), "m").collect()} == want
    before, wantp = {}, {}
    for i, k, v in data:
        wantp[i] = before.get(k)
        before[k] = v
    assert {x["seq"]: x["p"] for x in blocks.previous_in_key(df, ["k"], "seq", "v", "p").collect()} == wantp


@pytest.mark.parametrize("seed", range(3))
def test_merges(spark, seed):
    r = random.Random(seed)
    base = [("A", k, 1.0) for k in range(3)]
    ev = [(i, r.choice(["insert", "update", "delete"]), "A", r.randint(0, 5), float(i)) for i in range(40)]
    state, n = {b[:2]: b[2] for b in base}, {"added": 0, "updated": 0, "deleted": 0}
    for _, op, s, k, v in ev:
        if op == "delete":
            n["deleted"] += state.pop((s, k), None) is not None
        else:
            n["added" if op == "insert" or (s, k) not in state else "updated"] += 1
            state[(s, k)] = v
    b = spark.createDataFrame(base, "symbol string, trade_id long, price double")
    e = spark.createDataFrame(ev, "seq long, op string, symbol string, trade_id long, price double").repartition(3)
    key = ["symbol", "trade_id"]
    assert {(x[0], x[1]): x[2] for x in merge.ordered_merge(b, e, key, "seq", "op").collect()} == state
    assert merge.merge_counts(b, e, key, "seq", "op").first().asDict() == {**n, "total": len(state)}


def test_hash_guard(spark):
    ddl = "symbol string, trade_id long, price double, record_hash string, created_at timestamp, updated_at timestamp"
    t = spark.createDataFrame([("A", 1, 1.0, "x", None, None), ("A", 2, 2.0, "y", None, None)], ddl)
    b = spark.createDataFrame([("A", 1, 9.0, "x", 1), ("A", 2, 8.0, "z", 1), ("A", 2, 7.0, "w", 2), ("A", 3, 3.0, "v", 1), (None, 4, 1.0, "q", 1)], "symbol string, trade_id long, price double, record_hash string, seq int")
    got = merge.hash_guarded_upsert(t, b, ["symbol", "trade_id"], "record_hash", ["seq"], F.lit("2026-01-01").cast("timestamp")).orderBy("trade_id").collect()
    assert [(r["trade_id"], r["price"], r["__action"], r["created_at"] is None) for r in got] == [(1, 1.0, "keep", True), (2, 7.0, "update", True), (3, 3.0, "insert", False)]


def test_rolling_vwap(spark):
    df = spark.createDataFrame([("B", 0, 60000.0, 1.0), ("B", 3600, 62000.0, 1.0), ("B", 7201, 100.0, 2.0), ("B", 7201, 200.0, 2.0), ("E", 5, 3000.0, 1.0), ("E", None, 1.0, 1.0)], "symbol string, s long, price double, quantity double")
    got = sorted((r["symbol"], r["s"], r["price"], r["rolling_vwap"]) for r in indicators.rolling_vwap(df, "symbol", "s", 3600, 3600).collect())
    assert got == [("B", 0, 60000.0, 60000.0), ("B", 3600, 62000.0, 61000.0), ("B", 7201, 100.0, 150.0), ("B", 7201, 200.0, 150.0), ("E", 5, 3000.0, 3000.0)]


def test_ema_and_latest(spark):
    xs = [1.0, 5.0, 2.0, 8.0]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(xs)], "symbol string, window_start int, close_price double")
    got = [(r["window_start"], r["ema_3"]) for r in indicators.latest_with_ema(df, n=3, spans=(3,)).orderBy("window_start").collect()]
    y, want = xs[1], [(1, xs[1])]
    for i in (2, 3):
        y = 0.5 * xs[i] + 0.5 * y
        want.append((i, y))
    assert got == want


def test_book(spark):
    df = spark.createDataFrame([("A", '{"bids": [["9", "1"], ["8", "3"]], "asks": [["11", "2"]]}'), ("B", "broken")], "symbol string, body string")
    book = indicators.parse_book(df, "body", ["symbol"])
    m = indicators.book_metrics(book).first()
    assert (m["best_bid"], m["best_ask"], m["spread"], m["mid"], m["bid_total"]) == (9.0, 11.0, 2.0, 10.0, 4.0)
    assert [r["cumulative"] for r in indicators.cumulative_depth(book).where("side = 'bid'").orderBy(F.desc("price")).collect()] == [1.0, 4.0]


def test_gate_and_debezium(spark):
    ev = spark.createDataFrame([(m,) for m in [*fixtures.change_events(), "junk", '{"op": "z"}']], "m string")
    x = quality.debezium(ev, "m", [], "trade_id: bigint, symbol: string, price: double, quantity: double")
    assert x.count() == 127
    parsed = x.where("op_type is not null")
    assert parsed.count() == 123
    bad = F.size(quality.violations(F.col("op_type"), F.col("symbol"), F.col("trade_id"), F.col("row.price"), F.col("row.quantity"))) > 0
    assert parsed.where(bad).count() == 4 - 1


def test_stream_validation(spark):
    df = spark.createDataFrame([("btcusdt", 1.0, 1.0, 1.7e9), ("XX", -1.0, 1.0, 1.7e12), ("BTCUSDT", -500.0, 0.0, None), ("BTCUSDT", 1.0, None, 1.0), (None, 1.0, 1.0, 1.0)], "symbol string, price double, volume double, event_time double")
    got = [(r["error"], r["event_ms"]) for r in quality.validated_stream(df, ["BTCUSDT"]).collect()]
    assert got == [(None, 1_700_000_000_000), ("Unknown symbol", 1_700_000_000_000), ("Price must be positive", None), ("Volume must be positive", 1000), ("Unknown symbol", 1000)]


def test_checks(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "z")], "k int, v string")
    got = quality.checks(df, ["k"], ["k"], {"v": ["a", "b"]}, {"v": (df.where("v = 'a'"), "v")})
    assert rows(got) == [("accepted:v", 1), ("not_null:k", 1), ("refers:v", 2), ("unique:k", 1)]


def test_lake(spark, tmp_path, unit):
    p = str(tmp_path / "lake")
    lake.write_trades(unit, p)
    assert (tmp_path / "lake/year=2026/month=03/day=01/symbol=BTCUSDT").is_dir()
    x = lake.read_trades(spark, p)
    assert x.count() == 50
    assert "PartitionFilters: [isnotnull(symbol" in x.where("symbol = 'BTCUSDT'")._jdf.queryExecution().toString()
    s = lake.stats(spark, p)
    assert s["symbols"] == 3 and s["files"] >= 3
    one = str(tmp_path / "lake/year=2026/month=03/day=01/symbol=BTCUSDT")
    lake.write_trades(unit, p)
    r = lake.compact_directory(spark, one, str(tmp_path / "compact"))
    assert r["files_after"] == 1 and spark.read.parquet(str(tmp_path / "compact")).count() == 32
    assert lake.compact_directory(spark, str(tmp_path / "none"), str(tmp_path / "x"))["files_before"] == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("trade_id,symbol,price,quantity,quote_quantity,trade_timestamp,is_buyer_maker\n1,A,1,1,1,2026-03-01,True\n")
    x = files.csv_text(spark, str(tmp_path / "a.csv"))
    assert x.first()["trade_id"] == "1"
    assert dict(files.csv_typed(spark, str(tmp_path / "a.csv")).dtypes)["trade_id"] == "int"
    body = '[{"id": 1, "price": "65100.50", "qty": "0.5", "quoteQty": "", "time": 1772452800000, "isBuyerMaker": true, "isBestMatch": true}]'
    t = rest.trades(spark.createDataFrame([(body, " btcusdt ")], "b string, s string"), "b", "s").first()
    assert (t["trade_id"], t["symbol"], t["price"], t["quantity"], t["quote_quantity"]) == (1, "BTCUSDT", 65100.5, 0.5, 32550.25)
    k = rest.klines(spark.createDataFrame([('[[1000, "1", "3", "0.5", "2", "10", 60999, "25", 7, "4", "8"]]', "a")], "b string, s string"), "b", "s").first()
    assert (k["open_price"], k["vwap"], k["trade_count"], k["taker_volume_ratio"]) == (1.0, 2.5, 7, 40.0)
    waits, answers = [], iter([(429, {"Retry-After": "3"}, ""), (500, {}, ""), (200, {}, "ok")])
    assert rest.with_retries(lambda: next(answers), sleep=waits.append) == "ok"
    assert 3 <= waits[0] < 4 and waits[1] == 1.5
    with pytest.raises(RuntimeError):
        rest.with_retries(lambda: (500, {}, ""), sleep=waits.append)
    assert fixtures.stress_rows(spark, 200).count() == 200


def test_retention(spark):
    df = spark.createDataFrame([("2026-01-01",), ("2026-03-01",), ("bad",), (None,)], "t string")
    old, kept = retention.split_by_age(df, "t", F.lit("2026-02-01").cast("timestamp"))
    assert (old.count(), kept.count()) == (1, 3)
    n, kept = retention.sweep({"x": (df, "t", 24)}, F.lit("2026-03-01 12:00:00").cast("timestamp"))["x"]
    assert (n, kept.count()) == (1, 3)


def test_candle_ties(spark):
    df = spark.createDataFrame([("A", 2, 10.0, 1.0, 0), ("A", 1, 20.0, 1.0, 0), ("A", 3, 30.0, 2.0, 59_999)], "symbol string, trade_id long, price double, quantity double, ms long")
    x = df.select("*", F.lit(None).cast("double").alias("quote_quantity"), F.lit(False).alias("is_buyer_maker"), F.timestamp_millis("ms").alias("__event"))
    c = slices.compose(slices.panes(x, ["symbol"], 60_000), ["symbol"], 60_000).first()
    assert (c["open_price"], c["close_price"], c["high_price"], c["low_price"], c["vwap"], c["taker_buy_ratio"]) == (20.0, 30.0, 30.0, 10.0, 22.5, 100.0)
