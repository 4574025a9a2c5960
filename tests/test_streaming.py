"""Frames, registry, candles of streams, snapshot table."""

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import semantic
from tradeloom.operators.table import Conflict, SnapshotTable
from tradeloom.sources import fixtures
from tradeloom.streaming import backfill, codec, dlq, metrics, pipeline, run
from tradeloom.streaming.registry import SUBJECT, TRADE_V1, TRADE_V2, IncompatibleSchema, Registry, check_backward

BASE = 1_789_300_000_000
ROW = {"trade_id": 1, "symbol": "BTCUSDT", "price": 60000.0, "quantity": 1.0, "quote_quantity": 60000.0, "trade_timestamp": BASE, "is_buyer_maker": False}


def test_round_trip_and_evolution():
    reg = Registry()
    data = codec.encode(reg, 1, ROW)
    assert data[0] == 0 and codec.decode(reg, data) == (1, ROW)
    assert codec.decode(reg, data, 2)[1]["trade_type"] == "MARKET"
    v2 = codec.encode(reg, 2, {**ROW, "trade_type": None, "trade_id": -(2**40)})
    assert codec.decode(reg, v2)[1] == {**ROW, "trade_type": None, "trade_id": -(2**40)}
    assert reg.latest(SUBJECT) == (2, TRADE_V2) and reg.register(SUBJECT, TRADE_V1) == 1
    with pytest.raises(IncompatibleSchema):
        check_backward({"fields": [*TRADE_V1["fields"], {"name": "new", "type": "long"}]}, TRADE_V1)
    for bad in (None, b"", b"\xee" + data[1:], b"\x00\x00\x00\x00\x09" + data[5:], data[:9], data[:3]):
        with pytest.raises(codec.BadFrame):
            codec.decode(reg, bad)


def test_columns_are_those_of_the_single_frames():
    import random

    import pyarrow as pa

    reg, r = Registry(), random.Random(2)
    data = []
    for i in range(400):
        row = {**ROW, "trade_id": r.choice([0, -1, 63, 64, 2**62, -(2**63), 2**63 - 1]), "symbol": r.choice(["", "É", "ABCUSDT" * r.randint(1, 30)]), "trade_type": r.choice([None, "", "LIMIT"])}
        x = bytearray(codec.encode(reg, r.choice([1, 2]), row))
        for _ in range(r.choice([0, 0, 1, 3])):
            x[r.randrange(len(x))] = r.randrange(256)
        data.append(r.choice([None, b"", b"\x00" * 4]) if r.random() < 0.05 else bytes(x[: r.randint(0, len(x))] if r.random() < 0.2 else x))
    ids, cols, errors = codec.decode_columns(reg, pa.array([b"skip", *data], pa.binary())[1:], 2)
    names = [f["name"] for f in TRADE_V2["fields"]]
    for i, x in enumerate(data):
        got = (ids[i].as_py(), {n: c[i].as_py() for n, c in zip(names, cols, strict=True)})
        try:
            want = codec.decode(reg, x, 2)
        except codec.BadFrame:
            assert errors[i].as_py() and got == (None, dict.fromkeys(names))
        else:
            assert errors[i].as_py() is None and repr(got) == repr(want)
    assert [len(c) for c in codec.decode_columns(reg, pa.array([], pa.binary()), 2)[1]] == [0] * len(names)


def frames(spark, reg, rows):
    return spark.createDataFrame([(i, bytearray(x) if isinstance(x, bytes) else bytearray(codec.encode(reg, 2, {**ROW, **x}))) for i, x in enumerate(rows)], "seq long, payload binary")


def test_exact_candles_and_dead_letters(spark, tmp_path):
    reg = Registry()
    t = lambda s, p, q, m=False: {"trade_timestamp": BASE + s * 1000, "price": p, "quantity": q, "quote_quantity": p * q, "is_buyer_maker": m}
    good = codec.encode(reg, 2, ROW)
    # BASE lies 40 s into its minute: four trades fall into it, the fifth opens the next one and closes it for the last
    df = frames(spark, reg, [t(-30, 8.0, 2.0), t(-3, 7.0, 1.0, True), t(3, 10.0, 4.0, True), good[:-6], t(11, 9.0, 1.0), {"quantity": 0.0, "trade_timestamp": BASE * 3}, t(40, 9.5, 1.0), t(0, 99.0, 1.0)])
    x = pipeline.checked(df, "payload", "seq", reg).cache()
    assert {r["error_code"]: r["n"] for r in dlq.summary(x.where("error_code is not null")).collect()} == {"DESERIALIZATION_FAILURE": 1, "DOMAIN_CONTRACT_VIOLATION": 1}
    candles, late = pipeline.exact_candles(x, "seq")
    c = candles.where(F.col("window_start_ms") == BASE - 40_000).first()
    assert (c["open_price"], c["high_price"], c["low_price"], c["close_price"], c["base_volume"], c["vwap"], c["trade_count"], c["taker_buy_ratio"]) == (8.0, 10.0, 7.0, 9.0, 8.0, 9.0, 4, 50.0)
    assert [r["seq"] for r in late.collect()] == [7]
    letters = dlq.letters(x.where("error_code is not null"), "market.trades", "error_code", "error", "raw")
    dlq.append(letters, str(tmp_path / "dlq"))
    back = dlq.read(spark, str(tmp_path / "dlq"))
    assert back.count() == 2 and dlq.alerts(back).where("payload like '%N/A%' or payload like '%Schema%'").count() == 2


def test_simulated_stream(spark):
    reg = Registry()
    x = pipeline.checked(frames(spark, reg, fixtures.stream_frames(reg)), "payload", "seq", reg)
    assert x.count() == 155 and x.where("error_code is not null").count() == 5


def test_native_stream(spark, tmp_path):
    reg = Registry()
    for n, part in enumerate([[0, 10], [70], [200]]):
        frames(spark, reg, [{"trade_timestamp": BASE - 40_000 + s * 1000} for s in part]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = pipeline.native_candles(pipeline.checked(spark.readStream.schema("seq long, payload binary").parquet(str(tmp_path / "in")), "payload", "seq", reg)).writeStream
        q.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).format("parquet").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r["window_start_ms"]: r["trade_count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {BASE - 40_000: 2, BASE + 20_000: 1}


def tape(spark, rows):
    t0 = datetime(2026, 3, 1)
    data = [("A", i, 10.0 * i, 1.0, None, False, None if e is None else t0 + timedelta(seconds=e), t0 + timedelta(seconds=g)) for i, e, g in rows]
    return spark.createDataFrame(data, "symbol string, trade_id long, price double, quantity double, quote_quantity double, is_buyer_maker boolean, trade_timestamp timestamp, ingested_at timestamp")


def test_corrected_candles(spark, tmp_path):
    c = pipeline.CorrectedCandles(spark, str(tmp_path / "state"))
    emit = lambda rows, n: sorted((r["window_start_ms"] // 1000 % 86400, r["trade_count"]) for r in c.apply(tape(spark, rows), n).collect())
    assert emit([(1, 0, 1), (2, 30, 31), (3, 70, 71)], 0) == [(0, 2), (60, 1)]
    assert emit([(4, 10, 500), (1, 0, 501), (5, 20, 700), (6, None, 700)], 1) == [(0, 3)]
    assert emit([(4, 10, 500)], 1) == [(0, 3)]  # the last batch again: the same candles
    assert emit([(4, 10, 500)], 0) == []
    assert emit([(7, 130, 140), (2, 30, 600)], 2) == [(120, 1)]


def test_corrected_candles_fail_at_each_step(spark, tmp_path, monkeypatch):
    """A batch that breaks off anywhere and comes again counts once and loses no candle."""
    batches = [[(1, 0, 1), (2, 30, 31)], [(3, 20, 90), (1, 0, 95), (4, 70, 96)]]
    want = sorted((r["window_start_ms"], r["trade_count"]) for r in _fed(spark, pipeline.CorrectedCandles(spark, str(tmp_path / "calm")), batches)[-1].collect())
    steps = ["rows", "changes", "panes", "candles", "save"]
    for n, step in enumerate(steps):
        c = pipeline.CorrectedCandles(spark, str(tmp_path / f"state{n}"))
        c.apply(tape(spark, batches[0]), 0)
        with monkeypatch.context() as m:
            def broken(*args, real=c._write, **kw):
                if args[1] == step:
                    raise OSError("lost")
                return real(*args, **kw)

            m.setattr(c, "_write", broken)
            if step == "save":
                m.setattr(c.state, "save", lambda state: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                c.apply(tape(spark, batches[1]), 1)
        got = [sorted((r["window_start_ms"], r["trade_count"]) for r in c.apply(tape(spark, batches[1]), 1).collect()) for _ in range(2)]
        assert got == [want, want]
        assert c.panes().agg(F.sum("trade_count")).first()[0] == 4


def _fed(spark, c, batches):
    return [c.apply(tape(spark, b), n) for n, b in enumerate(batches)]


def test_corrected_sliding_and_forgetting(spark, tmp_path):
    c = pipeline.CorrectedCandles(spark, str(tmp_path / "s"), window_ms=120_000, slide_ms=60_000, allowed_ms=60_000, stretch_ms=120_000, most_seen=2)
    rows = [[(1, 5, 6)], [(2, 65, 66)], [(3, 130, 131), (9, 400, 135)], [(2, 65, 100), (4, 110, 140)], [(9, 400, 420), (5, 3000, 3001)], [(5, 3000, 3005)]]
    out = _fed(spark, c, rows)
    # a late trade re-emits the two windows over its pane and no other
    assert sorted(r["window_start_ms"] // 60_000 % 1440 for r in out[3].collect()) == [0, 1]
    assert c.panes().agg(F.sum("trade_count")).first()[0] == 6
    assert out[5].count() == 0 and len(c.state.load()["seen"]) <= 2
    with pytest.raises(Conflict):
        c.state.save({"version": 1})


def test_corrected_stream(spark, tmp_path):
    tape(spark, [(1, 0, 1), (2, 30, 31)]).write.parquet(str(tmp_path / "in"))
    c = pipeline.CorrectedCandles(spark, str(tmp_path / "state"))
    src = spark.readStream.schema(tape(spark, []).schema).parquet(str(tmp_path / "in"))
    c.start(src, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r["trade_count"], r["emitted_by"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 0)]


def test_snapshot_table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), "symbol string, trade_id long, price double, quantity double, quote_quantity double, trade_timestamp timestamp, is_buyer_maker boolean")
    assert t.read().count() == 0 and t.version() == 0
    ev = lambda rows: spark.createDataFrame([(*r, 1.0, 1.0, None, True) for r in rows], "seq long, op string, symbol string, trade_id long, price double, quantity double, quote_quantity double, trade_timestamp timestamp, is_buyer_maker boolean")
    key = ["symbol", "trade_id"]
    one = t.apply_changes(ev([(11, "insert", "X", 4, 2.5), (12, "insert", "Y", 4, 7.0), (13, "insert", "Y", 5, 8.0)]), key, "seq", "op")
    assert one["total"] == 3 and one["added"] == 3
    t.apply_changes(ev([(14, "update", "Y", 4, 7.75)]), key, "seq", "op")
    three = t.apply_changes(ev([(15, "delete", "Y", 5, 0.0), (16, "insert", "Z", 1, 1.0)]), key, "seq", "op")
    assert (three["total"], three["deleted"], three["added"]) == (3, 1, 1)
    state = lambda *v: {(r["symbol"], r["trade_id"]): r["price"] for r in t.read(*v).collect()}
    assert state(1) == {("X", 4): 2.5, ("Y", 4): 7.0, ("Y", 5): 8.0} and state() == {("X", 4): 2.5, ("Y", 4): 7.75, ("Z", 1): 1.0}
    assert t.apply_changes(ev([]), key, "seq", "op") == {"status": "SKIPPED"}
    for _ in range(8):
        t.append(t.read(1).where("symbol = 'X'"))
    assert t.version() == 11 and t.read().count() == 11
    assert [r[0] for r in t.history().collect()] == list(range(11, 0, -1))
    assert t.expired(2**50) == list(range(1, 11))
    with pytest.raises(ValueError):
        t.read(99)
    stale = t.metadata() | {"version": 5}
    with pytest.raises(Conflict):
        t._commit(stale, {"snapshot_id": 6, "timestamp_ms": 0, "paths": [], "summary": {"operation": "x"}})
    semantic.register(spark, t)
    assert semantic.query_view(spark, "v_lakehouse_snapshots").count() == 11
    with pytest.raises(ValueError):
        semantic.query_view(spark, "x; drop")


def test_backfill_and_metrics(spark, tmp_path):
    unit = fixtures.unit_rows(spark)
    r = backfill.run(unit, str(tmp_path / "bf"), fixtures.START_MS, fixtures.START_MS + 59_999)
    assert r == {"status": "DRY_RUN", "candles": 3}
    assert backfill.run(unit, str(tmp_path / "bf"), fixtures.START_MS, fixtures.START_MS + 59_999, dry_run=False)["candles"] == 3
    assert backfill.backfill(unit, 0, 1).count() == 0
    m = metrics.Metrics()
    m.add("stream_dlq_total", code="X")
    m.set("stream_watermark_ms", 5)
    assert 'stream_dlq_total{code="X"} 1' in m.text() and "stream_watermark_ms 5" in m.text()


def test_audited_run_and_metrics(spark, tmp_path):
    reg, m = Registry(), metrics.Metrics()
    t = lambda s, **kw: {"trade_timestamp": BASE + s * 1000, **kw}
    df = frames(spark, reg, [t(-30), t(-20, symbol="ETHUSDT"), b"\x07", t(-10, price=-2.0), t(45), t(-5)])
    audit = run.audited(df, "payload", "seq", reg, str(tmp_path / "run"), m)
    assert audit == {"frames": 6, "processed": 3, "late": 1, "rejected": {"DESERIALIZATION_FAILURE": 1, "DOMAIN_CONTRACT_VIOLATION": 1}, "candles": 3}
    assert run.audited(df, "payload", "seq", reg, str(tmp_path / "run"))["candles"] == 3
    server = metrics.serve(m)
    try:
        import urllib.error
        import urllib.request

        at = f"http://127.0.0.1:{server.server_port}"
        text = urllib.request.urlopen(f"{at}/metrics", timeout=5).read().decode()
        assert 'stream_events_total{status="quarantined",symbol="BTCUSDT"} 1' in text and 'stream_dlq_total{code="DESERIALIZATION_FAILURE"} 1' in text
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{at}/other", timeout=5)
    finally:
        server.shutdown()


def test_live_pull_and_schedule(spark):
    reg = Registry()
    pages = {"A": iter([[{**ROW, "trade_id": 1}], [{**ROW, "trade_id": 1}, {**ROW, "trade_id": 2}]]), "B": iter([[], [{**ROW, "trade_id": 1}]])}
    x = run.live(spark, lambda s: next(pages[s]), ["A", "B"], reg, 1, 2)
    got = pipeline.checked(x, "payload", "seq", reg).select("symbol", "trade_id", "error_code").collect()
    assert sorted(tuple(r) for r in got) == [("A", 1, None), ("A", 2, None), ("B", 1, None)]
    seen, wrong = [], []

    def job(n):
        seen.append(n)
        if n == 1:
            raise ValueError("once")

    assert run.scheduled(job, 0.01, threading.Event(), rounds=3, failed=wrong.append) == 3 and seen == [0, 1, 2] and len(wrong) == 1
    stop = threading.Event()
    stop.set()
    assert run.scheduled(job, 0.01, stop) == 0
