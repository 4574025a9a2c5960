"""Runs of the stream pipeline: one pass with an audit, a schedule, and a live pull through the same frames."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.streaming import codec, dlq, pipeline
from tradeloom.streaming.metrics import Metrics
from tradeloom.streaming.registry import Registry


def audited(frames: DataFrame, payload: str, seq: str, registry: Registry, out: str, metrics: Metrics | None = None, topic: str = "market.trades", window_ms: int = pipeline.WINDOW_MS, delay_ms: int = pipeline.DELAY_MS) -> dict[str, Any]:
    """Frames to candles, late rows and dead letters under ``out``; returns the audit.

    The audit counts this run alone: frames read, processed, rejected by code, late, candles written. Late rows are counted
    by the metrics as quarantined. The folders candles and late are replaced, letters are appended.
    """
    spark = frames.sparkSession
    pipeline.checked(frames, payload, seq, registry).write.mode("overwrite").parquet(f"{out}/decoded")
    rows = spark.read.parquet(f"{out}/decoded")
    candles, late = pipeline.exact_candles(rows, seq, window_ms, delay_ms)
    candles.write.mode("overwrite").parquet(f"{out}/candles")
    late.write.mode("overwrite").parquet(f"{out}/late")
    bad = rows.where("error_code is not null")
    dlq.append(dlq.letters(bad, topic, "error_code", "error", "raw"), f"{out}/dlq")
    codes = {r["error_code"]: r["n"] for r in dlq.summary(bad).collect()}
    read = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("b")).first()
    lates = {r["symbol"]: r["n"] for r in spark.read.schema(late.schema).parquet(f"{out}/late").groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).collect()}
    good = {r["symbol"]: r["n"] for r in rows.where("error_code is null").groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).collect()}
    windows = {r["symbol"]: r["n"] for r in spark.read.schema(candles.schema).parquet(f"{out}/candles").groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).collect()}
    if metrics:
        metrics.add("stream_bytes_total", read["b"] or 0)
        for s, n in good.items():
            metrics.add("stream_events_total", n - lates.get(s, 0), symbol=s, status="processed")
        for s, n in lates.items():
            metrics.add("stream_events_total", n, symbol=s, status="quarantined")
        for c, n in codes.items():
            metrics.add("stream_dlq_total", n, code=c)
        for s, n in windows.items():
            metrics.add("stream_windows_total", n, symbol=s)
    total_late = sum(lates.values())
    return {"frames": read["n"], "processed": sum(good.values()) - total_late, "late": total_late, "rejected": codes, "candles": sum(windows.values())}


def live(spark: SparkSession, pull: Callable[[str], Iterable[dict[str, Any]]], symbols: list[str], registry: Registry, schema_id: int, rounds: int, pause: float = 0.0) -> DataFrame:
    """(seq, payload): trades that ``pull`` gives for each symbol, framed as the stream carries them. Trades seen in an earlier
    round are not framed again. The rows of a few pulls pass through the driver, as they come from an interface there."""
    seen: set[tuple[str, int]] = set()
    out: list[tuple[int, bytearray]] = []
    for n in range(rounds):
        for s in symbols:
            for row in pull(s):
                key = (s, int(row["trade_id"]))
                if key not in seen:
                    seen.add(key)
                    out.append((len(out), bytearray(codec.encode(registry, schema_id, {**row, "symbol": s}))))
        if pause and n + 1 < rounds:
            time.sleep(pause)
    return spark.createDataFrame(out, "seq long, payload binary")


def scheduled(job: Callable[[int], Any], every_s: float, stop: threading.Event, rounds: int | None = None, failed: Callable[[Exception], None] | None = None) -> int:
    """Run ``job`` every ``every_s`` seconds until ``stop`` is set (by a signal handler, say); returns the number of runs.

    A run that fails is reported and the next one still comes; a run longer than the pause is followed at once. For a
    stream the same is ``trigger(processingTime=...)``.
    """
    n = 0
    while not stop.is_set() and (rounds is None or n < rounds):
        began = time.monotonic()
        try:
            job(n)
        except Exception as e:  # noqa: BLE001 the schedule outlives a failed run
            if failed:
                failed(e)
        n += 1
        if rounds is None or n < rounds:
            stop.wait(max(0.0, every_s - (time.monotonic() - began)))
    return n
