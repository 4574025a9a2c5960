"""Seeded inputs for tests and demonstrations."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.streaming.codec import encode
from tradeloom.streaming.registry import Registry

START_MS = 1_772_366_400_000  # 2026-03-01 12:00 UTC


def unit_rows(spark: SparkSession, n: int = 50) -> DataFrame:
    """n regular trades of three symbols, 2 s apart."""
    i = F.col("id")
    sym = F.element_at(F.array(F.lit("BTCUSDT"), F.lit("ETHUSDT"), F.lit("SOLUSDT")), (i % 3 + 1).cast("int"))
    price = F.element_at(F.array(F.lit(65000.0), F.lit(3500.0), F.lit(150.0)), (i % 3 + 1).cast("int")) + i * 0.5
    x = spark.range(1, n + 1).select(i.alias("trade_id"), sym.alias("symbol"), price.alias("price"), (F.lit(0.1) + i * 0.01).alias("quantity"), F.timestamp_millis(F.lit(START_MS) + i * 2000).alias("trade_timestamp"), (i % 2 == 0).alias("is_buyer_maker"))
    return x.withColumn("quote_quantity", F.col("price") * F.col("quantity"))


def stream_frames(registry: Registry, total: int = 150, late: int = 10, poison: int = 5, start_ms: int = START_MS, seed: int = 42) -> list[bytes]:
    """Frames in order of arrival: versions alternate, every so many 3 or 25 s late, and frames of five kinds of poison."""
    rng = random.Random(seed)
    out = []
    for i in range(total):
        back = 0 if not late or i % max(1, total // late) else (3000 if i % 2 else 25_000)
        row = {"trade_id": i + 1, "symbol": ("BTCUSDT", "ETHUSDT", "SOLUSDT")[i % 3], "price": round(100 + rng.random() * 10, 2), "quantity": round(0.1 + rng.random(), 4), "quote_quantity": 0.0, "trade_timestamp": start_ms + i * 300 - back, "is_buyer_maker": i % 2 == 0, "trade_type": "LIMIT"}
        row["quote_quantity"] = row["price"] * row["quantity"]
        out.append(encode(registry, 1 + i % 2, row))
    good = encode(registry, 1, {"trade_id": 1, "symbol": "BTCUSDT", "price": -1.0, "quantity": 1.0, "quote_quantity": 1.0, "trade_timestamp": start_ms, "is_buyer_maker": False})
    bad = [b"\x01" + good[1:], b"\x00\x7f\xff\xff\xff" + good[5:], good[:3], good, good[:7]]
    for k in range(poison):
        out.insert((k + 1) * max(1, total // (poison + 1)), bad[k % len(bad)])
    return out


def change_events(inserts: int = 100, updates: int = 15, deletes: int = 5, poison: int = 5, seed: int = 42) -> list[str]:
    """Change envelopes as JSON text: inserts, updates of half a percent, deletes and broken ones."""
    import json

    rng = random.Random(seed)
    row = lambda i: {"trade_id": i, "symbol": ("BTCUSDT", "ETHUSDT", "SOLUSDT")[i % 3], "price": round(100 + rng.random(), 4), "quantity": 1.0}
    base = [row(i + 1) for i in range(inserts)]
    env = lambda op, before, after, n: json.dumps({"op": op, "before": before, "after": after, "ts_ms": START_MS + n, "source": {"lsn": n}})
    out = [env("c", None, r, n) for n, r in enumerate(base)]
    out += [env("u", r, {**r, "price": round(r["price"] * 1.005, 4)}, 1000 + n) for n, r in enumerate(base[:updates])]
    out += [env("d", r, None, 2000 + n) for n, r in enumerate(base[-deletes:] if deletes else [])]
    for k in range(poison):
        broken = [{**base[0], "price": -1.0}, {**base[0], "trade_id": None}, {**base[0], "price": 9e9}][k % 3]
        out.append(env("c", None, broken, 3000 + k))
    return out


def stress_rows(spark: SparkSession, n: int = 100_000, seed: int = 42) -> DataFrame:
    """All-text rows: 5 % of keys again (some repriced), 3 % noisy symbols, 2 % scientific numbers, in random order."""
    i = F.col("id")
    h = lambda k: F.pmod(F.xxhash64(i, F.lit(k), F.lit(seed)), F.lit(1000))
    key = F.when(h(1) < 50, F.pmod(F.xxhash64(i, F.lit(9)), F.lit(n))).otherwise(i)
    price = F.round(100 + F.pmod(F.xxhash64(key), F.lit(10_000)) / 100, 2) * F.when((h(1) < 15), 1.001).otherwise(1.0)
    sym = F.element_at(F.array(F.lit("BTCUSDT"), F.lit("ETHUSDT"), F.lit("SOLUSDT")), (F.pmod(key, F.lit(3)) + 1).cast("int"))
    text = F.when(h(2) < 20, F.format_string("%e", price)).otherwise(price.cast("string"))
    return spark.range(n).select(key.cast("string").alias("trade_id"), F.when(h(3) < 30, F.concat(F.lit("  "), F.lower(sym), F.lit(" "))).otherwise(sym).alias("symbol"), text.alias("price"), F.lit("0.5").alias("quantity"), F.lit("").alias("quote_quantity"), F.lit("2026-03-01T00:00:00+00:00").alias("trade_timestamp"), F.lit("True").alias("is_buyer_maker")).orderBy(F.xxhash64("trade_id", "price"))


def steady_stream(n: int = 60, poison: bool = True) -> list[dict[str, object]]:
    """n trades two seconds apart, the symbols in turn, and behind them one whose price is negative."""
    one = lambda i, price: {"trade_id": i + 1, "symbol": ("BTCUSDT", "ETHUSDT", "SOLUSDT")[i % 3], "price": price, "volume": 0.25, "event_time": START_MS + 2000 * i}
    return [one(i, 100.0 + i / 4) for i in range(n)] + ([one(n, -3.0)] if poison else [])


def sample_trades(spark: SparkSession, symbol: str, n: int, price: float, seed: int = 42, spread: float = 0.02) -> DataFrame:
    """Made-up trades around a price, within ``spread`` of it. Nothing falls back to them: they are there for a caller who asks."""
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_001)) / 1_000_000
    p = F.round(F.lit(price) * (1 - spread + 2 * spread * u), 8)
    x = spark.range(1, n + 1).select(F.col("id").alias("trade_id"), F.lit(symbol).alias("symbol"), p.alias("price"), F.round(u + 0.001, 8).alias("quantity"), F.timestamp_millis(F.lit(START_MS) + F.col("id") * 1000).alias("trade_timestamp"), (F.col("id") % 2 == 0).alias("is_buyer_maker"))
    return x.withColumn("quote_quantity", F.col("price") * F.col("quantity"))
