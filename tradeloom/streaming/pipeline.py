"""Framed trades to candles: exact by record, native by micro-batch, and corrected panes for late records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.operators import blocks, slices
from tradeloom.operators.table import Manifests
from tradeloom.streaming import codec
from tradeloom.streaming.registry import Registry

WINDOW_MS, DELAY_MS = 60_000, 5_000
CANDLE = "symbol string, window_start_ms long, window_end_ms long, open_price double, high_price double, low_price double, close_price double, base_volume double, quote_volume double, vwap double, trade_count long, taker_buy_ratio double"
PANE = (
    "symbol string, pane_start_ms long, trade_count long, first struct<k: struct<t: bigint, i: bigint>, v: double>, last struct<k: struct<t: bigint, i: bigint>, v: double>, high_price double, low_price double, "
    "base_volume double, quote_volume double, notional double, takers long"
)
SEEN = "symbol string, trade_id long, until_ms long"


def checked(df: DataFrame, payload: str, seq: str, registry: Registry, reader_id: int = 2) -> DataFrame:
    """Decoded frames with error_code: DESERIALIZATION_FAILURE, DOMAIN_CONTRACT_VIOLATION, or null. Nothing is dropped."""
    x = codec.decode_frames(df.select(seq, F.col(payload).alias("payload"), F.col(payload).alias("raw")), "payload", [seq, "raw"], registry, reader_id)
    bad = F.col("trade_id").isNull() | (F.coalesce("price", F.lit(0.0)) <= 0) | (F.coalesce("quantity", F.lit(0.0)) <= 0)
    code = F.when(F.col("error").isNotNull(), "DESERIALIZATION_FAILURE").when(bad, "DOMAIN_CONTRACT_VIOLATION")
    return x.withColumns({"error_code": code, "error": F.coalesce("error", F.when(bad, "no id, or price or quantity not positive"))})


def exact_candles(rows: DataFrame, seq: str, window_ms: int = WINDOW_MS, delay_ms: int = DELAY_MS) -> tuple[DataFrame, DataFrame]:
    """(candles of all windows, rows too late) by per-record watermark in order of seq; rejected rows never move it."""
    x = blocks.lateness(rows, seq, "trade_timestamp", window_ms, delay_ms, F.col("error_code").isNull()).where("error_code is null")
    ok = x.where("not is_late").withColumn("__event", F.timestamp_millis("trade_timestamp"))
    # ties of event time are settled by arrival
    ok = ok.withColumn("trade_id", F.col(seq).cast("long"))
    return slices.compose(slices.panes(ok, ["symbol"], window_ms), ["symbol"], window_ms), x.where("is_late")


def native_candles(stream: DataFrame, window_ms: int = WINDOW_MS, delay_ms: int = DELAY_MS) -> DataFrame:
    """Append-mode candles with Spark's watermark: lateness is judged by the watermark of the batch before, and a window is
    emitted one batch after the watermark passes it."""
    x = stream.where("error_code is null").withColumn("ts", F.timestamp_millis("trade_timestamp")).withWatermark("ts", f"{delay_ms} milliseconds")
    g = x.groupBy(F.window("ts", f"{window_ms} milliseconds"), "symbol")
    at = F.struct("ts", "trade_id")
    return g.agg(
        F.min_by("price", at).alias("open_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"), F.max_by("price", at).alias("close_price"), F.sum("quantity").alias("base_volume"),
        F.sum(F.col("price") * F.col("quantity")).alias("notional"), F.count(F.lit(1)).alias("trade_count"), F.count_if(~F.col("is_buyer_maker")).alias("takers"),
    ).select("symbol", F.unix_millis("window.start").alias("window_start_ms"), "open_price", "high_price", "low_price", "close_price", "base_volume", F.try_divide("notional", "base_volume").alias("vwap"), "trade_count", (F.col("takers") * 100.0 / F.col("trade_count")).alias("taker_buy_ratio"))


class CorrectedCandles:
    """Micro-batches into panes; late records change their pane, and only windows over changed panes are composed and emitted.

    Rows: symbol, trade_id, price, quantity, quote_quantity, is_buyer_maker, trade_timestamp and ingested_at (timestamps).
    A trade counts once, by the first copy that a batch brings (in a batch, the one that arrived first), if at most
    allowed_ms late. Copies of a trade are taken to bear the same event time: a trade is remembered until no copy of it can be
    in time any more, by its event time or its arrival, whichever is later, with allowed_ms to spare for batches out of order.

    The state is panes by stretches of time (a batch rewrites only the stretches it touches) and the trades seen by batch.
    All that a batch changes becomes valid with one manifest, together with its number and the candles it emits. A batch
    that fails before leaves the state as it was; a batch that comes again after it gives the same candles.
    """

    def __init__(self, spark: SparkSession, root: str, window_ms: int = WINDOW_MS, slide_ms: int | None = None, allowed_ms: int = 600_000, stretch_ms: int = 3_600_000, most_seen: int = 32) -> None:
        self.spark, self.root, self.window, self.slide, self.allowed, self.most_seen = spark, root.rstrip("/"), window_ms, slide_ms, allowed_ms, most_seen
        self.stretch = max(stretch_ms, window_ms)
        self.state = Manifests(spark, f"{self.root}/state")

    def _write(self, df: DataFrame, name: str, *by: str) -> str:
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        return path

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _panes(self, held: dict[str, str], stretches: set[int]) -> DataFrame:
        return self._read(sorted(held[str(s)] for s in stretches if str(s) in held), PANE)

    def panes(self) -> DataFrame:
        """All panes as they are now."""
        return self._read(sorted(self.state.load().get("panes", {}).values()), PANE)

    def apply(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Take a micro-batch in; returns the candles to emit. The batch taken in last gives its candles again, older ones none."""
        now = self.state.load()
        if batch_id <= now.get("batch_id", -1):
            return self._read([now["emitted"]] if batch_id == now["batch_id"] else [], CANDLE)
        by, seen, held = ["symbol"], now.get("seen", []), now.get("panes", {})
        ident = {"symbol": F.upper(F.trim(F.col("symbol"))), "trade_id": F.col("trade_id")}
        values = {c: F.col(c) for c in ("price", "quantity", "quote_quantity", "is_buyer_maker")}
        rows = slices.first_copies(batch, ident, F.col("ingested_at"), F.col("trade_timestamp"), values)
        known = self._read([s["path"] for s in seen], SEEN)
        until = F.greatest(F.unix_millis("__arrived"), F.coalesce(F.unix_millis("__event"), F.lit(-(2**62)))) + 2 * self.allowed
        rows = rows.join(known.select("symbol", "trade_id"), ["symbol", "trade_id"], "left_anti").withColumns({"until_ms": until, "arrived_ms": F.unix_millis("__arrived")})
        taken = self._write(rows, "rows")
        rows = self.spark.read.schema(rows.schema).parquet(taken)
        top, last = rows.agg(F.max("arrived_ms"), F.max("until_ms")).first()
        new = slices.panes(slices.in_time(rows, self.allowed), by, slices.pane_ms(self.window, self.slide)).withColumn("stretch", F.floor(F.col("pane_start_ms") / self.stretch).cast("long"))
        fresh = self._write(new, "changes")
        new = self.spark.read.schema(new.schema).parquet(fresh)
        # as many numbers as the batch touches stretches of time
        touched = {r[0] for r in new.select("stretch").distinct().collect()}
        merged = slices.merge_panes(self._panes(held, touched), new.drop("stretch"), by).withColumn("stretch", F.floor(F.col("pane_start_ms") / self.stretch).cast("long"))
        if touched:
            at = self._write(merged.repartition("stretch", "symbol"), "panes", "stretch")
            held = {**held, **{str(s): f"{at}/stretch={s}" for s in touched}}
        windows = slices.affected_windows(new, by, self.window, self.slide)
        needed = slices.panes_under(windows, by, self.window, self.slide)
        around = {s + i for s in touched for i in (-1, 0, 1)}
        under = self._panes(held, around).join(needed, [*by, "pane_start_ms"], "left_semi")
        out = slices.compose(under, by, self.window, self.slide).join(windows, [*by, "window_start_ms"], "left_semi")
        emitted = self._write(out, "candles")
        newest = max(now.get("newest", -(2**62)), top if top is not None else -(2**62))
        seen = [s for s in [*seen, *([{"path": taken, "until": last}] if last is not None else [])] if s["until"] >= newest]
        if len(seen) > self.most_seen:  # one folder instead of many
            all_seen = self._read([s["path"] for s in seen], SEEN).where(F.col("until_ms") >= newest)
            seen = [{"path": self._write(all_seen, "rows"), "until": max(s["until"] for s in seen)}]
        self.state.save({"version": now["version"], "batch_id": batch_id, "panes": held, "seen": seen, "newest": newest, "emitted": emitted})
        return self._read([emitted], CANDLE)

    def start(self, stream: DataFrame, out: str, checkpoint: str):
        """Run on a stream until its input is used up; each batch has its folder under ``out``, which a repeated batch overwrites."""
        emit = lambda df, i: self.apply(df, i).write.mode("overwrite").parquet(f"{out}/emitted_by={i}")
        return stream.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
