"""Candles of a time range from the lake, deterministic and apart from the live ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.operators import slices


def backfill(lake: DataFrame, start_ms: int, end_ms: int, symbol: str | None = None, window_ms: int = 60_000) -> DataFrame:
    """Candles of trades from start to end, both included. Filters on year, month and day prune the directories first.

    lake: trade_id, symbol, price, quantity, quote_quantity, trade_timestamp, is_buyer_maker and, if there, year, month,
    day. A range without trades gives no candles; nothing is made up.
    """
    x = lake
    if {"year", "month", "day"} <= set(lake.columns):
        day = F.make_date(*[F.col(c).cast("int") for c in ("year", "month", "day")])
        # a day of slack: paths may follow another clock than UTC
        x = x.where(day.between(F.date_from_unix_date(F.lit(start_ms // 86_400_000 - 1).cast("int")), F.date_from_unix_date(F.lit(end_ms // 86_400_000 + 1).cast("int"))))
    at = F.col("trade_timestamp")
    at = F.try_to_timestamp(at) if dict(lake.dtypes)["trade_timestamp"] == "string" else at.cast("timestamp")
    x = x.withColumn("__event", at).where(F.unix_millis("__event").between(start_ms, end_ms))
    if symbol is not None:
        x = x.where(F.col("symbol") == symbol)
    return slices.compose(slices.panes(x, ["symbol"], window_ms), ["symbol"], window_ms).orderBy("window_start_ms", "symbol")


def run(lake: DataFrame, target: str, start_ms: int, end_ms: int, dry_run: bool = True, **kw) -> dict[str, object]:
    """Count only, or write to a target of its own."""
    c = backfill(lake, start_ms, end_ms, **kw)
    if dry_run:
        return {"status": "DRY_RUN", "candles": c.count()}
    c.withColumn("backfilled_at", F.current_timestamp()).write.mode("overwrite").parquet(target)
    return {"status": "COMMITTED", "candles": lake.sparkSession.read.parquet(target).count()}
