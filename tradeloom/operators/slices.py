"""Event-time windows by stream slicing.

Panes are the non-overlapping slices at window-boundary granularity (the greatest common divisor of window and slide).
Each holds mergeable partial aggregates; a late event changes one pane, and only the windows over it are composed anew.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pane_ms(window_ms: int, slide_ms: int | None = None) -> int:
    return gcd(window_ms, slide_ms or window_ms)


def first_copies(df: DataFrame, ident: dict[str, Column], arrived: Column, event: Column, values: dict[str, Column]) -> DataFrame:
    """One row per identity: the copy that arrived first (ties: the least row, nulls first). Rows without identity or arrival are dropped.

    Columns: the identity's names, __event, __arrived, the values. min over a struct combines before the shuffle.
    """
    x = df.select(*[c.alias(n) for n, c in ident.items()], F.struct(arrived.alias("__arrived"), event.alias("__event"), *[c.alias(n) for n, c in values.items()]).alias("__row"))
    for n in ident:
        x = x.where(F.col(n).isNotNull())
    x = x.where(F.col("__row.__arrived").isNotNull()).groupBy(*ident).agg(F.min("__row").alias("__row"))
    return x.select(*ident, "__row.*")


def in_time(df: DataFrame, allowed_ms: int) -> DataFrame:
    """Rows with an event time that are at most allowed_ms late (events ahead of their arrival are in time)."""
    return df.where(F.col("__event").isNotNull() & (F.unix_micros("__arrived") - F.unix_micros("__event") <= allowed_ms * 1000))


def panes(df: DataFrame, by: list[str], pane: int) -> DataFrame:
    """Partial aggregates per (by, pane_start_ms) of rows with __event, price, quantity, quote_quantity, is_buyer_maker, trade_id."""
    ms = F.floor(F.unix_micros("__event") / 1000).cast("long")
    at = F.struct(F.unix_micros("__event").alias("t"), F.col("trade_id").alias("i"))
    taker = (~F.col("is_buyer_maker")).cast("long")
    return df.withColumn("pane_start_ms", ms - F.pmod(ms, F.lit(pane))).groupBy(*by, "pane_start_ms").agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.min(F.struct(at.alias("k"), F.col("price").alias("v"))).alias("first"), F.max(F.struct(at.alias("k"), F.col("price").alias("v"))).alias("last"),
        F.max("price").alias("high_price"), F.min("price").alias("low_price"),
        F.sum("quantity").alias("base_volume"), F.sum(F.coalesce("quote_quantity", F.col("price") * F.col("quantity"))).alias("quote_volume"),
        F.sum(F.col("price") * F.col("quantity")).alias("notional"), F.coalesce(F.sum(taker), F.lit(0)).alias("takers"),
    )


def merge_panes(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The panes of two disjoint sets of rows as one."""
    return a.unionByName(b).groupBy(*by, "pane_start_ms").agg(
        F.sum("trade_count").alias("trade_count"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("high_price").alias("high_price"), F.min("low_price").alias("low_price"),
        F.sum("base_volume").alias("base_volume"), F.sum("quote_volume").alias("quote_volume"), F.sum("notional").alias("notional"), F.sum("takers").alias("takers"),
    )


def windows_over(p: DataFrame, window_ms: int, slide_ms: int | None = None) -> DataFrame:
    """p with window_start_ms: each pane once for each window that covers it."""
    slide = slide_ms or window_ms
    last = F.col("pane_start_ms") - F.pmod("pane_start_ms", F.lit(slide))
    if slide == window_ms:
        return p.withColumn("window_start_ms", last)
    first = F.col("pane_start_ms") - window_ms + pane_ms(window_ms, slide)
    start = first + F.pmod(-first, F.lit(slide))
    return p.withColumn("window_start_ms", F.explode(F.sequence(start, last, F.lit(slide).cast("long"))))


def compose(p: DataFrame, by: list[str], window_ms: int, slide_ms: int | None = None) -> DataFrame:
    """Candles per (by, window_start_ms) from panes."""
    w = windows_over(p, window_ms, slide_ms)
    if pane_ms(window_ms, slide_ms) == window_ms:
        g = w  # a pane is a window: nothing to merge, no shuffle
    else:
        g = w.groupBy(*by, "window_start_ms").agg(
            F.sum("trade_count").alias("trade_count"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("high_price").alias("high_price"), F.min("low_price").alias("low_price"),
            F.sum("base_volume").alias("base_volume"), F.sum("quote_volume").alias("quote_volume"), F.sum("notional").alias("notional"), F.sum("takers").alias("takers"),
        )
    return g.select(
        *by, "window_start_ms", (F.col("window_start_ms") + window_ms).alias("window_end_ms"), F.col("first.v").alias("open_price"), "high_price", "low_price", F.col("last.v").alias("close_price"),
        "base_volume", "quote_volume", F.coalesce(F.try_divide("notional", "base_volume"), F.col("last.v")).alias("vwap"), "trade_count",
        (F.col("takers") * F.lit(100.0) / F.col("trade_count")).alias("taker_buy_ratio"),
    )


def affected_windows(changed: DataFrame, by: list[str], window_ms: int, slide_ms: int | None = None) -> DataFrame:
    """(by, window_start_ms) that a set of changed panes touches: only these are composed and emitted anew."""
    return windows_over(changed.select(*by, "pane_start_ms").distinct(), window_ms, slide_ms).select(*by, "window_start_ms").distinct()


def panes_under(windows: DataFrame, by: list[str], window_ms: int, slide_ms: int | None = None) -> DataFrame:
    """(by, pane_start_ms) of the panes that windows (by, window_start_ms) are composed of."""
    pane = pane_ms(window_ms, slide_ms)
    return windows.select(*by, F.explode(F.sequence(F.col("window_start_ms"), F.col("window_start_ms") + window_ms - pane, F.lit(pane).cast("long"))).alias("pane_start_ms")).distinct()


def latest_emission(candles: DataFrame, by: dict[str, Column], start_ms: Column, emitted: Column, count: Column) -> DataFrame:
    """(by, window_start_ms, emitted_count): the candle emitted last; the greater count breaks a tie."""
    x = candles.select(*[c.alias(n) for n, c in by.items()], start_ms.alias("window_start_ms"), F.struct(emitted.alias("e"), count.alias("n")).alias("__r")).where("window_start_ms is not null")
    return x.groupBy(*by, "window_start_ms").agg(F.max("__r").alias("__r")).select(*by, "window_start_ms", F.col("__r.n").alias("emitted_count"))


def corrections(right: DataFrame, emitted: DataFrame, by: list[str]) -> DataFrame:
    """Windows whose right count differs from the emitted one; a missing side counts 0."""
    x = right.select(*by, "window_start_ms", F.col("trade_count").alias("right_count")).join(emitted, [*by, "window_start_ms"], "full_outer")
    n, e = F.coalesce("right_count", F.lit(0)), F.coalesce("emitted_count", F.lit(0))
    return x.where(n != e).select(*by, "window_start_ms", n.cast("long").alias("right_count"), e.cast("long").alias("emitted_count"))
