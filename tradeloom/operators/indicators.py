"""Rolling vwap, moving averages, order-book depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators.marts import exact, exact_product


def rolling_vwap(df: DataFrame, by: str, seconds: str, span: int = 3600, chunk: int = 6 * 3600) -> DataFrame:
    """df with notional, rolling_notional, rolling_volume, rolling_vwap over [t - span, t]; rows of equal time count for each other.

    Time is cut into chunks, and the last ``span`` seconds of a chunk are also context of the next one, so that
    a symbol with a third of all rows is spread over as many tasks as it has chunks. Columns price, quantity of at most
    eight decimals are summed exactly. Null keys, times, prices or quantities: the row is left out.
    """
    if span > chunk:
        raise ValueError("a chunk must be at least as long as the span")
    pq, q = exact_product("price", "quantity"), exact("quantity")
    own = F.floor(F.col(seconds) / chunk)
    x = df.where(F.col(by).isNotNull() & F.col(seconds).isNotNull() & F.col("price").isNotNull() & F.col("quantity").isNotNull())
    x = x.withColumn("__c", F.explode(F.when(F.col(seconds) >= (own + 1) * chunk - span, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(by, "__c").orderBy(seconds).rangeBetween(-span, 0)
    x = x.withColumns({"notional": pq.cast("double"), "rolling_notional": F.sum(pq).over(w).cast("double"), "rolling_volume": F.sum(q).over(w).cast("double")})
    return x.where(F.col("__c") == own).drop("__c").withColumn("rolling_vwap", F.try_divide("rolling_notional", "rolling_volume"))


def ema(values: Column, span: int) -> Column:
    """Exponential moving averages of an array: y0 = x0, y = a x + (1 - a) y', a = 2 / (span + 1)."""
    a = 2.0 / (span + 1)
    start = F.array().cast("array<double>")
    step = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(F.lit(a) * x + F.lit(1 - a) * F.element_at(acc, -1))))
    return F.aggregate(values, start, step)


def latest_per_key(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows per key in the given order; the limit by group runs before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def latest_with_ema(candles: DataFrame, n: int = 60, spans: tuple[int, ...] = (9, 21)) -> DataFrame:
    """The latest n candles per symbol, oldest first, with the moving averages of the close over them."""
    x = latest_per_key(candles, "symbol", [F.desc("window_start")], n)
    g = x.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("window_start", "close_price"))).alias("c"))  # n rows at most
    g = g.select("symbol", "c", *[ema(F.col("c.close_price"), s).alias(f"e{s}") for s in spans])
    return g.select("symbol", F.inline(F.arrays_zip(F.col("c.window_start").alias("window_start"), F.col("c.close_price").alias("close_price"), *[F.col(f"e{s}").alias(f"ema_{s}") for s in spans])))


def synthetic_book(mids: DataFrame, levels: int = 10, step: float = 0.5) -> DataFrame:
    """(symbol, side, level, price, qty) around a mid price: the fallback book, quantity 0.2 + 0.05 level^1.3."""
    x = mids.select("symbol", "mid", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"), F.lit(None).alias("__n"))
    qty = F.lit(0.2) + F.pow(F.col("level").cast("double"), F.lit(1.3)) * 0.05
    side = lambda s, sign: x.select("symbol", F.lit(s).alias("side"), "level", (F.col("mid") + sign * F.col("level") * step).alias("price"), qty.alias("qty"))
    return side("bid", -1).unionByName(side("ask", 1))


def parse_book(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """(keep, side, level, price, qty) from depth JSON {"bids": [[price, qty], ...], "asks": ...}."""
    b = F.from_json(F.col(payload), "bids array<array<string>>, asks array<array<string>>")
    x = df.select(*keep, b.alias("b"))
    one = lambda s, f: x.select(*keep, F.lit(s).alias("side"), F.posexplode(f"b.{f}").alias("pos", "l")).select(
        *keep, "side", (F.col("pos") + 1).alias("level"), F.try_element_at("l", F.lit(1)).try_cast("double").alias("price"), F.try_element_at("l", F.lit(2)).try_cast("double").alias("qty")
    )
    return one("bid", "bids").unionByName(one("ask", "asks"))


def cumulative_depth(book: DataFrame) -> DataFrame:
    """Running quantity from the best price outwards: bids by falling, asks by rising price. A book has few levels per symbol."""
    key = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy("symbol", "side").orderBy(key, "level").rowsBetween(Window.unboundedPreceding, 0)
    return book.withColumn("cumulative", F.sum("qty").over(w))


def book_metrics(book: DataFrame) -> DataFrame:
    """Best prices, spread, mid, totals and shares; a side without quantity gives shares of 50."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    g = book.groupBy("symbol").agg(
        F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"),
        F.coalesce(F.sum(F.when(bid, F.col("qty").cast("decimal(24,10)"))).cast("double"), F.lit(0.0)).alias("bid_total"), F.coalesce(F.sum(F.when(ask, F.col("qty").cast("decimal(24,10)"))).cast("double"), F.lit(0.0)).alias("ask_total"),
    )
    total = F.nullif(F.col("bid_total") + F.col("ask_total"), F.lit(0.0))
    spread = F.col("best_ask") - F.col("best_bid")
    return g.select(
        "symbol", "best_bid", "best_ask", "bid_total", "ask_total", F.coalesce(F.col("bid_total") / total * 100, F.lit(50.0)).alias("bid_share"), F.coalesce(F.col("ask_total") / total * 100, F.lit(50.0)).alias("ask_share"),
        spread.alias("spread"), F.try_divide(spread, "best_bid").alias("spread_ratio"), ((F.col("best_ask") + F.col("best_bid")) / 2).alias("mid"),
    ).withColumn("spread_bps", F.col("spread_ratio") * 10000).drop("spread_ratio")
