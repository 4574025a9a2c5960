"""Staging, deduplication and the star schema with its daily metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.text import canonical_symbol

#: Quote assets by suffix, in order of test (fixed values).
QUOTES = ["USDT", "EUR", "BTC"]


def rounded(c: Column, n: int) -> Column:
    """Half up on the double itself; unlike round() it gives the same bits in every engine."""
    return F.floor(c * F.lit(float(10**n)) + 0.5) / F.lit(float(10**n))


def exact(c: str) -> Column:
    """A stored column of at most eight decimals as decimal: sums don't depend on their order."""
    return F.col(c).try_cast("decimal(28,8)")


def exact_product(a: str, b: str) -> Column:
    """The product of two such columns, exact up to 10^11 and 10^10; larger values give null."""
    return F.col(a).try_cast("decimal(19,8)") * F.col(b).try_cast("decimal(18,8)")


def staged(df: DataFrame) -> DataFrame:
    """Trades with an id and positive price and quantity, symbol canonical, date of the trade in UTC."""
    x = df.where(F.col("trade_id").isNotNull() & (F.col("price") > 0) & (F.col("quantity") > 0))
    return x.select(
        "trade_id", canonical_symbol(F.col("symbol")).alias("symbol"), "price", "quantity", "quote_quantity", F.col("trade_timestamp").cast("timestamp").alias("trade_timestamp"), "is_buyer_maker",
        "partition_year", "partition_month", "partition_day",
    )


def deduplicated(stg: DataFrame) -> DataFrame:
    """The latest print per (symbol, trade_id); ties by price, quantity, quote quantity, maker, so that one answer exists.

    A max over a struct, not row_number: copies combine before the shuffle, so a key with very many copies is no hot task.
    """
    rest = [c for c in stg.columns if c not in ("symbol", "trade_id", "trade_timestamp", "price", "quantity", "quote_quantity", "is_buyer_maker")]
    order = ["trade_timestamp", "price", "quantity", "quote_quantity", "is_buyer_maker", *rest]
    return stg.groupBy("symbol", "trade_id").agg(F.max(F.struct(*order)).alias("r")).select("symbol", "trade_id", "r.*")


def assets(trades: DataFrame) -> DataFrame:
    """One row per symbol: key, base and quote asset."""
    s = F.col("symbol")
    quote = F.lit("UNKNOWN")
    for q in reversed(QUOTES):
        quote = F.when(s.endswith(q), q).otherwise(quote)
    return trades.select("symbol").distinct().select(F.md5("symbol").alias("asset_key"), "symbol", F.replace(s, F.lit("USDT"), F.lit("")).alias("base_asset"), quote.alias("quote_asset"))


def facts(trades: DataFrame, dim: DataFrame) -> DataFrame:
    """Trades with the keys of the star schema. The dimension is as small as its file or distinct count says; the optimizer decides."""
    key = F.md5(F.concat("symbol", F.lit("-"), F.col("trade_id").cast("string")))
    x = trades.join(dim.select("symbol", "asset_key"), "symbol")
    return x.select(
        key.alias("trade_key"), "asset_key", "trade_id", "symbol", "price", "quantity", "quote_quantity", "trade_timestamp", F.date_format("trade_timestamp", "yyyyMMdd").cast("int").alias("date_key"), "is_buyer_maker"
    )


def daily_metrics(trades: DataFrame, quantity_digits: int = 6, quote_digits: int = 2, price_digits: int = 4) -> DataFrame:
    """Per symbol and UTC day: counts, volumes, price range, vwap, maker and taker shares."""
    base, notional = F.sum(exact("quantity")), F.sum(exact_product("price", "quantity"))
    n, makers = F.count(F.lit(1)), F.count_if("is_buyer_maker")
    return trades.groupBy("symbol", F.to_date("trade_timestamp").alias("trade_date")).agg(
        n.alias("trade_count"), rounded(base.cast("double"), quantity_digits).alias("base_volume"), rounded(F.sum(exact("quote_quantity")).cast("double"), quote_digits).alias("quote_volume"),
        F.min("price").alias("low_price"), F.max("price").alias("high_price"), rounded(F.try_divide(notional.cast("double"), F.nullif(base.cast("double"), F.lit(0.0))), price_digits).alias("vwap"),
        makers.alias("maker_count"), F.count_if(~F.col("is_buyer_maker")).alias("taker_count"), rounded(F.count_if(~F.col("is_buyer_maker")) * F.lit(100.0) / n, 2).alias("taker_ratio"),
    )


def orphans(fct: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Facts without a row in the dimension."""
    return fct.join(dim.select(key), key, "left_anti")


def base_of(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("USDT"), F.lit(""))
