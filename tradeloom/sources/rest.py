"""Payloads of market interfaces as rows. Fetching is left to the caller: text comes in, rows go out."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TRADE = "array<struct<id: bigint, price: string, qty: string, quoteQty: string, time: bigint, isBuyerMaker: boolean, isBestMatch: boolean>>"


def trades(df: DataFrame, body: str, symbol: str) -> DataFrame:
    """Trades of JSON arrays; an absent, empty or zero quote quantity is price x quantity."""
    x = df.select(F.upper(F.trim(F.col(symbol))).alias("symbol"), F.explode(F.from_json(F.col(body), _TRADE)).alias("t"))
    p, q, qq = (F.col(f"t.{c}").try_cast("double") for c in ("price", "qty", "quoteQty"))
    return x.select(F.col("t.id").alias("trade_id"), "symbol", p.alias("price"), q.alias("quantity"), F.coalesce(F.nullif(qq, F.lit(0.0)), p * q).alias("quote_quantity"), F.timestamp_millis("t.time").alias("trade_timestamp"), F.coalesce("t.isBuyerMaker", F.lit(False)).alias("is_buyer_maker"))


def klines(df: DataFrame, body: str, symbol: str) -> DataFrame:
    """Candles of JSON arrays of arrays; the taker ratio is by volume, 50 without volume."""
    x = df.select(F.upper(F.trim(F.col(symbol))).alias("symbol"), F.explode(F.from_json(F.col(body), "array<array<string>>")).alias("k"))
    at = lambda i, t="double": F.try_element_at("k", F.lit(i + 1)).try_cast(t)
    base, quote, taker = at(5), at(7), at(9)
    return x.select(
        "symbol", at(0, "bigint").alias("window_start_ms"), at(6, "bigint").alias("window_end_ms"), at(1).alias("open_price"), at(2).alias("high_price"), at(3).alias("low_price"), at(4).alias("close_price"),
        base.alias("base_volume"), quote.alias("quote_volume"), F.round(F.try_divide(quote, base), 2).alias("vwap"), at(8, "int").alias("trade_count"), F.coalesce(F.round(F.try_divide(taker, base) * 100, 2), F.lit(50.0)).alias("taker_volume_ratio"),
    )


def with_retries(fetch: Callable[[], tuple[int, dict, str]], tries: int = 4, sleep: Callable[[float], None] = time.sleep) -> str:
    """The body of the first good answer of fetch() -> (status, headers, body). 429 and 418 wait as told, others longer each time."""
    for n in range(tries):
        status, headers, body = fetch()
        if status == 200:
            return body
        if n + 1 < tries:
            sleep(float(headers.get("Retry-After", 1)) + random.random() if status in (418, 429) else 1.5**n)
    raise RuntimeError(f"no answer in {tries} tries")


def paged(fetch: Callable[[dict[str, object]], tuple[int, dict, str]], limit: int = 1000, start: int | None = None, pages: int | None = None, tries: int = 4, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """Bodies of successive pages, each from the id behind the last one of the page before; a short page is the last.

    fetch takes the parameters (limit, fromId) and answers as in ``with_retries``. A repeated last id ends the walk, so an
    interface that ignores fromId can't loop.
    """
    last, n = None if start is None else start - 1, 0
    while pages is None or n < pages:
        params: dict[str, object] = {"limit": limit} | ({} if last is None else {"fromId": last + 1})
        body = with_retries(lambda params=params: fetch(params), tries, sleep)
        rows = json.loads(body)
        if not rows:
            return
        yield body
        n += 1
        top = max(int(r["id"]) for r in rows)
        if len(rows) < limit or (last is not None and top <= last):
            return
        last = top


def pull(spark: SparkSession, fetches: dict[str, Callable[[dict[str, object]], tuple[int, dict, str]]], workers: int = 8, **kw: object) -> DataFrame:
    """The trades of several symbols, their pages fetched side by side; one that stays without an answer is an error."""
    def all_pages(item: tuple[str, Callable]) -> list[tuple[str, str]]:
        return [(item[0], body) for body in paged(item[1], **kw)]

    with ThreadPoolExecutor(max_workers=workers) as pool:
        rows = [r for part in pool.map(all_pages, sorted(fetches.items())) for r in part]
    return trades(spark.createDataFrame(rows, "symbol string, body string"), "body", "symbol")
