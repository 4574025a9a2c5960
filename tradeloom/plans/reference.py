"""Queries over the trade tables for the market operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.functions.text import canonical_symbol
from tradeloom.operators import blocks, indicators, lake, marts, merge, quality, retention, slices
from tradeloom.operators.marts import rounded
from tradeloom.session import scratch, written
from tradeloom.streaming import backfill, dlq

HOUR_MS = 3_600_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _stg(spark: SparkSession, d: str) -> DataFrame:
    return marts.staged(read(spark, d, "stg_market_trades"))


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    return marts.deduplicated(_stg(spark, d))


_SYM = r"upper(regexp_replace(symbol, '^[\s]+|[\s]+$', '', 'g'))"
_STG = f"""stg as (select trade_id, {_SYM} as symbol, price, quantity, quote_quantity, trade_timestamp, is_buyer_maker, partition_year, partition_month, partition_day
from stg_market_trades where trade_id is not null and price > 0 and quantity > 0)"""
_INT = _STG + """, dd as (select * exclude rn from (select *, row_number() over (partition by symbol, trade_id order by trade_timestamp desc nulls last, price desc nulls last, quantity desc nulls last, quote_quantity desc nulls last,
is_buyer_maker desc nulls last, partition_year desc nulls last, partition_month desc nulls last, partition_day desc nulls last) as rn from stg) where rn = 1)"""
_DIM = _INT + """, dim as (select distinct md5(symbol) as asset_key, symbol, replace(symbol, 'USDT', '') as base_asset,
case when symbol like '%USDT' then 'USDT' when symbol like '%EUR' then 'EUR' when symbol like '%BTC' then 'BTC' else 'UNKNOWN' end as quote_asset from dd)"""


def _r(x: str, n: int) -> str:
    return f"floor(({x}) * {float(10**n)}::double + 0.5) / {float(10**n)}::double"


#: Amounts as whole numbers of 10^-8, by a rule of their own: the SQL shares no decimal type with the operators.
_I = "cast(round({} * 1e8) as hugeint)".format
_BASE, _NOTIONAL = f"(cast(sum({_I('quantity')}) as double) / 1e8)", f"(cast(sum({_I('price')} * {_I('quantity')}) as double) / 1e16)"


def _total(c: str) -> str:
    return f"(cast(sum({_I(c)}) as double) / 1e8)"


@query(f"with {_STG} select * from stg")
def stg_trades(spark: SparkSession, d: str) -> DataFrame:
    return _stg(spark, d)


@query(f"with {_INT} select * from dd")
def trades_deduped(spark: SparkSession, d: str) -> DataFrame:
    return _dedup(spark, d)


@query(f"with {_DIM} select * from dim")
def dim_assets(spark: SparkSession, d: str) -> DataFrame:
    return marts.assets(_dedup(spark, d))


@query(f"""with {_DIM} select md5(dd.symbol || '-' || cast(trade_id as varchar)) as trade_key, asset_key, trade_id, dd.symbol, price, quantity, quote_quantity, trade_timestamp,
cast(strftime(trade_timestamp, '%Y%m%d') as integer) as date_key, is_buyer_maker from dd join dim on dd.symbol = dim.symbol""")
def fct_trades(spark: SparkSession, d: str) -> DataFrame:
    t = written(_dedup(spark, d), "trades")  # read by the facts and by their dimension
    return marts.facts(t, marts.assets(t))


def _daily_sql(q: int, qq: int) -> str:
    return f"""with {_INT} select symbol, cast(cast(trade_timestamp as date) as varchar) as trade_date, count(*) as trade_count, {_r(_BASE, q)} as base_volume, {_r(_total('quote_quantity'), qq)} as quote_volume,
min(price) as low_price, max(price) as high_price, {_r(f"{_NOTIONAL} / nullif({_BASE}, 0)", 4)} as vwap, count(*) filter (is_buyer_maker) as maker_count, count(*) filter (not is_buyer_maker) as taker_count,
{_r("count(*) filter (not is_buyer_maker) * 100.0::double / count(*)", 2)} as taker_ratio from dd group by all"""


@query(_daily_sql(6, 2))
def agg_daily_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = marts.daily_metrics(_dedup(spark, d)).orderBy(F.desc("trade_date"), F.desc("quote_volume"))
    return x.withColumn("trade_date", F.col("trade_date").cast("string"))


@query(_daily_sql(4, 2).replace("select symbol, cast", "select * exclude (maker_count, taker_count) from (select symbol, cast", 1) + ")")
def semantic_daily(spark: SparkSession, d: str) -> DataFrame:
    return marts.daily_metrics(_dedup(spark, d), quantity_digits=4).drop("maker_count", "taker_count").withColumn("trade_date", F.col("trade_date").cast("string"))


@query(f"with {_DIM} select dd.symbol, count(*) as n_orphans from dd left join dim on dd.symbol = dim.symbol and quote_asset <> 'UNKNOWN' and base_asset <> '' where dim.symbol is null group by all")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    t = _dedup(spark, d)
    return marts.orphans(t, marts.assets(t).where("quote_asset <> 'UNKNOWN' and base_asset <> ''"), "symbol").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_orphans"))


@query(f"select {_SYM} as symbol, count(*) as n, {_r(_total('quote_quantity'), 4)} as quote_volume from stg_market_trades group by all")
def full_scan_agg(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "stg_market_trades").groupBy(canonical_symbol(F.col("symbol")).alias("symbol")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(marts.exact("quote_quantity")).cast("double"), 4).alias("quote_volume"))


@query(f"select count(*) as n, {_r(_total('price') + " / count(price)", 6)} as avg_price from stg_market_trades where symbol = 'BTCUSDT' and partition_day = 3")
def pruned_filter_avg(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "stg_market_trades").where("symbol = 'BTCUSDT' and partition_day = 3")
    return x.agg(F.count(F.lit(1)).alias("n"), rounded(F.try_divide(F.sum(marts.exact("price")).cast("double"), F.count("price")), 6).alias("avg_price"))


@query(f"select distinct {_SYM} as symbol from stg_market_trades")
def distinct_symbols(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "stg_market_trades").select(canonical_symbol(F.col("symbol")).alias("symbol")).distinct()


@query("select (select count(*) from stg_market_trades) as n_lake, (select count(*) from fact_trades) as n_fact, (select count(*) from realtime_market_candles where symbol = 'BTCUSDT') as n_candles")
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, n, c="true": read(spark, d, t).where(c).agg(F.count(F.lit(1)).alias(n)).withColumn("k", F.lit(1))
    return one("stg_market_trades", "n_lake").join(one("fact_trades", "n_fact"), "k").join(one("realtime_market_candles", "n_candles", "symbol = 'BTCUSDT'"), "k").drop("k")


# candles over events, whose ids are unique

_EV = "ev as (select event_id, upper(event_type) as symbol, value as price, cast(json_extract_string(props, '$.k') as double) as quantity, epoch_us(ts) as us, user_id % 2 = 0 as is_buyer_maker from events), ok as (select * from ev where price > 0 and quantity > 0)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) if dict(e.dtypes)["ts"] == "timestamp" else F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())) + F.lit(0)
    x = e.select("event_id", F.upper("event_type").alias("symbol"), F.col("value").alias("price"), F.get_json_object("props", "$.k").try_cast("double").alias("quantity"), us.alias("us"), (F.col("user_id") % 2 == 0).alias("is_buyer_maker"))
    return x


def _candle_rows(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).where("price > 0 and quantity > 0")
    return x.select("symbol", F.col("event_id").alias("trade_id"), "price", "quantity", (F.col("price") * F.col("quantity")).alias("quote_quantity"), "is_buyer_maker", F.timestamp_micros("us").alias("__event"))


def _candles(spark: SparkSession, d: str, window: int, slide: int | None = None) -> DataFrame:
    p = slices.panes(_candle_rows(spark, d), ["symbol"], slices.pane_ms(window, slide))
    c = slices.compose(p, ["symbol"], window, slide)
    return c.select("symbol", "window_start_ms", "open_price", "high_price", "low_price", "close_price", rounded(F.col("base_volume"), 4).alias("base_volume"), rounded(F.col("quote_volume"), 4).alias("quote_volume"), rounded(F.col("vwap"), 6).alias("vwap"), F.col("trade_count").cast("long").alias("trade_count"), rounded(F.col("taker_buy_ratio"), 2).alias("taker_ratio"))


def _candle_sql(ms: int) -> str:
    return f"""with {_EV} select symbol, us // {ms * 1000} * {ms} as window_start_ms, arg_min(price, row(us, event_id)) as open_price, max(price) as high_price, min(price) as low_price, arg_max(price, row(us, event_id)) as close_price,
{_r("sum(quantity)", 4)} as base_volume, {_r("sum(price * quantity)", 4)} as quote_volume, {_r("sum(price * quantity) / sum(quantity)", 6)} as vwap, count(*) as trade_count, {_r("count(*) filter (not is_buyer_maker) * 100.0::double / count(*)", 2)} as taker_ratio from ok group by all"""


@query(_candle_sql(60_000))
def candles_1m(spark: SparkSession, d: str) -> DataFrame:
    return _candles(spark, d, 60_000)


@query(_candle_sql(HOUR_MS))
def candles_1h(spark: SparkSession, d: str) -> DataFrame:
    return _candles(spark, d, HOUR_MS)


@query(f"""with {_EV}, w as (select *, unnest([us // {HOUR_MS * 1000} * {HOUR_MS}, us // {HOUR_MS * 1000} * {HOUR_MS} - {HOUR_MS}]) as window_start_ms from ok)
select symbol, window_start_ms, arg_min(price, row(us, event_id)) as open_price, max(price) as high_price, min(price) as low_price, arg_max(price, row(us, event_id)) as close_price,
{_r("sum(quantity)", 4)} as base_volume, {_r("sum(price * quantity)", 4)} as quote_volume, {_r("sum(price * quantity) / sum(quantity)", 6)} as vwap, count(*) as trade_count, {_r("count(*) filter (not is_buyer_maker) * 100.0::double / count(*)", 2)} as taker_ratio from w group by all""")
def candles_sliding_2h(spark: SparkSession, d: str) -> DataFrame:
    """Two-hour windows every hour: each pane is composed into two windows."""
    return _candles(spark, d, 2 * HOUR_MS, HOUR_MS)


@query(f"""with {_EV} select symbol, us // {HOUR_MS * 1000} * {HOUR_MS} as window_start_ms, {_r(_NOTIONAL + " / " + _BASE, 4)} as vwap, {_r("sum(quantity)", 4)} as volume, count(*) as trade_count from ok group by all""")
def batch_vwap_1h(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable accumulator of the batch pipeline: partial and final aggregation are Spark's own."""
    x = _events(spark, d).where("price > 0 and quantity > 0").withColumn("window_start_ms", F.floor(F.col("us") / (HOUR_MS * 1000)) * HOUR_MS)
    v = F.sum(marts.exact("quantity")).cast("double")
    return x.groupBy("symbol", "window_start_ms").agg(rounded(F.try_divide(F.sum(marts.exact_product("price", "quantity")).cast("double"), v), 4).alias("vwap"), rounded(F.sum("quantity"), 4).alias("volume"), F.count(F.lit(1)).alias("trade_count"))


_BF = (1_704_844_800_000, 1_705_708_800_000)


@query(f"""with {_EV} select symbol, us // {HOUR_MS * 1000} * {HOUR_MS} as window_start_ms, arg_min(price, row(us, event_id)) as open_price, arg_max(price, row(us, event_id)) as close_price, count(*) as trade_count from ok
where us // 1000 between {_BF[0]} and {_BF[1]} and symbol = 'CLICK' group by all""")
def backfill_range(spark: SparkSession, d: str) -> DataFrame:
    """Candles of one symbol over a time range, both ends included."""
    c = backfill.backfill(_candle_rows(spark, d).withColumnRenamed("__event", "trade_timestamp"), *_BF, symbol="CLICK", window_ms=HOUR_MS)
    return c.select("symbol", "window_start_ms", "open_price", "close_price", F.col("trade_count").cast("long").alias("trade_count")).orderBy("window_start_ms", "symbol")


_CANDLES = "select * exclude rn from (select *, row_number() over (partition by symbol, window_start order by emitted_at desc nulls last, trade_count desc nulls last, close_price desc nulls last) as rn from realtime_market_candles) where rn = 1"


def _last_candles(spark: SparkSession, d: str) -> DataFrame:
    return merge.last_per_key(read(spark, d, "realtime_market_candles"), ["symbol", "window_start"], ["emitted_at", "trade_count", "close_price"])


@query(f"select symbol, window_start, open_price, high_price, low_price, close_price, trade_count from ({_CANDLES}) order by window_start desc, symbol limit 20")
def latest_candles_topk(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20 candles: a top-k report."""
    return _last_candles(spark, d).select("symbol", "window_start", "open_price", "high_price", "low_price", "close_price", "trade_count").orderBy(F.desc("window_start"), "symbol").limit(20)


@query(f"select symbol, window_start, close_price from ({_CANDLES}) qualify row_number() over (partition by symbol order by window_start desc) <= 60")
def latest_n_per_symbol(spark: SparkSession, d: str) -> DataFrame:
    return indicators.latest_per_key(_last_candles(spark, d).select("symbol", "window_start", "close_price"), "symbol", [F.desc("window_start")], 60)


@query(f"""with recursive c as (select symbol, window_start, close_price, row_number() over (partition by symbol order by window_start) as i from (select symbol, window_start, close_price from ({_CANDLES}) qualify row_number() over (partition by symbol order by window_start desc) <= 60)),
e as (select symbol, window_start, close_price, i, close_price as a, close_price as b from c where i = 1 union all
select c.symbol, c.window_start, c.close_price, c.i, 0.2::double * c.close_price + (1 - 0.2::double) * e.a, 2.0::double / 22 * c.close_price + (1 - 2.0::double / 22) * e.b from e join c on c.symbol = e.symbol and c.i = e.i + 1)
select symbol, window_start, {_r("a", 6)} as ema_9, {_r("b", 6)} as ema_21 from e""")
def ema(spark: SparkSession, d: str) -> DataFrame:
    x = indicators.latest_with_ema(_last_candles(spark, d))
    return x.select("symbol", "window_start", rounded(F.col("ema_9"), 6).alias("ema_9"), rounded(F.col("ema_21"), 6).alias("ema_21"))


@query(f"""with {_INT}, t as (select symbol, trade_id, price, quantity, epoch_us(trade_timestamp) // 1000000 as s from dd where trade_timestamp is not null), w as (select *, sum({_I('price')} * {_I('quantity')}) over r as n, sum({_I('quantity')}) over r as v from t
window r as (partition by symbol order by s range between 3600 preceding and current row)) select symbol, trade_id, {_r("cast(n as double) / 1e16", 4)} as rolling_notional, {_r("cast(v as double) / 1e8", 6)} as rolling_volume, {_r("cast(n as double) / 1e16 / (cast(v as double) / 1e8)", 4)} as rolling_vwap from w""")
def rolling_vwap_1h(spark: SparkSession, d: str) -> DataFrame:
    t = _dedup(spark, d).withColumn("s", F.floor(F.unix_micros("trade_timestamp") / 1_000_000).cast("long"))
    x = indicators.rolling_vwap(t.select("symbol", "trade_id", "price", "quantity", "s"), "symbol", "s")
    return x.select("symbol", "trade_id", rounded(F.col("rolling_notional"), 4).alias("rolling_notional"), rounded(F.col("rolling_volume"), 6).alias("rolling_volume"), rounded(F.col("rolling_vwap"), 4).alias("rolling_vwap"))


_BOOK = f"""mid as (select symbol, arg_max(close_price, row(window_start, close_price)) as mid from ({_CANDLES}) group by all), lv as (select symbol, mid, unnest(generate_series(1, 10)) as level from mid),
book as (select symbol, 'bid' as side, level, mid - level * 0.5::double as price, 0.2::double + pow(level::double, 1.3::double) * 0.05::double as qty from lv union all select symbol, 'ask', level, mid + level * 0.5::double, 0.2::double + pow(level::double, 1.3::double) * 0.05::double from lv)"""


def _book(spark: SparkSession, d: str) -> DataFrame:
    mids = _last_candles(spark, d).groupBy("symbol").agg(F.max(F.struct("window_start", "close_price")).alias("m")).select("symbol", F.col("m.close_price").alias("mid"))
    return indicators.synthetic_book(mids)


@query(f"with {_BOOK} select symbol, side, level, price, {_r('sum(qty) over (partition by symbol, side order by level)', 6)} as cumulative from book")
def depth_cumulative(spark: SparkSession, d: str) -> DataFrame:
    x = indicators.cumulative_depth(_book(spark, d))
    return x.select("symbol", "side", F.col("level").cast("long").alias("level"), "price", rounded(F.col("cumulative"), 6).alias("cumulative"))


@query(f"""with {_BOOK}, g as (select symbol, max(price) filter (side = 'bid') as best_bid, min(price) filter (side = 'ask') as best_ask, sum(qty) filter (side = 'bid') as b, sum(qty) filter (side = 'ask') as a from book group by all)
select symbol, best_bid, best_ask, best_ask - best_bid as spread, (best_ask + best_bid) / 2 as mid, {_r("b / (a + b) * 100", 4)} as bid_share, {_r("(best_ask - best_bid) / best_bid * 10000", 4)} as spread_bps from g""")
def book_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = indicators.book_metrics(_book(spark, d))
    return x.select("symbol", "best_bid", "best_ask", "spread", "mid", rounded(F.col("bid_share"), 4).alias("bid_share"), rounded(F.col("spread_bps"), 4).alias("spread_bps"))


@query(f"""with e as (select event_id, epoch_us(ts) // 1000 as ms, (event_id // 3) * 3 + (2 - event_id % 3) as seq from events), m as (select *, max(ms) over (order by seq) - 5000 as watermark_ms, ms // {HOUR_MS} * {HOUR_MS} as window_start_ms from e)
select event_id, watermark_ms, window_start_ms, window_start_ms + {HOUR_MS} <= watermark_ms as is_late from m""")
def watermark_late(spark: SparkSession, d: str) -> DataFrame:
    """Exact per-record lateness over a scrambled order of arrival."""
    e = _events(spark, d).select("event_id", F.floor(F.col("us") / 1000).alias("ms"), ((F.floor(F.col("event_id") / 3)) * 3 + (2 - F.col("event_id") % 3)).alias("seq"))
    return blocks.lateness(e, "seq", "ms", HOUR_MS, 5000).select("event_id", "watermark_ms", "window_start_ms", "is_late")


@query(f"""with e as (select *, epoch_us(ts) // 1000 as ms, (event_id // 3) * 3 + (2 - event_id % 3) as seq from events), m as (select *, max(ms) over (order by seq) - 5000 as wm, ms // {HOUR_MS} * {HOUR_MS} as window_start_ms from e)
select upper(event_type) as symbol, window_start_ms, arg_min(value, row(ms, seq)) as open_price, arg_max(value, row(ms, seq)) as close_price, count(*) as trade_count from m where window_start_ms + {HOUR_MS} > wm group by all""")
def watermarked_candles(spark: SparkSession, d: str) -> DataFrame:
    """Candles without the late records, all windows flushed."""
    e = _events(spark, d).select("event_id", F.col("symbol").alias("event_type"), F.col("price").alias("value"), F.floor(F.col("us") / 1000).alias("ms"))
    e = e.withColumn("seq", (F.floor(F.col("event_id") / 3)) * 3 + (2 - F.col("event_id") % 3))
    x = blocks.lateness(e, "seq", "ms", HOUR_MS, 5000).where("not is_late").groupBy(F.upper("event_type").alias("symbol"), "window_start_ms")
    return x.agg(F.min_by("value", F.struct("ms", "seq")).alias("open_price"), F.max_by("value", F.struct("ms", "seq")).alias("close_price"), F.count(F.lit(1)).alias("trade_count"))


# sanitizing, gates, merges


def _num(c: str) -> str:
    return f"try_cast(trim({c}) as double)"


_NUM = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
_WHITE = r"regexp_replace({}, '^[\s]+|[\s]+$', '', 'g')".format
_SAN = rf"""s as (select row_id, upper({_WHITE("coalesce(symbol, '')")}) as symbol, case when regexp_full_match({_WHITE("trade_id")}, '[+-]?[0-9]+') then try_cast({_WHITE("trade_id")} as bigint) end as tid,
case when regexp_full_match({_WHITE("price")}, '{_NUM}') then try_cast({_WHITE("price")} as double) end as p, case when regexp_full_match({_WHITE("quantity")}, '{_NUM}') then try_cast({_WHITE("quantity")} as double) end as q,
{_WHITE("coalesce(quote_quantity, '')")} as qq, {_WHITE("trade_timestamp")} as ts, coalesce(lower({_WHITE("is_buyer_maker")}) in ('true', '1', 't', 'yes'), false) as is_buyer_maker from unit_test_50),
f as (select *, regexp_extract(ts, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:[T ]([0-9]{{2}}):([0-9]{{2}})(?::([0-9]{{2}})(?:[.][0-9]{{1,9}})?)?)?(?:Z|[+-]([0-9]{{2}}):?([0-9]{{2}}))?$', ['d', 'h', 'm', 's', 'oh', 'om']) as g from s),
san as (select row_id, symbol, is_buyer_maker, case when length(symbol) < 1 or length(symbol) > 20 then 'symbol' when tid is null or tid <= 0 then 'trade_id' when p is null or p = 'inf'::double or p <= 0 then 'price' when q is null or q = 'inf'::double or q <= 0 then 'quantity'
when qq <> '' and not (regexp_full_match(qq, '{_NUM}') or lower(qq) in ('nan', 'inf', '+inf', '-inf', 'infinity', '+infinity', '-infinity')) then 'quote_quantity'
when not coalesce(regexp_full_match(ts, '[0-9]{{1,18}}') or (try_cast(nullif(g.d, '') as date) is not null and coalesce(try_cast(g.h as int), 0) < 24 and coalesce(try_cast(g.m as int), 0) < 60 and coalesce(try_cast(g.s as int), 0) < 60 and coalesce(try_cast(g.oh as int), 0) <= 18 and coalesce(try_cast(g.om as int), 0) < 60), false) then 'trade_timestamp' end as reject_reason from f)"""


@query(f"with {_SAN} select * from san")
def sanitized_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first failing rule of each row, over all rules."""
    return quality.sanitized(read(spark, d, "unit_test_50")).select("row_id", "symbol", "is_buyer_maker", "reject_reason")


@query(f"with {_SAN} select coalesce(reject_reason, 'valid') as outcome, count(*) as n_rows from san group by all")
def ingest_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows scanned, valid and quarantined by reason."""
    return quality.sanitized(read(spark, d, "unit_test_50")).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n_rows"))


_HASH = f"sha256({_SYM} || '|' || trade_id || '|' || price || '|' || quantity || '|' || strftime(trade_timestamp, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(trade_timestamp) % 1000000 = 0 then '' else printf('.%06d', epoch_us(trade_timestamp) % 1000000) end || '+00:00|' || case when is_buyer_maker then 'True' else 'False' end)"


@query(f"select {_SYM} as symbol, trade_id, {_HASH} as content_hash, count(*) as n from fact_trades group by all")
def record_hash(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "fact_trades").withColumns({"symbol": canonical_symbol(F.col("symbol")), "trade_timestamp": F.col("trade_timestamp").cast("timestamp")})
    return x.select("symbol", "trade_id", quality.record_hash(x).alias("content_hash")).groupBy("symbol", "trade_id", "content_hash").agg(F.count(F.lit(1)).alias("n"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "cdc_mutation_events")
    op = F.lower(F.trim("op_type"))
    kind = F.when(op.isin("insert", "create", "c", "r"), "insert").when(op.isin("update", "u"), "update").when(op.isin("delete", "d"), "delete")
    num = lambda n: F.get_json_object("payload", f"$.{n}").try_cast("double")
    return e.select("arrival_seq", kind.alias("op_type"), canonical_symbol(F.col("symbol")).alias("symbol"), "trade_id", num("price").alias("price"), num("quantity").alias("quantity"), "lsn")


_CDC = f"""ev as (select arrival_seq, case when lower(trim(op_type)) in ('insert','create','c','r') then 'insert' when lower(trim(op_type)) in ('update','u') then 'update' when lower(trim(op_type)) in ('delete','d') then 'delete' end as op_type, {_SYM} as symbol, trade_id,
try_cast(json_extract_string(payload, '$.price') as double) as price, try_cast(json_extract_string(payload, '$.quantity') as double) as quantity, lsn from cdc_mutation_events)"""
_OKEV = "ok as (select * from ev where op_type is not null and symbol <> '' and trade_id is not null)"


@query(f"""with {_CDC} select arrival_seq, coalesce(trade_id <= 0, true) as bad_id, coalesce(symbol, '') = '' as no_symbol, op_type <> 'delete' and (price is null or price <= 0 or quantity is null or quantity <= 0) as non_positive,
coalesce(op_type <> 'delete' and price > case symbol when 'BTCUSDT' then 64000 when 'ETHUSDT' then 3500 end, false) as spike from ev where op_type is not null""")
def quality_violations(spark: SparkSession, d: str) -> DataFrame:
    """The rules that each change breaks (limits set low enough to be met here)."""
    e = _changes(spark, d).where("op_type is not null")
    v = quality.violations(*[F.col(c) for c in ("op_type", "symbol", "trade_id", "price", "quantity")], limits={"BTCUSDT": 64_000.0, "ETHUSDT": 3_500.0})
    has = lambda n: F.array_contains("v", n)
    x = e.select("arrival_seq", v.alias("v"))
    return x.select("arrival_seq", has("INVALID_TRADE_ID").alias("bad_id"), has("MISSING_SYMBOL").alias("no_symbol"), has("NON_POSITIVE").alias("non_positive"), has("PRICE_SPIKE").alias("spike"))


@query(f"""with {_CDC} select case when coalesce(trade_id <= 0, true) or coalesce(symbol, '') = '' or (op_type <> 'delete' and (price is null or price <= 0 or quantity is null or quantity <= 0)) then 'quarantined' else 'approved' end as outcome, op_type, count(*) as n from ev where op_type is not null group by all""")
def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    e = _changes(spark, d).where("op_type is not null")
    bad = F.size(quality.violations(*[F.col(c) for c in ("op_type", "symbol", "trade_id", "price", "quantity")])) > 0
    return e.groupBy(F.when(bad, "quarantined").otherwise("approved").alias("outcome"), "op_type").agg(F.count(F.lit(1)).alias("n"))


_KEY = ["symbol", "trade_id"]


_STATE = f"st as (select {_SYM} as symbol, trade_id, cast(arg_max(price, row(updated_at, record_hash)) as double) as price, cast(arg_max(quantity, row(updated_at, record_hash)) as double) as quantity from fact_trades where symbol is not null and trade_id is not null group by 1, 2)"


def _state(spark: SparkSession, d: str) -> DataFrame:
    """The trades loaded so far, each key once: what the changes are merged into."""
    f = read(spark, d, "fact_trades").withColumn("symbol", canonical_symbol(F.col("symbol"))).where("symbol is not null and trade_id is not null")
    f = f.groupBy(*_KEY).agg(F.max(F.struct("updated_at", "record_hash", "price", "quantity")).alias("r"))
    return f.select(*_KEY, F.col("r.price").cast("double").alias("price"), F.col("r.quantity").cast("double").alias("quantity"))


@query(f"""with {_CDC}, {_OKEV}, {_STATE}, l as (select *, row_number() over (partition by symbol, trade_id order by arrival_seq desc) as rn from ok) select symbol, trade_id, price, quantity from l where rn = 1 and op_type <> 'delete'
union all select st.* from st anti join l on st.symbol = l.symbol and st.trade_id = l.trade_id""")
def cdc_merge_state(spark: SparkSession, d: str) -> DataFrame:
    """The table after the changes in order of arrival."""
    e = _changes(spark, d).where("op_type is not null and symbol <> '' and trade_id is not null")
    return merge.ordered_merge(_state(spark, d), e, _KEY, "arrival_seq", "op_type")


@query(f"""with {_CDC}, {_OKEV}, {_STATE}, p as (select ok.*, coalesce(lag(op_type) over (partition by ok.symbol, ok.trade_id order by arrival_seq) <> 'delete', st.symbol is not null) as there, row_number() over (partition by ok.symbol, ok.trade_id order by arrival_seq desc) as rn from ok left join st on ok.symbol = st.symbol and ok.trade_id = st.trade_id)
select count(*) filter (op_type = 'insert' or (op_type = 'update' and not there)) as added, count(*) filter (op_type = 'update' and there) as updated, count(*) filter (op_type = 'delete' and there) as deleted, count(*) filter (rn = 1 and op_type <> 'delete') + (select count(*) from st anti join ok on st.symbol = ok.symbol and st.trade_id = ok.trade_id) as total from p""")
def cdc_merge_counts(spark: SparkSession, d: str) -> DataFrame:
    e = _changes(spark, d).where("op_type is not null and symbol <> '' and trade_id is not null")
    return merge.merge_counts(_state(spark, d).select(*_KEY), e, _KEY, "arrival_seq", "op_type")


_FACT1 = f"""f as (select * exclude rn from (select {_SYM} as symbol, trade_id, price, quantity, quote_quantity, is_buyer_maker, lower(record_hash) as record_hash, row_number() over (partition by {_SYM}, trade_id order by updated_at desc nulls last, record_hash desc nulls last) as rn from fact_trades where symbol is not null and trade_id is not null) where rn = 1),
b as (select * exclude rn from (select {_SYM} as symbol, trade_id, cast(price as decimal(18,8)) as price, cast(quantity as decimal(18,8)) as quantity, cast(quote_quantity as decimal(18,8)) as quote_quantity, is_buyer_maker, lower(record_hash) as record_hash, row_number() over (partition by {_SYM}, trade_id order by row_id desc) as rn from stg_raw_trades where symbol is not null and trade_id is not null) where rn = 1)"""


@query(f"""with {_FACT1} select coalesce(f.symbol, b.symbol) as symbol, coalesce(f.trade_id, b.trade_id) as trade_id, case when f.symbol is null then cast(b.price as double) when b.symbol is null or f.record_hash is not distinct from b.record_hash then cast(f.price as double) else cast(b.price as double) end as price,
case when f.symbol is null then 'insert' when b.symbol is null or f.record_hash is not distinct from b.record_hash then 'keep' else 'update' end as action from f full join b on f.symbol = b.symbol and f.trade_id = b.trade_id""")
def upsert_hash_guard(spark: SparkSession, d: str) -> DataFrame:
    fact = read(spark, d, "fact_trades").withColumns({"symbol": canonical_symbol(F.col("symbol")), "record_hash": F.lower("record_hash")}).where("symbol is not null and trade_id is not null")
    cols = ["price", "quantity", "quote_quantity", "is_buyer_maker", "record_hash"]
    target = merge.last_per_key(fact.select(*_KEY, *cols, "created_at", "updated_at"), _KEY, ["updated_at", "record_hash"])
    raw = read(spark, d, "stg_raw_trades")
    batch = raw.select(canonical_symbol(F.col("symbol")).alias("symbol"), "trade_id", *[F.col(c).cast("decimal(18,8)").alias(c) for c in cols[:3]], "is_buyer_maker", F.lower("record_hash").alias("record_hash"), "row_id")
    x = merge.hash_guarded_upsert(target, batch, _KEY, "record_hash", ["row_id"], F.current_timestamp())
    return x.select(*_KEY, F.col("price").cast("double").alias("price"), F.col("__action").alias("action"))


@query(f"""with {_FACT1} select symbol, trade_id, cast(quantity as double) as quantity from b union all select f.symbol, f.trade_id, cast(f.quantity as double) from f anti join b on f.symbol = b.symbol and f.trade_id = b.trade_id""")
def insert_or_replace(spark: SparkSession, d: str) -> DataFrame:
    fact = read(spark, d, "fact_trades").withColumns({"symbol": canonical_symbol(F.col("symbol")), "record_hash": F.lower("record_hash")}).where("symbol is not null and trade_id is not null")
    target = merge.last_per_key(fact.select(*_KEY, "quantity", "updated_at", "record_hash"), _KEY, ["updated_at", "record_hash"]).select(*_KEY, "quantity", F.lit(0).cast("long").alias("row_id"))
    raw = read(spark, d, "stg_raw_trades").select(canonical_symbol(F.col("symbol")).alias("symbol"), "trade_id", F.col("quantity").cast("decimal(18,8)").alias("quantity"), "row_id").where("symbol is not null and trade_id is not null")
    return merge.insert_or_replace(target, raw, _KEY, ["row_id"]).select(*_KEY, F.col("quantity").cast("double").alias("quantity"))


_CUT = "2022-01-02 12:00:00"


@query(f"select trade_id, {_SYM} as symbol, trade_timestamp from realtime_raw_trades where not coalesce(trade_timestamp < timestamptz '{_CUT}+00', false)")
def retention_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a retention sweep keeps: older than the cut-off (strictly) are deleted, null times stay."""
    t = read(spark, d, "realtime_raw_trades").withColumn("trade_timestamp", F.col("trade_timestamp").cast("timestamp"))
    kept = retention.sweep({"tape": (t, "trade_timestamp", 24)}, F.timestamp_micros(F.lit(1_641_124_800_000_000 + 24 * HOUR_MS * 1000)))["tape"][1]
    return kept.select("trade_id", canonical_symbol(F.col("symbol")).alias("symbol"), "trade_timestamp")


@query("""select 'not_null:trade_id' as check_name, count(*) filter (trade_id is null) as failures from stg_market_trades union all select 'not_null:symbol', count(*) filter (symbol is null) from stg_market_trades
union all select 'accepted:partition_month', count(*) filter (partition_month is not null and partition_month not in (1, 2, 3)) from stg_market_trades
union all select 'unique:trade_id', count(*) from (select trade_id from stg_market_trades where trade_id is not null group by trade_id having count(*) > 1)
union all select 'refers:symbol', count(*) from stg_market_trades s where symbol is not null and not exists (select 1 from realtime_market_candles c where c.symbol = s.symbol)""")
def generic_checks(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "stg_market_trades")
    return quality.checks(t, ["trade_id", "symbol"], ["trade_id"], {"partition_month": [1, 2, 3]}, {"symbol": (read(spark, d, "realtime_market_candles").select("symbol").distinct(), "symbol")})


@query(f"select {_SYM} as symbol, trade_id, trade_timestamp, case when is_buyer_maker then 'SELL (MAKER)' else 'BUY (TAKER)' end as side from realtime_raw_trades where trade_timestamp is not null order by trade_timestamp desc, {_SYM}, trade_id limit 20")
def tape_top20(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20 trades with their side: a top-k report."""
    t = read(spark, d, "realtime_raw_trades").where("trade_timestamp is not null")
    side = F.when(F.col("is_buyer_maker"), "SELL (MAKER)").otherwise("BUY (TAKER)").alias("side")
    return t.select(canonical_symbol(F.col("symbol")).alias("symbol"), "trade_id", "trade_timestamp", side).orderBy(F.desc("trade_timestamp"), "symbol", "trade_id").limit(20)


@query(f"select {_SYM} as symbol, trade_id, trade_timestamp, printf('%.4f', price) as price_text from realtime_raw_trades where trade_timestamp is not null qualify row_number() over (partition by {_SYM} order by trade_timestamp desc, trade_id, price, quantity) <= 20")
def tape_per_symbol(spark: SparkSession, d: str) -> DataFrame:
    """The newest 20 trades of each symbol: a top-k report."""
    t = read(spark, d, "realtime_raw_trades").where("trade_timestamp is not null").withColumn("symbol", canonical_symbol(F.col("symbol")))
    x = indicators.latest_per_key(t, "symbol", [F.desc("trade_timestamp"), F.col("trade_id"), F.col("price"), F.col("quantity")], 20)
    return x.select("symbol", "trade_id", "trade_timestamp", F.format_string("%.4f", "price").alias("price_text"))


@query(f"select {_SYM} as symbol, count(*) as n from stg_market_trades group by 1 order by 1")
def counts_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "stg_market_trades").groupBy(canonical_symbol(F.col("symbol")).alias("symbol")).agg(F.count(F.lit(1)).alias("n")).orderBy("symbol")


@query(f"""select extract(year from trade_timestamp)::varchar as year, lpad(extract(month from trade_timestamp)::varchar, 2, '0') as month, upper(trim(symbol)) as symbol, count(*) as n, 1 as n_files from stg_market_trades where trade_timestamp is not null and extract(day from trade_timestamp) = 3 group by all""")
def lake_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The lake written in its layout, compacted, and one day read back through its folders: rows and files of each partition."""
    path = scratch(spark, "lake")
    lake.write_trades(read(spark, d, "stg_market_trades").where("trade_timestamp is not null").drop("partition_year", "partition_month", "partition_day"), path)
    lake.compact_directory(spark, path, path + "-compact")
    x = lake.read_trades(spark, path + "-compact").where("cast(day as int) = 3").withColumn("file", F.col("_metadata.file_path"))
    return x.groupBy(F.col("year").cast("string").alias("year"), F.lpad(F.col("month").cast("string"), 2, "0").alias("month"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("file"), F.col("day")).cast("int").alias("n_files"))


@query("""with e as (select event_id, event_type, value, case when event_type not in ('click', 'view', 'purchase', 'signup') then 'Unknown symbol' when not coalesce(value > 0, false) then 'Price must be positive' when not coalesce(cast(json_extract_string(props, '$.k') as double) > 0, false) then 'Volume must be positive' end as error from events)
select coalesce(error, 'VALID') as error_code, count(*) as n from e group by all""")
def dlq_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by first failure of the stream validation."""
    e = read(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.get_json_object("props", "$.k").try_cast("double").alias("volume"), F.col("event_id").alias("event_time"))
    x = quality.validated_stream(e, ["CLICK", "VIEW", "PURCHASE", "SIGNUP"])
    return dlq.summary(x.withColumn("error_code", F.coalesce("error", F.lit("VALID"))))


@query("""select event_id, case when event_id * 40000000 > 1e11 then event_id * 40000000 else event_id * 40000000 * 1000 end as event_ms from events where event_type = 'purchase'""")
def event_clock(spark: SparkSession, d: str) -> DataFrame:
    """Event times given in seconds or in milliseconds, as milliseconds: numbers above 10^11 are milliseconds."""
    e = read(spark, d, "events").where("event_type = 'purchase'").select("event_id", F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), (F.col("event_id") * 40_000_000).alias("event_time"))
    return quality.validated_stream(e, ["PURCHASE"]).select("event_id", F.col("event_ms").cast("long").alias("event_ms"))


@query(f"""with {_CDC} select 'gate' as source, count(*) filter (op_type is null) as rejected, count(*) as n from ev union all select 'tape', count(*) filter (trade_timestamp is null), count(*) from realtime_raw_trades""")
def kpi_counts(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts over two quarantine sources as one table."""
    one = lambda df, n, bad: df.agg(F.lit(n).alias("source"), F.count_if(bad).alias("rejected"), F.count(F.lit(1)).alias("n"))
    return one(_changes(spark, d), "gate", F.col("op_type").isNull()).unionByName(one(read(spark, d, "realtime_raw_trades"), "tape", F.col("trade_timestamp").isNull()))


@query("""select 'year=' || extract(year from trade_timestamp) || '/month=' || lpad(cast(extract(month from trade_timestamp) as varchar), 2, '0') || '/day=' || lpad(cast(extract(day from trade_timestamp) as varchar), 2, '0') as path, count(*) as n
from stg_market_trades where trade_timestamp is not null group by all""")
def partition_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows by lake path of their UTC day."""
    k = lake.partition_columns(F.col("trade_timestamp").cast("timestamp"))
    path = F.concat(F.lit("year="), k["year"], F.lit("/month="), k["month"], F.lit("/day="), k["day"])
    return read(spark, d, "stg_market_trades").where("trade_timestamp is not null").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with c as (select *, case when regexp_matches(source_file, 'month=[0-9]{{2}}/') then 'padded' else 'unpadded' end as spelling from stg_market_trades) select spelling, count(distinct source_file) as n_files, count(*) as n_rows, count(distinct {_SYM}) as n_symbols from c group by all""")
def storage_stats(spark: SparkSession, d: str) -> DataFrame:
    """Files, rows and symbols of the lake by spelling of the path."""
    t = read(spark, d, "stg_market_trades")
    per = t.groupBy(F.when(F.col("source_file").rlike("month=[0-9]{2}/"), "padded").otherwise("unpadded").alias("spelling"))
    return per.agg(F.countDistinct("source_file").alias("n_files"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(canonical_symbol(F.col("symbol"))).alias("n_symbols"))


@query("""select r_name, n_name, count(*) as n_orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as revenue from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """A star join; the small sides are broadcast where their size allows."""
    o, c, n, r = (read(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return x.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))


@query("""with t as (select l_orderkey * 10 + l_linenumber as trade_id, l_returnflag || l_linestatus as symbol, l_extendedprice as price, l_quantity as quantity, l_shipdate from lineitem)
select symbol, cast(cast(l_shipdate as date) as varchar) as trade_date, count(*) as n, floor(cast(sum(cast(round(price * 1e8) as hugeint) * cast(round(quantity * 1e8) as hugeint)) as double) / 1e16 / (cast(sum(cast(round(quantity * 1e8) as hugeint)) as double) / 1e8) * 10000.0::double + 0.5) / 10000.0::double as vwap from t group by all""")
def lineitem_daily_vwap(spark: SparkSession, d: str) -> DataFrame:
    """Daily vwap over the largest driver table."""
    x = read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.to_date("l_shipdate").cast("string").alias("trade_date"))
    pq, q = marts.exact_product("price", "quantity"), marts.exact("quantity")
    return x.groupBy("symbol", "trade_date").agg(F.count(F.lit(1)).alias("n"), rounded(F.try_divide(F.sum(pq).cast("double"), F.sum(q).cast("double")), 4).alias("vwap"))


