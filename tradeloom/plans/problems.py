"""Queries p1 to p7 over the test tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.functions.clock import normalise_timestamps
from tradeloom.functions.text import canonical_symbol, eight_decimals
from tradeloom.operators import changes, compaction, drift, once, slices, tokenizer

SMALL_ROWS = 40
LATE_MS = 600_000
MINUTE_MS = 60_000


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# 1 small files

_LAKE = {"partition_year": F.col, "partition_month": F.col, "partition_day": F.col}


def _lake_partition() -> dict[str, Column]:
    return {**{k: f(k) for k, f in _LAKE.items()}, "canonical": canonical_symbol(F.col("symbol"))}


_RECORD = ["trade_id", "price", "quantity", "trade_timestamp"]
#: A target so small that the partitions of the test data have several groups.
FINE_BYTES = 1024


def _p1(spark: SparkSession, d: str, target: int = compaction.TARGET_BYTES) -> tuple[DataFrame, DataFrame]:
    src = read(spark, d, "stg_market_trades")
    return src, compaction.plan(src, _lake_partition(), "source_file", _RECORD, SMALL_ROWS, target)


def p1_plan(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d)[1].where("file is not null")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_plan(spark, d).where("action <> 'keep'").select(F.col("file").alias("source_file"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """The output files of a plan with a small target: how many files and bytes each takes in."""
    x = _p1(spark, d, FINE_BYTES)[1].where("action = 'merge'")
    return x.groupBy("partition_year", "partition_month", "partition_day", "canonical", "out_file").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("n_bytes"), F.min("file").alias("first_file"))


def p1_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """Rows and output files of every partition as read back after the rewrite."""
    src, planned = _p1(spark, d)
    x = compaction.rewritten(src, planned, _lake_partition(), "source_file", _RECORD)
    return x.groupBy("partition_year", "partition_month", "partition_day", F.col("canonical").alias("symbol")).agg(F.countDistinct("out_file").alias("n_files"), F.count(F.lit(1)).alias("n_rows"))


def p1_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Per partition the counts before the rewrite and of what is read back, compared."""
    src, planned = _p1(spark, d)
    part = _lake_partition()
    x = compaction.rewritten(src, planned, part, "source_file", _RECORD)
    return compaction.reconcile(src.where("source_file is not null"), x, part, _RECORD, {n: F.col(n) for n in part})


# 2 timestamps


def _stamped(spark: SparkSession, d: str, table: str, *cols: str) -> DataFrame:
    return normalise_timestamps(read(spark, d, table).select(*dict.fromkeys([*cols, "feed", "trade_timestamp"])), read(spark, d, "feed_zones"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    x = _stamped(spark, d, "unit_test_50", "row_id").unionByName(_stamped(spark, d, "stg_raw_trades", "row_id"))
    return x.where("utc_us is not null").select("row_id", "utc_us")


def p2_undecided(spark: SparkSession, d: str) -> DataFrame:
    """Rows per feed whose text denotes no single instant."""
    x = _stamped(spark, d, "unit_test_50", "row_id").unionByName(_stamped(spark, d, "stg_raw_trades", "row_id"))
    return x.groupBy("feed").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("utc_us").isNull()).alias("n_undecided"))


# 3 changes


def _p3(spark: SparkSession, d: str, spellings: dict[str, str]) -> DataFrame:
    ev = read(spark, d, "cdc_mutation_events")
    key = {"symbol": F.nullif(canonical_symbol(F.col("symbol")), F.lit("")), "trade_id": F.col("trade_id")}
    field = lambda n, t: F.get_json_object("payload", f"$.{n}").try_cast(t)
    cols = {n: field(n, "double") for n in ("price", "quantity", "quote_quantity")} | {"is_buyer_maker": field("is_buyer_maker", "boolean"), "lsn": F.col("lsn")}
    return changes.current_state(ev, key, "lsn", changes.operation(F.col("op_type"), spellings), cols).drop("__seq")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the present table with the lsn that its last writer set, a column like the others."""
    return p3_current(spark, d).select("symbol", "trade_id", "lsn")


def p3_current(spark: SparkSession, d: str) -> DataFrame:
    """The table of trades alive, with their columns."""
    return _p3(spark, d, changes.OPERATIONS)


def p3_patched(spark: SparkSession, d: str) -> DataFrame:
    """The same feed with updates that write only the fields they carry: each column has its own last writer."""
    return _p3(spark, d, {**changes.OPERATIONS, "update": "patch", "u": "patch"})


# 4 repeated messages


def content_hash(df: DataFrame, symbol: Column, utc_us: Column) -> Column:
    """The record hash that the content gives; null where a part is unknown."""
    micros, secs = F.pmod(utc_us, F.lit(1_000_000)), F.floor(utc_us / 1_000_000)
    day, of_day = F.date_from_unix_date(F.floor(secs / 86400).cast("int")).cast("string"), F.pmod(secs, F.lit(86400))
    clock = F.format_string("T%02d:%02d:%02d", F.floor(of_day / 3600), F.floor(of_day / 60) % 60, of_day % 60)
    iso = F.when(utc_us.isNotNull(), F.concat(day, clock, F.when(micros == 0, "").otherwise(F.format_string(".%06d", micros)), F.lit("+00:00")))
    maker = F.when(F.col("is_buyer_maker"), "True").when(~F.col("is_buyer_maker"), "False")
    bar = F.lit("|")
    text = F.concat(symbol, bar, F.col("trade_id").cast("string"), bar, eight_decimals(df, "price"), bar, eight_decimals(df, "quantity"), bar, iso, bar, maker)
    return F.sha2(text, 256)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, trade_id, record_hash, loaded_at) of every delivery in both tables."""
    raw = read(spark, d, "stg_raw_trades").select("symbol", "trade_id", "price", "quantity", "is_buyer_maker", "record_hash", "trade_timestamp", "feed", "ingested_at")
    given = F.nullif(F.lower(F.trim("record_hash")), F.lit(""))
    sym = canonical_symbol(F.col("symbol"))
    # only the few rows without a hash have their time text read
    bare = normalise_timestamps(raw.where(given.isNull()), read(spark, d, "feed_zones"))
    fact = read(spark, d, "fact_trades")
    pick = lambda df, h, at: df.select(sym.alias("symbol"), "trade_id", h.alias("record_hash"), F.col(at).alias("loaded_at"))
    hashed = pick(raw.where(given.isNotNull()), given, "ingested_at").unionByName(pick(bare, content_hash(bare, sym, F.col("utc_us")), "ingested_at"))
    return hashed.unionByName(pick(fact, F.coalesce(given, content_hash(fact, sym, F.unix_micros(F.col("trade_timestamp").cast("timestamp")))), "created_at"))


_MESSAGE = ["symbol", "trade_id", "record_hash"]


def month_bucket(c: Column) -> Column:
    """Months since the year 0: the time buckets of the storage."""
    return F.year(c) * 12 + F.month(c)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return once.repeated_messages(messages(spark, d), _MESSAGE, month_bucket(F.col("loaded_at")))


def p4_once(spark: SparkSession, d: str) -> DataFrame:
    """One copy of each message: the first loaded."""
    return once.keep_once(messages(spark, d), _MESSAGE, month_bucket(F.col("loaded_at")), [F.col("loaded_at")])


# 5 drifting schemas

_TAPE = ["trade_id", "symbol", "price", "quantity", "quote_quantity", "trade_timestamp", "is_buyer_maker", "trade_type", "ingested_at"]


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each file's edit script against the file before it."""
    return drift.file_changes(read(spark, d, "trade_event_v1"), "stream", "file_seq", "file_id", "body")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_changes(spark, d).select(F.col("file").alias("file_id"), "old_field", "new_field")


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    """All records as one table of trades with constant columns; fields that files add beside them are in ``others``."""
    x = drift.unified(read(spark, d, "trade_event_v1"), "file_id", "body", _TAPE, ["event_seq", "stream", "file_seq"], stream="stream", seq="file_seq", rest="others")
    number = {c: F.col(c).try_cast("double") for c in ("price", "quantity", "quote_quantity")}
    return x.withColumns(number | {"trade_id": F.col("trade_id").try_cast("long")})


# 6 rows that fail to parse

_CSV = ["trade_id", "symbol", "price", "quantity", "quote_quantity", "trade_timestamp", "is_buyer_maker"]


def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    """Both inputs as text columns, with the reason of those that can't be loaded."""
    raw = tokenizer.parse_records(read(spark, d, "raw_trade_lines").select("row_id", "raw_line"), "raw_line", _CSV, ["row_id"])
    cut = read(spark, d, "unit_test_50").select("row_id", *_CSV, F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("at_byte"))
    why = F.coalesce("reason", tokenizer.bad_value(F.col("trade_id"), F.col("price"), F.col("quantity")))
    return raw.unionByName(cut).withColumn("reason", why)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_rows(spark, d).where("reason is not null").select("row_id")


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rows per kind of failure."""
    return p6_rows(spark, d).where("reason is not null").groupBy(F.split("reason", ":")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The loadable trades, typed."""
    x = p6_rows(spark, d).where("reason is null")
    return x.select("row_id", tokenizer.positive_integer(F.col("trade_id")).alias("trade_id"), canonical_symbol(F.col("symbol")).alias("symbol"), tokenizer.positive_number(F.col("price")).alias("price"), tokenizer.positive_number(F.col("quantity")).alias("quantity"))


# 7 late events


def tape_copies(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "realtime_raw_trades")
    ident = {"symbol": canonical_symbol(F.col("symbol")), "trade_id": F.col("trade_id")}
    values = {c: F.col(c) for c in ("price", "quantity", "quote_quantity", "is_buyer_maker")}
    return slices.first_copies(t, ident, F.col("ingested_at").cast("timestamp"), F.col("trade_timestamp").cast("timestamp"), values)


def tape_panes(spark: SparkSession, d: str) -> DataFrame:
    return slices.panes(slices.in_time(tape_copies(spark, d), LATE_MS), ["symbol"], slices.pane_ms(MINUTE_MS))


def p7_candles(spark: SparkSession, d: str) -> DataFrame:
    """The right candles of a minute."""
    x = slices.compose(tape_panes(spark, d), ["symbol"], MINUTE_MS)
    return x.select("symbol", "window_start_ms", "open_price", "high_price", "low_price", "close_price", F.col("trade_count").cast("long").alias("trade_count"))


def p7_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Five-minute windows every minute: each pane of a minute is composed into the five windows over it."""
    x = slices.compose(tape_panes(spark, d), ["symbol"], 5 * MINUTE_MS, MINUTE_MS)
    return x.select("symbol", "window_start_ms", "open_price", "high_price", "low_price", "close_price", F.col("trade_count").cast("long").alias("trade_count"))


def p7_reemitted(spark: SparkSession, d: str) -> DataFrame:
    """Windows that late trades correct: composed from the panes of trades in time for the end of their pane, and anew, only
    where a late trade changed a pane, from those panes merged with the late ones."""
    x = slices.in_time(tape_copies(spark, d), LATE_MS)
    ms = F.unix_millis("__event")
    late = F.unix_micros("__arrived") >= (ms - F.pmod(ms, F.lit(MINUTE_MS)) + MINUTE_MS) * 1000
    first, then = (slices.panes(x.where(c), ["symbol"], MINUTE_MS) for c in (~late, late))
    touched = slices.affected_windows(then, ["symbol"], 5 * MINUTE_MS, MINUTE_MS)
    under = slices.panes_under(touched, ["symbol"], 5 * MINUTE_MS, MINUTE_MS)
    merged = slices.merge_panes(first, then, ["symbol"]).join(under, ["symbol", "pane_start_ms"], "left_semi")
    again = slices.compose(merged, ["symbol"], 5 * MINUTE_MS, MINUTE_MS).join(touched, ["symbol", "window_start_ms"], "left_semi")
    before = slices.compose(first, ["symbol"], 5 * MINUTE_MS, MINUTE_MS).select("symbol", "window_start_ms", F.col("trade_count").alias("emitted"))
    return again.join(before, ["symbol", "window_start_ms"], "left").select("symbol", "window_start_ms", F.coalesce("emitted", F.lit(0)).cast("long").alias("emitted"), F.col("trade_count").cast("long").alias("corrected"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "realtime_market_candles")
    start = F.unix_millis(F.col("window_start").cast("timestamp"))
    last = slices.latest_emission(c, {"symbol": canonical_symbol(F.col("symbol"))}, start, F.col("emitted_at").cast("timestamp"), F.col("trade_count"))
    right = slices.compose(tape_panes(spark, d), ["symbol"], MINUTE_MS)
    return slices.corrections(right, last, ["symbol"]).select("symbol", "window_start_ms")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_plan, p1_groups, p1_consolidated, p1_reconciled, p2_found, p2_undecided, p3_found, p3_current, p3_patched, p4_found, p4_once, p5_found, p5_changes, p5_unified, p6_found, p6_reasons, p6_loaded, p7_found, p7_candles, p7_sliding, p7_reemitted,
    )
}

_CANON = r"upper(regexp_replace(symbol, '^[\s]+|[\s]+$', '', 'g'))"
_OPS = "lower(regexp_replace(op_type, '^[\\s]+|[\\s]+$', '', 'g'))"
_P3 = f"""with ev as (select {_CANON} as symbol, trade_id, lsn, payload, {_OPS} as spelled, case when {_OPS} in ('insert','create','c','r','read','update','u') then 'w' when {_OPS} in ('delete','d') then 'd' end as op
  from cdc_mutation_events), ok as (select * from ev where op is not null and symbol <> '' and trade_id is not null and lsn is not null),
k as (select symbol, trade_id, max(lsn) filter (op = 'w') as w, max(lsn) filter (op = 'd') as d from ok group by all)"""
_P7 = f"""with t as (select {_CANON} as symbol, trade_id, ingested_at, trade_timestamp, price, row_number() over (partition by {_CANON}, trade_id order by ingested_at, trade_timestamp nulls first, price, quantity) as rn from realtime_raw_trades
  where symbol is not null and trade_id is not null and ingested_at is not null),
ok as (select *, epoch_us(trade_timestamp) // 60000000 * 60000 as window_start_ms from t where rn = 1 and trade_timestamp is not null and epoch_us(ingested_at) - epoch_us(trade_timestamp) <= 600000000)"""
_P6 = r"""with num as (select '^[+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$' as n),
raw as (select row_id, regexp_replace(raw_line, '[\r\n]+$', '') as l from raw_trade_lines),
cut as (select row_id, regexp_full_match(l, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*)){6}') as ok, regexp_extract_all(l || ',', '("([^"]|"")*"|[^",]*),', 1) as f from raw),
val as (select row_id, ok, list_transform(f, lambda x: case when x like '"%' then replace(x[2:-2], '""', '"') else x end) as f from cut),
j as (select row_id, ok, f[1] as trade_id, f[2] as symbol, f[3] as price, f[4] as quantity, lower(trim(f[1])) = 'trade_id' and lower(trim(f[3])) = 'price' as head from val
  union all select row_id, true, trade_id, symbol, price, quantity, false from unit_test_50),
c as (select row_id, ok, symbol, coalesce(head and ok, false) as head, trim(trade_id, ' ' || chr(9)) as t, trim(price, ' ' || chr(9)) as p, trim(quantity, ' ' || chr(9)) as q from j),
b as (select *, coalesce(not regexp_full_match(t, '[0-9]+') or coalesce(try_cast(t as bigint), 0) <= 0, true) as bad_t,
  coalesce(not regexp_matches(p, n) or not (coalesce(try_cast(p as double), 0) > 0) or try_cast(p as double) = 'inf'::double, true) as bad_p, coalesce(not regexp_matches(q, n) or not (coalesce(try_cast(q as double), 0) > 0) or try_cast(q as double) = 'inf'::double, true) as bad_q from c, num)"""
_LAKE_SQL = f"""with r as (select partition_year as y, partition_month as m, partition_day as d, {_CANON} as s, source_file as f, trade_id as t, price as p, quantity as q, trade_timestamp as ts,
  strlen(symbol) + 8 * ((trade_id is not null)::int + (price is not null)::int + (quantity is not null)::int + (quote_quantity is not null)::int + (trade_timestamp is not null)::int) + (is_buyer_maker is not null)::int + 12 as b from stg_market_trades where source_file is not null),
man as (select y, m, d, s, f, count(*) as n, count(*) filter (t is null) as bad, cast(sum(b) as bigint) as bytes from r group by all),
rec as (select distinct y, m, d, s, f, hash(t, p, q, ts) as h from r where t is not null),
siz as (select y, m, d, s, f, count(*) as k from rec group by all),
met as (select a.y, a.m, a.d, a.s, a.f, b.f as g, count(*) as k from rec a join rec b on a.y = b.y and a.m = b.m and a.d = b.d and a.s = b.s and a.h = b.h and a.f <> b.f group by all),
gone as (select distinct met.y, met.m, met.d, met.s, met.f from met join siz a on met.f = a.f and met.y = a.y and met.m = a.m and met.d = a.d and met.s = a.s join siz b on met.g = b.f and met.y = b.y and met.m = b.m and met.d = b.d and met.s = b.s
  join man ma on ma.f = met.f and ma.bad = 0 join man mb on mb.f = met.g where met.k = a.k and (b.k > a.k or mb.bad > 0 or met.g < met.f)),
sm as (select y, m, d, s, f, count(*) over (partition by y, m, d, s) as k from man where n < 40)"""


def _plan_sql(target: int) -> str:
    """The grouping said in windows over one partition at a time."""
    part = "partition by y, m, d, s"
    return f"""{_LAKE_SQL}, mg as (select man.*, gone.f is not null as gone from man left join gone using (y, m, d, s, f)),
o as (select *, row_number() over ({part} order by f) - 1 as rank, count(*) over ({part}) as k, coalesce(sum(case when gone then 0 else bytes end) over ({part} order by f rows between unbounded preceding and 1 preceding), 0) as start from mg where n < 40),
pr as (select *, least(rank // 2, greatest(k // 2, 1) - 1) as pair from o), g as (select *, cast(min(start) over ({part}, pair) // {target} as bigint) as grp from pr), mem as (select *, count(*) over ({part}, grp) as members from g),
pl as (select mg.*, case when mg.gone then 'drop' when coalesce(mem.members, 0) >= 2 then 'merge' else 'keep' end as action, case when mg.gone then null when coalesce(mem.members, 0) >= 2 then printf('consolidated-%012d', grp) else mg.f end as out_file
  from mg left join mem using (y, m, d, s, f)),
kept as (select r.*, pl.out_file from r join pl using (y, m, d, s, f) where pl.action <> 'drop'),
aft as (select y, m, d, s, min(out_file) as out_file, t from kept where t is not null group by y, m, d, s, t, p, q, ts union all select y, m, d, s, out_file, null from kept where t is null)"""


_PART_SQL = "y as partition_year, m as partition_month, d as partition_day, s as canonical"

SQL: dict[str, str] = {
    "p1_found": _LAKE_SQL + " select f as source_file from sm where k >= 2 union select f from gone",
    "p1_plan": _plan_sql(compaction.TARGET_BYTES) + f" select {_PART_SQL}, f as file, n as rows, bytes, action, out_file from pl",
    "p1_groups": _plan_sql(FINE_BYTES) + f" select {_PART_SQL}, out_file, count(*) as n_files, cast(sum(bytes) as bigint) as n_bytes, min(f) as first_file from pl where action = 'merge' group by all",
    "p1_consolidated": _plan_sql(compaction.TARGET_BYTES) + " select y as partition_year, m as partition_month, d as partition_day, s as symbol, count(distinct out_file) as n_files, count(*) as n_rows from aft group by all",
    "p1_reconciled": _plan_sql(compaction.TARGET_BYTES)
    + f""", b as (select y, m, d, s, count(distinct row(t, p, q, ts)) filter (t is not null) as records_before, count(*) filter (t is null) as unkeyed_before, count(*) as rows_before from r group by all),
a as (select y, m, d, s, count(t) as records_after, count(*) filter (t is null) as unkeyed_after, count(*) as rows_after from aft group by all)
select {_PART_SQL}, records_before, unkeyed_before, rows_before, records_after, unkeyed_after, rows_after, records_before = records_after and unkeyed_before = unkeyed_after as ok from b left join a using (y, m, d, s)""",
    "p3_found": _P3 + " select symbol, trade_id, w as lsn from k where w is not null and (d is null or w > d)",
    "p3_current": _P3
    + """, last as (select ok.symbol, ok.trade_id, ok.lsn, max(payload) as payload from ok join k on ok.symbol = k.symbol and ok.trade_id = k.trade_id and ok.lsn = k.w where op = 'w' and (d is null or w > d) group by all)
select symbol, trade_id, try_cast(json_extract_string(payload, '$.price') as double) as price, try_cast(json_extract_string(payload, '$.quantity') as double) as quantity,
try_cast(json_extract_string(payload, '$.quote_quantity') as double) as quote_quantity, try_cast(json_extract_string(payload, '$.is_buyer_maker') as boolean) as is_buyer_maker, lsn from last""",
    "p3_patched": _P3
    + f""", e2 as (select ok.*, spelled in ('insert','create','c','r','read') as whole from ok), ln as (select symbol, trade_id, max(lsn) filter (whole or op = 'd') as line from e2 group by all),
s as (select e2.*, try_cast(json_extract_string(payload, '$.price') as double) as p, try_cast(json_extract_string(payload, '$.quantity') as double) as q, try_cast(json_extract_string(payload, '$.quote_quantity') as double) as qq,
  try_cast(json_extract_string(payload, '$.is_buyer_maker') as boolean) as m from e2 join k using (symbol, trade_id) join ln using (symbol, trade_id) where op = 'w' and (k.d is null or k.w > k.d) and lsn >= coalesce(line, lsn))
select symbol, trade_id, (max(row(lsn, p)) filter (whole or p is not null))[2] as price, (max(row(lsn, q)) filter (whole or q is not null))[2] as quantity, (max(row(lsn, qq)) filter (whole or qq is not null))[2] as quote_quantity,
  (max(row(lsn, m)) filter (whole or m is not null))[2] as is_buyer_maker, max(lsn) as lsn from s group by symbol, trade_id""",
    "p7_found": _P7
    + f""", n as (select symbol, window_start_ms, count(*) as n from ok group by all),
c as (select {_CANON} as symbol, epoch_ms(window_start) as window_start_ms, arg_max(trade_count, emitted_at) as c from realtime_market_candles group by all)
select coalesce(n.symbol, c.symbol) as symbol, coalesce(n.window_start_ms, c.window_start_ms) as window_start_ms from n full join c on n.symbol = c.symbol and n.window_start_ms = c.window_start_ms where coalesce(n, 0) <> coalesce(c, 0)""",
    "p7_candles": _P7
    + """ select symbol, window_start_ms, arg_min(price, row(trade_timestamp, trade_id)) as open_price, max(price) as high_price, min(price) as low_price, arg_max(price, row(trade_timestamp, trade_id)) as close_price, count(*) as trade_count
from ok group by symbol, window_start_ms""",
    "p7_sliding": _P7
    + """, w as (select *, unnest(generate_series(window_start_ms - 240000, window_start_ms, 60000)) as w from ok) select symbol, w as window_start_ms, arg_min(price, row(trade_timestamp, trade_id)) as open_price, max(price) as high_price, min(price) as low_price,
arg_max(price, row(trade_timestamp, trade_id)) as close_price, count(*) as trade_count from w group by symbol, w""",
    "p7_reemitted": _P7
    + """, w as (select *, epoch_us(ingested_at) >= (window_start_ms + 60000) * 1000 as late, unnest(generate_series(window_start_ms - 240000, window_start_ms, 60000)) as w from ok)
select symbol, w as window_start_ms, count(*) filter (not late) as emitted, count(*) as corrected from w group by symbol, w having count(*) filter (late) > 0""",
    "p6_found": _P6
    + " select row_id from b where not head and (ok is null or not ok or bad_t or bad_p or bad_q)",
    "p6_reasons": _P6
    + r""", w as (select b.*, l, regexp_replace(l, '^(("([^"]|"")*"|[^",]*),)*', '') as rest, regexp_full_match(l, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') as quoted from b left join raw using (row_id) where not head),
r as (select case when l is null and ok is null then 'missing record' when l is not null and not quoted and rest like '"%' then case when regexp_matches(rest, '^"([^"]|"")*"[^",]') then 'text after a closing quote' else 'quote not closed' end
  when l is not null and not quoted then 'quote inside a plain field' when not ok then len(regexp_extract_all(l || ',', '("([^"]|"")*"|[^",]*),')) || ' columns in place of 7' when bad_t then 'trade_id' when bad_p then 'price' when bad_q then 'quantity' end as reason from w)
select reason, count(*) as n_rows from r where reason is not null group by all""",
    "p6_loaded": _P6
    + f" select row_id, try_cast(t as bigint) as trade_id, {_CANON} as symbol, try_cast(p as double) as price, try_cast(q as double) as quantity from b where not head and ok and not bad_t and not bad_p and not bad_q",
}
