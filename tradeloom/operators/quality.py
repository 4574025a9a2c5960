"""Sanitizing, quality gates, quarantine and declarative checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions.text import canonical_symbol, eight_decimals, strip

#: Highest plausible price by base asset (fixed values of the gate).
PRICE_LIMITS = {"BTCUSDT": 250_000.0, "ETHUSDT": 25_000.0, "SOLUSDT": 2_500.0}
TRUE_WORDS = ["true", "1", "t", "yes"]


def sanitized(df: DataFrame) -> DataFrame:
    """All-text trades typed, with reject_reason (null for those that pass) and record_hash.

    symbol trimmed and upper, 1 to 20 letters; trade_id a positive integer; price and quantity positive and finite; quote
    quantity price x quantity where absent, else a number; the time ISO (kept at its instant) or, all digits, epoch
    milliseconds; is_buyer_maker true only for true, 1, t, yes. The first failing rule is the reason; no row is dropped.
    """
    c = {n: strip(F.col(n)) for n in ("trade_id", "price", "quantity", "quote_quantity", "trade_timestamp", "is_buyer_maker")}
    sym, tid = canonical_symbol(F.coalesce("symbol", F.lit(""))), c["trade_id"].try_cast("bigint")
    price, qty = c["price"].try_cast("double"), c["quantity"].try_cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    blank = F.coalesce(c["quote_quantity"], F.lit("")) == ""
    quote = F.when(blank, price * qty).otherwise(c["quote_quantity"].try_cast("double"))
    digits = c["trade_timestamp"].rlike("^[0-9]{1,18}$")
    at = F.when(digits, F.timestamp_millis(F.when(digits, c["trade_timestamp"]).try_cast("long"))).otherwise(F.when(c["trade_timestamp"].rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$"), F.try_to_timestamp(c["trade_timestamp"])))
    reason = (
        F.when((F.length(sym) < 1) | (F.length(sym) > 20), "symbol").when(tid.isNull() | (tid <= 0), "trade_id").when(~finite(price) | (price <= 0), "price")
        .when(~finite(qty) | (qty <= 0), "quantity").when(quote.isNull(), "quote_quantity").when(at.isNull(), "trade_timestamp")
    )
    maker = F.coalesce(F.lower(c["is_buyer_maker"]).isin(TRUE_WORDS), F.lit(False))
    keep = [x for x in df.columns if x not in ("symbol", *c)]
    x = df.select(*keep, sym.alias("symbol"), tid.alias("trade_id"), price.alias("price"), qty.alias("quantity"), quote.alias("quote_quantity"), at.alias("trade_timestamp"), maker.alias("is_buyer_maker"), reason.alias("reject_reason"))
    return x.withColumn("record_hash", F.when(F.col("reject_reason").isNull(), record_hash()))


def record_hash(df: DataFrame | None = None) -> Column:
    """SHA-256 of symbol|id|price|quantity|UTC time|maker; the quote quantity is not part of it.
    df: where price and quantity may be decimals, the rows that the hash is for."""
    us = F.unix_micros("trade_timestamp")
    micros, secs = F.pmod(us, F.lit(1_000_000)), F.floor(us / 1_000_000)
    day, of = F.date_from_unix_date(F.floor(secs / 86400).cast("int")).cast("string"), F.pmod(secs, F.lit(86400))
    iso = F.concat(day, F.format_string("T%02d:%02d:%02d", F.floor(of / 3600), F.floor(of / 60) % 60, of % 60), F.when(micros == 0, "").otherwise(F.format_string(".%06d", micros)), F.lit("+00:00"))
    money = [eight_decimals(df, c) if df is not None else F.format_string("%.8f", c) for c in ("price", "quantity")]
    return F.sha2(F.concat_ws("|", "symbol", F.col("trade_id").cast("string"), *money, iso, F.when(F.col("is_buyer_maker"), "True").otherwise("False")), 256)


def violations(op: Column, symbol: Column, trade_id: Column, price: Column, quantity: Column, limits: dict[str, float] | None = None) -> Column:
    """All broken rules of a change as an array of names; a delete is held to identity only."""
    limits = PRICE_LIMITS if limits is None else limits
    top = F.lit(None).cast("double")
    for s, v in limits.items():
        top = F.when(symbol == s, v).otherwise(top)
    body = op != "delete"
    return F.array_compact(
        F.array(
            F.when(trade_id.isNull() | (trade_id <= 0), F.lit("INVALID_TRADE_ID")), F.when(F.coalesce(F.length(symbol), F.lit(0)) == 0, F.lit("MISSING_SYMBOL")),
            F.when(body & (price.isNull() | (price <= 0) | (quantity.isNull()) | (quantity <= 0)), F.lit("NON_POSITIVE")), F.when(body & (price > top), F.lit("PRICE_SPIKE")),
        )
    )


def validated_stream(df: DataFrame, allowed: list[str]) -> DataFrame:
    """df with error (first failure only): symbol not allowed, price, volume; and event_ms (numbers above 1e11 are milliseconds, below seconds)."""
    s, p, v = canonical_symbol(F.col("symbol")), F.col("price"), F.col("volume")
    err = F.when(~F.coalesce(s.isin(allowed), F.lit(False)), "Unknown symbol").when(~F.coalesce(p > 0, F.lit(False)), "Price must be positive").when(~F.coalesce(v > 0, F.lit(False)), "Volume must be positive")
    t = F.col("event_time").cast("double")
    return df.withColumns({"error": err, "event_ms": F.when(t > 1e11, t).otherwise(t * 1000).cast("long")})


def debezium(df: DataFrame, message: str, keep: list[str], image: str) -> DataFrame:
    """(keep, op_type, symbol, trade_id, row, commit_ts_ms, lsn) of change envelopes; unreadable ones have a null op_type.

    c, r: insert of after; u: update of after; d: delete of before. image: DDL of the row images.
    """
    e = F.from_json(F.col(message), f"before struct<{image}>, after struct<{image}>, source struct<lsn: bigint>, op string, ts_ms bigint")
    x = df.select(*keep, e.alias("e"))
    op = F.when(F.col("e.op").isin("c", "r"), "insert").when(F.col("e.op") == "u", "update").when(F.col("e.op") == "d", "delete")
    row = F.when(op == "delete", F.col("e.before")).otherwise(F.col("e.after"))
    x = x.select(*keep, op.alias("op_type"), row.alias("row"), F.col("e.ts_ms").alias("commit_ts_ms"), F.col("e.source.lsn").alias("lsn"))
    ok = F.col("row").isNotNull() & F.col("row.trade_id").isNotNull() & (F.coalesce(F.length(canonical_symbol(F.col("row.symbol"))), F.lit(0)) > 0)
    return x.select(*keep, F.when(ok, F.col("op_type")).alias("op_type"), canonical_symbol(F.col("row.symbol")).alias("symbol"), F.col("row.trade_id").alias("trade_id"), "row", "commit_ts_ms", "lsn")


def checks(df: DataFrame, not_null: list[str] = (), unique: list[str] = (), accepted: dict[str, list] | None = None, refers: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(check_name, failures) of declarative tests. Nulls pass unique, accepted and refers."""
    spark = df.sparkSession
    one = [F.count_if(F.col(c).isNull()).alias(f"not_null:{c}") for c in not_null]
    one += [F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(v)).alias(f"accepted:{c}") for c, v in (accepted or {}).items()]
    outs = []
    if one:  # all row-wise tests in one pass
        names = [f"not_null:{c}" for c in not_null] + [f"accepted:{c}" for c in accepted or {}]
        x = df.agg(*one)
        outs.append(x.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("failures")) for n in names]))))
    for c in unique:
        outs.append(df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").agg(F.lit(f"unique:{c}").alias("check_name"), F.count(F.lit(1)).alias("failures")))
    for c, (other, k) in (refers or {}).items():
        keys = other.select(F.col(k).alias("__k"))
        outs.append(df.where(F.col(c).isNotNull()).join(keys, F.col(c) == F.col("__k"), "left_anti").agg(F.lit(f"refers:{c}").alias("check_name"), F.count(F.lit(1)).alias("failures")))
    out = outs[0] if outs else spark.createDataFrame([], "check_name string, failures long")
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def quarantine(df: DataFrame, reasons: str, path: str, source: str) -> DataFrame:
    """Append the rows with a reason to the quarantine as JSON lines and return the others. reasons: a text or an array of texts."""
    some = F.size(reasons) > 0 if df.schema[reasons].dataType.typeName() == "array" else F.col(reasons).isNotNull()
    bad = df.where(F.coalesce(some, F.lit(False)))
    bad.select(F.current_timestamp().alias("quarantined_at"), F.lit(source).alias("source"), F.col(reasons).alias("reasons"), F.to_json(F.struct(*[c for c in df.columns if c != reasons])).alias("row")).write.mode("append").json(path)
    return df.where(~F.coalesce(some, F.lit(False))).drop(reasons)


def write_lines(df: DataFrame, path: str) -> None:
    """df as JSON lines in place of what the folder holds."""
    df.write.mode("overwrite").json(path)
