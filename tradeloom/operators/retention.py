"""Retention: what a sweep deletes, archives and keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.table import SnapshotTable


def split_by_age(df: DataFrame, at: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(older than the cut-off, the others): strictly older; rows without a readable time stay with the others."""
    c = F.col(at) if dict(df.dtypes)[at] != "string" else F.try_to_timestamp(F.col(at))
    old = F.coalesce(c < cutoff, F.lit(False))
    return df.where(old), df.where(~old)


def sweep(tables: dict[str, tuple[DataFrame, str, int]], now: Column) -> dict[str, tuple[int, DataFrame]]:
    """Per name (rows deleted, rows kept) for (table, time column, hours to keep)."""
    out = {}
    for name, (df, at, hours) in tables.items():
        old, kept = split_by_age(df, at, now - F.expr(f"interval {int(hours)} hours"))
        out[name] = (old.count(), kept)
    return out


def archive(df: DataFrame, at: str, cutoff: Column, archive_path: str, kept_path: str) -> tuple[int, int]:
    """Split by age into two writes, the older rows appended to the archive and the others written anew; (archived, kept).

    kept_path must not be where df is read from; the caller swaps the folders once both writes are there.
    """
    old, kept = split_by_age(df, at, cutoff)
    n = old.count()
    if n:
        old.write.mode("append").json(archive_path)
    kept.write.mode("overwrite").json(kept_path)
    return n, kept.sparkSession.read.schema(kept.schema).json(kept_path).count()


#: Hours that each kind of data is kept (fixed values of the policy): live trades, candles, snapshots, dead letters.
KEEP_HOURS = {"trades": 24, "candles": 7 * 24, "snapshots": 14 * 24, "letters": 30 * 24}


def full_sweep(trades: DataFrame, candles: DataFrame, snapshots: SnapshotTable, letters: DataFrame, now: Column, archive_path: str, kept_path: str) -> dict[str, object]:
    """The whole policy: kept trades and candles as frames, expired snapshots by number, letters archived; with the counts of each."""
    spark = trades.sparkSession
    rows = sweep({"trades": (trades, "trade_timestamp", KEEP_HOURS["trades"]), "candles": (candles, "window_start", KEEP_HOURS["candles"])}, now)
    now_ms = spark.range(1).select(F.unix_millis(now.cast("timestamp"))).first()[0]
    expired = snapshots.expired(now_ms - KEEP_HOURS["snapshots"] * 3_600_000)
    archived, kept = archive(letters, "failed_at_utc", now - F.expr(f"interval {KEEP_HOURS['letters']} hours"), archive_path, kept_path)
    return {"trades": rows["trades"], "candles": rows["candles"], "expired_snapshots": expired, "letters_archived": archived, "letters_kept": kept}
