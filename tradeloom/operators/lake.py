"""Hive-partitioned Parquet lake: paths, writes, reads, statistics and compaction of a directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def partition_columns(at: Column, local_text: Column | None = None) -> dict[str, Column]:
    """year, month, day as padded text: of the UTC day, or of an ISO text's own clock if one is given."""
    if local_text is not None:
        return {"year": F.substring(local_text, 1, 4), "month": F.substring(local_text, 6, 2), "day": F.substring(local_text, 9, 2)}
    day = F.date_from_unix_date(F.floor(F.unix_micros(at) / 86_400_000_000).cast("int")).cast("string")
    return {"year": F.substring(day, 1, 4), "month": F.substring(day, 6, 2), "day": F.substring(day, 9, 2)}


_PARTS = ["year", "month", "day", "symbol"]


def write_trades(df: DataFrame, path: str, at: str = "trade_timestamp", symbol: str = "symbol", compression: str = "snappy", rows_per_file: int = 5_000_000, mode: str = "append") -> None:
    """Append under year=/month=/day=/symbol=, one file for each ``rows_per_file`` rows of a partition.

    The rows of each partition are counted first; a partition above the size is dealt over as many tasks as it fills files,
    a smaller one stays together, so no partition gets more files than its rows need.
    """
    x = df.withColumns({**partition_columns(F.col(at).cast("timestamp")), "symbol": F.upper(F.trim(F.col(symbol)))})
    large = x.groupBy(*_PARTS).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("__files")).where("__files > 1")
    large = large.select("__files", *[F.col(c).alias(f"__{c}") for c in _PARTS])
    on = F.lit(True)
    for c in _PARTS:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    y = x.join(large, on, "left").select(*x.columns, F.coalesce("__files", F.lit(1)).alias("__files"))
    y = y.repartition(*_PARTS, F.pmod(F.xxhash64(*df.columns), F.col("__files"))).drop("__files")
    y.write.mode(mode).option("compression", compression).option("maxRecordsPerFile", rows_per_file).partitionBy(*_PARTS).parquet(path)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """All partitions below path; filters on year, month, day and symbol prune directories."""
    return spark.read.parquet(path)


def file_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Parquet files below a path with their bytes, listed through the file system of the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        if s.getPath().getName().endswith(".parquet"):
            out.append((s.getPath().toString(), s.getLen()))
    return sorted(out)


def stats(spark: SparkSession, path: str) -> dict[str, int]:
    """Files, bytes and distinct symbols by path."""
    files = file_sizes(spark, path)
    symbols = {part[7:] for f, _ in files for part in f.split("/") if part.startswith("symbol=")}
    return {"files": len(files), "bytes": sum(s for _, s in files), "symbols": len(symbols)}


def compact_directory(spark: SparkSession, path: str, out: str, target_bytes: int = 128 << 20) -> dict[str, float]:
    """Rewrite a directory, partitioned or not, into files of about ``target_bytes`` in another one with the same partitions.

    Each partition gets as many files as its bytes need (the sizes are listed by the file system); nothing to read is skipped.
    """
    before = file_sizes(spark, path)
    if not before:
        return {"files_before": 0, "files_after": 0, "reduction": 0.0}
    x = spark.read.parquet(path)
    keys = list(dict.fromkeys(p.split("=", 1)[0] for f, _ in before for p in f.split("/") if "=" in p and p.split("=", 1)[0] in x.columns))
    folder = lambda f: f.rpartition("/")[0]
    need: dict[str, int] = {}
    for f, n in before:
        need[folder(f)] = need.get(folder(f), 0) + n
    files = spark.createDataFrame([(k, max(1, -(-n // target_bytes))) for k, n in need.items()], "__folder string, __files long")
    # names in a path are written with escapes, in the listing as in the metadata
    x = x.withColumn("__folder", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")).join(F.broadcast(files) if len(need) <= 100_000 else files, "__folder", "left")
    rest = [c for c in x.columns if c not in ("__folder", "__files", *keys)]
    y = x.repartition(*[F.col(k) for k in keys], F.pmod(F.xxhash64(*rest), F.coalesce("__files", F.lit(1)))).drop("__folder", "__files")
    w = y.write.mode("errorifexists")
    (w.partitionBy(*keys) if keys else w).parquet(out)
    after = file_sizes(spark, out)
    return {"files_before": len(before), "files_after": len(after), "bytes_before": sum(s for _, s in before), "bytes_after": sum(s for _, s in after), "reduction": round(100 * (1 - len(after) / len(before)), 1)}
