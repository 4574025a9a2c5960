"""Reads of CSV, JSON lines and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_COLUMNS = ["trade_id", "symbol", "price", "quantity", "quote_quantity", "trade_timestamp", "is_buyer_maker"]


def csv_text(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All values as text, with _file and _seq (order inside a file: the offset of its split and the place in it)."""
    schema = ", ".join(f"`{c}` string" for c in columns or CSV_COLUMNS)
    x = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return x.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))


def csv_typed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)
