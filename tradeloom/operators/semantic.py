"""Named views over the tables and queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.operators import marts
from tradeloom.operators.table import SnapshotTable
from tradeloom.session import written

VIEWS = ("v_realtime_trades", "v_daily_market_metrics", "v_lakehouse_snapshots")


def register(spark: SparkSession, table: SnapshotTable) -> None:
    t = table.read().where("trade_id > 0")
    t.createOrReplaceTempView(VIEWS[0])
    marts.daily_metrics(t, quantity_digits=4).drop("maker_count", "taker_count").createOrReplaceTempView(VIEWS[1])
    table.history().withColumn("committed_at", F.timestamp_millis("timestamp_ms")).createOrReplaceTempView(VIEWS[2])


def query_view(spark: SparkSession, name: str) -> DataFrame:
    """The view's rows; only the known names are views."""
    if name not in VIEWS:
        raise ValueError(f"no view {name!r}")
    return spark.table(name)


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"create database if not exists `{name}`")


def create_table(spark: SparkSession, name: str, schema: str) -> None:
    """An empty table of that name if there is none."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)


def create_table_as(df: DataFrame, name: str, partition_by: list[str] = ()) -> DataFrame:
    """df as the table of that name, in place of the one there was."""
    w = df.write.format("parquet").mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(name)
    return df.sparkSession.table(name)


def seed(rows: DataFrame, name: str, key: list[str]) -> int:
    """Insert the rows whose key the table doesn't have; returns how many. Of rows with one key the least is taken; null keys are left out."""
    there = rows.sparkSession.table(name)
    rest = [c for c in there.columns if c not in key]
    new = rows.dropna(subset=key).groupBy(*key).agg(F.min(F.struct(*rest) if rest else F.lit(1)).alias("r"))
    new = new.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).join(there.select(*key), key, "left_anti").select(*there.columns)
    new = written(new, "seed")
    new.write.insertInto(name)
    return new.count()
