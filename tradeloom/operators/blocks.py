"""Order-dependent operators over a whole stream, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.session import written


def _ranged(df: DataFrame, by: list[str]) -> DataFrame:
    """df written in ranges of ``by`` of like size, with the number of its range as __b. Written, since the bounds of ranges are
    drawn anew each time a plan runs."""
    return written(df.repartitionByRange(*[F.col(c) for c in by]).withColumn("__b", F.spark_partition_id()), "ranges")


def running_max(df: DataFrame, seq: str, value: Column, out: str) -> DataFrame:
    """df with the greatest value up to each row in order of seq (this row included; nulls don't count).

    Two levels: a window inside ranges of rows, and the maximum of the ranges before, of which there are as many as
    shuffle partitions however sparse seq is. Rows with a null seq come first. Equal seq: rows see each other's values (they
    lie in one range).
    """
    x = _ranged(df.withColumn("__v", value), [seq])
    tops = x.groupBy("__b").agg(F.max("__v").alias("__m"))
    tops = tops.select("__b", F.max("__m").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    w = Window.partitionBy("__b").orderBy(seq).rangeBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__in", F.max("__v").over(w)).join(tops, "__b", "left")
    return x.withColumn(out, F.greatest("__in", "__before")).drop("__b", "__v", "__in", "__before")


def previous_in_key(df: DataFrame, key: list[str], seq: str, value: str, out: str, ties: list[str] = ()) -> DataFrame:
    """df with the value of the row before in its key by seq and ties (null for the first), hot keys split into ranges of rows."""
    order = [seq, *ties]
    x = _ranged(df, [*key, *order])
    last = x.groupBy(*key, "__b").agg(F.max_by(value, F.struct(*order)).alias("__l"))
    last = last.select(*key, "__b", F.lag("__l").over(Window.partitionBy(*key).orderBy("__b")).alias("__before"))
    w = Window.partitionBy(*key, "__b").orderBy(*order)
    x = x.withColumns({"__p": F.lag(value).over(w), "__n": F.row_number().over(w)}).join(last, [*key, "__b"], "left")
    return x.withColumn(out, F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col("__p"))).drop("__b", "__p", "__n", "__before")


def lateness(df: DataFrame, seq: str, event_ms: str, window_ms: int, delay_ms: int, counts: Column | None = None) -> DataFrame:
    """df with watermark_ms, window_start_ms and is_late: a row is late if its window ended at or before the watermark.

    The watermark is the greatest event time so far (this row included) less the delay. counts: rows that may move it
    (others, such as invalid ones, may not). A null event time is never late and has no window.
    """
    moves = F.col(event_ms) if counts is None else F.when(counts, F.col(event_ms))
    x = running_max(df, seq, moves, "__top")
    start = F.col(event_ms) - F.pmod(F.col(event_ms), F.lit(window_ms))
    mark = F.col("__top") - delay_ms
    return x.withColumns({"watermark_ms": mark, "window_start_ms": start, "is_late": F.coalesce(start + window_ms <= mark, F.lit(False))}).drop("__top")
