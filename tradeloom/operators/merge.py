"""Upserts and ordered merges as DataFrames: a new state from the old one and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.blocks import previous_in_key


def last_per_key(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order`` and then by all columns; combines before the shuffle."""
    rest = [c for c in batch.columns if c not in key and c not in order]
    g = batch.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return g.select(*key, *[F.col(f"r.{c}").alias(c) for c in [*order, *rest]]).select(*batch.columns)


def hash_guarded_upsert(target: DataFrame, batch: DataFrame, key: list[str], hash_col: str, order: list[str], now: Column, created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """target after the batch, with __action: insert, update, or keep.

    Absent keys are inserted; present ones are overwritten only if the hash differs (created stays); else nothing changes.
    Keys that repeat in the batch: the last by ``order`` counts. Null keys of the batch are left out; a null hash differs
    from any hash. target holds each key once; its columns are the result's.
    """
    for k in key:
        batch = batch.where(F.col(k).isNotNull())
    values = [c for c in target.columns if c not in (*key, created, updated)]
    b = last_per_key(batch, key, order).select(*key, *[F.col(c).cast(target.schema[c].dataType).alias(f"__b_{c}") for c in values], F.lit(True).alias("__new"))
    x = target.withColumn("__old", F.lit(True)).join(b, key, "full_outer")
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull() | F.col(hash_col).eqNullSafe(F.col(f"__b_{hash_col}")), "keep").otherwise("update")
    x = x.withColumn("__action", action)
    put = F.col("__action") != "keep"
    return x.select(
        *key, *[F.when(put, F.col(f"__b_{c}")).otherwise(F.col(c)).alias(c) for c in values], F.when(F.col("__action") == "insert", now).otherwise(F.col(created)).alias(created), F.when(put, now).otherwise(F.col(updated)).alias(updated), "__action"
    )


def insert_or_replace(target: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch replace those of the target by key; the last of the batch by ``order`` wins."""
    b = last_per_key(batch, key, order)
    return target.join(b.select(*key), key, "left_anti").select(*target.columns).unionByName(b.select(*target.columns))


def ordered_merge(base: DataFrame, events: DataFrame, key: list[str], seq: str, op: str) -> DataFrame:
    """base after insert, update and delete events in order of seq; both writes overwrite whether or not the key exists."""
    cols = [c for c in base.columns if c not in key]
    last = events.groupBy(*key).agg(F.max_by(F.struct(op, *cols), seq).alias("r"))
    alive = last.where(F.col(f"r.{op}") != "delete").select(*key, *[F.col(f"r.{c}").alias(c) for c in cols])
    return base.join(last.select(*key), key, "left_anti").select(*base.columns).unionByName(alive.select(*base.columns))


def merge_counts(base: DataFrame, events: DataFrame, key: list[str], seq: str, op: str) -> DataFrame:
    """One row: added, updated, deleted, total after the events. An insert always adds; an update of an absent key adds;
    a delete counts only if the key exists then."""
    ev = previous_in_key(events.select(*key, seq, op), key, seq, op, "__prev").join(base.select(*key).distinct().withColumn("__base", F.lit(True)), key, "left")
    there = F.when(F.col("__prev").isNotNull(), F.col("__prev") != "delete").otherwise(F.col("__base").isNotNull())
    kind, ops = F.col(op), ev.withColumn("__there", there)
    counts = ops.agg(
        F.count_if((kind == "insert") | ((kind == "update") & ~F.col("__there"))).alias("added"), F.count_if((kind == "update") & F.col("__there")).alias("updated"), F.count_if((kind == "delete") & F.col("__there")).alias("deleted")
    )
    # two tables of one row each meet on a constant
    total = ordered_count(base, events, key, seq, op).withColumn("__one", F.lit(1))
    return counts.withColumn("__one", F.lit(1)).join(total, "__one").drop("__one")


def ordered_count(base: DataFrame, events: DataFrame, key: list[str], seq: str, op: str) -> DataFrame:
    last = events.groupBy(*key).agg(F.max_by(op, seq).alias("__last"))
    x = base.select(*key).distinct().join(last, key, "full_outer")
    return x.agg(F.count_if(F.coalesce(F.col("__last") != "delete", F.lit(True))).alias("total"))
