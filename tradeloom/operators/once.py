"""Messages delivered more than once: Bloom filters per time bucket, exact check against matching storage.

1. Copies inside a batch of rows are counted into one before anything is shuffled, so a message that is a third of all rows
   is a few. The rest is dealt by hash of the identity: one shuffle.
2. A pass over each share in order of time keeps one filter per bucket. An identity that no filter knows is definitely new;
   the others are marked with the buckets whose filters match. All are written as storage, one folder per bucket.
3. Only marked identities are looked up, by exact identity, and only in the folders of the buckets they are marked with.

Filters are split by hash of the identity, so their memory is bounded by a partition's share and nothing is broadcast that
isn't small. They have no false negatives: the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.session import scratch, written

#: Words of 64 bits in a slice of a filter, and identities that a slice takes before its bucket gets another.
WORDS, FILL = 4096, 16384
#: Words of the filter over all earlier buckets together, which is asked first.
ALL_WORDS = 1 << 18

#: Marked identities (12 bytes each) up to which they are sent to every executor; more are joined by a shuffle.
SMALL_ROWS = 2_000_000


class Filters:
    """Register-blocked Bloom filters: an identity has four bits in one 64-bit word. A bucket may have several slices."""

    def __init__(self) -> None:
        self.bits = np.zeros((8, WORDS), dtype=np.uint64)
        self.every = np.zeros(ALL_WORDS, dtype=np.uint64)
        self.bucket: list[int] = []
        self.held = 0

    @staticmethod
    def places(h: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
        u = h.view(np.uint64)
        mask = np.zeros(len(u), dtype=np.uint64)
        for shift in (20, 28, 36, 44):
            mask |= np.uint64(1) << ((u >> np.uint64(shift)) & np.uint64(63))
        return (u & np.uint64(words - 1)).astype(np.int64), mask

    def known(self, h: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
        """(identity, bucket) for each identity, by place in h, and each bucket before ``before`` whose filter matches it."""
        w, mask = self.places(h, ALL_WORDS)
        some = np.flatnonzero((self.every[w] & mask) == mask)
        w, mask = self.places(h[some])
        who, where = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for s, b in enumerate(self.bucket):
            if b != before:
                hit = some[(self.bits[s][w] & mask) == mask]
                who.append(hit)
                where.append(np.full(len(hit), b))
        both = np.unique(np.stack([np.concatenate(who), np.concatenate(where)]), axis=1)
        return both[0], both[1]

    def add(self, h: np.ndarray, bucket: int) -> None:
        w, mask = self.places(h, ALL_WORDS)
        np.bitwise_or.at(self.every, w, mask)
        w, mask = self.places(h)
        for lo in range(0, len(h), FILL):
            if not self.bucket or self.bucket[-1] != bucket or self.held >= FILL:
                self.bucket.append(bucket)
                self.held = 0
                if len(self.bucket) > len(self.bits):
                    self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            part = slice(lo, lo + FILL)
            np.bitwise_or.at(self.bits[len(self.bucket) - 1], w[part], mask[part])
            self.held += len(w[part])


def combined(messages: DataFrame, key: list[str], bucket: Column) -> DataFrame:
    """(key, __bucket, __h, __copies): messages with the copies that stand in one batch of rows counted together, and a hash
    of the identity. Rows with a null in the key are no messages; a null bucket is one of its own."""
    x = messages.select(*key, F.coalesce(bucket.cast("int"), F.lit(-(2**31))).alias("__bucket"))
    for k in key:
        x = x.where(F.col(k).isNotNull())
    x = x.withColumn("__h", F.xxhash64(*key))
    names = x.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(names).aggregate([([], "count_all")])
            yield from t.select([*names, "count_all"]).rename_columns([*names, "__copies"]).combine_chunks().to_batches()

    return x.mapInArrow(count, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields) + ", __copies bigint")


def screened(messages: DataFrame) -> DataFrame:
    """The rows of ``combined`` with __in: the buckets whose filters know the identity (null: it is definitely new). The own
    bucket is among them where the identity stands there several times."""
    x = messages.repartition("__h").sortWithinPartitions("__bucket", "__h")
    names = x.columns

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, last = Filters(), (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, h, copies = (batch.column(names.index(c)).to_numpy() for c in ("__bucket", "__h", "__copies"))
            # equal identities of one bucket follow each other
            own = copies > 1
            own[1:] |= (h[1:] == h[:-1]) & (bucket[1:] == bucket[:-1])
            own[0] |= (bucket[0], h[0]) == last
            last = (bucket[-1], h[-1])
            who, where = [np.flatnonzero(own)], [bucket[own].astype(np.int64)]
            for part in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                b = int(bucket[part[0]])
                i, met = filters.known(h[part], b)
                who.append(part[i])
                where.append(met)
                filters.add(h[part], b)
            who, where = np.concatenate(who), np.concatenate(where)
            order = np.argsort(who, kind="stable")
            n = np.bincount(who, minlength=len(h))
            marks = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(where[order].astype(np.int32)), mask=pa.array(n == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*names, "__in"])

    return x.mapInArrow(screen, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields) + ", __in array<int>")


def storage(messages: DataFrame, key: list[str], bucket: Column) -> DataFrame:
    """The screened messages, written under one folder per time bucket."""
    x = screened(combined(messages, key, bucket))
    path = scratch(messages.sparkSession, "messages-by-bucket")
    x.write.partitionBy("__bucket").parquet(path)
    kinds = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    return messages.sparkSession.read.schema(", ".join(f"`{c}` {kinds[c]}" for c in [*[c for c in kinds if c != "__bucket"], "__bucket"])).parquet(path)


def repeated_messages(messages: DataFrame, key: list[str], bucket: Column) -> DataFrame:
    """The keys that stand at least twice, once each.

    What is read to the driver are the numbers of the buckets that have a match, one per time bucket at most.
    """
    store = storage(messages, key, bucket)
    marked = store.where(F.col("__in").isNotNull())
    maybe = written(marked.select("__h", F.explode(F.array_union("__in", F.array("__bucket"))).alias("__bucket")).distinct(), "marked")
    count = {r[0]: r[1] for r in maybe.groupBy("__bucket").agg(F.count(F.lit(1))).collect()}
    buckets = sorted(count)
    if sum(count.values()) <= SMALL_ROWS:
        maybe = F.broadcast(maybe)
    met = store.where(F.col("__bucket").isin(buckets)).join(maybe, ["__bucket", "__h"], "left_semi")
    return met.groupBy(*key).agg(F.sum("__copies").alias("__n")).where("__n > 1").select(*key)


def keep_once(messages: DataFrame, key: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """One copy of each message: the first by time bucket, then by ``order``; rows with a null in the key all stay.

    Messages without repeats pass an anti-join; the few repeated ones are reduced to their first row by an aggregation.
    All columns are kept.
    """
    again = repeated_messages(messages, key, bucket)
    cols = messages.columns
    x = messages.withColumn("__b", F.coalesce(bucket.cast("int"), F.lit(-(2**31))))
    single = x.join(again, key, "left_anti").select(*cols)
    several = x.join(again, key, "left_semi").groupBy(*key).agg(F.min(F.struct("__b", *[o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*cols).alias("__row"))).alias("__m"))
    return single.unionByName(several.select("__m.__row.*").select(*cols))
