"""A feed of inserts, updates and deletes to the present table, by column-wise last writer wins.

One aggregation by key does it all: for each column max_by over the changes that set it, and the latest delete or
replacement as the line behind which nothing counts. Partial aggregation combines a hot key before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of operations after trimming and lower case (fixed values of the feed's protocol).
OPERATIONS = {"insert": "replace", "create": "replace", "c": "replace", "r": "replace", "read": "replace", "update": "replace", "u": "replace", "delete": "delete", "d": "delete"}


def operation(c: Column, spellings: dict[str, str] | None = None) -> Column:
    """replace, patch or delete; null where the operation can't be read."""
    s = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    by: dict[str, list[str]] = {}
    for k, v in (spellings or OPERATIONS).items():
        by.setdefault(v, []).append(k)
    for v, ks in by.items():
        out = F.when(s.isin(ks), v).otherwise(out)
    return out


def current_state(changes: DataFrame, key: dict[str, Column], seq: str, op: Column, columns: dict[str, Column], sets: dict[str, Column] | None = None, base: DataFrame | None = None) -> DataFrame:
    """One row per key alive after the last change: key, ``columns``, and __seq, the sequence of its last write.

    op gives replace (writes the whole row), patch (writes the columns whose entry in ``sets`` is true, by default those
    not null) or delete; a null op, seq or key part changes nothing. Arrival order doesn't matter; equal seq means one
    change (repeats are harmless; if rows under one seq differ, for a column the greatest value and delete before write
    count, whatever the order of arrival). A patch without a row creates it. base: the table so far with the key and
    columns, older than every change. Columns of the input beyond those named are ignored. An empty feed gives base.
    """
    sets = sets or {}
    names = list(columns)
    ev = changes.select(
        *[c.alias(f"__k{i}") for i, c in enumerate(key.values())], F.col(seq).cast("long").alias("__seq"), op.alias("__op"),
        *[c.alias(f"__c{i}") for i, c in enumerate(columns.values())],
        *[((op == "replace") | ((op == "patch") & sets.get(n, columns[n].isNotNull()))).alias(f"__s{i}") for i, n in enumerate(names)],
    )
    keys = [f"__k{i}" for i in range(len(key))]
    for k in [*keys, "__seq", "__op"]:
        ev = ev.where(F.col(k).isNotNull())
    if base is not None:
        old = base.select(
            *[F.col(n).alias(k) for n, k in zip(key, keys, strict=True)], F.lit(-(2**63)).cast("long").alias("__seq"), F.lit("replace").alias("__op"),
            *[F.col(n).cast(ev.schema[f"__c{i}"].dataType).alias(f"__c{i}") for i, n in enumerate(names)], *[F.lit(True).alias(f"__s{i}") for i in range(len(names))],
        )
        ev = ev.unionByName(old)
    seq_if = lambda cond: F.max(F.when(cond, F.col("__seq")))
    # max over (seq, is there a value, value) and not max_by: ties have one answer
    g = ev.groupBy(*keys).agg(
        seq_if(F.col("__op") == "delete").alias("__gone"), seq_if(F.col("__op") != "delete").alias("__last"), seq_if(F.col("__op").isin("delete", "replace")).alias("__line"),
        *[F.max(F.when(F.col(f"__s{i}"), F.struct(F.col("__seq").alias("s"), F.col(f"__c{i}").alias("v")))).alias(f"__v{i}") for i in range(len(names))],
    )
    alive = g.where(F.col("__last").isNotNull() & (F.col("__gone").isNull() | (F.col("__last") > F.col("__gone"))))
    line = F.coalesce("__line", F.lit(-(2**63)))
    value = lambda i: F.when(F.col(f"__v{i}.s") >= line, F.col(f"__v{i}.v"))
    return alive.select(*[F.col(k).alias(n) for n, k in zip(key, keys, strict=True)], *[value(i).alias(n) for i, n in enumerate(names)], F.col("__last").alias("__seq"))
