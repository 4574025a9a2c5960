"""Many small files into few of good size, planned in SQL from a frozen manifest.

1. ``manifest``: one row per (partition, file): rows and bytes, in order of partition and file, frozen by writing it.
2. ``redundant_files``: files whose records all lie in one other file (left behind by consolidations that broke off).
3. ``plan``: the small files are taken in order, their bytes summed by windows, and groups assigned by target-sized
   intervals of the running sum. A file is merged if its group has another one.
4. ``rewrite``: the rows of merged files, each distinct record once, in one output file per group; ``reconcile`` compares
   the counts of what is read back with those before.

Two rows are one record if the record columns agree; a null in the first record column agrees with nothing. Nulls in
other columns agree with each other. Partition keys may be null (they form a partition of their own); rows without
a file name are no part of any file and are left alone. Columns of the input beyond those named are kept by ``rewrite``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeloom.operators import lake
from tradeloom.session import scratch, written

TARGET_BYTES = 128 << 20


def row_bytes(df: DataFrame, leave: list[str] = ()) -> Column:
    """Bytes of a row's values as stored plainly: the length of texts, the width of fixed types, nothing for a null."""
    width = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    size = lambda n, t: F.octet_length(n) if t in ("string", "binary") else F.when(F.col(n).isNotNull(), F.lit(width.get(t, 8)))
    parts = [F.coalesce(size(f"`{n}`", t), F.lit(0)) for n, t in df.dtypes if n not in leave]
    return sum(parts[1:], parts[0]).cast("long") if parts else F.lit(0).cast("long")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of a directory as its file system tells them: the sizes of a lake that is still in its files."""
    return spark.createDataFrame(lake.file_sizes(spark, path), "file string, bytes long")


def _prepared(df: DataFrame, partition: dict[str, Column], file: str, record: list[str]) -> DataFrame:
    """__pid and __fid, hashes of the partition and the file in it, and the record as two more, together 128 bits."""
    part = list(partition.values())
    missing = [p.isNull().cast("int") for p in part]  # else a null would hash like nothing at all
    return df.where(F.col(file).isNotNull() & F.col(record[0]).isNotNull()).select(
        F.xxhash64(*part, *missing).alias("__pid"), F.xxhash64(F.col(file), *part).alias("__fid"), F.xxhash64(*record, *[F.col(c).isNull() for c in record[1:]]).alias("__h1"), F.xxhash64(F.lit("second"), *record).alias("__h2")
    )


def _keys(partition: dict[str, Column]) -> list[str]:
    return [f"__p{i}" for i in range(len(partition))]


def manifest(df: DataFrame, partition: dict[str, Column], file: str, record: list[str], size: Column, sizes: DataFrame | None = None) -> DataFrame:
    """The frozen manifest: one row per file with its partition, rows, bytes and rows without a record key.

    Bytes are those of ``sizes`` (file, bytes; see ``file_sizes``) where it knows the file, else the sum of ``size`` over
    its rows. It is written to the shared folder in order of partition and file, so that all planning sees the same
    files; __range numbers the stretches it was written in, among which a partition with very many files is split.
    """
    keys, part = _keys(partition), list(partition.values())
    x = df.where(F.col(file).isNotNull()).select(*[c.alias(k) for k, c in zip(keys, part, strict=True)], F.col(file).alias("__file"), F.col(record[0]).isNull().cast("long").alias("__none"), size.alias("__size"))
    g = x.groupBy(*keys, "__file").agg(F.count(F.lit(1)).alias("rows"), F.sum("__none").alias("unkeyed"), F.sum("__size").alias("bytes"))
    if sizes is not None:
        g = g.join(sizes.select(F.col("file").alias("__file"), F.col("bytes").alias("__told")), "__file", "left").withColumn("bytes", F.coalesce("__told", "bytes")).drop("__told")
    named = [F.col(k) for k in keys]
    pid = F.xxhash64(*named, *[k.isNull().cast("int") for k in named])
    g = g.select("*", pid.alias("__pid"), F.xxhash64(F.col("__file"), *named).alias("__fid")).repartitionByRange(*[F.col(k) for k in keys], F.col("__file"))
    return written(g.withColumn("__range", F.spark_partition_id()), "manifest")


def redundant_files(df: DataFrame, partition: dict[str, Column], file: str, record: list[str], man: DataFrame) -> DataFrame:
    """(__pid, __fid) of files whose records all lie in one other file of the partition; of files with equal records the
    first by name stays.

    A record that one file alone holds makes that file irreplaceable; what is left are records of several files, the only
    ones whose members are looked up. Equal files are found by fingerprint, and only the first of each set goes on. Where one
    larger file is the largest holder of all records of a file, that is settled by one aggregation (files nested in each other
    end here). Of what remains, a file can lie only in files that hold its rarest record: those are its candidates, and
    each is verified by counting shared records.
    """
    rec, at = ["__pid", "__h1", "__h2"], ["__pid", "__fid"]
    rows = _prepared(df, partition, file, record)
    # min and max combine before the shuffle, so a record that is everywhere is no hot task
    held = rows.groupBy(*rec).agg(F.min("__fid").alias("__a"), F.max("__fid").alias("__b"))
    held = written(held.select(*rec, F.col("__a"), (F.col("__a") != F.col("__b")).alias("__many")), "records")
    alone = held.where("not __many").select("__pid", F.col("__a").alias("__fid")).distinct()
    members = written(rows.join(held.where("__many").select(*rec), rec, "left_semi").groupBy(*rec, "__fid").agg(F.lit(1).alias("__x")).drop("__x"), "members")
    fp = "decimal(38,0)"
    files = members.groupBy(*at).agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("__h1").cast(fp)).alias("fp1"), F.sum(F.col("__h2").cast(fp)).alias("fp2"))
    whole = files.join(man.where("unkeyed = 0").select(*at, "__file"), at).join(alone, at, "left_anti")
    sets = whole.groupBy("__pid", "records", "fp1", "fp2").agg(F.min(F.struct("__file", "__fid")).alias("__m"))
    whole = written(whole.join(sets, ["__pid", "records", "fp1", "fp2"]).select(*at, "records", F.col("__m.__fid").alias("__first")), "replaceable")
    twins = whole.where("__fid <> __first").select(*at)
    lead = whole.where("__fid = __first").select(*at, "records")
    # a file that is not replaceable holds more than any that lies in it; of the others it must be a larger one
    sized = members.join(whole.select(*at, F.col("records").alias("__size")), at, "left").select(*rec, F.col("__fid").alias("__in"), "__size")
    often = written(sized.groupBy(*rec).agg(F.count(F.lit(1)).alias("__held"), F.max(F.struct(F.coalesce("__size", F.lit(2**62)).alias("s"), F.col("__in").alias("f"))).alias("__top")), "holders")
    own = members.join(lead, at).join(often, rec)
    # per file the rarest record, and whether all its records have one and the same largest holder
    own = own.groupBy(*at, "records").agg(F.min(F.struct("__held", "__h1", "__h2")).alias("__r"), F.min("__top").alias("__lo"), F.max("__top").alias("__hi"))
    own = written(own.withColumn("__sure", (F.col("__lo.f") == F.col("__hi.f")) & (F.col("__lo.f") != F.col("__fid")) & (F.col("__lo.s") > F.col("records"))), "rarest")
    rarest = own.where("not __sure").select(*at, "records", F.col("__r.__h1").alias("__h1"), F.col("__r.__h2").alias("__h2"))
    cand = rarest.join(sized, rec).where("__fid <> __in and (__size is null or __size > records)").select(*at, "records", "__in")
    want = cand.join(members, at).select(*rec, "__fid", "records", "__in")
    met = want.join(members.select(*rec, F.col("__fid").alias("__in")), [*rec, "__in"], "left_semi")
    inside = met.groupBy(*at, "__in", "records").agg(F.count(F.lit(1)).alias("__met")).where("__met = records")
    return twins.union(own.where("__sure").select(*at)).union(inside.select(*at)).distinct()


def plan(df: DataFrame, partition: dict[str, Column], file: str, record: list[str], small_rows: int = 40, target_bytes: int = TARGET_BYTES, size: Column | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """One row per file: partition keys (named as in ``partition``), file, rows, bytes, action, out_file.

    action: drop (redundant), merge (small, with another small one in its group), keep. The small files of a partition are
    taken in pairs by name (three at the end if their number is odd); a pair belongs to the target-sized interval of the
    running sum of bytes in which it begins, so a group has at least two files wherever the partition has, and none
    exceeds the target by more than a pair. Redundant files stand in the order but add no bytes. Sums and ranks are made in
    two steps, per stretch of the manifest and then within one, so that a partition with very many files is not one task.
    """
    keys = _keys(partition)
    man = manifest(df, partition, file, record, row_bytes(df, [file]) if size is None else size, sizes)
    gone = redundant_files(df, partition, file, record, man)
    x = man.join(gone.withColumn("__gone", F.lit(True)), ["__pid", "__fid"], "left").withColumn("__gone", F.coalesce("__gone", F.lit(False)))
    x = x.withColumn("__small", F.col("rows") < small_rows)
    small = x.where("__small").withColumn("__b", F.when(F.col("__gone"), 0).otherwise(F.col("bytes")))
    part = small.groupBy("__pid", "__range").agg(F.count(F.lit(1)).alias("__k"), F.sum("__b").alias("__s"))
    w = Window.partitionBy("__pid")
    before = w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("__pid", "__range", F.sum("__k").over(w).alias("__all"), F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__k0"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"))
    inner = Window.partitionBy("__pid", "__range").orderBy("__file", "__fid")
    start = F.col("__s0") + F.coalesce(F.sum("__b").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("__k0") + F.row_number().over(inner) - 1
    small = small.join(part, ["__pid", "__range"]).select("__pid", "__fid", "__gone", "__all", start.alias("__start"), rank.alias("__rank"))
    pair = F.least(F.floor(F.col("__rank") / 2), F.greatest(F.floor(F.col("__all") / 2), F.lit(1)) - 1)
    small = small.withColumn("__pair", pair).withColumn("__start", F.min("__start").over(Window.partitionBy("__pid", "__pair")))
    small = small.withColumn("__group", F.floor(F.col("__start") / F.lit(target_bytes)))
    groups = small.groupBy("__pid", "__group").agg(F.count(F.lit(1)).alias("__members"))
    small = small.join(groups, ["__pid", "__group"]).select("__pid", "__fid", "__group", "__members")
    x = x.join(small, ["__pid", "__fid"], "left")
    merged = ~F.col("__gone") & (F.coalesce("__members", F.lit(0)) >= 2)
    action = F.when(F.col("__gone"), "drop").when(merged, "merge").otherwise("keep")
    named = [F.col(k).alias(n) for k, n in zip(keys, partition, strict=True)]
    out = F.when(merged, F.format_string("consolidated-%012d", "__group")).when(~F.col("__gone"), F.col("__file"))
    return x.select(*named, F.col("__file").alias("file"), "rows", "bytes", action.alias("action"), out.alias("out_file"))


def consolidated(df: DataFrame, planned: DataFrame, partition: dict[str, Column], file: str, record: list[str]) -> DataFrame:
    """The rows after consolidation with a column out_file: rows of dropped files are gone (their records live on in
    another file), and a record of a partition stands once. Rows whose first record column is null are all kept.
    Among copies of a record the one in the least (out_file, row) stays, so the result is the same each time.
    """
    names = list(partition)
    clash = {n: f"__k{i}" for i, n in enumerate(names)}
    x = df.select("*", *[c.alias(clash[n]) for n, c in partition.items()])
    p = planned.where("action <> 'drop'").select(*[F.col(n).alias(f"__q{i}") for i, n in enumerate(names)], F.col("file").alias("__pf"), "out_file")
    on = F.col(file) == F.col("__pf")
    for i, n in enumerate(names):
        on = on & F.col(clash[n]).eqNullSafe(F.col(f"__q{i}"))
    x = x.join(p, on).drop("__pf", *[f"__q{i}" for i in range(len(names))])
    keyed = x.where(F.col(record[0]).isNotNull())
    rest = [c for c in x.columns if c not in record and c not in clash.values()]
    one = keyed.groupBy(*clash.values(), *record).agg(F.min(F.struct("out_file", *[c for c in rest if c != "out_file"])).alias("__row"))
    one = one.select(*clash.values(), *record, *[F.col(f"__row.{c}").alias(c) for c in rest])
    return one.unionByName(x.where(F.col(record[0]).isNull()).select(*one.columns)).drop(*clash.values())


def rewrite(df: DataFrame, planned: DataFrame, partition: dict[str, Column], file: str, record: list[str], path: str) -> None:
    """Write the consolidated rows under ``path``: the rows of an output file come together in one task, so a file per group is written."""
    x = consolidated(df, planned, partition, file, record).withColumns(partition)
    x.repartition(*[F.col(n) for n in partition], F.col("out_file")).write.mode("errorifexists").partitionBy(*partition, "out_file").parquet(path)


def rewritten(df: DataFrame, planned: DataFrame, partition: dict[str, Column], file: str, record: list[str], path: str | None = None) -> DataFrame:
    """What ``rewrite`` wrote, read back with the partition columns and out_file; without a path it is a scratch folder."""
    spark = df.sparkSession
    path = path or scratch(spark, "consolidated")
    kinds = dict(consolidated(df, planned, partition, file, record).withColumns(partition).dtypes)
    rewrite(df, planned, partition, file, record, path)
    rest = [c for c in kinds if c not in partition and c != "out_file"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*rest, *partition, "out_file"])
    return spark.read.schema(schema).parquet(path)


def reconcile(before: DataFrame, after: DataFrame, partition: dict[str, Column], record: list[str], after_partition: dict[str, Column] | None = None) -> DataFrame:
    """Per partition: distinct records and unkeyed rows before and after, and rows after; ok says that none is lost or doubled.

    after_partition: the partition of rows that were read back, where it differs. One aggregation over both sides.
    """
    side = lambda df, part, tag: df.select(*[c.alias(n) for n, c in part.items()], F.when(F.col(record[0]).isNotNull(), F.struct(*record)).alias("__rec"), F.lit(tag).alias("__after"))
    x = side(before, partition, 0).unionByName(side(after, after_partition or partition, 1))
    x = x.groupBy(*partition, "__rec").agg(F.sum(1 - F.col("__after")).alias("__n0"), F.sum("__after").alias("__n1"))
    keyed, tags = F.col("__rec").isNotNull(), ("before", "after")
    x = x.groupBy(*partition).agg(*[
        a for i, t in enumerate(tags) for a in (F.count_if(keyed & (F.col(f"__n{i}") > 0)).alias(f"records_{t}"), F.sum(F.when(~keyed, F.col(f"__n{i}")).otherwise(0)).alias(f"unkeyed_{t}"), F.sum(f"__n{i}").alias(f"rows_{t}"))
    ])
    ok = (F.col("records_before") == F.col("records_after")) & (F.col("unkeyed_before") == F.col("unkeyed_after")) & (F.col("rows_after") == F.col("records_after") + F.col("unkeyed_after"))
    return x.withColumn("ok", ok)
