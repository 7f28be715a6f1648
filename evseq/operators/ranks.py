"""How rows are dealt out, and global ranks and running totals without a window over all rows: rows are numbered inside ordered buckets, and each bucket is
shifted by what stands in those before it. Only bucket totals meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of an md5 that name a bucket: 4096 buckets.
DIGITS = 3
#: Ranges of a column's values for running totals: this many, each cut into as many again.
RANGES = 32


#: Bytes of files, compressed, whose rows one task should get.
PART_BYTES = 4 << 20


def parts(*dfs: DataFrame) -> int:
    """Into how many parts rows read from files are dealt, so that a part stays as large as it is while the files grow: one for each
    PART_BYTES of the files that these DataFrames read; 0, for as Spark deals by itself, if that would not be more parts than there are cores."""
    spark = dfs[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = {f for d in dfs for f in d.inputFiles()}
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    n = -(-sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths) // PART_BYTES)
    return n if n > spark.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """df with equal keys in one of n parts, which Spark neither merges nor deals anew for a join, window or group by these keys; n 0: as it is."""
    return df.repartition(n, *keys) if n else df


def shuffled(df: DataFrame, key: str, seed: str, within: tuple[str, ...] = (), name: str = "_rank", total: str = "_total") -> DataFrame:
    """Adds the row's place, from 0, in the order of md5(seed:key), and the number of rows, both within the given columns. Any engine
    with md5 gives the same order. Rows with null keys come first; ties of equal keys are numbered anyhow. Empty table: no rows."""
    md5 = F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.lit(""))
    d = df.withColumn("_md5", md5).withColumn("_bucket", F.substring("_md5", 1, DIGITS))
    per = d.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*within)
    per = per.withColumns({"_before": F.sum("_n").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"), total: F.sum("_n").over(w)}).drop("_n")
    keys = [*within, "_bucket"]
    right = per.select(*[F.col(k).alias(f"_r{k}") for k in keys], "_before", total)
    on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    # At most 4096 rows for each combination of `within`; Spark broadcasts them if they are few.
    n = d.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy("_md5", key)) - 1)
    return n.join(right, on).withColumn(name, F.col("_in") + F.col("_before")).drop("_md5", "_bucket", "_in", "_before", *[f"_r{k}" for k in keys])


def row_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the row's place, from 0, in the given order; ties of whole keys are numbered anyhow. Nulls first. Empty table: no rows.

    Rows are range-partitioned and sorted; a row's place in its partition is at hand, and a small join adds the rows of the
    partitions before. The number of partitions is stated, so that they aren't merged. Ranges come from a sample, so both sides must
    read one and the same exchange: the counting side reads all columns, and the place asks of every row that its hash over all columns is
    none that the counting side has not met, so that no column of either side can be left out, whichever columns are wanted in the end.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts(df))
    d = df.repartitionByRange(n, *order)
    every = F.xxhash64(*[F.map_entries(f"`{f.name}`") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields])
    per = d.withColumn("_part", F.spark_partition_id()).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.max(every).alias("_most"))
    before = per.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), "_most")
    d = d.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # The partition's number above 33 bits, the place in it below.
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    place = F.when(every <= F.col("_most"), at + F.col("_before")).otherwise(F.raise_error(F.lit("ranges differ between two readings")).cast("long"))
    return d.join(F.broadcast(before), part == F.col("_part")).withColumn(name, place).drop("_id", "_part", "_before", "_most")  # a row for each partition


def ranges(df: DataFrame, column: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds `_bucket`: which of RANGES ** 2 ranges, of about equal counts, a numeric column's value is in, within the given columns.
    The cuts come from one aggregate with a bounded sketch; nulls and equal values share a bucket."""
    k = RANGES * RANGES
    cuts = df.groupBy(*within).agg(F.percentile_approx(F.col(column).cast("double"), F.array(*[F.lit(i / k) for i in range(1, k)]), F.lit(10 * k)).alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.transform(F.sequence(F.lit(RANGES), F.lit(k - RANGES), F.lit(RANGES)), lambda i: F.get("_cuts", i - 1)))
    right = cuts.select(*[F.col(c).alias(f"_r{c}") for c in within], "_cuts", "_coarse")
    d = df.join(right, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in within]) if within else df.crossJoin(F.broadcast(right))  # one row
    below = lambda a: F.size(F.filter(a, lambda c: c < F.col(column)))
    d = d.withColumn("_bucket", below(F.col("_coarse")) * RANGES)
    d = d.withColumn("_bucket", F.when(F.col(column).isNull(), -1).otherwise(F.col("_bucket") + below(F.slice("_cuts", F.col("_bucket") + 1, F.lit(RANGES)))))
    return d.drop("_cuts", "_coarse", *[f"_r{c}" for c in within])


def running(df: DataFrame, bucket: Column, order: list, sums: dict[str, str], exclusive: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds running totals of columns, in the order of buckets and, inside, of `order`."""
    d = df.withColumn("_bucket", bucket)
    keys = [*within, "_bucket"]
    per = d.groupBy(*keys).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    right = per.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_i_{n}": F.sum(c).over(w) - (F.col(c) if exclusive else F.lit(0)) for n, c in sums.items()})
    d = d.join(right, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys])
    d = d.withColumns({n: F.col(f"_i_{n}") + F.col(f"_b_{n}") for n in sums})
    return d.drop("_bucket", *[f"_r{k}" for k in keys], *[f"_i_{n}" for n in sums], *[f"_b_{n}" for n in sums])
