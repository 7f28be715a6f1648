"""Readers and writers. Everything large stays in DataFrames; only vocabularies and metrics, which are small, become JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evseq import schema
from evseq.functions import codes
from evseq.operators.ranks import row_index


def lower_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def keep_available(df: DataFrame, wanted: list[str], key: str) -> DataFrame:
    """The wanted columns that exist; an error if that is the key alone."""
    have = [c for c in wanted if c in df.columns]
    if key not in have or len(have) == 1:
        raise ValueError(f"need {key} and one of {', '.join(w for w in wanted if w != key)}")
    return df.select(*have)


def read_table(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """Parquet or CSV by suffix, gzip too. gzip can't be split, so such a table is dealt out after it is read."""
    if path.rstrip("/").endswith((".csv", ".csv.gz", ".tsv")):
        r = spark.read.option("header", True).option("sep", "\t" if ".tsv" in path else ",").option("mode", "PERMISSIVE")
        df = lower_headers(r.csv(path))
        df = df.select(*[c for c in df.columns if c and not c.startswith(("unnamed", "_c"))])
        df = df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df
    else:
        df = spark.read.parquet(path)
    return schema.conform(df, ddl) if ddl else df


def read_events(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """All parquet shards under a folder, with the event schema; rows without subject, time or code are dropped."""
    df = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.parquet").parquet(folder)
    return schema.conform(df, schema.EVENT).dropna(subset=["subject_id", "time", "code"])


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path)
    paths = F.col("jpg_path") if "jpg_path" in df.columns else F.lit(None).cast("string")
    there = codes.truthy(F.col("jpg_path_exists").cast("string"), extra=("t",)) if "jpg_path_exists" in df.columns else paths.isNotNull()
    ids = {c: F.col(c).try_cast("long") for c in ("subject_id", "hadm_id", "study_id") if c in df.columns}
    time = next(c for c in df.columns if c.lower() == "studydatetime")
    return df.withColumns(ids | {"StudyDateTime": F.col(time).try_cast("timestamp_ntz"), "jpg_path": paths, "jpg_path_exists": there})


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each file; the count comes from parquet footers."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))


def read_vocab_files(spark: SparkSession, folder: str) -> DataFrame:
    """rank, token of every *vocab.json in order of file names, each token once, where it comes first."""
    files = spark.read.option("pathGlobFilter", "*vocab.json").text(folder, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    tokens = files.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "token"))
    first = tokens.groupBy("token").agg(F.min(F.struct("file", "pos")).alias("at"))
    return row_index(first.select("at.file", "at.pos", "token"), ["file", "pos"], "rank").select("rank", "token")


def read_code_labels(spark: SparkSession, folder: str) -> DataFrame:
    """code, label of every *.json; of a code in several files, the last by name."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    pairs = files.select("file", F.explode(F.from_json("value", "map<string,string>")).alias("code", "label"))
    return pairs.groupBy("code").agg(F.max_by("label", "file").alias("label"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if path.endswith((".csv", ".csv.gz")):
        w.option("header", True).option("compression", "gzip" if path.endswith(".gz") else "none").csv(path)
    else:
        w.parquet(path)


def stage(spark: SparkSession, path: str, make, needs: tuple[str, ...] = (), refresh: bool = False) -> DataFrame:
    """The table at path if it was finished and has the needed columns; else made, written and read back."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    done = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
    if not refresh and done and set(needs) <= set(spark.read.parquet(path).columns):
        return spark.read.parquet(path)
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def replace_table(spark: SparkSession, path: str, change) -> None:
    """Overwrites a table by a function of itself: Spark can't read and overwrite one path, so the new table is written beside it.
    Once it is whole the old one is moved aside, the new one takes its place, and the old one goes; whatever is lost in between,
    one whole table is left at path, .old or .new, and if it was .old alone the next call puts it back."""
    beside, aside = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside, aside))
    fs = at.getFileSystem(conf)

    def move(a, b) -> None:
        if not fs.rename(a, b):
            raise OSError(f"{a} could not be moved to {b}")

    if fs.exists(old) and not fs.exists(at):
        move(old, at)
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(beside)
    fs.delete(old, True)
    move(at, old)
    move(new, at)
    fs.delete(old, True)


def read_splits(spark: SparkSession, path: str, split: str | None = None, scheme: str | None = None, key: str | None = None) -> DataFrame:
    """split, scheme, key, subject_id of a table of splits, each row once; of the given split, scheme and key alone if named. A table
    without schemes has null ones."""
    d = schema.conform(read_table(spark, path), schema.SPLIT).dropna(subset=["split", "subject_id"]).distinct()
    for c, v in (("split", split), ("scheme", scheme), ("key", key)):
        d = d if v is None else d.where(F.col(c) == v)
    return d


def append_new(df: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the manifest at path has not; gives the rows that were new."""
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    new = df if done is None else df.join(done, key, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def packed(df: DataFrame, order: list[str], shard_size: int = 1024) -> DataFrame:
    """pack and index_in_pack of each row, in the given order."""
    n = row_index(df, order, "_row")
    return n.withColumns({"pack": F.floor(F.col("_row") / shard_size), "index_in_pack": F.col("_row") % shard_size}).drop("_row")


def summary(df: DataFrame, **counts) -> DataFrame:
    """One row with a counter for each condition."""
    return df.agg(*[F.count_if(c).alias(k) for k, c in counts.items()])


#: Rows that a JSON file may have.
JSON_ROWS = 5_000_000


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, in any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json_list(df: DataFrame, path: str) -> None:
    """A sorted list of the only column, for vocabularies: their size is checked."""
    rows = df.distinct().limit(JSON_ROWS + 1).collect()
    if len(rows) > JSON_ROWS:
        raise ValueError("too many tokens for a JSON list")
    write_text(df.sparkSession, json.dumps(sorted(r[0] for r in rows), indent=4), path)


def write_json_row(df: DataFrame, path: str) -> None:
    """The first row as an object, for metrics."""
    write_text(df.sparkSession, json.dumps(df.first().asDict(True), indent=4, default=str), path)
