"""Tables with versions: a log of commits beside the data, so that replacing and appending are whole or not at all in any store.

Data files are written under names of their own and never changed. A version is one small file, `_log/<number>.json`, that lists the folders
it consists of; it is made by creating that file only if it isn't there, which is the one step that decides. So a writer that is killed
leaves the last version as it was; of two writers that start from one version one wins and the other sees it, starts anew from what the
winner left, or gives up. Readers take the highest version, or any earlier one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evseq import schema

#: Times that a writer starts anew when others were first.
TRIES = 10


class Conflict(Exception):
    """Another writer made the version first."""


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions there are, ascending; none if there is no table."""
    files, at = _store(spark, path)
    log = at(f"{path}/_log")
    names = [x.getPath().getName() for x in files.listStatus(log)] if files.exists(log) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def entry(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version consists of (the last if none is named): version, folders, schema. Version 0 is no table."""
    have = versions(spark, path)
    n = (have[-1] if have else 0) if version is None else version
    if n == 0:
        return {"version": 0, "folders": [], "schema": None}
    if n not in have:
        raise ValueError(f"{path} has no version {n}")
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/_log/{n:09d}.json").collect()))  # a small file


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table of a version, of the last if none is named. A column that later parts alone have is null in the others."""
    e = entry(spark, path, version)
    if not e["version"]:
        raise ValueError(f"{path} is no table with versions")
    return _of(spark, path, e)


def _of(spark: SparkSession, path: str, e: dict) -> DataFrame:
    if not e["folders"]:
        return spark.createDataFrame([], e["schema"])
    return spark.read.schema(e["schema"]).parquet(*[f"{path}/{f}" for f in e["folders"]])


def commit(spark: SparkSession, path: str, version: int, folders: list[str], ddl: str) -> None:
    """Makes the version, or raises Conflict if it is there. The file is whole before it has its name, and a store that can't rename without
    replacing refuses to create it."""
    files, at = _store(spark, path)
    text = json.dumps({"version": version, "folders": folders, "schema": ddl})
    to, beside = at(f"{path}/_log/{version:09d}.json"), at(f"{path}/_log/.{uuid.uuid4().hex}")
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        # The default rename fails where the name is taken; it never replaces.
        context.rename(beside, to, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        files.delete(beside, False)
        if "AlreadyExists" in str(e) or files.exists(to):
            raise Conflict(f"version {version} of {path} is there already") from e
        raise


def _written(df: DataFrame, path: str) -> str:
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return folder


def replace(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame]) -> int:
    """The table becomes a function of itself (of None if there is none yet); its version. If another writer is first, the function is
    applied to what that one left."""
    for _ in range(TRIES):
        e = entry(spark, path)
        new = change(_of(spark, path, e) if e["version"] else None)
        folder = _written(new, path)
        try:
            commit(spark, path, e["version"] + 1, [folder], _ddl(new))
            return e["version"] + 1
        except Conflict:
            _forget(spark, f"{path}/{folder}")
    raise Conflict(f"{path}: others were first {TRIES} times")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the table has not, of equal keys one; the version after it, which stays where nothing is new. Rows with
    a null key are left out. A job that is taken up again appends what is missing, and two that append at once don't double a key, as
    the second compares with what the first has left."""
    spark = df.sparkSession
    d = df.where(F.col(key).isNotNull()).dropDuplicates([key])
    for _ in range(TRIES):
        e = entry(spark, path)
        new = d.join(_of(spark, path, e).select(key), key, "left_anti") if e["version"] else d
        new = new.select(*df.columns)
        folder = _written(new, path)
        if e["version"] and spark.read.schema(_ddl(new)).parquet(f"{path}/{folder}").isEmpty():
            _forget(spark, f"{path}/{folder}")
            return e["version"]
        try:
            had = schema.fields(e["schema"]) if e["schema"] else {}
            ddl = ", ".join(f"`{c}` {t}" for c, t in (had | {f.name: f.dataType.simpleString() for f in new.schema if f.name not in had}).items())
            commit(spark, path, e["version"] + 1, [*e["folders"], folder], ddl)
            return e["version"] + 1
        except Conflict:
            _forget(spark, f"{path}/{folder}")
    raise Conflict(f"{path}: others were first {TRIES} times")


def clean(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Forgets all but the last `keep` versions, and the data that no version names; how many folders went. Not while others write."""
    files, at = _store(spark, path)
    have = versions(spark, path)
    used = {f for n in have[-keep:] for f in entry(spark, path, n)["folders"]}
    for n in have[:-keep]:
        files.delete(at(f"{path}/_log/{n:09d}.json"), False)
    data = at(f"{path}/data")
    gone = [x.getPath() for x in files.listStatus(data) if f"data/{x.getPath().getName()}" not in used] if files.exists(data) else []
    for p in gone:
        files.delete(p, True)
    return len(gone)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _forget(spark: SparkSession, path: str) -> None:
    files, at = _store(spark, path)
    files.delete(at(path), True)
