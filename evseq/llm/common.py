"""What several operators share: session settings, checkpoints, word and shingle hashing, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes in an Arrow batch, whichever is less: long texts must not fill a worker's memory. One row is always taken.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Bytes of text that numpy code handles at once.
CHUNK_BYTES = 1 << 20

LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_MUL1 = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xBF58476D1CE4E5B9)
_MUL3 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches (settings of the session, which stay, as results are computed later), and the checkpoint folder that the cluster names. In local mode, as in tests, where none is named, a
    temporary one; elsewhere that is an error, as executors don't see each other's folders."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="evseq-checkpoint-"))
    return spark


#: For each scope that is open, the paths made in it. The outermost ends with the process.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """What operators write to the checkpoint folder inside is deleted at the end, so a result must be written or collected before. Without
    a scope it stays until the process ends, as lazy results read it."""
    _scopes.append([])
    try:
        yield
    finally:
        _free(_scopes.pop())


def _free(paths: list[tuple[SparkSession, str]]) -> None:
    for spark, path in paths:
        forget(spark, path)


@atexit.register
def _free_all() -> None:
    for paths in _scopes:
        _free([x for x in paths if x[0].sparkContext._jsc is not None])


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder; deleted with the scope, whether or not Spark is told to clean checkpoints up."""
    spark = prepare(df.sparkSession)
    out = df.checkpoint()
    path = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if path.isDefined():
        _scopes[-1].append((spark, path.get()))
    return out


def written(df: DataFrame, outer: bool = False) -> tuple[DataFrame, str]:
    """df as a table in the checkpoint folder, and its path; deleted with the scope, or with the one around it. Where a loop goes round,
    this and not checkpoint(): Spark hands its estimates of sizes on through checkpoints, and products of joins would grow without end."""
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    _scopes[-2 if outer else -1].append((spark, path))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


#: With it the files of a query's shuffles go when the query ends; without, when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table of the checkpoint folder before its scope ends."""
    for s in _scopes:
        s[:] = [x for x in s if x[1] != path]
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Tables that operators keep in a worker between tasks, and the operator whose they are.
CACHES: list[dict] = []
_owner = ""


def occupy(owner: str) -> None:
    """Called as a worker starts on an operator: what another operator has left there is let go."""
    global _owner
    if _owner != owner:
        _owner = owner
        for c in CACHES:
            c.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can, it gives the memory back
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow, one dictionary of columns for each batch."""
    prepare(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occupy(fn.__module__)
        for batch in batches:
            if batch.num_rows:
                yield as_batch(fn(batch), arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for f in schema for c in [columns[f.name]]], schema=schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64 over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MUL2
    h ^= h >> np.uint64(27)
    h *= _MUL3
    h ^= h >> np.uint64(31)
    return h


BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)

#: A prime modulus, so that no texts can be made for which sums of powers agree as they do modulo 2 ** 64; and a base.
PRIME, BASE61 = (1 << 61) - 1, 0x1A6F3B5C9D27E841 % ((1 << 61) - 1)
_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
#: Bytes summed at once: few enough for sums of products with 31 bits to fit 64, and for a cache.
_STRETCH = 1 << 14


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = ah * bl + al * bh
    return _reduced(((ah * bh) << np.uint64(1)) + (mid >> _30) + ((mid & _LOW30) << _31) + al * bl)


def _powers(base: int, n: int, modulus: int) -> np.ndarray:
    """base ** i modulo PRIME or 2 ** 64, for i up to n or more."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), modulus))
        out = np.concatenate([out, times(out, step) if modulus == PRIME else out * step])
    return out[:n].copy()


#: Powers, which another operator has no use for.
_tables: dict[str, np.ndarray] = {}
CACHES.append(_tables)


def _power_tables(n: int) -> dict[str, np.ndarray]:
    if n > len(_tables.get("up61", ())):
        n = -(-n // (1 << 16)) << 16
        _tables.update(up61=_powers(BASE61, n, PRIME), down61=_powers(pow(BASE61, -1, PRIME), n, PRIME), up64=_powers(BASE, n, 1 << 64), down64=_powers(INVERSE, n, 1 << 64))
    return _tables


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL1)


class Rolling:
    """Hashes of substrings of some bytes, by prefix sums modulo PRIME and modulo 2 ** 64; they don't depend on the place."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        t = _power_tables(n + 1)
        self.p, self.q = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * t["up64"][:n], out=self.q[1:])
        at = np.uint64(0)
        for i in range(0, n, _STRETCH):
            c, up = data[i : i + _STRETCH].astype(np.uint64) + np.uint64(1), t["up61"][i : min(n, i + _STRETCH)]
            high = _reduced(np.cumsum(c * (up >> _31)))
            x = (((high << _31) & _P) | (high >> _30)) + _reduced(np.cumsum(c * (up & _LOW31))) + at
            self.p[i + 1 : i + 1 + len(c)] = _reduced(x)
            at = self.p[i + len(c)]

    def names(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of bytes start to end for each pair: two numbers of 64 bits, made of both sums."""
        a = times(_reduced(self.p[end] + (_P - self.p[start])), _tables["down61"][start])
        b = (self.q[end] - self.q[start]) * _tables["down64"][start]
        return mix(a * _MUL1 ^ b), mix(b * _MUL3 + a)


#: Bytes that end a word of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes above which a word is hashed by itself.
LONG_WORD = 512
#: What of eight bytes a word of so many more bytes has, least significant first.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """A hash for each word `[^\\x20\\x09-\\x0D]+` of the text, A-Z lower-cased if asked for: eight bytes at a time are mixed in, for all words that
    have so many. No sum of powers, as texts can be made for which such sums agree."""
    text = text.translate(LOWER_ASCII) if lower else text
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    size = end - start
    padded = np.frombuffer(text + bytes(8), np.uint8)
    eight = np.ndarray((len(data),), "<u8", padded, 0, (1,))  # at each place the eight bytes that follow
    out = mix(size.astype(np.uint64) * _MUL1)
    todo, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(todo):
        out[todo] = mix((out[todo] ^ (eight[start[todo] + at] & _HEAD[np.minimum(size[todo] - at, 8)])) * _MUL1 + _MUL2)
        at += 8
        todo = todo[size[todo] > at]
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(text[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; the whole sequence if there are fewer; none without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(size, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ words[k : len(words) - n + 1 + k]) * np.uint64(BASE)
        h ^= h >> np.uint64(32)
    return np.unique(mix(h + np.uint64(n)))


#: Edges that a task joins at once.
FOREST = 1 << 20


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that edges reach but the smallest of its component, and that smallest one."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _forest(edges: DataFrame) -> DataFrame:
    """u, v: of FOREST edges of a task at a time, each node with the smallest that they reach. They connect what the edges connect."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            if n and (batch is None or n >= FOREST):
                u, v = roots(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2)))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                held, n = [], 0

    prepare(edges.sparkSession)
    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b", held: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that edges reach, as a table that is written. Nodes without edges are absent. held: components
    found before, whose names the edges connect; its nodes are then in the result, too.

    A task joins its edges before they travel, so a node sends few of its smaller neighbours, and again once all of these have met. A
    round then leads each edge to its smaller end's smallest neighbour: joined, so that a hub's edges are never gathered in one row. It
    ends when every node has one smaller neighbour, which has none."""
    spark, seen = edges.sparkSession, Observation()
    e, path = written(_forest(_forest(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")).repartition("u")).observe(seen, F.count(F.lit(1)).alias("n")))
    if not seen.get["n"]:
        return spark.createDataFrame([], "node long, component long") if held is None else held
    for _ in range(rounds):
        ends = F.array(F.struct(F.col("u").alias("node"), "v", F.lit(False).alias("end")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("end")))
        nodes, seen = e.select(F.explode(ends).alias("_")).select("_.*").groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("end").alias("end")), Observation()
        nodes, low_path = written(nodes.observe(seen, F.count(F.when(F.col("low").isNotNull() & (F.col("end") | (F.col("low") != F.col("high"))), 1)).alias("open")))
        if not seen.get["open"]:
            forget(spark, path)
            break
        # By negated nodes both sides are dealt out anew for this join, and Spark can split a hub's edges among tasks.
        low = nodes.where("low is not null").select(F.col("node").alias("_w"), "low")
        up = e.join(low, F.negative("v") == F.negative("_w"), "left").select("u", F.coalesce("low", "v").alias("v"))
        before = path
        e, path = written(_forest(_forest(up).repartition("u")))
        forget(spark, before)
        forget(spark, low_path)
    else:
        raise RuntimeError("components did not settle")
    found = nodes.select("node", F.coalesce("low", "node").alias("component"))
    if held is None:
        return found
    more = found.toDF("_n", "_c")
    both = held.join(more, F.negative("component") == F.negative("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    return written(both.unionByName(found.join(held.select("node"), "node", "left_anti")))[0]
