"""MinHash near-dedup by min-max hashing.

Each permutation gives two values of a document's shingle set, its minimum and its maximum; both agree between two sets with
probability equal to their Jaccard similarity, so half the permutations fill a signature. Bands of the signature bring candidates
together:

1. documents with equal sets are one class, whatever their number;
2. in each band bucket every class is tied to the bucket's smallest; ties whose signatures are far apart are dropped. Classes of a
   bucket that are left apart are compared by their signatures, in blocks of bounded size that return a spanning forest of what
   agrees. What holds together is a cluster of candidates;
3. inside each cluster pairs are verified on full sets, in blocks of bounded size that share the work, leaving out pairs that
   verified ties have joined; a block pair returns a spanning forest of its links, not the links;
4. connected components of those are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evseq.llm import common

#: Permutations, values in a band. Two values each: 40 bands of 5. A pair of similarity 0.8 misses every band with probability
#: (1 - 0.8 ** 5) ** 40 = 1.3e-7.
PERMUTATIONS, BAND = 100, 5
#: Similarity, in hundredths.
LEAST = 80
#: Estimated similarity under which a tie is dropped: over six standard deviations below LEAST.
TIE = 0.5
#: Classes and shingles in a block of a cluster; a cluster of up to two blocks is one task's work.
BLOCK, BLOCK_SHINGLES = 128, 300_000
#: Signatures in a block of a bucket.
BUCKET = 512
_random = np.random.Generator(np.random.PCG64(7))
A = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def min_max(shingles: np.ndarray) -> np.ndarray:
    """32-bit minima of all permutations, then maxima."""
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 1024):
        h = shingles[None, i : i + 1024] * A[:, None]
        h += B[:, None]
        h >>= np.uint64(32)
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    h = np.arange(len(values) // BAND, dtype=np.uint64) * np.uint64(common.BASE)
    for column in values.reshape(-1, BAND).T:
        h = common.mix(h + column)
    return h.view(np.int64)


def features(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the shingle set (null if empty), bands, sig (a byte of each value)."""

    def one(batch: pa.RecordBatch) -> dict:
        digests, bands, sigs, n = [], [], [], []
        for t in common.texts(batch.column(1)):
            s = common.shingle_set(t, size)
            n.append(len(s))
            if len(s):
                v = min_max(s)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(v))
                sigs.append(common.mix(v).astype(np.uint8).tobytes())
            else:
                digests.append(None)
                bands.append([])
                sigs.append(b"")
        return {"doc_id": batch.column(0), "text_hash": batch.column(2), "n_shingles": n, "digest": digests, "bands": bands, "sig": sigs}

    return common.map_rows(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), one, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sig binary")


def likenesses(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of each signature in x to each in y."""
    if x.size * len(y) <= 1 << 18:
        same = (x[:, None, :] == y[None, :, :]).sum(axis=2)
    else:
        same = np.zeros((len(x), len(y)), np.uint16)
        for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
            same += a[:, None] == b[None, :]
    return (same / x.shape[1] - 1 / 256) / (1 - 1 / 256)


def agreeing(part: np.ndarray, sigs: np.ndarray, block: np.ndarray, tie: float) -> list[tuple[int, int, float]]:
    """Ties that join whatever agrees in tie or more and isn't of one part already; of two blocks, only pairs of both."""
    label = np.unique(part, return_inverse=True)[1]
    rows = np.flatnonzero(block == block.min())
    columns = rows if len(rows) == len(block) else np.flatnonzero(block != block.min())
    estimate = likenesses(sigs[rows], sigs[columns])
    good = estimate >= tie
    out = []
    for k, i in enumerate(rows):
        near = np.flatnonzero(good[k] & (label[columns] != label[i]))
        if len(near):
            others, first = np.unique(label[columns[near]], return_index=True)
            out += [(int(i), int(columns[j]), float(estimate[k, j])) for j in near[first]]
            label[np.isin(label, others)] = label[i]
    return out


def ties(classes: DataFrame, tie: float = TIE) -> DataFrame:
    """a, b, estimate: ties of signatures that agree in tie or more; they hold together all that share a bucket and agree so."""
    return clustered(classes, tie)[0]


def clustered(classes: DataFrame, tie: float = TIE) -> tuple[DataFrame, DataFrame]:
    """Ties, and node, component: the clusters that they make.

    Each class is first tied to the smallest of a bucket it is in. What these ties leave apart in a bucket is compared by
    signatures, all but the bucket's largest part with all.
    """
    bands = classes.select("uid", F.explode("bands").alias("key"))
    heads = bands.groupBy("key").agg(F.min("uid").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared, path = common.written(bands.join(heads, "key").where("uid <> head"))
    pairs = shared.select(F.col("uid").alias("a"), F.col("head").alias("b")).distinct()
    sig = classes.select("uid", "sig")
    pairs = pairs.join(sig.toDF("a", "x"), "a").join(sig.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def agreement(batch: pa.RecordBatch) -> dict:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in batch.columns[2:])
        same = (x == y).mean(axis=1)
        return {"a": batch.column(0), "b": batch.column(1), "estimate": (same - 1 / 256) / (1 - 1 / 256)}

    stars, _ = common.written(common.map_rows(pairs, agreement, "a long, b long, estimate double").where(F.col("estimate") >= tie))
    parts = common.components(stars)
    apart, _ = common.written(left_apart(shared.where("n > 2").select("key", "uid"), parts, sig, tie))
    common.forget(classes.sparkSession, path)
    return stars.unionByName(apart.select("a", "b", "estimate")), common.components(apart, "part_a", "part_b", parts)


def left_apart(shared: DataFrame, parts: DataFrame, sig: DataFrame, tie: float) -> DataFrame:
    """a, b, estimate, part_a, part_b: ties inside buckets whose members are in several parts. shared: key, uid, without the buckets' heads,
    which are compared with all. A unit of work is a block of a bucket, or two; it returns a spanning forest."""
    m = shared.join(parts.withColumnRenamed("node", "uid"), "uid", "left").withColumn("part", F.coalesce("component", "uid")).drop("component")
    sizes = m.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("n")).where("n > main.n")
    blocks = lambda n: F.ceil(n / BUCKET).cast("int")
    main = main.select("key", F.col("main.part").alias("main"), blocks(F.col("n") - F.col("main.n")).alias("rest_blocks"), blocks(F.col("main.n")).alias("main_blocks"))
    work = _dealt(m.join(main, "key"), "key").join(sig, "uid").select("unit", "lo", "hi", "uid", "block", "part", "sig")

    def done(held: list[pa.RecordBatch]) -> list[tuple[int, int, float, int, int]]:
        t = pa.Table.from_batches(held)
        uid, block, part = (t[c].to_numpy() for c in ("uid", "block", "part"))
        if (across := t["lo"][0].as_py() != t["hi"][0].as_py()) and block.min() == block.max():
            return []  # a block that has no rows
        sigs = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(uid), -1)
        return [(int(uid[i]), int(uid[j]), e, int(part[i]), int(part[j])) for i, j, e in agreeing(part, sigs, block if across else np.zeros_like(block), tie)]

    schema = "a long, b long, estimate double, part_a long, part_b long"
    arrow = common.arrow_schema(sig.sparkSession, schema)

    # Sorted rows, many small units to a batch: most buckets have few members.
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.occupy(__name__)
        held, at = [], None
        for batch in chain(batches, [None]):
            out = []
            if batch is None:
                out = done(held) if held else []
            elif batch.num_rows:
                unit = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
                cuts = [0, *(np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
                for i, j in pairwise(cuts):
                    if held and at != unit[:, i].tolist():
                        out += done(held)
                        held = []
                    at = unit[:, i].tolist()
                    held.append(batch.slice(i, j - i))
            if out:
                yield common.as_batch(dict(zip(arrow.names, zip(*out, strict=True), strict=True)), arrow)

    return work.repartition("unit", "lo", "hi").sortWithinPartitions("unit", "lo", "hi").mapInArrow(run, schema)


def linked(sets: list[np.ndarray], side: np.ndarray, across: bool, least: float = LEAST) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with similarity least (hundredths) or more; across: only pairs of both sides."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]])
    else:
        words, of = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        order = np.argsort(words, kind="stable")
        words, of = words[order], of[order]
        new = np.r_[True, words[1:] != words[:-1]]
        column = np.cumsum(new) - 1
        shared = np.bincount(column) > 1
        keep = shared[column]
        column = (np.cumsum(shared) - 1)[column[keep]]
        of = of[keep]
        both = np.zeros((n, n))
        cuts = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 if len(column) else 0, 16_384))
        for i, j in zip(cuts, [*cuts[1:], len(column)], strict=True):
            m = np.zeros((n, min(16_384, int(column[j - 1] - column[i]) + 1)), np.float32)
            m[of[i:j], column[i:j] - column[i]] = 1
            both += m @ m.T
    both = both.astype(np.int64)
    good = np.triu(100 * both >= least * (sizes[:, None] + sizes[None, :] - both), 1)
    if across:
        good &= side[:, None] != side[None, :]
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in np.argwhere(good):
        a, b = find(int(i)), find(int(j))
        if a != b:
            parent[b] = a
            out.append((int(i), int(j)))
    return out


def _blocks(n, shingles):
    """How many blocks a set of classes takes."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _block_of(uid: str, blocks):
    return F.pmod(F.xxhash64(uid), blocks).cast("int")


def _dealt(rows: DataFrame, unit: str) -> DataFrame:
    """rows (uid, part, main, rest_blocks, main_blocks) once for each block they are compared with, as unit, lo, hi, block: all but
    the unit's main part with all, the main part not with itself."""
    rest = F.col("part") != F.col("main")
    block = F.when(rest, _block_of("uid", F.col("rest_blocks"))).otherwise(F.col("rest_blocks") + _block_of("uid", F.col("main_blocks")))
    others = F.when(rest, F.col("rest_blocks") + F.col("main_blocks")).otherwise(F.col("rest_blocks"))
    work = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return work.withColumn("unit", F.col(unit)).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))


def compared(work: DataFrame, members: DataFrame, size: int, least: float = LEAST) -> DataFrame:
    """a, b, part_a, part_b: links that span those found by each unit of work. work: unit, lo, hi, uid, block, part; if lo and hi differ,
    only classes of different blocks are compared. Texts join by uid, so they are gathered by units of bounded size and by nothing larger."""

    def one(table: pa.Table) -> pa.Table:
        common.occupy(__name__)
        uid, block = table["uid"].to_numpy(), table["block"].to_numpy()
        uid, first = np.unique(uid, return_index=True)  # rows repeated whole
        text, part = table["text"].take(pa.array(first)).combine_chunks(), table["part"].to_numpy()[first]
        across = table["lo"][0].as_py() != table["hi"][0].as_py()
        pairs = linked([common.shingle_set(x, size) for x in common.texts(text)], block[first], across, least) if len(uid) > 1 else []
        return pa.table({f"{name}{side}": pa.array([int(ids[pair[k]]) for pair in pairs], pa.int64()) for name, ids in (("", uid), ("part_", part)) for k, side in enumerate("ab")})

    work = work.select("unit", "lo", "hi", "uid", "block", "part").join(members.select("uid", "text"), "uid")
    return work.select("unit", "lo", "hi", "uid", "block", "part", "text").groupBy("unit", "lo", "hi").applyInArrow(one, "a long, b long, part_a long, part_b long")


def verified(members: DataFrame, tied: DataFrame, size: int, least: float = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links that span what is linked in each cluster: those found first (a, b), node and component of what these join, and the rest
    (a, b, part_a, part_b), which connect such components. members: cluster, uid, n_shingles, text.

    A small cluster is one unit. In a large one each class is compared first with the class it is likeliest tied to; what that
    joins to the cluster's largest part needs no comparison inside the part, so only the rest is compared with all. A group of
    copies close to one of them costs its size, not its square. Work is dealt out by ids alone.
    """
    ids = members.select("cluster", "uid", "n_shingles")
    per = ids.groupBy("cluster").agg(F.count(F.lit(1)).alias("g"), F.sum("n_shingles").alias("s"))
    m = ids.join(per, "cluster").withColumn("large", (F.col("g") > 2 * BLOCK) | (F.col("s") > 2 * BLOCK_SHINGLES)).drop("g", "s")
    zero = F.lit(0)
    small = m.where("not large").select(F.col("cluster").alias("unit"), zero.alias("lo"), zero.alias("hi"), "uid", zero.alias("block"))
    large = m.where("large")

    best = tied.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("head")).withColumnRenamed("a", "uid")
    followers = large.join(best, "uid")
    of_head = followers.groupBy("head").agg(_blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("blocks"))
    followers = followers.join(of_head, "head").select(F.col("head").alias("unit"), _block_of("uid", F.col("blocks")).alias("lo"), F.lit(-1).alias("hi"), "uid", F.lit(1).alias("block"))
    heads = large.join(of_head.withColumnRenamed("head", "uid"), "uid").withColumn("lo", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    heads = heads.select(F.col("uid").alias("unit"), "lo", F.lit(-1).alias("hi"), "uid", zero.alias("block"))
    first, _ = common.written(compared(small.unionByName(followers).unionByName(heads).withColumn("part", F.col("uid")), members, size, least).select("a", "b"))

    joined = common.components(first)
    parts = large.join(joined.withColumnRenamed("node", "uid"), "uid", "left").withColumn("part", F.coalesce("component", "uid")).drop("component")
    sizes = parts.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "part", "s")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > main.n")
    main = main.select("cluster", F.col("main.part").alias("main"), _blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("rest_blocks"), _blocks(F.col("main.n"), F.col("main.s")).alias("main_blocks"))
    return first, joined, compared(_dealt(parts.join(main, "cluster"), "cluster"), members, size, least)


def with_texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    t = docs.select(F.col("doc_id").alias("_d"), "text", F.xxhash64("text").alias("_h"))
    return members.join(t, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h"))).select("cluster", "uid", "n_shingles", "text").dropDuplicates(["uid"])


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Null, empty or wordless text: an empty set, linked with nothing, its component_id its doc_id. Equal rows are in one
    component and agree. Null doc_ids count as documents but never name a component unless all of it are null. No rows: none.
    """
    f, named = components_of(docs, size)
    out = f.select("doc_id", "n_shingles", "digest").join(named.select("digest", "component_id"), "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def components_of(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """features, and for each digest its component's id and the row that stands for the component: the smallest, null doc_ids last."""
    common.prepare(docs.sparkSession)
    with common.scope():  # what texts and signatures were written for goes before the result is read
        f, _ = common.written(features(docs, size))
        classes = f.where("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        classes, _ = common.written(classes.select(F.monotonically_increasing_id().alias("uid"), "digest", "at.doc_id", "at.text_hash", "n_shingles", "bands", "sig"))
        f, _ = common.written(f.select("doc_id", "text_hash", "n_shingles", "digest"), outer=True)
        tied, clusters = clustered(classes)
        members = clusters.select(F.col("component").alias("cluster"), F.col("node").alias("uid")).join(classes.select("uid", "doc_id", "text_hash", "n_shingles"), "uid")
        _, joined, rest = verified(common.written(with_texts(members, docs))[0], tied, size)
        groups = common.components(rest, "part_a", "part_b", joined)
        at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
        named = classes.select("uid", "digest", "doc_id", "text_hash").join(groups.withColumnRenamed("node", "uid"), "uid")
        names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(at).alias("stands"))
        grouped = named.select("digest", "component").join(names, "component").select("digest", "component_id", "stands")
        alone = classes.join(groups, classes.uid == groups.node, "left_anti").select("digest", F.col("doc_id").alias("component_id"), at.alias("stands"))
        return f, common.written(grouped.unionByName(alone), outer=True)[0]


def one_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs without the rows that don't stand for their component, and without repeats of whole documents; columns as they are.

    A row is known by doc_id and text, so texts that share a doc_id stay or go each by itself, and of near copies without doc_id
    one stays. Texts without words all stay.
    """
    f, named = components_of(docs, size)
    gone = f.join(named, "digest").where(~(F.col("doc_id").eqNullSafe(F.col("stands.doc_id")) & (F.col("text_hash") == F.col("stands.text_hash"))))
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    left = docs.join(gone, (F.xxhash64("text") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti")
    return left.select(*[f"`{c}`" for c in docs.columns]).dropDuplicates(["doc_id", "text"])
