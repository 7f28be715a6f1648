"""Document fingerprints: MinHash over word shingles under many universal hash permutations, in numpy.

`signatures` gives each text its fingerprint; `similar` joins bands of signatures in Spark and verifies Jaccard on the full
shingle sets; `self_check` compares each text with an edited one and with its neighbour by doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evseq.llm import common, minhash_dedup

SHINGLE = 5
#: Bytes of text in a partition of self_check, about.
PART_BYTES = 64 << 20
#: Permutations h -> a * h + b mod 2 ** 64, of which the upper half counts; a odd.
PERMUTATIONS = 64
_random = np.random.Generator(np.random.PCG64(20240501))
A = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray = A, b: np.ndarray = B) -> np.ndarray:
    """The least 32-bit value under each permutation; all ones for no shingles. Long sets go in pieces of bounded memory."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 4096):
        h = shingles[None, i : i + 4096] * a[:, None]
        h += b[:, None]
        h >>= np.uint64(32)
        np.minimum(out, h.min(axis=1).astype(np.uint32), out=out)
    return out


def fingerprint(text: bytes, size: int = SHINGLE) -> np.ndarray:
    return signature(common.shingle_set(text, size))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float((x == y).mean())


def spelled(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, fingerprint (hex), sig (array of 64 longs). Null or wordless text: no shingles, all ones."""

    def one(batch: pa.RecordBatch) -> dict:
        sets = [common.shingle_set(t, size) for t in common.texts(batch.column(1))]
        sigs = [signature(s) for s in sets]
        return {"doc_id": batch.column(0), "n_shingles": [len(s) for s in sets], "fingerprint": [spelled(s) for s in sigs], "sig": [s.astype(np.int64) for s in sigs]}

    return common.map_rows(docs.select("doc_id", "text"), one, "doc_id long, n_shingles long, fingerprint string, sig array<long>")


def similar(docs: DataFrame, size: int = SHINGLE, threshold: float = 0.8, rows: int = 4) -> DataFrame:
    """doc_id, fingerprint, other_id, representative, jaccard: links between documents of different shingle sets.

    Documents with equal sets are one class, of which the smallest doc_id stands in a link. Classes that share a band of `rows` values
    are held together by their signatures, however many share it, and Jaccard is verified on full sets; the links are a spanning
    forest of the pairs that reach the threshold, so a bucket gives a link for each class and not for each pair. At 0.8, a pair
    shares no band with probability (1 - 0.8 ** 4) ** 16 = 2.2e-4. Texts without words link with nothing.
    """
    spark = common.prepare(docs.sparkSession)

    def one(batch: pa.RecordBatch) -> dict:
        sets = [common.shingle_set(t, size) for t in common.texts(batch.column(1))]
        sigs = [signature(s) for s in sets]
        return {
            "doc_id": batch.column(0), "text_hash": batch.column(2), "n_shingles": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
            "fingerprint": [spelled(s) for s in sigs], "values": [s.astype(np.int64) for s in sigs], "sig": [common.mix(s.astype(np.uint64)).astype(np.uint8).tobytes() for s in sigs],
        }

    f = common.map_rows(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), one, "doc_id long, text_hash long, n_shingles long, digest binary, fingerprint string, values array<long>, sig binary")
    at = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("at")
    classes = f.where("n_shingles > 0").groupBy("digest").agg(at, *[F.first(c).alias(c) for c in ("n_shingles", "fingerprint", "values", "sig")])
    keys = F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // rows - 1)), lambda k: F.xxhash64(k, F.slice("values", k * rows + 1, rows)))
    classes = common.checkpoint(classes.select(F.monotonically_increasing_id().alias("uid"), "at.doc_id", "at.text_hash", "n_shingles", "fingerprint", keys.alias("bands"), "sig"))
    # Six standard deviations of an estimate below the threshold.
    tied, clusters = minhash_dedup.clustered(classes, threshold - 6 * (threshold * (1 - threshold) / PERMUTATIONS) ** 0.5)
    clusters = clusters.select(F.col("component").alias("cluster"), F.col("node").alias("uid"))
    members = common.checkpoint(minhash_dedup.with_texts(clusters.join(classes.select("uid", "doc_id", "text_hash", "n_shingles"), "uid"), docs))
    first, _, rest = minhash_dedup.verified(members, tied, size, 100 * threshold)
    links = first.unionByName(rest.select("a", "b"))

    def jaccard(batch: pa.RecordBatch) -> dict:
        out = []
        for x, y in zip(common.texts(batch.column(4)), common.texts(batch.column(5)), strict=True):
            a, b = common.shingle_set(x, size), common.shingle_set(y, size)
            n = len(np.intersect1d(a, b, assume_unique=True))
            out.append(n / (len(a) + len(b) - n))
        return dict(zip(batch.schema.names[:4], batch.columns[:4], strict=True)) | {"jaccard": out}

    named = members.select("uid", "text").join(classes.select("uid", "doc_id", "fingerprint"), "uid").select("uid", "doc_id", "fingerprint", "text")
    both = links.join(named.toDF("a", "doc_id", "fingerprint", "t1"), "a").join(named.toDF("b", "other_id", "representative", "t2"), "b")
    return common.map_rows(both.select("doc_id", "fingerprint", "other_id", "representative", "t1", "t2"), jaccard, "doc_id long, fingerprint string, other_id long, representative string, jaccard double")


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def row(doc_id: int | None, text: str, mine: np.ndarray, following: str, its: np.ndarray) -> tuple:
    e = edited(text, following)
    raw = e.encode()
    sig = fingerprint(raw)
    return doc_id, len(text), hashlib.sha256(raw).hexdigest(), spelled(mine), spelled(sig), likeness(mine, sig), likeness(mine, its)


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def self_check(docs: DataFrame) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and their likeness; also to the next row's text.

    Rows are range-partitioned and sorted by doc_id once; inside a partition the next row is at hand, and the first and last
    row of each partition meet through a small join on the partitions' numbers. Order: nulls first, then doc_id, then a hash of the text. The
    row after the last is the first; a single row follows itself. Null text: empty. Empty table: no rows.
    """
    spark = common.prepare(docs.sparkSession)
    # A stated number: partitions are not merged, so both readers see the same; and enough for partitions of bounded size.
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Ties by a hash: the range exchange samples its keys to the driver, so texts can't be among them.
    d = d.withColumn("_h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    schema, ends_ddl = common.arrow_schema(spark, ROW), "part int, is_head boolean, doc_id long, text string"
    ends_schema = common.arrow_schema(spark, ends_ddl)

    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sig = fingerprint(text.encode())
                if held:
                    out.append(row(*held, text, sig))
                held = (doc_id, text, sig)
            if out:
                yield _emit(out, schema)

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, head, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if batch.num_rows:
                head = head or (part, True, batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
                last = (part, False, batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py())
        if head:
            yield _emit([head, last], ends_schema)

    # Dealt anew, so that partitions are numbered in a stage of their own: inside a union the numbers go on from the other side.
    e = d.mapInArrow(ends, ends_ddl).repartition(n, "part")
    # Partitions' numbers only: the next partition that has rows, the first after the last.
    order = Window.orderBy("part")
    to = e.where("is_head").select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next_part"))
    heads = e.where("is_head").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    seams = e.where("not is_head").select("part", "doc_id", "text").join(to, "part").join(heads, "next_part").select("doc_id", "text", "next_text")

    def seam(batch: pa.RecordBatch) -> dict:
        rows = [row(i, t, fingerprint(t.encode()), n, fingerprint(n.encode())) for i, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        return dict(zip(schema.names, zip(*rows, strict=True), strict=True))

    return d.mapInArrow(inner, ROW).unionByName(common.map_rows(seams, seam, ROW))
