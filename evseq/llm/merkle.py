"""Merkle manifest of a dataset by superblock reduction.

The rows of a group (a source) are leaves in the order of a key. FANOUT consecutive nodes become their digest, level by level, until one
is left, the group's subroot; the subroots, in the order of their groups, are reduced alike to the root. Leaves are dealt into buckets
by index div FANOUT ** LEVELS: a task takes one bucket through LEVELS levels, and what the buckets leave is dealt and reduced in the
same way, so each round has FANOUT ** LEVELS times fewer nodes and no task sees more than that many, however large a group is. On the
way down each bucket gets the proof of its own root once, makes the lower proofs of its nodes and appends the upper one to them;
lower proofs never travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evseq.llm import common

#: Nodes that become one; levels that one task takes a bucket through: 729 nodes.
FANOUT, LEVELS = 3, 6
#: Columns of a leaf, in their order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left string, right string>>"


def leaf(*values: Column) -> Column:
    """Lowercase hex sha256 of the values one after the other: `-` for null, else the UTF-8 byte count, `:` and the value."""
    each = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*each), 256)


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to: at each level the digest of what stands left, the node and what stands right."""
    return F.aggregate(proof, node, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level from below, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def depth(n: int, fanout: int = FANOUT) -> int:
    """Levels until one of n nodes is left."""
    out, holds = 0, 1
    while holds < n:
        out, holds = out + 1, holds * fanout
    return out


def risen(nodes: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def _collapsed(fanout: int, levels: int) -> Callable:
    """A bucket's root, with the bucket's number as its index."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        nodes = table.sort_by("idx")["node"].to_pylist()
        for _ in range(min(levels, depth(n, fanout))):
            nodes = risen(nodes, fanout)
        return pa.table({"grp": pa.array([key[0].as_py()]), "idx": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // fanout**levels)], pa.int64()), "node": pa.array(nodes)})

    return run


def _descended(fanout: int, levels: int, columns: list[str]) -> Callable:
    """A bucket's nodes, each with its siblings up to the bucket's root and those of that root."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("idx")
        level, lower = left["node"].to_pylist(), [[] for _ in range(left.num_rows)]
        at = range(left.num_rows)
        for _ in range(min(levels, depth(left["n"][0].as_py(), fanout)) if left.num_rows else 0):
            steps = [("".join(level[i - i % fanout : i]), "".join(level[i + 1 : i - i % fanout + fanout])) for i in range(len(level))]
            for k, i in enumerate(at):
                lower[k].append(steps[i])
            level, at = risen(level, fanout), [i // fanout for i in at]
        upper = [(s["left"], s["right"]) for s in right["proof"][0].as_py()] if left.num_rows else []
        flat = [s for steps in lower for s in (*steps, *upper)]
        ends = [0]
        for steps in lower:
            ends.append(ends[-1] + len(steps) + len(upper))
        pairs = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.string()) for k in (0, 1)], ["left", "right"])
        made = {"proof": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)} | {c: pa.array([right[c][0].as_py()] * left.num_rows, pa.string()) for c in ("subroot", "root") if c in columns and left.num_rows}
        return pa.table({c: made[c] if c in made else left[c] if c in left.column_names else pa.array([], pa.string()) for c in columns})

    return run


def _indexed(nodes: DataFrame, *order: str) -> DataFrame:
    """grp, node, row -> with idx, the place from 0 in its group in the order given, and n, the group's size; written.

    Rows are sorted by ranges and written with their places in the partition; a group's rows in the partitions before come from counts
    by partition and group. A group of any size is spread over as many partitions as it fills.
    """
    sorted_, path = common.written(nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id()))
    sorted_ = sorted_.withColumn("part", F.shiftright("at", 33))
    per = sorted_.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("grp")
    per = per.select(F.col("part").alias("_part"), F.col("grp").alias("_grp"), "first", (F.sum("m").over(w.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(w).alias("n"))
    placed = sorted_.join(per, (F.col("part") == F.col("_part")) & (F.col("grp") == F.col("_grp")))
    out, _ = common.written(placed.select("grp", (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "n", "node", "row"))
    common.forget(nodes.sparkSession, path)
    return out


def _rounds(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes, the roots of their buckets, the roots of those, until each group has one."""
    out = [nodes]
    bucket = F.floor(F.col("idx") / F.lit(fanout**levels)).cast("long").alias("bucket")
    while (nodes.agg(F.max("n")).first()[0] or 1) > 1:
        d = nodes.select("grp", bucket, "idx", "n", "node")
        nodes, _ = common.written(d.groupBy("grp", "bucket").applyInArrow(_collapsed(fanout, levels), "grp string, idx long, n long, node string"))
        out.append(nodes)
    return out


def _down(rounds: list[DataFrame], upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """upper: grp, idx, proof, root and perhaps subroot of the last round's nodes. The same columns, node and row for those of the first."""
    tops = [c for c in ("subroot", "root") if c in upper.columns]
    for r in reversed(range(len(rounds) - 1)):
        nodes = rounds[r]
        kept = [f for f in nodes.schema if f.name != "n"]
        schema = T.StructType([*kept, T.StructField("proof", T._parse_datatype_string(PROOF)), *[T.StructField(c, T.StringType()) for c in tops]])
        left = nodes.withColumn("bucket", F.floor(F.col("idx") / F.lit(fanout**levels)).cast("long"))
        right = upper.select("grp", F.col("idx").alias("bucket"), "proof", *tops)
        upper = left.groupBy("grp", "bucket").cogroup(right.groupBy("grp", "bucket")).applyInArrow(_descended(fanout, levels, [f.name for f in schema]), schema)
    return upper


def manifest(leaves: DataFrame, key: str = "doc_id", group: str = "source", node: str = "leaf", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaves with subroot, root and proof, an array of the siblings' digests left and right of the path, for each level from below.

    Leaves of a group ascend by key, nulls first, ties by leaf; groups ascend by UTF-8 bytes, null first. A run of one node becomes its
    digest, too; a lone leaf is its subroot, a lone subroot the root. Equal rows are leaves of their own. Empty table: no rows. Columns
    of leaves named subroot, root or proof are replaced.
    """
    common.prepare(leaves.sparkSession)
    mine = [c for c in leaves.columns if c.lower() not in ("subroot", "root", "proof")]
    grp = F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0"))
    # Texts are hashed once, before the ranges are drawn.
    d, path = common.written(leaves.select(grp.alias("grp"), F.col(key).alias("key"), F.col(node).alias("node"), F.struct(*[F.col(f"`{c}`") for c in mine]).alias("row")))
    rounds = _rounds(_indexed(d, "key", "node"), fanout, levels)
    common.forget(leaves.sparkSession, path)
    subroots = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("key"), "node", F.struct("grp", F.col("node").alias("subroot")).alias("row"))
    tops = _rounds(_indexed(subroots, "key"), fanout, levels)
    none = F.array().cast(PROOF)
    root = tops[-1].withColumns({"proof": none, "root": F.col("node")})
    upper = _down(tops, root, fanout, levels).select("row.grp", F.lit(0).cast("long").alias("idx"), "proof", "row.subroot", "root")
    if len(rounds) == 1:  # each group is one leaf
        out = rounds[0].join(upper.drop("idx"), "grp")
    else:
        out = _down(rounds, upper, fanout, levels)
    return out.select("row.*", "subroot", "root", "proof")


def sealed(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """doc_id, source, leaf, tampered_leaf, subroot, root and proof of each row. tampered_leaf: the leaf without the text's line feeds
    where the crc32 of the decimal doc_id is even, else null; null doc_ids are not tampered with, null texts stay null."""
    at = dict(zip(columns, (F.col(f"`{c}`") for c in columns), strict=True))
    changed = at | {"text": F.replace(at["text"], F.lit("\n"), F.lit(""))}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf(*changed.values()))
    return manifest(docs.select("doc_id", "source", leaf(*at.values()).alias("leaf"), tampered.alias("tampered_leaf")))


def verified(sealed_rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row's root recomputed from its tampered leaf, or where
    there is none from its leaf, and the siblings of its proof."""
    d = sealed_rows.withColumns({"proof_sha256": F.sha2(siblings(F.col("proof")), 256), "folded_root": folded(F.coalesce("tampered_leaf", "leaf"), F.col("proof"))})
    return d.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
