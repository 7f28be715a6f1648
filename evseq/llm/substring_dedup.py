"""Substring dedup by seed and extend on words.

Seeds are runs of SEED words; a seed is an anchor where its hash is the least of the WINDOW - SEED + 1 seeds of some window (winnowing, the
first of equals). Which seed that is depends on the window's words alone, so two places of one window have the same anchor at the same
distance, and every repeat of WINDOW or more words shares an anchor in each of its windows.

- Seeds: documents are joined on their anchors; those that stand at one place only can be in no repeat and are left.
- Extension: a shared anchor is extended both ways to WINDOW words, by all its placements in a window: r words to the left and the rest to
  the right. The bucket of an anchor joins the extensions of all places of the anchor and tells which agree with another one. Places that
  agree are classes, not pairs, so an anchor that a third of all documents share costs its places times the placements.
- Windows that agree with another, joined where they overlap or touch, are the maximal repeats; their words go.

Documents are dealt into blocks of bounded size. A block sends each name (hash of 64 bits) once for each bucket, however often it has it,
and gets bits back in the same order, so places never travel, and copies of one text inside a block cost as much as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evseq.llm import common

#: Words of a window and of a seed.
WINDOW, SEED = 35, 16
#: Bytes of text in a block; bytes of text for each bucket of names; least number of both.
BLOCK_BYTES, BUCKET_BYTES, LEAST = 8 << 20, 32 << 20, 64
#: Bytes of text hashed together, about.
STRETCH = 1 << 18
NAMES, BITS = "bucket int, block int, pass string, names binary, many binary", "block int, bucket int, pass string, repeated binary"
ROWS = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start int, end int>>"

_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a pair of hashes, order and all."""
    return common.mix(a * _A + (b ^ (b >> np.uint64(32))) * _B)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on: runs of 1, 2, 4 .. words are joined, and at last two that overlap."""
    out, size = words, 1
    while size < n:
        step = min(size, n - size)
        out = _joined(out[: max(0, len(out) - step)], out[step:])
        size += step
    return out


def anchors(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` seeds the place of the least, the first of equals."""
    if len(seeds) < width:
        return np.zeros(0, np.int64)
    best, size = np.arange(len(seeds)), 1
    while size < width:
        step = min(size, width - size)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(seeds[b] < seeds[a], b, a)
        size += step
    return best


class Names:
    """Names of a block for one pass, by bucket, each once, and the way back to where they came from."""

    def __init__(self, names: np.ndarray, buckets: np.ndarray):
        order = np.lexsort((names, buckets))
        h, b = names[order], buckets[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        self.back = np.empty(len(h), np.int64)
        self.back[order] = group
        self.names = h[new]
        self.many = np.bincount(group, minlength=len(self.names)) > 1
        self.buckets, self.cuts = np.unique(b[new], return_index=True)
        self.cuts = np.append(self.cuts, len(self.names))

    def rows(self, block: int, kind: str) -> pa.Table:
        parts = [slice(a, z) for a, z in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        n = len(parts)
        columns = (self.buckets, [block] * n, [kind] * n, [self.names[p].tobytes() for p in parts], [np.packbits(self.many[p]).tobytes() for p in parts])
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("bucket", "block", "pass", "names", "many"), columns, (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)})

    def answers(self, bits: dict[int, bytes]) -> np.ndarray:
        """For each name given, in that order, whether it stands at another place, too."""
        out = np.zeros(len(self.names), bool)
        for b, a, z in zip(self.buckets.tolist(), self.cuts[:-1], self.cuts[1:], strict=True):
            out[a:z] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=z - a)
        return out[self.back]


class Block:
    """The texts of a block as one row of words; windows, each with its anchor, don't cross texts."""

    def __init__(self, texts: list[bytes], n_buckets: int):
        self.n_buckets, self.ends = n_buckets, [0]
        hashes, at, seeds, chosen, n_words, n_seeds = [], [], [], [], 0, 0
        for held in stretches(texts):
            words = common.word_hashes(b" ".join(held), lower=False)
            sizes = [len(t.split()) for t in held]
            text = np.repeat(np.arange(len(held)), sizes)
            whole = np.flatnonzero(text[: max(0, len(words) - WINDOW + 1)] == text[WINDOW - 1 :])
            every = run_hashes(words, SEED)
            places, which = np.unique(anchors(every, WINDOW - SEED + 1)[whole], return_inverse=True)
            hashes.append(run_hashes(words, WINDOW)[whole])
            at.append(whole + n_words)
            seeds.append(every[places])
            chosen.append(which + n_seeds)
            self.ends += (n_words + np.cumsum(sizes)).tolist()
            n_words, n_seeds = n_words + len(words), n_seeds + len(places)
        one = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        #: Of each window the hash, the first word's place and the anchor's number; of each anchor the hash.
        self.windows, self.at, self.chosen, self.seeds = one(hashes, np.uint64), one(at, np.int64), one(chosen, np.int64), one(seeds, np.uint64)

    def _bucket(self, seeds: np.ndarray) -> np.ndarray:
        return (common.mix(seeds + _A) % np.uint64(self.n_buckets)).astype(np.int64)

    def seed_names(self) -> Names:
        return Names(self.seeds, self._bucket(self.seeds))

    def after_seeds(self, bits: dict[int, bytes]) -> None:
        shared = self.seed_names().answers(bits)[self.chosen]
        self.windows, self.at, self.chosen = self.windows[shared], self.at[shared], self.chosen[shared]

    def extension_names(self) -> Names:
        """Extensions of shared anchors, in their anchors' buckets."""
        return Names(self.windows, self._bucket(self.seeds)[self.chosen])

    def after_extensions(self, bits: dict[int, bytes]) -> list[list[tuple[int, int]]]:
        """For each text its maximal repeats, from word to word."""
        again = self.at[self.extension_names().answers(bits)]
        cuts = np.searchsorted(again, self.ends)
        return [joined_windows(again[a:z] - n) for a, z, n in zip(cuts[:-1], cuts[1:], self.ends[:-1], strict=True)]


def stretches(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in runs of about STRETCH bytes, which numpy handles at once."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def joined_windows(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of words that windows at ascending places cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > WINDOW)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + WINDOW).tolist(), strict=True))


def join_bucket(table: pa.Table) -> pa.Table:
    """One bucket: which of its names stand in two blocks, or twice in one."""
    common.occupy(__name__)
    out: dict[str, list] = {c: [] for c in ("block", "bucket", "pass", "repeated")}
    for kind in table["pass"].unique().to_pylist():
        t = table.filter(pa.compute.equal(table["pass"], kind))
        parts = [np.frombuffer(x, np.uint64) for x in t["names"].to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)) for m, p in zip(t["many"].to_pylist(), parts, strict=True)]).astype(bool)
        names = np.concatenate(parts)
        order = np.argsort(names)
        s = names[order]
        same = s[1:] == s[:-1]
        again = many[order]
        again[1:] |= same
        again[:-1] |= same
        back = np.empty(len(s), bool)
        back[order] = again
        at = 0
        for p, block, bucket in zip(parts, t["block"].to_pylist(), t["bucket"].to_pylist(), strict=True):
            for c, x in zip(out, (block, bucket, kind, np.packbits(back[at : at + len(p)]).tobytes()), strict=True):
                out[c].append(x)
            at += len(p)
    return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), (pa.int32(), pa.int32(), pa.string(), pa.binary()), strict=True)})


def run_block(docs: pa.Table, bits: pa.Table | None, upto: str, n_buckets: int) -> Names | list[list[tuple[int, int]]]:
    """A block's names for the pass `upto`, or after both its repeats."""
    common.occupy(__name__)
    known: dict[str, dict[int, bytes]] = {"seed": {}, "extension": {}}
    if bits is not None:
        for kind, bucket, r in zip(*(bits[c].to_pylist() for c in ("pass", "bucket", "repeated")), strict=True):
            known[kind][bucket] = r
    block = Block(common.texts(docs["text"].combine_chunks()) if docs.num_rows else [], n_buckets)
    if upto == "seed":
        return block.seed_names()
    block.after_seeds(known["seed"])
    return block.extension_names() if upto == "extension" else block.after_extensions(known["extension"])


def _dealt(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """The columns but the text as one, `row`, and the text, dealt into blocks by the row's place in its file, so that rows equal in all are
    dealt out, too; and the number of buckets."""
    common.prepare(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64(F.lit("block"), F.monotonically_increasing_id()), F.lit(max(LEAST, -(-total // BLOCK_BYTES)))).cast("int").alias("_block")
    rest = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"], F.lit(None).cast("int").alias("_")).alias("row")
    return docs.select("text", rest, block).repartition("_block"), max(LEAST, -(-total // BUCKET_BYTES))


def _finished(docs: DataFrame, columns: list[str], fn: Callable[[pa.Table, list], pa.Table], schema: str | T.StructType) -> DataFrame:
    d, n = _dealt(docs, columns)

    def seeds(key: tuple, left: pa.Table) -> pa.Table:
        return run_block(left, None, "seed", n).rows(key[0].as_py(), "seed")

    def extensions(key: tuple, left: pa.Table, bits: pa.Table) -> pa.Table:
        return run_block(left, bits, "extension", n).rows(key[0].as_py(), "extension")

    def last(key: tuple, left: pa.Table, bits: pa.Table) -> pa.Table:
        return fn(left, run_block(left, bits, "", n))

    # d whole, each time: one exchange of the documents serves all passes.
    shared = d.groupBy("_block").applyInArrow(seeds, NAMES).groupBy("bucket").applyInArrow(join_bucket, BITS)
    sent = d.groupBy("_block").cogroup(shared.groupBy("block")).applyInArrow(extensions, NAMES)
    bits = shared.unionByName(sent.groupBy("bucket").applyInArrow(join_bucket, BITS))
    return d.groupBy("_block").cogroup(bits.groupBy("block")).applyInArrow(last, schema)


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The words outside the spans joined by one space, how many words there were and how many went."""
    words = text.split()
    keep = np.ones(len(words), bool)
    for a, z in spans:
        keep[a:z] = False
    return b" ".join(compress(words, keep.tolist())), len(words), int(len(words) - keep.sum())


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and repeats (maximal repeats as words from start to before end) for each row.

    A word goes if a run of WINDOW words covers it whose words start at another place of the table, too, the same row included; judged
    on the input. Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null and empty texts, and texts of fewer words than WINDOW, lose nothing.
    Equal rows are copies of each other. Empty table: no rows.
    """

    def digest(left: pa.Table, spans: list) -> pa.Table:
        every = [_kept(t, s) for t, s in zip(common.texts(left["text"].combine_chunks()) if left.num_rows else [], spans, strict=True)]
        kept, n, gone = zip(*every, strict=True) if every else ((), (), ())
        spans_ = pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.table({"doc_id": left["row"].combine_chunks().field("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "repeats": spans_})

    return _finished(docs, ["doc_id", "text"], digest, ROWS)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the kept words, joined by one space, as text where words went; other rows and columns, whatever their names, are as they
    were, and a row of which nothing is left stays with an empty text. Null texts stay null. Empty table: no rows."""

    def rewrite(left: pa.Table, spans: list) -> pa.Table:
        texts = left["text"].to_pylist() if left.num_rows else []
        new = [_kept(t.encode(), s)[0].decode() if s else t for t, s in zip(texts, spans, strict=True)]
        rest = left["row"].combine_chunks()
        return pa.table({c: pa.array(new, pa.string()) if c == "text" else rest.field(c) for c in columns})

    columns = docs.columns
    return _finished(docs, columns, rewrite, docs.schema)
