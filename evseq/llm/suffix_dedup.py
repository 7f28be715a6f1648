"""Suffix-array dedup: blockwise construction with a difference cover.

What is asked of the suffix array is which suffixes agree with another one in their first LENGTH bytes. Sorting every suffix
would move many times the input, so the order is built the way blockwise algorithms do it: ranks of a sample first, and buckets
of suffixes, one at a time, that settle long ties by those ranks.

- The sample is a difference cover: places p with p mod V in D, where every difference mod V occurs between two members of D.
  So for any two suffixes i and j there is a shift d < V that brings both to sample places; if they agree in LENGTH bytes, the
  sample suffixes i + d and j + d agree in LENGTH - V + 1.
- Rank 1 of a sample suffix is its class by its first LENGTH - V + 1 bytes. A suffix with no shift to a sample suffix of a class
  with two members is unique, and is left out from here on.
- Rank 2 is its class by the LENGTH bytes after it and the V - 1 before it. If the class has two members, all suffixes up to V - 1
  before them tie in LENGTH bytes: long ties are settled without sorting these suffixes. One member of the class stands for
  all of them.
- The suffixes left, near the ends of repeats, and those of the standing members are dealt into buckets and each bucket is sorted.

Copies of whole texts are found first, and one of them stands for all. Documents are dealt into blocks of bounded size, equal rows
too; a block names its suffixes by hashes (64 bits, and the bucket's number from further bits, out of sums modulo a prime and modulo
2 ** 64), the buckets answer in bits in the order of the names, so places never travel. Every exchange holds each name once for a
block, however often it occurs. The order within a bucket is that of names: all that is asked of it is who stands beside an equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evseq.llm import common

LENGTH = 200
#: Bytes of text in a block of documents, about; bytes of text for each bucket of names; least number of both.
BLOCK_BYTES, BUCKET_BYTES, LEAST_BLOCKS = 8 << 20, 32 << 20, 128
#: Bytes of text hashed together, about.
STRETCH = 1 << 18
#: Bytes of a name that travel, by pass: whole texts, rank 1 (a filter: equal names only keep suffixes in), rank 2, suffixes.
WIDTH = {"text": 8, "rank1": 6, "rank2": 8, "suffix": 8}
PASSES = tuple(WIDTH)
NAMES, BITS = "bucket int, block int, pass string, names binary, many binary", "block int, bucket int, pass string, repeated binary, lead binary"
ROWS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def difference_set(q: int) -> tuple[int, np.ndarray]:
    """v = q * q + q + 1 and q + 1 residues among which every difference mod v but 0 occurs once (Singer's sets, q prime):
    powers of a generator x of the field of q ** 3 elements that lie in a plane."""
    v = q * q + q + 1
    for c in range(1, q):
        for b in range(q):
            for a in range(q):  # x ** 3 = a x ** 2 + b x + c
                power, out = (1, 0, 0), []
                for k in range(v):
                    if power[2] == 0:
                        out.append(k)
                    low, mid, high = power
                    power = (high * c % q, (low + high * b) % q, (mid + high * a) % q)
                if len(out) == q + 1 and len({(x - y) % v for x in out for y in out}) == v:
                    return v, np.array(out)
    raise ValueError(f"{q} is not prime")


V, D = difference_set(11)
SHORT = LENGTH - V + 1


def sample_places(n: int, length: int) -> np.ndarray:
    """Places of the cover from which `length` bytes follow in a text of n bytes."""
    p = (np.arange(0, max(0, n), V)[:, None] + D[None, :]).ravel()
    return p[p <= n - length]


def before(n: int, places: np.ndarray) -> np.ndarray:
    """Marks the suffixes of LENGTH or more bytes that are at most V - 1 before a place."""
    step = np.zeros(n - LENGTH + 2, np.int32)
    np.add.at(step, np.maximum(places - V + 1, 0), 1)
    stop = places + 1
    np.add.at(step, stop[stop < len(step)], -1)
    return np.cumsum(step)[:-1] > 0


class Names:
    """Names of a block for one pass, sorted by bucket and each once, and the way back to where they came from."""

    def __init__(self, names: list[np.ndarray], buckets: list[np.ndarray], n_buckets: int):
        h = np.concatenate(names) if names else np.zeros(0, np.uint64)
        b = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
        order = np.argsort(h)
        # numpy sorts 16-bit numbers stably by radix.
        order = order[np.argsort(b[order].astype(np.uint16 if n_buckets <= 1 << 16 else np.int64), kind="stable")]
        h, b = h[order], b[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        self.back = np.empty(len(h), np.int64)
        self.back[order] = group
        self.names, buckets_ = h[new], b[new]
        self.many = np.bincount(group, minlength=len(self.names)) > 1
        self.cuts = np.searchsorted(buckets_, np.arange(n_buckets + 1))

    def rows(self, block: int, kind: str) -> list[tuple]:
        out = []
        for b in np.flatnonzero(np.diff(self.cuts)):
            part = slice(self.cuts[b], self.cuts[b + 1])
            raw = self.names[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : WIDTH[kind]].tobytes()
            out.append((int(b), block, kind, raw, np.packbits(self.many[part]).tobytes()))
        return out

    def answers(self, bits: dict[int, tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """repeated and lead for each name given, in the order given."""
        repeated, lead = np.zeros(len(self.names), bool), np.zeros(len(self.names), bool)
        for b, (r, s) in bits.items():
            n = int(self.cuts[b + 1] - self.cuts[b])
            part = slice(self.cuts[b], self.cuts[b + 1])
            repeated[part] = np.unpackbits(np.frombuffer(r, np.uint8), count=n)
            lead[part] = np.unpackbits(np.frombuffer(s, np.uint8), count=n)
        return repeated[self.back], lead[self.back]


class Block:
    """The distinct texts of a block, taken through the passes as far as answers are known."""

    def __init__(self, texts: list[bytes], n_buckets: int):
        self.n_buckets = n_buckets
        count: dict[bytes, int] = {}
        for t in texts:
            count[t] = count.get(t, 0) + 1
        self.keys = {t: hashlib.sha256(t).digest() for t in count if len(t) >= LENGTH}
        self.texts = sorted(self.keys, key=self.keys.get)
        self.count = count

    def split(self, flat: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
        return np.split(flat, np.cumsum([len(p) for p in parts])[:-1]) if parts else []

    def text_names(self) -> Names:
        names, buckets = [], []
        for t in self.texts:
            key = np.frombuffer(self.keys[t], "<u8")[:2]
            n = 2 if self.count[t] > 1 else 1
            names.append(np.repeat(key[:1], n))
            buckets.append(np.repeat((key[1:] % np.uint64(self.n_buckets)).astype(np.int64), n))
        return Names(names, buckets, self.n_buckets)

    def after_texts(self, bits: dict) -> None:
        """copied: another copy exists; live: stands for its copies from now on."""
        names = self.text_names()
        repeated, lead = names.answers(bits)
        at = np.cumsum([0] + [2 if self.count[t] > 1 else 1 for t in self.texts])[:-1]
        self.copied = dict(zip(self.texts, repeated[at], strict=True))
        self.live = [t for t, r, s in zip(self.texts, repeated[at], lead[at], strict=True) if s or not r]
        self.sizes = [len(t) for t in self.live]
        # Texts in stretches, hashed together; a text's substrings are hashed alike wherever it begins.
        self.stretches: list[tuple[common.Rolling, int, np.ndarray]] = []
        held, size = [], 0
        for k, t in enumerate(self.live):
            held.append(t)
            size += len(t)
            if size >= STRETCH or k + 1 == len(self.live):
                at = np.cumsum([0, *map(len, held)])
                self.stretches.append((common.Rolling(np.frombuffer(b"".join(held), np.uint8)), k + 1 - len(held), at))
                held, size = [], 0

    def named(self, start: list[np.ndarray], end: list[np.ndarray]) -> Names:
        got = []
        for rolling, k, at in self.stretches:
            i, j = (np.concatenate([x[k + m] + at[m] for m in range(len(at) - 1)]) for x in (start, end))
            got.append(rolling.names(i, j))
        # A bucket's number: the other hash's upper bits.
        buckets = [(((other >> np.uint64(32)) * np.uint64(self.n_buckets)) >> np.uint64(32)).astype(np.int64) for _, other in got]
        return Names([h for h, _ in got], buckets, self.n_buckets)

    def rank1_names(self) -> Names:
        self.places = [sample_places(n, SHORT) for n in self.sizes]
        return self.named(self.places, [p + SHORT for p in self.places])

    def after_rank1(self, names: Names, bits: dict) -> None:
        repeated, _ = names.answers(bits)
        self.places = [p[r] for p, r in zip(self.places, self.split(repeated, self.places), strict=True)]

    def rank2_names(self) -> Names:
        self.long = [p[(p >= V - 1) & (p <= n - LENGTH)] for n, p in zip(self.sizes, self.places, strict=True)]
        return self.named([p - V + 1 for p in self.long], [p + LENGTH for p in self.long])

    def after_rank2(self, names: Names, bits: dict) -> None:
        repeated, lead = names.answers(bits)
        self.settled, self.open = [], []
        for n, p, q, r, s in zip(self.sizes, self.places, self.long, self.split(repeated, self.long), self.split(lead, self.long), strict=True):
            maybe, settled, standing = before(n, p), before(n, q[r]), before(n, q[r & s])
            self.settled.append(settled)
            self.open.append(np.flatnonzero(maybe & ~settled | standing))

    def suffix_names(self) -> Names:
        return self.named(self.open, [p + LENGTH for p in self.open])

    def after_suffixes(self, names: Names, bits: dict) -> dict[bytes, np.ndarray]:
        """For each live text, which of its suffixes agree with another in LENGTH bytes."""
        repeated, _ = names.answers(bits)
        out = {}
        for t, settled, p, r in zip(self.live, self.settled, self.open, self.split(repeated, self.open), strict=True):
            settled[p[r]] = True
            out[t] = settled
        return out


def kept_bytes(text: bytes, starts: np.ndarray) -> tuple[bytes, int]:
    """The text without what the marked suffixes' first LENGTH bytes cover, and the number of runs removed."""
    step = np.zeros(len(text) + 1, np.int32)
    at = np.flatnonzero(starts)
    step[at] += 1
    step[at + LENGTH] -= 1
    gone = np.cumsum(step[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def sort_bucket(table: pa.Table) -> pa.Table:
    """One bucket: its names sorted, those that occur twice marked; of those, the first block is the lead."""
    common.occupy(__name__)
    out = []
    kinds, blocks = table["pass"].to_pylist(), table["block"].to_pylist()
    for kind in set(kinds):
        rows = sorted((b, i) for i, (k, b) in enumerate(zip(kinds, blocks, strict=True)) if k == kind)
        width, parts, many = WIDTH[kind], [], []
        for _, i in rows:
            raw = np.frombuffer(table["names"][i].as_py(), np.uint8).reshape(-1, width)
            full = np.zeros((len(raw), 8), np.uint8)
            full[:, :width] = raw
            parts.append(full.view("<u8").ravel())
            many.append(np.unpackbits(np.frombuffer(table["many"][i].as_py(), np.uint8), count=len(raw)).astype(bool))
        names = np.concatenate(parts)
        order = np.argsort(names, kind="stable")  # of equal names, the first block comes first
        s = names[order]
        same = s[1:] == s[:-1]
        repeated = np.zeros(len(s), bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        lead = np.r_[True, ~same] if len(s) else np.zeros(0, bool)
        r, f = np.empty(len(s), bool), np.empty(len(s), bool)
        r[order], f[order] = repeated, lead
        r |= np.concatenate(many)
        at = 0
        for (block, i), part in zip(rows, parts, strict=True):
            here = slice(at, at + len(part))
            at += len(part)
            out.append((block, table["bucket"][i].as_py(), kind, np.packbits(r[here]).tobytes(), np.packbits(f[here]).tobytes()))
    cols = list(zip(*out, strict=True))
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "bucket", "pass", "repeated", "lead"), cols, (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)})


def run_block(docs: pa.Table, bits: pa.Table | None, upto: str, n_buckets: int) -> Block | tuple[Block, Names] | dict:
    """A block through the passes before `upto`; the names of that pass, or after the last the marked suffixes."""
    common.occupy(__name__)
    known: dict[str, dict[int, tuple[bytes, bytes]]] = {k: {} for k in PASSES}
    if bits is not None:
        for kind, bucket, r, s in zip(*(bits[c].to_pylist() for c in ("pass", "bucket", "repeated", "lead")), strict=True):
            known[kind][bucket] = (r, s)
    block = Block(common.texts(docs["text"].combine_chunks()) if docs.num_rows else [], n_buckets)
    if upto == "text":
        return block, block.text_names()
    block.after_texts(known["text"])
    names = block.rank1_names()
    if upto == "rank1":
        return block, names
    block.after_rank1(names, known["rank1"])
    names = block.rank2_names()
    if upto == "rank2":
        return block, names
    block.after_rank2(names, known["rank2"])
    names = block.suffix_names()
    if upto == "suffix":
        return block, names
    return block, block.after_suffixes(names, known["suffix"])


def _dealt(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """The columns as one, `row`, and the text, dealt into blocks by the row's place in its file, so that rows equal in all are dealt out,
    too; and the number of buckets."""
    common.prepare(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.lit("block"), F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("_block")
    rest = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"], F.lit(None).cast("int").alias("_")).alias("row")
    return docs.select("text", rest, block).repartition("_block"), max(LEAST_BLOCKS, -(-total // BUCKET_BYTES))


def named(key: tuple, docs: pa.Table, bits: pa.Table | None, kind: str, n: int) -> pa.Table:
    block = int(key[0].as_py())
    cols = list(zip(*run_block(docs, bits, kind, n)[1].rows(block, kind), strict=True)) or [[]] * 5
    return pa.table({c: pa.array(x, t) for c, x, t in zip(("bucket", "block", "pass", "names", "many"), cols, (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)})


def alone(kind: str, n: int) -> Callable:
    return lambda key, docs: named(key, docs, None, kind, n)


def informed(kind: str, n: int) -> Callable:
    return lambda key, docs, bits: named(key, docs, bits, kind, n)


def _answers(d: DataFrame, n: int) -> DataFrame:
    """Bits of all passes, by block."""
    bits = None
    for kind in PASSES:
        # d whole, each time: one exchange of the documents serves all passes.
        if bits is None:
            sent = d.groupBy("_block").applyInArrow(alone(kind, n), NAMES)
        else:
            sent = d.groupBy("_block").cogroup(bits.groupBy("block")).applyInArrow(informed(kind, n), NAMES)
        answer = sent.groupBy("bucket").applyInArrow(sort_bucket, BITS)
        bits = answer if bits is None else bits.unionByName(answer)
    return bits


def _finished(d: DataFrame, n: int, fn: Callable[[pa.Table, list], pa.Table], schema) -> DataFrame:
    def last(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, marks = run_block(left, right, "", n)
        every: list[tuple[bytes, int]] = []
        for t in common.texts(left["text"].combine_chunks()) if left.num_rows else []:
            if len(t) < LENGTH:
                every.append((t, 0))
            elif block.copied[t]:
                every.append((b"", 1))
            else:
                every.append(kept_bytes(t, marks[t]))
        return fn(left, every)

    return d.groupBy("_block").cogroup(_answers(d, n).groupBy("block")).applyInArrow(last, schema)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    Removed: each byte that a LENGTH-byte string covers which also starts at another place of the table, judged on the input.
    Null text: empty. Texts under LENGTH bytes lose nothing. A text of which a copy exists loses all its bytes. Repeated rows are
    copies. Empty table: no rows.
    """
    d, n = _dealt(docs, ["doc_id", "text"])

    def digest(left: pa.Table, kept: list) -> pa.Table:
        sizes = [len(t) for t in common.texts(left["text"].combine_chunks())] if left.num_rows else []
        return pa.table({
            "doc_id": left["row"].combine_chunks().field("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array([s - len(k[0]) for s, k in zip(sizes, kept, strict=True)], pa.int64()),
            "n_spans": pa.array([k[1] for k in kept], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k[0]).hexdigest() for k in kept], pa.string()),
        })

    return _finished(d, n, digest, ROWS)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the kept bytes as text (what a cut leaves of a character is dropped) and n_chars, if there is such a column, to
    match; documents of which nothing is left are dropped unless they were empty before; null texts stay null. Other columns, whatever
    their names, are as they were. Empty table: no rows."""
    d, n = _dealt(docs, docs.columns)

    def rewrite(left: pa.Table, kept: list) -> pa.Table:
        rest = left["row"].combine_chunks()
        none = left["text"].combine_chunks().is_null().to_pylist()
        texts = [None if x else k[0].decode("utf-8", "ignore") for k, x in zip(kept, none, strict=True)]
        new = {"text": texts, "n_chars": [len(x or "") for x in texts]}
        had = common.texts(left["text"].combine_chunks()) if left.num_rows else []
        kind = lambda c: pa.string() if c == "text" else rest.type.field(c).type
        out = pa.table({c: pa.array(new[c]).cast(kind(c)) if c in new else rest.field(c) for c in columns})
        return out.filter(pa.array([bool(x) or not h for x, h in zip(texts, had, strict=True)], pa.bool_()))

    columns = docs.columns
    return _finished(d, n, rewrite, docs.schema)
