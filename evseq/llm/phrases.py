"""Phrase collocation mining by hierarchical pair naming.

Words of a language that occur MIN times or more get ids, joined over all documents; then adjacent ids that both stand are a pair, and pairs
that occur MIN times get ids in turn: names of phrases of two words, then, as pairs of those, of three words and of four. A phrase's id leads
to its left and right parent, the phrases without the last and the first word, so the parts of each cut and the phrases inside a longer one
are found by joins on ids, never by comparing words. No phrase with a rare part is ever counted.

Documents are dealt into blocks of bounded size, a language each, where they stand. A block is rewritten from level to level: its sequence of
words, of pairs, of triples, as small local numbers, with what is rare taken out. Each of its distinct names goes once, with its count, to a
bucket, which adds up and answers with ids; sequences stay with the block. Every level is a written table, so a lost executor costs no
more than its part of one level. All names are exact, words by their bytes and pairs by their parents' ids; there are no hashes to collide.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evseq.llm import common

#: Occurrences that make a candidate; words of the longest; part of an inner phrase's occurrences, in 100, at which a longer one covers it.
MIN, LONGEST, COVERED = 30, 4, 80
#: Phrases returned for a language; parts in which they are looked for first.
TOP, PARTS = 2000, 64
#: Bytes of text in a block; names (words or pairs) of all blocks in a bucket; least number of buckets.
BLOCK_BYTES, BUCKET_NAMES, LEAST = 4 << 20, 1 << 20, 64

WORDS = "lang string, seq binary, names array<binary>, counts binary"
PAIRS = "block long, lang string, seq binary, left binary, right binary, counts binary, n long"
SENT_WORDS = "bucket int, block long, lang string, names array<binary>, counts binary"
SENT_PAIRS = "bucket int, block long, lang string, left binary, right binary, counts binary"
#: Answers (block, bucket, ids) and the named phrases (lang, id and the rest; id 0: all words of the language).
NAMED = "block long, bucket int, ids binary, lang string, id long, left long, right long, f long, word binary"

#: A-Z lower-cased, ends of pieces as line feeds, tabs as spaces.
_TABLE = bytearray(common.LOWER_ASCII)
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 10
_TABLE[9] = 32
_TABLE = bytes(_TABLE)


def packed(a: np.ndarray) -> bytes:
    """Numbers from 0 on by planes of bytes, as many as the greatest needs, and how many: they are small, and ordered ones compress well."""
    width = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<i8").ravel()


def tokens(texts: Iterable[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Local numbers of the words of some texts, 0 after each piece, and the words by number from 1 on."""
    number = defaultdict(count().__next__)
    number[b"\n"], number[b""]
    parts = []
    for t in texts:
        w = (t.translate(_TABLE).replace(b"\n", b" \n ") + b" \n").split(b" ")
        parts.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
    seq = np.concatenate(parts)
    return squeezed(np.maximum(seq[seq != 1] - 1, 0)), list(number)[2:]


def squeezed(seq: np.ndarray) -> np.ndarray:
    """Of zeros in a row one stands for all."""
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] != 0) | (seq[:-1] != 0)
    return seq[keep]


def paired(seq: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """seq: local numbers, 0 between; ids: by local number, 0 where rare. The distinct pairs of adjacent ids, left, right and count, and the
    sequence of their local numbers."""
    seq = squeezed(np.where(ids[seq] != 0, seq, 0))
    both = (seq[:-1] != 0) & (seq[1:] != 0)
    pairs, which, n = np.unique(seq[:-1][both] << 32 | seq[1:][both], return_inverse=True, return_counts=True)
    out = np.zeros(len(both), np.int64)
    out[both] = which + 1
    alone = out != 0
    alone[1:] &= out[:-1] == 0
    alone[:-1] &= out[1:] == 0
    out[alone] = 0
    return ids[pairs >> 32], ids[pairs & 0xFFFFFFFF], n, squeezed(out)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they come, in blocks of BLOCK_BYTES of all languages together, cut at whole texts."""
    common.occupy(__name__)
    held, size = defaultdict(list), 0

    def out() -> pa.RecordBatch:
        rows = [(lang, *tokens(texts)) for lang, texts in held.items()]
        n = [np.bincount(seq, minlength=len(words) + 1)[1:] for _, seq, words in rows]
        columns = [r[0] for r in rows], [packed(r[1]) for r in rows], [r[2] for r in rows], [packed(x) for x in n]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.list_(pa.binary()), pa.binary()), strict=True)], ["lang", "seq", "names", "counts"])

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), common.texts(batch["text"]), strict=True):
            held[lang].append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                yield out()
                held.clear()
                size = 0
    if held:
        yield out()


def _order(buckets: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Names by bucket, and each bucket's place in that order. Sender and receiver of answers agree on it."""
    order = np.lexsort((*by, buckets))
    kinds, cuts = np.unique(buckets[order], return_index=True)
    return order, [(int(b), slice(a, z)) for b, a, z in zip(kinds, cuts, np.append(cuts, len(order))[1:], strict=True)]


def _word_order(names: list[bytes], k: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    return _order(np.fromiter((zlib.crc32(w) % k for w in names), np.int64, len(names)), np.arange(len(names)))


def _pair_order(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    h = common.mix(left.astype(np.uint64) * np.uint64(common.BASE) ^ common.mix(right.astype(np.uint64)))
    return _order((h % np.uint64(k)).astype(np.int64), right, left)


def _send(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.occupy(__name__)
        for batch in batches:
            words = "names" in batch.schema.names
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n = unpacked(row["counts"])
                if words:
                    order, parts = _word_order(row["names"], k)
                    columns = [[row["names"][i] for i in order[p]] for _, p in parts], [packed(n[order[p]]) for _, p in parts]
                    kinds = pa.list_(pa.binary()), pa.binary()
                else:
                    left, right = unpacked(row["left"]), unpacked(row["right"])
                    order, parts = _pair_order(left, right, k)
                    columns = tuple([packed(a[order[p]]) for _, p in parts] for a in (left, right, n))
                    kinds = (pa.binary(),) * 3
                m = len(parts)
                columns = [b for b, _ in parts], [row["block"]] * m, [row["lang"]] * m, *columns
                kinds = pa.int32(), pa.int64(), pa.string(), *kinds
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "block", "lang", *(("names", "counts") if words else ("left", "right", "counts"))])

    return run


def _table(columns: dict[str, list], n: int) -> pa.Table:
    kinds = {"block": pa.int64(), "bucket": pa.int32(), "ids": pa.binary(), "lang": pa.string(), "id": pa.int64(), "left": pa.int64(), "right": pa.int64(), "f": pa.int64(), "word": pa.binary()}
    return pa.table({c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()})


def _name(k: int, least: int):
    """Names of one bucket, added up; ids for those that occur often enough: the bucket and the place in it, so small numbers."""

    def run(key: tuple, table: pa.Table) -> Iterator[pa.Table]:
        common.occupy(__name__)
        bucket, held, lang_ids = key[0].as_py(), 0, table["lang"].to_pylist()
        rows = defaultdict(list)
        for i in sorted(range(table.num_rows), key=lambda i: table["block"][i].as_py()):
            rows[lang_ids[i]].append(i)
        for lang in sorted(rows):
            at = rows[lang]
            t = table.take(pa.array(at))
            n = [unpacked(x) for x in t["counts"].to_pylist()]
            ends, total = np.cumsum([len(x) for x in n]), np.concatenate(n)
            if "names" in t.column_names:
                flat = t["names"].combine_chunks().flatten().dictionary_encode()
                which, words = flat.indices.to_numpy(), flat.dictionary
                size = len(words)
            else:
                left, right = (np.concatenate([unpacked(x) for x in t[c].to_pylist()]) for c in ("left", "right"))
                order = np.lexsort((right, left))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
                which = np.empty(len(order), np.int64)
                which[order] = np.cumsum(new) - 1
                first, size = order[new], int(new.sum())
            f = np.zeros(size, np.int64)
            np.add.at(f, which, total)
            often = np.flatnonzero(f >= least)
            ids = np.zeros(size, np.int64)
            ids[often] = 1 + bucket + k * np.arange(held, held + len(often))
            held += len(often)
            yield _table({"block": t["block"].combine_chunks(), "bucket": [bucket] * len(at), "ids": [packed(x) for x in np.split(ids[which], ends[:-1])]}, len(at))
            made = {"lang": [lang] * len(often), "id": ids[often], "f": f[often]}
            made |= {"word": words.take(pa.array(often))} if "names" in t.column_names else {"left": left[first[often]], "right": right[first[often]]}
            yield _table(made, len(often))
            if "names" in t.column_names:
                yield _table({"lang": [lang], "id": [0], "f": [int(f.sum())]}, 1)

    return lambda key, table: pa.concat_tables(run(key, table))


def _rise(k: int, last: bool):
    """A block with its answers: its sequence one level up."""

    def run(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        common.occupy(__name__)
        out: dict[str, list] = {c: [] for c in ("block", "lang", "seq", "left", "right", "counts", "n")}
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        for row in blocks.to_pylist():
            got = dict(zip(answers["bucket"].to_pylist(), answers["ids"].to_pylist(), strict=True))
            order, parts = _word_order(row["names"], k) if "names" in row else _pair_order(unpacked(row["left"]), unpacked(row["right"]), k)
            ids = np.zeros(len(order) + 1, np.int64)
            for b, p in parts:
                ids[order[p] + 1] = unpacked(got[b])
            left, right, n, seq = paired(unpacked(row["seq"]), ids)
            for c, x in zip(out.values(), (row["block"], row["lang"], b"" if last else packed(seq), packed(left), packed(right), packed(n), len(n)), strict=True):
                c.append(x)
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), kinds, strict=True)})

    return run


def named(docs: DataFrame, least: int = MIN, longest: int = LONGEST) -> list[DataFrame]:
    """For phrases of 1, 2 .. words: lang, id, left, right, f and (of single words) word. With the words a row of id 0 for each language:
    all its words, rare ones, too. Written tables."""
    spark = common.prepare(docs.sparkSession)
    d = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    level, path = common.written(d.mapInArrow(_blocks, WORDS).withColumn("n", F.size("names").cast("long")).withColumn("block", F.monotonically_increasing_id()))
    out = []
    for size in range(1, longest + 1):
        k = max(LEAST, -(-(level.agg(F.sum("n")).first()[0] or 0) // BUCKET_NAMES))
        sent = level.drop("seq", "n").mapInArrow(_send(k), SENT_WORDS if size == 1 else SENT_PAIRS)
        names, _ = common.written(sent.groupBy("bucket").applyInArrow(_name(k, least), NAMED))
        out.append(names.where("id is not null").drop("block", "bucket", "ids"))
        before = path
        if size < longest:
            answers = names.where("id is null").select("block", "bucket", "ids")
            level, path = common.written(level.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_rise(k, size + 1 == longest), PAIRS))
        common.forget(spark, before)
    return out


def _score(a: Column, parts: Column) -> Column:
    """2000000 a over both parts, rounded down; products of over 64 bits are exact decimals."""
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(19,0)"), parts.cast("decimal(20,0)"))


def candidates(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, size, a, l, r, score and covered (a longer candidate holds its words with COVERED of 100 occurrences) for each phrase of two
    words or more: the cut of the lowest score, of equal scores the first. Joins on ids: a phrase's parents have all parts but the inner ones,
    which their own parents have."""
    words = levels[0].where("id > 0").select("id", F.col("word").cast("string").alias("phrase"), F.col("f").alias("a"), F.array(F.col("f")).alias("heads"), F.array(F.col("f")).alias("tails"), F.col("word").cast("string").alias("last"))
    below, out = words, None
    for size, level in enumerate(levels[1:], 2):
        left = below.select(F.col("id").alias("left"), F.col("phrase").alias("lp"), F.col("heads"))
        right = below.select(F.col("id").alias("right"), F.col("last"), F.col("tails"))
        # heads: occurrences of the first 1, 2 .. words; tails: of the last 1, 2 .. words.
        d = level.select("lang", "id", "left", "right", F.col("f").alias("a")).join(left, "left").join(right, "right")
        d = d.withColumn("phrase", F.concat("lp", F.lit(" "), "last"))
        cuts = [F.struct(_score(F.col("a"), F.col("heads")[i - 1] + F.col("tails")[size - i - 1]).alias("score"), F.lit(i).alias("k"), F.col("heads")[i - 1].alias("l"), F.col("tails")[size - i - 1].alias("r")) for i in range(1, size)]
        d = d.withColumn("cut", F.array_min(F.array(*cuts)))
        here = d.select("id", "left", "right", "lang", "phrase", F.lit(size).alias("size"), "a", "cut.l", "cut.r", "cut.score")
        if size < len(levels):
            # The most frequent longer phrase that holds it is one word longer, as what holds that one is no more frequent.
            longer = levels[size].select("left", "right", "f")
            longer = longer.select(F.col("left").alias("id"), "f").unionByName(longer.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("most"))
            here = here.join(longer, "id", "left").withColumn("covered", F.coalesce(100 * F.col("most").cast("decimal(19,0)") >= COVERED * F.col("a").cast("decimal(19,0)"), F.lit(False))).drop("most")
        else:
            here = here.withColumn("covered", F.lit(False))
        here = here.drop("id", "left", "right")
        out = here if out is None else out.unionByName(here)
        below = d.select("id", "phrase", "a", F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"), "last")
    return out


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score descending, a descending, phrase ascending.

    a: occurrences of the phrase inside pieces, overlaps included; l and r: of the parts of its lowest-scoring cut; n: all words of the
    language. Phrases that a longer candidate covers are left out. A-Z are lower-cased, texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces and
    those at spaces and tabs into words. Null lang: `und`, with what is called so. Null and empty texts have no words. Equal rows count each.
    Empty table, or no phrase frequent enough: no rows. Other columns are not read.
    """
    levels = named(docs)
    d = candidates(levels).where(~F.col("covered"))
    # The best of each of PARTS parts of a language first, so that no task has more than PARTS times `top` of its phrases.
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    d = d.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_n") <= top)
    best = d.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = levels[0].where("id = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
