"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, decoding by a UTF-8 state machine.

The merges compile into a transducer over bytes. After each byte, every prefix of the piece has one last token: the token t,
ending there, that the merges leave as it is after the last token of the prefix before t. Those links form a tree; only
prefixes from which a longer token may still start are alive, and what all of them have in common can no longer change, so it is
emitted. What is left, renamed relative to its root, is a state; states and transitions are made when first met. Lookahead is
bounded by the longest token.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evseq.llm import common

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: States and pairs kept before a table starts anew; short pieces kept before the oldest go, half of all at once.
MOST_STATES, MOST_PAIRS, MOST_PIECES = 200_000, 200_000, 200_000
#: A file of ranks above this is not sent to the executors.
MOST_RANK_BYTES = 64 << 20


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelling = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token: dict[int, int] = {}  # node -> rank of the token spelt so far
        self.inner: set[int] = set()  # nodes that a longer token passes
        last = 0
        for t, i in ranks.items():
            node = 0
            for b in t:
                self.inner.add(node)
                key = node << 8 | b
                if (node := self.child.get(key, -1)) < 0:
                    last += 1
                    self.child[key] = node = last
            self.token[node] = i
        self.pair: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        # Of two tokens that spell a third, first << 32 | second -> its rank.
        self.merge = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.never = max(self.spelling, default=0) + 1
        self.reset()

    def reset(self) -> None:
        # A state: entries (parent's index, last token, trie node or -1) by place, their numbers one after the other; the first is the root.
        start = (-1, -1, 0)
        self.number = {start: 0}
        self.states = [start]
        self.go: dict[int, tuple[int, tuple[int, ...]]] = {}  # state << 8 | byte -> next state, tokens emitted
        self.rest: dict[int, tuple[int, ...]] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge, the last of all, makes this one; (-1, -1) of a single byte, None if the merges never make it."""
        if token not in self.halves:
            spelt = self.spelling[token]
            parts = [spelt[i : i + 1] for i in range(len(spelt))]
            while len(parts) > 2:
                best, at = token, -1
                for i in range(len(parts) - 1):
                    r = self.ranks.get(parts[i] + parts[i + 1])
                    if r is not None and r < best:
                        best, at = r, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (-1, -1) if len(spelt) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def stays(self, left: int, right: int) -> bool:
        """Whether the merges leave these neighbours as they are; left -1: the start of the piece."""
        key = left << 32 | right
        if (known := self.pair.get(key)) is None:
            if len(self.pair) > MOST_PAIRS:
                self.pair.clear()
            known = self.pair[key] = self.parts(right) is not None and (left < 0 or self.apart(left, right))
        return known

    def apart(self, x: int, y: int) -> bool:
        """Back in time from both tokens to single bytes, the later merge undone first: x is what stood before the border, y behind it,
        and neither was merged across it before it was merged with its own. Of equal ranks, the merge further left came first."""
        merge, halves = self.merge, self.halves
        of_x = of_y = self.never  # ranks at which they were merged with their own; at first never
        while True:
            r = merge.get(x << 32 | y)
            if r is not None and r < of_x and r <= of_y:
                return False
            before = halves[x] if x in halves else self.parts(x)
            after = halves[y] if y in halves else self.parts(y)
            if before is None or after is None:
                return False
            if before[0] < 0 and after[0] < 0:
                return True
            if after[0] < 0 or before[0] >= 0 and x > y:
                of_x, x = x, before[1]
            else:
                of_y, y = y, after[0]

    def step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        child, tokens, inner = self.child, self.token, self.inner
        new, parent, token = [], -1, -1
        flat = iter(self.states[number])
        for k, (up, last, node) in enumerate(zip(flat, flat, flat)):
            if node >= 0 and (node := child.get(node << 8 | byte, -1)) >= 0:
                if parent < 0 and (t := tokens.get(node)) is not None and self.stays(last, t):
                    parent, token = k, t  # the longest: entries are in order of place
                if node not in inner:
                    node = -1
            new.append((up, last, node))
        if parent < 0:
            raise ValueError("the ranks have no token for a single byte")
        new.append((parent, token, 0))
        # What is alive or leads to it; how many ways on each entry has, and the last of them.
        n = len(new)
        ways, on = [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            up, _, node = new[k]
            if node >= 0 or ways[k]:
                ways[up] += 1
                on[up] = k
        root, out = 0, []
        while new[root][2] < 0 and ways[root] == 1:  # one way on: the token it leads to is fixed
            root = on[root]
            out.append(new[root][1])
        _, last, node = new[root]
        state, index = [-1, last if node >= 0 else -2, node], {root: 0}
        for k in range(root + 1, n):
            up, last, node = new[k]
            if node >= 0 or ways[k]:
                index[k] = len(index)
                state += (index[up], last, node)
        state = tuple(state)
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
        self.go[number << 8 | byte] = move = (to, tuple(out))
        return move

    def finish(self, number: int) -> tuple[int, ...]:
        entries, out = self.states[number], []
        k = len(entries) - 3
        while k > 0:
            out.append(entries[k + 1])
            k = 3 * entries[k]
        self.rest[number] = done = tuple(reversed(out))
        return done

    def encode(self, piece: bytes) -> list[int]:
        """A piece of any length in one pass."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > MOST_STATES:
            self.reset()
        state, out, go = 0, [], self.go
        for b in piece:
            try:
                state, emitted = go[state << 8 | b]
            except KeyError:
                state, emitted = self.step(state, b)
            if emitted:
                out += emitted
        out += self.rest.get(state) or self.finish(state)
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern)
        #: Bytes of each id, by its decimal digits.
        self.spelling = {str(i): t for i, t in self.transducer.spelling.items()}
        # Short pieces met of late, and those met before them: their ids in decimal, joined by spaces.
        self.pieces: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def piece(self, piece: str) -> str:
        known = self.older.get(piece)
        if known is None:
            known = " ".join(map(str, self.transducer.encode(piece.encode())))
        if len(piece) < 64:
            if len(self.pieces) >= MOST_PIECES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = known
        return known

    def encode(self, text: str) -> str:
        """Ids in decimal, joined by spaces."""
        known, new = self.pieces.get, self.piece
        out = []
        for piece in self.split.findall(text):
            ids = known(piece)
            if ids is None:
                ids = new(piece)
                known = self.pieces.get
            out.append(ids)
        return " ".join(out)


class StreamDecoder:
    """Ids in, text out, in steps: bytes of a character that is not complete yet wait for the next ids. The state machine is the standard
    library's incremental UTF-8 decoder. Ids may be numbers or their digits, as the spelling has them."""

    def __init__(self, spelling: dict[int, bytes] | dict[str, bytes]):
        self.spelling = spelling
        self.machine = codecs.getincrementaldecoder("utf-8")("strict")

    def feed(self, ids: list, final: bool = False) -> str:
        return self.machine.decode(b"".join([self.spelling[i] for i in ids]), final)


def decode_stream(ids: list, spelling: dict, step: int = 4096) -> Iterator[str]:
    """The text of the ids, in pieces."""
    decoder = StreamDecoder(spelling)
    for i in range(0, max(1, len(ids)), step):
        yield decoder.feed(ids[i : i + step], i + step >= len(ids))


_loaded: dict[tuple[str, str], Encoder] = {}
common.CACHES.append(_loaded)


def tokenized(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of what the decoder makes of the ids) and, if wanted, ids for each row; the rank file
    is read by the driver alone and sent to the executors (its size is checked). Null or empty text: no ids. Rows are independent. Ids
    that are no UTF-8 together, which no text gives, are an error."""
    spark = common.prepare(docs.sparkSession)
    with open(rank_file, "rb") as f:
        raw = f.read(MOST_RANK_BYTES + 1)
    if len(raw) > MOST_RANK_BYTES:
        raise ValueError(f"{rank_file} is over {MOST_RANK_BYTES} bytes")
    sent, key = spark.sparkContext.broadcast(raw), (hashlib.sha256(raw).hexdigest(), pattern)

    def one(batch: pa.RecordBatch) -> dict:
        from evseq.llm import bpe  # the module's table lives as long as the worker

        if key not in bpe._loaded:
            bpe._loaded[key] = Encoder(read_ranks(sent.value), pattern)
        encoder = bpe._loaded[key]
        cols: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")}
        for text in batch.column(1).to_pylist():
            spelt = encoder.encode(text or "")
            ids = spelt.split()
            back = hashlib.sha256()
            for part in decode_stream(ids, encoder.spelling):
                back.update(part.encode())
            cols["n_tokens"].append(len(ids))
            cols["ids_sha256"].append(hashlib.sha256(spelt.encode()).hexdigest())
            cols["decoded_sha256"].append(back.hexdigest())
            if with_ids:
                cols["ids"].append(np.fromstring(spelt, np.int32, sep=" ") if ids else np.zeros(0, np.int32))
        return cols | {"doc_id": batch.column(0)}

    return common.map_rows(docs.select("doc_id", "text"), one, SCHEMA + (", ids array<int>" if with_ids else ""))
