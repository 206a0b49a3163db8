"""BPE encoding and decoding by tree concatenation.

A long text is halved, wherever that falls, until leaves have at most `TEXT_LEAF` characters. The
leaves are encoded in parallel, and neighbours are joined bottom-up: the window around a join, from
the last white space before it to the first one behind, is encoded again; it grows over whole
leaves until both of its ends are at white space, where the two sides agree with the text exactly.

A run without white space of `RUN` characters or more would make one window of itself. It is cut
into the pieces that the vocabulary never merges across; a long one is halved until parts have at
most `LEAF` symbols, and at each join a window of tokens is encoded again and doubled until its
first token is the left side's and its last the right side's. Every adjacent pair of tokens is then
one that the merges themselves produce, so the join is exact.

In Spark, texts of over `SPLIT` characters take a branch of their own: their leaves are rows that
are dealt over the cluster, then gathered by text and joined. All other texts are encoded where they
are read (long words in them by the same halving). The vocabulary is a parameter (a tokenizer file).
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import bounds, grouped, materialize, released

SPLIT, TEXT_LEAF, RUN, LEAF = 1 << 14, 1 << 12, 1 << 14, 256
CACHE = 300_000  # words, and pieces of words, that a worker remembers
NONE = 1 << 60  # the rank of a pair that doesn't merge

#: The pieces the word vocabulary allows, its end-of-word mark.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
MARK = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """The merges and tokens of a word-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks: dict[tuple[str, str], int] = {p: k for k, p in enumerate(pairs)}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.stops = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.letters = byte_letters()
        self.cache: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def symbols(self, piece: str) -> list[str]:
        out = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        out[-1] += MARK
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        if len(symbols) <= 48:
            s, rank = list(symbols), self.ranks.get
            ranks = [rank(p, NONE) for p in zip(s, s[1:], strict=False)]
            while ranks and (best := min(ranks)) < NONE:
                k = ranks.index(best)
                s[k] += s.pop(k + 1)
                ranks.pop(k)
                if k:
                    ranks[k - 1] = rank((s[k - 1], s[k]), NONE)
                if k < len(ranks):
                    ranks[k] = rank((s[k], s[k + 1]), NONE)
            return s
        s: list[str | None] = list(symbols)
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, s[k], s[k + 1]) for k in range(n - 1) if (r := self.ranks.get((s[k], s[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if s[k] != a or j >= n or s[j] != b:
                continue
            s[k], s[j] = a + b, None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := self.ranks.get((s[x], s[y]))) is not None:
                    heapq.heappush(heap, (r, x, s[x], s[y]))
        return [x for x in s if x is not None]

    def join(self, left: list[str], right: list[str], spans: dict[str, list[str]] | None = None) -> list[str]:
        """Tokens of two encoded neighbours, encoded as one."""
        if not left or not right:
            return left + right
        w = 2
        while True:
            a, b = min(w, len(left)), min(w, len(right))
            window = self.merge(self.split("".join(left[len(left) - a :] + right[:b])))
            left_ok = a == len(left) or window[0] == left[len(left) - a]
            right_ok = b == len(right) or window[-1] == right[b - 1]
            if left_ok and right_ok:
                return left[: len(left) - a] + window + right[b:]
            w *= 2

    def split(self, joined: str) -> list[str]:
        """The symbols of a stretch of joined tokens: one letter a byte, the mark with the last."""
        return [*joined[: -len(MARK) - 1], joined[-len(MARK) - 1 :]] if joined.endswith(MARK) and len(joined) > len(MARK) else [*joined]

    def tree(self, parts: list[list[str]]) -> list[str]:
        """Join encoded neighbours pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def leaves(self, symbols: list[str], leaf: int = LEAF) -> list[list[str]]:
        """Halve until no part has over `leaf` symbols."""
        if len(symbols) <= leaf:
            return [symbols]
        m = len(symbols) // 2
        return self.leaves(symbols[:m], leaf) + self.leaves(symbols[m:], leaf)

    def encode_piece(self, piece: str, leaf: int = LEAF) -> list[str]:
        return self.tree([self.merge(x) for x in self.leaves(self.symbols(piece), leaf)])

    def piece(self, piece: str) -> bytes:
        ids = [self.ids[t] for t in (self.encode_piece(piece) if len(piece) > LEAF // 4 else self.merge(self.symbols(piece)))]
        known = array("I", ids).tobytes()
        if len(self.known) >= CACHE:
            self.known.clear()
        if len(piece) <= LEAF:
            self.known[piece] = known
        return known

    def chunk(self, chunk: str) -> bytes:
        """The ids of a stretch without white space, as little-endian unsigned 32-bit integers."""
        if (known := self.cache.get(chunk)) is None:
            known = b"".join([self.known.get(p) or self.piece(p) for p in self.pieces.findall(fold(chunk))])
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[chunk] = known
        return known

    def encode(self, text: str) -> bytes:
        """The ids of a whole text (little-endian unsigned 32-bit). Special tokens' strings become their ids."""
        out = []
        for k, part in enumerate(self.stops.split(text) if self.stops and "<|" in text else [text]):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                chunks = part.split() if not _ODD.search(part) else _SPACE.split(part)
                get = self.cache.get
                out += [get(c) or self.chunk(c) for c in chunks]
        return b"".join(out)

    def part(self, leaf: str) -> tuple[str, bytes, str | None]:
        """A leaf as (its first stretch, the ids between, its last stretch): the stretches go on beyond the leaf. One without white space: (itself, none, None)."""
        first, *inner = _SPACE.split(leaf)
        if not inner:
            return first, b"", None
        get = self.cache.get
        return first, b"".join([get(c) or self.chunk(c) for c in inner[:-1]]), inner[-1]

    def concatenate(self, parts: list[tuple[str, bytes, str | None]]) -> bytes:
        """The ids of neighbouring leaves, joined pairwise, level by level."""

        def join(a: tuple[str, bytes, str | None], b: tuple[str, bytes, str | None]) -> tuple[str, bytes, str | None]:
            if a[2] is None:  # the window goes on to the left
                return a[0] + b[0], b[1], b[2]
            if b[2] is None:  # and to the right
                return a[0], a[1], a[2] + b[0]
            return a[0], a[1] + self.chunk(a[2] + b[0]) + b[1], b[2]

        while len(parts) > 1:
            parts = [join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        first, ids, last = parts[0]
        return self.chunk(first) + ids + self.chunk(last or "")

    def decode(self, ids: np.ndarray) -> str:
        """Tokens with a space between, special ones too; unknown ids are skipped."""
        return " ".join([t for t in map(self.tokens.get, ids.tolist()) if t is not None])


_ODD = regex.compile("[\x1c-\x1f]")  # white space to str.split, but not to the vocabulary
_SPACE = regex.compile(r"\p{White_Space}+")


def fold(text: str) -> str:
    """Canonical composition, then lower case letter by letter (no final sigma)."""
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _out(batch: pa.RecordBatch, found: list[bytes], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            size = max(1, batch.num_rows // max(1, batch.nbytes >> 22))
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                found = [v.encode(t or "") for t in part.column(1).to_pylist()]
                yield _out(part, found, [v.decode(np.frombuffer(x, "<u4")) for x in found])

    return run


def halves(text: str, leaf: int) -> list[str]:
    """Halved until no part has over `leaf` characters."""
    if len(text) <= leaf:
        return [text] if text else []
    m = len(text) // 2
    return halves(text[:m], leaf) + halves(text[m:], leaf)


ROW = "uid long, doc_id long, part long, kind string, word long, ids binary, head string, tail string"
_ROW = (("uid", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("kind", pa.string()), ("word", pa.int64()), ("ids", pa.binary()), ("head", pa.string()), ("tail", pa.string()))


def _leaves(path: str, leaf: int, run_: int):
    """A text in rows (kind, word, ids, head): special tokens' ids, leaves of text, and leaves of long words; those of one word (a number) are joined."""
    long_run = regex.compile(rf"\P{{White_Space}}{{{run_},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for uid, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []

                def stretch(part: str, rows=rows) -> None:
                    word = len(rows) + 1
                    rows.extend(("text", word, None, x) for x in halves(part, leaf))

                for k, part in enumerate(v.stops.split(text) if v.stops else [text]):
                    if k % 2:
                        rows.append(("ids", 0, np.array([v.special[part]], "<u4").tobytes(), None))
                        continue
                    at = 0
                    for m in long_run.finditer(part):
                        stretch(part[at : m.start()])
                        at = m.end()
                        for p in v.pieces.findall(fold(m[0])):
                            word = len(rows) + 1
                            rows.extend(("word", word, None, "".join(x)) for x in v.leaves(v.symbols(p)))
                    stretch(part[at:])
                n = len(rows)
                cols = [[uid] * n, [doc] * n, range(n), *([r[i] for r in rows] for i in range(4)), [None] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _ROW, strict=True)], names=[k for k, _ in _ROW])

    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            out = []
            for kind, ids, leaf in zip(*(batch.column(k).to_pylist() for k in (3, 5, 6)), strict=True):
                if kind == "ids":
                    out.append((None, ids, None))
                elif kind == "word":
                    out.append((None, np.array([v.ids[t] for t in v.merge(v.split(leaf))], "<u4").tobytes(), None))
                else:
                    out.append(v.part(leaf))
            cols = [pa.array([x[i] for x in out], t) for i, t in ((1, pa.binary()), (0, pa.string()), (2, pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *cols], names=batch.schema.names)

    return run


def _gather(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for rows in grouped(batches, ["uid"]):
            uid, word = rows.column("uid").to_numpy(), rows.column("word").to_numpy()
            kind, ids, head, tail, doc = (rows.column(c) for c in ("kind", "ids", "head", "tail", "doc_id"))
            at = bounds(uid)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                cut, out = bounds(word[lo:hi]) + lo, []
                for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    own = ids.slice(s, e - s).to_pylist()
                    what = kind[s].as_py()
                    if what == "ids":
                        out += own
                    elif what == "text":
                        out.append(v.concatenate(list(zip(head.slice(s, e - s).to_pylist(), own, tail.slice(s, e - s).to_pylist(), strict=True))))
                    else:
                        tokens = v.tree([[v.tokens[i] for i in np.frombuffer(x, "<u4").tolist()] for x in own])
                        out.append(np.array([v.ids[t] for t in tokens], "<u4").tobytes())
                whole = b"".join(out)
                yield pa.RecordBatch.from_arrays([pa.array([doc[lo].as_py()], pa.int64()), pa.array([whole], pa.binary()), pa.array([v.decode(np.frombuffer(whole, "<u4"))], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, split: int = SPLIT, leaf: int = TEXT_LEAF, run: int = RUN) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit, decoded string) of every row's whole text.

    Null texts count as empty (no ids). Repeated rows and null doc_ids stay; extra columns are
    ignored; an empty table gives none. Texts and words of any length are encoded whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > split
    plain = rows.where(~long).mapInArrow(_whole(path), "doc_id long, ids binary, decoded string")
    leaves = rows.where(long).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(_leaves(path, leaf, run), ROW)
    encoded = materialize(leaves, "leaves").repartition("uid", "part").mapInArrow(lambda b: released(_encode_leaves(path)(b)), ROW)
    joined = encoded.repartition("uid").sortWithinPartitions("uid", "part").mapInArrow(_gather(path), "doc_id long, ids binary, decoded string")
    return plain.unionByName(joined)
