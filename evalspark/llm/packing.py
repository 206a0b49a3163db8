"""Best-fit packing of documents into sequences by bin completion.

A document is its token ids and an end id; one longer than a sequence is cut into full pieces, the
first of which may be shorter. What has to be packed is then a multiset of lengths from 1 to
`size`, so its histogram (at most `size` counts, whatever the corpus) is all that the search sees:
bin completion takes the largest length left, enumerates undominated fillings around it, and
applies a filling as often as the counts allow. Best-fit decreasing completes every node and gives
the incumbents; branches are cut by waste bounds. Pieces then look up their place by their rank
within their length; ranks are numbered in hashed buckets, as many as the root of a length's
pieces, so one that a third of all pieces share is split over tasks, and so are its buckets' sums.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.bpe import byte_letters
from evalspark.llm.common import materialize, released

SIZE, END = 1024, 2
NODES, WIDTH, BRANCHES = 20_000, 4, 12  # that the search may open in all, and of a level and a node at a time
LOOKS = 64  # fillings, dominated ones too, that are looked at when a node is opened; it is returned to for more
CACHE = 150_000  # words a worker remembers

# ---------------------------------------------------------------- tokens

_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]| [ \n]|\n |^ | $")
#: Fixed value: the pieces the byte-level vocabulary splits a text into.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """A byte-level BPE tokenizer file behind a memory of words.

    No token spans from a letter into the single space before the next word, so " word" stretches
    are encoded once each, by the same vocabulary's ranks; texts with other white space side by
    side, or with a special token's string, are encoded whole by the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.words = tiktoken.Encoding("words", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text or _ODD.search(text) or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *words = text.split(" ")
        known, ids = self.cache, self.words.encode_ordinary
        unknown = [w for w in set(words) if w not in known]
        if len(known) + len(unknown) > CACHE:
            known.clear()
            unknown = set(words)
        for w in unknown:
            known[w] = array("I", ids(" " + w)).tobytes()
        return array("I", ids(first)).tobytes() + b"".join([known[w] for w in words])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece (0..), start, length, ids_crc32, and ids (binary) if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            step = max(1, batch.num_rows // max(1, batch.nbytes >> 22))
            for lo in range(0, batch.num_rows, step):
                out: list[tuple] = []
                part = batch.slice(lo, step)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = enc.encode(text or "") + last
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n, size), n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        raw = ids[4 * a : 4 * b]
                        out.append((doc, k, a, b - a, zlib.crc32(raw), raw if keep_ids else None))
                arrays = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays if keep_ids else arrays[:5], names=names if keep_ids else names[:5])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: released(run(b)), schema)


# ---------------------------------------------------------------- the search


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...]]:
    """All undominated ways to fill `room` from the counts, with any number of items: least waste first, larger items first on ties."""
    return (f for f in _looked_at(counts, room) if f is not None)


def _looked_at(counts: np.ndarray, room: int, least: int = 0) -> Iterator[tuple[int, ...] | None]:
    """The fillings of at least `least` in order, None in the place of each that is dominated.

    Sums are reached by a bounded knapsack over the lengths, the set of sums as the bits of a
    number; the fillings of the highest sums are read off it. A filling is dominated if an item that
    is left could be added, or put in the place of a smaller one of it.
    """
    if room <= 0:
        yield ()
        return
    left = np.flatnonzero(counts[: room + 1] > 0).tolist()
    mask = (1 << room + 1) - 1
    reach = [1]  # sums of the k shortest lengths
    for v in left:
        now, n, step = reach[-1], min(int(counts[v]), room // v), 1
        while n > 0:  # counts by doubling
            step = min(step, n)
            now |= now << v * step & mask
            n -= step
            step *= 2
        reach.append(now)

    def ways(total: int, k: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        for at in range(k, 0, -1):  # the largest item
            v = left[at - 1]
            for n in range(min(int(counts[v]), total // v), 0, -1):
                if reach[at - 1] >> (total - n * v) & 1:
                    for rest in ways(total - n * v, at - 1):
                        yield (v,) * n + rest

    all_left = sum(1 << v for v in left)

    def dominated(way: tuple[int, ...], waste: int) -> bool:
        spare = all_left
        for v in set(way):
            if counts[v] == way.count(v):
                spare ^= 1 << v
        near = (1 << waste) - 1
        return any(spare >> x + 1 & near for x in {0, *way})

    sums = reach[-1]
    while sums:
        total = sums.bit_length() - 1
        sums ^= 1 << total
        if total < least:
            return
        for way in ways(total, len(left)):
            yield way if total == room or not dominated(way, room - total) else None


def _times(counts: np.ndarray, bin_: tuple[int, ...]) -> int:
    return min(int(counts[v]) // bin_.count(v) for v in set(bin_))


def _best_fit(counts: np.ndarray) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
    """Best-fit decreasing on a histogram: (lengths with how many of each, room left, times used) of each bin, which takes the largest item that fits, again and again, as often as the counts allow."""
    lengths, left, size = np.flatnonzero(counts).tolist(), counts.tolist(), len(counts) - 1
    while lengths:
        room, used, times, at = size, [], left[lengths[-1]], len(lengths)
        while at:
            v = lengths[at - 1]
            have, n = left[v], room // v
            if n > have:
                n = have
            used.append((v, n))
            room -= n * v
            if have < times * n:
                times = have // n
            at = bisect_right(lengths, room, 0, at - 1) if room else 0
        for v, n in used:
            left[v] -= times * n
            if not left[v]:
                del lengths[bisect_left(lengths, v)]
        yield used, room, times


def _listed(used: list[tuple[int, int]]) -> tuple[int, ...]:
    return tuple(v for v, n in used for _ in range(n))


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing's bins (lengths, largest first) with how often each is used."""
    return [(_listed(used), times) for used, _, times in _best_fit(counts)]


def least_bins(counts: np.ndarray) -> int:
    """A bound from below: the best over all splits into items that need a bin of their own (over size - a, over half) and items of at least a that fill them."""
    size = len(counts) - 1
    lengths = np.arange(size + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * lengths)
    best = -(-int(total[-1]) // size)
    for a in range(size // 2 + 1):
        large = int(n[-1] - n[size - a])
        half, half_sum = int(n[size - a] - n[size // 2]), int(total[size - a] - total[size // 2])
        small = int(total[size // 2] - (total[a - 1] if a else 0))
        best = max(best, large + half + max(0, -(-(small - (size * half - half_sum)) // size)))
    return best


class _Node:
    """A choice of bins, how well best fit completes it, and how many of the ways on have been taken. What is left to pack is kept as the choices only."""

    def __init__(self, counts: np.ndarray, used: int, path: tuple):
        self.used, self.path, self.taken, self.more = used, path, 0, True
        self.first, self.bins, waste = (), used, 0
        for bin_, room, times in _best_fit(counts):
            self.first = self.first or _listed(bin_)
            self.bins += times
            waste += times * room * room
        # of equal numbers of bins the one whose waste lies in few bins: these can be filled yet
        self.rank = (self.bins, -waste)

    def chosen(self) -> list[tuple[tuple[int, ...], int]]:
        out, path = [], self.path
        while path:
            out.append(path[0])
            path = path[1]
        return out[::-1]

    def left(self, start: np.ndarray) -> np.ndarray:
        counts, path, lengths, times = start.copy(), self.path, [], []
        while path:
            (way, n), path = path
            lengths += way
            times += [n] * len(way)
        np.subtract.at(counts, lengths, times)
        return counts

    def below(self, start: np.ndarray, bins: int) -> list[tuple[bytes, _Node]]:
        """The nodes of the next BRANCHES ways that may still need fewer than `bins` bins."""
        counts = self.left(start)
        inner, top, size = counts.copy(), self.first[0], len(counts) - 1
        inner[top] -= 1
        total = int((counts * np.arange(size + 1)).sum())
        least = total - size * (bins - 2 - self.used) - top  # less leaves too much waste, whatever follows
        ways = chain([self.first], _looked_at(inner, size - top, least))
        out: list[tuple[bytes, _Node]] = []
        self.more = False
        for at, way in enumerate(islice(ways, self.taken, self.taken + LOOKS + 1)):
            if at == LOOKS or len(out) == BRANCHES:
                self.more = True
                break
            self.taken += 1
            if way is None:
                continue
            way = way if self.taken == 1 else (top, *way)
            if self.taken > 1 and way == self.first:
                continue
            n = _times(counts, way)
            if self.used + n - (n * sum(way) - total) // size < bins:
                other = counts.copy()
                for v in set(way):
                    other[v] -= n * way.count(v)
                out.append((other.tobytes(), _Node(other, self.used + n, ((way, n), self.path))))
        return out


def plan(histogram: dict[int, int], size: int = SIZE, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Bins (lengths, largest first) with how often each is used; all counts are used up.

    Branch and bound: a node's branches are the fillings around its largest length, each as often as
    the counts allow; best fit completes every node, and the best completion is the incumbent. The
    `WIDTH` best nodes of the deepest level are opened next, `BRANCHES` branches of each at a time;
    what is left of them, and of their level, is returned to later. A branch whose waste leaves no
    room for a better result is cut. The search ends when the incumbent meets the bound from below,
    when all is searched, or after `nodes` nodes (the documented allowance of an NP-hard problem).
    """
    start = np.zeros(size + 1, np.int64)
    for v, n in histogram.items():
        start[v] = n
    best, least = _Node(start, 0, ()), least_bins(start)
    # first straight down by least waste: with many lengths that meets the bound at once
    used, path, counts = 0, (), start.copy()
    while counts.any() and best.bins > least:
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        way = (top, *next(fillings(counts, size - top)))
        counts[top] += 1
        n = _times(counts, way)
        for v in way:
            counts[v] -= n
        used, path = used + n, ((way, n), path)
    if best.bins > least and used < best.bins:
        best = _Node(counts, used, path)
    levels, opened = [[_Node(start, 0, ())]] if best.bins > least else [], 1
    while levels and best.bins > least and opened <= nodes:
        level = levels[-1]
        now, level[:] = level[:WIDTH], level[WIDTH:]
        found: dict[bytes, _Node] = {}
        for node in now:
            some = node.below(start, best.bins)
            opened += max(1, len(some))
            if node.more:
                level.append(node)
            for key, x in some:
                if key not in found or x.rank < found[key].rank:
                    found[key] = x
        best = min([best, *found.values()], key=lambda x: x.bins)
        if not level:
            levels.pop()
        if further := [x for x in found.values() if x.first]:
            levels.append(sorted(further, key=lambda x: x.rank))
    return best.chosen() + best_fit(best.left(start))


# ---------------------------------------------------------------- places


def _slots(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """For each length its runs of ranks: (first rank, end rank, first sequence, offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    at: dict[int, int] = {}
    sequence = 0
    for bin_, n in bins:
        offset = 0
        for v in bin_:
            rank = at.get(v, 0)
            out.setdefault(v, []).append((rank, rank + n, sequence, offset))
            at[v] = rank + n
            offset += v
        sequence += n
    return sorted(out.items())


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to pieces (a stored table). The plan is one row a length: at most `size` rows are broadcast."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    schema = "length long, parts long, runs array<struct<lo:long,hi:long,first:long,offset:long>>"
    runs = spark.createDataFrame([(v, isqrt(histogram[v]), r) for v, r in _slots(plan(histogram, size))], schema)
    keyed = cut.join(F.broadcast(runs.select("length", "parts")), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), "parts"))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("own", F.row_number().over(own) - 1).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))
    placed = ranked.join(F.broadcast(runs.select("length", "runs")), "length").withColumn("run", F.expr("filter(runs, r -> rank >= r.lo AND rank < r.hi)[0]"))
    return placed.select(*cut.columns, (F.col("run.first") + F.col("rank") - F.col("run.lo")).alias("sequence_id"), F.col("run.offset").alias("offset"))


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pack all documents: one row per piece with its sequence_id and offset.

    Null and empty texts are a piece of the end id alone; texts of any length are encoded whole;
    repeated rows and null doc_ids are packed like any other; extra columns are ignored; an empty
    table gives none.
    """
    return place(materialize(pieces(docs, path, size, end, keep_ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (from pack(keep_ids=True)): sequence_id, ids binary, doc_ids; each group has at most `size` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
