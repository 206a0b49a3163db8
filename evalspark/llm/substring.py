"""Substring dedup: fuzzy passages that a document shares with an earlier one, by collinear chaining.

1. Seeds: of every 6 neighbouring five-word shingles the one with the least hash (minimizers), so
   any run of 10 equal words shares a seed. Each seed value points at its earliest document; a
   passage that thousands of documents share thus costs one link an occurrence, never all pairs.
2. Chains: the matched seeds of a (document, earlier document) pair are chained in order with
   linear gap costs; the best predecessor is a prefix maximum in a Fenwick tree.
3. Alignment: both sides of a chain are aligned word by word between the anchors and past the ends,
   and the alignment is taken apart where it is unlike, however far the chain was linked. Gaps of any
   size are aligned in linear space. An end runs on until it is unlike; where the words at hand
   don't show that, the chain is aligned again with more of them.
4. Passages: a document's aligned stretches, to whichever earlier document, are merged; those of
   `min_words` or more with `similarity` or more of their words matched are returned.

Documents are texts: rows that share both doc_id and text are one document, and rows that share a
doc_id only are different ones. Of these the text of the least hash is known by the doc_id, the
others by numbers beyond all ids, so they come after all documents of an id of their own. Null ids,
null and empty texts and texts under five words have no passage; texts of any length count whole;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import bounds, free, grouped, materialize, mix, release, released, slices, word_bounds, word_hashes
from evalspark.operators.ingest import number

K, WINDOW = 5, 6
MIN_WORDS, SIMILARITY = 50, 0.8
GAP_COST, JOIN_GAP = 0.1, 6
REACH = 32  # words past a chain's ends that an alignment sees at first; eight times as many in each further round
DROP = 24  # an end is unlike where its sum has fallen so far below its best
TABLE = 1 << 16  # cells of a gap that is aligned by a table; a larger one is halved
SPACE = " \t\n\x0b\f\r"


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every window x[i : i + w], by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[: len(out) - (w - have)], out[w - have :]) if have < w else out


def minimizers(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the seeds' first words, and their shingle hashes; no seed crosses a row."""
    n = len(words) - K + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(K):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    h = mix(h)
    inside = rows[:n] == rows[K - 1 :]
    h[~inside] = np.uint64(2**64 - 1)
    pad = np.full(WINDOW - 1, 2**64 - 1, np.uint64)
    least = _slide(np.concatenate([pad, h, pad]), WINDOW, np.minimum)  # windows over the padded row
    chosen = _slide(least, WINDOW, np.maximum) == h
    at = np.flatnonzero(chosen & inside)
    return at, h[at]


def versions(docs: DataFrame) -> DataFrame | None:
    """(doc_id, hash, key) of the texts whose doc_id another text has too, but the one of the least hash; None if there are none."""
    own = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"))
    twice = own.groupBy("doc_id").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("lo <> hi")
    twice = materialize(twice.select("doc_id", "lo"), "twice")
    if twice.isEmpty():
        release(twice)
        return None
    others = materialize(own.join(twice, "doc_id").where("hash <> lo").select("doc_id", "hash").distinct().withColumn("order", F.xxhash64("doc_id", "hash")), "others")
    last = F.broadcast(own.agg(F.max("doc_id").alias("last")))  # one row
    out = materialize(number(others, "order", "n").crossJoin(last).select("doc_id", "hash", (F.col("last") + 1 + F.col("n")).alias("key")), "versions")
    release(twice, others)
    return out


def keyed(docs: DataFrame, known: DataFrame | None, name: str) -> DataFrame:
    """Add the number that a row's document is known by; null ids and texts have none."""
    own = F.when(F.col("text").isNotNull(), F.col("doc_id").cast("long"))
    if known is None:
        return docs.withColumn(name, own)
    hash_, id_, key = free([*docs.columns, name], "_hash", "_id", "_key")
    named = known.select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_), F.col("key").alias(key))
    return docs.withColumn(id_, own).withColumn(hash_, F.xxhash64("text")).join(named, [id_, hash_], "left").withColumn(name, F.coalesce(key, id_)).drop(id_, hash_, key)


def seeds(docs: DataFrame) -> DataFrame:
    """(h, doc, pos, first) of documents (doc, text): first marks a document's first seed of that value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch):
                starts, ends, rows = word_bounds(data, off)
                at, h = minimizers(word_hashes(data, starts, ends), rows)
                begin = np.searchsorted(rows, np.arange(part.num_rows))
                own = rows[at]
                order = np.lexsort((at, h, own))
                same = np.zeros(len(at), bool)
                same[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
                doc = part.column(0).to_numpy()[own]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc), pa.array((at - begin[own]).astype(np.int32)), pa.array(~same)], names=["h", "doc", "pos", "first"])

    return docs.mapInArrow(lambda b: released(run(b)), "h long, doc long, pos int, first boolean")


def chain(pos: np.ndarray, rpos: np.ndarray, k: int = K, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Collinear chains over matches sorted by (pos, rpos): lists of indexes, best chain first.

    Score: k for each match, less gap_cost for each word skipped on either side (halved). The best
    predecessor among smaller pos and smaller rpos is a prefix maximum in a Fenwick tree over rpos.
    """
    n = len(pos)
    ranks = np.unique(rpos, return_inverse=True)[1].tolist()
    p, r = pos.tolist(), rpos.tolist()
    size = max(ranks) + 1
    tree: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    half = gap_cost / 2
    i = 0
    while i < n:
        j = i
        while j < n and p[j] == p[i]:  # matches of one position don't follow each other
            best, at, x = 0.0, -1, ranks[j]
            base = half * (p[j] + r[j])
            while x:
                v, y = tree[x]
                if y >= 0 and (at < 0 or v > best):
                    best, at = v, y
                x -= x & -x
            gain = best - base
            if at >= 0 and gain > 0:
                score[j], before[j] = k + gain, at
            else:
                score[j] = float(k)
            j += 1
        for m in range(i, j):
            v, x = score[m] + half * (p[m] + r[m]), ranks[m] + 1
            while x <= size:
                if tree[x][1] < 0 or v > tree[x][0]:
                    tree[x] = (v, m)
                x += x & -x
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda m: (-score[m], m)):
        path, m = [], end
        while m >= 0 and not used[m]:
            path.append(m)
            used[m] = True
            m = before[m]
        if path:
            out.append(path[::-1])
    return out


PAIR = ["doc", "ref"]


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in grouped(batches, PAIR):
        *pair, pos, rpos = (rows.column(c).to_numpy() for c in (*PAIR, "pos", "rpos"))
        first = bounds(*pair, pos, rpos)[:-1]  # rows of one document that repeat have the same matches
        pair, pos, rpos = [c[first] for c in pair], pos[first], rpos[first]
        at = bounds(*pair)
        out: list[tuple] = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            p, r = pos[lo:hi], rpos[lo:hi]
            if ((p[1:] - p[:-1]) == (r[1:] - r[:-1])).all() and (p[1:] > p[:-1]).all() and int((p[1:] - p[:-1]).max()) * GAP_COST < K:
                found = [range(hi - lo)]  # one diagonal without a break is its own best chain
            else:
                found = chain(p, r)
            for path in found:
                if len(path) > 1:
                    out.append((*(c[lo] for c in pair), p[list(path)], r[list(path)]))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=[*PAIR, "pos", "rpos"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put 32-bit hashes of the words lo..hi in the place of each text; a text that repeats in a row is read once."""
    last, words = None, np.zeros(0, np.int32)
    for batch in batches:
        out, text = [], batch.column(batch.num_columns - 1)
        lo, hi = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("lo", "hi"))
        for k in range(batch.num_rows):
            t = text[k].as_py()
            if t != last:
                data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
                last, words = t, word_hashes(data, starts, ends).astype(np.uint32).view(np.int32)
            out.append(words[max(0, lo[k]) : hi[k]])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "words"])


def _lengths(a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    """The length of a longest common subsequence of a and every prefix of b (0 to all of it).

    A row of the table is held as bits (0 where it grows), in blocks of b's words; what one block's
    rows carry goes on to the next.
    """
    carry, words, rest = [0] * len(a), a.tolist(), []
    for at in range(0, len(b), block):
        part = b[at : at + block].tolist()
        where: dict[int, int] = {}
        for k, x in enumerate(part):
            where[x] = where.get(x, 0) | 1 << k
        n = len(part)
        v = full = (1 << n) - 1
        for i, x in enumerate(words):
            m = where.get(x)
            if m or carry[i]:
                u = v & m if m else 0
                total = v + u + carry[i]
                carry[i] = total >> n
                v = total & full | v - u
        rest.append(np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n])
    return np.concatenate([[0], np.cumsum(1 - np.concatenate(rest).astype(np.int64))])


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each word of a its partner in b in a longest common subsequence, -1 without one; space is linear in both."""
    to = np.full(len(a), -1)
    if not len(a) or not len(b):
        return to
    if len(a) == len(b):
        same = a == b
        if same.all() or len(a) == 1:
            return np.where(same, np.arange(len(a)), -1)
    if len(a) == 1 or len(b) == 1 or len(a) * len(b) <= TABLE:
        return _table(a, b, to)
    half = len(a) // 2
    m = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    for lo, part, by in ((0, _gap(a[:half], b[:m]), 0), (half, _gap(a[half:], b[m:]), m)):
        to[lo : lo + len(part)] = np.where(part >= 0, part + by, -1)
    return to


def _table(a: np.ndarray, b: np.ndarray, to: np.ndarray) -> np.ndarray:
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    equal = a[:, None] == b[None, :]
    for i in range(len(a)):
        row = np.maximum(table[i, 1:], table[i, :-1] + equal[i])
        table[i + 1, 1:] = np.maximum.accumulate(row)
    i, j = len(a), len(b)
    while i and j:
        if equal[i - 1, j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            to[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return to


def _run_on(a: np.ndarray, b: np.ndarray) -> tuple[int, bool]:
    """How far two slices run on from their start, and whether they might beyond their end.

    An equal word counts 1, another -2; the end is the (first) highest sum above 0 before the sum
    falls DROP below it.
    """
    n = min(len(a), len(b))
    if not n:
        return 0, True
    total = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    low = np.flatnonzero(np.maximum(np.maximum.accumulate(total), 0) - total >= DROP)
    seen = total[: low[0]] if len(low) else total
    best = int(seen.argmax())
    return (best + 1 if seen[best] > 0 else 0), not len(low)


def _best(x: np.ndarray, cost: float, least: int) -> tuple[int, int] | None:
    """The stretch of `least` words or more, from a matched word to a matched word, whose matches less cost x misses sum up highest; None unless above 0."""
    n = len(x) - least + 1
    if n < 1:
        return None
    total = np.concatenate([[0.0], np.cumsum(x - cost * (1 - x))])
    start = np.where(x > 0, total[:-1], np.inf)
    gain = np.where(x[least - 1 :] > 0, total[least:], -np.inf) - np.minimum.accumulate(start[:n])
    j = int(gain.argmax())
    return (int(start[: j + 1].argmin()), j + least) if gain[j] > 0 else None


def stretches(x: np.ndarray, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Disjoint stretches with `similarity` or more of their words matched; x: how far each word is matched, 0 to 1.

    So many unmatched words in a row that the words around them hold a passage by themselves part stretches.
    Between them the best-scoring stretch (a miss costs 2, as in `_run_on`) is taken if it is a passage, else the best
    of `min_words` or more at the cost at which a sum above 0 means `similarity`, so that a passage is found
    wherever there is one; then shorter ones, which may be parts of a passage with other documents.
    """
    live = np.flatnonzero(x > 0)
    strict = similarity / max(1 - similarity, 1e-6) * (1 - 1e-9)  # a stretch of just this similarity counts
    gap = min_words * max(1.0, 2 / strict)
    out = []
    todo = [(int(p[0]), int(p[-1]) + 1) for p in np.split(live, np.flatnonzero(np.diff(live) > gap + 1) + 1) if len(p)]
    while todo:
        lo, hi = todo.pop()
        part = x[lo:hi]
        found = _best(part, min(2.0, strict), min_words)
        if not found or part[slice(*found)].sum() < similarity * (found[1] - found[0]) - 1e-9:
            found = _best(part, strict, min_words) or _best(part, strict, K)
        if found:
            out.append((lo + found[0], lo + found[1]))
            todo += [(lo, lo + found[0]), (lo + found[1], hi)]
    return sorted(out)


def align(
    a: np.ndarray, b: np.ndarray, pos: np.ndarray, rpos: np.ndarray, min_words: int = MIN_WORDS, similarity: float = SIMILARITY
) -> tuple[list[tuple[int, int, int, int, int]], bool, bool]:
    """Align two word slices along anchors (offsets into them).

    Returns a's span, b's span and matched words of each stretch that is alike, and whether the
    alignment might run on before and behind the slices. On one diagonal the words are compared in
    place; where the diagonal changes, the gap between two anchors is aligned by a longest common
    subsequence. Ends run on word by word.
    """
    to = np.full(len(a), -1)  # the partner of each word in b

    def compare(lo: int, hi: int, r: int) -> None:
        same = np.flatnonzero(a[lo:hi] == b[r : r + hi - lo])
        to[lo + same] = r + same

    cuts = np.flatnonzero(np.diff(pos) != np.diff(rpos)) + 1
    for run in np.split(np.arange(len(pos)), cuts):
        lo, hi, r = int(pos[run[0]]), int(pos[run[-1]]) + K, int(rpos[run[0]])
        compare(lo, lo + min(hi - lo, len(b) - r), r)
    for c in cuts:
        lo, hi, r0, r1 = int(pos[c - 1]) + K, int(pos[c]), int(rpos[c - 1]) + K, int(rpos[c])
        if hi > lo and r1 > r0:
            part = _gap(a[lo:hi], b[r0:r1])
            to[lo:hi] = np.where(part >= 0, r0 + part, to[lo:hi])
    lo, rlo = int(pos[0]), int(rpos[0])
    n, before = _run_on(a[:lo][::-1], b[:rlo][::-1])
    compare(lo - n, lo, rlo - n)
    lo -= n
    hi, rhi = int(pos[-1]) + K, int(rpos[-1]) + K
    n, behind = _run_on(a[hi:], b[rhi:])
    compare(hi, hi + n, rhi)
    hi += n
    hit = to[lo:hi] >= 0
    good = int(hit.sum())
    if hi - lo - good <= min_words and good >= similarity * (hi - lo):  # alike, and too few misses to part it
        found = [(0, hi - lo)]
    else:
        found = stretches(hit.astype(float), min_words, similarity)
    out = []
    for i, j in found:
        partner = to[lo + i : lo + j]
        partner = partner[partner >= 0]
        out.append((lo + i, lo + j, int(partner.min()), int(partner.max()) + 1, len(partner)))
    return out, before, behind


CHAIN = [*PAIR, "chain"]
ALIGNED = "doc long, ref long, chain long, lo long, hi long, rlo long, rhi long, matched long"


def _align(min_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a chain: its document's side (0, with the anchors), then the earlier document's (1). One that needs more words comes back with matched null."""
        for rows in grouped(batches, CHAIN):
            rows = rows.combine_chunks()
            *keys, side, lo, hi = (rows.column(c).to_numpy() for c in (*CHAIN, "side", "lo", "hi"))
            pos, rpos, words = (rows.column(c).combine_chunks() for c in ("pos", "rpos", "words"))
            at, out = bounds(*keys), []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                other = s + int(np.searchsorted(side[s:e], 1))
                if s < other < e:
                    dlo, rlo = max(0, int(lo[s])), max(0, int(lo[other]))
                    a, b, p, r = (x.values.to_numpy() for x in (words[s], words[other], pos[s], rpos[s]))
                    found, before, behind = align(a, b, p - dlo, r - rlo, min_words, similarity)
                    before &= lo[s] > 0 and lo[other] > 0
                    behind &= len(a) == hi[s] - dlo and len(b) == hi[other] - rlo  # neither text has ended
                    key = tuple(int(c[s]) for c in keys)
                    if before or behind:
                        out.append((*key, 0, 0, 0, 0, None))
                    else:
                        out += [(*key, x[0] + dlo, x[1] + dlo, x[2] + rlo, x[3] + rlo, x[4]) for x in found]
            names = [f.split(" ")[0] for f in ALIGNED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(len(names))], names=names)

    return run


def _merge(min_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["doc"]):
            doc, ref, lo, hi, rlo, rhi, matched = (rows.column(c).to_numpy() for c in ("doc", "ref", "lo", "hi", "rlo", "rhi", "matched"))
            out = []
            at = bounds(doc)
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                order = np.lexsort((ref[s:e], -hi[s:e], lo[s:e])) + s
                parts: list[int] = []
                start = end = 0
                for i in [*order.tolist(), -1]:
                    if i >= 0 and parts and lo[i] <= end + JOIN_GAP:
                        end = max(end, hi[i])
                        parts.append(i)
                        continue
                    if end - start >= min_words:
                        x = np.zeros(end - start)  # overlaps: as matched as the better span's words
                        for j in parts:
                            span = x[lo[j] - start : hi[j] - start]
                            np.maximum(span, matched[j] / (hi[j] - lo[j]), out=span)
                        whole = x.sum() >= similarity * len(x) - 1e-9
                        for f, t in [(0, len(x))] if whole else stretches(x, min_words, similarity):
                            if t - f >= min_words:
                                own = [j for j in parts if lo[j] < start + t and hi[j] > start + f]
                                top = max(own, key=lambda j: (matched[j], -ref[j]))
                                out.append((doc[s], start + f, start + t, ref[top], rlo[top], rhi[top], sorted({int(ref[j]) for j in own}), float(x[f:t].mean())))
                    if i >= 0:
                        parts, start, end = [i], lo[i], hi[i]
            names = ["doc", "start_word", "end_word", "ref", "ref_start_word", "ref_end_word"]
            cols = [pa.array([int(x[c]) for x in out], pa.int64()) for c in range(6)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[6] for x in out], pa.list_(pa.int64())), pa.array([x[7] for x in out], pa.float64())], names=[*names, "refs", "identity"])

    return run


def _aligned(chains: DataFrame, docs: DataFrame, reach: int, min_words: int, similarity: float) -> DataFrame:
    """Chains with the words between `reach` before and behind them, aligned."""
    lo, hi = (lambda c: (F.element_at(c, 1) - reach).alias("lo")), (lambda c: (F.element_at(c, -1) + K + reach).alias("hi"))
    none = F.lit(None).cast("array<int>")
    asked = chains.select(*CHAIN, F.col("doc").alias("_doc"), F.lit(0).alias("side"), lo("pos"), hi("pos"), "pos", "rpos").unionByName(
        chains.select(*CHAIN, F.col("ref").alias("_doc"), F.lit(1).alias("side"), lo("rpos"), hi("rpos"), none.alias("pos"), none.alias("rpos"))
    )
    key = "doc long, ref long, chain long, side int, lo int, hi int, pos array<int>, rpos array<int>"
    cut = asked.join(docs.select(F.col("doc").alias("_doc"), "text"), "_doc").drop("_doc").mapInArrow(_cut, f"{key}, words array<int>")
    return cut.repartition(*CHAIN).sortWithinPartitions(*CHAIN, "side").mapInArrow(_align(min_words, similarity), ALIGNED)


def _passages(docs: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """doc, start_word, end_word, ref, ref_start_word, ref_end_word, refs, identity of documents (doc, text)."""
    every = materialize(seeds(docs), "seeds")
    first = every.groupBy("h").agg(F.min("doc").alias("ref"), F.max("doc").alias("last"), F.expr("min_by(pos, CASE WHEN first THEN doc END)").alias("rpos"))
    shared = materialize(first.where("ref < last").select("h", "ref", "rpos"), "shared")  # so that a hot value's seeds can be split in the join
    matches = every.join(shared, "h").where("doc <> ref").select(*PAIR, "pos", "rpos")
    chains = matches.repartition(*PAIR).sortWithinPartitions(*PAIR, "pos", "rpos").mapInArrow(_chains, "doc long, ref long, pos array<int>, rpos array<int>")
    chains = materialize(chains.withColumn("chain", F.xxhash64(*PAIR, "pos", "rpos")), "chains")
    release(every, shared)
    found, reach = [], REACH
    while True:
        aligned = materialize(_aligned(chains, docs, reach, min_words, similarity), "aligned")
        found.append(aligned.where("matched IS NOT NULL"))
        open_ = aligned.where("matched IS NULL").select(*CHAIN)
        if open_.isEmpty():
            break
        chains, before = materialize(chains.join(open_, CHAIN, "left_semi"), "chains"), chains
        release(before)
        reach *= 8
    release(chains)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    schema = "doc long, start_word long, end_word long, ref long, ref_start_word long, ref_end_word long, refs array<long>, identity double"
    return rows.repartition("doc").sortWithinPartitions("doc").mapInArrow(_merge(min_words, similarity), schema)


def _documents(docs: DataFrame, known: DataFrame | None) -> DataFrame:
    (doc,) = free(docs.columns, "_doc")
    return keyed(docs.select("doc_id", "text"), known, doc).where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), "text")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per passage that an earlier document (smaller doc_id) has too.

    doc_id, start_word, end_word (words of the whole text, end exclusive), ref_doc_id with its span
    (the earlier document that gives most of it), ref_doc_ids (all that give a part), identity. Where
    texts share an id, `text_hash` (xxhash64) tells which text it is; it is null otherwise.
    """
    known = versions(docs)
    found = _passages(_documents(docs, known), min_words, similarity)
    if known is None:
        named = found.withColumn("text_hash", F.lit(None).cast("long"))
    else:
        own = lambda a, b: known.select(F.col("key").alias(a), F.col("doc_id").alias(b), F.col("hash").alias(f"{b}_hash"))
        each = found.withColumn("_n", F.monotonically_increasing_id())
        each = materialize(each, "passages")
        refs = each.select("_n", F.explode("refs").alias("_r")).join(own("_r", "_id"), "_r", "left").groupBy("_n").agg(F.array_sort(F.collect_set(F.coalesce("_id", "_r"))).alias("refs"))
        each = each.drop("refs").join(refs, "_n").join(own("doc", "_doc_id"), "doc", "left").join(own("ref", "_ref_id"), "ref", "left")
        named = each.withColumn("doc", F.coalesce("_doc_id", "doc")).withColumn("ref", F.coalesce("_ref_id", "ref")).withColumn("text_hash", F.col("_doc_id_hash"))
    return named.select(F.col("doc").alias("doc_id"), "start_word", "end_word", F.col("ref").alias("ref_doc_id"), "ref_start_word", "ref_end_word", F.col("refs").alias("ref_doc_ids"), "identity", "text_hash")


def _removed(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans (sorted, disjoint, end exclusive), each with the white space behind it."""
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at : words[lo].start()])
        at = words[hi].start() if hi < len(words) else len(text)
    return "".join([*out, text[at:]])


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the passages that an earlier document has; one of which no word is left goes.

    Every row loses its own text's passages only. All other rows, those without an id or a text too,
    stay as they are. Columns stay; n_chars follows the text.
    """
    doc, cut = free(docs.columns, "_doc", "_spans")
    known = versions(docs)
    spans = F.sort_array(F.collect_list(F.array("start_word", "end_word"))).alias(cut)
    found = _passages(_documents(docs, known), min_words, similarity).groupBy(F.col("doc").alias(doc)).agg(spans)
    found = materialize(found, "passages")  # its size is known then: Spark broadcasts it under its own limit only
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            spans, texts = batch.column(batch.num_columns - 1).to_pylist(), batch.column(at).to_pylist()
            new = [_removed(t, s) if s and t else t for t, s in zip(texts, spans, strict=True)]
            keep = [not s or bool(t and t.strip(SPACE)) for t, s in zip(new, spans, strict=True)]
            cols = [pa.array(new, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([len(t) if s and t is not None else n for t, s, n in zip(new, spans, cols[k].to_pylist(), strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return keyed(docs, known, doc).join(found, doc, "left").select(*names, cut).mapInArrow(run, docs.schema)
