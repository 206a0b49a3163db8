"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: 64 bits, a bit is 1 where more than half of a text's 4-word shingle hashes
(XXH64, seed 42, repeats counted) have it set. Distinct fingerprints are joined with themselves:
64 bits are six blocks, and two fingerprints at most four bits apart agree on at least two whole
blocks, so the fifteen pairs of blocks deal the trie into subtrees that need never meet. In each
subtree the two-sided walk runs over a path-compressed binary trie: node pairs are visited
together, differing bits accumulate, and a pair is cut off when the budget is exceeded or when
both nodes already lie in one component. Only a spanning forest of links leaves a subtree, so a
dense group of n copies yields at most n - 1 links. A subtree with more than `limit` members is
dealt out as pairs of hashed chunks, each pair one bounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import bounds, free, grouped, materialize
from evalspark.llm.components import components

SEED = 42
BITS = 4
#: Starts of the six blocks, low bit first, and the end.
BLOCKS = (0, 11, 22, 33, 44, 54, 64)
LIMIT = 4096


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of one whole text; null and texts without a word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[width - 1 :].tolist() if len(words) >= width else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 15):
        part = np.ascontiguousarray(hashes[lo : lo + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > n).astype(np.uint64)).sum()) if (2 * counts > n).any() else 0


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp long): fp is the unsigned 64-bit fingerprint held in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def trie_links(values: list[int], bits: int = BITS) -> list[tuple[int, int]]:
    """Spanning links (positions) between sorted distinct values at most `bits` bits apart."""
    n = len(values)
    parent = list(range(n))
    one: set[tuple[int, int]] = set()  # nodes whose members are one component
    links: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def split(lo: int, hi: int) -> int:
        """A node is a range of the sorted values; its children part at its highest differing bit."""
        top = (values[lo] ^ values[hi - 1]).bit_length() - 1
        border = (values[lo] >> top | 1) << top
        a, b = lo, hi
        while a < b:
            m = (a + b) // 2
            if values[m] < border:
                a = m + 1
            else:
                b = m
        return a

    def whole(lo: int, hi: int) -> bool:
        return hi - lo == 1 or (lo, hi) in one

    def pair(alo: int, ahi: int, blo: int, bhi: int) -> None:
        stack = [(alo, ahi, blo, bhi)]
        while stack:
            alo, ahi, blo, bhi = stack.pop()
            if whole(alo, ahi) and whole(blo, bhi) and find(alo) == find(blo):
                continue
            x, y = values[alo], values[blo]
            top = max((x ^ values[ahi - 1]).bit_length(), (y ^ values[bhi - 1]).bit_length())
            if ((x ^ y) >> top).bit_count() > bits:
                continue
            if not top:
                if (i := find(alo)) != (j := find(blo)):
                    parent[max(i, j)] = min(i, j)
                    links.append((alo, blo))
                continue
            if (x ^ values[ahi - 1]).bit_length() == top:
                m = split(alo, ahi)
                stack += [(alo, m, blo, bhi), (m, ahi, blo, bhi)]
            else:
                m = split(blo, bhi)
                stack += [(alo, ahi, blo, m), (alo, ahi, m, bhi)]

    def within(lo: int, hi: int) -> None:
        if hi - lo < 2:
            return
        m = split(lo, hi)
        within(lo, m)
        within(m, hi)
        pair(lo, m, m, hi)
        if whole(lo, m) and whole(m, hi) and find(lo) == find(m):
            one.add((lo, hi))

    within(0, n)
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in grouped(batches, ["deal", "key", "cell"]):
        deal, key, cell = (rows.column(k).to_numpy() for k in ("deal", "key", "cell"))
        fp, rep = rows.column("fp").to_numpy().view(np.uint64), rows.column("rep").to_numpy()
        at = bounds(deal, key, cell)
        out: list[tuple[int, int]] = []
        for g in np.flatnonzero(np.diff(at) > 1):
            part = slice(at[g], at[g + 1])
            order = np.argsort(fp[part])
            ids = rep[part][order]
            out += [(int(ids[i]), int(ids[j])) for i, j in trie_links(fp[part][order].tolist())]
        a = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def link(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """distinct: (fp, rep), one row a fingerprint and its name. Returns links (a, b) between names that span every component."""
    mask = [F.lit((1 << (hi - lo)) - 1) for lo, hi in zip(BLOCKS, BLOCKS[1:], strict=False)]
    part = [F.shiftrightunsigned("fp", lo).bitwiseAND(m) for lo, m in zip(BLOCKS, mask, strict=False)]
    keys = [F.struct(F.lit(k).alias("deal"), (F.shiftleft(part[i], 11) + part[j]).cast("int").alias("key")) for k, (i, j) in enumerate(combinations(range(6), 2))]
    dealt = distinct.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("k.deal", "k.key", "fp", "rep")
    large = dealt.groupBy("deal", "key").count().where(F.col("count") > limit).select("deal", "key", F.ceil(F.col("count") / limit).alias("parts"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("other")
    cells = dealt.join(large, ["deal", "key"], "left").select("deal", "key", "fp", "rep", "parts", mine.alias("mine"), other)
    cells = cells.select("deal", "key", "fp", "rep", F.coalesce(F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other"), F.lit(0).cast("long")).alias("cell"))
    return cells.repartition("deal", "key", "cell").sortWithinPartitions("deal", "key", "cell").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, text_hash, fp, component_id (smallest doc_id reachable, itself included).

    Null and empty texts have fingerprint 0 and are linked like any other. Every row is linked by its
    own text, so rows that share a doc_id but not their text may lie in different components. Rows
    with a null doc_id are left out. Extra columns are ignored; an empty table gives none.
    """
    fps = materialize(fingerprints(docs.where(F.col("doc_id").isNotNull())), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = materialize(components(link(distinct.select("fp", F.col("fp").alias("rep")))), "components")
    named = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without the near copies: of each component the smallest doc_id stays, with all of its rows in it.

    Rows that share a doc_id are judged by their own texts; rows with a null doc_id stay. Columns stay.
    """
    doc, own = free(docs.columns, "_doc", "_hash")
    gone = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(own)).distinct()
    keyed = docs.withColumn(own, F.xxhash64("text")).withColumn(doc, F.col("doc_id").cast("long"))
    return keyed.join(gone, [doc, own], "left_anti").select(*docs.columns)
