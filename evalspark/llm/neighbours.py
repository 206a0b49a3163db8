"""Approximate nearest neighbours by collision counting.

Every vector is projected on `PROJECTIONS` random lines; each line keeps its vectors in a sorted
array. A query opens a window centred on its own projection on every line, and counts how many
lines each vector falls into the window on. Vectors that reach the collision threshold are
verified with their exact distance. Virtual rehashing widens all windows by `RATIO` and counts
only what is new, until the k-th best verified distance is no larger than the radius the windows
stand for, or the windows hold everything. No candidate is capped.

The difference of two projections is Gaussian with the distance as its deviation, so a window of
`WIDTH` radii holds a vector at the radius on 89 % of the lines: it reaches the threshold of 85 % of
96 lines in about 9 of 10 cases, nearer ones more often, and few that are much farther reach it.

In Spark, vectors are dealt by a hash of their id into shards of bounded size. Every vector is sent
once; every query is sent to every shard and streams past it, and the shards' best k are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import bounds

PROJECTIONS, THRESHOLD, WIDTH, RATIO = 96, 0.85, 3.18, 1.05
SHARD, BLOCK = 8192, 1024


class Lines:
    """Sorted projections of one shard of vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 23):
        self.vectors = vectors
        self.axes = np.random.default_rng(seed).normal(size=(vectors.shape[1], PROJECTIONS))
        on = vectors @ self.axes
        self.order = np.argsort(on, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(on, self.order.T.astype(np.int64), 0).T.copy()
        # the first radius: half of what a tenth of some vectors have to their tenth nearest
        some = vectors[:: max(1, len(vectors) // 64)]
        d = np.sqrt(np.maximum(0, (some**2).sum(1)[:, None] + (vectors**2).sum(1)[None] - 2 * some @ vectors.T))
        near = np.partition(d, min(10, d.shape[1] - 1), axis=1)[:, min(10, d.shape[1] - 1)]
        self.unit = float(np.quantile(near, 0.1)) / 2 or 1e-9

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """For each query (own: its place among the vectors or -1): number, places of the best k found, distances, how many were verified."""
        n, least = len(self.vectors), int(np.ceil(THRESHOLD * PROJECTIONS))
        centre = queries @ self.axes
        mid = np.stack([np.searchsorted(self.values[j], centre[:, j]) for j in range(PROJECTIONS)], 1)
        lo, hi = mid.copy(), mid.copy()
        radius = self.unit
        live = np.arange(len(queries))
        counts = np.zeros((len(queries), n), np.uint8)
        verified = np.zeros(len(queries), np.int64)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        while len(live):
            half = WIDTH * radius / 2
            to_lo = np.stack([np.searchsorted(self.values[j], centre[live, j] - half, "left") for j in range(PROJECTIONS)], 1)
            to_hi = np.stack([np.searchsorted(self.values[j], centre[live, j] + half, "right") for j in range(PROJECTIONS)], 1)
            still = []
            for row, q in enumerate(live.tolist()):
                a, b, c, d = to_lo[row].tolist(), lo[q].tolist(), hi[q].tolist(), to_hi[row].tolist()
                new = [self.order[j, s:t] for j in range(PROJECTIONS) for s, t in ((a[j], b[j]), (c[j], d[j])) if t > s]
                lo[q], hi[q] = to_lo[row], to_hi[row]
                if new:
                    before = counts[q] >= least
                    counts[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.uint8)
                    fresh = np.flatnonzero((counts[q] >= least) & ~before)
                    fresh = fresh[fresh != own[q]]
                    verified[q] += len(fresh)
                    if len(fresh):
                        dist = np.sqrt(((self.vectors[fresh] - queries[q]) ** 2).sum(1))
                        at, far = np.concatenate([best[q][0], fresh]), np.concatenate([best[q][1], dist])
                        keep = np.lexsort((at, far))[:k]
                        best[q] = at[keep], far[keep]
                full = (to_lo[row] == 0).all() and (to_hi[row] == n).all()
                if not full and (len(best[q][1]) < k or best[q][1][-1] > radius):
                    still.append(q)
            live = np.array(still, np.int64)
            radius *= RATIO
        for q, (at, far) in enumerate(best):
            yield q, at, far, int(verified[q])


def _shards(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by dim and shard: its vectors (kind 0), which are held, then the queries, which pass by in blocks."""
        key: tuple | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        lines: Lines | None = None
        place: dict[int, int] = {}
        for batch in batches:
            dim, shard, kind, ids = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("dim", "shard", "kind", "vec_id"))
            flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at, first = bounds(dim, shard, kind), np.append(0, np.cumsum(dim))
            out: list[tuple[np.ndarray, ...]] = []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                x = flat[first[s] : first[e]].reshape(e - s, int(dim[s]))
                if key != (dim[s], shard[s]):
                    key, held, lines = (dim[s], shard[s]), [], None
                if not kind[s]:
                    held.append((ids[s:e], x))
                    continue
                if not held:
                    continue
                if lines is None:
                    names = np.concatenate([h[0] for h in held])
                    lines, held = Lines(np.concatenate([h[1] for h in held])), [(names, x[:0])]
                    place = {v: i for i, v in enumerate(names.tolist())}
                for lo in range(0, e - s, BLOCK):
                    block = ids[s + lo : min(e, s + lo + BLOCK)]
                    own = np.array([place.get(v, -1) for v in block.tolist()])
                    for q, near, dist, _ in lines.search(x[lo : lo + BLOCK], own, k):
                        out.append((np.full(len(near), block[q]), held[0][0][near], dist))
            cols = [np.concatenate(c) if out else np.zeros(0) for c in (zip(*out, strict=True) if out else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: not null, not zero, only finite components."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(finite & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """The k nearest found of each query (Euclidean): query_id, rank, vec_id, score.

    Both inputs have vec_id and embedding. A query's own vec_id is no candidate; ties go to the
    smaller vec_id; vectors meet only those of their own length. Of rows that share a vec_id the
    least vector (by its components) counts. Null ids and unusable vectors take no part; extra
    columns are ignored; an empty table gives none.
    """
    one = lambda df: usable(df).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = max(1, -(-vectors.count() // shard))  # of all rows: read off the files' footers
    size = F.size("v").cast("long").alias("dim")
    data = one(vectors).select(size, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = one(queries).select(size, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    rows = data.unionByName(asked).repartition(max(shards, 2), "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "vec_id")
    found = rows.mapInArrow(_shards(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
