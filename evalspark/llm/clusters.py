"""Centroid clustering in whole numbers, each vector's nearest centroid found by annulus search.

A centroid at distance d or less from a vector has a norm within d of the vector's norm. Centroids
are sorted by norm; the distance to the centroid of the nearest norm bounds the search, two binary
searches give the centroids inside the annulus, and only those are compared, exactly, so that ties
on the annulus' edge are settled by number. Distances and sums are whole numbers: results don't
depend on how rows are dealt, and a task that is lost is repeated to the same result. A round is
one pass that keeps nothing but k sums of each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import materialize

BLOCK = 4096  # vectors a step of numpy works on
LIMIT = 2**26  # magnitude of a whole component from which squared distances might leave 64 bits


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64; x is double."""
    v = np.floor(x * scale)
    if len(v) and (np.abs(v) >= LIMIT).any():
        raise OverflowError(f"components of {LIMIT / scale:g} and more have no squared distance in 64 bits")
    return v.astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Annuli:
    """Centroids sorted by norm. `nearest` is exact: (number, squared distance) of the nearest, ties to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.number], centroids[self.number]
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, dist = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for lo in range(0, len(x), BLOCK):
            best[lo : lo + BLOCK], dist[lo : lo + BLOCK] = self._block(x[lo : lo + BLOCK])
        return best, dist

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm, k = np.sqrt((x.astype(np.float64) ** 2).sum(1)), len(self.norms)
        right = np.searchsorted(self.norms, norm).clip(0, k - 1)
        left = (right - 1).clip(0)
        near = np.where(norm - self.norms[left] < self.norms[right] - norm, left, right)
        dist, best = squared(x, self.centroids[near]), self.number[near].copy()
        bound = np.sqrt(dist.astype(np.float64))
        slack = 1e-9 * (norm + bound + 1)  # the roots are rounded; a wider annulus costs comparisons, never results
        lo = np.searchsorted(self.norms, norm - bound - slack, "left")
        hi = np.searchsorted(self.norms, norm + bound + slack, "right")
        self.compared += int((hi - lo).sum())
        for j in range(k):
            rows = np.flatnonzero((lo <= j) & (j < hi) & (near != j))
            d, number = squared(x[rows], self.centroids[j]), self.number[j]
            better = (d < dist[rows]) | ((d == dist[rows]) & (number < best[rows]))
            dist[rows[better]], best[rows[better]] = d[better], number
        return best, dist


def matrix(batch: pa.RecordBatch, column: str, dim: int, scale: int) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(column))
    return whole(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dim), scale)


def usable(column: str | Column, dim: int) -> Column:
    """Exactly `dim` components, none null, infinite or NaN; a null vector isn't usable."""
    c = F.col(column) if isinstance(column, str) else column
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == dim) & ok, F.lit(False))


def _sums(centroids: np.ndarray, dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Annuli(centroids), len(centroids)
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                x = matrix(batch.slice(lo, BLOCK), "v", dim, scale)
                best, _ = search.nearest(x)
                counts += np.bincount(best, minlength=k)
                order = np.argsort(best, kind="stable")
                there, first = np.unique(best[order], return_index=True)
                sums[there] += np.add.reduceat(x[order], first, axis=0)
        there = np.flatnonzero(counts)
        if len(there):
            cells = [pa.array(np.repeat(there, dim)), pa.array(np.tile(np.arange(dim), len(there))), pa.array(sums[there].ravel()), pa.array(np.repeat(counts[there], dim))]
            yield pa.RecordBatch.from_arrays(cells, names=["cluster", "pos", "total", "n"])

    return run


def _assigned(centroids: np.ndarray, columns: list[str], dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(centroids)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                best, dist = search.nearest(matrix(part, "v", dim, scale))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), pa.array(dist)], names=columns)

    return run


def starts(kept: DataFrame, k: int, seed: int, dim: int, scale: int) -> np.ndarray:
    """The k vectors of the smallest hash of seed and id (equal ids: of the smallest components): each task keeps k rows."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return whole(np.array([r.v for r in rows], np.float64).reshape(len(rows), dim), scale)


def annulus_kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid array<long>) of every usable vector.

    A component x counts as floor(scale * x), x as double. Vectors that are null, of another length,
    or hold null or non-finite components take no part; repeated rows count each; a null id hashes
    as an empty one. With fewer than k usable vectors each of them starts a centroid; a centroid
    without vectors stays where it is; an empty table gives none. Extra columns are ignored.
    Components whose whole number reaches 2^26 are an error that says so. What reaches the driver
    are k starts, and a round's k x dim sums, never rows.
    """
    kept = vectors.where(usable(column, dim)).select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    centroids = starts(kept, k, seed, dim, scale)
    for _ in range(rounds if len(centroids) else 0):
        cells = kept.select("v").mapInArrow(_sums(centroids, dim, scale), "cluster long, pos long, total long, n long")
        # whole-number floor division: Spark's `div` cuts towards zero
        floor = F.expr("(t - pmod(t, c)) div c")
        means = cells.groupBy("cluster", "pos").agg(F.sum("total").alias("t"), F.sum("n").alias("c")).select("cluster", "pos", floor.alias("mean"))
        centroids = centroids.copy()
        for cluster, pos, mean in means.collect():  # at most k x dim
            centroids[cluster, pos] = mean
    spark = vectors.sparkSession
    found = materialize(kept.mapInArrow(_assigned(centroids, ["vec_id", "cluster", "distance"], dim, scale), "vec_id long, cluster int, distance long"), "clusters")
    per = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k
    rows = [(c, per.get(c, 0), sum(per.values()), v) for c, v in enumerate(centroids.tolist())]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
