"""Connected components by alternating large-star and small-star rounds on an edge table.

Every round is two group-by-minimum joins over the edges that are left, so no component, link
list or label table is ever gathered in one task or on the driver; only the change count is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. Large star links larger neighbours to the smallest neighbour, small star the smaller ones."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without a link are absent.

    Nulls and self links are dropped. Rounds until the edge set is a set of stars (O(log n)).
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = materialize(edges, "edges")
    mark = None
    while True:
        edges, before = materialize(_star(_star(edges, True), False), "edges"), edges
        release(before)
        n, total, check = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if (n, total, check) == mark or not n:
            break
        mark = (n, total, check)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
