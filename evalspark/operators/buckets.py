"""Results and rows that lie in buckets by their row: joins and groupings by row need no shuffle.

A run's results are written once and compared with many others; dealt into buckets when they are
written, each comparison reads bucket by bucket. Tables that are joined should have the same number
of buckets (or one a multiple of the other).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

BUCKETS = 256


def bucketed(rows: DataFrame, table: str, path: str, key: str = "row_id", buckets: int = BUCKETS) -> DataFrame:
    """Write rows as a table of buckets by `key`, a file a bucket, and give it back. Null keys share a bucket."""
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)
    return rows.sparkSession.table(table)


def with_rows(results: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Results with the dataset row each of them is of; a result whose row is gone stays, without one. Columns of both names are the result's."""
    own = [c for c in rows.columns if c == key or c not in results.columns]
    return results.join(rows.select(*own), key, "left")
