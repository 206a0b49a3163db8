"""Shared by the registered queries: table loading and the derived score grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.stored import shared_dir as shared_dir
from evalspark.functions.stored import stored as stored


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents x metrics: label quality, 1 - toxic, and a length score; null where a document has no label."""
    d = docs.select("doc_id", "source", "n_chars").join(labels, "doc_id", "left")
    cell = lambda m, s, t, w: F.struct(F.lit(m).alias("metric"), s.cast("double").alias("score"), F.lit(t).alias("threshold"), F.lit(w).alias("weight"))
    three = F.array(cell("quality", F.col("quality"), 0.5, 2.0), cell("safety", 1 - F.col("toxic"), 0.5, 1.0), cell("length", F.least(F.col("n_chars") / 1000, F.lit(1.0)), 0.3, 1.0))
    return d.select("doc_id", "source", F.explode(three).alias("c")).select("doc_id", "source", "c.*")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score grid of the tables' documents and labels."""
    return cells(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


GRID_SQL = """g AS (
  SELECT d.doc_id, d.source, m.metric, m.threshold, m.weight,
    CASE m.metric WHEN 'quality' THEN CAST(l.quality AS DOUBLE) WHEN 'safety' THEN CAST(1 - l.toxic AS DOUBLE) ELSE least(d.n_chars / 1000, 1.0) END AS score
  FROM documents d LEFT JOIN labels l USING (doc_id)
  CROSS JOIN (VALUES ('quality', 0.5::DOUBLE, 2.0::DOUBLE), ('safety', 0.5, 1.0), ('length', 0.3, 1.0)) m(metric, threshold, weight)
)"""
