"""The corpus pipeline: toxicity filter, near-duplicates, repeated passages, secrets, packing.

Each stage works on the table its predecessor wrote; all but the last return the columns of
`documents`, extra ones of any name as they are. An empty table stays empty in every stage, texts
of any length are read whole, and rows are judged by their own text: rows that repeat, share an id,
or have none, are defined below. SQL can't express the pipeline: the tests hold it against brute
force, and every stage against odd tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import packing, secrets, simhash, substring, toxicity
from evalspark.llm.common import load, materialize


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that score toxic go. Null and empty texts stay; repeated rows and null ids are judged by their text."""
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near copies the document of the smallest id stays, with all of its rows in the group.

    Null texts and texts without a word are one group: copies of each other. Rows without an id stay.
    """
    return simhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: passages that an earlier document has are cut out; a document of which no word is left goes.

    Rows that share id and text are one document and keep their passages together; null texts,
    rows without an id and texts under five words stay as they are.
    """
    return substring.remove_passages(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every secret is replaced by a mark. No row goes; null texts stay null, repeated rows and null ids like any other."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: what is left is packed into sequences. Null and empty texts are an end id alone; repeated rows and null ids are packed like any other."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", clean), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("secrets", redact_secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
