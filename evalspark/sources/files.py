"""File sources: declared rows from CSV and JSON, texts of any encoding, corpora as sentences or paragraphs."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from evalspark.functions import text as T


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of CSV files with a header; quoted cells may hold line ends; NaN is null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    rows = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    floats = (ty.DoubleType, ty.FloatType)
    return rows.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, floats) else F.col(f.name) for f in rows.schema])


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, row variant) of files that are one JSON list of objects; anything else raises."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("v"))
    whole = whole.withColumn("v", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(F.raise_error(F.lit("not a list of objects")).cast("variant")))
    rows = spark.sql("SELECT path, pos AS position, value AS row FROM {whole}, LATERAL variant_explode(v)", whole=whole)
    return rows.where(F.when(F.schema_of_variant("row").startswith("OBJECT"), F.lit(True)).otherwise(F.raise_error(F.lit("not a list of objects")).cast("boolean")))


def decode(raw: bytes) -> str:
    for encoding in ("utf-8", "utf-8-sig", "gbk"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "ignore")


def read_texts(spark: SparkSession, path: str, glob: str = "*.{txt,md,markdown,csv,json}") -> DataFrame:
    """(name: file stem, path, text, sha256) of text files: UTF-8, else GBK, else what UTF-8 can read. Blank files are left out."""

    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        return raw.map(decode)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "path", text("content").alias("text"), F.sha2("content", 256).alias("sha256"))
    return rows.where(T.strip("text") != "")


def sentences(texts: DataFrame, key: str, text: str = "text", least: int = 10) -> DataFrame:
    """(key, position, sentence) of at least ten characters."""
    return _cut(texts, key, text, "[。！？\n]+", "sentence", least)


def paragraphs(texts: DataFrame, key: str, text: str = "text", least: int = 20) -> DataFrame:
    """(key, position, paragraph) of at least twenty characters."""
    return _cut(texts, key, text, "\n{2,}", "paragraph", least)


def _cut(texts: DataFrame, key: str, text: str, pattern: str, name: str, least: int) -> DataFrame:
    parts = texts.select(key, F.posexplode(F.split(text, pattern)).alias("position", "_p"))
    return parts.select(key, "position", T.strip("_p").alias(name)).where(F.length(name) >= least)


#: How blocks of a fixture file's preamble begin, and words only these have.
PREAMBLE_STARTS, PREAMBLE_WORDS = ("#", "---"), ("本文件", "用法", "选材原则", "每段", "每个段落")


def without_preamble(blocks: DataFrame, text: str = "paragraph") -> DataFrame:
    begins = F.lit(False)
    for s in PREAMBLE_STARTS:
        begins = begins | F.col(text).startswith(s)
    return blocks.where(~begins & ~F.col(text).rlike("|".join(map(re.escape, PREAMBLE_WORDS))))


def keyed(rows: DataFrame, keys: list[str], key: str) -> DataFrame:
    """The rows of a key list in its order (column `position`), a key that repeats once; a key without a row is an error when the rows are read."""
    order = list(dict.fromkeys(keys))
    wanted = rows.sparkSession.createDataFrame(list(enumerate(order)), f"position int, {key} {rows.schema[key].dataType.simpleString()}")
    seen = F.when(F.col("_seen"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no rows for "), F.col(key).cast("string"))).cast("boolean"))
    return wanted.join(rows.withColumn("_seen", F.lit(True)), key, "left").where(seen).drop("_seen")


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str | None:
    """Non-blank paragraphs of a DOCX file, a line each; null if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))
    return "\n".join(line for line in lines if line.strip())


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(name: file stem, path, text, sha256) of DOCX files; a file that can't be read has a null text."""

    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        return raw.map(docx_text)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "path", text("content").alias("text"), F.sha2("content", 256).alias("sha256"))


def body_blocks(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Layout blocks (y0, y1, page_height, width, height, text) that are body text: not in the outer 12 % above or below as a header, nor thin and short."""
    from evalspark.operators.corpus import is_header

    margin = (F.col("y1") < 0.12 * F.col("page_height")) | (F.col("y0") > 0.88 * F.col("page_height"))
    density = F.try_divide(F.length(text).cast("double"), F.col("width") * F.col("height"))
    thin = (density < 0.015) & (F.length(text) < 24)
    return blocks.where(~(margin & is_header(F.col(text))) & ~F.coalesce(thin, F.lit(False)))
