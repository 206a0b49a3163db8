"""Stored datasets in versions: a manifest lists a version's files, with each file's least and greatest key and its rows.

A merge rewrites the files only that its keys fall into, and lists the others again as they are. A
version exists once its manifest does, and a manifest is made only where there is none: readers see one
version or the next, and of two writers at a time the later one begins again on what the earlier
left. Files of a version don't overlap, so a page is found by the manifest's counts, without reading what
comes before it.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from evalspark.functions.stored import release, stored
from evalspark.operators.lifecycle import upsert

ROWS = 1_000_000  # of a file, about


@dataclass(frozen=True)
class File:
    """A file of a version. `least` and `most` are keys as texts; null keys come first of all."""

    path: str
    least: str | None
    most: str | None
    rows: int


def rank_among(value: Column, sorted_: list, kind: ty.DataType) -> Column:
    """How many of the sorted values are no greater; null: none. Two steps of the root of their number each."""
    step = max(1, math.isqrt(len(sorted_)))
    lits = lambda xs: F.array(*[F.lit(x).cast(kind) for x in xs]).cast(ty.ArrayType(kind))
    below = lambda xs: F.size(F.filter(xs, lambda q: q <= value))
    coarse = step * below(lits(sorted_[step - 1 :: step]))
    return F.when(value.isNull(), 0).otherwise(coarse + below(F.slice(lits(sorted_), coarse + 1, step))).cast("int")


@dataclass(frozen=True)
class Dataset:
    """A dataset under `path`, a folder all readers share. `key` names a row; rows lie by its first column."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    rows_per_file: int = ROWS

    # ------------------------------------------------------------ versions

    def _fs(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        at, fs = self._fs("manifests")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(at)) if fs.exists(at) else []

    def files(self, version: int | None = None) -> tuple[list[File], ty.StructType]:
        """A version's files in the order of their keys, and its schema; of the last one, unless told."""
        known = self.versions()
        number = version if version is not None else known[-1] if known else None
        if number is None or number not in known:
            raise ValueError(f"no version {version} in {self.path}")
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{number:09d}.json").collect())  # a manifest
        told = json.loads(text)
        return [File(**f) for f in told["files"]], ty.StructType.fromJson(told["schema"])

    def _commit(self, number: int, files: list[File], schema: ty.StructType) -> bool:
        at, fs = self._fs(f"manifests/{number:09d}.json")
        try:
            out = fs.create(at, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps({"files": [vars(f) for f in files], "schema": schema.jsonValue()}).encode()))
        out.close()
        return True

    def read(self, version: int | None = None) -> DataFrame:
        """One version, whole: later merges don't change what is read."""
        files, schema = self.files(version)
        return self._open([f.path for f in files], schema)

    def _open(self, paths: list[str], schema: ty.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    # ------------------------------------------------------------ merges

    def _write(self, rows: DataFrame, slot: Column, n: int) -> list[File]:
        """Files of rows, none with rows of two slots, each with its keys' range; slots' files follow each other in key order."""
        by, folder = self.key[0], uuid.uuid4().hex
        dealt = rows.withColumn("_slot", slot).repartitionByRange(max(1, n), "_slot", F.col(by).asc_nulls_first()).sortWithinPartitions("_slot", F.col(by).asc_nulls_first(), *self.key[1:])
        dealt.write.partitionBy("_slot").parquet(f"{self.path}/data/{folder}")
        there = self.spark.read.schema(ty.StructType([*rows.schema, ty.StructField("_slot", ty.IntegerType())])).parquet(f"{self.path}/data/{folder}")
        name = F.regexp_extract(F.input_file_name(), f"({folder}/.*)$", 1)
        text = lambda c: c.cast("string")
        found = there.groupBy(name.alias("path")).agg(text(F.min(by)).alias("least"), text(F.max(by)).alias("most"), F.count("*").alias("rows"), (F.count("*") > F.count(by)).alias("nulls"))
        return [File(r.path, None if r.nulls else r.least, r.most, r.rows) for r in found.collect()]  # a row a file

    def _ordered(self, files: list[File], schema: ty.StructType) -> list[File]:
        kind = schema[self.key[0]].dataType
        value = int if isinstance(kind, ty.IntegralType) else float if isinstance(kind, ty.FractionalType) else str
        place = lambda x: (x is not None, value(x) if x is not None else value())
        return sorted(files, key=lambda f: (place(f.least), place(f.most)))

    def merge(self, batch: DataFrame, update: bool = True, order: list[Column] | None = None) -> int:
        """The next version: its number. With `update` rows of the batch take the place of those they name, else known keys stay.

        Of a key that the batch holds more than once the last row by `order` counts, without `update`
        the first. A null key is a key. An empty batch makes a version too. Rows that share the first
        key column lie in one file, so the files of a version never overlap.
        """
        batch = stored(batch, "batch")
        while True:
            known = self.versions()
            number = known[-1] + 1 if known else 1
            files, schema = self.files(known[-1]) if known else ([], batch.schema)
            kind = schema[self.key[0]].dataType
            ordered = self._ordered(files, schema)
            mins = [f.least for f in ordered[1:]]
            slot = rank_among(F.col(self.key[0]), mins, kind) if mins else F.lit(0)
            touched = sorted(r.s for r in batch.select(slot.alias("s")).distinct().collect()) if ordered else [0]  # a row a file at most
            old = self._open([ordered[s].path for s in touched] if ordered else [], schema)
            merged = upsert(old, batch.select(*schema.names), list(self.key), update, order)
            expected = sum(ordered[s].rows for s in touched) if ordered else 0
            n = -(-(expected + batch.count()) // self.rows_per_file)
            made = self._write(merged, slot, n) if touched else []
            if self._commit(number, self._ordered([f for i, f in enumerate(ordered) if i not in set(touched)] + made, schema), schema):
                release(batch)
                return number

    # ------------------------------------------------------------ pages

    def page(self, size: int, offset: int = 0, version: int | None = None) -> DataFrame:
        """Rows `offset` to `offset + size` in key order: the files that hold them are told by the manifest's counts, others aren't opened."""
        files, schema = self.files(version)
        files = self._ordered(files, schema)
        before, chosen, skip = 0, [], 0
        for f in files:
            if before + f.rows > offset and before < offset + size:
                if not chosen:
                    skip = offset - before
                chosen.append(f.path)
            before += f.rows
        order = [F.col(self.key[0]).asc_nulls_first(), *self.key[1:]]
        return self._open(chosen, schema).orderBy(*order).offset(skip).limit(size)

    def after(self, last: object, size: int, version: int | None = None) -> DataFrame:
        """The `size` rows behind a key (its first column): for paging on from a row, however deep."""
        files, schema = self.files(version)
        kind = schema[self.key[0]].dataType
        value = int if isinstance(kind, ty.IntegralType) else float if isinstance(kind, ty.FractionalType) else str
        chosen, rows = [], 0
        for f in self._ordered(files, schema):
            if f.most is not None and value(f.most) > last and rows < size:
                chosen.append(f.path)
                rows += f.rows if f.least is not None and value(f.least) > last else 0
        return self._open(chosen, schema).where(F.col(self.key[0]) > F.lit(last)).orderBy(*self.key).limit(size)
