"""Helpers that several training-data operators share.

Conventions: a *word* is a run of bytes outside ``\\x20\\x09-\\x0D`` (UTF-8 text, so the byte
rule and the character rule agree); texts are cut into bounded slices before numpy touches
them, so one Arrow batch of long texts never multiplies in memory.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 19  # texts handed to numpy at a time

_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(12).integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir. Local sessions without one get a temporary folder, others an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evalspark-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote, once whatever is made of them is stored itself."""
    for t in tables:
        path = _stored.pop(t, None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def free(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (Spark's names don't tell cases apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass batches on; after the last one give free memory back to the system, since workers outlive their tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about `limit` text bytes: (rows, uint8 data, offsets)."""
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the row it belongs to."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = _NOT_SPACE[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(solid & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (byte value times place weight, summed, mixed)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    total = int(lens.sum())
    place = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
    at = place + np.repeat(starts, lens)
    values = _BYTE[data[at]] * _PLACE[place & 0xFFFF]
    return mix(np.add.reduceat(values, first) + lens.astype(np.uint64))


def arrow_rows(columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    arrays = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From rows sorted by `keys`, yield tables that hold whole groups only (many groups a table)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        for k in keys:
            col = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
            if held:
                last = held[-1].column(batch.schema.get_field_index(k))[held[-1].num_rows - 1].as_py()
                change[0] |= col[0] != last
        cuts = np.flatnonzero(change)
        if held and len(cuts):
            cut = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
            held = [batch.slice(cut)]
        elif len(cuts):
            cut = int(cuts[-1])
            if cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounds(*cols: np.ndarray) -> np.ndarray:
    """First index of each run of equal key tuples, with the length at the end."""
    n = len(cols[0])
    change = np.ones(n, dtype=bool)
    if n:
        change[1:] = False
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)
