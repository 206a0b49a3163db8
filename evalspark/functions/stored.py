"""Intermediate tables in the folder that driver and executors share, and small sets handed to every task."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

MOST = 1 << 22  # 64-bit numbers that a task may be handed: 32 MB


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local sessions without one a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or tempfile.mkdtemp(prefix="evalspark-")).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: for a table that a plan reads several times."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote, once what is made of them is stored itself."""
    for t in tables:
        path = _paths.pop(t, None)
        if path:
            _delete(t.sparkSession, path)


def handed(numbers: DataFrame, most: int = MOST) -> Broadcast | None:
    """The distinct numbers (one long column) as a sorted array for every task, if there are no more than `most`; None beyond, where a join has to do."""
    (name,) = numbers.columns
    found = numbers.where(f"`{name}` IS NOT NULL").distinct().limit(most + 1).toPandas()[name].to_numpy(np.int64)
    return numbers.sparkSession.sparkContext.broadcast(np.sort(found)) if len(found) <= most else None


def among(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(wanted):
        return np.zeros(len(x), bool)
    return wanted[np.searchsorted(wanted, x).clip(0, len(wanted) - 1)] == x
