"""Runs that can be stopped, run out of time, and are taken up where they were left.

A run's work is a table of requests. Each task asks for a bounded number of rows and writes its
answers as a file of its own; the file counts as soon as the task has ended, whatever becomes of
the job. A run is stopped by a row in a table of orders, which the driver watches while the run's
jobs go on under a job group of their own; its deadline travels with the requests into the tasks.
What was answered stays. The next attempt asks only for rows without an answer.
"""

from __future__ import annotations

import functools
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from evalspark.operators.judge import Provider

#: What becomes of a row, and of a run.
DONE, ERROR, TIMEOUT, CANCELLED, PENDING, FAILED, RUNNING, COMPLETED = "done", "error", "timeout", "cancelled", "pending", "failed", "running", "completed"
FILES = "path string NOT NULL, modificationTime timestamp NOT NULL, length long NOT NULL, content binary"
JOB_SECONDS, CALL_SECONDS = 900.0, 120.0
ANSWER = "answer string, error string, status string, attempt int, asked_at timestamp"


def _micros() -> int:
    return time.time_ns() // 1000


def _name(run: str) -> str:
    """A run's name as a folder's."""
    return f"r{run.encode().hex()}"


def _seen(spark: SparkSession, path: str, schema: str | ty.StructType, kind: str) -> DataFrame:
    """A table of files that may not exist yet."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)
    try:
        return reader.format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Store:
    """Answers, events and orders of runs in files under `path`, a folder that driver and executors share. `key`: the columns (and their types) that name a row of a run, such as side and row_id."""

    path: str
    key: str = "side string, row_id long"
    requests: str = "request"

    @property
    def names(self) -> list[str]:
        return [f.name for f in ty.StructType.fromDDL(self.key)]

    @property
    def schema(self) -> str:
        return f"run string, {self.key}, {ANSWER}"

    def stop(self, spark: SparkSession, run: str, reason: str = "") -> None:
        """Tell a run to stop: whoever executes it sees the order, and nobody begins it, until it's allowed again."""
        self._mark(spark, f"orders/{_name(run)}/{_micros()}-stop", reason)

    def allow(self, spark: SparkSession, run: str) -> None:
        """Stops until now are past."""
        self._mark(spark, f"orders/{_name(run)}/{_micros()}-go")

    def told_to_stop(self, spark: SparkSession, run: str) -> bool:
        """Whether the run's last order is to stop. The driver looks at names only: no task has to wait for the run's own tasks."""
        return max(self._marks(spark, f"orders/{_name(run)}"), default="go").endswith("stop")

    def note(self, spark: SparkSession, run: str, attempt: int, event: str) -> None:
        self._mark(spark, f"events/{_name(run)}/{attempt:09d}-{_micros()}-{event}")

    def claim(self, spark: SparkSession, run: str) -> int:
        """The next attempt's number, from 1: nobody else can have it, since its file is made only where there is none."""
        number = 1 + max(map(int, self._marks(spark, f"claims/{_name(run)}")), default=0)
        while not self._mark(spark, f"claims/{_name(run)}/{number:09d}"):
            number += 1
        return number

    def events(self, spark: SparkSession) -> DataFrame:
        """(run, attempt, event, ts): each attempt's beginning and end. An attempt without an end is under way, or its driver is lost."""
        run, part = F.decode(F.unhex(F.substring(F.element_at("_p", -2), 2, 1 << 30)), "utf-8"), F.split(F.element_at("_p", -1), "-")
        rows = _seen(spark, f"{self.path}/events", FILES, "binaryFile").select(F.split("path", "/").alias("_p"))
        return rows.select(run.alias("run"), part[0].cast("int").alias("attempt"), part[2].alias("event"), F.timestamp_micros(part[1].cast("long")).alias("ts"))

    def orders(self, spark: SparkSession) -> DataFrame:
        """(run, go, reason, ts): every order to stop, and every permission to go on."""
        run, part = F.decode(F.unhex(F.substring(F.element_at("_p", -2), 2, 1 << 30)), "utf-8"), F.split(F.element_at("_p", -1), "-")
        rows = _seen(spark, f"{self.path}/orders", FILES, "binaryFile").select(F.split("path", "/").alias("_p"), F.rtrim(F.decode("content", "utf-8"), F.lit("\n")).alias("reason"))
        return rows.select(run.alias("run"), (part[1] == "go").alias("go"), "reason", F.timestamp_micros(part[0].cast("long")).alias("ts"))

    def _files(self, spark: SparkSession, name: str):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _mark(self, spark: SparkSession, name: str, text: str = "") -> bool:
        """Make a small file; False if it's there already."""
        at, fs = self._files(spark, name)
        try:
            out = fs.create(at, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(f"{text}\n".encode()))  # empty files are skipped when they are read
        out.close()
        return True

    def _marks(self, spark: SparkSession, name: str) -> list[str]:
        at, fs = self._files(spark, name)
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def results(self, spark: SparkSession) -> DataFrame:
        """One answer a row: a done one before others, of those the earliest. Two attempts that ran at the same time thus count once."""
        rows = _seen(spark, f"{self.path}/results", self.schema, "parquet")
        rest = [f.name for f in ty.StructType.fromDDL(ANSWER)]
        rank = F.struct(F.col("status") != DONE, F.col("status") != ERROR, "attempt", "asked_at", "answer", "error")
        return rows.groupBy("run", *self.names).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select("run", *self.names, "_r.*")

    def arriving(self, spark: SparkSession) -> DataFrame:
        """The answers as a stream, as tasks end: for progress and for heartbeats. Rows come as they were written, at least once."""
        return spark.readStream.schema(self.schema).option("recursiveFileLookup", True).parquet(f"{self.path}/results")

    def left(self, work: DataFrame, run: str, again: tuple[str, ...] = (TIMEOUT,)) -> DataFrame:
        """The run's work that has no answer yet, or one of a status in `again`. Rows that share a key are one row's work: one of them is asked."""
        spark = work.sparkSession
        had = self.results(spark).where((F.col("run") == run) & ~F.col("status").isin(*again)).select(*self.names)
        once = work.groupBy(*self.names).agg(F.min(self.requests).alias(self.requests))
        keys = had.select(*[F.col(n).alias(f"_{n}") for n in self.names])
        same = functools.reduce(lambda a, b: a & b, [once[n].eqNullSafe(keys[f"_{n}"]) for n in self.names])
        return once.join(keys, same, "left_anti")

    def outcome(self, work: DataFrame, run: str) -> DataFrame:
        """Every row of the run's work with its answer; rows without one have the status of what ended the run, or are pending."""
        spark = work.sparkSession
        last = self.events(spark).where(F.col("run") == run).agg(F.max_by("event", F.struct("attempt", "ts")).alias("_event"))  # one row
        keys = work.select(*self.names).distinct()
        own = self.results(spark).where(F.col("run") == run).drop("run").select(*[F.col(c).alias(f"_{c}") for c in (*self.names, "answer", "error", "status", "attempt", "asked_at")])
        same = functools.reduce(lambda a, b: a & b, [keys[n].eqNullSafe(own[f"_{n}"]) for n in self.names])
        ended = F.when(F.col("_event").isin(CANCELLED, TIMEOUT, FAILED), F.col("_event")).otherwise(PENDING)
        found = keys.join(own, same, "left").crossJoin(F.broadcast(last))
        rest = [F.col(f"_{c}").alias(c) for c in ("answer", "error", "attempt", "asked_at")]
        return found.select(F.lit(run).alias("run"), *self.names, F.coalesce("_status", ended).alias("status"), *rest)


@dataclass(frozen=True)
class Limits:
    """Seconds of a run and of one call, rows of a call and of a task. A task's rows are what a lost executor, or a stop, can cost."""

    job: float = JOB_SECONDS
    call: float = CALL_SECONDS
    batch: int = 64
    per_task: int = 512
    poll: float = 1.0


def within(seconds: float, call: Callable[[], list[str]]) -> list[str]:
    """The call's value, or TimeoutError after so many seconds; a call that hangs is left behind."""
    said: list = []

    def run() -> None:
        try:
            said.append((True, call()))
        except Exception as e:  # told to the caller
            said.append((False, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(max(0.0, seconds))
    if not said:
        raise TimeoutError(f"no answer within {seconds:.0f} s")
    fine, value = said[0]
    if not fine:
        raise value
    return value


def asked(work: DataFrame, store: Store, run: str, attempt: int, task: str, provider: Provider, limits: Limits, until: float, slow=None) -> DataFrame:
    """Answers of the work's requests, with what became of them. Rows whose turn comes after `until` (seconds since 1970) aren't asked and get no row.

    A call that fails gives its rows an error, one that takes too long a timeout, and ends its task;
    `slow`, an accumulator, tells the driver. Null requests are errors and aren't sent.
    """
    names = store.names
    keys = ty.StructType.fromDDL(store.key)
    rows = work.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in keys], F.col(store.requests).alias("_request"))

    def call(part: pa.RecordBatch) -> tuple[list, list, list]:
        requests = part.column(len(names)).to_pylist()
        sent = [r for r in requests if r is not None]
        left = min(limits.call, until - time.time())
        try:
            said = iter(within(left, lambda: provider.answer(task, sent)) if sent else [])
            answers = [None if r is None else next(said) for r in requests]
            return answers, ["no request" if r is None else None for r in requests], [ERROR if r is None else DONE for r in requests]
        except TimeoutError as e:
            return [None] * len(requests), [str(e)] * len(requests), [TIMEOUT] * len(requests)
        except Exception as e:
            return [None] * len(requests), [f"{type(e).__name__}: {e}"[:800]] * len(requests), [ERROR] * len(requests)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, limits.batch):
                if time.time() >= until:
                    return
                part = whole.slice(lo, limits.batch)
                answers, errors, states = call(part)
                n, now = part.num_rows, pa.scalar(datetime.now(timezone.utc), pa.timestamp("us", "UTC"))
                stamps = [pa.array([attempt] * n, pa.int32()), pa.array([now.as_py()] * n, pa.timestamp("us", "UTC"))]
                columns = [pa.array([run] * n, pa.string()), *part.columns[: len(names)], *(pa.array(x, pa.string()) for x in (answers, errors, states)), *stamps]
                yield pa.RecordBatch.from_arrays(columns, names=["run", *names, "answer", "error", "status", "attempt", "asked_at"])
                if TIMEOUT in states:
                    if slow is not None:
                        slow.add(1)
                    return

    return rows.mapInArrow(ask, store.schema)


@dataclass
class Running:
    """A run under way. `wait` gives its end: completed, cancelled, timeout or failed."""

    run: str
    attempt: int
    group: str
    cancel: Callable[[], None]
    status: str = RUNNING
    error: BaseException | None = None
    _threads: list[threading.Thread] = field(default_factory=list)

    def wait(self, seconds: float | None = None) -> str:
        for t in self._threads:
            t.join(seconds)
        return self.status


def start(work: DataFrame, store: Store, run: str, task: str, provider: Provider, limits: Limits = Limits(), again: tuple[str, ...] = (TIMEOUT,), seconds_left: float | None = None) -> Running:
    """Begin (or take up) a run: ask for what the store lacks of its work, until it's done, stopped, or out of time.

    `seconds_left` is what is left of a deadline that began earlier (`lifecycle.remaining`). One
    count of the work decides the number of tasks; nothing else passes through the driver.
    """
    spark = work.sparkSession
    sc, attempt = spark.sparkContext, store.claim(spark, run)
    until = time.time() + (limits.job if seconds_left is None else seconds_left)
    store.note(spark, run, attempt, RUNNING)
    slow, over = sc.accumulator(0), threading.Event()
    state = Running(run, attempt, f"run-{run}-{attempt}-{uuid.uuid4().hex[:8]}", lambda: sc.cancelJobGroup(state.group))

    def judge() -> None:
        try:
            sc.setJobGroup(state.group, f"run {run}, attempt {attempt}", interruptOnCancel=True)
            left = store.left(work, run, again)
            n = left.count()
            if n and state.status == RUNNING:
                dealt = left.repartition(max(1, -(-n // limits.per_task)))
                answers = asked(dealt, store, run, attempt, task, provider, limits, until, slow)
                # version 2 of the committer: a task's file is there for good once the task has ended
                answers.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(f"{store.path}/results/{state.group}")
        except BaseException as e:
            state.error = e
        finally:
            over.set()

    def watch() -> None:
        while not over.wait(limits.poll):
            reason = CANCELLED if store.told_to_stop(spark, run) else TIMEOUT if slow.value or time.time() >= until + limits.poll else None
            if reason and state.status == RUNNING:
                state.status = reason
            if state.status != RUNNING:
                state.cancel()  # again, should a job have begun in between
        finish()

    def finish() -> None:
        if state.status == RUNNING:
            if state.error is not None:
                state.status = FAILED
            elif slow.value or time.time() >= until:
                state.status = TIMEOUT if store.left(work, run, again).limit(1).count() else COMPLETED
            else:
                state.status = COMPLETED
        store.note(spark, run, attempt, state.status)

    if store.told_to_stop(spark, run):
        state.status = CANCELLED
        finish()
        return state
    state._threads = [InheritableThread(target=judge), InheritableThread(target=watch)]
    for t in state._threads:
        t.daemon = True
        t.start()
    return state
