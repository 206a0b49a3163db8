"""Answers of event streams as they arrive, not when they end.

A task posts its requests, several at a time, and spools the lines it gets: every second or so they
become one more file in a folder that driver and executors share. Spark's own file source streams the folder: its
checkpoint knows which files a query has seen, so a replay sees the same lines. The fold keeps a
response's answer so far as state. A line is known by response, attempt and number: a request that
is posted again after its task was lost is another attempt, and lines of two never mix.
"""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evalspark.sources.endpoint import Endpoint

LINES = "response string, attempt string, line_no long, line string, error string, at timestamp"
_ARROW = pa.schema([("response", pa.string()), ("attempt", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("error", pa.string()), ("at", pa.timestamp("us", "UTC"))])
HELD = 10_000  # lines that wait to be written; beyond, connections wait


class _Spool:
    """Files of lines, each whole when it has its name."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.files.create_dir(self.folder, recursive=True)

    def write(self, rows: list[tuple]) -> None:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.parquet"
        hidden = f"{self.folder}/_{name}"
        pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW), hidden, filesystem=self.files)
        self.files.move(hidden, f"{self.folder}/{name}")


def _now() -> datetime:
    return datetime.now(timezone.utc)


def spool(requests: DataFrame, endpoint: Endpoint, folder: str, every: float = 1.0) -> DataFrame:
    """Post requests (response, request) and spool their lines; (response, attempt, n_lines, error) once they have ended.

    A response's last row in the spool has no line: its number is the number of lines, and its error
    is null if the response came to its end. Running the frame is the work: each of its tasks has
    `endpoint.parallel` responses open, and spools what came every `every` seconds.
    """

    def pump(response: str, body: str, lines: queue.Queue) -> None:
        attempt, n, error = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", 0, None
        try:
            for line in endpoint.lines(body):
                lines.put((response, attempt, n, line, None, _now()))
                n += 1
        except (OSError, ValueError) as e:
            error = str(e) or type(e).__name__
        lines.put((response, attempt, n, None, error, _now()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, todo, lines, done = _Spool(folder), queue.Queue(), queue.Queue(HELD), []
        given = ((r, b) for batch in batches for r, b in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        lock = threading.Lock()

        def work() -> None:
            while True:
                with lock:
                    one = next(given, None)
                if one is None:
                    break
                pump(*one, lines)
            todo.put(None)

        threads = [threading.Thread(target=work, daemon=True) for _ in range(max(1, endpoint.parallel))]
        for t in threads:
            t.start()
        held, last, ended = [], time.monotonic(), 0
        while ended < len(threads) or not lines.empty() or held:
            try:
                row = lines.get(timeout=max(0.01, min(0.2, every)))
                held.append(row)
                if row[3] is None:
                    done.append((row[0], row[1], row[2], row[4]))
            except queue.Empty:
                while not todo.empty():
                    todo.get()
                    ended += 1
            over = ended == len(threads) and lines.empty()
            if held and (over or len(held) >= HELD or time.monotonic() - last >= every):
                out.write(held)
                held, last = [], time.monotonic()
                if done:
                    yield _ended(done)
                    done = []

    def _ended(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["response", "attempt", "n_lines", "error"])

    asked = requests.where("response IS NOT NULL").select(F.col("response").cast("string").alias("response"), F.coalesce(F.col("request"), F.lit("")).alias("request"))
    return asked.mapInArrow(run, "response string, attempt string, n_lines long, error string")


def unanswered(requests: DataFrame, folder: str) -> DataFrame:
    """The requests whose response hasn't come to its end in the spool."""
    there = spooled(requests.sparkSession, folder).where("line IS NULL AND error IS NULL").select("response")
    return requests.join(there, "response", "left_anti")


def spooled(spark: SparkSession, folder: str) -> DataFrame:
    """The spool as a table."""
    return spark.read.schema(LINES).parquet(folder)


def arriving(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """The spool as a stream; at most `files` files a batch, if given."""
    reader = spark.readStream.schema(LINES)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def whole(lines: DataFrame) -> DataFrame:
    """Of a table of lines each response's best attempt: one that came to its end, the first of those, else the one that has most."""
    ended = F.max((F.col("line").isNull() & F.col("error").isNull()).cast("int")).alias("ended")
    best = lines.groupBy("response", "attempt").agg(ended, F.count("line").alias("n")).groupBy("response")
    chosen = best.agg(F.min_by("attempt", F.struct(-F.col("ended"), F.when(F.col("ended") == 0, -F.col("n")), "attempt")).alias("attempt"))
    return lines.join(chosen, ["response", "attempt"], "left_semi").where("line IS NOT NULL")


def _at(value: object, path: str) -> object:
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


class Fold(StatefulProcessor):
    """State of a response: for its attempt under way the lines that wait for earlier ones, the event's lines so far, and the answer so far."""

    FIELDS = "attempt string, next long, event string, full string, delta string, events long, held long, over boolean"

    def __init__(self, final: str, full: str, delta: str, framed: bool):
        self.final, self.full, self.delta, self.framed = final, full, delta, framed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("answer", self.FIELDS)
        self.waiting = handle.getMapState("waiting", "line_no long", "line string, error string")

    def _event(self, s: dict, data: str) -> None:
        data = data.strip() if not self.framed else data
        if data == "[DONE]":
            return
        s["events"] += 1
        try:
            told, _ = json.JSONDecoder().raw_decode(data.lstrip())  # the first value, as columns read it
        except ValueError:
            return
        for path in (self.final, self.full):
            text = _at(told, path)
            if isinstance(text, str) and text.strip():
                s["full"] = text
                break
        piece = _at(told, self.delta)
        if isinstance(piece, str):
            s["delta"] += piece

    def _line(self, s: dict, line: str) -> None:
        if line.startswith("data:"):
            data = line[5:]
            if not self.framed:
                self._event(s, data)
            else:
                data = data.removeprefix(" ")
                s["event"] = data if s["event"] is None else f"{s['event']}\n{data}"
        elif self.framed and not line.strip():
            self._close(s)

    def _close(self, s: dict) -> None:
        if s["event"] is not None:
            self._event(s, s["event"])
            s["event"] = None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = [f.split()[0] for f in self.FIELDS.split(", ")]
        fresh = {"attempt": None, "next": 0, "event": None, "full": None, "delta": "", "events": 0, "held": 0, "over": False}
        s = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else fresh
        if s["over"]:
            return
        before, came = (s["attempt"], s["next"], s["over"]), {}
        for r in rows:
            came.setdefault(r["attempt"], {})[r["line_no"]] = (r["line"], r["error"])
        for attempt in sorted(came):
            if s["over"] or (s["attempt"] is not None and attempt < s["attempt"]):
                continue  # an attempt that began later has taken its place
            if s["attempt"] != attempt:
                s = fresh | {"attempt": attempt}
                self.waiting.clear()
            here = came[attempt]
            while (n := s["next"]) in here or (s["held"] and self.waiting.containsKey((n,))):
                if n in here:
                    line, error = here.pop(n)
                else:
                    line, error = self.waiting.getValue((n,))
                    self.waiting.removeKey((n,))
                    s["held"] -= 1
                if line is None:
                    if error is None:
                        self._close(s)
                        s["over"] = True
                    break
                self._line(s, line)
                s["next"] += 1
            for n, told in here.items():
                if n > s["next"] and not s["over"] and not self.waiting.containsKey((n,)):
                    self.waiting.updateValue((n,), told)
                    s["held"] += 1
        if s["over"]:
            self.waiting.clear()
        self.state.update(tuple(s[n] for n in names))
        if (s["attempt"], s["next"], s["over"]) != before:
            yield Row(response=key[0], answer=s["full"] if s["full"] is not None else s["delta"], n_events=s["events"], complete=s["over"])

    def close(self) -> None:
        pass


def answers(lines: DataFrame, final: str = "final_answer", full: str = "answer", delta: str = "text", framed: bool = True) -> DataFrame:
    """(response, answer, n_events, complete): each response's answer so far, whenever more of it has come. For a stream of lines; start it within `heartbeats.keyed_state`.

    The answer is the last one given in full, if there is one, else the pieces in order. Lines may come
    in any order and more than once. `framed`: an event's lines end with a blank line; else every
    data line is an event. When the request had to be posted again, the later attempt counts.
    """
    fold = Fold(final, full, delta, framed)
    return lines.groupBy("response").transformWithState(fold, "response string, answer string, n_events long, complete boolean", "update", "none")
