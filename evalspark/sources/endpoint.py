"""HTTP endpoints under evaluation: request templates, a client with retries, field extraction."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from evalspark.functions import text as T
from evalspark.operators.lifecycle import request_body
from evalspark.sources.paced import Refused

RAW_LIMIT = 20_000


@dataclass(frozen=True)
class Endpoint:
    """A judge.Provider over HTTP: each request is posted as JSON, `parallel` at a time. Malformed answers fail at once, others are tried again; the last error is the answer.

    With `stream`, the answer is a stream of events: its lines come back as they are, for `sse.data_lines` or `sse.frames`.
    """

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 180.0
    attempts: int = 3
    parallel: int = 8
    stream: bool = False

    def answer(self, task: str, requests: list[str]) -> list[str]:
        with ThreadPoolExecutor(max(1, self.parallel)) as pool:
            return list(pool.map(self._post, map(self._body, [task] * len(requests), requests)))

    def _body(self, task: str, request: str) -> str:
        return request

    def _headers(self) -> dict[str, str]:
        return {"Content-Type": "application/json", "Accept": "text/event-stream" if self.stream else "application/json", **self.headers}

    def call(self, request: str) -> str:
        """One request, sent once: the answer's text. A server that is busy refuses, for as long as it says."""
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, self._body("", request).encode(), self._headers()), timeout=self.timeout) as response:
                return response.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code not in (429, 503):
                raise
            said = e.headers.get("Retry-After") or ""
            raise Refused(float(said) if said.strip().isdigit() else 1.0) from e

    def lines(self, body: str) -> Iterator[str]:
        """The answer's lines as they come. A connection that isn't made is tried again; once a line has come, what breaks it is an error."""
        for k in range(1, self.attempts + 1):
            try:
                response = urllib.request.urlopen(urllib.request.Request(self.url, body.encode(), self._headers()), timeout=self.timeout)
                break
            except OSError:
                if k == self.attempts:
                    raise
                time.sleep(min(2.0, 0.5 * k))
        with response:
            for line in response:
                yield line.decode("utf-8", "replace").rstrip("\r\n")

    def _post(self, body: str) -> str:
        for k in range(1, self.attempts + 1):
            try:
                request = urllib.request.Request(self.url, body.encode(), self._headers())
                with urllib.request.urlopen(request, timeout=self.timeout) as response:
                    return response.read().decode("utf-8", "replace")
            except ValueError as e:
                return json.dumps({"error": str(e)})
            except OSError as e:
                if k == self.attempts:
                    return json.dumps({"error": str(e)})
                time.sleep(min(2.0, 0.5 * k))
        raise AssertionError("unreachable")


@dataclass(frozen=True)
class Chat(Endpoint):
    """A chat model behind an OpenAI-style URL, in JSON mode: the task is told by a system message, the request is the user's; the answer is the model's text."""

    model: str = ""
    prompts: dict[str, str] = field(default_factory=dict)
    temperature: float = 0.0
    json_mode: bool = True

    def _body(self, task: str, request: str) -> str:
        messages = [{"role": "system", "content": self.prompts[task]}] if task in self.prompts else []
        body = {"model": self.model, "temperature": self.temperature, "messages": [*messages, {"role": "user", "content": request}]}
        return json.dumps(body | ({"response_format": {"type": "json_object"}} if self.json_mode else {}), ensure_ascii=False)

    def answer(self, task: str, requests: list[str]) -> list[str]:
        return [self._text(a) for a in super().answer(task, requests)]

    def _text(self, raw: str) -> str:
        try:
            said = json.loads(raw)
            return raw if "error" in said else said["choices"][0]["message"]["content"] or ""
        except (ValueError, LookupError, TypeError):
            return json.dumps({"error": "no message in the answer"})


@dataclass(frozen=True)
class Embeddings(Endpoint):
    """An embedding model behind an OpenAI-style URL: texts in batches of 64, vectors in the order of the texts."""

    model: str = ""
    batch: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for lo in range(0, len(texts), self.batch):
            said = json.loads(self._post(json.dumps({"model": self.model, "input": texts[lo : lo + self.batch]}, ensure_ascii=False)))
            if "data" not in said:
                raise ValueError(str(said.get("error", "no vectors in the answer")))
            out += [x["embedding"] for x in sorted(said["data"], key=lambda x: x["index"])]
        return out


class Hashed:
    """An offline embedding: a bag of words hashed into `dim` places."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % self.dim] += 1.0
            out.append(v)
        return out


def embed(rows: DataFrame, text: str, model: Embeddings | Hashed, name: str = "embedding", batch: int = 64) -> DataFrame:
    """Add the vector of each text, `batch` texts a call; null texts have none."""
    at, names = rows.columns.index(text), [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                texts = part.column(at).to_pylist()
                vectors = iter(model.embed([t for t in texts if t is not None]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float64()))], names=names)

    return rows.mapInArrow(run, ty.StructType([*rows.schema, ty.StructField(name, ty.ArrayType(ty.DoubleType()))]))


def body(rows: DataFrame, template: dict, question: str = "user_input") -> Column:
    """A request's body from a template with {{user_input}}, {{question}} and {{row_data.<field>}} variables."""
    kinds = {f.name: f.dataType for f in rows.schema}
    names = {"user_input": question, "question": question} | {f"row_data.{c}": c for c in rows.columns}
    return request_body(template, {n: F.col(c) for n, c in names.items() if c in kinds}, {n: kinds[c] for n, c in names.items() if c in kinds})


def raw(payload: Column) -> Column:
    """The copy of an answer that is kept beside its fields, cut to RAW_LIMIT characters; fields are read from the whole."""
    return F.substring(payload, 1, RAW_LIMIT)


def fields(payload: Column, paths: dict[str, str]) -> list[Column]:
    """Mapped fields of an answer's JSON; `response` falls back to `data.answer`, `answer`, then the raw text."""
    out = [T.path_get(payload, p).alias(name) for name, p in paths.items() if name != "response"]
    named = [T.path_get(payload, paths["response"])] if paths.get("response") else []
    answer = T.first_of(*named, T.path_get(payload, "data.answer"), T.path_get(payload, "answer"), payload)
    return [answer.alias("response"), *out]


def errors(payload: Column, paths: dict[str, str]) -> Column:
    """Names of the mapped fields that an answer lacks."""
    return F.array_compact(F.array(*[F.when(T.path_get(payload, p).isNull(), F.lit(n)) for n, p in sorted(paths.items())]))
