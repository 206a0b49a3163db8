"""Calls under a budget for the whole stage: so many calls and tokens a second, whatever the number of tasks.

The budget is dealt out once: a stage has as many partitions as may call at a time, and each keeps
to its share of the rate by its own clock. A refusal pauses its task for as long as the server
asks and gives the request back; what was given back, and what failed, is the next stage's work.
Every stage's answers are stored before the next begins, so a lost executor repeats its own calls only.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from evalspark.functions.stored import stored


class Refused(Exception):
    """The server didn't take the request; it may be sent again after so many seconds."""

    def __init__(self, after: float = 1.0):
        super().__init__(f"refused for {after:g} s")
        self.after = after


class Caller(Protocol):
    """One call: the answer, or Refused, or any other exception for a failure. Can be pickled."""

    def call(self, request: str) -> str: ...


@dataclass(frozen=True)
class Budget:
    """What a stage may spend: calls and tokens a second, calls at a time in how many partitions. `rounds`: how often what was given back is sent again."""

    calls: float = 10.0
    tokens: float = 1e9
    slots: int = 8
    parallel: int = 4
    rounds: int = 5
    pause: float = 60.0  # the longest that a server may ask for

    def partitions(self) -> int:
        return max(1, self.slots)


class Pace:
    """When the next call may begin, by a task's share of the rates: no call before what earlier ones have spent is earned again."""

    def __init__(self, calls: float, tokens: float, clock=time.monotonic):
        self.calls, self.tokens, self.clock = calls, tokens, clock
        self.free = clock()

    def wait(self, cost: float) -> float:
        """Seconds to wait for a call of so many tokens; it's taken as begun then."""
        now = self.clock()
        begin = max(now, self.free)
        self.free = begin + max(1 / self.calls, cost / self.tokens)
        return begin - now

    def hold(self, seconds: float) -> None:
        self.free = max(self.free, self.clock() + seconds)


TOLD = "answer string, error string, refused boolean, began double"


def _stage(work: DataFrame, caller: Caller, budget: Budget, request: str, cost: str | None) -> DataFrame:
    n, names = budget.partitions(), work.columns
    at, costs = names.index(request), names.index(cost) if cost else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(budget.calls / n, budget.tokens / n)

        def one(text: str) -> tuple:
            began = time.time()
            try:
                return caller.call(text), None, False, began
            except Refused as e:
                pace.hold(min(e.after, budget.pause))
                return None, str(e), True, began
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"[:800], False, began

        with ThreadPoolExecutor(budget.parallel) as pool:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                spent = batch.column(costs).to_pylist() if cost else [len(t or "") / 4 for t in texts]
                waiting: list[Future | None] = []
                for text, tokens in zip(texts, spent, strict=True):
                    if text is None:
                        waiting.append(None)
                        continue
                    open_ = [f for f in waiting if f is not None and not f.done()]
                    if len(open_) >= budget.parallel:
                        open_[0].result()
                    time.sleep(pace.wait(tokens or 0))
                    waiting.append(pool.submit(one, text))
                told = [(None, "no request", False, None) if f is None else f.result() for f in waiting]
                kinds = (pa.string(), pa.string(), pa.bool_(), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(zip(*told, strict=True), kinds, strict=True))], names=[*names, "answer", "error", "refused", "began"])

    dealt = work.repartition(n)
    return dealt.mapInArrow(run, ty.StructType([*work.schema, *ty.StructType.fromDDL(TOLD)]))


def paced(work: DataFrame, caller: Caller, budget: Budget = Budget(), request: str = "request", cost: str | None = None, again: bool = True) -> DataFrame:
    """Every row with `answer`, `error`, `refused`, `began` (seconds since 1970) and `stage`, after as many stages as it takes.

    `cost`: a column of tokens a request spends; without one a token is four characters. Null
    requests aren't sent. With `again` failed requests are sent again like refused ones, up to
    `budget.rounds` stages; those of the last stage stay as they are, so no row is lost.
    """
    out, left, stage = [], work, 0
    while True:
        stage += 1
        told = stored(_stage(left, caller, budget, request, cost).withColumn("stage", F.lit(stage)), f"paced-{stage}")
        back = F.col("refused") | (F.col("error").isNotNull() & F.col(request).isNotNull() if again else F.lit(False))
        last = stage >= budget.rounds
        out.append(told if last else told.where(~back))
        if last or told.where(back).isEmpty():
            break
        left = told.where(back).select(*work.columns)
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows
