"""Runs that fall silent, found as the silence lasts: state and a timer for each run.

Every sign of life moves a run's timer on. A timer that fires fails the run, once; a run that has
ended, either way, is remembered for a while, so that late or repeated signs don't bring it back,
and then dropped. Event time is for replays and tests: it moves with the stream's own signs.
Processing time is for live use: timers fire though every run is silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

ENDS = ("completed", "cancelled", "failed")
FOUND = "status string, last_beat timestamp, found_at timestamp"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def microseconds(interval: str) -> int:
    """Of '30 minutes' and the like."""
    number, unit = interval.split()
    return int(float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.removesuffix("s")] * 1_000_000)


def joined(spans: list[tuple[int, int]], more: list[int], silence: int) -> list[tuple[int, int]]:
    """Stretches of signs that are no more than `silence` apart, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted([*spans, *((at, at) for at in more)]):
        if out and start - out[-1][1] <= silence:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def fires(at: int) -> int:
    """The first whole millisecond that is no earlier."""
    return -(-at // 1000)


class Watch(StatefulProcessor):
    """State of a run: stretches of its signs, the first end it was told, whether it's over, and the time of its one timer. Microseconds, as Spark's timestamps are; timers count milliseconds.

    With event time a silence is judged once the watermark has passed it, so the order in which signs
    come, and the batches they come in, make no difference: what arrives behind a gap waits as a
    stretch of its own, and what arrives in the gap joins the two.
    """

    def __init__(self, silence: int, forget: int, event_time: bool):
        self.silence, self.forget, self.event_time = silence, forget, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "starts array<long>, ends array<long>, told long, over boolean, timer long")

    def _keep(self, spans: list[tuple[int, int]], told: int | None, over: bool, timer: int, before: int | None) -> None:
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(fires(before))
            self.handle.registerTimer(fires(timer))
        self.run.update(([a for a, _ in spans], [b for _, b in spans], told, over, timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = 1000 * (timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs())
        signs, told = [], None
        for r in rows:
            at = r["us"] if self.event_time else now
            signs.append(at)
            if r["kind"] in ENDS:
                told = at if told is None else min(told, at)
        if not self.run.exists():
            if max(signs) + self.forget <= now:
                return iter(())  # too old to tell anything: its run is forgotten
            before, spans, over = None, [], False
        else:
            starts, ends, known, over, before = self.run.get()
            spans = list(zip(starts, ends, strict=True))
            told = min((t for t in (told, known) if t is not None), default=None)
        spans = joined(spans, signs, self.silence)
        over = over or (told is not None and told <= spans[0][1])
        if over:  # nothing to watch but that the run stays away
            last = spans[-1][1]
            self._keep([(last, last)], told, True, max(last + self.forget, before or 0), before)
        else:
            self._keep(spans, told, False, spans[0][1] + self.silence, before)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.run.exists():
            return
        starts, ends, told, over, timer = self.run.get()
        if at != fires(timer):
            return  # moved on since
        if over:
            self.run.clear()
            return
        later = max(1000 * (at + 1), ends[-1] + self.forget)  # never the timer that has just fired: it's deleted after this
        self.handle.registerTimer(fires(later))
        self.run.update(([ends[-1]], [ends[-1]], told, True, later))
        yield Row(run=key[0], status="failed", last_us=ends[0], found_us=timer)

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in a store that has timers; the session's own choice comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def silent(beats: DataFrame, silence: str = "30 minutes", forget: str = "1 hour", late: str = "1 minute", event_time: bool = True) -> DataFrame:
    """(run, status, last_beat, found_at): a failed row for every run whose signs of life (run, kind, ts) stop for `silence`, once.

    A kind of ENDS ends a run; null kinds are beats; signs without a run or a time count for
    nothing. Start the query within `keyed_state`, in append or update mode.
    """
    rows = beats.where("run IS NOT NULL AND ts IS NOT NULL").select(F.col("run").cast("string").alias("run"), "kind", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    if event_time:
        rows = rows.withWatermark("ts", late)
    watch = Watch(microseconds(silence), max(microseconds(forget), microseconds(silence)), event_time)
    found = rows.groupBy("run").transformWithState(watch, "run string, status string, last_us long, found_us long", "update", "eventTime" if event_time else "processingTime")
    return found.select("run", "status", F.timestamp_micros("last_us").alias("last_beat"), F.timestamp_micros("found_us").alias("found_at"))
