"""Streaming: progress of runs as results arrive, and runs whose heartbeat has stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators import report


def progress(results: DataFrame, *run: str) -> DataFrame:
    """Results so far, errors and the last heartbeat of each run. Works on a stream (update or complete mode) and on a batch."""
    return results.groupBy(*run).agg(F.count("*").alias("done"), F.count("error").alias("errors"), F.max("ts").alias("last_ts"))


def windowed(results: DataFrame, late: str = "10 minutes", size: str = "1 hour", *run: str) -> DataFrame:
    """An extension: progress by event-time windows under a watermark, so that state is dropped and late rows are defined."""
    return results.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), *run).agg(F.count("*").alias("done"), F.count("error").alias("errors")).select(F.col("w.start").alias("start"), *run, "done", "errors")


def to_table(state: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run until the source's present end into an in-memory table of the session; for a console or a dashboard."""
    return state.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_files(state: DataFrame, path: str, checkpoint: str, *run: str) -> StreamingQuery:
    """Run until the source's present end; every batch's changed runs are appended to a table of files, numbered by `batch`. The driver sees no row."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(saved: DataFrame, *run: str) -> DataFrame:
    """The last state of each run in a table that `to_files` wrote; a batch that was written twice counts once."""
    rest = [c for c in saved.columns if c not in run]
    return saved.groupBy(*run).agg(F.max_by(F.struct(*[c for c in rest if c != "batch"]), "batch").alias("_r")).select(*run, "_r.*")


def summarized(scores: DataFrame, path: str, checkpoint: str, *key: str) -> StreamingQuery:
    """Run until the source's present end: each batch's partial summary becomes a folder of its own, written anew if the batch is repeated. `summaries` merges them."""

    def save(batch: DataFrame, number: int) -> None:
        report.partial_summary(batch, *key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scores.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summaries(parts: DataFrame, *key: str) -> DataFrame:
    """The metric summary of all batches so far: reads a state a key and batch, never the scores."""
    return report.merged_summary(parts, *key)


def recovered(runs: DataFrame, beats: DataFrame, now: Column, run: str, started: str = "30 minutes", beat: str = "30 minutes") -> DataFrame:
    """All runs, the stale ones failed, with the time they were found so."""
    lost = stale(runs, beats, now, run, started, beat).select(run, F.lit(True).alias("_lost"))
    out = runs.join(lost, run, "left").withColumn("finished_at", F.when(F.col("_lost"), now))
    return out.withColumn("status", F.when(F.col("_lost"), "failed").otherwise(F.col("status"))).drop("_lost")


def cancelled(results: DataFrame, stops: DataFrame, run: str) -> DataFrame:
    """Results of runs but those that came after the run was told to stop: what is under way ends, nothing is begun."""
    return results.join(stops.groupBy(run).agg(F.min("ts").alias("_stop")), run, "left").where(F.col("_stop").isNull() | (F.col("ts") <= F.col("_stop"))).drop("_stop")


def rate(done: Column, total: Column) -> Column:
    return F.round(F.try_divide(done, total), 4)


def stale(runs: DataFrame, beats: DataFrame, now: Column, run: str, started: str = "30 minutes", beat: str = "30 minutes") -> DataFrame:
    """Pending or running runs that began before the cutoff and have no recent heartbeat."""
    last = beats.groupBy(run).agg(F.max("ts").alias("last_beat"))
    rows = runs.where(F.col("status").isin("pending", "running")).join(last, run, "left")
    old = F.col("started_at") < now - F.expr(f"INTERVAL {started}")
    quiet = F.col("last_beat").isNull() | (F.col("last_beat") < now - F.expr(f"INTERVAL {beat}"))
    return rows.where(old & quiet)
