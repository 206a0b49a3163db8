"""Queries of runs as they run: outcomes of stopped and resumed ones, and silence. What the tables lack is derived from them, so that both engines agree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.plans.common import GRID_SQL, cells, load, shared_dir
from evalspark.sources import arriving
from evalspark.streaming import heartbeats, progress, runs

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


class Lengths:
    """A provider that answers a text with its length."""

    def answer(self, task: str, requests: list[str]) -> list[str]:
        return [str(len(r)) for r in requests]


@query(
    """SELECT 'resumed' AS run, doc_id AS row_id, CASE WHEN text IS NULL THEN 'error' ELSE 'done' END AS status, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS attempt, length(text)::VARCHAR AS answer FROM documents
UNION ALL SELECT 'stopped', doc_id, 'cancelled', 0, NULL FROM documents"""
)
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose first attempt saw part of its work (one language) and whose second asks for the rest, and a run that was told to stop before it began."""
    store = runs.Store(f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}", key="row_id long")
    work = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("request"), "lang")
    limits = runs.Limits(job=3600, batch=1024, per_task=20_000)
    store.stop(spark, "stopped", "not wanted")
    for run, part in (("resumed", work.where("lang = 'en'")), ("resumed", work), ("stopped", work)):
        state = runs.start(part, store, run, "lengths", Lengths(), limits)
        if state.wait() == runs.FAILED:
            raise state.error
    both = [store.outcome(work, run) for run in ("resumed", "stopped")]
    return both[0].unionByName(both[1]).select("run", "row_id", "status", F.coalesce("attempt", F.lit(0)).alias("attempt"), "answer")


@query(
    """WITH e AS (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next, (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE AS mark FROM events),
g AS (SELECT user_id, min(ts) FILTER (next IS NULL OR next > ts + INTERVAL 12 HOUR) AS last_beat, min(ts) FILTER (event_type = 'error') AS told, min(mark) AS mark FROM e GROUP BY user_id)
SELECT user_id::VARCHAR AS run, 'failed' AS status, last_beat, last_beat + INTERVAL 12 HOUR AS found_at FROM g WHERE (told IS NULL OR told > last_beat) AND ceil(epoch_us(last_beat + INTERVAL 12 HOUR) / 1000) <= floor(epoch_us(mark) / 1000)"""
)
def silent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are users, alive at each event, ended by an error: those that fall silent for twelve hours, as a stream over the events tells."""
    schema = load(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file
    beats = events.select(F.col("user_id").alias("run"), F.when(F.col("event_type") == "error", "failed").alias("kind"), "ts")
    base = f"{shared_dir(spark)}/silent-{uuid.uuid4().hex}"
    with heartbeats.keyed_state(spark):
        found = heartbeats.silent(beats, "12 hours", "3650 days", "1 minute")
        query = found.writeStream.outputMode("append").format("parquet").option("path", f"{base}/found").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{base}/found")


@query(
    """SELECT conv_id::VARCHAR AS response, md5(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text)) AS answer_md5, count(*) AS n_events, true AS complete FROM conversations GROUP BY conv_id"""
)
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as event streams, a turn an event: the stream's fold of their lines, which lie in files of any order."""
    turns = load(spark, sf_dir, "conversations")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    data = F.concat(F.lit("data: "), F.to_json(F.struct("text")))
    placed = turns.select(F.col("conv_id").cast("string").alias("response"), at.alias("k"), data.alias("line"))
    two = F.array(F.struct((2 * F.col("k")).alias("n"), "line"), F.struct((2 * F.col("k") + 1).alias("n"), F.lit("").alias("line")))  # the event and the blank line behind it
    each = placed.select("response", F.explode(two).alias("x")).select("response", "x.*")
    ends = each.groupBy("response").agg((F.max("n") + 1).alias("n")).select("response", "n", F.lit(None).cast("string").alias("line"))
    base = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    row = [F.col("response"), F.lit("1").alias("attempt"), F.col("n").cast("long").alias("line_no"), "line", F.lit(None).cast("string").alias("error"), F.current_timestamp().alias("at")]
    each.unionByName(ends).select(*row).repartition("line_no").write.parquet(f"{base}/spool")
    with heartbeats.keyed_state(spark):
        found = arriving.answers(arriving.arriving(spark, f"{base}/spool"))

        def save(batch: DataFrame, number: int) -> None:
            batch.where("complete").write.mode("append").parquet(f"{base}/answers")

        query = found.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{base}/answers").select("response", F.md5("answer").alias("answer_md5"), "n_events", "complete")


@query(f"WITH {GRID_SQL} SELECT source, metric, round(avg(score), 4) AS mean, round(min(score), 4) AS min, round(max(score), 4) AS max, round(avg((score >= coalesce(threshold, 0.7))::INT), 4) AS pass_rate, count(score) AS n, count(*) - count(score) AS errors FROM g GROUP BY source, metric")
def summary_by_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric summaries of each source out of the partial ones of a stream's batches, a file a batch."""
    schema = load(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern: the table may be one file
    base = f"{shared_dir(spark)}/summary-{uuid.uuid4().hex}"
    progress.summarized(cells(docs, load(spark, sf_dir, "labels")), f"{base}/parts", f"{base}/check", "source", "metric").awaitTermination()
    return progress.summaries(spark.read.parquet(f"{base}/parts"), "source", "metric")
