"""Datasets, runs and generation jobs through their life: listings with what belongs to them, seeds and upserts, counts and states, exports."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from evalspark.functions import text as T
from evalspark.operators import judge
from evalspark.operators.ingest import csv_cells

JOB_TIMEOUT = 900  # seconds
#: The message of a run that its process left behind.
ORPHANED = "interrupted"

# ---------------------------------------------------------------- rows and listings


def dataset_rows(rows: DataFrame, datasets: DataFrame | None = None, dataset_id: int | None = None, name: str | None = None, limit: int | None = None) -> DataFrame:
    """A dataset's rows in row_index order, by its id, or by its name among `datasets`; the first `limit` if given (a top-k, no full sort)."""
    if dataset_id is not None:
        found = rows.where(F.col("dataset_id") == dataset_id)
    else:
        found = rows.join(datasets.where(F.col("name") == name).select("dataset_id"), "dataset_id", "left_semi")
    ordered = found.orderBy("row_index")
    return ordered.limit(limit) if limit is not None else ordered


def page_with_total(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """One page of a listing, each row with the number of all; `order` must decide ties."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))


def page_of(row_index: Column | str, size: int) -> Column:
    """The page (from 1) that a row is on."""
    return (F.floor(T.col(row_index) / size) + 1).cast("long")


def latest(rows: DataFrame, order: list[Column], *key: str) -> DataFrame:
    """The first row of each key in an order of columns, of equal ones that of the smallest values (combined before the shuffle); of the whole table without a key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order, *T.orderable(rows, rest))).alias("_r")).select(*key, "_r.*")


def with_dimensions(tasks: DataFrame, **dimensions: DataFrame) -> DataFrame:
    """Tasks with the name of each dimension's row (dataset=..., scenario=...: frames of <dimension>_id and name); null where there is none. Small frames are broadcast under Spark's own check."""
    out = tasks
    for what, dim in dimensions.items():
        out = out.join(dim.select(f"{what}_id", F.col("name").alias(f"{what}_name")), f"{what}_id", "left")
    return out


def scenario_metrics(scenarios: DataFrame, links: DataFrame, metrics: DataFrame) -> DataFrame:
    """Scenarios with their metrics in order, of a link its threshold and weight; a scenario without metrics has one row of nulls."""
    both = links.join(metrics.select("metric_id", "metric", "metric_type"), "metric_id", "left")
    return scenarios.join(both, "scenario_id", "left")


def scoring_grid(rows: DataFrame, metrics: DataFrame, most: int = 1000) -> DataFrame:
    """Every row with every metric of its run's scenario: an equi-join by scenario. A scenario of more than `most` metrics is an error."""
    listed = metrics.groupBy("scenario_id").agg(F.collect_list(F.struct(*[c for c in metrics.columns if c != "scenario_id"])).alias("_m"))
    checked = F.when(F.size("_m") <= most, F.col("_m")).otherwise(F.raise_error(F.lit("too many metrics in a scenario")).cast(listed.schema["_m"].dataType))
    return rows.join(listed, "scenario_id").select(*rows.columns, F.explode(checked).alias("_c")).select(*rows.columns, "_c.*")


def with_stats(runs: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Runs with their counts, 0 where a run has none."""
    counts = [c for c in stats.columns if c != key]
    return runs.join(stats, key, "left").fillna(0, counts)


def comparable(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Pairs (run, other) that may be compared: completed, of one dataset and scenario, with the same set of metrics; no run with itself."""
    sets = metrics.groupBy("run").agg(F.array_sort(F.collect_set("metric")).alias("_m"))
    done = runs.where("status = 'completed'").join(sets, "run", "left").withColumn("_m", F.coalesce("_m", F.array().cast("array<string>")))
    other = done.select(F.col("run").alias("other"), "dataset_id", "scenario_id", "_m")
    return done.join(other, ["dataset_id", "scenario_id", "_m"]).where("run <> other").select("run", "other")


def refusal(run: Column, other: Column) -> Column:
    """Why two runs (structs dataset_id, scenario_id, metrics) can't be compared; null if they can."""
    same = lambda a, b: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    return (
        F.when(~run["dataset_id"].eqNullSafe(other["dataset_id"]), "dataset")
        .when(~run["scenario_id"].eqNullSafe(other["scenario_id"]), "scenario")
        .when(~same(run["metrics"], other["metrics"]), "metrics")
    )


def searched(rows: DataFrame, words: str, columns: list[str], **equal: object) -> DataFrame:
    """Rows of which some column holds the words (any case; none: all rows), and that have the given values."""
    found = rows if not words.strip() else rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(words.strip().lower())))
    for c, v in equal.items():
        found = found.where(F.col(c) == v)
    return found


def listed_first(rows: DataFrame, column: str, names: list[str]) -> list[Column]:
    """An order: the named values as they are listed, then the others by themselves."""
    at = F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return [F.when(at > 0, at).otherwise(len(names) + 1), F.col(column)]


# ---------------------------------------------------------------- seeds, schemas, keys


def upsert(existing: DataFrame, new: DataFrame, key: list[str], update: bool = False, order: list[Column] | None = None) -> DataFrame:
    """Existing rows and those of `new` with a new key; with `update` a row of `new` takes the place of the one it names.

    Of a key that the batch holds more than once its first row by `order` counts, with `update` its
    last one (rows that are equal by it: by their values). A null key is a key like any other.
    """
    columns, rest = existing.columns, [c for c in existing.columns if c not in key]
    place = F.struct(*(order or []), *T.orderable(new, columns))
    batch = new.groupBy(*key).agg((F.max_by if update else F.min_by)(F.struct(*rest), place).alias("_r")).select(*key, "_r.*") if rest else new.select(*key).distinct()

    def lacking(rows: DataFrame, others: DataFrame) -> DataFrame:
        names = {k: f"_k{i}" for i, k in enumerate(key)}
        keys = others.select(*[F.col(k).alias(n) for k, n in names.items()])
        same = functools.reduce(lambda a, b: a & b, [rows[k].eqNullSafe(keys[n]) for k, n in names.items()])
        return rows.join(keys, same, "left_anti").select(*columns)

    return lacking(existing, batch).unionByName(batch.select(*columns)) if update else existing.unionByName(lacking(batch, existing))


def merge_fields(fields: DataFrame, found: DataFrame) -> DataFrame:
    """A dataset's declared fields (name, type, required, position) and those of `found` (name, value as JSON text) that it lacks, appended by name."""
    lacking = found.groupBy("name").agg(F.min("value").alias("_v")).join(fields.select("name"), "name", "left_anti")
    last = fields.agg(F.coalesce(F.max("position"), F.lit(0)).alias("_last"))  # one row
    place = F.row_number().over(Window.orderBy("name"))  # one row a new field name
    fresh = lacking.select("name", T.json_type("_v").alias("type"), F.lit(False).alias("required"), place.alias("_p")).crossJoin(F.broadcast(last))
    return fields.unionByName(fresh.select("name", "type", "required", (F.col("_last") + F.col("_p")).cast(fields.schema["position"].dataType).alias("position")))


def index_corpus(kb: DataFrame, distractors: DataFrame, hard: DataFrame, n: int, m: int, order: str = "doc_id") -> DataFrame:
    """What a retriever is tested on: the knowledge base, the first n distractors, the first m hard negatives (a top-k each), with their origin."""
    tag = lambda df, what: df.select(F.lit(what).alias("origin"), *kb.columns)
    return tag(kb, "kb").unionByName(tag(distractors.orderBy(order).limit(n), "distractor")).unionByName(tag(hard.orderBy(order).limit(m), "hard"))


def zip_rows(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Two lists row by row, by their explicit numbers, never by the order they come in."""
    return left.join(right, key, "full_outer")


def samples_of(chunks: DataFrame, samples: DataFrame) -> DataFrame:
    """(chunk_id, sample_id): samples that name a chunk among their sources, by an equi-join."""
    return samples.select("sample_id", F.explode(F.array_distinct("source_chunk_ids")).alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "sample_id")


def merge_reports(first: DataFrame, second: DataFrame, rows: list[str], carried: list[str]) -> DataFrame:
    """The metrics of the first report, and of the second those carried over, each with its origin. An error unless both hold the same rows.

    Reports are (metric, *rows, score): a metric's scores by row, with what the rows are (their kind).
    """
    shape = lambda df: df.select(*rows).distinct()
    differ = shape(first).exceptAll(shape(second)).unionByName(shape(second).exceptAll(shape(first))).agg(F.count("*").alias("_d"))  # one row
    kept = second.where(F.col("metric").isin(*carried)).join(first.select("metric").distinct(), "metric", "left_anti")
    both = first.withColumn("origin", F.lit("first")).unionByName(kept.withColumn("origin", F.lit("second")))
    same = F.when(F.col("_d") == 0, F.lit(True)).otherwise(F.raise_error(F.lit("the reports hold different rows")).cast("boolean"))
    return both.crossJoin(F.broadcast(differ)).where(same).drop("_d")


# ---------------------------------------------------------------- reviews and reports


def review_counts(rows: DataFrame, *run: str, status: str = "manual_status") -> DataFrame:
    """Manually reviewed rows, and how many of each verdict."""
    n = lambda v: F.count_if(F.col(status) == v).alias(f"manual_{v}")
    return rows.groupBy(*run).agg(F.count(status).alias("reviewed"), *map(n, ("pass", "fail", "needs_fix", "needs_review")))


def backfilled(summary: DataFrame, recomputed: DataFrame, key: list[str]) -> DataFrame:
    """Stored summaries with the pass rate that their scores give where none is stored. recomputed: report.metric_summary of the rows."""
    new = recomputed.select(*key, F.col("pass_rate").alias("_rate"))
    return summary.join(new, key, "left").withColumn("pass_rate", F.coalesce("pass_rate", "_rate")).drop("_rate")


# ---------------------------------------------------------------- generation jobs


def recount(jobs: DataFrame, documents: DataFrame, chunks: DataFrame, samples: DataFrame) -> DataFrame:
    """Jobs with their numbers: selected samples in all, completed and failed, documents, chunks; and the state these mean."""
    mine = samples.where("selected").groupBy("job_id").agg(F.count("*").alias("total_samples"), F.count_if(F.col("status") == "completed").alias("completed_samples"), F.count_if(F.col("status") == "failed").alias("failed_samples"))
    docs = documents.groupBy("job_id").agg(F.count("*").alias("total_documents"))
    cut = chunks.join(documents.select("job_id", "document_id"), "document_id").groupBy("job_id").agg(F.count("*").alias("total_chunks"))
    out = jobs
    for part in (mine, docs, cut):
        out = with_stats(out, part, "job_id")
    return out.withColumn("job_status", job_status(F.col("total_samples"), F.col("completed_samples"), F.col("failed_samples")))


def job_status(total: Column, completed: Column, failed: Column) -> Column:
    """failed without a completed sample, completed without a failed one, else partial."""
    return F.when((total == 0) | (completed == 0), "failed").when(failed == 0, "completed").otherwise("partial")


def recovered_jobs(jobs: DataFrame, now: Column, timeout: int = JOB_TIMEOUT) -> DataFrame:
    """Jobs that have run for `timeout` seconds or longer since they were started (or updated, or created) are over: failed, or partial with completed samples. All jobs come back."""
    begun = F.coalesce("started_at", "updated_at", "created_at")
    stale = (F.col("status") == "running") & (F.unix_timestamp(now) - F.unix_timestamp(begun) >= timeout)
    over = F.when(F.col("completed_samples") == 0, "failed").otherwise("partial")
    stale = F.coalesce(stale, F.lit(False))
    return jobs.withColumn("stale", stale).withColumn("status", F.when(F.col("stale"), over).otherwise(F.col("status")))


def remaining(started: Column, now: Column, timeout: int = JOB_TIMEOUT) -> Column:
    """Seconds that are left of a deadline, 0 at least; all of them before the start is known."""
    return F.greatest(F.lit(0), F.lit(timeout) - F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(started), F.lit(0)))


def orphaned(runs: DataFrame, now: Column) -> DataFrame:
    """After a restart: runs that were pending or running have failed. All runs come back."""
    lost = F.col("status").isin("pending", "running")
    out = runs.withColumn("error", F.when(lost, ORPHANED).otherwise(F.col("error"))).withColumn("finished_at", F.when(lost, now).otherwise(F.col("finished_at")))
    return out.withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def with_snapshots(runs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Runs without a scenario snapshot get their scenario's present one (scenario_id, metrics)."""
    now = scenarios.select("scenario_id", F.col("metrics").alias("_now"))
    return runs.join(now, "scenario_id", "left").withColumn("snapshot", F.coalesce("snapshot", "_now")).drop("_now")


def sample_payload(samples: DataFrame) -> Column:
    """The dataset row of a generated sample (sample_id, job_id, chunk_id, question, reference, reference_context_ids, source_chunk_ids, document_name), as JSON text."""
    none = F.array().cast("array<string>")
    names = F.when(F.col("document_name").isNotNull(), F.array("document_name")).otherwise(none)
    meta = F.struct("sample_id", "job_id", "chunk_id").alias("generation_meta")
    return F.to_json(F.struct(F.col("question").alias("user_input"), "reference", F.coalesce("reference_context_ids", none).alias("reference_context_ids"), F.coalesce("source_chunk_ids", none).alias("source_chunk_ids"), names.alias("source_document_names"), meta))


def generated(chunks: DataFrame, provider: judge.Provider, most_chars: int = 12_000) -> DataFrame:
    """Candidate questions of chunks (chunk_id, content, allocated): more than wanted are asked for, blank ones are left out.

    (chunk_id, position, question, reference, allocated); a chunk whose answer holds no usable item
    has one row with an error. Ready for `judge.select_questions`, which keeps the wanted number.
    """
    wanted = F.col("allocated") + F.least(F.lit(3), F.greatest(F.lit(1), F.col("allocated")))
    asked = chunks.where("allocated > 0").select("chunk_id", "allocated", F.to_json(F.struct(F.substring("content", 1, most_chars).alias("content"), wanted.cast("int").alias("n"))).alias("request"))
    said = judge.ask(asked, "generate", provider)
    items = F.from_json(T.path_get(T.json_object("answer"), "items"), "array<struct<question:string,reference:string>>")
    text = lambda c: F.coalesce(T.strip(c), F.lit(""))
    usable = F.filter(F.transform(items, lambda x: F.struct(text(x["question"]).alias("question"), text(x["reference"]).alias("reference"))), lambda x: (x["question"] != "") & (x["reference"] != ""))
    rows = said.select("chunk_id", "allocated", F.posexplode_outer(usable).alias("position", "x"))
    error = F.when(F.col("x").isNull(), F.lit("no usable question in the answer"))
    return rows.select("chunk_id", F.coalesce("position", F.lit(0)).alias("position"), "x.question", "x.reference", "allocated", error.alias("error"))


# ---------------------------------------------------------------- logs


def last_lines(log: Column | str, n: int = 8) -> Column:
    """The last `n` lines of a log that aren't blank."""
    lines = F.filter(F.split(T.col(log), "\n"), lambda x: F.trim(x) != "")
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n)


def log_line(ts: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("] "), message)


def logs(events: DataFrame, run: str, ts: str, order: str, message: str) -> DataFrame:
    """(run, log): an append-only table of messages as one text a run, for display."""
    each = events.select(run, F.struct(order, log_line(F.col(ts), F.col(message)).alias("line")).alias("l"))
    return each.groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("log"))


# ---------------------------------------------------------------- results and exports


def append_results(results: DataFrame, path: str, *by: str) -> None:
    """Add results to a table of files, parted by run (and side): a row is written once, nothing is read back or rewritten."""
    results.write.mode("append").partitionBy(*by).parquet(path)


def json_lines(rows: DataFrame, order: str) -> DataFrame:
    """(part, order, value): the lines of one JSON array of objects, indented, without nulls' keys lost; the array's ends are parts of their own.

    Sorted by all three columns they are the file. Rows of one `order` stand by their texts, and
    equal ones are one line's several objects, so that exactly one line is the last.
    """
    names = [c for c in rows.columns if c != order]
    body = F.regexp_replace(F.to_json(F.struct(*names), {"pretty": "true", "ignoreNullFields": "false"}), "(?m)^", "  ")
    each = rows.select(order, body.alias("_b")).groupBy(order, "_b").agg(F.count("*").cast("int").alias("_n"))
    last = each.agg(F.max(F.struct(order, "_b")).alias("_last"))  # one row
    text = F.concat(F.repeat(F.concat("_b", F.lit(",\n")), F.col("_n") - 1), "_b", F.when(F.struct(order, "_b") == F.col("_last"), "").otherwise(","))
    lines = each.crossJoin(F.broadcast(last)).select(F.lit(1).alias("part"), order, text.alias("value"))
    return lines.unionByName(_ends(rows, order, [(0, "["), (2, "]")]))


def csv_lines(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(part, order, value): the lines of a CSV file with a byte order mark, the given columns in order, complex cells as JSON text, all texts quoted where they need it."""
    cells = csv_cells(rows)
    cell = lambda c: F.coalesce(F.when(F.col(c).cast("string").rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c).cast("string")), F.lit(""))
    body = cells.select(F.lit(1).alias("part"), order, F.concat_ws(",", *[cell(c) for c in columns]).alias("value"))
    return body.unionByName(_ends(rows, order, [(0, "\ufeff" + ",".join(columns))]))


def _ends(rows: DataFrame, order: str, lines: list[tuple[int, str]]) -> DataFrame:
    ends = rows.sparkSession.createDataFrame(lines, "part int, value string")
    return ends.select("part", F.lit(None).cast(rows.schema[order].dataType).alias(order), "value")


def write_lines(lines: DataFrame, path: str, order: str) -> None:
    """Write lines in order, as one file: the last step of an export, which is one file by its nature. Rows stream through, none is collected."""
    lines.repartition(1).sortWithinPartitions("part", order, "value").select("value").write.mode("overwrite").text(path)


def prior_report(spark: SparkSession, path: str, metrics: list[str], rows: int, scores: str = "scores") -> DataFrame:
    """(metric, row_index, score) of a stored report {"metrics": {name: {scores: [...]}}}. A metric that it lacks, or of another number of rows, is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    found = None
    for m in metrics:
        listed = F.try_variant_get("v", f"$.metrics['{m}']['{scores}']", "array<double>")
        checked = F.when(F.coalesce(F.size(listed), F.lit(-1)) == rows, listed).otherwise(F.raise_error(F.lit(f"{m}: not {rows} scores in the report")).cast("array<double>"))
        one = whole.select(F.lit(m).alias("metric"), F.posexplode(checked).alias("row_index", "score"))
        found = one if found is None else found.unionByName(one)
    return found


def request_body(template: object, columns: dict[str, Column], kinds: dict[str, ty.DataType]) -> Column:
    """A request's JSON from a template of dicts, lists and texts with {{name}} variables, compiled once into a column.

    A text that is one variable keeps the value's type (a number stays a number, null is null);
    within a longer text values are put in as text. Unknown variables stay as they are.
    """
    if isinstance(template, dict):
        parts = [F.concat(F.lit(json.dumps(str(k), ensure_ascii=False) + ":"), request_body(v, columns, kinds)) for k, v in template.items()]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")
    if isinstance(template, list):
        return F.concat(F.lit("["), F.concat_ws(",", *[request_body(v, columns, kinds) for v in template]), F.lit("]")) if template else F.lit("[]")
    if not isinstance(template, str):
        return F.lit(json.dumps(template, ensure_ascii=False))
    name = template.strip().removeprefix("{{").removesuffix("}}")
    if template.strip() == f"{{{{{name}}}}}" and name in columns:
        return as_json(columns[name], kinds[name])
    out: Column = F.lit(template)
    for n, c in columns.items():
        if f"{{{{{n}}}}}" in template:
            text = c if isinstance(kinds[n], ty.StringType) else as_json(c, kinds[n])
            out = F.replace(out, F.lit(f"{{{{{n}}}}}"), F.coalesce(text, F.lit("null")))
    return T.quoted(out)


def as_json(c: Column, kind: ty.DataType) -> Column:
    """A value as JSON text; null is `null`."""
    if isinstance(kind, (ty.ArrayType, ty.MapType, ty.StructType)):
        return F.coalesce(F.to_json(c), F.lit("null"))
    listed = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(listed.substr(F.lit(2), F.length(listed) - 2))
