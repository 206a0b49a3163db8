"""Rows into datasets: validation, coercion, deduplication, row numbers, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from evalspark.functions import text as T
from evalspark.operators.report import with_range


def validate(rows: DataFrame, fields: list[dict]) -> DataFrame:
    """Add `errors` (array of texts) by declared fields: {name, type: text | number | json | text_list | conversation | tool_call_list, required}."""
    tests: list[Column] = []
    for f in fields:
        name, c = f["name"], F.col(f["name"]) if f["name"] in rows.columns else F.lit(None).cast("string")
        blank = c.isNull() | (F.trim(c.cast("string")) == "")
        if f.get("required"):
            tests.append(F.when(blank, F.lit(f"{name}: missing")))
        if f.get("type") == "number":
            tests.append(F.when(~blank & c.cast("string").try_cast("double").isNull(), F.lit(f"{name}: not a number")))
        if f.get("type") == "json":
            tests.append(F.when(~blank & F.try_parse_json(c.cast("string")).isNull(), F.lit(f"{name}: not JSON")))
        if f.get("type") == "text_list":
            tests.append(F.when(~blank & T.list_text(c).isNull(), F.lit(f"{name}: not a list")))
        if f.get("type") in ("conversation", "tool_call_list"):
            tests.append(F.when(~blank & (T.json_type(c) != "array"), F.lit(f"{name}: not a JSON list")))
    return rows.withColumn("errors", F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))


def missing_fields(rows: DataFrame, required: list[str]) -> Column:
    """Sorted names of the required fields that a row lacks: null, empty, or no such column."""
    kinds = {f.name: f.dataType for f in rows.schema}
    complex_ = (ty.ArrayType, ty.MapType)
    tests = [F.when(T.is_missing(r, "array" if isinstance(kinds[r], complex_) else "string") if r in kinds and not isinstance(kinds[r], ty.NumericType) else (F.col(r).isNull() if r in kinds else F.lit(True)), F.lit(r)) for r in sorted(set(required))]
    return F.array_compact(F.array(*tests))


def row_key(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """Canonical JSON of a row: columns by name, nulls left out."""
    return F.to_json(F.struct(*sorted(columns or rows.columns)))


def import_new(existing: DataFrame, batch: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The batch's rows that neither the dataset nor an earlier row of the batch has, numbered on from the dataset's last row_index."""
    key = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    own = batch.withColumn("_k", key)
    rest = [c for c in own.columns if c != "_k"]
    first = own.groupBy("_k").agg(F.min_by(F.struct(*rest), F.struct(order, *T.orderable(own, rest))).alias("_r"))  # the first of equal rows, combined before the shuffle
    new = first.join(existing.select(key.alias("_k")), "_k", "left_anti").select("_r.*")
    last = existing.agg(F.coalesce(F.max("row_index"), F.lit(-1)).alias("_last"))
    return number(new, order, "row_index").crossJoin(F.broadcast(last)).withColumn("row_index", F.col("row_index") + F.col("_last") + 1).drop("_last")  # one row


def number(rows: DataFrame, order: str, name: str, parts: int = 256) -> DataFrame:
    """Consecutive numbers from 0 in the order of a column of distinct numbers: within ranges at approximate percentiles, plus the counts of earlier ranges."""
    ranged = with_range(rows, rows, order, parts)
    totals = ranged.groupBy("_p").agg(F.count("*").alias("_t"))
    before = totals.withColumn("_b", F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).select("_p", "_b")  # at most `parts` rows
    return ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order))).join(F.broadcast(before), "_p").withColumn(name, (F.col("_i") + F.col("_b") - 1).cast("long")).drop("_p", "_i", "_b")


def export_columns(rows: DataFrame, data: str, declared: list[str], order: str = "row_index") -> DataFrame:
    """(name, position) of an export: declared fields, then those that rows (a map column) have beyond, as first seen."""
    seen = rows.select(order, F.posexplode(F.map_keys(data)).alias("pos", "name")).groupBy("name").agg(F.min(F.struct(order, "pos")).alias("at"))
    extra = seen.where(~F.col("name").isin(*declared)) if declared else seen
    place = F.row_number().over(Window.orderBy("at")) + len(declared)  # one row a field name
    known = rows.sparkSession.createDataFrame([(n, i + 1) for i, n in enumerate(declared)], "name string, position int")
    return known.unionByName(extra.select("name", place.cast("int").alias("position")))


def csv_cells(rows: DataFrame) -> DataFrame:
    """Complex cells as JSON text, ready for a CSV writer."""
    flat = (ty.ArrayType, ty.MapType, ty.StructType)
    return rows.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, flat) else F.col(f.name) for f in rows.schema])


def write_back(rows: DataFrame, found: DataFrame, key: str, data: str = "data") -> DataFrame:
    """Merge a map of new values into each row's map; the new value wins."""
    return rows.join(found.select(key, F.col(data).alias("_new")), key, "left").withColumn(data, F.when(F.col("_new").isNull(), F.col(data)).otherwise(F.map_concat(F.map_filter(data, lambda k, v: ~F.map_contains_key("_new", k)), "_new"))).drop("_new")


def normalize_messages(messages: Column, system: Column | None = None) -> Column:
    """Messages (structs role, content): known roles, empty ones dropped, a system prompt in front if there is one."""
    role = lambda m: F.when(F.lower(m["role"]).isin("bot", "assistant"), "assistant").when(F.lower(m["role"]) == "system", "system").when(F.lower(m["role"]) == "tool", "tool").otherwise("user")
    clean = F.filter(F.transform(messages, lambda m: F.struct(role(m).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))), lambda m: F.trim(m["content"]) != "")
    if system is None:
        return clean
    return F.when(F.coalesce(F.trim(system), F.lit("")) != "", F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), clean)).otherwise(clean)


def tool_calls(messages: Column) -> Column:
    """All tool calls (structs name, args) of a conversation in order; missing arguments are empty."""
    calls = F.flatten(F.transform(messages, lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<struct<name:string,args:map<string,string>>>"))))
    return F.transform(calls, lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["args"], F.create_map().cast("map<string,string>")).alias("args")))


def sync_samples(rows: DataFrame, samples: DataFrame, data: str = "data") -> DataFrame:
    """Generated samples (sample_id, dataset_row_id, data) into dataset rows (row_id, row_index, data): update the row a sample names, append the others in sample order."""
    linked = samples.where(F.col("dataset_row_id").isNotNull()).groupBy(F.col("dataset_row_id").alias("row_id")).agg(F.max_by(data, "sample_id").alias("_new"))
    kept = rows.select("row_id", "row_index", data).join(linked, "row_id", "left").select("row_id", "row_index", F.coalesce("_new", data).alias(data))
    last = rows.agg(F.coalesce(F.max("row_index"), F.lit(-1)).alias("_last"), F.coalesce(F.max("row_id"), F.lit(0)).alias("_id"))
    fresh = number(samples.where(F.col("dataset_row_id").isNull()).select("sample_id", data), "sample_id", "_k").crossJoin(F.broadcast(last))  # one row
    return kept.unionByName(fresh.select((F.col("_id") + F.col("_k") + 1).alias("row_id"), (F.col("_last") + F.col("_k") + 1).alias("row_index"), data))


def document_chunks(documents: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks with their document's name and digest; those of a job's documents only."""
    return chunks.join(documents.select(key, "name", "sha256"), key)


def chunk_scope(chunks: DataFrame, samples: DataFrame, scope: str = "full", chunk: str = "chunk_id") -> DataFrame:
    """The chunks to generate for: `full` those without a selected sample, `retry_failed` those that failed or have none; none without an allocation."""
    n = samples.groupBy(chunk).agg(F.count_if("selected").alias("_n"))
    rows = chunks.where("allocated > 0").join(n, chunk, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    wanted = (F.col("_n") == 0) if scope == "full" else ((F.col("status") == "failed") | (F.col("_n") == 0))
    return rows.where(wanted).drop("_n")


def compatible(datasets: DataFrame, scenarios: DataFrame, produced: list[str]) -> DataFrame:
    """Pairs of dataset and scenario of one sample type, with the required fields that neither the dataset nor the endpoint gives."""
    both = datasets.select("dataset_id", "sample_type", "fields").join(scenarios.select("scenario_id", "sample_type", "required"), "sample_type")
    given = F.array(*map(F.lit, produced)) if produced else F.array().cast("array<string>")
    return both.select("dataset_id", "scenario_id", F.array_sort(F.array_except(F.array_except("required", "fields"), given)).alias("lacking"))
