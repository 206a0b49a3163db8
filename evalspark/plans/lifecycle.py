"""Queries of dataset, run and job life, of templates, and of custom metrics. What the tables lack is derived from ids, so that both engines agree."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from evalspark.functions import scores as S
from evalspark.functions import text as T
from evalspark.operators import judge, metrics, report, retrieval
from evalspark.operators import lifecycle as L
from evalspark.plans.common import load
from evalspark.sources import endpoint, files
from evalspark.streaming import progress

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- templates and JSON


@query(
    """SELECT o_orderkey, md5('{"query":' || to_json(o_orderpriority) || ',"opts":{"n":' || o_custkey || ',"tags":["a",' || to_json('p-' || o_orderstatus || '-' || o_custkey || '-{{zz}}') || ']},"k":3,"none":null}') AS body_md5 FROM orders"""
)
def request_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies: a text that is one variable keeps its type, a variable within a text becomes text, unknown ones stay."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("user_input"), "o_custkey", "o_orderstatus")
    template = {"query": "{{question}}", "opts": {"n": "{{row_data.o_custkey}}", "tags": ["a", "p-{{row_data.o_orderstatus}}-{{row_data.o_custkey}}-{{zz}}"]}, "k": 3, "none": None}
    return rows.select("o_orderkey", F.md5(endpoint.body(rows, template)).alias("body_md5"))


@query("""SELECT event_id, '{"a":{"b":{"c":' || event_id || '}},"k":' || json_extract_string(props, '$.k') || '}' AS whole FROM events""")
def json_path_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value set at a path of which nothing is there yet, beside what is."""
    data = T.json_map("props")
    return load(spark, sf_dir, "events").select("event_id", T.json_text(T.path_set(data, "a.b.c", F.col("event_id").cast("string"))).alias("whole"))


@query(
    """WITH v AS (SELECT event_id, [props, CAST(event_id AS VARCHAR), '[1, 2]', 'true', '"x"', 'no json', '1.5'][event_id % 7 + 1] AS v FROM events)
SELECT CASE WHEN NOT json_valid(v) THEN 'text' WHEN json_type(v) = 'ARRAY' THEN 'array' WHEN json_type(v) = 'OBJECT' THEN 'json' WHEN json_type(v) IN ('VARCHAR', 'NULL') THEN 'text' ELSE 'number' END AS type, count(*) AS n FROM v GROUP BY 1"""
)
def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [F.col("props"), F.col("event_id").cast("string"), *map(F.lit, ("[1, 2]", "true", '"x"', "no json", "1.5"))]
    rows = load(spark, sf_dir, "events").select(T.json_type(F.get(F.array(*values), (F.col("event_id") % 7).cast("int"))).alias("type"))
    return rows.groupBy("type").agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, md5(CASE WHEN length(text) > 2400 THEN left(text, 2400) || '...[truncated]' ELSE text END) AS text_md5, least(len(w), 12) AS items,
  md5(array_to_string(list_transform(w[1:12], lambda x: CASE WHEN length(x) > greatest(300, 2400 // len(w)) THEN left(x, greatest(300, 2400 // len(w))) || '...[truncated]' ELSE x END), ' ')) AS list_md5 FROM d"""
)
def payload_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and their lists of words within a judge's size budget."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", " ").alias("w"))
    words = T.budgeted("w", ty.ArrayType(ty.StringType()))
    return rows.select("doc_id", F.md5(T.budgeted("text", ty.StringType())).alias("text_md5"), F.size(words).cast("long").alias("items"), F.md5(F.array_join(words, " ")).alias("list_md5"))


@query(
    """SELECT c_custkey, CASE WHEN length(c_name) > 16 THEN left(c_name, 8) || '****' || right(c_name, 4) ELSE '****' END AS key_masked, true AS key_gone, '****' AS inner_masked, c_mktsegment AS kept FROM customer"""
)
def redact_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by field name at any depth: null, with a mask beside it."""
    inner = F.array(F.struct(F.col("c_mktsegment").alias("token_name"), F.lit("12345").alias("password")))
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("API-Key"), inner.alias("list")).alias("v"))
    kind = rows.schema["v"].dataType
    out = rows.select("c_custkey", T.redacted("v", kind).alias("r"))
    return out.select("c_custkey", F.col("r")["API-Key_masked"].alias("key_masked"), F.col("r")["API-Key"].isNull().alias("key_gone"), F.col("r.list")[0]["password_masked"].alias("inner_masked"), F.col("r.list")[0]["token_name"].alias("kept"))


# ---------------------------------------------------------------- metrics


KINDS = ("builtin_faithfulness", "code_retrieval_mrr", "numeric", "discrete", "aspect_critic", "builtin_faithfulness_claim", "unheard_of")
PROMPTS = ("score 0.2~0.8 for {user_input}", "0 或 1 {endpoint.raw}", "plain {dataset.reference} {{no}}")


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric definitions derived from parts."""
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))
    p = load(spark, sf_dir, "part")
    allowed = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("1"), F.col("p_size").cast("string")))
    return p.select("p_partkey", pick(KINDS, F.col("p_partkey")).alias("metric_type"), F.when(F.col("p_size") == 7, "context_recall").otherwise(F.col("p_name")).alias("name"), allowed.alias("allowed"), pick(PROMPTS, F.col("p_size")).alias("prompt"))


DEFINITIONS_SQL = f"""d AS (SELECT p_partkey, {list(KINDS)}[p_partkey % {len(KINDS)} + 1] AS metric_type, CASE WHEN p_size = 7 THEN 'context_recall' ELSE p_name END AS name, CASE WHEN p_size % 2 = 0 THEN ['1', p_size::VARCHAR] END AS allowed, {list(PROMPTS)}[p_size % {len(PROMPTS)} + 1] AS prompt FROM part)"""


@query(
    f"""WITH {DEFINITIONS_SQL}, e AS (SELECT *, CASE WHEN metric_type = 'builtin_faithfulness_claim' THEN 'composite' WHEN name = 'context_recall' OR metric_type = 'builtin_faithfulness' THEN 'judge' WHEN metric_type = 'code_retrieval_mrr' THEN 'code'
  WHEN metric_type IN ('numeric', 'discrete', 'aspect_critic') THEN 'custom' END AS executor FROM d)
SELECT p_partkey, executor, coalesce(executor IN ('composite', 'judge', 'custom'), false) AS sampled,
  CASE metric_type WHEN 'numeric' THEN coalesce(allowed[1], '0') || ' 到 ' || coalesce(allowed[2], '1') WHEN 'discrete' THEN array_to_string(coalesce(allowed, ['pass', 'fail']), ' / ') WHEN 'aspect_critic' THEN '0 或 1' ELSE '0 到 1' END AS score_range FROM e"""
)
def metric_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which executor a metric definition gets, whether it is sampled, and its range in words."""
    who = metrics.executor("metric_type", "name")
    return _definitions(spark, sf_dir).select("p_partkey", who.alias("executor"), metrics.is_sampled(who).alias("sampled"), metrics.score_range("metric_type", "allowed").alias("score_range"))


@query(
    f"""WITH {DEFINITIONS_SQL}, v AS (SELECT *, regexp_matches(prompt, '0\\.2~0\\.8') AS ranged, contains(prompt, '0 或 1') AS two FROM d)
SELECT p_partkey, array_to_string(list_concat(CASE WHEN metric_type = 'aspect_critic' AND ranged THEN ['aspect_with_range'] WHEN metric_type = 'numeric' AND two THEN ['numeric_with_binary'] WHEN metric_type = 'discrete' AND ranged THEN ['discrete_with_range'] ELSE [] END,
  CASE WHEN contains(prompt, 'endpoint') THEN ['no_endpoint:endpoint.raw'] WHEN contains(prompt, 'dataset') THEN ['empty:dataset.reference'] ELSE [] END), ',') AS conflicts,
  CASE WHEN contains(prompt, 'endpoint') THEN 'raw' WHEN contains(prompt, 'dataset') THEN 'reference' ELSE 'user_input' END AS excluded FROM v"""
)
def prompt_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of prompts with their metric's type and with a sample that has a user_input only; the fields that a prompt holds already."""
    rows = _definitions(spark, sf_dir).withColumn("present", F.array(F.lit("user_input")))
    return rows.select("p_partkey", F.array_join(metrics.diagnose(rows, "prompt", "present"), ",").alias("conflicts"), F.array_join(metrics.excluded_fields(metrics.variables("prompt")), ",").alias("excluded"))


class Measured:
    """A provider whose answer follows from the request: the score is the prompt's length (mod 11) / 8, as a number, a label, or nothing."""

    def answer(self, task: str, requests: list[str]) -> list[str]:
        out = []
        for r in requests:
            n = len(json.loads(r)["prompt"]) % 11
            score = {"graded": n / 8, "labelled": ("PASS", "it must fail", "none")[n % 3], "critic": n / 8}[task]
            out.append(json.dumps({"score": score, "reason": f"  {n} of 11 "}))
        return out


CUSTOMS = (
    metrics.Custom("graded", "numeric", "Grade {user_input}; dataset: {dataset.segment}, range {metric.score_range}", bounds=(0.0, 1.0), required=("user_input",)),
    metrics.Custom("labelled", "discrete", "Label {user_input}", labels=("pass", "fail")),
    metrics.Custom("critic", "aspect_critic", "Is it so: {user_input}{absent}?"),
)


@query(
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS u, c_mktsegment AS s FROM customer),
p AS (SELECT c_custkey, 'graded' AS metric, u, length('Grade ' || coalesce(u, '') || '; dataset: ' || s || ', range 0 到 1') % 11 AS n FROM c UNION ALL SELECT c_custkey, 'labelled', u, length('Label ' || coalesce(u, '')) % 11 FROM c UNION ALL SELECT c_custkey, 'critic', u, length('Is it so: ' || coalesce(u, '') || '?') % 11 FROM c)
SELECT c_custkey, metric, CASE WHEN metric = 'graded' AND u IS NOT NULL THEN round(least(1, n / 8), 4) WHEN metric = 'critic' THEN (n / 8 >= 0.5)::INT::DOUBLE END AS score, CASE WHEN metric = 'labelled' THEN [NULL, 'pass', 'fail'][CASE n % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END] END AS label,
  CASE WHEN metric = 'graded' AND u IS NULL THEN 'missing: user_input' ELSE n || ' of 11' END AS reason, CASE WHEN metric = 'labelled' AND n % 3 = 2 THEN 'no score or reason in the answer' END AS error FROM p"""
)
def custom_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric, discrete and aspect metrics by a provider whose answers are known."""
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("user_input"), F.col("c_mktsegment").alias("segment"))
    out = None
    for m in CUSTOMS:
        one = metrics.custom_judge(rows, ["c_custkey"], m, Measured())
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 WHEN l_partkey % 2 = l_suppkey % 2 THEN 1.0 ELSE 0.5 END AS one_call, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 WHEN l_partkey % 2 = l_suppkey % 2 THEN 0.75 ELSE 0.5 END AS two_calls FROM lineitem"""
)
def argument_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with two arguments of which one always agrees; the second expected call finds what the first has left."""
    args = lambda k: F.create_map(F.lit("x"), F.col("l_linenumber").cast("string"), F.lit("y"), (F.col(k) % 2).cast("string"))
    call = lambda name, a: F.struct(name.alias("name"), a.alias("args"))
    same = F.when(F.col("l_linenumber") % 3 == 0, "other").otherwise("f")
    other = F.create_map(F.lit("x"), F.col("l_linenumber").cast("string"), F.lit("y"), F.lit("?"))
    rows = load(spark, sf_dir, "lineitem")
    one = S.argument_correctness(F.array(call(F.lit("f"), args("l_partkey"))), F.array(call(same, args("l_suppkey"))))
    two = S.argument_correctness(F.array(call(F.lit("f"), args("l_partkey")), call(F.lit("f"), args("l_partkey"))), F.array(call(same, other), call(same, args("l_suppkey"))))
    return rows.select("l_orderkey", "l_linenumber", one.alias("one_call"), two.alias("two_calls"))


# ---------------------------------------------------------------- listings and joins


@query(
    """SELECT o_orderkey, o_custkey, c_name AS customer_name, n_name AS nation_name, count(*) OVER () AS total, (o_orderkey // 50 + 1)::BIGINT AS page FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0 LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY o_orderkey LIMIT 50 OFFSET 100"""
)
def tasks_with_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of orders (the page is the feature) with the names of what they refer to; a third of the customers is missing."""
    customers = load(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("name"))
    tasks = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id")).join(customers.select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("nation_id")), "customer_id", "left")
    named = L.with_dimensions(tasks, customer=customers.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name")), nation=nations)
    page = L.page_with_total(named, [F.col("o_orderkey")], 50, 100)
    return page.select("o_orderkey", F.col("customer_id").alias("o_custkey"), "customer_name", "nation_name", "total", L.page_of("o_orderkey", 50).alias("page"))


@query(
    """SELECT l_orderkey AS dataset_id, l_linenumber AS row_index, l_partkey FROM lineitem WHERE l_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderpriority LIKE '%URGENT%') ORDER BY l_linenumber LIMIT 3"""
)
def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a dataset by its name (a limit is the feature): orders are datasets, the first urgent one has the name."""
    o = load(spark, sf_dir, "orders")
    first = L.latest(o.where(F.col("o_orderpriority").like("%URGENT%")).select("o_orderkey"), [F.col("o_orderkey")]).withColumn("name", F.lit("urgent"))
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dataset_id"), F.col("l_linenumber").alias("row_index"), "l_partkey")
    return L.dataset_rows(rows, first.withColumnRenamed("o_orderkey", "dataset_id"), name="urgent", limit=3)


@query("SELECT p::INT AS position, doc_id, n_chars FROM (VALUES (0, 5), (1, 3), (2, 8)) k(p, id) JOIN documents ON doc_id = id")
def key_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a list of keys, in its order, repeated keys once."""
    return files.keyed(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), [5, 3, 8, 5], "doc_id").select("position", "doc_id", "n_chars")


@query(
    """SELECT c_custkey AS scenario_id, CASE WHEN c_custkey % 5 <> 0 THEN p_brand END AS metric, CASE WHEN c_custkey % 5 <> 0 THEN (p_partkey % 10) / 10 END AS threshold FROM customer LEFT JOIN (SELECT p_partkey, p_brand FROM part WHERE p_partkey < 20) p ON p_partkey % 4 = c_custkey % 4 AND c_custkey % 5 <> 0"""
)
def scenario_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios (customers) with their metrics (some parts); every fifth has none."""
    parts = load(spark, sf_dir, "part").where("p_partkey < 20")
    scenarios = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scenario_id"))
    some = scenarios.where("scenario_id % 5 <> 0").withColumn("m", F.col("scenario_id") % 4)
    links = some.join(parts.select((F.col("p_partkey") % 4).alias("m"), F.col("p_partkey").alias("metric_id"), ((F.col("p_partkey") % 10) / 10).alias("threshold")), "m").drop("m")
    definitions = parts.select(F.col("p_partkey").alias("metric_id"), F.col("p_brand").alias("metric"), F.col("p_type").alias("metric_type"))
    return L.scenario_metrics(scenarios, links, definitions).select("scenario_id", "metric", "threshold")


@query("""SELECT l_linestatus AS status, p_type, count(*) AS n FROM lineitem JOIN part ON p_partkey // 4 = l_partkey // 4 GROUP BY ALL""")
def scoring_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with every metric (four) of its scenario, counted."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), F.expr("l_partkey div 4").alias("scenario_id"))
    definitions = load(spark, sf_dir, "part").select(F.expr("p_partkey div 4").alias("scenario_id"), "p_type", "p_partkey")
    return L.scoring_grid(rows, definitions).groupBy("status", "p_type").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT s_suppkey AS run, s_nationkey % 3 AS dataset_id, s_nationkey % 2 AS scenario_id FROM supplier WHERE s_suppkey % 4 <> 0), m AS (SELECT s_suppkey AS run, [unnest([s_suppkey % 2, s_suppkey % 3])] AS x FROM supplier),
s AS (SELECT run, list_sort(list_distinct(list(x[1]))) AS ms FROM m GROUP BY run), c AS (SELECT r.*, ms FROM r JOIN s USING (run))
SELECT a.run, b.run AS other FROM c a JOIN c b ON a.dataset_id = b.dataset_id AND a.scenario_id = b.scenario_id AND a.ms = b.ms AND a.run <> b.run"""
)
def comparable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (suppliers) that may be compared with each other: the pairs are the result."""
    s = load(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "run")
    runs = s.select("run", (F.col("s_nationkey") % 3).alias("dataset_id"), (F.col("s_nationkey") % 2).alias("scenario_id"), F.when(F.col("run") % 4 != 0, "completed").otherwise("failed").alias("status"))
    each = s.select("run", F.explode(F.array(F.col("run") % 2, F.col("run") % 3)).alias("metric"))
    return L.comparable(runs, each)


@query("""SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand)), 'widget') AND p_type = 'ECONOMY'""")
def metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.searched(load(spark, sf_dir, "part"), " Widget ", ["p_name", "p_brand"], p_type="ECONOMY").select("p_partkey", "p_name", "p_type")


# ---------------------------------------------------------------- seeds, schemas, indexes


@query(
    """SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, upper(p_name), p_size FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0"""
)
def seed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds (even parts) beside what is there (every third): known keys stay as they are."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return L.upsert(p.where("p_partkey % 3 = 0"), p.where("p_partkey % 2 = 0").withColumn("p_name", F.upper("p_name")), ["p_partkey"])


@query(
    """WITH d AS (SELECT * FROM (VALUES ('event_type', 'text', true, 1), ('value', 'number', false, 2)) t(name, type, required, position)),
f AS (SELECT name, min(json_extract(props, '$.' || name)::VARCHAR) AS v FROM (SELECT unnest(json_keys(props)) AS name, props FROM events) GROUP BY name UNION ALL SELECT event_type, min('[' || user_id || ']') FROM events GROUP BY 1 UNION ALL SELECT 'value', '"x"'),
n AS (SELECT name, CASE WHEN v[1] = '[' THEN 'array' WHEN v[1] = '{' THEN 'json' WHEN v[1] = '"' THEN 'text' ELSE 'number' END AS type, row_number() OVER (ORDER BY name) AS p FROM f WHERE name NOT IN (SELECT name FROM d))
SELECT * FROM d UNION ALL SELECT name, type, false, (2 + p)::INT FROM n"""
)
def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the rows' JSON has beyond the declared ones, with inferred types."""
    declared = spark.createDataFrame([("event_type", "text", True, 1), ("value", "number", False, 2)], "name string, type string, required boolean, position int")
    found = load(spark, sf_dir, "events").select(F.explode(F.map_concat(T.json_map("props"), F.create_map(F.col("event_type"), F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]")), F.lit("value"), F.lit('"x"')))).alias("name", "value"))
    return L.merge_fields(declared, found)


@query(
    """SELECT origin, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT 'kb' AS origin, item_id AS doc_id FROM benchmark UNION ALL (SELECT 'distractor', doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20) UNION ALL (SELECT 'hard', doc_id FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 5)) GROUP BY origin"""
)
def index_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge base with the first distractors and hard negatives (first-n is the feature)."""
    d = load(spark, sf_dir, "documents")
    of = lambda lang: d.where(F.col("lang") == lang).select("doc_id", "text")
    both = L.index_corpus(load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), of("en"), of("de"), 20, 5)
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.quality, -1) AS platform, coalesce(b.toxic, -1) AS external FROM (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, toxic FROM labels WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id""")
def zipped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of scores by the number of their row."""
    r = load(spark, sf_dir, "labels")
    return L.zip_rows(r.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("platform")), r.where("doc_id % 5 <> 0").select("doc_id", F.col("toxic").alias("external")), ["doc_id"]).fillna(-1)


@query("""SELECT l_linenumber AS chunk_id, count(DISTINCT l_orderkey) AS n_samples FROM lineitem JOIN nation ON n_nationkey = l_linenumber AND n_nationkey % 2 = 1 GROUP BY 1""")
def chunk_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples (orders) by the chunks (every other nation, by number) that they name in their lines."""
    samples = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.collect_list(F.col("l_linenumber").cast("long")).alias("source_chunk_ids"))
    chunks = load(spark, sf_dir, "nation").where("n_nationkey % 2 = 1").select(F.col("n_nationkey").cast("long").alias("chunk_id"))
    return L.samples_of(chunks, samples).groupBy(F.col("chunk_id").cast("int").alias("chunk_id")).agg(F.count("*").alias("n_samples"))


@query(
    """SELECT metric, origin, count(*) AS n, round(avg(score), 6) AS mean FROM (SELECT 'a' AS metric, 'first' AS origin, CAST(l_quantity AS DOUBLE) AS score FROM lineitem UNION ALL SELECT 'b', 'first', l_tax FROM lineitem UNION ALL SELECT 'c', 'second', l_discount FROM lineitem) GROUP BY 1, 2"""
)
def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports on the same rows: of the second only the metrics named, and that the first lacks."""
    rows = load(spark, sf_dir, "lineitem")
    part = lambda m, c: rows.select(F.lit(m).alias("metric"), "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"), F.col(c).cast("double").alias("score"))
    first, second = part("a", "l_quantity").unionByName(part("b", "l_tax")), part("b", "l_quantity").unionByName(part("c", "l_discount")).unionByName(part("d", "l_tax"))
    found = L.merge_reports(first, second, ["l_orderkey", "l_linenumber", "kind"], ["b", "c"])
    return found.groupBy("metric", "origin").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(
    """WITH t AS (SELECT item_id, lower(regexp_replace(text, '\\s', '', 'g')) AS s FROM benchmark), d AS (SELECT doc_id, lower(regexp_replace(text, '\\s', '', 'g')) AS s FROM documents),
a AS (SELECT DISTINCT item_id, substr(s, i, 5) AS gram FROM t, generate_series(1, greatest(length(s) - 4, 1)) r(i) WHERE s <> ''), n AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1),
b AS (SELECT DISTINCT doc_id, substr(s, i, 5) AS gram FROM d, generate_series(1, greatest(length(s) - 4, 1)) r(i) WHERE s <> '' AND substr(s, i, 5) IN (SELECT gram FROM a)),
o AS (SELECT item_id, doc_id, round(count(*) / any_value(n), 4) AS overlap FROM a JOIN b USING (gram) JOIN n USING (item_id) GROUP BY 1, 2), k AS (SELECT t.item_id, coalesce(max(overlap), 0) AS overlap FROM t LEFT JOIN o USING (item_id) GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (overlap >= 0.8) AS contaminated, round(count(*) FILTER (overlap >= 0.8) / count(*), 4) AS share, max(overlap) AS highest FROM k"""
)
def contamination_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.contamination_tally(retrieval.ngram_overlap(load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents")))


# ---------------------------------------------------------------- reviews, jobs


STATES = ("pass", "fail", "needs_fix", "needs_review", "?")


@query(
    f"""WITH r AS (SELECT lang, CASE WHEN doc_id % 7 <> 0 THEN {list(STATES)}[doc_id % 5 + 1] END AS s FROM documents)
SELECT lang, count(s) AS reviewed, count(*) FILTER (s = 'pass') AS manual_pass, count(*) FILTER (s = 'fail') AS manual_fail, count(*) FILTER (s = 'needs_fix') AS manual_needs_fix, count(*) FILTER (s = 'needs_review') AS manual_needs_review FROM r GROUP BY lang"""
)
def manual_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.get(F.array(*map(F.lit, STATES)), (F.col("doc_id") % 5).cast("int"))
    return L.review_counts(load(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 7 != 0, state).alias("manual_status")), "lang")


@query(
    """WITH s AS (SELECT l_returnflag AS metric, l_suppkey % 10 AS run, CASE WHEN l_suppkey % 10 < 5 THEN round(avg(l_tax), 4) END AS stored, round(avg((l_discount * 10 >= 0.7)::INT), 4) AS rate FROM lineitem GROUP BY 1, 2) SELECT run, metric, coalesce(stored, rate) AS pass_rate FROM s"""
)
def pass_rate_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the runs have no stored pass rate: it comes from their scores, at the default threshold."""
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("run"), F.col("l_returnflag").alias("metric"), (F.col("l_discount") * 10).alias("score"), F.lit(None).cast("double").alias("threshold"), "l_tax")
    stored = rows.groupBy("run", "metric").agg(F.round(F.avg("l_tax"), 4).alias("t")).select("run", "metric", F.when(F.col("run") < 5, F.col("t")).alias("pass_rate"))
    return L.backfilled(stored, report.metric_summary(rows, "run", "metric"), ["run", "metric"])


@query(
    """WITH j AS (SELECT c_custkey AS job_id FROM customer), s AS (SELECT o_custkey AS job_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS failed FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1),
d AS (SELECT o_custkey AS job_id, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT o_custkey AS job_id, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT job_id, coalesce(total, 0) AS total_samples, coalesce(done, 0) AS completed_samples, coalesce(failed, 0) AS failed_samples, coalesce(d.n, 0) AS total_documents, coalesce(c.n, 0) AS total_chunks,
  CASE WHEN coalesce(done, 0) = 0 THEN 'failed' WHEN failed = 0 THEN 'completed' ELSE 'partial' END AS job_status FROM j LEFT JOIN s USING (job_id) LEFT JOIN d USING (job_id) LEFT JOIN c USING (job_id)"""
)
def job_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs are customers, documents and samples their orders, chunks the lines."""
    o = load(spark, sf_dir, "orders")
    jobs = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))
    documents = o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("document_id"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    samples = o.select(F.col("o_custkey").alias("job_id"), (F.col("o_orderkey") % 4 != 0).alias("selected"), status.alias("status"))
    return L.recount(jobs, documents, load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id")), samples)


@query(
    """WITH j AS (SELECT user_id AS job_id, CASE WHEN user_id % 3 <> 2 THEN 'running' ELSE 'completed' END AS status, CASE WHEN user_id % 4 <> 0 THEN min(ts) END AS started_at, max(ts) AS updated_at, count(*) FILTER (event_type = 'purchase') AS completed_samples FROM events GROUP BY user_id),
r AS (SELECT *, status = 'running' AND epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(date_trunc('second', coalesce(started_at, updated_at))) >= 86400 AS stale FROM j)
SELECT job_id, CASE WHEN stale THEN CASE WHEN completed_samples = 0 THEN 'failed' ELSE 'partial' END ELSE status END AS status, stale FROM r"""
)
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs are users; those that began over a day before a fixed time are over."""
    e = load(spark, sf_dir, "events")
    jobs = e.groupBy(F.col("user_id").alias("job_id")).agg(F.min("ts").alias("a"), F.max("ts").alias("updated_at"), F.count_if(F.col("event_type") == "purchase").alias("completed_samples"))
    jobs = jobs.select("job_id", F.when(F.col("job_id") % 3 != 2, "running").otherwise("completed").alias("status"), F.when(F.col("job_id") % 4 != 0, F.col("a")).alias("started_at"), "updated_at", F.lit(None).cast("timestamp").alias("created_at"), "completed_samples")
    return L.recovered_jobs(jobs, F.lit("2024-01-30 00:00:00").cast(jobs.schema["updated_at"].dataType), 86400).select("job_id", "status", "stale")


@query(
    """WITH r AS (SELECT user_id AS run, ['pending', 'running', 'completed'][user_id % 3 + 1] AS status, min(ts) AS started_at, max(CASE WHEN event_type <> 'error' THEN ts END) AS beat FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT run, CASE WHEN status <> 'completed' AND started_at < now - INTERVAL 12 HOUR AND (beat IS NULL OR beat < now - INTERVAL 6 HOUR) THEN 'failed' ELSE status END AS status FROM r, n"""
)
def recovered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without a heartbeat are marked as failed; the present time is a one-row table of its own."""
    e = load(spark, sf_dir, "events")
    status = F.get(F.array(F.lit("pending"), F.lit("running"), F.lit("completed")), (F.col("user_id") % 3).cast("int")).alias("status")
    runs = e.groupBy("user_id").agg(F.min("ts").alias("started_at")).select(F.col("user_id").alias("run"), status, "started_at")
    runs = runs.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    beats = e.where("event_type <> 'error'").select(F.col("user_id").alias("run"), "ts")
    return progress.recovered(runs, beats, F.col("now"), "run", "12 hours", "6 hours").select("run", "status")


@query(
    """SELECT o_orderkey AS sample_id, md5('{"user_input":"' || o_orderpriority || '","reference":"' || o_orderstatus || '","reference_context_ids":[],"source_chunk_ids":["' || o_custkey || '"],"source_document_names":' || CASE WHEN o_orderkey % 2 = 0 THEN '["d"]' ELSE '[]' END || ',"generation_meta":{"sample_id":' || o_orderkey || ',"job_id":' || o_custkey || ',"chunk_id":' || o_custkey || '}}') AS row_md5 FROM orders"""
)
def sample_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset rows of generated samples (orders)."""
    s = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("job_id"), F.col("o_custkey").alias("chunk_id"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("reference"),
        F.lit(None).cast("array<string>").alias("reference_context_ids"), F.array(F.col("o_custkey").cast("string")).alias("source_chunk_ids"), F.when(F.col("o_orderkey") % 2 == 0, "d").alias("document_name"),
    )
    return s.select("sample_id", F.md5(L.sample_payload(s)).alias("row_md5"))


class Writer:
    """A provider that makes the wanted number of questions out of a chunk's length; every third has no reference."""

    def answer(self, task: str, requests: list[str]) -> list[str]:
        made = []
        for r in map(json.loads, requests):
            items = [{"question": f" q{k % 4} of {len(r['content']) % 50} ", "reference": "" if k % 3 == 2 else f"r{k}"} for k in range(r["n"])]
            made.append(json.dumps({"items": items}))
        return made


@query(
    """WITH c AS (SELECT doc_id AS chunk_id, n_chars % 4 AS w, least(length(text), 12000) % 50 AS len FROM documents WHERE n_chars % 4 > 0), k AS (SELECT chunk_id, w, len, unnest(range(w + least(3, greatest(1, w)))) AS k FROM c),
u AS (SELECT chunk_id, w, len, min(k) AS k FROM k WHERE k % 3 <> 2 GROUP BY chunk_id, w, len, k % 4), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY k) AS n FROM u)
SELECT chunk_id, 'q' || (k % 4) || ' of ' || len AS question, 'r' || k AS reference FROM r WHERE n <= w"""
)
def generated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More questions than wanted are asked for; blank and repeated ones go, the wanted number stays."""
    chunks = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"), (F.col("n_chars") % 4).alias("allocated"))
    made = L.generated(chunks, Writer()).where("error IS NULL")
    verdicts = made.sparkSession.createDataFrame([], "chunk_id long, question string, keep boolean, score double")
    kept = judge.select_questions(made, verdicts, "chunk_id", "position")
    return kept.join(made.select("chunk_id", "position", "reference"), ["chunk_id", "position"]).select("chunk_id", "question", "reference")


@query("""SELECT user_id, md5(string_agg('[' || strftime(ts, '%H:%M:%S') || '] ' || event_type, chr(10) ORDER BY event_id)) AS log_md5, array_to_string(list(event_type ORDER BY event_id DESC)[1:2], ',') AS last_two FROM events GROUP BY user_id""")
def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as one text a run, and its last lines."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts"))
    found = L.logs(e, "user_id", "ts", "event_id", "event_type")
    tail = F.transform(F.reverse(L.last_lines("log", 2)), lambda x: F.regexp_replace(x, r"^\[.{8}\] ", ""))
    return found.select("user_id", F.md5("log").alias("log_md5"), F.array_join(tail, ",").alias("last_two"))


# ---------------------------------------------------------------- exports


@query(
    '''SELECT md5(chr(65279) || 'c_custkey,c_name,tags' || chr(10) || string_agg(c_custkey || ',' || '"a ""' || c_name || '"""' || ',"[""' || c_mktsegment || '""]"', chr(10) ORDER BY c_custkey)) AS file_md5, count(*) + 1 AS n_lines FROM customer'''
)
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a CSV file with a byte order mark; they are gathered here for a digest only."""
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('a "'), "c_name", F.lit('"')).alias("c_name"), F.array("c_mktsegment").alias("tags"))
    lines = L.csv_lines(rows, ["c_custkey", "c_name", "tags"], "c_custkey")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "c_custkey", "value"))), lambda x: x["value"]), "\n")
    return lines.agg(F.md5(whole).alias("file_md5"), F.count("*").alias("n_lines"))


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a JSON array, gathered (25 rows) and read back."""
    rows = load(spark, sf_dir, "nation").withColumn("row_index", F.col("n_nationkey"))
    lines = L.json_lines(rows, "row_index")
    whole = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "row_index", "value"))), lambda x: x["value"]), "\n").alias("t"))
    return whole.select(F.explode(F.from_json("t", "array<struct<n_nationkey:int,n_name:string,n_regionkey:int>>")).alias("x")).select("x.*")
