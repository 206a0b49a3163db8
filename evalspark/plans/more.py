"""Queries of sources, corpora, judge answers and sample selection. What the tables lack is derived from ids, so that both engines agree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions import scores as S
from evalspark.functions import text as T
from evalspark.operators import ingest, judge, retrieval
from evalspark.operators import lifecycle as L
from evalspark.plans.common import load, shared_dir
from evalspark.plans.datasets import BM25_SQL, RAG_SQL, TOKENS_SQL
from evalspark.sources import endpoint, files

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- sources


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal, 'a \"q\"' || chr(10) || c_name AS note FROM customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV and read back with inferred types: quoted line ends stay, NaN is null."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).otherwise(F.lit(float("nan"))).alias("c_acctbal"), F.concat(F.lit('a "q"\n'), "c_name").alias("note"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_csv(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "note")


@query("SELECT s_suppkey, s_name, (row_number() OVER (ORDER BY s_suppkey) - 1)::INT AS position FROM supplier")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exported JSON array read back as rows, in its order."""
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    L.write_lines(L.json_lines(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_index"), "s_name", F.col("s_suppkey").alias("key")), "row_index"), path, "row_index")
    rows = files.read_json_rows(spark, path)
    return rows.select(F.try_variant_get("row", "$.key", "bigint").alias("s_suppkey"), F.try_variant_get("row", "$.s_name", "string").alias("s_name"), "position")


@query(
    """WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[。！？\\n]+')) AS x FROM documents), t AS (SELECT doc_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM s) SELECT doc_id, count(*) AS n, max(length(x)) AS longest FROM t WHERE length(x) >= 10 GROUP BY doc_id"""
)
def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.sentences(load(spark, sf_dir, "documents"), "doc_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("sentence")).cast("long").alias("longest"))


@query(
    """WITH s AS (SELECT page_id, unnest(regexp_split_to_array(replace(html, '<p>', chr(10) || chr(10) || '# '), '\\n{2,}')) AS x FROM pages), t AS (SELECT page_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM s) SELECT page_id, count(*) AS n, count(*) FILTER (NOT starts_with(x, '#') AND NOT starts_with(x, '---')) AS body FROM t WHERE length(x) >= 20 GROUP BY page_id"""
)
def corpus_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of pages, and how many are no preamble (here: what doesn't begin a marked paragraph)."""
    texts = load(spark, sf_dir, "pages").select("page_id", F.replace(F.col("html"), F.lit("<p>"), F.lit("\n\n# ")).alias("text"))
    parts = files.paragraphs(texts, "page_id")
    body = files.without_preamble(parts).groupBy("page_id").agg(F.count("*").alias("body"))
    return parts.groupBy("page_id").agg(F.count("*").alias("n")).join(body, "page_id", "left").fillna(0, ["body"])


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity * 20 AS y0, l_quantity * 20 + 10 AS y1, CASE WHEN l_suppkey % 2 = 0 THEN '第 ' || l_linenumber || ' 页' ELSE 'words of a body ' || l_linenumber END AS text, l_linenumber * 100.0 AS w FROM lineitem)
SELECT l_orderkey, l_linenumber FROM b WHERE NOT ((y1 < 120 OR y0 > 880) AND starts_with(text, '第')) AND NOT (length(text) / (w * 10) < 0.015 AND length(text) < 24)"""
)
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page at derived places: headers in the margins go, thin short blocks too."""
    y = F.col("l_quantity") * 20
    text = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("第 "), F.col("l_linenumber").cast("string"), F.lit(" 页"))).otherwise(F.concat(F.lit("words of a body "), F.col("l_linenumber").cast("string")))
    blocks = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", y.alias("y0"), (y + 10).alias("y1"), F.lit(1000.0).alias("page_height"), (F.col("l_linenumber") * 100.0).alias("width"), F.lit(10.0).alias("height"), text.alias("text"))
    return files.body_blocks(blocks).select("l_orderkey", "l_linenumber")


# ---------------------------------------------------------------- answers


@query(
    """WITH e AS (SELECT event_id, event_id % 5 AS k, event_id % 100 AS n FROM events)
SELECT event_id, CASE k WHEN 0 THEN n / 100 WHEN 1 THEN -n::DOUBLE WHEN 2 THEN 1 END AS score, CASE WHEN k < 3 THEN 'why ' || n END AS reason, CASE WHEN k < 3 THEN 'a' || n ELSE raw END AS response, CASE WHEN k < 3 THEN '' ELSE 'docs,response' END AS missing, 'whatisit' || n AS question
FROM (SELECT *, CASE k WHEN 3 THEN 'no json ' || n ELSE '[' || n || ']' END AS raw FROM e)"""
)
def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as judges give them: plain JSON, JSON within words, neither, and a list."""
    n = (F.col("event_id") % 100).cast("string")
    body = lambda score: F.concat(F.lit('{"score": '), score, F.lit(', "reason": "  why '), n, F.lit(' ", "data": {"answer": "a'), n, F.lit('", "docs": [1]}}'))
    kinds = [body((F.col("event_id") % 100 / 100).cast("string")), F.concat(F.lit("so: "), body(F.concat(F.lit('"it is -'), n, F.lit(' of 9"'))), F.lit(" end")), body(F.lit("true")), F.concat(F.lit("no json "), n), F.concat(F.lit("["), n, F.lit("]"))]
    rows = load(spark, sf_dir, "events").select("event_id", n.alias("n"), F.get(F.array(*kinds), (F.col("event_id") % 5).cast("int")).alias("answer"))
    found = rows.withColumn("j", T.json_object("answer"))
    paths = {"docs": "data.docs.0", "response": "data.answer"}
    response = endpoint.fields(F.coalesce("j", "answer"), {"response": "data.answer"})[0]
    return found.select("event_id", T.coerce_float(T.path_get("j", "score")).alias("score"), T.clean_reason(T.path_get("j", "reason")).alias("reason"), response, F.array_join(endpoint.errors(F.coalesce("j", "answer"), paths), ",").alias("missing"), T.question_key(F.concat(F.lit(" What  is\nIT "), "n")).alias("question"))


@query(
    """WITH m AS (SELECT conv_id, list(struct_pack(t := turn, k := turn % 3) ORDER BY turn) AS ms FROM conversations GROUP BY conv_id) SELECT conv_id, len(list_filter(ms, lambda m: m.k <> 2)) AS n_calls, coalesce(array_to_string(list_transform(list_filter(ms, lambda m: m.k <> 2), lambda m: 'f' || m.t || CASE WHEN m.k = 0 THEN '' ELSE '(x)' END), ','), '') AS calls FROM m"""
)
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a conversation's messages in order: derived ones, a third of the messages without any, a third without arguments."""
    args = lambda t: F.when(t % 3 == 1, F.create_map(F.lit("x"), F.lit("1"))).cast("map<string,string>")
    call = lambda t: F.when(t % 3 != 2, F.array(F.struct(F.concat(F.lit("f"), t.cast("string")).alias("name"), args(t).alias("args"))))
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("ts"))
    rows = turns.select("conv_id", F.transform("ts", lambda t: F.struct(call(t).alias("tool_calls"))).alias("ms"))
    found = rows.select("conv_id", ingest.tool_calls(F.col("ms")).alias("c"))
    shown = F.transform("c", lambda c: F.concat(c["name"], F.when(F.size(c["args"]) > 0, F.concat(F.lit("("), F.array_join(F.map_keys(c["args"]), ","), F.lit(")"))).otherwise("")))
    return found.select("conv_id", F.size("c").cast("long").alias("n_calls"), F.array_join(shown, ",").alias("calls"))


@query("""SELECT l_orderkey, l_linenumber, 'q' AS u, l_shipdate::DATE::VARCHAR || ',' || l_returnflag AS reversed FROM lineitem""")
def swapped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample with its lists reversed."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("q").alias("u"), F.array("l_returnflag", F.col("l_shipdate").cast("date").cast("string")).alias("x"))
    return judge.swap_lists(rows).select("l_orderkey", "l_linenumber", "u", F.array_join("x", ",").alias("reversed"))


@query("""SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 1 - abs(round(l_discount * 7, 4) - l_tax * 9))), 4) AS consistency, round((l_discount * l_tax + 1) / (sqrt(l_discount * l_discount + 1) * sqrt(l_tax * l_tax + 1)), 6) AS cosine FROM lineitem""")
def swap_and_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistency of a score with the swapped one; the cosine of short vectors, of which one is longer."""
    one = F.array(F.col("l_discount"), F.lit(1.0), F.lit(5.0))
    two = F.array(F.col("l_tax"), F.lit(1.0))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.swap_consistency(F.col("l_discount") * 7, F.col("l_tax") * 9).alias("consistency"), F.round(S.cosine(one, two), 6).alias("cosine"))


# ---------------------------------------------------------------- retrieval


@query(
    f"""WITH {RAG_SQL}, s AS (SELECT row_id, u, unnest(list_filter(regexp_split_to_array(r, '[。；\\n]+'), lambda x: trim(x) <> '')) AS s FROM q), k AS (SELECT row_id, list_distinct({TOKENS_SQL.format('s')}) AS tok, list_filter(regexp_split_to_array(u, '[。；\\n]+'), lambda x: trim(x) <> '') AS cs FROM s),
h AS (SELECT row_id, coalesce(list_bool_or(list_transform(cs, lambda c: len(list_intersect(tok, {TOKENS_SQL.format('c')})) >= 0.4 * len(tok) AND len(tok) > 0)), false) AS hit FROM k)
SELECT q.row_id, round(coalesce(avg(hit::INT), 0), 4) AS rule_recall FROM q LEFT JOIN h ON q.row_id = h.row_id GROUP BY 1"""
)
def rule_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of an answer that the question covers."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    turns = load(spark, sf_dir, "conversations").withColumn("r", F.lead("text").over(own)).where("role = 'user'")
    rows = turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"), F.array("text").alias("contexts"), "r")
    return retrieval.rule_recall(rows, "row_id", "r", "contexts")


@query(
    "WITH "
    + BM25_SQL.format(docs=f"SELECT item_id AS doc_id, {TOKENS_SQL.format('text')} AS tok FROM benchmark", queries=f"SELECT item_id AS query_id, {TOKENS_SQL.format('left(text, 60)')} AS tok FROM benchmark")
    + """, g AS (SELECT q.query_id, q.query_id % 3 AS kind, min(rank) FILTER (k.doc_id = q.query_id) AS pos FROM q LEFT JOIN k ON k.query_id = q.query_id AND rank <= 5 GROUP BY 1, 2)
SELECT kind, count(*) AS n, round(avg(coalesce(pos <= 1, false)::INT), 4) AS h1, round(avg(coalesce(pos <= 3, false)::INT), 4) AS h3, round(avg((pos IS NOT NULL)::INT), 4) AS hk, round(avg(coalesce(1 / pos, 0)), 4) AS mrr FROM g GROUP BY kind"""
)
def retrieval_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings of benchmark texts look for the whole ones (a query's form is the feature), by kind."""
    b = load(spark, sf_dir, "benchmark")
    queries = b.select(F.col("item_id").alias("query_id"), F.substring("text", 1, 60).alias("text"), F.array("item_id").alias("gold"), (F.col("item_id") % 3).alias("kind"))
    hits = retrieval.bm25(b.select(F.col("item_id").alias("doc_id"), "text"), queries)
    return retrieval.retrieval_means(hits, queries, by=("kind",))


# ---------------------------------------------------------------- datasets and samples


@query(
    """WITH d AS (SELECT c_custkey AS dataset_id, c_nationkey % 3 AS t, CASE WHEN c_custkey % 2 = 0 THEN ['a', 'b'] ELSE ['a'] END AS f FROM customer), s AS (SELECT n_nationkey AS scenario_id, n_nationkey % 3 AS t, CASE WHEN n_nationkey % 2 = 0 THEN ['a', 'b', 'c'] ELSE ['d', 'b'] END AS r FROM nation)
SELECT dataset_id, scenario_id, array_to_string(list_sort(list_filter(r, lambda x: NOT list_contains(f, x) AND x <> 'c')), ',') AS lacking FROM d JOIN s USING (t)"""
)
def dataset_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a scenario needs and neither its dataset nor the endpoint gives."""
    names = lambda *xs: F.array(*map(F.lit, xs))
    d = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dataset_id"), (F.col("c_nationkey") % 3).alias("sample_type"), F.when(F.col("c_custkey") % 2 == 0, names("a", "b")).otherwise(names("a")).alias("fields"))
    s = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scenario_id"), (F.col("n_nationkey") % 3).alias("sample_type"), F.when(F.col("n_nationkey") % 2 == 0, names("a", "b", "c")).otherwise(names("d", "b")).alias("required"))
    return ingest.compatible(d, s, ["c"]).select("dataset_id", "scenario_id", F.array_join("lacking", ",").alias("lacking"))


@query(
    """WITH c AS (SELECT o_orderkey AS chunk_id, o_orderkey % 3 AS allocated, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'done' END AS status FROM orders), s AS (SELECT l_orderkey AS chunk_id, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1)
SELECT chunk_id, 'full' AS scope FROM c LEFT JOIN s USING (chunk_id) WHERE allocated > 0 AND coalesce(n, 0) = 0 UNION ALL SELECT chunk_id, 'retry_failed' FROM c LEFT JOIN s USING (chunk_id) WHERE allocated > 0 AND (status = 'failed' OR coalesce(n, 0) = 0)"""
)
def generation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks (orders) to generate for, in both scopes."""
    chunks = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderkey") % 3).alias("allocated"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"))
    samples = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), (F.col("l_returnflag") == "R").alias("selected"))
    scoped = lambda s: ingest.chunk_scope(chunks, samples, s).select("chunk_id", F.lit(s).alias("scope"))
    return scoped("full").unionByName(scoped("retry_failed"))


@query(
    """WITH r AS (SELECT p_partkey AS row_id, p_partkey AS row_index, p_name AS data FROM part WHERE p_partkey % 2 = 0), s AS (SELECT p_partkey AS sample_id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey END AS dataset_row_id, upper(p_name) AS data FROM part WHERE p_partkey % 3 = 0)
SELECT r.row_id, r.row_index, coalesce(s.data, r.data) AS data FROM r LEFT JOIN s ON s.dataset_row_id = r.row_id
UNION ALL SELECT (SELECT max(row_id) FROM r) + row_number() OVER (ORDER BY sample_id), (SELECT max(row_index) FROM r) + row_number() OVER (ORDER BY sample_id), data FROM s WHERE dataset_row_id IS NULL"""
)
def synced_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples update the rows that they name; the others are appended in their order."""
    p = load(spark, sf_dir, "part")
    rows = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("row_index"), F.col("p_name").alias("data"))
    samples = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("sample_id"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey")).alias("dataset_row_id"), F.upper("p_name").alias("data"))
    return ingest.sync_samples(rows, samples)


@query(
    """SELECT event_id, '{"event":"' || event_type || '","k":"' || CASE WHEN event_id % 2 = 0 THEN 'new' ELSE json_extract_string(props, '$.k') END || '"' || CASE WHEN event_id % 2 = 0 THEN ',"z":"1"' ELSE '' END || '}' AS data FROM events"""
)
def written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted fields merged into rows: the new value wins, rows without any stay."""
    e = load(spark, sf_dir, "events")
    rows = e.select("event_id", F.create_map(F.lit("event"), F.col("event_type"), F.lit("k"), T.path_get("props", "k")).alias("data"))
    found = e.where("event_id % 2 = 0").select("event_id", F.create_map(F.lit("k"), F.lit("new"), F.lit("z"), F.lit("1")).alias("data"))
    merged = ingest.write_back(rows, found, "event_id")
    return merged.select("event_id", T.json_text(F.transform_values("data", lambda k, v: T.quoted(v))).alias("data"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, o_orderpriority AS name, sha256(o_orderpriority) AS sha256 FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_custkey % 4 = 1")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks (lines) of one job's documents (orders of some customers), with name and digest."""
    documents = load(spark, sf_dir, "orders").where("o_custkey % 4 = 1").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("name"), F.sha2(F.col("o_orderpriority").cast("binary"), 256).alias("sha256"))
    chunks = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"))
    return ingest.document_chunks(documents, chunks)


@query(
    """WITH c AS (SELECT doc_id % 50 AS chunk, doc_id AS no, CASE doc_id % 4 WHEN 0 THEN '文档提到了什么' WHEN 1 THEN ' ' ELSE 'Q ' || (n_chars % 5) END AS question FROM documents), f AS (SELECT chunk, min(no) AS no, arg_min(question, no) AS question FROM c WHERE no % 4 > 1 GROUP BY chunk, lower(replace(question, ' ', ''))),
v AS (SELECT *, CASE WHEN right(question, 1) = '0' THEN false ELSE true END AS keep, CASE WHEN right(question, 1) = '1' THEN 0.9 WHEN right(question, 1) = '2' THEN 0.2 ELSE 0.5 END AS score FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY score DESC, no) AS k FROM v WHERE keep)
SELECT chunk, no, question, score FROM r WHERE k <= 2"""
)
def selected_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of chunks: blank, meta and repeated ones go, verdicts (of some) rank the rest, two of each chunk stay (the wanted number is the feature)."""
    d = load(spark, sf_dir, "documents")
    q = F.when(F.col("doc_id") % 4 == 0, "文档提到了什么").when(F.col("doc_id") % 4 == 1, " ").otherwise(F.concat(F.lit("Q "), (F.col("n_chars") % 5).cast("string")))
    rows = d.select((F.col("doc_id") % 50).alias("chunk"), F.col("doc_id").alias("no"), q.alias("question"), F.lit(2).alias("allocated"))
    said = spark.createDataFrame([("Q 0", False, 1.0), ("Q 1", True, 0.9), ("Q 2", True, 0.2)], "question string, keep boolean, score double")
    verdicts = rows.select("chunk").distinct().crossJoin(F.broadcast(said))  # three rows
    return judge.select_questions(rows, verdicts, "chunk", "no")
