"""Queries of ingest, text, corpus, retrieval and judge operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions import scores as S
from evalspark.functions import text as T
from evalspark.operators import corpus, ingest, judge, retrieval
from evalspark.plans.common import load, stored
from evalspark.sources import endpoint, sse

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- ingest


@query(
    """WITH e AS (SELECT * FROM documents WHERE source IN ('src0', 'src1')), b AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS k FROM documents WHERE source NOT IN ('src0', 'src1')),
n AS (SELECT b.doc_id FROM b WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.text = b.text AND e.lang = b.lang))
SELECT doc_id, (SELECT max(doc_id) FROM e) + row_number() OVER (ORDER BY doc_id) AS row_index FROM n"""
)
def import_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources are the dataset, the others the import; equal text and language is a repeated row."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    there = d.where(F.col("source").isin("src0", "src1")).select("text", "lang", F.col("doc_id").alias("row_index"))
    new = ingest.import_new(there, d.where(~F.col("source").isin("src0", "src1")), ["text", "lang"], "doc_id")
    return new.select("doc_id", "row_index")


FIELDS = [{"name": "amount", "type": "number", "required": True}, {"name": "props", "type": "json", "required": True}, {"name": "tags", "type": "text_list"}]


@query(
    """WITH r AS (SELECT CASE WHEN event_id % 17 = 0 THEN 'n/a' WHEN event_id % 19 = 0 THEN ' ' ELSE CAST(value AS VARCHAR) END AS amount, CASE WHEN event_id % 23 = 0 THEN '{' ELSE props END AS props, CASE WHEN event_id % 29 = 0 THEN '[1' ELSE event_type END AS tags FROM events),
e AS (SELECT [CASE WHEN trim(amount) = '' THEN 'amount: missing' END, CASE WHEN trim(amount) <> '' AND try_cast(amount AS DOUBLE) IS NULL THEN 'amount: not a number' END, CASE WHEN NOT json_valid(props) THEN 'props: not JSON' END] AS errors FROM r),
u AS (SELECT unnest(errors) AS error FROM e) SELECT error, count(*) AS n FROM u WHERE error IS NOT NULL GROUP BY error"""
)
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with derived faults, by error."""
    at = F.col("event_id")
    rows = load(spark, sf_dir, "events").select(
        "event_id", F.when(at % 17 == 0, "n/a").when(at % 19 == 0, " ").otherwise(F.col("value").cast("string")).alias("amount"), F.when(at % 23 == 0, "{").otherwise(F.col("props")).alias("props"), F.when(at % 29 == 0, "[1").otherwise(F.col("event_type")).alias("tags")
    )
    return ingest.validate(rows, FIELDS).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'k,z' ELSE 'z' END AS missing, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS score FROM events")
def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {"k": "k", "z": "z.0"}
    return load(spark, sf_dir, "events").select("event_id", T.path_get("props", "k").alias("k"), F.array_join(endpoint.errors(F.col("props"), paths), ",").alias("missing"), T.coerce_float(T.path_get("props", "k")).alias("score"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive row numbers without sorting in one task."""
    return ingest.number(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "row_index")


@query("SELECT name, position::INT AS position FROM (VALUES ('event_type', 1), ('value', 2), ('k', 3)) t(name, position)")
def export_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared columns, then those first seen in the rows' data."""
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("row_index"), F.from_json("props", "map<string,string>").alias("data"))
    return ingest.export_columns(rows, "data", ["event_type", "value"])


@query(
    """SELECT c_custkey, CASE WHEN length(c_name) > 16 THEN left(c_name, 8) || '****' || right(c_name, 4) ELSE '****' END AS name_masked, CASE WHEN length(c_mktsegment) > 8 THEN left(c_mktsegment, 3) || '****' || right(c_mktsegment, 4) ELSE '****' END AS key_masked FROM customer"""
)
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", T.mask_secret("c_name").alias("name_masked"), T.mask_key("c_mktsegment").alias("key_masked"))


TEMPLATE = "Rate the {lang} text of {source} ({n_chars} characters): {text}{absent}"


@query("SELECT doc_id, md5('Rate the ' || lang || ' text of ' || source || ' (' || n_chars || ' characters): ' || text) AS prompt_md5, length('Rate the ' || lang || ' text of ' || source || ' (' || n_chars || ' characters): ' || text) AS n FROM documents")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template compiled once into a column."""
    d = load(spark, sf_dir, "documents")
    prompt = T.render(TEMPLATE, {c: F.col(c) for c in d.columns})
    return d.select("doc_id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).cast("long").alias("n"))


@query(
    """WITH m AS (SELECT conv_id, CASE WHEN lower(role) IN ('bot', 'assistant') THEN 'assistant' WHEN lower(role) IN ('system', 'tool') THEN lower(role) ELSE 'user' END AS role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM m WHERE trim(text) <> '' GROUP BY conv_id, role"""
)
def conversation_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with known roles and a text, counted by conversation and role; no conversation is gathered."""
    one = F.array(F.struct("role", F.col("text").alias("content")))
    rows = load(spark, sf_dir, "conversations").select("conv_id", F.explode(ingest.normalize_messages(one)).alias("m"))
    return rows.groupBy("conv_id", F.col("m.role").alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("m.content")).alias("chars"))


@query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS answer_md5, count(*) AS n_events FROM conversations GROUP BY conv_id")
def sse_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as an event stream whose deltas are its turns."""
    lines = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("data: "), F.to_json(F.struct("text"))).alias("line"))
    found = sse.answers(sse.data_lines(lines, "conv_id", "turn"), "conv_id", "turn")
    return found.select("conv_id", F.md5("answer").alias("answer_md5"), "n_events")


# ---------------------------------------------------------------- deterministic metrics


@query(
    """WITH r AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids, list(l_partkey) FILTER (l_returnflag = 'R') AS gold FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN gold IS NOT NULL THEN CAST(list_has_any(ids[1:2], gold) AS INT)::DOUBLE END AS hit_at_2, CASE WHEN gold IS NOT NULL THEN round(1 / list_min([list_position(ids, g) FOR g IN gold]), 4) END AS mrr FROM r"""
)
def hit_rate_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved ids: an order's parts; gold ids: the returned ones."""
    lists = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x.l_partkey).alias("ids"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("gold")
    )
    return lists.select("l_orderkey", S.hit_rate("ids", "gold", 2).alias("hit_at_2"), S.reciprocal_rank("ids", "gold").alias("mrr"))


@query(
    """WITH c AS (SELECT l_orderkey, l_returnflag || ':' || (l_partkey % 2) AS e, l_returnflag || ':' || (l_suppkey % 2) AS a, l_linestatus FROM lineitem),
x AS (SELECT l_orderkey, e AS call, count(*) AS n FROM c GROUP BY 1, 2), y AS (SELECT l_orderkey, a AS call, count(*) AS n FROM c WHERE l_linestatus = 'O' GROUP BY 1, 2),
t AS (SELECT x.l_orderkey, sum(least(x.n, coalesce(y.n, 0))) AS hit, sum(x.n) AS expected FROM x LEFT JOIN y USING (l_orderkey, call) GROUP BY 1), s AS (SELECT l_orderkey, count(*) AS e, count(*) FILTER (l_linestatus = 'O') AS a FROM c GROUP BY 1)
SELECT l_orderkey, round(hit / expected, 4) AS accuracy, CASE WHEN a > 0 THEN round(least(e, a) / greatest(e, a), 4) ELSE 0 END AS efficiency FROM t JOIN s USING (l_orderkey)"""
)
def tool_call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls derived from an order's lines: expected ones from parts, actual ones from suppliers of open lines."""
    call = lambda k: F.concat("l_returnflag", F.lit(":"), (F.col(k) % 2).cast("string"))
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(call("l_partkey")).alias("e"), F.collect_list(F.when(F.col("l_linestatus") == "O", call("l_suppkey"))).alias("a"))
    return rows.select("l_orderkey", S.tool_call_accuracy("e", "a").alias("accuracy"), S.step_efficiency(F.size("e"), F.size("a")).alias("efficiency"))


# ---------------------------------------------------------------- retrieval

TOKENS_SQL = "regexp_extract_all(lower({}), '[a-z0-9]+')"
BM25_SQL = """d AS ({docs}), q AS ({queries}),
s AS (SELECT count(*) AS n, avg(len(tok)) AS avg_len FROM d), t AS (SELECT doc_id, len(tok) AS len, unnest(tok) AS term FROM d), p AS (SELECT doc_id, len, term, count(*) AS tf FROM t GROUP BY ALL),
a AS (SELECT DISTINCT query_id, unnest(tok) AS term FROM q), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT p.doc_id, p.term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)) AS w FROM p JOIN f USING (term), s),
r AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM a JOIN w USING (term) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)"""


@query("WITH " + BM25_SQL.format(docs=f"SELECT doc_id, {TOKENS_SQL.format('text')} AS tok FROM documents", queries=f"SELECT item_id AS query_id, {TOKENS_SQL.format('text')} AS tok FROM benchmark") + " SELECT query_id, doc_id, rank::INT AS rank, round(score, 4) AS score FROM k WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each benchmark text (a top-k is the feature)."""
    found = retrieval.bm25(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return found.select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query(
    "WITH "
    + BM25_SQL.format(
        docs=f"SELECT item_id AS doc_id, {TOKENS_SQL.format('text')} AS tok FROM benchmark UNION ALL SELECT doc_id + 1000000000, {TOKENS_SQL.format('text')} FROM documents",
        queries=f"SELECT item_id AS query_id, {TOKENS_SQL.format('text')} AS tok FROM benchmark",
    )
    + """, g AS (SELECT q.query_id, min(rank) FILTER (k.doc_id = q.query_id) AS pos FROM q LEFT JOIN k ON k.query_id = q.query_id AND rank <= 5 GROUP BY 1)
SELECT 'all' AS scenario, count(*) AS n, round(avg(coalesce(pos <= 1, false)::INT), 4) AS h1, round(avg(coalesce(pos <= 3, false)::INT), 4) AS h3, round(avg((pos IS NOT NULL)::INT), 4) AS hk, round(avg(coalesce(1 / pos, 0)), 4) AS mrr FROM g
UNION ALL SELECT 'none', count(*), 1.0, 1.0, 1.0, 1.0 FROM q"""
)
def retrieval_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts look for themselves: among themselves, and with all documents as distractors."""
    kb = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    queries = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.array("item_id").alias("gold"))
    distractors = load(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text")
    out = None
    for name, docs in (("none", kb), ("all", kb.unionByName(distractors))):
        one = retrieval.retrieval_means(retrieval.bm25(docs, queries), queries).select(F.lit(name).alias("scenario"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH t AS (SELECT item_id, lower(regexp_replace(text, '\\s', '', 'g')) AS s FROM benchmark), d AS (SELECT doc_id, lower(regexp_replace(text, '\\s', '', 'g')) AS s FROM documents),
a AS (SELECT DISTINCT item_id, substr(s, i, 5) AS gram FROM t, generate_series(1, greatest(length(s) - 4, 1)) r(i) WHERE s <> ''), n AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1),
b AS (SELECT DISTINCT doc_id, substr(s, i, 5) AS gram FROM d, generate_series(1, greatest(length(s) - 4, 1)) r(i) WHERE s <> '' AND substr(s, i, 5) IN (SELECT gram FROM a)),
o AS (SELECT item_id, doc_id, round(count(*) / any_value(n), 4) AS overlap FROM a JOIN b USING (gram) JOIN n USING (item_id) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS k FROM o)
SELECT t.item_id, coalesce(overlap, 0) AS overlap, doc_id, coalesce(overlap, 0) >= 0.8 AS contaminated FROM t LEFT JOIN k ON t.item_id = k.item_id AND k = 1"""
)
def contamination_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text's highest 5-gram containment in a document."""
    return retrieval.ngram_overlap(load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents"))


@query(
    """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, least(1, list_cosine_similarity(q.v, e.embedding::DOUBLE[]))), 6) AS c FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS k FROM c) SELECT query_id, vec_id, round(c, 4) AS cosine, round(c, 4) >= 0.92 AS contaminated FROM k WHERE k = 1"""
)
def contamination_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector (the stated query set) against all others, in blocks."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.cosine_max(e, e.where("vec_id % 20 = 0"))


# ---------------------------------------------------------------- corpus


def _noise_sql() -> tuple[str, str, str]:
    """Header, revision record and form, of a text's normal form n and its compact form c."""
    words = lambda c, ws: f"regexp_matches({c}, '{'|'.join(ws)}')"
    dated = r"regexp_matches(n, '\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日')"
    hits = " + ".join(f"contains(n, '{w}')::INT" for w in corpus.REVISION)
    head = f"""(n = '' OR regexp_matches(n, '^\\s*第?\\s*\\d+\\s*页(?:\\s*/\\s*共?\\s*\\d+\\s*页)?\\s*$') OR (contains(n, '第') AND contains(n, '页') AND {dated}) OR regexp_matches(c, '^\\d+(?:\\.\\d+){{1,4}}$') OR ({dated} AND length(n) <= 40) OR (length(c) <= 12 AND NOT regexp_matches(c, '{corpus.WORDS4}')))"""
    revision = f"""(length(n) <= 180 AND (({hits}) >= 2 OR (starts_with(n, '注：1.') AND contains(n, '修订')) OR ((starts_with(n, '注：') OR regexp_matches(n, '^\\d+\\.')) AND {words('n', ('修订', '审核', '批准'))})))"""
    return head, revision, words("n", corpus.FORM)


def _quality_sql(latin_ok: bool) -> str:
    n = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
    words = lambda c, ws: f"regexp_matches({c}, '{'|'.join(ws)}')"
    cjk = n("c", corpus.T.CJK)
    head, revision, form = _noise_sql()
    garbled = "false" if latin_ok else f"""(c = '' OR ({n('c', '[A-Za-z]')} >= 6 AND {cjk} <= 4 AND {n('c', '[0-9]')} <= 2) OR (regexp_matches(text, '[A-Za-z]{{2,}}\\s*[A-Za-z]{{2,}}') AND {cjk} <= 6) OR ({n('c', corpus.SIGNS)} >= greatest(4, length(c) * 0.25::DOUBLE) AND {cjk} <= 6))"""
    return f"""q0 AS (SELECT doc_id, source, n_chars, text, regexp_replace(text, '\\s+', '', 'g') AS c, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n FROM documents),
q1 AS (SELECT *, {n('text', corpus.MARKS)} AS m,
  {head} AS head, {revision} AS revision,
  {form} AS form, {garbled} AS garbled, {words('n', corpus.RULES)} AS rule FROM q0),
q2 AS (SELECT *, CASE WHEN head THEN 0 WHEN revision OR form THEN 0.05 WHEN garbled THEN 0.15 ELSE round(greatest(0, least(1, 1.0::DOUBLE + CASE WHEN length(c) < 40 THEN -0.45::DOUBLE WHEN length(c) < 90 THEN -0.15 ELSE 0 END
  + CASE WHEN {cjk} < 12 AND {n('c', '[A-Za-z]')} < 24 THEN -0.25::DOUBLE ELSE 0 END + CASE WHEN {n('c', '[0-9]')} >= greatest(8, floor(length(c) * 0.28::DOUBLE)) AND m = 0 THEN -0.2::DOUBLE ELSE 0 END + CASE WHEN m = 0 AND length(c) < 140 THEN -0.15::DOUBLE ELSE 0 END
  + CASE WHEN length(c) < 220 AND regexp_matches(c, '{corpus.BROKEN_OFF}') THEN -0.2::DOUBLE ELSE 0 END + CASE WHEN rule THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN length(c) >= 220 THEN 0.08::DOUBLE ELSE 0 END)), 2) END::DOUBLE AS quality FROM q1),
q3 AS (SELECT *, CASE WHEN head OR revision OR form OR garbled OR quality < 0.2 THEN 'filtered' WHEN quality >= 0.75 THEN 'good' WHEN quality >= 0.45 THEN 'medium' ELSE 'low' END AS label, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM q2),
q AS (SELECT *, CASE WHEN s = '' OR quality < 0.35 THEN 0 WHEN least(2.2::DOUBLE, length(s) / 550) + least(0.8::DOUBLE, greatest(1, {n('s', '[。！？.!?;' + chr(92) + 'n]')}) / 12) + CASE WHEN rule THEN 0.35::DOUBLE ELSE 0 END + 0.35::DOUBLE * quality >= 2.1 THEN 2 ELSE 1 END AS n_questions FROM q3)"""


@query(f"WITH {_quality_sql(False)} SELECT doc_id, quality, label, n_questions::BIGINT AS n_questions FROM q")
def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faithful rules: they take any text in Latin letters for garbled."""
    return corpus.quality(load(spark, sf_dir, "documents")).select("doc_id", "quality", "label", "n_questions")


@query(f"WITH {_quality_sql(True)} SELECT doc_id, quality, label, n_questions::BIGINT AS n_questions FROM q")
def chunk_quality_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules without the one on garbled text."""
    return corpus.quality(load(spark, sf_dir, "documents"), latin_ok=True).select("doc_id", "quality", "label", "n_questions")


@query(
    f"""WITH {_quality_sql(True)}, r AS (SELECT source, doc_id, n_questions AS w, n_chars, count(*) OVER p AS n, sum(n_questions) OVER p AS t FROM q WHERE n_questions > 0 WINDOW p AS (PARTITION BY source)),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, n_chars DESC, doc_id) AS rn, row_number() OVER (PARTITION BY source ORDER BY greatest(0, w * t / t - 1) DESC, doc_id DESC) AS pos FROM r)
SELECT source, doc_id, ((rn <= t)::INT + greatest(0, t - n) // n + (pos <= greatest(0, t - n) % n)::INT)::BIGINT AS allocated FROM k"""
)
def question_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of a job (source), weighted by suggested questions."""
    rows = corpus.quality(load(spark, sf_dir, "documents"), latin_ok=True).select("source", "doc_id", "n_questions", "n_chars")
    return corpus.allocate(stored(rows, "rated"), "source", "doc_id")


@query(
    """WITH l AS (SELECT DISTINCT n_chars, doc_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS line FROM (SELECT n_chars, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)),
p AS (SELECT n_chars, line, count(*) AS n_pages FROM l WHERE line <> '' GROUP BY 1, 2), t AS (SELECT n_chars, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1)
SELECT n_chars, md5(line) AS line_md5, n_pages FROM p JOIN t USING (n_chars) WHERE n_pages >= 2 AND n_pages >= 0.5 * n"""
)
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one length are the pages of a document."""
    pages = load(spark, sf_dir, "documents").select("n_chars", "doc_id", "text")
    return corpus.repeated_lines(pages, "n_chars", "doc_id").select("n_chars", F.md5("line").alias("line_md5"), "n_pages")


def _lengths_sql() -> str:
    """One step a row: take a paragraph, cut a long one, or close a chunk."""
    size, overlap, earliest = corpus.SIZE, corpus.OVERLAP, int(corpus.SIZE * corpus.EARLIEST)
    cut = f"left(rest, {size})"
    at = "coalesce(" + ", ".join(f"CASE WHEN length({cut}) - strpos(reverse({cut}), '{b}') > {earliest} AND contains({cut}, '{b}') THEN length({cut}) - strpos(reverse({cut}), '{b}') + 1 END" for b in corpus.BREAKS[1:]) + f", {size})"
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {strip("replace(text, chr(13) || chr(10), chr(10))")} AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, list_filter(list_transform(CASE WHEN length(t) <= {size} THEN [t] ELSE string_split(t, chr(10)) END, lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM d),
s AS (SELECT doc_id, 0 AS step, 1 AS i, '' AS cur, NULL::VARCHAR AS rest, NULL::VARCHAR AS piece, false AS done FROM p
UNION ALL SELECT s.doc_id, step + 1,
  CASE WHEN rest IS NULL AND i <= len(ps) AND (cur = '' OR length(cur) + 1 + length(ps[i]) <= {size}) THEN i + 1 ELSE i END,
  CASE WHEN length(rest) > {size} THEN '' WHEN rest IS NOT NULL THEN rest WHEN i > len(ps) THEN cur WHEN cur = '' THEN CASE WHEN length(ps[i]) <= {size} THEN ps[i] ELSE '' END WHEN length(cur) + 1 + length(ps[i]) <= {size} THEN cur || chr(10) || ps[i] ELSE '' END,
  CASE WHEN length(rest) > {size} THEN {strip(f"substr(rest, greatest(1, {at} - {overlap}) + 1)")} WHEN rest IS NULL AND i <= len(ps) AND cur = '' AND length(ps[i]) > {size} THEN ps[i] END,
  CASE WHEN length(rest) > {size} THEN {strip(f"left(rest, {at})")} WHEN rest IS NULL AND (i > len(ps) OR (cur <> '' AND length(cur) + 1 + length(ps[i]) > {size})) THEN cur END,
  rest IS NULL AND i > len(ps) FROM s JOIN p ON s.doc_id = p.doc_id WHERE NOT done)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1)::INT AS chunk_index, 'doc-' || doc_id || '-chunk-' || (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1) AS chunk_key, piece AS content, length(piece) AS char_count FROM s WHERE piece <> ''"""


@query(_lengths_sql())
def length_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk(load(spark, sf_dir, "documents"), structured=False)


@query()
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk(load(spark, sf_dir, "documents"))


def _pages_sql() -> str:
    head, revision, form = _noise_sql()
    return f"""WITH l AS (SELECT source, doc_id, unnest(range(len(x))) AS no, trim(regexp_replace(unnest(x), '\\s+', ' ', 'g')) AS n FROM (SELECT source, doc_id, string_split(text, chr(10)) AS x FROM documents)),
k AS (SELECT source, n, count(DISTINCT doc_id) AS pages FROM l WHERE n <> '' GROUP BY 1, 2), t AS (SELECT source, count(DISTINCT doc_id) AS total FROM documents GROUP BY 1),
r AS (SELECT source, n FROM k JOIN t USING (source) WHERE pages >= 2 AND pages >= 0.5 * total AND length(n) <= 120),
c AS (SELECT *, replace(n, ' ', '') AS c, count(*) OVER (PARTITION BY source, doc_id) AS lines FROM l),
m AS (SELECT *, {head} OR {revision} AS noise, {form} AS form FROM c), f AS (SELECT *, min(CASE WHEN form AND no >= greatest(3, floor(lines * 0.4)) THEN no END) OVER (PARTITION BY source, doc_id) AS tail FROM m),
g AS (SELECT source, doc_id, string_agg(f.n, chr(10) ORDER BY no) AS text FROM f LEFT JOIN r USING (source, n) WHERE NOT noise AND NOT form AND r.n IS NULL AND (tail IS NULL OR no < tail) GROUP BY 1, 2)
SELECT d.source, d.doc_id, coalesce(g.text, '') AS text FROM documents d LEFT JOIN g USING (source, doc_id)"""


@query(_pages_sql())
def cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without headers, repeated lines and form lines; a source is a document of many pages."""
    return corpus.clean_pages(load(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id")


# ---------------------------------------------------------------- judge


def _rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAG rows derived from conversations: a user turn, the answer to it, and the answer as its own context."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    turns = load(spark, sf_dir, "conversations").withColumn("response", F.lead("text").over(own)).where("role = 'user'")
    return turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"), F.col("text").alias("user_input"), "response", F.array("response").alias("retrieved_contexts"), F.col("response").alias("reference"))


WORDS_SQL = "list_filter(list_distinct(regexp_extract_all(lower(to_json({})::VARCHAR), '[\\p{{L}}\\p{{N}}_]+')), lambda x: x <> 'null')"
RAG_SQL = """t AS (SELECT conv_id, turn, role, text AS u, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), q AS (SELECT conv_id || '-' || turn AS row_id, u, r FROM t WHERE role = 'user')"""
_LIMITED = "CASE WHEN length({0}) > 2400 THEN left({0}, 2400) || '...[truncated]' ELSE {0} END"


@query(
    f"""WITH {RAG_SQL}, w AS (SELECT *, {WORDS_SQL.format(_LIMITED.format('u'))} AS uw, {WORDS_SQL.format(_LIMITED.format('r'))} AS rw, coalesce(u, '') = '' AS no_u, coalesce(r, '') = '' AS no_r FROM q),
a AS (SELECT row_id, 'answer_relevancy' AS metric, no_u OR no_r AS lacking, len(list_intersect(uw, rw)) AS hit, len(uw) AS n, array_to_string(list_filter([CASE WHEN no_u THEN 'user_input' END, CASE WHEN no_r THEN 'response' END], lambda x: x IS NOT NULL), ', ') AS missing FROM w
UNION ALL SELECT row_id, 'factual_correctness', no_r, len(rw), len(rw), 'response, reference' FROM w)
SELECT row_id, metric, CASE WHEN NOT lacking THEN CASE WHEN n = 0 THEN 0 ELSE round(hit / n, 4) END END AS score, CASE WHEN lacking THEN 'missing: ' || missing ELSE metric || ': ' || hit || ' of ' || n || ' words' END AS reason, NULL::VARCHAR AS error FROM a"""
)
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two built-in metrics by the offline provider."""
    rows, offline = _rag(spark, sf_dir), judge.Offline()
    return judge.judge(rows, ["row_id"], "answer_relevancy", offline).unionByName(judge.judge(rows, ["row_id"], "factual_correctness", offline))


@query(
    f"""WITH {RAG_SQL}, c AS (SELECT row_id, r, {WORDS_SQL.format('[r]')} AS rw, list_filter(list_transform(regexp_split_to_array(r, '[.!?。！？]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS claims FROM q),
k AS (SELECT row_id, rw, unnest(claims) AS claim FROM c WHERE r <> ''), v AS (SELECT row_id, 2 * len(list_intersect({WORDS_SQL.format('claim')}, rw)) >= len({WORDS_SQL.format('claim')}) AS ok FROM k), s AS (SELECT row_id, count(*) AS n, count(*) FILTER (ok) AS hit FROM v GROUP BY 1)
SELECT c.row_id, CASE WHEN coalesce(r, '') <> '' THEN round(coalesce(hit, 0) / greatest(1, coalesce(n, 0)), 4) END AS score, coalesce(n, 0) AS n_claims FROM c LEFT JOIN s USING (row_id)"""
)
def claim_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.claim_faithfulness(_rag(spark, sf_dir), "row_id", judge.Offline())


@query()
def generative_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.generative_relevancy(_rag(spark, sf_dir), "row_id", judge.Offline())
