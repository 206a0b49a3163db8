"""The registered queries of the corpus operators: thin digests of what each operator returns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import bpe, chat, clusters, fim, licenses, neighbours, packing, pii, quality, secrets, simhash, substring, toxicity
from evalspark.llm.common import load


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: A conversation whose texts hold the template's own control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.digests(chat.format_turns(turns.unionByName(extra)))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
    ELSE '@' || regexp_replace(role, '([\\#<:])', '\\\1', 'g') END AS label,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS turn_no,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS after
  FROM rows
), u AS (
  SELECT *, CASE WHEN turn_no = 0 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END AS ok
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn_no)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn_no) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || label || ': ' || regexp_replace(text, '([\\#<:])', '\\\1', 'g') || ' </turn>' || chr(10)))::BIGINT AS formatted_chars,
  bool_and(ok) AND max(role) FILTER (after IS NULL) = 'assistant' AS valid,
  min(turn_no) FILTER (NOT ok) AS first_bad_turn
FROM u GROUP BY conv_id
"""


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(load(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates, the entities' places, and how many there are of each type."""
    found = pii.pseudonymize(load(spark, sf_dir, "documents"))
    n = [F.expr(f"CAST(size(filter(entities, e -> e.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in pii.KINDS]
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e.kind, e.start.cast("string"), e.end.cast("string"))), ",")
    return found.select("doc_id", "text", *n, spans.alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(load(spark, sf_dir, "documents")))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(load(spark, sf_dir, "documents"), columns=["doc_id"])
    base = F.filter("found", lambda f: f.phrase)
    firsts = F.transform(base, lambda f: f.first_word)
    said = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda f: f.label))), ",")
    counts = [F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word")]
    return found.select("doc_id", "n_words", *counts, said(base).alias("base_labels"), said(F.col("found")).alias("labels"), F.col("license_score").alias("score"))


def _op11_sql() -> str:
    """Phrases by lists of words, wordings as regular expressions over the words."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    stands = {label: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(licenses.words_of(phrase))) for phrase, label in licenses.PHRASES.items()}
    phrases = "\n  UNION ALL ".join(f"SELECT row, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: {where})) - 1 AS p FROM d" for label, where in stands.items())
    wordings = ", ".join(f"CASE WHEN regexp_matches(j, '{licenses.pattern(text)}') THEN '{label}' END" for label, text in licenses.WORDINGS.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
base AS ({phrases}),
b AS (SELECT row, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS own FROM base GROUP BY row),
m AS (SELECT row, doc_id, len(w) AS n_words, list_filter([{wordings}], lambda x: x IS NOT NULL) AS more FROM (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS j FROM d))
SELECT doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_concat(more, coalesce(own, []))), ',') AS labels,
  CASE WHEN len(more) > 0 THEN 1.0::DOUBLE ELSE 1 - pow(0.5::DOUBLE, coalesce(n_base, 0)) END AS score
FROM m LEFT JOIN b USING (row)
"""


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.annulus_kmeans(load(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    """Every vector against every centroid, round by round."""
    d = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    nearest, steps = f"min_by(c.cluster, ({d}, c.cluster)) AS cluster, min({d}) AS distance", []
    for r in range(rounds):
        cells = f"SELECT a.cluster, unnest(e.v) AS x, unnest(range(1, 65)) AS pos FROM e JOIN a{r} a USING (row)"
        means = f"SELECT cluster, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean FROM ({cells}) GROUP BY cluster, pos"
        steps.append(f"a{r} AS MATERIALIZED (SELECT e.row, {nearest} FROM e CROSS JOIN c{r} c GROUP BY e.row)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list(mean ORDER BY pos) AS v FROM ({means}) GROUP BY cluster) n USING (cluster))")
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM e ORDER BY h, v LIMIT {k})),
{", ".join(steps)},
last AS (SELECT e.row, {nearest} FROM e CROSS JOIN c{rounds} c GROUP BY e.row)
SELECT e.vec_id, a.cluster::INTEGER AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last a JOIN e USING (row) JOIN c{rounds} c USING (cluster)
"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(load(spark, sf_dir, "documents"), columns=["doc_id"], unit="line", seed=7, rate=100, spm=50)
    restored = fim.restore(F.col("output"), F.col("form"))
    digests = [F.sha2(t.cast("binary"), 256).alias(n) for t, n in ((F.col("output"), "output_sha256"), (restored, "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [('0x' || substr(h, 8 * k + 1, 8))::UBIGINT::BIGINT FOR k IN range(4)] AS g FROM d),
c AS (SELECT *, len(u) AS n, least(g[1] % (len(u) + 1), g[2] % (len(u) + 1)) AS lo, greatest(g[1] % (len(u) + 1), g[2] % (len(u) + 1)) AS hi FROM u),
p AS (SELECT *, coalesce(array_to_string(list_slice(u, 1, lo), ''), '') AS prefix, coalesce(array_to_string(list_slice(u, lo + 1, hi), ''), '') AS middle, coalesce(array_to_string(list_slice(u, hi + 1, n), ''), '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 100 THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


QUERIES = {
    "op1_chat": op1_chat, "op2_substring": op2_substring, "op3_simhash": op3_simhash, "op4_quality": op4_quality, "op5_secrets": op5_secrets, "op6_neighbours": op6_neighbours, "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity, "op9_bpe": op9_bpe, "op10_pii": op10_pii, "op11_licenses": op11_licenses, "op12_clusters": op12_clusters, "op13_fim": op13_fim,
}
ORACLES: dict[str, str] = {"op1_chat": OP1_SQL, "op11_licenses": _op11_sql(), "op12_clusters": _op12_sql(), "op13_fim": OP13_SQL}
