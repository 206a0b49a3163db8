"""Queries of the report operators. Runs, votes and manual verdicts are derived from ids, so that both engines agree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions import scores as S
from evalspark.operators import blind, report
from evalspark.plans.common import GRID_SQL, grid, load, shared_dir
from evalspark.streaming import progress

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SUMMARY_SQL = """round(avg(score), 4) AS mean, round(min(score), 4) AS min, round(max(score), 4) AS max,
  round(avg(CASE WHEN score IS NOT NULL THEN CAST(score >= threshold AS INT) END), 4) AS pass_rate, count(score) AS n, count(*) - count(score) AS errors"""


@query(f"WITH {GRID_SQL} SELECT metric, {SUMMARY_SQL} FROM g GROUP BY metric")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, extremes, pass rate and errors of each metric over the document grid."""
    return report.metric_summary(grid(spark, sf_dir), "metric")


@query(f"WITH {GRID_SQL} SELECT source, metric, {SUMMARY_SQL} FROM g GROUP BY source, metric")
def metric_summary_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.metric_summary(grid(spark, sf_dir), "source", "metric")


@query(
    f"""WITH {GRID_SQL}, s AS (SELECT source, metric, round(avg(score), 4) AS mean, min(weight) AS weight FROM g GROUP BY source, metric)
SELECT source, round(sum(mean * weight) / sum(CASE WHEN mean IS NOT NULL THEN weight END) + 1e-9::DOUBLE, 4) AS weighted_total, count(mean) AS metric_count FROM s WHERE weight > 0 GROUP BY source"""
)
def weighted_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    weights = g.groupBy("source", "metric").agg(F.min("weight").alias("weight"))
    return report.weighted_total(report.metric_summary(g, "source", "metric").join(weights, ["source", "metric"]), "source")


VERDICT_SQL = f"""WITH {GRID_SQL}, v AS (SELECT source, doc_id, bool_and(coalesce(score >= threshold, false)) AS is_pass FROM g GROUP BY source, doc_id),
r AS (SELECT v.*, CASE WHEN l.toxic = 1 THEN 'toxic' END AS error FROM v LEFT JOIN labels l USING (doc_id))"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of runs (source): the grid's verdict, and an error where the document is toxic."""
    error = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("error"))
    return report.row_verdicts(grid(spark, sf_dir), "source", "doc_id").join(error, "doc_id", "left")


@query(f"{VERDICT_SQL} SELECT source, count(*) AS total, count(*) FILTER (is_pass) AS passed, count(*) FILTER (NOT is_pass) AS failed, count(error) AS errors FROM r GROUP BY source")
def report_row_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.row_stats(_rows(spark, sf_dir), "source")


@query(f"""{VERDICT_SQL} SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN is_pass THEN 'pass' WHEN NOT is_pass THEN 'fail' ELSE 'unknown' END AS status, count(*) AS n FROM r GROUP BY 1""")
def row_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy(S.row_status(F.col("error"), F.col("is_pass")).alias("status")).agg(F.count("*").alias("n"))


@query(
    f"""{VERDICT_SQL}, t AS (SELECT source, count(*) AS total, count(*) FILTER (is_pass) AS passed FROM r GROUP BY source),
n AS (SELECT DISTINCT source FROM documents WHERE source ILIKE '%SRC1%')
SELECT n.source, coalesce(total, 0) AS total, coalesce(passed, 0) AS passed, row_number() OVER (ORDER BY coalesce(total, 0) DESC, n.source) AS position
FROM n LEFT JOIN t USING (source) ORDER BY position LIMIT 5 OFFSET 2"""
)
def report_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of runs by keyword: five from the third on (the page is the feature)."""
    runs = load(spark, sf_dir, "documents").select("source").distinct().where(F.col("source").ilike("%SRC1%"))
    stats = report.row_stats(_rows(spark, sf_dir), "source").select("source", "total", "passed")
    joined = runs.join(stats, "source", "left").fillna(0, ["total", "passed"])
    return report.page(joined, [F.desc("total"), F.col("source")], 5, 2)


@query(
    """WITH t AS (SELECT l_suppkey % 10 AS run, sum(CAST(l_quantity AS BIGINT) * l_linenumber)::BIGINT AS prompt_tokens, sum(CAST(l_quantity AS BIGINT))::BIGINT AS completion_tokens FROM lineitem GROUP BY 1)
SELECT *, round(prompt_tokens / 1000 * 0.0008::DOUBLE + completion_tokens / 1000 * 0.002::DOUBLE, 6) AS cost FROM t"""
)
def run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens are derived from quantities."""
    q = F.col("l_quantity").cast("long")
    return report.cost(load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("run"), (q * F.col("l_linenumber")).alias("prompt_tokens"), q.alias("completion_tokens")), "run")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged rows derived from lineitem: run = line status, metric = return flag; every seventh line has no score."""
    score = F.when(F.col("l_linenumber") % 7 != 0, F.col("l_discount") * 10)
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("run"), F.col("l_returnflag").alias("metric"), score.alias("score"), (F.col("l_tax") * 2).alias("score_std"), S.swap_consistency(score, F.col("l_tax") * 10).alias("swap_consistency"), (F.col("l_discount") / 2).alias("judge_mad")
    )


JUDGED_SQL = """j AS (SELECT l_linestatus AS run, l_returnflag AS metric, CASE WHEN l_linenumber % 7 <> 0 THEN l_discount * 10 END AS score, l_tax * 2 AS score_std,
  round(greatest(0, least(1, 1 - abs(round(CASE WHEN l_linenumber % 7 <> 0 THEN l_discount * 10 END, 4) - l_tax * 10))), 4) AS swap_consistency, l_discount / 2 AS judge_mad FROM lineitem),
m AS (SELECT run, metric, round(avg(score_std), 4) AS avg_score_std, count(*) FILTER (score_std > 0.1) AS low_confidence, round(avg(swap_consistency), 4) AS avg_swap_consistency,
  count(*) FILTER (swap_consistency < 0.9) AS inconsistent, round(avg(judge_mad), 4) AS avg_judge_mad FROM j WHERE score IS NOT NULL GROUP BY run, metric)"""


@query(f"WITH {JUDGED_SQL} SELECT * FROM m")
def judge_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.reliability(_judged(spark, sf_dir), "run", "metric")


@query(
    f"""WITH {JUDGED_SQL} SELECT run, round(avg(avg_score_std), 4) AS avg_score_std, sum(low_confidence)::BIGINT AS low_confidence, round(avg(avg_swap_consistency), 4) AS avg_swap_consistency,
  sum(inconsistent)::BIGINT AS inconsistent, round(avg(avg_judge_mad), 4) AS avg_judge_mad FROM m GROUP BY run"""
)
def judge_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.overall_reliability(report.reliability(_judged(spark, sf_dir), "run", "metric"), "run")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several judgements of a row: the lines of an order; returned ones have no score."""
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("idx"), F.col("l_returnflag").alias("label"), F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 10).alias("score"), F.concat("l_linestatus", F.col("l_partkey").cast("string")).alias("reason")
    )


SAMPLES_SQL = """x AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS idx, l_returnflag AS label, CASE WHEN l_returnflag <> 'R' THEN l_discount * 10 END AS score, l_linestatus || l_partkey AS reason FROM lineitem)"""


@query(
    f"""WITH {SAMPLES_SQL}, y AS (SELECT *, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS sd, count(*) OVER w AS n FROM x WHERE score IS NOT NULL WINDOW w AS (PARTITION BY l_orderkey)),
z AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(abs(score - mean), 9), idx, reason) AS k FROM y)
SELECT l_orderkey, round(mean, 6) AS score, round(sd, 6) AS score_std, n AS n_samples, reason FROM z WHERE k = 1"""
)
def judge_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sampled(_samples(spark, sf_dir), "l_orderkey", digits=6)


@query(
    f"""WITH {SAMPLES_SQL}, y AS (SELECT *, avg(score) OVER (PARTITION BY l_orderkey) AS mean FROM x)
SELECT l_orderkey, round(any_value(mean), 6) AS score, round(avg(abs(score - mean)), 6) AS judge_mad, count(*) AS n_judges FROM y GROUP BY l_orderkey"""
)
def judge_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.panel(_samples(spark, sf_dir).withColumn("judge", F.col("idx").cast("string")), "l_orderkey", digits=6)
    return found.select("l_orderkey", "score", "judge_mad", F.size("by_judge").cast("long").alias("n_judges"))


@query(
    f"""WITH {SAMPLES_SQL}, v AS (SELECT l_orderkey, coalesce(label, 'None') AS label, count(*) AS votes, min(idx) AS first FROM x GROUP BY 1, 2),
z AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, first, label) AS k FROM v) SELECT l_orderkey, label, votes FROM z WHERE k = 1"""
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.majority(_samples(spark, sf_dir), "l_orderkey")


@query(
    """WITH r AS (SELECT d.lang, l.quality = 1 AS m, l.toxic = 0 AND d.n_chars > 500 AS a FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT lang, count(*) AS n, count(*) FILTER (m AND a) AS both_pass, count(*) FILTER (m AND NOT a) AS manual_only, count(*) FILTER (NOT m AND a) AS auto_only, count(*) FILTER (NOT m AND NOT a) AS both_fail FROM r GROUP BY lang),
p AS (SELECT *, (both_pass + both_fail) / n AS po, ((both_pass + manual_only) * (both_pass + auto_only) + (both_fail + auto_only) * (both_fail + manual_only)) / (n * n) AS pe FROM c),
k AS (SELECT *, CASE WHEN pe <> 1 THEN round((po - pe) / (1 - pe), 4) END AS kappa FROM p)
SELECT lang, n, both_pass, manual_only, auto_only, both_fail, round(po, 4) AS agreement, kappa, coalesce(kappa < 0.7 AND n >= 10, false) AS suggest_review FROM k"""
)
def agreement_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual verdict: label quality; automatic: not toxic and over 500 characters."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id")
    rows = d.select("lang", F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("manual"), ((F.col("toxic") == 0) & (F.col("n_chars") > 500)).alias("is_pass"), F.lit(None).cast("string").alias("error"))
    return report.agreement(rows, "lang")


def _run(labels: DataFrame, flip: int, drop: int, twice: int) -> DataFrame:
    """A derived run: ids divisible by `drop` are missing, verdicts of those divisible by `flip` turned, those divisible by `twice` given again, turned."""
    ok = (F.col("quality") == 1) != (F.col("doc_id") % flip == 0)
    rows = labels.where(F.col("doc_id") % drop != 0).select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("result_id"), ok.alias("is_pass"), F.when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), "e").alias("error"), (F.col("quality") * 0.5 + (F.col("doc_id") % flip) / 100.0).alias("mean"))
    again = rows.where(F.col("row_id") % twice == 0).select("row_id", (F.col("result_id") + 1_000_000_000).alias("result_id"), (~F.col("is_pass")).alias("is_pass"), "error", "mean")
    return rows.unionByName(again)


def _run_sql(name: str, flip: int, drop: int, twice: int) -> str:
    return f"""{name}0 AS (SELECT doc_id AS row_id, (quality = 1) <> (doc_id % {flip} = 0) AS is_pass, CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'e' END AS error, quality * 0.5::DOUBLE + (doc_id % {flip}) / 100.0 AS mean FROM labels WHERE doc_id % {drop} <> 0),
{name} AS (SELECT row_id, mean, CASE WHEN error IS NOT NULL THEN 'error' WHEN is_pass <> (row_id % {twice} = 0) THEN 'pass' ELSE 'fail' END AS status FROM {name}0)"""


@query(
    f"""WITH {_run_sql("b", 17, 5, 13)}, {_run_sql("c", 11, 7, 19)},
f AS (SELECT coalesce(b.row_id, c.row_id) AS row_id, b.status AS bs, c.status AS cs, round(c.mean - b.mean, 4) AS delta FROM b FULL JOIN c ON b.row_id = c.row_id)
SELECT CASE WHEN cs IS NULL THEN 'missing_current' WHEN bs IS NULL THEN 'missing_baseline' WHEN cs = 'error' AND bs <> 'error' THEN 'new_errors' WHEN bs = 'pass' AND cs = 'fail' THEN 'new_failures'
  WHEN bs IN ('fail', 'error') AND cs = 'pass' THEN 'fixed' WHEN bs = 'fail' AND cs = 'fail' THEN 'still_failing' WHEN bs = 'pass' AND cs = 'pass' THEN 'still_passing' ELSE 'unchanged_other' END AS bucket,
  count(*) AS n, round(avg(delta), 4) AS mean_delta FROM f GROUP BY 1"""
)
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of a full outer comparison of two derived runs with missing and repeated rows."""
    labels = load(spark, sf_dir, "labels")
    rows = report.compare_runs(_run(labels, 17, 5, 13), _run(labels, 11, 7, 19))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 4).alias("mean_delta"))


@query(
    f"""WITH {GRID_SQL}, s AS (SELECT doc_id % 2 AS run, metric, {SUMMARY_SQL} FROM g GROUP BY 1, 2), b AS (SELECT * FROM s WHERE run = 0 AND metric <> 'safety'), n AS (SELECT * FROM s WHERE run = 1 AND metric <> 'length')
SELECT coalesce(b.metric, n.metric) AS metric, b.mean AS base_mean, b.pass_rate AS base_rate, n.mean AS now_mean, n.pass_rate AS now_rate, round(n.mean - b.mean, 4) AS mean_delta, round(n.pass_rate - b.pass_rate, 4) AS rate_delta
FROM b FULL JOIN n ON b.metric = n.metric"""
)
def compare_metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs (even and odd ids) of which each lacks a metric."""
    s = report.metric_summary(grid(spark, sf_dir).withColumn("run", F.col("doc_id") % 2), "run", "metric")
    return report.metric_deltas(s.where("run = 0 AND metric <> 'safety'"), s.where("run = 1 AND metric <> 'length'"))


@query(
    """WITH m AS (SELECT p_brand AS metric, max(p_size) / 50 AS threshold, CAST(count(*) AS DOUBLE) AS weight FROM part GROUP BY 1),
o AS (SELECT p_brand AS metric, CASE WHEN min(p_size) % 2 = 0 THEN 0.25::DOUBLE END AS threshold, 3.0::DOUBLE AS weight FROM part GROUP BY 1 HAVING count(*) % 2 = 0)
SELECT m.metric, CASE WHEN o.metric IS NOT NULL THEN o.threshold ELSE m.threshold END AS threshold, CASE WHEN o.metric IS NOT NULL THEN o.weight ELSE m.weight END AS weight FROM m LEFT JOIN o USING (metric)"""
)
def snapshot_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics (brands) with overrides, of which some set a null threshold."""
    g = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("metric")).agg(F.max("p_size").alias("hi"), F.min("p_size").alias("lo"), F.count("*").alias("n"))
    over = g.where("n % 2 = 0").select("metric", F.when(F.col("lo") % 2 == 0, 0.25).alias("threshold"), F.lit(3.0).alias("weight"))
    return report.snapshot(g.select("metric", (F.col("hi") / 50).alias("threshold"), F.col("n").cast("double").alias("weight")), over)


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived votes: the task is the length mod 10; every seventh row has no answers."""
    vote = F.get(F.array(*map(F.lit, ("left", "right", "tie", "both_bad", "skip"))), (F.col("doc_id") % 6).cast("int"))
    answer = F.when(F.col("doc_id") % 7 != 0, F.col("source"))
    task = (F.col("n_chars") % 10).alias("task")
    return load(spark, sf_dir, "documents").select(task, "doc_id", answer.alias("answer_a"), F.when(F.col("doc_id") % 21 != 0, answer).alias("answer_b"), vote.alias("vote"), blind.display_order(F.col("n_chars") % 10, F.col("doc_id")).alias("display_order"))


@query(
    """WITH r AS (SELECT n_chars % 10 AS task, doc_id, CASE WHEN doc_id % 7 <> 0 THEN source END AS a, ['left', 'right', 'tie', 'both_bad', 'skip'][doc_id % 6 + 1] AS vote, (n_chars % 10 + doc_id) % 2 = 0 AS a_left FROM documents),
w AS (SELECT *, coalesce(a, '') <> '' AS answered, CASE WHEN vote = 'left' THEN a_left WHEN vote = 'right' THEN NOT a_left END AS a_wins FROM r)
SELECT task, count(*) AS total, count(*) FILTER (a IS NOT NULL) AS completed, count(*) FILTER (vote IS NOT NULL AND vote <> 'skip') AS voted, count(*) FILTER (answered AND a_wins) AS wins_a, count(*) FILTER (answered AND NOT a_wins) AS wins_b,
  count(*) FILTER (vote = 'tie') AS ties, count(*) FILTER (vote = 'both_bad') AS both_bad, count(*) FILTER (NOT answered) AS no_answer, count(*) - count(*) FILTER (vote IS NOT NULL AND vote <> 'skip') AS pending FROM w GROUP BY task"""
)
def blind_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blind.tally(_votes(spark, sf_dir), "task")


@query("""SELECT doc_id, CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2))::INT % 2 = 0 THEN 'ab' ELSE 'ba' END AS sides FROM documents""")
def blind_display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(blind.display_order_md5(F.col("doc_id").cast("string")), "").alias("sides"))


@query(
    """WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem),
k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM r)
SELECT count(*) AS n, round(corr(x, y), 4) AS pearson, round(corr(rx, ry), 4) AS spearman FROM k"""
)
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.correlation(load(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")))


@query("SELECT l_returnflag AS kind, round(avg(l_discount), 4) AS mean_x, round(avg(l_tax), 4) AS mean_y, count(*) AS n, count(*) FILTER (l_discount <> l_tax) AS changed FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
def stratified_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired means by kind and over all, with the number of rows that differ."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), "l_discount", "l_tax")
    mean = lambda c, n: F.round(F.avg(c), 4).alias(n)
    return rows.groupingSets([[F.col("kind")], []], F.col("kind")).agg(mean("l_discount", "mean_x"), mean("l_tax", "mean_y"), F.count("*").alias("n"), F.count_if(F.col("l_discount") != F.col("l_tax")).alias("changed"))


@query(
    """WITH r AS (SELECT user_id, ['pending', 'running', 'completed'][user_id % 3 + 1] AS status, min(ts) AS started_at, max(CASE WHEN event_type <> 'error' THEN ts END) AS last_beat FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, status, started_at, last_beat FROM r, n WHERE status IN ('pending', 'running') AND started_at < now - INTERVAL 12 HOUR AND (last_beat IS NULL OR last_beat < now - INTERVAL 6 HOUR)"""
)
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are users: begun with their first event, alive at each event but errors; now is the last event."""
    e = load(spark, sf_dir, "events")
    status = F.get(F.array(F.lit("pending"), F.lit("running"), F.lit("completed")), (F.col("user_id") % 3).cast("int")).alias("status")
    runs = e.groupBy("user_id").agg(F.min("ts").alias("started_at")).select("user_id", status, "started_at")
    runs = runs.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    return progress.stale(runs, e.where("event_type <> 'error'"), F.col("now"), "user_id", "12 hours", "6 hours").select("user_id", "status", "started_at", "last_beat")


@query("SELECT event_type, count(*) AS done, count(CASE WHEN value > 100 THEN 'slow' END) AS errors, max(ts) AS last_ts FROM events GROUP BY event_type")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final state of a file stream over events, run until its present end; the state goes to files."""
    schema = load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file
    state = progress.progress(stream.withColumn("error", F.when(F.col("value") > 100, "slow")), "event_type")
    name = f"progress_{uuid.uuid4().hex}"
    base = f"{shared_dir(spark)}/{name}"
    progress.to_files(state, f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return progress.current(spark.read.parquet(f"{base}/state"), "event_type")
