"""From long scores (run, row_id, metric, score, label) to verdicts, summaries, reliability and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import scores as S
from evalspark.functions import text as T

DEFAULT_THRESHOLD, LOW_CONFIDENCE, CONSISTENT = 0.7, 0.1, 0.9


def count_if(c: Column) -> Column:
    return F.count_if(c).cast("long")


def row_verdicts(scores: DataFrame, *row: str) -> DataFrame:
    """is_pass of each row: every metric with a threshold has a score of at least it; rows without thresholds pass."""
    value = S.numeric(F.col("score"), F.col("label")) if "label" in scores.columns else F.col("score")
    met = F.when(F.col("threshold").isNotNull(), F.coalesce(value >= F.col("threshold"), F.lit(False)))
    return scores.groupBy(*row).agg(F.coalesce(F.bool_and(met), F.lit(True)).alias("is_pass"))


def row_stats(rows: DataFrame, *run: str) -> DataFrame:
    """Rows, passed, failed and errors of each run; rows without a verdict count in total only."""
    return rows.groupBy(*run).agg(F.count("*").alias("total"), count_if(F.col("is_pass")).alias("passed"), count_if(~F.col("is_pass")).alias("failed"), F.count("error").alias("errors"))


def metric_summary(scores: DataFrame, *key: str) -> DataFrame:
    """Mean, min, max, pass rate (over scored rows; default threshold 0.7), count and errors of each metric. NaN counts as no score."""
    s = F.when(~F.isnan("score"), F.col("score"))
    at = F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))
    r = lambda c: F.round(c, 4)
    return scores.groupBy(*key).agg(
        r(F.avg(s)).alias("mean"), r(F.min(s)).alias("min"), r(F.max(s)).alias("max"), r(F.avg((s >= at).cast("double"))).alias("pass_rate"), F.count(s).alias("n"), (F.count("*") - F.count(s)).alias("errors")
    )


def partial_summary(scores: DataFrame, *key: str) -> DataFrame:
    """What a batch of scores adds to `metric_summary`: states that merge in any order. Sums are decimal, so their order makes no difference."""
    s = F.when(~F.isnan("score"), F.col("score"))
    at = F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))
    return scores.groupBy(*key).agg(F.sum(s.cast("decimal(30,15)")).alias("total"), F.min(s).alias("min"), F.max(s).alias("max"), count_if(s >= at).alias("passed"), F.count(s).alias("n"), F.count("*").alias("all"))


def merged_summary(parts: DataFrame, *key: str) -> DataFrame:
    """`metric_summary` out of partial ones: a state a batch is read, not a score."""
    r = lambda c: F.round(c, 4)
    n = F.sum("n")
    return parts.groupBy(*key).agg(
        r(F.try_divide(F.sum("total").cast("double"), n)).alias("mean"), r(F.min("min")).alias("min"), r(F.max("max")).alias("max"), r(F.try_divide(F.sum("passed"), n)).alias("pass_rate"), n.alias("n"), (F.sum("all") - n).alias("errors")
    )


def weighted_total(summary: DataFrame, *run: str) -> DataFrame:
    """Weighted mean of the (rounded) metric means; metrics without a mean or a positive weight take no part. A half of the last digit goes up, in whatever order the sums were made."""
    w = F.when(F.col("mean").isNotNull() & (F.col("weight") > 0), F.col("weight"))
    return summary.groupBy(*run).agg(F.round(F.try_divide(F.sum(F.col("mean") * w), F.sum(w)) + 1e-9, 4).alias("weighted_total"), F.count(w).alias("metric_count"))


def cost(tokens: DataFrame, *run: str, price_in: float = 0.0008, price_out: float = 0.002) -> DataFrame:
    """Token sums and their price; a run without tokens has no cost."""
    out = tokens.groupBy(*run).agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))
    price = F.col("prompt_tokens") / 1000 * price_in + F.col("completion_tokens") / 1000 * price_out
    return out.withColumn("cost", F.when(F.col("prompt_tokens") + F.col("completion_tokens") > 0, F.round(price, 6)))


def reliability(scores: DataFrame, *key: str) -> DataFrame:
    """Stability of each metric over its scored rows: mean deviation of samples, low-confidence rows, swap consistency, judge deviation."""
    ok = F.col("score").isNotNull()
    of = lambda c: F.when(ok, F.col(c))
    return scores.groupBy(*key).agg(
        F.round(F.avg(of("score_std")), 4).alias("avg_score_std"),
        count_if(of("score_std") > LOW_CONFIDENCE).alias("low_confidence"),
        F.round(F.avg(of("swap_consistency")), 4).alias("avg_swap_consistency"),
        count_if(of("swap_consistency") < CONSISTENT).alias("inconsistent"),
        F.round(F.avg(of("judge_mad")), 4).alias("avg_judge_mad"),
    )


def overall_reliability(per_metric: DataFrame, *run: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    return per_metric.groupBy(*run).agg(mean("avg_score_std"), F.sum("low_confidence").alias("low_confidence"), mean("avg_swap_consistency"), F.sum("inconsistent").alias("inconsistent"), mean("avg_judge_mad"))


def sampled(samples: DataFrame, *key: str, digits: int = 4) -> DataFrame:
    """One result out of several samples (idx, score, reason): mean, population deviation, the reason nearest the mean (first by idx on ties, then by itself). Null scores take no part."""
    # two aggregations on one key: the second needs the mean of the first; a window would keep whole groups
    own = samples.where("score IS NOT NULL")
    mean = own.groupBy(*key).agg(F.avg("score").alias("_mean"), F.stddev_pop("score").alias("_std"), F.count("*").alias("n_samples"))
    near = own.join(mean, list(key)).groupBy(*key).agg(
        F.round(F.first("_mean"), digits).alias("score"), F.round(F.first("_std"), digits).alias("score_std"), F.first("n_samples").alias("n_samples"), F.min_by("reason", F.struct(F.round(F.abs(F.col("score") - F.col("_mean")), 9), "idx", "reason")).alias("reason")
    )
    return near


def panel(judges: DataFrame, *key: str, digits: int = 4) -> DataFrame:
    """One result out of several judges (idx, judge, score): mean, mean absolute deviation, and each judge's score."""
    mean = judges.where("score IS NOT NULL").groupBy(*key).agg(F.avg("score").alias("_mean"))
    return judges.join(mean, list(key), "left").groupBy(*key).agg(
        F.round(F.first("_mean"), digits).alias("score"), F.round(F.avg(F.abs(F.col("score") - F.col("_mean"))), digits).alias("judge_mad"), F.array_sort(F.collect_list(F.struct("judge", F.round("score", digits).alias("score")))).alias("by_judge")
    )


def majority(votes: DataFrame, *key: str) -> DataFrame:
    """The most frequent label, the one seen first on ties, of those seen together the first by name; a null label votes as 'None'."""
    label = F.coalesce("label", F.lit("None"))
    each = votes.groupBy(*key, label.alias("label")).agg(F.count("*").alias("votes"), F.min("idx").alias("_first"))
    return each.groupBy(*key).agg(F.min_by("label", F.struct(-F.col("votes"), "_first", "label")).alias("label"), F.max("votes").alias("votes"))


def agreement(rows: DataFrame, *run: str) -> DataFrame:
    """Human (manual: pass or fail) against automatic verdicts: agreement and Cohen's kappa, null where chance alone agrees always."""
    own = rows.where(F.col("manual").isin("pass", "fail") & F.col("is_pass").isNotNull() & F.col("error").isNull())
    m, a = F.col("manual") == "pass", F.col("is_pass")
    out = own.groupBy(*run).agg(F.count("*").alias("n"), count_if(m & a).alias("both_pass"), count_if(m & ~a).alias("manual_only"), count_if(~m & a).alias("auto_only"), count_if(~m & ~a).alias("both_fail"))
    n = F.col("n").cast("double")
    po = (F.col("both_pass") + F.col("both_fail")) / n
    pe = ((F.col("both_pass") + F.col("manual_only")) * (F.col("both_pass") + F.col("auto_only")) + (F.col("both_fail") + F.col("auto_only")) * (F.col("both_fail") + F.col("manual_only"))) / (n * n)
    kappa = F.when(pe != 1, F.round((po - pe) / (1 - pe), 4))
    return out.withColumn("agreement", F.round(po, 4)).withColumn("kappa", kappa).withColumn("suggest_review", F.coalesce((kappa < 0.7) & (F.col("n") >= 10), F.lit(False)))


def last_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`, of equal ones the one of the largest values; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *T.orderable(rows, rest))).alias("_r")).select(*key, "_r.*")


def compare_runs(base: DataFrame, now: DataFrame, key: str = "row_id", order: str = "result_id") -> DataFrame:
    """Full outer comparison of two runs' rows (is_pass, error, mean): bucket and delta of each row. Of repeated keys the last row counts."""
    side = lambda df, n: last_of(df, [key], order).select(key, S.row_status(F.col("error"), F.col("is_pass")).alias(f"{n}_status"), F.col("mean").alias(f"{n}_mean"))
    both = side(base, "base").join(side(now, "now"), key, "full_outer")
    return both.select(key, "base_status", "now_status", S.change_bucket(F.col("base_status"), F.col("now_status")).alias("bucket"), F.round(F.col("now_mean") - F.col("base_mean"), 4).alias("delta"))


def metric_deltas(base: DataFrame, now: DataFrame) -> DataFrame:
    """(metric, mean, pass_rate) summaries of two runs side by side, with metrics that only one of them has."""
    b, n = (df.select("metric", F.col("mean").alias(f"{k}_mean"), F.col("pass_rate").alias(f"{k}_rate")) for df, k in ((base, "base"), (now, "now")))
    return b.join(n, "metric", "full_outer").select("*", F.round(F.col("now_mean") - F.col("base_mean"), 4).alias("mean_delta"), F.round(F.col("now_rate") - F.col("base_rate"), 4).alias("rate_delta"))


def snapshot(metrics: DataFrame, overrides: DataFrame) -> DataFrame:
    """Metrics of a scenario with their overrides: an override that is present wins, null or not."""
    o = overrides.select("metric", F.lit(True).alias("_present"), F.col("threshold").alias("_t"), F.col("weight").alias("_w"))
    pick = lambda mine, base: F.when(F.col("_present"), F.col(mine)).otherwise(F.col(base)).alias(base)
    return metrics.join(o, "metric", "left").select("metric", pick("_t", "threshold"), pick("_w", "weight"))


def page(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """One page of a listing, numbered from 1 in its order (top-k: no full sort). `order` must decide ties."""
    cut = rows.orderBy(*order).offset(offset).limit(size)
    return cut.withColumn("position", (F.row_number().over(Window.orderBy(*order)) + offset).cast("long"))


def ranks(df: DataFrame, value: str, name: str, parts: int = 256) -> DataFrame:
    """Add average ranks (ties share their mean rank) without sorting in one task.

    Distinct values are counted first and dealt into ranges at approximate percentiles (one row,
    part of the same plan); a value's rank is the count in earlier ranges, plus the running count in
    its own.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    ranged = with_range(counts, df, value, parts)
    totals = ranged.groupBy("_p").agg(F.sum("_n").alias("_t"))
    before = totals.withColumn("_before", F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).select("_p", "_before")  # at most `parts` rows
    inner = F.sum("_n").over(Window.partitionBy("_p").orderBy(value))
    placed = ranged.withColumn("_inner", inner).join(F.broadcast(before), "_p").select(value, (F.col("_before") + F.col("_inner") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(placed, value)


def with_range(rows: DataFrame, whole: DataFrame, value: str, parts: int) -> DataFrame:
    """Add `_p`: how many of the percentiles of `whole` are no larger than a row's value. Two steps: among every sixteenth of them, then among the sixteen there."""
    at = F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts))
    coarse = F.filter("_q", lambda q, i: i % 16 == 15)
    splits = F.broadcast(whole.agg(F.array_distinct(at).alias("_q")).withColumn("_c", coarse))  # one row
    below = lambda qs: F.size(F.filter(qs, lambda q: q <= F.col(value)))
    step = rows.crossJoin(splits).withColumn("_k", 16 * below(F.col("_c")))
    return step.withColumn("_p", F.coalesce(F.col("_k") + below(F.slice("_q", F.col("_k") + 1, 16)), F.lit(0))).drop("_q", "_c", "_k")


def correlation(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Pearson and Spearman of complete pairs; null with under three pairs or without variance."""
    own = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = ranks(ranks(own, x, "_rx"), y, "_ry")

    def corr(a: str, b: str) -> Column:
        a, b = F.col(a).cast("double"), F.col(b).cast("double")
        cov = F.covar_pop(a, b)
        sd = F.stddev_pop(a) * F.stddev_pop(b)
        return F.when((F.count("*") >= 3) & (sd > 0), F.round(F.try_divide(cov, sd), 4))

    return ranked.agg(F.count("*").alias("n"), corr(x, y).alias("pearson"), corr("_rx", "_ry").alias("spearman"))
