"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Per language and source (a small group: per language, or over all documents), the statistics of
every document are transformed into a vector, and the mean and covariance of the tightest three quarters of the vectors are searched for by
concentration steps from several starts. A document far from them, by Mahalanobis distance, is
rejected. Only DataFrame functions are used.

A concentration step is one pass: each row's distance to its group's present estimate falls into
a bin (eight an octave), and counts, sums and products are added up per group, start and bin, so
what is shuffled is bounded by groups x starts x bins and a group of any size is combined before
the shuffle. The subset is the least number of whole bins that hold `KEEP` of the group. Vectors
are whole numbers on a grid, so sums are exact and don't depend on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import materialize, release

#: Fixed values of the contract.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50

GRID = 1024  # a vector's component is a whole number of 1/GRID
DIM = 5
KEEP = 0.75
STARTS, FIRST_STEPS, LAST_STEPS = 4, 2, 4
BINS, LOWEST = 8, -160  # an octave; the lowest bin
MIN_GROUP = 60  # a group with fewer vectors takes the estimate of its language, or, if that has fewer too, of all documents
#: The least standard deviation of each component: one that is nearly always zero mustn't reject what differs a little.
FLOOR = (0.25, 0.25, 0.1, 0.1, 0.1)
REWEIGHT, REJECT = 0.975, 1e-3  # share of a Gaussian that the last step keeps, and that is rejected


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_tail(x: float, dim: int = DIM) -> float:
    """P(chi2 > x) for an odd number of dimensions, in closed form (exact far out in the tail)."""
    t = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, (dim - 1) // 2 + 1):
        t += term
        term *= x / (2 * k + 1)
    return t


def chi2_cut(tail: float, dim: int = DIM) -> float:
    """The distance that a share `tail` of Gaussian vectors exceeds, by bisection."""
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, dim) > tail else (lo, mid)
    return hi


def consistency(share: float, dim: int = DIM) -> float:
    """What makes the covariance of a Gaussian's central share unbiased."""
    return share / gamma_p(dim / 2 + 1, chi2_cut(1 - share, dim) / 2)


# ---------------------------------------------------------------- statistics


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, `carry`, the contract's counts, and n_lines (lines with a word) of every whole text; null: none."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *carry, text.alias("_t"), F.btrim(text, F.lit(SPACE)).alias("_b"))
    word = F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", f"[{SPACE}]+"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, SPACE, "") != "")
    rows = rows.select(
        "doc_id",
        *carry,
        word.alias("_w"),
        F.length(F.translate("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        # a text without a line end has one line, so nothing to compare
        F.when(F.col("_b").contains("\n"), lines).otherwise(F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.array(F.lit("")))).alias("_l"),
    )
    # a window is known by a 64-bit hash of its three words
    windows = F.when(F.size("_w") >= 3, F.expr("transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))"))
    rows = rows.select(
        "doc_id",
        *carry,
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        windows.alias("_h"),
    )
    repeats = F.size("_h") > F.size(F.array_distinct("_h"))
    rows = rows.withColumn("_s", F.when(repeats, F.expr("sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i)))")))
    found = F.expr("transform(filter(_s, (x, k) -> x.h <=> get(_s, k - 1).h OR x.h <=> get(_s, k + 1).h), x -> x.i)")
    rows = rows.select("doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.sort_array(found).alias("_p"))
    covered = F.expr("aggregate(transform(_p, (x, k) -> CAST(least(3, x - coalesce(get(_p, k - 1), -3)) AS bigint)), 0L, (a, x) -> a + x)")
    return rows.select("doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines")


def vector() -> list[Column]:
    """Transformed statistics on the grid: length, word length, symbols, repeated lines, repeated words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda a, b: F.least(F.lit(1.0), F.col(a) / b)
    parts = [
        F.log1p(F.col("n_words").cast("double")),
        F.least(F.lit(60.0), F.col("word_chars") / words),
        F.least(F.lit(8.0), F.sqrt(F.col("n_symbols") / words)),
        F.asin(F.sqrt(share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))))),
        F.asin(F.sqrt(share("n_repeat_words", words))),
    ]
    return [F.round(p * GRID).cast("long") for p in parts]


# ---------------------------------------------------------------- estimates

PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]
GROUP = ["lang", "source"]
KEY = ["level", *GROUP]  # of an estimate: 0: a group, 1: a language, 2: all documents
_ESTIMATE = [f"m{i}" for i in range(DIM)] + [f"l{i}{j}" for i, j in PAIRS]
_SUMS = ["n", *[f"s{i}" for i in range(DIM)], *[f"q{i}{j}" for i, j in PAIRS]]


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]]


def _estimate(sums: DataFrame, factor: float = 1.0) -> DataFrame:
    """Means, the Cholesky factor of the (floored) covariance, and its log determinant, out of exact sums."""
    out = sums
    n = F.col("n").cast("double")
    for i in range(DIM):
        out = out.withColumn(f"m{i}", F.col(f"s{i}") / n)
    for i, j in PAIRS:
        # n * q - s * s in decimals: no cancellation
        exact = F.col("n").cast("decimal(19,0)") * F.col(f"q{i}{j}").cast("decimal(19,0)") - F.col(f"s{i}").cast("decimal(19,0)") * F.col(f"s{j}").cast("decimal(19,0)")
        cov = exact.cast("double") / n / n * factor
        floor = (FLOOR[i] * GRID) ** 2 if i == j else 0.0
        for k in range(j):
            cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov + floor, F.lit(floor / 4))) if i == j else cov / F.col(f"l{j}{j}"))
    log = F.lit(0.0)
    for i in range(DIM):
        log = log + F.log(F.col(f"l{i}{i}"))
    return out.withColumn("log_det", log)


def _distance(rows: DataFrame, name: str = "d2") -> DataFrame:
    """Add the squared Mahalanobis distance to the estimate in the row, by forward substitution."""
    for i in range(DIM):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"_z{j}")
        rows = rows.withColumn(f"_z{i}", z / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(DIM):
        total = total + F.col(f"_z{i}") * F.col(f"_z{i}")
    return rows.withColumn(name, total)


def _step(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step of every key and start."""
    near = _distance(rows.join(estimate.select(*KEY, "start", *_ESTIMATE), KEY))
    bin_ = F.greatest(F.lit(LOWEST), F.floor(F.log2(F.greatest("d2", F.lit(1e-30))) * BINS)).cast("int")
    binned = near.withColumn("bin", bin_).groupBy(*KEY, "start", "bin").agg(*_sums())
    own = Window.partitionBy(*KEY, "start")
    run = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inner = binned.withColumn("_before", F.coalesce(F.sum("n").over(run), F.lit(0))).withColumn("_all", F.sum("n").over(own)).where(F.col("_before") < F.ceil(F.col("_all") * KEEP))
    return _estimate(inner.groupBy(*KEY, "start").agg(*[F.sum(c).alias(c) for c in _SUMS]))


def _starts(rows: DataFrame) -> DataFrame:
    """Start 0: all rows of a key. The others: DIM + 1 rows each, the least by a keyed hash in as many parts."""
    all_rows = rows.groupBy(*KEY).agg(*_sums())
    x = [f"x{i}" for i in range(DIM)]
    key = F.xxhash64(F.col("start"), *x)
    few = rows.withColumn("start", F.explode(F.array(*[F.lit(s) for s in range(1, STARTS)]))).withColumn("_k", key)
    few = few.groupBy(*KEY, "start", F.pmod("_k", F.lit(DIM + 1)).alias("_p")).agg(F.min(F.struct("_k", *x)).alias("r"))
    few = few.select(*KEY, "start", *[F.col(f"r.{c}").alias(c) for c in x]).groupBy(*KEY, "start").agg(*_sums())
    return _estimate(all_rows.withColumn("start", F.lit(0)).select(*KEY, "start", *_SUMS).unionByName(few.select(*KEY, "start", *_SUMS)))


def _levels(found: DataFrame) -> DataFrame:
    """(lang, source, level): the narrowest level at which a group has MIN_GROUP vectors, else that of all documents, however few."""
    groups = materialize(found.groupBy(*GROUP).agg(F.count_if(~F.col("base_failed")).alias("n")), "groups")
    of_lang = groups.groupBy("lang").agg(F.sum("n").alias("_lang"))
    level = F.when(F.col("n") >= MIN_GROUP, 0).when(F.col("_lang") >= MIN_GROUP, 1).otherwise(2)
    out = materialize(groups.join(of_lang, "lang").select(*GROUP, level.alias("level")), "levels")
    release(groups)
    return out


def _keys(level: int) -> list[Column]:
    """A group's key at a level."""
    return [F.lit(level).alias("level"), *[(F.col(c) if k + level < 2 else F.lit("")).alias(c) for k, c in enumerate(GROUP)]]


def estimates(found: DataFrame) -> DataFrame:
    """The estimate that each group (lang, source) is held against: means and Cholesky factor.

    `found` is a stored table (lang, source, base_failed, x0..). A group of MIN_GROUP vectors has its own
    estimate; a smaller one takes that of all vectors of its language, or, if these are too few, of all vectors,
    however few there are: the floors keep the covariance of any number of vectors regular.
    """
    levels = _levels(found)
    x = [f"x{i}" for i in range(DIM)]
    good = found.where(~F.col("base_failed"))
    parts = [good.join(levels.where(F.col("level") == n).select(*on).distinct(), on, "left_semi").select(*_keys(n), *x) for n, on in ((0, GROUP), (1, ["lang"]))]
    any_ = F.broadcast(levels.where("level = 2").select("level").limit(1))  # one row
    parts.append(good.crossJoin(any_).select(*_keys(2), *x))
    vectors = materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]), "vectors")
    fitted = _fit(vectors)
    own = levels.select(*[F.col(c).alias(f"_{c}") for c in GROUP], "level", *[F.when(F.col("level") + k < 2, F.col(c)).otherwise("").alias(c) for k, c in enumerate(GROUP)])
    out = materialize(own.join(fitted, KEY).select(*[F.col(f"_{c}").alias(c) for c in GROUP], *_ESTIMATE), "estimates")
    release(levels, vectors, fitted)
    return out


def _fit(rows: DataFrame) -> DataFrame:
    """The reweighted minimum-covariance-determinant estimate of each key's vectors (level, lang, source, x0..).

    `rows` is a stored table. Of the starts the one of the least determinant after the first steps
    goes on, the first of equal ones. Each estimate table is stored before it is joined, so its size
    is known when the join is planned: it is broadcast only under Spark's own limit, beyond it the
    join is by group.
    """

    def stored(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
        out = materialize(new, "mcd")
        if old is not None:
            release(old)
        return out

    now = stored(_starts(rows))
    for _ in range(FIRST_STEPS):
        now = stored(_step(rows, now), now)
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("log_det", "start"))
    now = stored(now.withColumn("_r", rank).where("_r = 1").drop("_r"), now)
    for _ in range(LAST_STEPS):
        now = stored(_step(rows, now), now)
    # reweighting: all vectors within the scaled estimate's Gaussian cut
    cut = chi2_cut(1 - REWEIGHT) * consistency(KEEP)
    near = _distance(rows.join(now.select(*KEY, *_ESTIMATE), KEY)).where(F.col("d2") <= cut)
    return stored(_estimate(near.groupBy(*KEY).agg(*_sums()), consistency(REWEIGHT)), now)


def quality(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """One row per document row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    Null texts count as empty, null languages and sources as ''. Base rules: under 50 words, or
    over half of the words in repeated three-word windows. Rows that fail them are no part of the
    estimates and not kept. `distance` is the squared Mahalanobis distance (null only where no row
    of the table passes the base rules); kept means at most the cut that a Gaussian exceeds with
    probability `reject`. Texts of any length count whole; repeated rows and null doc_ids stay;
    extra columns are ignored; an empty table gives none.
    """
    key = [F.coalesce(c, F.lit("")).alias(c) for c in GROUP]
    found = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, "text"), *GROUP)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    found = found.withColumn("base_failed", failed).select("*", *[v.alias(f"x{i}") for i, v in enumerate(vector())])
    found = materialize(found, "statistics")
    fitted = estimates(found)
    out = _distance(found.join(fitted.select(*GROUP, *_ESTIMATE), GROUP, "left"), "distance")
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_cut(reject))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
