"""Row-level metrics as column functions. A missing input gives null, not 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import bind, clamp, col

#: Labels that count as passed.
PASS_LABELS = ("pass", "yes", "true", "1")


def hit_rate(retrieved: Column | str, gold: Column | str, k: int = 5) -> Column:
    """1 if one of the gold ids is among the first k retrieved, else 0; null without gold."""
    found = F.coalesce(F.arrays_overlap(F.slice(col(retrieved), 1, k), col(gold)), F.lit(False))
    return F.when(F.size(col(gold)) > 0, found.cast("double"))


def reciprocal_rank(retrieved: Column | str, gold: Column | str, digits: int | None = 4) -> Column:
    """1 / rank of the first gold id, over all retrieved; 0 if there is none; null without gold."""
    rank = F.array_min(F.filter(F.transform(col(gold), lambda g: F.array_position(col(retrieved), g)), lambda r: r > 0))
    value = F.coalesce(1.0 / rank, F.lit(0.0))
    return F.when(F.size(col(gold)) > 0, F.round(value, digits) if digits is not None else value)


def tool_call_accuracy(expected: Column | str, actual: Column | str) -> Column:
    """Share of expected calls (canonical texts) that are made; each actual call counts once. Extra calls cost nothing."""
    e, a = col(expected), col(actual)
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    hits = F.aggregate(F.array_distinct(e), F.lit(0), lambda t, x: t + F.least(times(e, x), times(a, x)))
    return F.when(F.size(e) > 0, F.round(hits / F.size(e), 4))


def argument_score(expected: Column, actual: Column) -> Column:
    """Share of the expected arguments (map) that the call has with equal value; without any: 1 if the call has none either, else 0.8."""
    same = F.size(F.filter(F.map_entries(expected), lambda e: F.try_element_at(actual, e["key"]).eqNullSafe(e["value"])))
    return F.when(F.size(expected) == 0, F.when(F.size(actual) == 0, 1.0).otherwise(0.8)).otherwise(same / F.size(expected))


def argument_correctness(expected: Column | str, actual: Column | str) -> Column:
    """Mean argument score over expected calls (structs name, args): each in turn takes the unused call of its name with the best score, the first on ties."""
    e, a = col(expected), col(actual)
    indexed = F.transform(a, lambda c, i: F.struct(c["name"].alias("name"), c["args"].alias("args"), i.alias("i")))

    def step(acc: Column, want: Column) -> Column:
        scored = F.transform(F.filter(acc["u"], lambda c: c["name"] == want["name"]), lambda c: F.struct(argument_score(want["args"], c["args"]).alias("s"), (-c["i"]).alias("i")))
        best = F.array_max(scored)
        return F.struct(F.filter(acc["u"], lambda c: F.coalesce(c["i"] != -best["i"], F.lit(True))).alias("u"), (acc["t"] + F.coalesce(best["s"], F.lit(0.0))).alias("t"))

    total = F.aggregate(e, F.struct(indexed.alias("u"), F.lit(0.0).alias("t")), step, lambda acc: acc["t"])
    return F.when(F.size(e) > 0, F.round(total / F.size(e), 4))


def step_efficiency(expected: Column, actual: Column) -> Column:
    """min / max of the numbers of steps; 0 without an actual one; null without an expected one."""
    return F.when(expected > 0, F.when(actual > 0, F.round(F.least(expected, actual) / F.greatest(expected, actual), 4)).otherwise(0.0))


def swap_consistency(score: Column, swapped: Column) -> Column:
    return F.round(clamp(1.0 - F.abs(F.round(score, 4) - swapped)), 4)


def numeric(score: Column, label: Column) -> Column:
    """The score, else 1 or 0 by the label; null without both."""
    return F.coalesce(score, F.when(label.isNotNull(), F.lower(F.trim(label)).isin(*PASS_LABELS).cast("double")))


def discrete(answer: Column, allowed: Column) -> Column:
    """The allowed label that an answer names: exactly, but for case, or within it."""
    first = lambda test: F.get(F.filter(allowed, test), 0)
    return F.coalesce(first(lambda x: x == answer), first(lambda x: F.lower(x) == F.lower(answer)), first(lambda x: F.contains(F.lower(answer), F.lower(x))))


def aspect(score: Column) -> Column:
    return F.when(score.isNotNull(), (score >= 0.5).cast("double"))


def row_status(error: Column, passed: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(passed, "pass").when(~passed, "fail").otherwise("unknown")


def change_bucket(base: Column, now: Column) -> Column:
    """Where a row goes in a comparison, from the two statuses (null: the row is missing there). Pairs that no rule names: unchanged_other."""
    return (
        F.when(now.isNull(), "missing_current")
        .when(base.isNull(), "missing_baseline")
        .when((now == "error") & (base != "error"), "new_errors")
        .when((base == "pass") & (now == "fail"), "new_failures")
        .when(base.isin("fail", "error") & (now == "pass"), "fixed")
        .when((base == "fail") & (now == "fail"), "still_failing")
        .when((base == "pass") & (now == "pass"), "still_passing")
        .otherwise("unchanged_other")
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two double arrays over their common length, within 0 and 1; 0 for empty or zero vectors."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    short = lambda v: F.slice(v["p"], 1, F.least(F.size(v["p"]), F.size(v["q"])))
    other = lambda v: F.slice(v["q"], 1, F.least(F.size(v["p"]), F.size(v["q"])))
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    value = lambda v: F.try_divide(dot(short(v), other(v)), F.sqrt(dot(short(v), short(v))) * F.sqrt(dot(other(v), other(v))))
    return F.coalesce(clamp(bind(F.struct(col(a).alias("p"), col(b).alias("q")), value)), F.lit(0.0))
