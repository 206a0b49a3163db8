"""Metric definitions: which executor scores them, their prompts and what these refer to, and the judges of custom metrics."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from evalspark.functions import scores as S
from evalspark.functions import text as T
from evalspark.operators import judge

#: Types that code scores, types of custom prompts, and the two composite judges.
CODE = ("code_retrieval_hit_rate", "code_retrieval_mrr", "builtin_tool_call_accuracy", "builtin_argument_correctness", "builtin_step_efficiency")
CUSTOM = ("numeric", "discrete", "aspect_critic")
COMPOSITE = ("builtin_faithfulness_claim", "builtin_answer_relevancy_generative")
#: A range of decimal scores, and a choice of 0 or 1, in a prompt.
DECIMAL_RANGE = r"0\.\d+\s*(?:到|至|~|-)\s*(?:0\.\d+|1(?:\.0)?)|0\s*(?:到|至|~|-)\s*1(?:\.0)?"
BINARY = r"0\s*(?:或|/|和|、)\s*1"


def executor(metric_type: Column | str, name: Column | str) -> Column:
    """Who scores a metric: composite, judge (by name, then by type), code, or custom; null for an unknown type."""
    kind, named = T.col(metric_type), T.col(name)
    builtin = [f"builtin_{m}" for m in judge.CATALOG]
    return F.when(kind.isin(*COMPOSITE), "composite").when(named.isin(*judge.CATALOG) | kind.isin(*builtin), "judge").when(kind.isin(*CODE), "code").when(kind.isin(*CUSTOM), "custom")


def is_sampled(executor_: Column | str) -> Column:
    """Whether repeated judgements, panels and swaps make sense: code always gives the same score."""
    return F.coalesce(T.col(executor_).isin("composite", "judge", "custom"), F.lit(False))


def score_range(metric_type: Column | str, allowed: Column | str) -> Column:
    """What a metric's scores may be, in words. allowed: array of texts (two ends, or labels), null for the default."""
    kind, given = T.col(metric_type), T.col(allowed)
    ends = F.coalesce(F.when(F.size(given) > 0, given), F.array(F.lit("0"), F.lit("1")))
    labels = F.coalesce(F.when(F.size(given) > 0, given), F.array(F.lit("pass"), F.lit("fail")))
    between = F.concat(F.get(ends, 0), F.lit(" 到 "), F.get(ends, 1))
    return F.when((kind == "numeric") & (F.size(ends) >= 2), between).when(kind == "discrete", F.array_join(labels, " / ")).when(kind == "aspect_critic", "0 或 1").otherwise("0 到 1")


def template(metrics: DataFrame, override: Column | None = None) -> Column:
    """A metric's prompt: the override if it isn't blank, else what its type is configured by (columns prompt, definition, description, display_name)."""
    have = lambda *names: [F.nullif(F.col(n), F.lit("")) for n in names if n in metrics.columns]
    aspect = F.coalesce(*have("definition", "description", "display_name"), F.lit(""))
    other = F.coalesce(*have("prompt", "definition", "description"), F.lit(""))
    own = F.when(F.col("metric_type") == "aspect_critic", aspect).otherwise(other)
    return F.coalesce(F.nullif(F.trim(override), F.lit("")), own) if override is not None else own


def variables(prompt: Column | str) -> Column:
    """Names that a column of prompts refers to, sorted, once each."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(T.col(prompt), F.lit(r"(?<!\{)\{([A-Za-z_][\w.]*)\}(?!\})"), F.lit(1))))


def excluded_fields(names: Column | str) -> Column:
    """Sample fields that a prompt holds already: plain names, and those behind `dataset.` or `endpoint.`."""
    plain = lambda n: F.when(~n.contains("."), n).otherwise(F.nullif(F.regexp_extract(n, r"^(?:dataset|endpoint)\.(.+)$", 1), F.lit("")))
    return F.array_distinct(F.array_compact(F.transform(T.col(names), plain)))


def diagnose(metrics: DataFrame, prompt: str, present: str, endpoint_mode: bool = False) -> Column:
    """Conflicts between a metric's type, its prompt and a sample. present: names of the sample's fields that have a value, with their namespaces."""
    kind, said = F.col("metric_type"), F.replace(F.col(prompt), F.lit("～"), F.lit("~"))
    decimal = said.rlike(DECIMAL_RANGE)
    clash = F.array(
        F.when((kind == "aspect_critic") & decimal, "aspect_with_range"),
        F.when((kind == "numeric") & said.rlike(BINARY) & ~decimal, "numeric_with_binary"),
        F.when((kind == "discrete") & decimal, "discrete_with_range"),
    )

    def lacking(n: Column) -> Column:
        unseen = F.when(~F.array_contains(F.col(present), n), F.concat(F.lit("empty:"), n))
        return unseen if endpoint_mode else F.when(n.startswith("endpoint."), F.concat(F.lit("no_endpoint:"), n)).otherwise(unseen)

    return F.array_compact(F.concat(clash, F.transform(variables(prompt), lacking)))


@dataclass(frozen=True)
class Custom:
    """A custom metric: kind numeric (bounds), discrete (labels) or aspect_critic, and its prompt with {field}, {dataset.field}, {endpoint.field} and {metric.field} variables."""

    name: str
    kind: str
    prompt: str
    bounds: tuple[float, float] = (0.0, 1.0)
    labels: tuple[str, ...] = ("pass", "fail")
    threshold: float | None = None
    weight: float | None = None
    required: tuple[str, ...] = field(default=())

    def columns(self) -> dict[str, Column]:
        """The `metric.` namespace of a prompt."""
        given = {"numeric": [f"{b:g}" for b in self.bounds], "discrete": list(self.labels)}.get(self.kind)
        allowed = F.array(*map(F.lit, given)) if given else F.lit(None).cast("array<string>")
        values = {"name": self.name, "metric_type": self.kind, "pass_threshold": self.threshold, "weight": self.weight, "required_fields": ",".join(self.required)}
        return {f"metric.{k}": F.lit(v) for k, v in values.items()} | {"metric.score_range": score_range(F.lit(self.kind), allowed)}


def context(rows: DataFrame, endpoint: tuple[str, ...] = ()) -> dict[str, Column]:
    """What a prompt may refer to: all fields but hidden ones (a leading _), the dataset's as `dataset.x`, the endpoint's as `endpoint.x`; plainly named, the endpoint's win."""
    text = lambda f: F.to_json(f.name) if isinstance(f.dataType, (ty.ArrayType, ty.MapType, ty.StructType)) else F.col(f.name).cast("string")
    shown = {f.name: text(f) for f in rows.schema if not f.name.startswith("_")}
    own = {n.removeprefix("endpoint_"): c for n, c in shown.items() if n in endpoint}
    dataset = {n: c for n, c in shown.items() if n not in endpoint}
    return dataset | own | {f"dataset.{n}": c for n, c in dataset.items()} | {f"endpoint.{n}": c for n, c in own.items()}


def custom_judge(rows: DataFrame, key: list[str], metric: Custom, provider: judge.Provider, endpoint: tuple[str, ...] = (), most: int = 16) -> DataFrame:
    """(key, metric, score, label, reason, error) of a custom metric.

    The request holds the metric, the rendered prompt, and the fields that the prompt doesn't hold
    already (`most` at most, within the size budget). A numeric score is clamped to its bounds, an
    aspect's is 1 from 0.5 on, a discrete answer is matched to a label and has no score of its own.
    Rows that lack a required field aren't sent.
    """
    known = context(rows, endpoint)
    prompt = T.render(metric.prompt, known | metric.columns())
    named = T.prompt_variables(metric.prompt)
    held = {n for n in named if "." not in n} | {n.split(".", 1)[1] for n in named if re.match(r"(?:dataset|endpoint)\..", n)}
    kinds = {f.name: f.dataType for f in rows.schema}
    order = [c for c in judge.IMPORTANT if c in kinds] + [c for c in rows.columns if c not in judge.IMPORTANT and c not in key]
    fields = [c for c in order if c not in held and c not in judge.HIDDEN and not c.startswith("_")][:most]
    sample = F.struct(*[T.budgeted(c, kinds[c]).alias(c) for c in fields]) if fields else F.create_map().cast("map<string,string>")
    bounds = f"{metric.bounds[0]:g} 到 {metric.bounds[1]:g}"
    about = F.struct(F.lit(metric.name).alias("name"), F.lit(metric.kind).alias("kind"), F.lit(bounds if metric.kind == "numeric" else " / ".join(metric.labels) if metric.kind == "discrete" else "0 或 1").alias("score_range"))
    missing = F.array_compact(F.array(*[F.when(T.is_missing(c, "array" if isinstance(kinds[c], (ty.ArrayType, ty.MapType)) else "string") if c in kinds else F.lit(True), F.lit(c)) for c in metric.required])) if metric.required else F.array().cast("array<string>")
    request = F.to_json(F.struct(about.alias("metric"), prompt.alias("prompt"), sample.alias("sample")))
    asked = rows.select(*key, missing.alias("_missing"), F.when(F.size(missing) == 0, request).alias("request"))
    said = judge.ask(asked, metric.name, provider).withColumn("_j", T.json_object("answer"))
    raw, reason = T.path_get("_j", "score"), T.clean_reason(T.path_get("_j", "reason"))
    number = T.coerce_float(raw)
    score = {"numeric": F.round(T.clamp(number, *metric.bounds), 4), "aspect_critic": S.aspect(number), "discrete": F.lit(None).cast("double")}[metric.kind]
    label = S.discrete(F.trim(raw), F.array(*map(F.lit, metric.labels))) if metric.kind == "discrete" else F.lit(None).cast("string")
    found = label if metric.kind == "discrete" else score
    bad = F.col("request").isNotNull() & (found.isNull() | (F.coalesce(reason, F.lit("")) == ""))
    return said.select(
        *key,
        F.lit(metric.name).alias("metric"),
        F.when(~bad, score).alias("score"),
        F.when(~bad, label).alias("label"),
        F.when(F.col("request").isNull(), F.concat(F.lit("missing: "), F.array_join("_missing", ", "))).otherwise(reason).alias("reason"),
        F.when(bad, F.lit("no score or reason in the answer")).alias("error"),
    )
