"""The judge stage: payloads, a pluggable provider called in Arrow batches, answers parsed natively.

A provider's answers are not repeatable, so a stage's output should be stored before it is used
twice. `Offline` answers by word overlap, deterministically: for tests and for runs without a
network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from evalspark.functions import scores as S
from evalspark.functions import text as T

HIDDEN = ("generation_meta",)
#: The order of a sample's fields.
IMPORTANT = ("user_input", "response", "reference", "retrieved_contexts", "reference_contexts", "retrieved_context_ids", "reference_context_ids", "reference_tool_calls", "reference_topics", "reference_role", "rubrics")
#: Required and visible fields of the built-in metrics; what is not visible never reaches the judge.
CATALOG: dict[str, dict[str, tuple[str, ...]]] = {
    "faithfulness": {"required": ("response", "retrieved_contexts"), "visible": ("response", "retrieved_contexts")},
    "context_recall": {"required": ("retrieved_contexts", "reference"), "visible": ("retrieved_contexts", "reference")},
    "context_precision": {"required": ("user_input", "retrieved_contexts"), "visible": ("user_input", "retrieved_contexts", "reference")},
    "contextual_relevancy": {"required": ("user_input", "retrieved_contexts"), "visible": ("user_input", "retrieved_contexts")},
    "factual_correctness": {"required": ("response", "reference"), "visible": ("response", "reference")},
    "answer_completeness": {"required": ("response", "reference"), "visible": ("response", "reference")},
    "answer_relevancy": {"required": ("user_input", "response"), "visible": ("user_input", "response")},
    "faithfulness_claim": {"required": ("response", "retrieved_contexts"), "visible": ("response", "retrieved_contexts")},
    "answer_relevancy_generative": {"required": ("user_input", "response"), "visible": ("user_input", "response")},
    "agent_goal_accuracy": {"required": ("user_input", "reference"), "visible": ("user_input", "reference", "response", "tool_calls", "reference_tool_calls")},
    "task_completion": {"required": ("user_input", "reference"), "visible": ("user_input", "reference", "response", "tool_calls", "reference_tool_calls")},
    "topic_adherence": {"required": ("user_input", "reference_topics"), "visible": ("user_input", "reference_topics", "response")},
    "turn_relevancy": {"required": ("user_input",), "visible": ("user_input", "response")},
    "conversation_completeness": {"required": ("user_input", "reference"), "visible": ("user_input", "reference", "response")},
    "knowledge_retention": {"required": ("user_input",), "visible": ("user_input", "response")},
    "role_adherence": {"required": ("user_input", "reference_role"), "visible": ("user_input", "reference_role", "response")},
    "turn_faithfulness": {"required": ("user_input", "retrieved_contexts"), "visible": ("user_input", "retrieved_contexts", "response")},
}


class Provider(Protocol):
    """Anything that can be pickled and answers requests (JSON texts) with texts, one each."""

    def answer(self, task: str, requests: list[str]) -> list[str]: ...


def _words(value: object) -> set[str]:
    return set(re.findall(r"\w+", json.dumps(value, ensure_ascii=False).lower())) - {"null"}


class Offline:
    """A deterministic stand-in: scores are shares of words that the sample's other fields have too."""

    def answer(self, task: str, requests: list[str]) -> list[str]:
        return [self._one(task, json.loads(r)) for r in requests]

    def _one(self, task: str, x: dict) -> str:
        if task == "decompose":
            return json.dumps({"claims": [c.strip() for c in re.split(r"[.!?。！？]", x.get("response", "")) if c.strip()]}, ensure_ascii=False)
        if task == "verify":
            claim = _words(x.get("claim", ""))
            return json.dumps({"supported": len(claim & _words(x.get("contexts", []))) >= 0.5 * len(claim)})
        if task == "questions":
            words = x.get("response", "").split()
            return json.dumps({"questions": [" ".join(words[k :: x.get("n", 3)]) for k in range(x.get("n", 3))], "noncommittal": not words}, ensure_ascii=False)
        first, *rest = [_words(v) for v in x.get("sample", x).values()] or [set()]
        seen = set().union(*rest) if rest else first
        score = len(first & seen) / len(first) if first else 0.0
        return json.dumps({"score": round(score, 6), "reason": f"{task}: {len(first & seen)} of {len(first)} words"})


#: What a judge is asked to look for.
CRITERIA: dict[str, str] = {
    "faithfulness": "Every key fact of the response is supported by the retrieved contexts; invented or contradicting facts cost points.",
    "context_recall": "The retrieved contexts cover the facts of the reference; a point of it that they lack costs points.",
    "context_precision": "The retrieved contexts are relevant to the question and the reference; noise and repetition cost points.",
    "contextual_relevancy": "The retrieved contexts are about the question itself; what only touches it costs points.",
    "factual_correctness": "The response agrees with the facts of the reference; errors and missing conditions cost points.",
    "answer_completeness": "The response has all points of the reference.",
    "answer_relevancy": "The response answers the question directly; straying and generalities cost points, errors don't.",
    "faithfulness_claim": "The share of the response's single claims that the retrieved contexts support.",
    "answer_relevancy_generative": "How near the question is to the questions that the response would answer.",
    "agent_goal_accuracy": "The conversation reaches the goal that the reference states.",
    "task_completion": "The task of the reference is done, by the tools that it takes.",
    "topic_adherence": "The conversation stays with the topics of the reference.",
    "turn_relevancy": "Each answer fits its turn.",
    "conversation_completeness": "The conversation settles all that the user asked for.",
    "knowledge_retention": "What the user has said is kept in mind later.",
    "role_adherence": "The answers stay in the role of the reference.",
    "turn_faithfulness": "Each answer is supported by the retrieved contexts.",
}


def payload(metric: str, rows: DataFrame, extra: tuple[str, ...] = ()) -> Column:
    """The judge's sample: the visible fields in the fixed order, then extras, within the size budget; nulls and hidden fields are left out."""
    kinds = {f.name: f.dataType for f in rows.schema}
    shown = dict.fromkeys((*CATALOG[metric]["visible"], *extra))
    names = [c for c in (*[c for c in IMPORTANT if c in shown], *[c for c in shown if c not in IMPORTANT]) if c in kinds and c not in HIDDEN]
    return F.to_json(F.struct(*[T.budgeted(c, kinds[c]).alias(c) for c in names]))


def custom_payload(data: Column, important: list[str], most: int = 16) -> Column:
    """The sample of a custom metric from a map: important fields first, then others, 16 at most, none that starts with _; texts within the size budget."""
    shown = F.map_filter(data, lambda k, v: ~k.startswith("_") & ~k.isin(*HIDDEN))
    first = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.try_element_at(shown, F.lit(k)).alias("value")) for k in important]), lambda e: e["value"].isNotNull())
    rest = F.filter(F.map_entries(shown), lambda e: ~F.exists(first, lambda f: f["key"] == e["key"]))
    return F.to_json(F.transform_values(F.map_from_entries(F.slice(F.concat(first, rest), 1, most)), lambda k, v: T.limit_text(v, T.BUDGET)))


def ask(rows: DataFrame, task: str, provider: Provider, request: str = "request", batch: int = 64) -> DataFrame:
    """Add `answer`: the provider's text for each request, `batch` requests a call; null requests aren't sent."""
    names, at = rows.columns, rows.columns.index(request)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                asked = part.column(at).to_pylist()
                said = iter(provider.answer(task, [r for r in asked if r is not None]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if r is None else next(said) for r in asked], pa.string())], names=[*names, "answer"])

    fields = ty.StructType([*rows.schema, ty.StructField("answer", ty.StringType())])
    return rows.mapInArrow(run, fields)


def judge(rows: DataFrame, key: list[str], metric: str, provider: Provider, required: tuple[str, ...] | None = None, prompt: str | None = None) -> DataFrame:
    """(key, metric, score, reason, error) of a built-in metric.

    The request holds the metric, its criteria (or a prompt that overrides them) and the sample. Rows
    without a required field (the metric's own, unless overridden) aren't sent: null score, a
    reason; an answer without score or reason is an error.
    """
    need = CATALOG[metric]["required"] if required is None else required
    kinds = {f.name: f.dataType.typeName() for f in rows.schema}
    lacking = [T.is_missing(c, "array" if kinds[c] in ("array", "map") else "string") if c in kinds else F.lit(True) for c in need]
    missing = F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in zip(lacking, need, strict=True)]).cast("array<string>"))
    ask_for = F.to_json(F.struct(F.lit(metric).alias("metric"), F.lit(prompt or CRITERIA[metric]).alias("criteria")))
    request = F.concat(ask_for.substr(F.lit(1), F.length(ask_for) - 1), F.lit(',"sample":'), payload(metric, rows), F.lit("}"))
    asked = rows.select(*key, missing.alias("_missing"), F.when(F.size(missing) == 0, request).alias("request"))
    said = ask(asked, metric, provider).withColumn("_j", T.json_object("answer"))
    score = F.round(T.clamp(T.coerce_float(T.path_get("_j", "score"))), 4)
    reason = T.clean_reason(T.path_get("_j", "reason"))
    bad = F.col("request").isNotNull() & (score.isNull() | (F.coalesce(reason, F.lit("")) == ""))
    return said.select(
        *key,
        F.lit(metric).alias("metric"),
        F.when(~bad, score).alias("score"),
        F.when(F.col("request").isNull(), F.concat(F.lit("missing: "), F.array_join("_missing", ", "))).otherwise(reason).alias("reason"),
        F.when(bad, F.lit("no score or reason in the answer")).alias("error"),
    )


def claim_faithfulness(rows: DataFrame, key: str, provider: Provider) -> DataFrame:
    """Share of a response's claims that its contexts support: decompose, explode, verify, average. No claim: 0; no decomposition: null."""
    asked = rows.select(key, "retrieved_contexts", F.when(~T.is_missing("response") & ~T.is_missing("retrieved_contexts", "array"), F.to_json(F.struct("response"))).alias("request"))
    cut = ask(asked, "decompose", provider).withColumn("_c", F.from_json(T.path_get(T.json_object("answer"), "claims"), "array<string>"))
    claims = F.filter(F.transform("_c", T.strip), lambda c: c != "")
    each = cut.select(key, F.col("_c").isNotNull().alias("_ok"), "retrieved_contexts", F.explode_outer(claims).alias("claim"))
    verify = each.select(key, "_ok", F.col("claim"), F.when(F.col("claim").isNotNull(), F.to_json(F.struct("claim", F.col("retrieved_contexts").alias("contexts")))).alias("request"))
    said = ask(verify, "verify", provider).withColumn("_s", F.coalesce(T.path_get(T.json_object("answer"), "supported", "boolean"), F.lit(False)))
    share = F.round(F.sum(F.col("_s").cast("int")) / F.greatest(F.lit(1), F.count("claim")), 4)
    return said.groupBy(key).agg(F.when(F.bool_and("_ok"), share).alias("score"), F.count("claim").alias("n_claims"))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A bag of words hashed into `dim` places: an offline embedding."""
    at = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    return T.bind(at, lambda xs: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(xs, lambda x: x == i)).cast("double")))


def generative_relevancy(rows: DataFrame, key: str, provider: Provider, n: int = 3) -> DataFrame:
    """Highest cosine of the question and the n questions that the response would answer; 0 if it commits to nothing."""
    asked = rows.select(key, "user_input", F.when(~T.is_missing("response"), F.to_json(F.struct("response", F.lit(n).alias("n")))).alias("request"))
    said = ask(asked, "questions", provider).withColumn("_j", T.json_object("answer"))
    questions = F.from_json(T.path_get("_j", "questions"), "array<string>")
    each = said.select(key, "user_input", F.coalesce(T.path_get("_j", "noncommittal", "boolean"), F.lit(False)).alias("_no"), F.col("request").isNotNull().alias("_ok"), F.explode_outer(questions).alias("q"))
    near = F.when(~F.col("_no") & F.col("q").isNotNull(), S.cosine(hashed_embedding(F.col("user_input")), hashed_embedding(F.col("q"))))
    return each.groupBy(key).agg(F.when(F.bool_and("_ok"), F.round(F.coalesce(F.max(near), F.lit(0.0)), 4)).alias("score"))


def swap_lists(rows: DataFrame) -> DataFrame:
    """The swapped sample: every list-typed field reversed."""
    return rows.select(*[F.reverse(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema])


def select_questions(candidates: DataFrame, verdicts: DataFrame, chunk: str, order: str, n: str = "allocated") -> DataFrame:
    """Generated questions that stay: no blank or meta questions, the first of equal ones, those a verdict keeps (without one: kept, 0.5), the best `n` a chunk."""
    real = candidates.where(F.trim("question") != "").where(~(F.col("question").contains("文档") & (F.col("question").contains("提到了什么") | F.col("question").contains("说了什么"))))
    first = real.withColumn("_q", T.question_key("question")).groupBy(chunk, "_q").agg(F.min_by(F.struct(order, "question", n), F.struct(order, "question", n)).alias("_r")).select(chunk, "_r.*")
    told = first.join(verdicts.select(chunk, "question", "keep", F.col("score").alias("_s")), [chunk, "question"], "left")
    kept = told.where(F.coalesce("keep", F.lit(True))).withColumn("score", F.coalesce("_s", F.lit(0.5)))
    rank = F.row_number().over(Window.partitionBy(chunk).orderBy(F.desc("score"), order, "question"))
    return kept.withColumn("_rank", rank).where(F.col("_rank") <= F.col(n)).select(chunk, order, "question", "score")
