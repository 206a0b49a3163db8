"""Server-sent events: lines of a response (response, line_no, line) folded into answers, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import text as T


def data_lines(lines: DataFrame, response: str, order: str) -> DataFrame:
    """(response, order, data) of the `data:` lines but the closing [DONE]."""
    data = F.trim(F.regexp_extract("line", r"^data:(.*)$", 1))
    return lines.where(F.col("line").startswith("data:")).select(response, order, data.alias("data")).where("data <> '[DONE]'")


def frames(lines: DataFrame, response: str, order: str) -> DataFrame:
    """(response, order, data): `data:` lines up to a blank line form one event, joined by line ends."""
    own = Window.partitionBy(response).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    framed = lines.withColumn("_f", F.coalesce(F.sum((F.trim("line") == "").cast("int")).over(own), F.lit(0)))
    data = F.regexp_extract("line", r"^data: ?(.*)$", 1)
    parts = framed.where(F.col("line").startswith("data:")).groupBy(response, "_f").agg(F.min(order).alias(order), F.array_sort(F.collect_list(F.struct(order, data.alias("d")))).alias("p"))
    return parts.select(response, order, F.array_join(F.transform("p", lambda x: x.d), "\n").alias("data")).where("data <> '[DONE]'")


def answers(events: DataFrame, response: str, order: str, final: str = "final_answer", full: str = "answer", delta: str = "text") -> DataFrame:
    """One answer a response: the last non-blank full answer if there is one, else all deltas joined in order."""
    whole = T.first_of(T.path_get("data", final), T.path_get("data", full))
    piece = T.path_get("data", delta)
    rows = events.select(response, order, whole.alias("_w"), piece.alias("_d"))
    folded = rows.groupBy(response).agg(F.max_by("_w", F.when(F.col("_w").isNotNull(), F.col(order))).alias("_w"), F.array_sort(F.collect_list(F.when(F.col("_d").isNotNull(), F.struct(order, "_d")))).alias("_p"), F.count("*").alias("n_events"))
    return folded.select(response, F.coalesce("_w", F.array_join(F.transform("_p", lambda x: x["_d"]), "")).alias("answer"), "n_events")
