"""Blind tests of two answers: which side is shown first, whose vote it was, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def display_order(task: Column, row: Column) -> Column:
    """The sides as shown, by the parity of both ids."""
    return F.when((task + row) % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a")))


def display_order_md5(key: Column) -> Column:
    """The sides as shown, by the parity of the first byte of a digest."""
    return F.when(F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("int") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a")))


def winner(vote: Column, order: Column) -> Column:
    """Whose answer a vote for the left or right side meant; null for other votes."""
    left = F.coalesce(F.get(order, 0), F.lit("a"))
    return F.when(vote == "left", left).when(vote == "right", F.when(left == "a", "b").otherwise("a"))


def tally(rows: DataFrame, *task: str) -> DataFrame:
    """Counts of a blind test's rows (answer_a, answer_b, vote, display_order). A skipped row stays pending; a win needs an answer."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    answered = filled("answer_a") | filled("answer_b")
    who, n = winner(F.col("vote"), F.col("display_order")), lambda c: F.count_if(c)
    voted = F.col("vote").isNotNull() & (F.col("vote") != "skip")
    out = rows.groupBy(*task).agg(
        F.count("*").alias("total"),
        n(F.col("answer_a").isNotNull() | F.col("answer_b").isNotNull()).alias("completed"),
        n(voted).alias("voted"),
        n(answered & (who == "a")).alias("wins_a"),
        n(answered & (who == "b")).alias("wins_b"),
        n(F.col("vote") == "tie").alias("ties"),
        n(F.col("vote") == "both_bad").alias("both_bad"),
        n(~answered).alias("no_answer"),
    )
    return out.withColumn("pending", F.greatest(F.col("total") - F.col("voted"), F.lit(0)).cast("long"))
