"""Accumulators over a stream of scores: counts, sums and sums of squares add up, so a quarter's spread is always at hand.

A stream keeps its state by day: a day is closed once the watermark has passed it, its sums are given out and its state is dropped. Quarters
are sums of closed days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanescope.operators.power import quarter_index


def daily(scores: DataFrame, delay: str = "7 days") -> DataFrame:
    """(benchmark, day, n, total, squares) of a batch or stream of scores. In a stream rows up to `delay` behind the latest still count, later
    ones don't, and append mode gives a day out when it is closed."""
    rows = scores.dropna(subset=["score", "eval_date"]).withColumn("eval_date", F.col("eval_date").cast("timestamp"))
    rows = rows.withWatermark("eval_date", delay) if rows.isStreaming else rows
    day = rows.groupBy("benchmark", F.window("eval_date", "1 day").alias("at"))
    sums = day.agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.sum(F.col("score") * F.col("score")).alias("squares"))
    return sums.select("benchmark", F.col("at.start").alias("day"), "n", "total", "squares")


def quarters(days: DataFrame) -> DataFrame:
    """(benchmark, q, n, mean, variance) from the sums of days."""
    sums = days.groupBy("benchmark", quarter_index(F.col("day")).alias("q")).agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("s"))
    n, mean = F.col("n"), F.col("t") / F.col("n")
    return sums.select("benchmark", "q", "n", mean.alias("mean"), F.when(n > 1, F.greatest(F.lit(0.0), (F.col("s") - n * mean * mean) / (n - 1))).alias("variance"))


def accumulators(scores: DataFrame) -> DataFrame:
    """The quarters of a batch of scores."""
    return quarters(daily(scores))
