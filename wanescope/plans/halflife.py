"""The whole path from scores to a half-life with its interval, for one or many benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanescope.operators import fit, power, resample


def halflives(scores: DataFrame, variant: str = "toolkit", k: float = 0.2) -> DataFrame:
    """(benchmark, n_quarters, halflife, status) by the native fit."""
    series = power.topk_variance(scores, variant, k)
    fits = fit.decay_fit(series, ["benchmark"])
    return fits.select("benchmark", F.col("n").alias("n_quarters"), "halflife", power.decay_label(F.col("halflife")).alias("status"))


def report(scores: DataFrame, k: float = 0.2, reps: int = 1000, seed: int = 42) -> DataFrame:
    """(benchmark, n_models, n_quarters, amplitude, rate, floor, halflife, median, lo, hi, status): the fit and its bootstrap interval."""
    series = power.topk_variance(scores, "toolkit", k)
    fits = fit.decay_fit(series, ["benchmark"]).select("benchmark", "amplitude", "rate", "floor", "halflife")
    sizes = series.groupBy("benchmark").agg(F.count("*").alias("n_quarters"))
    out = power.model_counts(scores).join(sizes, "benchmark").join(fits, "benchmark", "left")
    if reps:
        out = out.join(resample.bootstrap_halflife(scores, "toolkit", k, reps, seed), "benchmark", "left")
    return out.withColumn("status", power.decay_label(F.col("halflife")))
