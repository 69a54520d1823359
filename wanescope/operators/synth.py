"""Synthetic benchmarks with known ageing: responses by a hash of (epoch, model, item), so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanescope.operators.resample import mixed, uniform


def responses(spark: SparkSession, epochs: int = 20, models: int = 30, items: int = 500, growth: float = 0.08, contaminated_items: float = 0.1, contamination: float = 0.5, ceiling_items: float = 0.1, seed: int = 42) -> DataFrame:
    """(epoch, model, item, theta, a, b, correct, clean): logistic responses of models that grow by epoch; from the middle on, a share of
    models knows contaminated items by heart, and ceiling items get easy. `clean` is the answer without contamination."""
    cells = spark.range(epochs * models * items).select(
        (F.col("id") % items).alias("item"), (F.floor(F.col("id") / items) % models).alias("model"), F.floor(F.col("id") / (items * models)).alias("epoch")
    )
    u = lambda x, y, s: uniform(F.col(x).cast("bigint"), (F.col(y) if isinstance(y, str) else F.lit(y)).cast("bigint"), seed + s)
    bell = lambda x, s: (u(x, 1, s) + u(x, 2, s) + u(x, 3, s) + u(x, 4, s) - 2) * F.lit(3.0**0.5)  # noqa: E731  near normal, variance 1
    rows = cells.withColumns({"theta": bell("model", 11) + F.lit(growth) * F.col("epoch"), "a": 0.5 + 1.5 * u("item", 5, 13), "b": bell("item", 17), "item_class": u("item", 6, 19), "leak": u("model", 7, 23)})
    late = F.col("epoch") >= epochs / 2
    rows = rows.withColumn("b", F.when(late & (F.col("item_class") > 1 - ceiling_items), F.col("b") - 3.0).otherwise(F.col("b")))
    p = 1 / (1 + F.exp(-F.col("a") * (F.col("theta") - F.col("b"))))
    rows = rows.withColumn("clean", F.when(uniform(F.col("epoch") * models + F.col("model"), F.col("item"), seed + 29) < p, 1).otherwise(0))
    known = late & (F.col("item_class") < contaminated_items) & (F.col("leak") < contamination)
    return rows.select("epoch", "model", "item", "theta", "a", "b", F.when(known, 1).otherwise(F.col("clean")).alias("correct"), "clean")


def spread(rows: DataFrame, value: str) -> DataFrame:
    """(epoch, mean, var, best): model accuracies of each epoch."""
    acc = rows.groupBy("epoch", "model").agg(F.avg(value).alias("acc"))
    return acc.groupBy("epoch").agg(F.avg("acc").alias("mean"), F.var_samp("acc").alias("var"), F.max("acc").alias("best"))


def ground_truth(rows: DataFrame, share: float = 0.3) -> DataFrame:
    """(epoch, d_total, d_clean, k, f, g): spread with and without contamination, and its parts."""
    both = spread(rows, "correct").select("epoch", F.col("var").alias("d_total"), F.col("best").alias("best")).join(spread(rows, "clean").select("epoch", F.col("var").alias("d_clean")), "epoch")
    k = F.greatest(F.lit(0.0), F.col("d_clean") - F.col("d_total"))
    f = F.when(F.col("best") >= 0.95, F.lit(share) * F.col("d_total")).otherwise(0.0)
    return both.withColumn("k", k).withColumn("f", f).withColumn("g", F.greatest(F.lit(0.0), F.col("d_clean") - F.col("k") - F.col("f")))


def sweep_decomposition(rows: DataFrame, ceiling: float = 0.95, share: float = 0.3) -> DataFrame:
    """One row: first against last epoch: mean shift, signed spread shift, ceiling part and remaining growth part."""
    both = spread(rows, "correct").select("epoch", F.col("mean").alias("mo"), F.col("var").alias("vo")).join(spread(rows, "clean").select("epoch", F.col("mean").alias("mc"), F.col("var").alias("vc")), "epoch")
    acc = rows.groupBy("epoch", "item").agg(F.avg("correct").alias("p")).groupBy("epoch").agg(F.avg(F.when(F.col("p") >= ceiling, 1.0).otherwise(0.0)).alias("frac"))
    x = both.join(acc, "epoch")
    ends = x.agg(F.max_by(F.col("mo") - F.col("mc"), "epoch").alias("k_mu"), F.max_by(F.col("vc") - F.col("vo"), "epoch").alias("k_sigma"), F.min_by("vo", "epoch").alias("d0"), F.max_by("frac", "epoch").alias("frac"), (F.min_by("vc", "epoch") - F.max_by("vc", "epoch")).alias("fall"))
    return ends.withColumn("f", F.lit(share) * F.col("frac") * F.col("d0")).withColumn("g", F.greatest(F.lit(0.0), F.col("fall") - F.col("f")))


def config_grid(spark: SparkSession, contamination: list[float], growth: list[float], reps: int) -> DataFrame:
    """(contamination, growth, rep, seed): every combination of a sweep."""
    axis = lambda xs, n: F.explode(F.array(*[F.lit(x) for x in xs])).alias(n)
    g = spark.range(1).select(axis(contamination, "contamination")).select("*", axis(growth, "growth")).select("*", axis(list(range(reps)), "rep"))
    return g.withColumn("seed", 42 + 100 * F.col("rep") + F.floor(100 * F.col("contamination")) + F.floor(1000 * F.col("growth")))


def validation(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """Truth and estimates of one epoch side by side."""
    return truth.join(estimate, "epoch")


__all__ = ["config_grid", "ground_truth", "mixed", "responses", "spread", "sweep_decomposition", "validation"]
