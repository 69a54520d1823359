"""Resampling: bootstraps and permutations by an integer hash, so that a replicate is the same on any partitioning and in any engine.

A replicate's draws are rows (rep, k) whose pick among n rows is a quadratic mix of both modulo a prime. Draws are counted by (rep, pick)
before they meet the values, so that only distinct picks are joined; groups that fit into a task's arrays are drawn from there (`replicates`). The golden mode keeps a published generator's draw order on the
few hundred items of one benchmark, as a grouped pandas function.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanescope.operators import ranking, replicates, selection
from wanescope.operators.fit import PANEL, TOOLKIT, Box
from wanescope.shared import released, written

PRIME = 2147483647


def pick(rep: Column, k: Column, n: Column, seed: int = 42) -> Column:
    """A place in 0..n-1 for draw k of a replicate: all in 64-bit integers below 2^62."""
    x0 = (rep * 1000003 + k * 7919 + F.lit(seed)) % F.lit(PRIME)
    x1 = (x0 * x0 + k) % F.lit(PRIME)
    x2 = (x1 * F.lit(48271) + rep) % F.lit(PRIME)
    x3 = (x2 * x2 + F.lit(12345)) % F.lit(PRIME)
    return x3 % n


def mixed(a: Column, b: Column, seed: int = 42) -> Column:
    """A number in 0..PRIME-1 for a pair of integers."""
    return pick(a, b, F.lit(PRIME).cast("bigint"), seed)


def uniform(a: Column, b: Column, seed: int = 42) -> Column:
    return mixed(a, b, seed) / F.lit(float(PRIME))


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with place `k` from 0 in its group and the group's size `n`, by ranges: no task holds a group."""
    rows = written(df)
    placed = ranking.numbered(rows, by, order, "k")
    sizes = placed.groupBy(*by).agg(F.count("*").alias("n"))
    released(rows)
    return ranking.with_values(placed, sizes, by)


def draws(groups: DataFrame, by: list[str], reps: int, seed: int = 42) -> DataFrame:
    """(by, rep, k, times) for groups (by, n): how often each place is drawn in each replicate of n draws."""
    each = groups.select(*by, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))).alias("rep"))
    drawn = each.select(*by, "rep", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("d"))
    return drawn.groupBy(*by, "rep", pick(F.col("rep"), F.col("d"), F.col("n"), seed).alias("k")).agg(F.count("*").alias("times"))


def interval(stats: DataFrame, by: list[str], value: str, lo: float = 0.025, hi: float = 0.975, least: int = 1) -> DataFrame:
    """(by, n_boot, median, lo, hi) over replicates; with fewer than `least` of them only their number is given."""
    at = lambda p: F.when(F.count("*") >= least, F.percentile(value, F.lit(p)))
    return stats.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n_boot"), at(0.5).alias("median"), at(lo).alias("lo"), at(hi).alias("hi"))


def bootstrap_mean(items: DataFrame, by: list[str], order: list[str], value: str, reps: int = 1000, seed: int = 42) -> DataFrame:
    """(by, rep, stat): mean of value over rows drawn with replacement; order makes the rows' places unique."""
    rows = numbered(items.dropna(subset=[value]), by, order).select(*by, "k", "n", value)
    groups = rows.select(*by, "n").distinct()
    most = groups.agg(F.max("n")).first()[0] or 0
    if most <= replicates.HELD:
        return replicates.replicated(rows, by, [], value, most, reps, seed, replicates.mean, "stat double")
    drawn = draws(groups, by, reps, seed).join(rows.select(*by, "k", value), [*by, "k"])
    return drawn.groupBy(*by, "rep").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("stat"))


def bootstrap_rows(rows: DataFrame, by: list[str], order: list[str], reps: int, seed: int = 42) -> DataFrame:
    """The drawn rows themselves, with `rep`: each as often as it was drawn. For statistics that no weights express."""
    placed = numbered(rows, by, order)
    drawn = draws(placed.select(*by, "n").distinct(), by, reps, seed)
    many = drawn.select(*by, "rep", "k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return many.join(placed.drop("n"), [*by, "k"]).drop("k", "copy")


@dataclass(frozen=True)
class Interval:
    """How half-lives of a resample count: the fit's box, whether a rising trend is no decay, bounds that they lie between, the points that a
    replicate's series needs, and the successes below which there is no interval."""

    box: Box
    gated: bool
    low: float
    high: float
    points: int
    least: int


#: By the name of the series' variant. The first is the command line's, which gives an interval from one success on.
INTERVALS = {
    "toolkit": Interval(TOOLKIT, False, 0.1, 500.0, 3, 1),
    "boot_v2": Interval(PANEL, True, 0.0, 200.0 * (1 + 1e-12), 4, 50),
    "boot_v1": Interval(PANEL, True, 0.0, 200.0 * (1 + 1e-12), 3, 50),
}


def bootstrap_halflife(scores: DataFrame, variant: str = "toolkit", k: float = 0.2, reps: int = 1000, seed: int = 42) -> DataFrame:
    """(benchmark, n_boot, median, lo, hi) of half-lives over resampled models within quarters; replicates are groups of their own, so they
    spread over the cluster. variant: one of INTERVALS."""
    from wanescope.operators import fit, power

    rule = INTERVALS[variant]
    rows = power.with_quarter(scores).select("benchmark", "q", "model", "score", "eval_date")
    most, group, order = selection.largest(rows, ["benchmark", "q"]), ["benchmark", "q"], ["eval_date", "model", "score"]
    keys = ["rep", "benchmark"]
    if most <= replicates.HELD:
        observed = rows.groupBy("benchmark").agg(F.min("q").alias("observed"))
        series = power.resampled_topk(numbered(rows, group, order), observed, most, variant, k, reps, seed)
    else:  # a resample is as large as its group
        series = power.topk_variance(bootstrap_rows(rows, group, order, reps, seed).drop("q"), variant, k, keys=["rep"], largest=most)
    series = written(series.select("rep", "benchmark", "t_months", "value"))
    fits = fit.decay_fit(series, keys, rule.box).where(F.col("n") >= rule.points)
    if rule.gated:
        fits = fits.join(fit.trend(series, keys), keys).where("slope < 0")
    return interval(fits.where((F.col("halflife") > rule.low) & (F.col("halflife") < rule.high)), ["benchmark"], "halflife", least=rule.least)


def pair_bootstrap(series: DataFrame, by: list[str], reps: int = 1000, seed: int = 42, min_unique: int = 4, least: int = 10) -> DataFrame:
    """(by, n_boot, median, lo, hi): half-lives of the best of three shapes over distinct quarters drawn with replacement; replicates with
    fewer than `min_unique` of them fail, and below `least` successes there is no interval. Half-lives are searched to about half a per cent."""
    from wanescope.operators import fit

    placed = numbered(series.dropna(subset=["t_months", "value"]).select(*by, "q", "t_months", "value"), by, ["q"])
    drawn = written(draws(placed.select(*by, "n").distinct(), by, reps, seed).join(placed.drop("n"), [*by, "k"]).select(*by, "rep", "t_months", "value"))
    best = fit.three_shapes(drawn, [*by, "rep"], constant=False, least=min_unique, rounds=6).groupBy(*by, "rep").agg(F.min_by("halflife", F.struct("aic", "shape")).alias("halflife"))
    return interval(best.where("halflife > 0"), by, "halflife", least=least)


def permutation_flip(items: DataFrame, by: list[str], order: list[str], value: str, reps: int = 10000, seed: int = 42) -> DataFrame:
    """(by, observed, p): share of sign-flipped means that reach the observed one in size."""
    rows = numbered(items.dropna(subset=[value]), by, order).select(*by, "k", "n", value)
    flips = rows.select(*by, "k", "n", value, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))).alias("rep"))
    sign = 1 - 2 * (mixed(F.col("rep"), F.col("k"), seed) % 2)
    nulls = flips.groupBy(*by, "rep").agg(F.sum(F.col(value) * sign).alias("flipped"), F.sum(value).alias("seen"), F.max("n").alias("n"))
    return nulls.groupBy(*by).agg((F.max("seen") / F.max("n")).alias("observed"), F.avg(F.when(F.abs("flipped") >= F.abs("seen") - 1e-9, 1.0).otherwise(0.0)).alias("p"))


def exact_label_permutation(gap: DataFrame, value: str, group: str, first: str) -> DataFrame:
    """One row (observed, n_splits, p): the size of the difference of group means against every relabelling with as many in the first group. For a few
    models: the number of splits is a binomial coefficient of their count."""
    rows = gap.select(value, (F.col(group) == first).alias("in_first")).collect()  # one row per model of a short list
    v, k = [r[0] for r in rows], sum(r[1] for r in rows)
    splits = [(list(c),) for c in combinations(range(len(v)), k)]
    spark = gap.sparkSession
    base = spark.createDataFrame([(i, float(x), bool(r[1])) for i, (x, r) in enumerate(zip(v, rows))], "i int, v double, in_first boolean")
    named = spark.createDataFrame([(j, s[0]) for j, s in enumerate(splits)], "split int, chosen array<int>")
    each = named.join(F.broadcast(base), F.lit(True)).groupBy("split").agg(F.abs(F.avg(F.when(F.array_contains("chosen", F.col("i")), F.col("v"))) - F.avg(F.when(~F.array_contains("chosen", F.col("i")), F.col("v")))).alias("d"))
    seen = base.agg(F.abs(F.avg(F.when(F.col("in_first"), F.col("v"))) - F.avg(F.when(~F.col("in_first"), F.col("v")))).alias("observed"))
    return each.join(F.broadcast(seen), F.lit(True)).groupBy("observed").agg(F.count("*").alias("n_splits"), F.avg(F.when(F.col("d") >= F.col("observed") - 1e-12, 1.0).otherwise(0.0)).alias("p"))


def seeded_sample(df: DataFrame, by: list[str], id_col: str, size: int, seed: int = 42) -> DataFrame:
    """`size` rows of each group without replacement, by hash of an integer id, in the id's order."""
    w = Window.partitionBy(*by).orderBy("_h", id_col)
    return df.withColumn("_h", mixed(F.col(id_col).cast("bigint"), F.lit(seed).cast("bigint"), seed)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size).drop("_h", "_rn")


def golden_gap(orig: np.ndarray, pert: np.ndarray, reps: int = 1000, seed: int = 42) -> tuple[float, float, float]:
    """Mean paired gap with its 95 % interval, drawing places as numpy's legacy generator does."""
    d = np.asarray(orig, float) - np.asarray(pert, float)
    rng = np.random.RandomState(seed)
    means = np.array([d[rng.choice(len(d), len(d), replace=True)].mean() for _ in range(reps)])
    return float(d.mean()), *map(float, np.percentile(means, [2.5, 97.5]))


def golden_gaps(paired: DataFrame, by: list[str], reps: int = 1000, seed: int = 42, min_items: int = 30) -> DataFrame:
    """(by, n, gap, lo, hi) over paired items (by, item, o, p), in item order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("item")
        row = golden_gap(p.o.to_numpy(), p.p.to_numpy(), reps, seed) if len(p) >= min_items else (None,) * 3
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], len(p), *row]], columns=[*by, "n", "gap", "lo", "hi"])

    kinds = dict(paired.dtypes)
    return paired.groupBy(*by).applyInPandas(one, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n long, gap double, lo double, hi double"]))


def ols_bootstrap(x: np.ndarray, y: np.ndarray, reps: int = 2000, seed: int = 42) -> np.ndarray:
    """Percentiles 2.5 and 97.5 of each coefficient over resampled rows of a small table."""
    from wanescope.operators.stats import ols

    rng = np.random.RandomState(seed)
    betas = [ols(x[i], y[i])[0] for i in (rng.choice(len(y), len(y), replace=True) for _ in range(reps))]
    return np.nanpercentile(np.array(betas), [2.5, 97.5], axis=0)


def slope_bootstrap(df: DataFrame, by: list[str], order: list[str], x: str, y: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """(by, n_boot, median, lo, hi) of the least-squares slope of y on x over resampled rows; resamples of one x are skipped."""
    from wanescope.operators.stats import safe_slope

    again = bootstrap_rows(df.dropna(subset=[x, y]).select(*by, *order, x, y), by, order, reps, seed)
    return interval(again.groupBy(*by, "rep").agg(safe_slope(F.col(y), F.col(x)).alias("b")), by, "b")


def correlation_bootstrap(df: DataFrame, by: list[str], order: list[str], x: str, y: str, reps: int = 5000, seed: int = 42) -> DataFrame:
    """(by, n_boot, median, lo, hi) of Pearson's r over resampled pairs; resamples without variance are skipped. order tells a group's rows
    apart."""
    from wanescope.operators.stats import safe_corr

    again = bootstrap_rows(df.dropna(subset=[x, y]).select(*by, *order, x, y), by, order, reps, seed)
    return interval(again.groupBy(*by, "rep").agg(safe_corr(F.col(x), F.col(y)).alias("r")), by, "r")
