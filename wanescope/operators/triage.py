"""Choosing benchmarks: policies over benchmark dimensions, and how well the chosen ones rank models."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanescope.operators import replicates, selection
from wanescope.operators.resample import PRIME, pick
from wanescope.operators.stats import average_rank, safe_corr
from wanescope.shared import released, written

#: Sort key of each policy over (saturation, halflife), and what a missing value counts as.
POLICIES = {"saturation_low": ("saturation", 1, 1.0), "saturation_high": ("saturation", -1, 0.0), "halflife_long": ("halflife", -1, 0.0), "halflife_short": ("halflife", 1, 60.0)}


def pick_benchmarks(dim: DataFrame, k: int) -> DataFrame:
    """(policy, benchmark, place): the k benchmarks that each policy takes; ties go by `ord`. dim: (benchmark, ord, saturation, halflife)."""
    out = None
    for name, (column, sign, missing) in POLICIES.items():
        keyed = dim.select(F.lit(name).alias("policy"), "benchmark", "ord", (F.coalesce(column, F.lit(missing)) * sign).alias("key"))
        out = keyed if out is None else out.unionByName(keyed)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("policy").orderBy("key", "ord"))).where(F.col("place") <= k).select("policy", "benchmark", "place")


def ability(acc: DataFrame) -> DataFrame:
    """(model, ability): mean over benchmarks of accuracy; acc: (benchmark, model, acc)."""
    return acc.groupBy("model").agg(F.avg("acc").alias("ability"))


def policy_rho(acc: DataFrame, picks: DataFrame) -> DataFrame:
    """(policy, n, rho): rank correlation of ability on a policy's benchmarks with that on all."""
    chosen = acc.join(picks, "benchmark").groupBy("policy", "model").agg(F.avg("acc").alias("part"))
    both = chosen.join(ability(acc), "model")
    ranks = both.withColumns({"a": average_rank("part", ["policy"]), "b": average_rank("ability", ["policy"])})
    return ranks.groupBy("policy").agg(F.count("*").alias("n"), safe_corr(F.col("a"), F.col("b")).alias("rho"))


def random_policy_rho(acc: DataFrame, k: int) -> DataFrame:
    """The mean rho over every choice of k benchmarks: one row (n_subsets, rho)."""
    names = sorted(r[0] for r in acc.select("benchmark").distinct().collect())  # a short list
    subsets = [(f"{i}", b, 0) for i, c in enumerate(combinations(names, k)) for b in c]
    picks = acc.sparkSession.createDataFrame(subsets, "policy string, benchmark string, place int")
    return policy_rho(acc, picks).agg(F.count("*").alias("n_subsets"), F.avg("rho").alias("rho"))


def _placed(groups: DataFrame, by: list[str], value: str, salts: int = 256) -> DataFrame:
    """groups' distinct (by, value) with place `k` from 0 and size `n` of each group: ranks in hash parts with offsets, so no task sorts a
    whole group."""
    salted = groups.select(*by, value).distinct().withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    inside = salted.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(value)) - 1)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sizes = salted.groupBy(*by, "_salt").agg(F.count("*").alias("_n"))  # at most `salts` rows a group
    before = sizes.select(*by, "_salt", (F.sum("_n").over(whole.orderBy("_salt")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("n"))
    return inside.join(before, [*by, "_salt"]).select(*by, value, (F.col("_at") + F.col("_before")).alias("k"), "n")


def _drawn(placed: DataFrame, by: list[str], reps: int, seed: int) -> DataFrame:
    """(rep, by, k, times): how often each place is drawn in a replicate of as many draws as its group has rows. Each row stands for a draw."""
    each = placed.select(*by, "n", F.col("k").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep"))
    mixed = F.pmod(F.xxhash64("rep", *by), F.lit(PRIME).cast("long"))
    return each.groupBy("rep", *by, pick(mixed, F.col("d"), F.col("n"), seed).alias("k")).agg(F.count("*").alias("times"))


def bootstrap_policies(answers: DataFrame, picks: DataFrame, reps: int = 2000, seed: int = 42, models_too: bool = False) -> DataFrame:
    """(rep, policy, rho): items (and models) are resampled once a replicate and all policies are judged on the same draw; rho is nan where
    it isn't defined. answers: (benchmark, model, item, correct). A benchmark's answers are held in arrays by the tasks that draw from them, or
    draws are rows that meet the answers in joins; only the accuracies of (rep, benchmark, model) are ranked."""
    cells = written(answers.where("correct is not null").groupBy("benchmark", "model", "item").agg(F.avg("correct").alias("correct")))
    items = _placed(cells, ["benchmark"], "item")
    most = selection.largest(cells, ["benchmark"])
    if most <= replicates.HELD:
        rows = cells.join(items, ["benchmark", "item"])
        mark = lambda rep: F.pmod(F.xxhash64(rep, "benchmark"), F.lit(PRIME).cast("long"))
        acc = replicates.replicated(rows, ["benchmark"], ["model"], "correct", most, reps, seed, replicates.accuracies, "acc double", mark).where(~F.isnan("acc"))
    else:
        rows = cells.join(items.select("benchmark", "item", "k"), ["benchmark", "item"])
        acc = rows.join(_drawn(items, ["benchmark"], reps, seed), ["benchmark", "k"]).groupBy("rep", "benchmark", "model").agg((F.sum(F.col("correct") * F.col("times")) / F.sum("times")).alias("acc"))
    acc = written(acc)  # read twice
    if models_too:
        models = written(_placed(cells, [], "model"))
        who = _drawn(models, [], reps, seed + 1).join(models.select("model", "k"), "k").select("rep", "model")
        acc = acc.join(who, ["rep", "model"])
    released(cells)
    part = acc.join(F.broadcast(picks.select("policy", "benchmark")), "benchmark").groupBy("rep", "policy", "model").agg(F.avg("acc").alias("part"))
    both = part.join(acc.groupBy("rep", "model").agg(F.avg("acc").alias("ability")), ["rep", "model"])
    # means of the same numbers in another order are ties
    both = both.withColumns({"part": F.round("part", 12), "ability": F.round("ability", 12)})
    ranks = both.withColumns({"a": average_rank("part", ["rep", "policy"]), "b": average_rank("ability", ["rep", "policy"])})
    rho = F.when(F.count("*") > 2, safe_corr(F.col("a"), F.col("b")))
    return ranks.groupBy("rep", "policy").agg(F.coalesce(rho, F.lit(float("nan"))).alias("rho"))


def head_to_head(draws: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, p_greater, mean_diff, lo, hi) of two policies over shared replicates."""
    side = lambda p, n: draws.where((F.col("policy") == p) & ~F.isnan("rho")).select("rep", F.col("rho").alias(n))
    d = side(a, "x").join(side(b, "y"), "rep").withColumn("d", F.col("x") - F.col("y"))
    return d.agg(F.count("*").alias("n"), F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("p_greater"), F.avg("d").alias("mean_diff"), F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"))
