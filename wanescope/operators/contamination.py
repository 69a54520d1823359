"""Original-versus-perturbed accuracy: gaps, decompositions, item drift, fidelity and subset rules over a long `responses` frame.

A null answer is not evaluated, never wrong. Gaps over versions use what each version has (available case); `paired_items` keeps items
with both versions. All operators group by benchmark and model or item, with partial aggregation; small dimensions come as frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanescope.operators.ranking import average_ranks, numbered, with_values
from wanescope.operators.stats import safe_corr, safe_slope
from wanescope.shared import released, written

VERSIONS = ("orig", "pert")


def accuracy(responses: DataFrame, min_valid: int = 1) -> DataFrame:
    """(benchmark, model, version, acc, n) over answered items."""
    return responses.groupBy("benchmark", "model", "version").agg(F.avg("correct").alias("acc"), F.count("correct").alias("n")).where(F.col("n") >= min_valid)


def _of(version: str) -> Column:
    return F.when(F.col("version") == version, F.col("correct"))


def gaps(responses: DataFrame, min_valid: int = 1, versions: tuple[str, str] = VERSIONS) -> DataFrame:
    """(benchmark, model, orig, pert, gap), available case."""
    a, b = versions
    out = responses.groupBy("benchmark", "model").agg(F.avg(_of(a)).alias("orig"), F.avg(_of(b)).alias("pert"), F.count(_of(a)).alias("n_orig"), F.count(_of(b)).alias("n_pert"))
    return out.where((F.col("n_orig") >= min_valid) & (F.col("n_pert") >= min_valid)).withColumn("gap", F.col("orig") - F.col("pert"))


def wide_items(responses: DataFrame, versions: tuple[str, str] = VERSIONS) -> DataFrame:
    """(benchmark, model, item, o, p): one row for each item that a model was given, with null where it wasn't answered."""
    return responses.groupBy("benchmark", "model", "item").agg(F.max(_of(versions[0])).alias("o"), F.max(_of(versions[1])).alias("p"))


def paired_items(responses: DataFrame) -> DataFrame:
    return wide_items(responses).where("o is not null and p is not null").withColumn("d", F.col("o") - F.col("p"))


def paired_gaps(responses: DataFrame, min_valid: int = 30) -> DataFrame:
    return paired_items(responses).groupBy("benchmark", "model").agg(F.avg("d").alias("gap"), F.count("*").alias("n")).where(F.col("n") >= min_valid)


def complete_items(responses: DataFrame) -> DataFrame:
    """(benchmark, item): items that every model of the benchmark answered in both versions."""
    models = responses.groupBy("benchmark").agg(F.countDistinct("model").alias("models"))
    full = paired_items(responses).groupBy("benchmark", "item").agg(F.count("*").alias("k"))
    return full.join(models, "benchmark").where("k = models").select("benchmark", "item")


def vendor_of(model: Column) -> Column:
    return F.when(model.startswith("gpt"), "openai").when(model.startswith("claude"), "anthropic").when(model.startswith("gemini"), "google").otherwise("other")


def vendor_gaps(gap: DataFrame, dim: DataFrame) -> DataFrame:
    """Mean gap by vendor; dim: (model, vendor)."""
    return gap.join(dim.select("model", "vendor"), "model").groupBy("vendor").agg(F.avg("gap").alias("mean_gap"), F.count("*").alias("n"))


def decomposition(gap: DataFrame, ceiling: float = 0.95, share: float = 0.3) -> DataFrame:
    """(benchmark, k, f, g): added spread under perturbation, a ceiling part of the original spread, and what is left of the perturbed one."""
    v = gap.groupBy("benchmark").agg(F.var_samp("orig").alias("var_orig"), F.var_samp("pert").alias("var_pert"), F.max("orig").alias("best"))
    k = F.greatest(F.lit(0.0), F.col("var_pert") - F.col("var_orig"))
    f = F.when(F.col("best") >= ceiling, F.lit(share) * F.col("var_orig")).otherwise(0.0)
    return v.withColumn("k", k).withColumn("f", f).withColumn("g", F.greatest(F.lit(0.0), F.col("var_pert") - F.col("k") - F.col("f")))


def decomposition_by_model(gap: DataFrame, ceiling: float = 0.95) -> DataFrame:
    """(benchmark, n_models, k, mean_gap, max_abs_gap, ceiling_frac); a single model has variances 0."""
    v = gap.groupBy("benchmark").agg(F.count("*").alias("n_models"), F.coalesce(F.var_samp("orig"), F.lit(0.0)).alias("vo"), F.coalesce(F.var_samp("pert"), F.lit(0.0)).alias("vp"), F.avg("gap").alias("mean_gap"), F.max(F.abs("gap")).alias("max_abs_gap"), F.avg(F.when(F.col("orig") >= ceiling, 1.0).otherwise(0.0)).alias("ceiling_frac"))
    return v.withColumn("k", F.greatest(F.lit(0.0), F.col("vp") - F.col("vo"))).drop("vo", "vp")


def item_gaps(responses: DataFrame, top_share: float = 0.12) -> DataFrame:
    """(benchmark, item, mean_gap, rank, top): items by mean gap over models; the top share rounds half to even."""
    g = paired_items(responses).groupBy("benchmark", "item").agg(F.avg("d").alias("mean_gap"))
    g = written(g)
    placed = numbered(g, ["benchmark"], [F.desc("mean_gap"), "item"], "rank")
    released(g)
    sizes = placed.groupBy("benchmark").agg(F.count("*").alias("n"))
    out = with_values(placed.withColumn("rank", (F.col("rank") + 1).cast("int")), sizes, ["benchmark"])
    return out.withColumn("top", F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(top_share)).cast("int"))).drop("n")


def universal_items(responses: DataFrame) -> DataFrame:
    """Items that every model with both answers gets right as written and wrong when perturbed."""
    return paired_items(responses).groupBy("benchmark", "item").agg(F.min("d").alias("least"), F.count("*").alias("n_models")).where("least = 1").select("benchmark", "item", "n_models")


DRIFT = ["incomplete", "all_correct", "all_wrong", "contamination_signature", "difficulty_drift", "discriminating", "noisy"]


def item_drift(responses: DataFrame, dim: DataFrame) -> DataFrame:
    """(benchmark, item, class) for items and the ordered models of dim (model, ord); the first rule that holds names the class."""
    n = dim.count()  # a short list of models
    rows = wide_items(responses).join(dim.select("model", "ord"), "model")
    rows = rows.withColumn("prev", F.lag("o").over(Window.partitionBy("benchmark", "item").orderBy("ord")))
    both = F.col("o").isNotNull() & F.col("p").isNotNull()
    out = rows.groupBy("benchmark", "item").agg(
        F.count(F.when(both, 1)).alias("k"), F.sum("o").alias("so"), F.sum("p").alias("sp"), F.count(F.when((F.col("o") == 1) & (F.col("p") == 0), 1)).alias("lost"), F.count(F.when((F.col("o") == 0) & (F.col("p") == 1), 1)).alias("won"), F.count(F.when(F.col("o") < F.col("prev"), 1)).alias("falls")
    )
    label = F.when(F.col("k") < n, "incomplete").when((F.col("so") == n) & (F.col("sp") == n), "all_correct").when((F.col("so") == 0) & (F.col("sp") == 0), "all_wrong").when((F.col("lost") >= 2) & (F.col("won") == 0), "contamination_signature").when((F.col("falls") == 0) & (F.col("so") > 0) & (F.col("so") < n), "difficulty_drift").when(F.col("so").between(1, n - 1), "discriminating").otherwise("noisy")
    return out.select("benchmark", "item", label.alias("class"))


def temporal_slopes(responses: DataFrame, dim: DataFrame, min_points: int = 3) -> DataFrame:
    """(benchmark, item, n, slope): least-squares slope of an item's gap on model time; dim: (model, t_year)."""
    rows = paired_items(responses).join(dim.select("model", "t_year"), "model")
    return rows.groupBy("benchmark", "item").agg(F.count("*").alias("n"), safe_slope(F.col("d"), F.col("t_year")).alias("slope")).where(F.col("n") >= min_points)


def temporal_summary(slopes: DataFrame, eps: float = 1e-9, steep: float = 0.5) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return slopes.where("slope is not null").groupBy("benchmark").agg(F.avg("slope").alias("mean_slope"), F.percentile("slope", F.lit(0.5)).alias("median_slope"), share(F.col("slope") > eps).alias("positive"), share(F.col("slope") > steep).alias("steep"), F.count("*").alias("n_items"))


def time_shifted(gap: DataFrame, dim: DataFrame, published: DataFrame) -> DataFrame:
    """gap rows with months from the benchmark's publication (benchmark, published) to the model's cutoff (model, cutoff), both `yyyy-MM`."""
    day = lambda c: F.to_date(F.concat(F.col(c), F.lit("-01")))
    return gap.join(dim.select("model", "cutoff"), "model").join(published, "benchmark").withColumn("months", F.date_diff(day("cutoff"), day("published")) / F.lit(30.44))


def fidelity(responses: DataFrame, eps: float = 1e-3) -> DataFrame:
    """How alike item accuracies over models are in both versions: correlations on raw, rank and logit scale, shift and agreement shares."""
    items = paired_items(responses).groupBy("benchmark", "item").agg(F.avg("o").alias("o"), F.avg("p").alias("p"))
    clip = lambda c: F.greatest(F.least(F.col(c), F.lit(1 - eps)), F.lit(eps))
    logit = lambda c: -F.log(clip(c) / (1 - clip(c)))
    rows = average_ranks(items, ["benchmark"], {"o": "ro", "p": "rp"}).withColumns({"lo": logit("o"), "lp": logit("p")})
    near = lambda d: F.avg(F.when(F.abs(F.col("o") - F.col("p")) < d, 1.0).otherwise(0.0))
    return rows.groupBy("benchmark").agg(F.count("*").alias("n_items"), safe_corr(F.col("o"), F.col("p")).alias("pearson"), safe_corr(F.col("ro"), F.col("rp")).alias("spearman"), safe_corr(F.col("lo"), F.col("lp")).alias("logit_r"), (F.avg("p") - F.avg("o")).alias("mean_shift"), near(0.001).alias("exact"), near(0.25).alias("close"))


def per_item_fidelity(responses: DataFrame) -> DataFrame:
    """(benchmark, item, n, r, gap): correlation of versions over models; without variance 1 where all answers agree, else 0."""
    x = paired_items(responses).groupBy("benchmark", "item").agg(F.count("*").alias("n"), safe_corr(F.col("o"), F.col("p")).alias("raw"), F.sum(F.abs("d")).alias("off"), F.avg("d").alias("gap"))
    return x.select("benchmark", "item", "n", F.coalesce("raw", F.when(F.col("off") == 0, 1.0).otherwise(0.0)).alias("r"), "gap")


def grouped_gaps(responses: DataFrame, item_dim: DataFrame, by: str, population: bool) -> DataFrame:
    """Mean and spread of item gaps by an item attribute; population: ddof 0, with 0 for one item."""
    items = paired_items(responses).groupBy("benchmark", "item").agg(F.avg("d").alias("gap")).join(item_dim.select("item", by), "item")
    return items.groupBy("benchmark", by).agg(F.avg("gap").alias("mean_gap"), (F.stddev_pop("gap") if population else F.stddev_samp("gap")).alias("std_gap"), F.count("*").alias("n_items"))


def cluster_of(subject: Column, clusters: dict[str, list[str]], other: str = "Other") -> Column:
    out = F.lit(other)
    for name, subjects in clusters.items():
        out = F.when(subject.isin(subjects), name).otherwise(out)
    return out


def on_items(responses: DataFrame, items: DataFrame) -> DataFrame:
    """responses of the items of another frame (benchmark, item)."""
    return responses.join(items.select("benchmark", "item").distinct(), ["benchmark", "item"], "left_semi")


def cross_set_residual(main: DataFrame, extra: DataFrame) -> DataFrame:
    """Mean and spread over models of how the gap differs between two item sets; both as from `gaps`."""
    both = main.select("model", F.col("gap").alias("g0")).join(extra.select("model", F.col("gap").alias("g1")), "model")
    return both.agg(F.count("*").alias("n"), F.avg(F.col("g1") - F.col("g0")).alias("mean_residual"), F.stddev_samp(F.col("g1") - F.col("g0")).alias("std_residual"))


def rank_steps(acc: DataFrame) -> DataFrame:
    """Median and mean step between models that are next to each other in accuracy; acc: (benchmark, version, acc)."""
    steps = acc.withColumn("step", F.col("acc") - F.lag("acc").over(Window.partitionBy("benchmark", "version").orderBy("acc")))
    return steps.where("step is not null").groupBy("benchmark", "version").agg(F.percentile("step", F.lit(0.5)).alias("median_step"), F.avg("step").alias("mean_step"))


def binomial_excess(universal: int, items: int, p: float) -> float:
    """How likely at least as many universal items are if each is one with probability p."""
    from wanescope.operators.stats import binomial_sf

    return binomial_sf(universal, items, p)


def retry_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with its null answers filled from new; answers that are there stay."""
    keys = ["benchmark", "model", "item", "version"]
    return old.join(new.select(*keys, F.col("correct").alias("_new")), keys, "left").withColumn("correct", F.coalesce("correct", "_new")).drop("_new")


def unfinished(wanted: DataFrame, responses: DataFrame, min_valid: int = 50) -> DataFrame:
    """The (benchmark, model) pairs of wanted without more than min_valid answers yet."""
    done = responses.groupBy("benchmark", "model").agg(F.count("correct").alias("n")).where(F.col("n") > min_valid)
    return wanted.join(done, ["benchmark", "model"], "left_anti")


def append_items(main: DataFrame, extra: DataFrame) -> DataFrame:
    """Two item sets as one: extra's items follow main's, for models that main has."""
    offset = main.groupBy("benchmark").agg((F.max("item") + 1).alias("_from"))
    moved = extra.join(main.select("benchmark", "model").distinct(), ["benchmark", "model"], "left_semi").join(offset, "benchmark").withColumn("item", F.col("item") + F.col("_from")).drop("_from")
    return main.unionByName(moved.select(main.columns))
