"""Discriminative power of benchmarks over time: dispersion series per calendar quarter, saturation and status labels.

Every operator takes a long `scores` frame (benchmark, model, score, eval_date) and groups by benchmark and quarter, so one shuffle on
these keys serves it; means and variances aggregate before it. Null scores and dates are not evaluated rows and are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanescope.operators import replicates, selection
from wanescope.operators.ranking import with_values
from wanescope.operators.selection import interpolated, order_values

GROUP = ["benchmark", "q"]
#: Days in a month of the day-based month axis.
MONTH_DAYS = 30.44


def quarter_index(date: Column) -> Column:
    return (F.year(date) * 4 + F.quarter(date) - 1).cast("int")


def quarter_label(q: Column) -> Column:
    return F.concat(F.floor(q / 4).cast("string"), F.lit("Q"), (q % 4 + 1).cast("string"))


def quarter_start(q: Column) -> Column:
    return F.make_date(F.floor(q / 4).cast("int"), (q % 4 * 3 + 1).cast("int"), F.lit(1))


def with_quarter(scores: DataFrame, date_col: str = "eval_date", score_col: str = "score") -> DataFrame:
    return scores.dropna(subset=[score_col, date_col]).withColumn("q", quarter_index(F.col(date_col)))


def quarter_window(scores: DataFrame, first: str, last: str) -> DataFrame:
    """Rows between two quarters like 2024Q2, both included."""
    of = lambda s: int(s[:4]) * 4 + int(s[5]) - 1
    return with_quarter(scores).where(F.col("q").between(of(first), of(last))).drop("q")


def months_by_index(q: Column, origin: Column) -> Column:
    return 3.0 * (q - origin)


def months_by_days(q: Column, origin: Column) -> Column:
    return F.date_diff(quarter_start(q), quarter_start(origin)) / F.lit(MONTH_DAYS)


@dataclass(frozen=True)
class Variant:
    """A definition of the top stratum's variance and of the series that it gives."""

    rows: bool  # the ceil(n * k) largest rows, else all at or over the (1 - k) percentile
    ddof: int
    min_group: int
    min_top: int
    day_months: bool
    origin_eligible: bool
    min_quarters: int = 1


VARIANTS = {
    "toolkit": Variant(True, 0, 10, 1, False, False),
    "boot_v1": Variant(False, 1, 5, 3, True, True, 3),
    "boot_v2": Variant(False, 1, 10, 3, True, True, 4),
    "select_v1": Variant(False, 1, 15, 3, True, False),
    "select_v2": Variant(False, 1, 10, 3, True, False),
    "nlargest": Variant(True, 1, 20, 1, True, True),
    "panel_v1": Variant(False, 1, 5, 3, True, True),
    "panel_v2": Variant(False, 1, 20, 3, True, True),
}


def _top_rows(rows: DataFrame, by: list[str], k: float, rule: Variant, largest: int | None = None) -> DataFrame:
    """(by, n, value, n_top): the variance of each group's n_top = ceil(k n) largest scores. The least of them is selected; of the scores
    that equal it, as many count as are left over by the greater ones, so ties are shared out without numbering them. Where all groups are
    small, their scores are sorted instead. largest: the size of the largest group where the caller knows it."""
    n_top = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") * F.lit(k)))
    if (selection.largest(rows, by) if largest is None else largest) <= selection.FEW:
        own = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), False).alias("all")).where(F.col("n") >= rule.min_group)
        own = own.withColumn("n_top", n_top).withColumn("top", F.slice("all", F.lit(1), F.col("n_top").cast("int")))
        total = lambda part: F.aggregate("top", F.lit(0.0), lambda s, x: s + part(x.cast("double")))
        own = own.withColumn("mean", total(lambda x: x) / F.col("n_top"))
        squares = total(lambda x: (x - F.col("mean")) * (x - F.col("mean")))
        return own.select(*by, "n", (squares / F.nullif(F.col("n_top") - rule.ddof, F.lit(0))).alias("value"), "n_top")
    cuts = order_values(rows, by, "score", F.when(F.col("n") >= rule.min_group, F.array(F.col("n") - n_top))).select(*by, "n", n_top.alias("n_top"), F.col("at").alias("cut"))
    over = F.when(F.col("score") > F.col("cut"), F.col("score"))
    sums = with_values(rows.select(*by, "score"), cuts, by).groupBy(*by, "n", "n_top", "cut").agg(F.count(over).alias("c"), F.avg(over).alias("m"), F.var_pop(over).alias("v"))
    squares = F.coalesce(F.col("v") * F.col("c") + F.pow(F.col("cut") - F.col("m"), F.lit(2.0)) * F.col("c") * (F.col("n_top") - F.col("c")) / F.col("n_top"), F.lit(0.0))
    return sums.select(*by, "n", (squares / F.nullif(F.col("n_top") - rule.ddof, F.lit(0))).alias("value"), "n_top")


def _series(top: DataFrame, observed: DataFrame, by: list[str], variant: str, k: float) -> DataFrame:
    """topk_variance's rows from (by, q, n, value, n_top) and the first quarter that has rows, `observed`, for all columns of by or some."""
    rule = VARIANTS[variant]
    series = top.where((F.col("n_top") >= rule.min_top) & F.col("value").isNotNull()).join(observed, [c for c in by if c in observed.columns])
    whole = Window.partitionBy(*by)
    series = series.withColumn("quarters", F.count("*").over(whole)).withColumn("origin", F.min("q").over(whole) if rule.origin_eligible else F.col("observed"))
    months = months_by_days if rule.day_months else months_by_index
    return series.where(F.col("quarters") >= rule.min_quarters).select(*by, F.lit(variant).alias("variant"), F.lit(k).alias("k"), "q", quarter_label(F.col("q")).alias("quarter"), months(F.col("q"), F.col("origin")).alias("t_months"), "value", "n")


def topk_variance(scores: DataFrame, variant: str = "toolkit", k: float = 0.2, keys: list[str] | None = None, largest: int | None = None) -> DataFrame:
    """(benchmark, variant, k, q, quarter, t_months, value, n): the variance of the top stratum in each eligible quarter. keys: more
    grouping columns of scores, such as a resample's number. largest: rows of the largest group, counted where it isn't given."""
    rule, by = VARIANTS[variant], [*(keys or []), "benchmark"]
    rows = with_quarter(scores)
    observed = rows.groupBy(*by).agg(F.min("q").alias("observed"))
    spread = F.var_pop("score") if rule.ddof == 0 else F.var_samp("score")
    if rule.rows:
        top = _top_rows(rows, [*by, "q"], k, rule, largest)
    else:  # one row per group meets its scores again: no group is held in one task
        cuts = rows.groupBy(*by, "q").agg(F.count("*").alias("n"), F.percentile("score", F.lit(1.0 - k)).alias("cut")).where(F.col("n") >= rule.min_group)
        top = rows.join(cuts, [*by, "q"]).where("score >= cut").groupBy(*by, "q", "n").agg(spread.alias("value"), F.count("*").alias("n_top"))
    return _series(top, observed, by, variant, k)


def resampled_topk(placed: DataFrame, observed: DataFrame, most: int, variant: str, k: float, reps: int, seed: int) -> DataFrame:
    """topk_variance's rows with `rep` over resamples of each quarter's rows, from placed (benchmark, q, k, n, score) without the drawn
    rows. observed: (benchmark, observed), its first quarter, which is that of all resamples as they are as large as their quarter. most:
    rows of the largest quarter."""
    rule = VARIANTS[variant]
    of = replicates.top_variance(k, rule.rows, rule.ddof, rule.min_group)
    top = replicates.replicated(placed, GROUP, [], "score", most, reps, seed, of, "n long, value double, n_top long")
    return _series(top.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))), observed, ["rep", "benchmark"], variant, k)


def topk_sweep(scores: DataFrame, ks: list[float], variant: str = "boot_v2") -> DataFrame:
    """The series for several shares, in one union of plans over the same scan."""
    out = topk_variance(scores, variant, ks[0])
    for k in ks[1:]:
        out = out.unionByName(topk_variance(scores, variant, k))
    return out


def quarter_summary(scores: DataFrame) -> DataFrame:
    return with_quarter(scores).groupBy(*GROUP).agg(F.count("*").alias("n_models"), F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score")).withColumn("quarter", quarter_label(F.col("q")))


def score_range(scores: DataFrame, hi: float = 0.9, lo: float = 0.1) -> DataFrame:
    """Width between two percentiles in each quarter."""
    return with_quarter(scores).groupBy(*GROUP).agg((F.percentile("score", F.lit(hi)) - F.percentile("score", F.lit(lo))).alias("score_range"))


def inter_model_variance(scores: DataFrame, min_group: int = 1) -> DataFrame:
    return with_quarter(scores).groupBy(*GROUP).agg(F.count("*").alias("n"), F.var_samp("score").alias("variance")).where(F.col("n") >= min_group)


def stratification_effect(scores: DataFrame, k: float = 0.2, min_group: int = 10) -> DataFrame:
    """Variance of everyone beside that of the top stratum, and their ratio."""
    rows = with_quarter(scores)
    cuts = rows.groupBy(*GROUP).agg(F.count("*").alias("n"), F.percentile("score", F.lit(1.0 - k)).alias("cut")).where(F.col("n") >= min_group)
    out = rows.join(cuts, GROUP).groupBy(*GROUP).agg(F.var_samp("score").alias("var_all"), F.var_samp(F.when(F.col("score") >= F.col("cut"), F.col("score"))).alias("var_top"))
    return out.withColumn("ratio", F.col("var_top") / F.nullif(F.col("var_all"), F.lit(0.0)))


def ceiling_compression(scores: DataFrame, top_k: float = 0.25) -> DataFrame:
    """1 - IQR(top max(2, floor(k n))) / IQR(all); null under 4 rows, 1 where all are alike."""
    rows = with_quarter(scores)
    n = F.col("n")
    m = F.greatest(F.lit(2).cast("long"), F.floor(n * F.lit(top_k)))
    marks = {"a1": (n - 1) * 0.25, "a3": (n - 1) * 0.75, "t1": n - m + (m - 1) * 0.25, "t3": n - m + (m - 1) * 0.75}  # quartiles of all and of the top
    iqr_all, iqr_top = F.col("a3") - F.col("a1"), F.col("t3") - F.col("t1")
    value = F.when(n < 4, F.lit(None)).when(iqr_all < 1e-10, F.lit(1.0)).otherwise(1.0 - iqr_top / F.nullif(iqr_all, F.lit(0.0)))
    return interpolated(rows, GROUP, "score", marks).select(*GROUP, "n", value.alias("compression"))


def ranking_stability(scores: DataFrame, min_group: int = 3, min_common: int = 3) -> DataFrame:
    """Kendall's tau-b between consecutive eligible quarters over the models in both; a model counts by its first row in a quarter."""
    rows = with_quarter(scores)
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*GROUP, "model").orderBy("eval_date", "score"))).where("rn = 1").select(*GROUP, "model", "score")
    sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") >= min_group)
    steps = sizes.withColumn("prev", F.lag("q").over(Window.partitionBy("benchmark").orderBy("q"))).where("prev is not null").select("benchmark", F.col("q").alias("now"), "prev")
    now = first.join(steps, (first.benchmark == steps.benchmark) & (first.q == steps.now)).select(first.benchmark, "now", "prev", "model", F.col("score").alias("y"))
    before = first.select(F.col("benchmark").alias("b0"), F.col("q").alias("q0"), F.col("model").alias("m0"), F.col("score").alias("x"))
    both = now.join(before, (F.col("benchmark") == F.col("b0")) & (F.col("prev") == F.col("q0")) & (F.col("model") == F.col("m0"))).select("benchmark", F.col("now").alias("q"), "model", "x", "y")
    from wanescope.operators.stats import kendall

    return kendall(both, GROUP, "x", "y", "model").where(F.col("n") >= min_common)


def metrics_over_time(scores: DataFrame, min_group: int = 3) -> DataFrame:
    """One row per eligible quarter: months, n, mean, variance, compression and ranking stability."""
    base = with_quarter(scores).groupBy(*GROUP).agg(F.count("*").alias("n_models"), F.avg("score").alias("mean_score"), F.var_samp("score").alias("variance")).where(F.col("n_models") >= min_group)
    months = months_by_days(F.col("q"), F.min("q").over(Window.partitionBy("benchmark")))
    tau = ranking_stability(scores, min_group).select(*GROUP, F.col("tau").alias("kendall_tau"))
    return base.withColumn("months", months).join(ceiling_compression(scores).select(*GROUP, "compression"), GROUP).join(tau, GROUP, "left")


def saturation_index(scores: DataFrame, k_th: int = 5) -> DataFrame:
    """exp(-((top - kth) / sd)^2) in each benchmark's latest quarter; null under k_th + 1 rows, 1 where the spread vanishes."""
    rows = with_quarter(scores)
    latest = rows.groupBy("benchmark").agg(F.max("q").alias("latest"))
    rows = with_values(rows, latest, ["benchmark"]).where("q = latest")
    sums = rows.groupBy(*GROUP).agg(F.count("*").alias("n"), F.max("score").alias("top"), F.stddev_samp("score").alias("sd"))
    kth = order_values(rows, GROUP, "score", F.array(F.greatest(F.col("n") - k_th, F.lit(0).cast("long")))).drop("place", "n")
    out = with_values(sums, kth, GROUP).select(*GROUP, "n", "top", F.when(F.col("n") >= k_th, F.col("at")).alias("kth"), "sd")
    s = F.when(F.col("n") < k_th + 1, F.lit(None)).when(F.col("sd") < 1e-9, F.lit(1.0)).otherwise(F.exp(-F.pow((F.col("top") - F.col("kth")) / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(2.0))))
    return out.withColumn("saturation", s)


def saturation_status(s: Column) -> Column:
    return F.when(s.isNull(), "unknown").when(s > 0.9, "SATURATED").when(s > 0.5, "partial").otherwise("unsaturated")


def halflife_status(t: Column) -> Column:
    return F.when(t.isNull(), "not measurable").when(t < 6, "EXHAUSTED").when(t < 12, "fast").when(t < 36, "slow").otherwise("very slow")


def decay_label(t: Column) -> Column:
    return F.when(t.isNull(), "noisy").when(t < 3, "exhausted").when(t < 10, "decaying").when(t < 24, "slow").otherwise("stable")


def disagreement(s: Column, t: Column, s_cut: float = 0.7, t_cut: float = 12.0) -> Column:
    """Saturation and half-life call a benchmark's state differently."""
    return (s > s_cut) != (t < t_cut)


def sota_gap(history: DataFrame, ceiling: float = 100.0) -> DataFrame:
    """Least gap to the ceiling of the running best, per day: (benchmark, release_date, months, gap). Rows of one day are one point."""
    daily = history.dropna(subset=["score", "release_date"]).groupBy("benchmark", "release_date").agg(F.max("score").alias("best"))
    w = Window.partitionBy("benchmark").orderBy("release_date")
    running = F.max("best").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.min("release_date").over(Window.partitionBy("benchmark"))
    return daily.select("benchmark", "release_date", (F.date_diff("release_date", start) / F.lit(MONTH_DAYS)).alias("months"), (F.lit(ceiling) - running).alias("gap"))


def mean_discrimination(params: DataFrame) -> DataFrame:
    """(benchmark, epoch, mean_a): an epoch's mean item discrimination."""
    return params.groupBy("benchmark", "epoch").agg(F.avg("a").alias("mean_a"))


def value_shares(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """How often each value occurs in its group, and its share."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))))


def model_counts(scores: DataFrame) -> DataFrame:
    """Distinct models of each benchmark; rows where there is no model column."""
    n = F.countDistinct("model") if "model" in scores.columns else F.count("*")
    return scores.groupBy("benchmark").agg(n.alias("n_models"))
