"""Correlation, trend tests and agreement, grouped; and the few distribution functions that p-values need.

Grouped statistics are aggregates over pairs of columns. Zero variance gives null rather than an error: every ratio divides by nullif.
Distribution functions are plain numpy for one statistic at a time, for results that are already one row per group.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanescope.functions.expressions import let
from wanescope.operators import ranking
from wanescope.operators.ranking import average_ranks, least_from_here, numbered, with_values
from wanescope.shared import released, written


def safe_corr(x: Column, y: Column) -> Column:
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def safe_slope(y: Column, x: Column) -> Column:
    """Least-squares slope of y on x over rows where both are there."""
    both = x.isNotNull() & y.isNotNull()
    return F.covar_pop(x, y) / F.nullif(F.var_pop(F.when(both, x)), F.lit(0.0))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank of a value in a small group, ties sharing the mean of their places; `ranking.average_ranks` is the way for groups of any size."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.dropna(subset=[x, y]).groupBy(*by).agg(F.count("*").alias("n"), safe_corr(F.col(x), F.col(y)).alias("r"))


def correlation_tests(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, r, p): Pearson's r with its two-sided p by Student's t, null for fewer than three rows."""
    out = pearson(df, by, x, y)
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return out.withColumn("p", F.when(F.col("n") > 2, F.when(F.abs("r") >= 1, 0.0).otherwise(t_two_sided_p(t, F.col("n") - 2))))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    ranks = average_ranks(df.dropna(subset=[x, y]).select(*by, x, y), by, {x: "_rx", y: "_ry"})
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), safe_corr(F.col("_rx"), F.col("_ry")).alias("rho"))


def kendall(df: DataFrame, by: list[str], x: str, y: str, key: str) -> DataFrame:
    """(by, n, tau): Kendall's tau-b of each group; key tells rows of a group apart.

    Discordant pairs are inversions of y in the order of x. Two different ranks of y part at one bit: among the rows that agree above it, a
    pair is inverted where the earlier row has 1 and the later 0. So each row is looked at once a bit, and ones before zeros are counted
    within chunks of the order and, by running sums over the chunks, across them. No pairs are made, and no window holds a group.
    """
    rows = written(df.dropna(subset=[x, y]).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(key).alias("_key")))
    placed = numbered(rows, by, ["_x", "_y", "_key"], "_at")
    ranks = numbered(rows, by, ["_y", "_key"], "_rank").groupBy(*by, "_y").agg(F.min("_rank").alias("_rank"))
    most = placed.agg(F.max("_at")).first()[0] or 0
    tied = {}
    for name, cols in (("_tx", ["_x"]), ("_ty", ["_y"]), ("_txy", ["_x", "_y"])):
        same = rows.groupBy(*by, *cols).agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
        tied[name] = same.groupBy(*by).agg(F.sum("pairs").alias(name))
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(0, int(most).bit_length() - 1)))).alias("_level")
    each = with_values(placed.select(*by, "_y", "_at"), ranks, [*by, "_y"]).select(*by, "_at", "_rank", levels)
    each = each.select(*by, "_level", F.expr("shiftright(_rank, _level + 1)").alias("_above"), F.expr("shiftright(_rank, _level) & 1").alias("_bit"), F.floor(F.col("_at") / ranking.CHUNK).alias("_chunk"), "_at")
    group = [*by, "_level", "_above"]
    chunks = each.groupBy(*group, "_chunk").agg(F.sum("_bit").alias("_ones"), F.count("*").alias("_n"))
    before = F.sum("_ones").over(Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    across = chunks.withColumn("_before", F.coalesce(before, F.lit(0))).groupBy(*by).agg(F.sum((F.col("_n") - F.col("_ones")) * F.col("_before")).alias("_d"))
    inside = F.sum("_bit").over(Window.partitionBy(*group, "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    within = each.withColumn("_before", inside).where("_bit = 0").groupBy(*by).agg(F.sum(F.coalesce("_before", F.lit(0))).alias("_d"))
    inverted = across.unionByName(within).groupBy(*by).agg(F.sum("_d").alias("_d"))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"))
    for values in (*tied.values(), inverted):
        out = with_values(out, values, by)
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    concord = all_pairs - F.col("_tx") - F.col("_ty") + F.col("_txy") - 2 * F.coalesce("_d", F.lit(0))
    return out.select(*by, "n", (concord / F.nullif(F.sqrt((all_pairs - F.col("_tx")) * (all_pairs - F.col("_ty"))), F.lit(0.0))).alias("tau"))


def inversions(values: np.ndarray) -> int:
    """Pairs out of order, by merging."""
    if len(values) < 2:
        return 0
    left, right = values[: len(values) // 2], values[len(values) // 2 :]
    total = inversions(left) + inversions(right)
    return total + int((len(left) - np.searchsorted(np.sort(left), right, "right")).sum())


def kendall_grouped(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """As `kendall`, in n log n steps for each group, for groups that fit in a task's memory."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values([x, y])
        a, b, n = d[x].to_numpy(), d[y].to_numpy(), len(d)
        pairs = lambda *c: int(sum(k * (k - 1) // 2 for k in d.groupby(list(c), sort=False).size()))
        n0, tx, ty, txy = n * (n - 1) // 2, pairs(x), pairs(y), pairs(x, y)
        s = n0 - tx - ty + txy - 2 * inversions(b)
        scale = math.sqrt(float(n0 - tx) * float(n0 - ty))
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], n, s / scale if scale and len(a) > 1 else None]], columns=[*by, "n", "tau"])

    kinds = dict(df.dtypes)
    return df.dropna(subset=[x, y]).groupBy(*by).applyInPandas(one, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n long", "tau double"]))


def mann_kendall(df: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """(by, n, s, tau): the trend statistic over ordered pairs, without tie correction."""
    rows = df.dropna(subset=[t, v]).select(*by, t, v)
    later = rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
    on = F.col(t) < F.col(f"_{t}")
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    s = rows.join(later, on).groupBy(*by).agg(F.sum(F.signum(F.col(f"_{v}") - F.col(v))).cast("long").alias("s"))
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return n.join(s, by).withColumn("tau", F.col("s") / (F.col("n") * (F.col("n") - 1) / F.lit(2.0)))


def mann_kendall_p(s: int, n: int) -> float:
    """Two-sided normal approximation with continuity correction."""
    var = n * (n - 1) * (2 * n + 5) / 18
    return 1.0 if s == 0 or var <= 0 else math.erfc((abs(s) - 1) / math.sqrt(2 * var))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, observed, expected, kappa); null where chance agreement is total."""
    rows = df.dropna(subset=[a, b])
    marks = rows.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(a).cast("string").alias("label")), F.struct(F.lit(1).alias("side"), F.col(b).cast("string").alias("label")))).alias("m")).select("m.*")
    by_label = marks.groupBy("label").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("na"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("nb"))
    expected = by_label.agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("dot"))
    seen = rows.agg(F.count("*").alias("n"), F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)).alias("observed"))
    out = seen.join(expected, F.lit(True)).withColumn("expected", F.col("dot") / (F.col("n").cast("double") * F.col("n")))
    return out.select("n", "observed", "expected", F.when(F.col("expected") < 1 - 1e-12, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def krippendorff_alpha(ratings: DataFrame, unit: str = "unit", label: str = "label") -> DataFrame:
    """One row (n, alpha): nominal alpha over all ordered pairs of ratings of a unit, each unit weighted by 1 / (ratings - 1)."""
    counts = ratings.dropna(subset=[unit, label]).groupBy(unit, label).agg(F.count("*").alias("k"))
    units = counts.groupBy(unit).agg(F.sum("k").alias("m"), F.sum(F.col("k").cast("double") * F.col("k")).alias("kk")).where("m > 1")
    observed = units.agg(F.sum("m").cast("double").alias("n"), F.sum((F.col("m").cast("double") * F.col("m") - F.col("kk")) / (F.col("m") - 1)).alias("off"))
    totals = counts.join(units.select(unit), unit, "left_semi").groupBy(label).agg(F.sum("k").cast("double").alias("t")).agg(F.sum("t").alias("all"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    out = observed.join(totals, F.lit(True))
    disagree = (F.col("all") * F.col("all") - F.col("tt")) / (F.col("all") - 1)
    return out.select(F.col("n").cast("long").alias("n"), (1 - F.col("off") / F.nullif(disagree, F.lit(0.0))).alias("alpha"))


def icc21(df: DataFrame, by: list[str], row: str, col: str, value: str, mode: str = "textbook") -> DataFrame:
    """(by, n, k, icc): two-way random single-rating agreement over complete tables of n rows and k columns. mode `legacy` divides the
    row and column mean squares once more in the residual, as some published figures do."""
    rows = df.dropna(subset=[value])
    size = rows.groupBy(*by).agg(F.countDistinct(row).cast("double").alias("n"), F.countDistinct(col).cast("double").alias("k"), F.avg(value).alias("grand"), F.var_pop(value).alias("var"), F.count("*").cast("double").alias("cells"))
    of_rows = rows.groupBy(*by, row).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.var_pop("m").alias("vr"))
    of_cols = rows.groupBy(*by, col).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.var_pop("m").alias("vc"))
    x = size.join(of_rows, by).join(of_cols, by) if by else size.join(of_rows, F.lit(True)).join(of_cols, F.lit(True))
    n, k = F.col("n"), F.col("k")
    ssr, ssc, sst = n * k * F.col("vr"), n * k * F.col("vc"), F.col("var") * F.col("cells")
    bms, jms = ssr / (n - 1), ssc / (k - 1)
    rest = sst - ssr - ssc if mode == "textbook" else sst - bms * (n - 1) / k - jms * (k - 1) / n
    ems = rest / ((n - 1) * (k - 1))
    return x.select(*by, n.cast("long").alias("n"), k.cast("long").alias("k"), ((bms - ems) / F.nullif(bms + (k - 1) * ems + k * (jms - ems) / n, F.lit(0.0))).alias("icc"))


def lord_chi2(a0: Column, a1: Column, b0: Column, b1: Column, se_a: float = 0.2, se_b: float = 0.3) -> tuple[Column, Column]:
    """Statistic and p of the drift test with two degrees of freedom."""
    x = F.pow((a1 - a0) / F.lit(se_a), F.lit(2.0)) / 2 + F.pow((b1 - b0) / F.lit(se_b), F.lit(2.0)) / 2
    return x, F.exp(-x / 2)


def benjamini_hochberg(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """df with q: false discovery rates within each group."""
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()))
    placed = numbered(rows, by, [F.col(p).asc_nulls_last(), "_row"], "_r")
    sizes = placed.groupBy(*by).agg(F.count(p).alias("_m"))
    released(rows)
    out = least_from_here(with_values(placed, sizes, by), by, "_r", F.col(p) * F.col("_m") / (F.col("_r") + 1), "q")
    return out.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("q")))).drop("_m", "_r", "_row")


def binomial_sf(x: int, n: int, p: float) -> float:
    """P(X >= x) of a binomial, as an incomplete beta function: sums of terms overflow from about a thousand trials on."""
    if x <= 0 or x > n:
        return float(x <= 0)
    return beta_inc(x, n - x + 1, p)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    f = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + up * d) or tiny)
            c = (1 + up / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return 1.0 if df <= 0 else beta_inc(df / 2, 0.5, df / (df + t * t))


def pearson_p(r: float, n: int) -> float:
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


@lru_cache(maxsize=64)
def _inversion_counts(n: int) -> tuple[int, ...]:
    counts = [1]
    for k in range(2, n + 1):
        sums = np.cumsum([0, *counts])
        counts = [int(sums[min(i + 1, len(counts))] - sums[max(0, i - k + 1)]) for i in range(len(counts) + k - 1)]
    return tuple(counts)


def kendall_exact_p(tau: float, n: int) -> float:
    """Two-sided exact p without ties, from the distribution of inversions."""
    counts = _inversion_counts(n)
    most = n * (n - 1) // 2
    low = round((1 - abs(tau)) * most / 2)
    return min(1.0, 2 * sum(counts[: low + 1]) / sum(counts))


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, as an expression: the finite sums over powers of the cosine of atan(t / sqrt(dof))
    that hold for odd and even ones."""
    odd = dof % 2 == 1
    cos2, sine = dof / (dof + t * t), F.abs(t) / F.sqrt(dof + t * t)

    def summed(x: Column) -> Column:
        first = F.when(x["odd"], F.sqrt(x["cos2"])).otherwise(1.0)
        # each term is the last one by cos^2 and a ratio of neighbouring whole numbers
        ratio = lambda k: F.when(x["odd"], 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        step = lambda z, k: let(z["term"] * x["cos2"] * ratio(k), lambda v: F.struct(v.alias("term"), (z["sum"] + v).alias("sum")))
        more = F.when(x["last"] >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(x["last"], F.lit(1).cast("long")))).otherwise(F.array().cast("array<long>"))
        return F.aggregate(more, F.struct(first.alias("term"), first.alias("sum")), step, lambda z: z["sum"])

    last = F.floor((dof - F.when(odd, 3).otherwise(2)) / 2).cast("long")
    series = let(F.struct(odd.alias("odd"), cos2.alias("cos2"), last.alias("last")), summed)
    inside = F.when(~odd, sine * series).when(dof == 1, F.asin(sine) * (2 / math.pi)).otherwise((F.asin(sine) + sine * series) * (2 / math.pi))
    return F.greatest(F.lit(0.0), 1 - inside)


def linear_regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, slope, intercept, r2, stderr): least squares of y on x."""
    rows = df.dropna(subset=[x, y])
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
    slope = F.col("cxy") / F.nullif(F.col("vx"), F.lit(0.0))
    out = out.withColumn("slope", slope).withColumn("r2", F.col("cxy") * F.col("cxy") / F.nullif(F.col("vx") * F.col("vy"), F.lit(0.0)))
    err = F.when(F.col("n") > 2, F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("r2")) * F.col("vy")) / F.nullif(F.col("vx"), F.lit(0.0)) / (F.col("n") - 2)))
    return out.select(*by, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "r2", err.alias("stderr"))


def detect_drift(params: DataFrame, alpha: float = 0.05, value: str = "a") -> DataFrame:
    """(benchmark, item, t_n, slope, p, significant): linear trend of an item parameter over epochs, Bonferroni over a benchmark's items."""
    fits = linear_regression(params, ["benchmark", "item"], "t", value).withColumn("items", F.count("*").over(Window.partitionBy("benchmark")))

    t, untested = F.col("slope") / F.nullif(F.col("stderr"), F.lit(0.0)), (F.col("n") < 3) | F.col("slope").isNull() | F.col("stderr").isNull()
    out = fits.withColumn("p", F.when(untested, 1.0).when(F.col("stderr") == 0, 0.0).otherwise(t_two_sided_p(t, F.col("n") - 2)))
    return out.select("benchmark", "item", F.col("n").alias("t_n"), "slope", "p", ((F.col("n") >= 3) & (F.col("p") < F.lit(alpha) / F.col("items"))).alias("significant"))


def drift_class(ceiling: Column, a_sig: Column, a_slope: Column, b_sig: Column, b_slope: Column) -> Column:
    return F.when(ceiling > 0.95, "ceiling").when(a_sig & (a_slope < 0), "discrimination_collapse").when(b_sig & (b_slope < 0) & ~a_sig, "difficulty_drift").otherwise("stable")


def leave_one_out_mae(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, mae): the mean size of the error at each row of the line through the others, by downdating: a row's residual over one less its
    leverage. Rows that alone decide the slope have no such error."""
    rows = df.dropna(subset=[x, y])
    sums = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_vx"), F.covar_pop(x, y).alias("_cxy"))
    both = with_values(rows, sums, by)
    dx = F.col(x) - F.col("_mx")
    vx = F.nullif(F.col("_vx"), F.lit(0.0))
    left = 1 - 1 / F.col("_n") - dx * dx / (F.col("_n") * vx)
    error = (F.col(y) - F.col("_my") - F.col("_cxy") / vx * dx) / F.when(left > 1e-12, left)
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"))


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients (intercept first; least norm where singular) and R squared, not under 0, of a small table."""
    design = np.column_stack((np.ones(len(y)), x))
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    total = float(((y - y.mean()) ** 2).sum())
    return beta, max(0.0, 1 - float(((y - design @ beta) ** 2).sum()) / total) if total else 0.0


def ols_frame(df: DataFrame, xs: list[str], y: str) -> tuple[np.ndarray, float]:
    """As `ols` over a frame of any size: the normal equations' sums are aggregated in Spark."""
    names = ["_1", *xs, y]
    rows = df.dropna(subset=[*xs, y]).withColumn("_1", F.lit(1.0))
    sums = rows.agg(*[F.sum(F.col(a).cast("double") * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]).first()
    m = np.array([[sums[f"s{i}_{j}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
    k = len(names) - 1
    beta = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
    total = m[k, k] - m[0, k] ** 2 / m[0, 0]
    rss = m[k, k] - 2 * beta @ m[:k, k] + beta @ m[:k, :k] @ beta
    return beta, max(0.0, 1 - rss / total) if total else 0.0


def loo_log_mae(x: np.ndarray, y: np.ndarray) -> float:
    """Mean absolute error of predicting each y (logarithms) from the others."""
    errors = []
    for i in range(len(y)):
        rest = np.arange(len(y)) != i
        beta, _ = ols(x[rest], y[rest])
        errors.append(abs(y[i] - float(np.concatenate(([1.0], np.atleast_1d(x[i]))) @ beta)))
    return float(np.mean(errors))


def out_of_sample_log_mae(beta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Log error of a fitted equation on other rows, and the factor that it stands for."""
    mae = float(np.abs(y - np.column_stack((np.ones(len(y)), x)) @ beta).mean())
    return mae, math.exp(mae)
