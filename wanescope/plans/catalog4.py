"""Queries over whole half-life fits: bounds of their own, three shapes, and their bootstraps; see `catalog`."""

from __future__ import annotations

from pyspark.sql import functions as F

from wanescope.operators import contamination as C
from wanescope.operators import fit, power, resample, stats
from wanescope.plans import halflife as H
from wanescope.plans import views as V
from wanescope.plans.catalog import CORR, ORACLES, PGAPS, QUERIES, RANKED, TOOLKIT, D, R, pctl_series, query
from wanescope.plans.catalog2 import pick_sql
from wanescope.plans.fit_sql import fit_sql, three_sql
from wanescope.plans.views import tidy


@query(f"WITH {TOOLKIT}, {fit_sql('ser', 'benchmark', fit.VALIDATION)} SELECT benchmark, n, {R(4, amplitude='amp', rate='rate', floor='flr', halflife='h')} FROM best")
def refined_fit(spark, sf):
    """The validation's fit: rates from 1e-5, no half-life below 1e-4."""
    found = fit.decay_fit(power.topk_variance(V.scores(spark, sf)), ["benchmark"], fit.VALIDATION)
    return tidy(found.select("benchmark", "n", "amplitude", "rate", "floor", "halflife"), 4)


GATED = f"tr AS (SELECT benchmark, covar_pop(t, v) / nullif(var_pop(t), 0) AS slope FROM ser GROUP BY 1), {fit_sql('ser', 'benchmark', fit.PANEL)}"


@query(f"WITH {RANKED}, {pctl_series(0.2, 10)}, {GATED} SELECT benchmark, n, {R(4, halflife='CASE WHEN slope < 0 AND h <= 200 THEN h END')} FROM best JOIN tr USING (benchmark)")
def gated_halflife(spark, sf):
    """The bootstraps' point estimate: a falling trend, rates up to 1, half-lives up to 200 months."""
    series = power.topk_variance(V.scores(spark, sf), "boot_v2")
    found = fit.decay_fit(series, ["benchmark"], fit.PANEL).join(fit.trend(series, ["benchmark"]), "benchmark")
    return tidy(found.select("benchmark", "n", F.when((F.col("slope") < 0) & (F.col("halflife") <= 200), F.col("halflife")).alias("halflife")), 4)


@query(f"WITH {TOOLKIT}, {three_sql('ser', 'benchmark')} SELECT benchmark, n, shape, {R(4, rss='rss', aic='aic', bic='bic', delta_aic='delta_aic')}, {R(3, halflife='h')} FROM shapes")
def three_model_fits(spark, sf):
    found = fit.three_shapes(power.topk_variance(V.scores(spark, sf)), ["benchmark"])
    return tidy(found.select("benchmark", "n", "shape", "rss", "aic", "bic", "delta_aic"), 4).join(tidy(found.select("benchmark", "shape", "halflife"), 3), ["benchmark", "shape"])


PAIRS = (
    TOOLKIT + ", nb AS (SELECT benchmark, t, v, CAST(row_number() OVER (PARTITION BY benchmark ORDER BY q) - 1 AS BIGINT) AS k, count(*) OVER (PARTITION BY benchmark) AS m FROM ser), "
    f"dr AS (SELECT DISTINCT g.benchmark, CAST(r.i AS BIGINT) AS rep, {pick_sql('CAST(r.i AS BIGINT)', 'g.k')} % g.m AS k FROM nb g, range(1000) AS r(i)), "
    "ps AS MATERIALIZED (SELECT benchmark, rep, t, v FROM dr JOIN nb USING (benchmark, k))"
)
SPREAD = "count(*) AS n_boot, " + R(4, median="quantile_cont(h, 0.5)", lo="quantile_cont(h, 0.025)", hi="quantile_cont(h, 0.975)")


@query(
    f"WITH {PAIRS}, {three_sql('ps', 'benchmark, rep', constant=False, rounds=6)}, bs AS (SELECT benchmark, rep, h FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, rep ORDER BY aic, shape) AS place FROM shapes) WHERE place = 1 AND h > 0) "
    f"SELECT benchmark, {SPREAD} FROM bs GROUP BY 1"
)
def pair_bootstrap(spark, sf):
    return tidy(resample.pair_bootstrap(power.topk_variance(V.scores(spark, sf)), ["benchmark"]), 4)


MODELS = (
    V.SCORES + ", nb AS MATERIALIZED (SELECT benchmark, q, score, CAST(row_number() OVER (PARTITION BY benchmark, q ORDER BY eval_date, model, score) - 1 AS BIGINT) AS k, count(*) OVER (PARTITION BY benchmark, q) AS m FROM scores), "
    f"dr AS (SELECT g.benchmark, g.q, CAST(r.i AS BIGINT) AS rep, {pick_sql('CAST(r.i AS BIGINT)', 'g.k')} % g.m AS k FROM nb g, range(1000) AS r(i)), "
    "rk AS (SELECT rep, benchmark, q, score, row_number() OVER (PARTITION BY rep, benchmark, q ORDER BY score DESC) AS rn, m AS n, min(q) OVER (PARTITION BY rep, benchmark) AS q0 FROM dr JOIN nb USING (benchmark, q, k)), "
    f"bser AS MATERIALIZED (SELECT rep, benchmark, {D(3)} * (q - min(q0)) AS t, var_pop(score) AS v FROM rk WHERE n >= 10 AND rn <= greatest(1, ceil(n * {D(0.2)})) GROUP BY rep, benchmark, q), "
    f"{fit_sql('bser', 'rep, benchmark', name='y', best='bfit')}, bs AS (SELECT benchmark, h FROM bfit WHERE h > 0.1 AND h < 500)"
)


@query(f"WITH {MODELS} SELECT benchmark, {SPREAD} FROM bs GROUP BY 1")
def bootstrap_halflife(spark, sf):
    return tidy(resample.bootstrap_halflife(V.scores(spark, sf)), 4)


@query(
    f"WITH {MODELS}, ci AS (SELECT benchmark, {SPREAD} FROM bs GROUP BY 1), {TOOLKIT[len(V.SCORES) + 2:].replace('rk AS', 'rk0 AS', 1).replace('FROM rk ', 'FROM rk0 ')}, {fit_sql('ser', 'benchmark')}, "
    "nm AS (SELECT benchmark, count(DISTINCT model) AS n_models FROM scores GROUP BY 1) "
    f"SELECT benchmark, n_models, n AS n_quarters, {R(4, amplitude='amp', rate='rate', floor='flr', halflife='h')}, n_boot, median, lo, hi, "
    "CASE WHEN h IS NULL THEN 'noisy' WHEN h < 3 THEN 'exhausted' WHEN h < 10 THEN 'decaying' WHEN h < 24 THEN 'slow' ELSE 'stable' END AS status FROM nm JOIN best USING (benchmark) LEFT JOIN ci USING (benchmark)"
)
def halflife_report(spark, sf):
    return tidy(H.report(V.scores(spark, sf)), 4)


def t_sql(t: str, dof: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom, its terms by gamma functions."""
    cos2, sine = f"({dof} / ({dof} + {t} * {t}))", f"(abs({t}) / sqrt({dof} + {t} * {t}))"
    even = f"{sine} * list_sum(list_transform(range(0, {dof} // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow({cos2}, k)))"
    odd = f"coalesce({sine} * list_sum(list_transform(range(1, ({dof} - 1) // 2 + 1), lambda k: sqrt(pi()) / 2 * exp(lgamma(CAST(k AS DOUBLE)) - lgamma(k + 0.5)) * pow({cos2}, k - 0.5))), 0)"
    return f"greatest(0, 1 - CASE WHEN {dof} % 2 = 0 THEN {even} ELSE 2 / pi() * (asin({sine}) + {odd}) END)"


def _trend(value: str) -> str:
    line = f"covar_pop(t, {value}) / nullif(var_pop(t), 0)"
    square = f"pow(covar_pop(t, {value}), 2) / nullif(var_pop(t) * var_pop({value}), 0)"
    fits = f"SELECT item, count(*) AS n, {line} AS slope, sqrt(greatest(0, (1 - {square}) * var_pop({value})) / nullif(var_pop(t), 0) / nullif(count(*) - 2, 0)) AS se FROM params GROUP BY 1"
    p = f"CASE WHEN n < 3 OR slope IS NULL OR se IS NULL THEN 1 WHEN se = 0 THEN 0 ELSE {t_sql('(slope / se)', '(n - 2)')} END"
    return f"SELECT *, n >= 3 AND p < 0.05 / count(*) OVER () AS sig FROM (SELECT *, {p} AS p FROM ({fits}))"


PAIRED = (
    PGAPS + ", nb AS (SELECT benchmark, orig, pert, CAST(row_number() OVER (PARTITION BY benchmark ORDER BY model) - 1 AS BIGINT) AS k, count(*) OVER (PARTITION BY benchmark) AS n FROM pg), "
    f"dr AS (SELECT g.benchmark, CAST(r.i AS BIGINT) AS rep, {pick_sql('CAST(r.i AS BIGINT)', 'g.k')} % g.n AS k FROM nb g, range(5000) AS r(i)), "
    f"bs AS (SELECT benchmark, r FROM (SELECT dr.benchmark, rep, {CORR('orig', 'pert')} AS r FROM dr JOIN nb ON dr.benchmark = nb.benchmark AND dr.k = nb.k GROUP BY 1, 2) WHERE r IS NOT NULL), "
    "ci AS (SELECT benchmark, count(*) AS n_boot, quantile_cont(r, 0.5) AS md, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM bs GROUP BY 1), "
    f"co AS (SELECT benchmark, count(*) AS n, {CORR('orig', 'pert')} AS r FROM pg GROUP BY 1)"
)


@query(
    f"WITH {PAIRED} SELECT benchmark, n, n_boot, {R(r='r', median='md', lo='lo', hi='hi')}, "
    f"{R(p='CASE WHEN n > 2 THEN CASE WHEN abs(r) >= 1 THEN 0 ELSE ' + t_sql('(r * sqrt((n - 2) / nullif(1 - r * r, 0)))', '(n - 2)') + ' END END')} FROM co JOIN ci USING (benchmark)"
)
def correlation_intervals(spark, sf):
    """Accuracies of both versions: r, its p and its bootstrap interval."""
    g = C.gaps(V.panel(spark, sf)).select("benchmark", "model", "orig", "pert")
    r = stats.correlation_tests(g, ["benchmark"], "orig", "pert")
    return tidy(r.join(resample.correlation_bootstrap(g, ["benchmark"], ["model"], "orig", "pert"), "benchmark"))


META = (
    RANKED + ", cut AS (SELECT benchmark, q, quantile_cont(score, 0.8) AS cut FROM scores GROUP BY 1, 2), "
    "sf AS (SELECT benchmark, q, var_samp(score) AS va, var_samp(CASE WHEN score >= cut THEN score END) / var_samp(score) AS ratio FROM rk JOIN cut USING (benchmark, q) WHERE n >= 10 GROUP BY 1, 2), "
    "mr AS MATERIALIZED (SELECT q, ln(avg(ratio)) AS y, avg(va) AS x FROM sf WHERE ratio > 0 GROUP BY 1), "
    "nb AS (SELECT x, y, CAST(row_number() OVER (ORDER BY q) - 1 AS BIGINT) AS k, count(*) OVER () AS n FROM mr), "
    f"dr AS (SELECT CAST(r.i AS BIGINT) AS rep, {pick_sql('CAST(r.i AS BIGINT)', 'g.k')} % g.n AS k FROM nb g, range(2000) AS r(i)), "
    "bs AS (SELECT b FROM (SELECT rep, covar_pop(x, y) / nullif(var_pop(x), 0) AS b FROM dr JOIN nb USING (k) GROUP BY 1) WHERE b IS NOT NULL), "
    "su AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cxy FROM mr), "
    "lo AS (SELECT avg(abs((y - my - cxy / vx * (x - mx)) / (1 - 1 / n - (x - mx) * (x - mx) / (n * vx)))) AS mae FROM mr, su)"
)


@query(
    f"WITH {META} SELECT {R(4, slope='cxy / vx', lo='(SELECT quantile_cont(b, 0.025) FROM bs)', hi='(SELECT quantile_cont(b, 0.975) FROM bs)', r2='cxy * cxy / (vx * vy)', loo_mae='mae')} FROM su, lo"
)
def meta_regression(spark, sf):
    """Log variance ratio on variance over quarters: slope with its bootstrap interval, R squared and leave-one-out error."""
    rows = power.stratification_effect(V.scores(spark, sf)).where("ratio > 0").groupBy("q").agg(F.log(F.avg("ratio")).alias("y"), F.avg("var_all").alias("x"))
    line = stats.linear_regression(rows.withColumn("all", F.lit(1)), ["all"], "x", "y").select("slope", "r2")
    draws = resample.slope_bootstrap(rows.withColumn("all", F.lit(1)), ["all"], ["q"], "x", "y").select("lo", "hi")
    loo = stats.leave_one_out_mae(rows, [], "x", "y").select(F.col("mae").alias("loo_mae"))
    return tidy(line.crossJoin(draws).crossJoin(loo), 4)  # a row each


ORACLES["irt_trend_drift"] = (
    f"WITH {V.PARAMS}, fa AS ({_trend('a')}), fb AS ({_trend('b')}) SELECT item, CASE WHEN fa.sig AND fa.slope < 0 THEN 'discrimination_collapse' WHEN fb.sig AND fb.slope < 0 AND NOT fa.sig THEN 'difficulty_drift' ELSE 'stable' END AS class, "
    f"{R(a_slope='fa.slope', b_slope='fb.slope', p='fb.p')} FROM fa JOIN fb USING (item)"
)


def rasch_sql(source: str, by: str, rounds: int = 60) -> str:
    """CTE `rb` (by, item, b, n_models) of Rasch difficulties over source (by, model, item, correct): rounds of Newton steps over classes of items
    that the same models answered, equally many right, and the shift that the priors decide."""
    p = "1 / (1 + exp(-greatest(least(theta - b, 30), -30)))"
    out = [
        f"rr AS MATERIALIZED (SELECT {by}, model, item, CAST(max(correct) AS DOUBLE) AS y FROM {source} WHERE correct IS NOT NULL GROUP BY {by}, model, item)",
        f"ri AS MATERIALIZED (SELECT {by}, item, sum(y) AS s, list(model ORDER BY model) AS who FROM rr GROUP BY {by}, item)",
        f"rc AS MATERIALIZED (SELECT {by}, who, s, CAST(count(*) AS DOUBLE) AS c FROM ri GROUP BY {by}, who, s)",
        f"rp AS MATERIALIZED (SELECT {by}, who, s, c, unnest(who) AS model FROM rc)",
        f"t0 AS MATERIALIZED (SELECT {by}, model, sum(y) AS r, CAST(0 AS DOUBLE) AS theta FROM rr GROUP BY {by}, model)",
        "b0 AS MATERIALIZED (SELECT *, CAST(0 AS DOUBLE) AS b FROM rc)",
    ]
    for k in range(1, rounds + 1):
        out.append(f"u{k} AS MATERIALIZED (SELECT {by}, model, r, theta + (r - sum(c * p) - theta) / (sum(c * p * (1 - p)) + 1) AS theta FROM (SELECT *, {p} AS p FROM rp JOIN t{k - 1} USING ({by}, model) JOIN b{k - 1} USING ({by}, who, s, c)) GROUP BY {by}, model, r, theta)")
        out.append(f"d{k} AS MATERIALIZED (SELECT {by}, who, s, c, b + (sum(p) - s - b / 4) / (sum(p * (1 - p)) + CAST(0.25 AS DOUBLE)) AS b FROM (SELECT *, {p} AS p FROM rp JOIN u{k} USING ({by}, model) JOIN b{k - 1} USING ({by}, who, s, c)) GROUP BY {by}, who, s, c, b)")
        out.append(f"h{k} AS MATERIALIZED (SELECT {by}, -sum(pull) / sum(hold) AS h FROM (SELECT {by}, theta AS pull, 1 AS hold FROM u{k} UNION ALL SELECT {by}, c * b / 4, c / 4 FROM d{k}) GROUP BY {by})")
        out.append(f"t{k} AS MATERIALIZED (SELECT {by}, model, r, theta + h AS theta FROM u{k} JOIN h{k} USING ({by}))")
        out.append(f"b{k} AS MATERIALIZED (SELECT {by}, who, s, c, b + h AS b FROM d{k} JOIN h{k} USING ({by}))")
    out.append(f"rb AS (SELECT {by}, item, b, n_models FROM ri JOIN b{rounds} USING ({by}, who, s) JOIN (SELECT {by}, count(*) AS n_models FROM t0 GROUP BY {by}) USING ({by}))")
    return ",\n".join(out)


ORACLES["rasch_delta_b"] = (
    f"WITH {V.RESPONSES}, {rasch_sql('responses', 'benchmark, version')}, dl AS (SELECT o.benchmark, p.b - o.b AS delta FROM rb o JOIN rb p ON o.benchmark = p.benchmark AND o.item = p.item AND o.version = 'orig' AND p.version = 'pert') "
    f"SELECT benchmark, count(*) AS n_items, {R(4, mean_delta='avg(delta)', std_delta='stddev_pop(delta)')}, count(*) FILTER (WHERE delta < -1) AS below, count(*) FILTER (WHERE delta > 1) AS above, "
    f"{R(4, easier='avg(CASE WHEN delta < -0.5 THEN 1.0 ELSE 0.0 END)')} FROM dl GROUP BY 1"
)
ORACLES["rasch_windows"] = (
    f"WITH {V.RESPONSES}, {V.DIM}, wn AS (SELECT benchmark, w AS win, model, item, correct FROM responses JOIN dim USING (model), range(6) AS x(w) WHERE version = 'orig' AND ord BETWEEN w AND w + 1), "
    f'{rasch_sql("wn", "benchmark, win")} SELECT benchmark, CAST(win AS INTEGER) AS "window", item, {R(4, b="b")}, n_models FROM rb'
)

__all__ = ["ORACLES", "QUERIES"]
