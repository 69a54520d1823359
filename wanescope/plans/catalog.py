"""Every query of the engine over the driver's tables, with its oracle in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanescope.operators import contamination as C
from wanescope.operators import fit, power, stats
from wanescope.plans import views as V
from wanescope.plans.fit_sql import fit_sql
from wanescope.plans.views import rounded as R
from wanescope.plans.views import tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


D = "CAST({} AS DOUBLE)".format
RANKED = V.SCORES + ", rk AS (SELECT *, row_number() OVER (PARTITION BY benchmark, q ORDER BY score DESC) AS rn, count(*) OVER (PARTITION BY benchmark, q) AS n, min(q) OVER (PARTITION BY benchmark) AS q0 FROM scores)"
LABEL = "CAST(q // 4 AS VARCHAR) || 'Q' || CAST(q % 4 + 1 AS VARCHAR)"


def pctl_series(k: float, min_group: int, min_top: int = 3, name: str = "ser", origin: str = "eligible") -> str:
    """CTEs of a percentile variant's series: benchmark, q, t, v, n."""
    start = "make_date(CAST({0} // 4 AS BIGINT), CAST({0} % 4 * 3 + 1 AS BIGINT), 1)".format
    zero = "min(q) OVER (PARTITION BY benchmark)" if origin == "eligible" else "q0"
    return f"""{name}_cut AS (SELECT benchmark, q, quantile_cont(score, {1.0 - k}) AS cut FROM scores GROUP BY 1, 2),
    {name}_raw AS (SELECT r.benchmark, r.q, min(r.q0) AS q0, min(r.n) AS n, var_samp(score) AS v FROM rk r JOIN {name}_cut c ON r.benchmark = c.benchmark AND r.q = c.q WHERE r.n >= {min_group} AND score >= cut GROUP BY 1, 2 HAVING count(*) >= {min_top}),
    {name} AS (SELECT benchmark, q, n, v, date_diff('day', {start(zero)}, {start('q')}) / {D(30.44)} AS t FROM {name}_raw QUALIFY count(*) OVER (PARTITION BY benchmark) >= {4 if origin == 'eligible' else 1})"""


TOOLKIT = RANKED + f", ser AS (SELECT benchmark, q, min(n) AS n, {D(3)} * (q - min(q0)) AS t, var_pop(score) AS v FROM rk WHERE n >= 10 AND rn <= greatest(1, ceil(n * {D(0.2)})) GROUP BY 1, 2)"


@query(f"WITH {V.SCORES} SELECT benchmark, {LABEL} AS quarter, count(*) AS n_models, {R(9, mean_score='avg(score)', std_score='stddev_samp(score)', min_score='min(score)', max_score='max(score)')} FROM scores GROUP BY benchmark, q")
def quarter_summary(spark, sf):
    return tidy(power.quarter_summary(V.scores(spark, sf)).drop("q"), 9)


@query(f"WITH {TOOLKIT} SELECT benchmark, {LABEL} AS quarter, {R(t_months='t', value='v')}, n FROM ser")
def topk_variance_rows(spark, sf):
    return tidy(power.topk_variance(V.scores(spark, sf), "toolkit").select("benchmark", "quarter", "t_months", "value", "n"))


@query(f"WITH {RANKED}, {pctl_series(0.2, 10)} SELECT benchmark, {LABEL} AS quarter, {R(t_months='t', value='v')}, n FROM ser")
def topk_variance_pctl(spark, sf):
    return tidy(power.topk_variance(V.scores(spark, sf), "boot_v2").select("benchmark", "quarter", "t_months", "value", "n"))


@query(f"WITH {RANKED}, {pctl_series(0.2, 15, origin='observed')} SELECT benchmark, {LABEL} AS quarter, {R(t_months='t', value='v')}, n FROM ser")
def topk_variance_select(spark, sf):
    return tidy(power.topk_variance(V.scores(spark, sf), "select_v1").select("benchmark", "quarter", "t_months", "value", "n"))


@query(f"WITH {RANKED} SELECT benchmark, {LABEL} AS quarter, {R(value='var_samp(score)')} FROM rk WHERE n >= 20 AND rn <= greatest(1, ceil(n * {D(0.2)})) GROUP BY benchmark, q HAVING var_samp(score) IS NOT NULL")
def nlargest_variance(spark, sf):
    return tidy(power.topk_variance(V.scores(spark, sf), "nlargest").select("benchmark", "quarter", "value"))


@query(f"WITH {RANKED}, cut AS (SELECT benchmark, q, quantile_cont(score, 0.8) AS cut FROM scores GROUP BY 1, 2) SELECT benchmark, q, {R(var_all='var_samp(score)', var_top='var_samp(CASE WHEN score >= cut THEN score END)', ratio='var_samp(CASE WHEN score >= cut THEN score END) / var_samp(score)')} FROM rk JOIN cut USING (benchmark, q) WHERE n >= 10 GROUP BY 1, 2")
def stratification_effect(spark, sf):
    return tidy(power.stratification_effect(V.scores(spark, sf)))


@query(f"WITH {V.SCORES} SELECT benchmark, q, {R(9, score_range='quantile_cont(score, 0.9) - quantile_cont(score, 0.1)')} FROM scores GROUP BY 1, 2")
def score_range(spark, sf):
    return tidy(power.score_range(V.scores(spark, sf)), 9)


@query(f"WITH {V.SCORES} SELECT benchmark, q, count(*) AS n, {R(variance='var_samp(score)')} FROM scores GROUP BY 1, 2")
def inter_model_variance(spark, sf):
    return tidy(power.inter_model_variance(V.scores(spark, sf)))


COMPRESSION = RANKED + f", iqr AS (SELECT benchmark, q, max(n) AS n, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS ia, quantile_cont(CASE WHEN rn <= greatest(2, floor(n * {D(0.25)})) THEN score END, 0.75) - quantile_cont(CASE WHEN rn <= greatest(2, floor(n * {D(0.25)})) THEN score END, 0.25) AS it FROM rk GROUP BY 1, 2), comp AS (SELECT benchmark, q, n, CASE WHEN n < 4 THEN NULL WHEN ia < 1e-10 THEN 1 ELSE 1 - it / ia END AS compression FROM iqr)"


@query(f"WITH {COMPRESSION} SELECT benchmark, q, n, {R(compression='compression')} FROM comp")
def ceiling_compression(spark, sf):
    return tidy(power.ceiling_compression(V.scores(spark, sf)))


TAU = """sz AS (SELECT benchmark, q, count(*) AS n FROM scores GROUP BY 1, 2 HAVING count(*) >= 3), st AS (SELECT *, lag(q) OVER (PARTITION BY benchmark ORDER BY q) AS prev FROM sz),
 f1 AS (SELECT benchmark, q, model, score FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, q, model ORDER BY eval_date, score) AS k FROM scores) WHERE k = 1),
 cm AS (SELECT a.benchmark, a.q, a.model, b.score AS x, a.score AS y FROM f1 a JOIN st ON a.benchmark = st.benchmark AND a.q = st.q JOIN f1 b ON b.benchmark = a.benchmark AND b.q = st.prev AND b.model = a.model),
 tau AS (SELECT a.benchmark, a.q, sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))), 0) AS tau FROM cm a JOIN cm b ON a.benchmark = b.benchmark AND a.q = b.q AND a.model < b.model GROUP BY 1, 2),
 cn AS (SELECT benchmark, q, count(*) AS n FROM cm GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query(f"WITH {V.SCORES}, {TAU} SELECT benchmark, q, n, {R(tau='tau')} FROM cn JOIN tau USING (benchmark, q)")
def ranking_stability(spark, sf):
    return tidy(power.ranking_stability(V.scores(spark, sf)))


@query(f"WITH {COMPRESSION}, {TAU}, base AS (SELECT benchmark, q, count(*) AS n_models, avg(score) AS m, var_samp(score) AS v FROM scores GROUP BY 1, 2 HAVING count(*) >= 3), mm AS (SELECT *, min(q) OVER (PARTITION BY benchmark) AS z FROM base) SELECT mm.benchmark, mm.q, n_models, {R(mean_score='m', variance='v', months=f'''date_diff('day', make_date(CAST(z // 4 AS BIGINT), CAST(z % 4 * 3 + 1 AS BIGINT), 1), make_date(CAST(mm.q // 4 AS BIGINT), CAST(mm.q % 4 * 3 + 1 AS BIGINT), 1)) / {D(30.44)}''', compression='compression', kendall_tau='CASE WHEN cn.n >= 3 THEN tau END')} FROM mm JOIN comp ON mm.benchmark = comp.benchmark AND mm.q = comp.q LEFT JOIN tau ON mm.benchmark = tau.benchmark AND mm.q = tau.q LEFT JOIN cn ON mm.benchmark = cn.benchmark AND mm.q = cn.q")
def metrics_over_time(spark, sf):
    return tidy(power.metrics_over_time(V.scores(spark, sf)))


SATURATION = V.SCORES + ", lt AS (SELECT *, max(q) OVER (PARTITION BY benchmark) AS lq FROM scores), ls AS (SELECT benchmark, q, score, row_number() OVER (PARTITION BY benchmark ORDER BY score DESC) AS rn FROM lt WHERE q = lq), sa AS (SELECT benchmark, q, count(*) AS n, max(score) AS top, max(CASE WHEN rn = 5 THEN score END) AS kth, stddev_samp(score) AS sd FROM ls GROUP BY 1, 2), sat AS (SELECT *, CASE WHEN n < 6 THEN NULL WHEN sd < 1e-9 THEN 1 ELSE exp(-pow((top - kth) / sd, 2)) END AS s FROM sa)"


@query(f"WITH {SATURATION} SELECT benchmark, q, n, {R(9, top='top', kth='kth', sd='sd', saturation='s')} FROM sat")
def saturation_latest(spark, sf):
    return tidy(power.saturation_index(V.scores(spark, sf)), 9)


LOGLIN = ", lo AS (SELECT *, greatest(0, 0.9 * min(v) OVER (PARTITION BY benchmark)) AS fl FROM ser), ly AS (SELECT *, ln(greatest(v - fl, 1e-9)) AS y FROM lo), lh AS (SELECT benchmark, count(*) AS n, covar_pop(t, y) / nullif(var_pop(t), 0) AS b FROM ly GROUP BY 1), half AS (SELECT benchmark, n, CASE WHEN b < 0 THEN ln(2) / -b END AS h FROM lh)"


@query(f"WITH {TOOLKIT}{LOGLIN} SELECT benchmark, n, {R(halflife='h')} FROM half")
def loglinear_halflife(spark, sf):
    return tidy(fit.loglinear_halflife(power.topk_variance(V.scores(spark, sf)), ["benchmark"]))


@query(f"WITH {TOOLKIT}{LOGLIN}, {SATURATION[len(V.SCORES) + 2:]} SELECT benchmark, CASE WHEN s IS NULL THEN 'unknown' WHEN s > 0.9 THEN 'SATURATED' WHEN s > 0.5 THEN 'partial' ELSE 'unsaturated' END AS sat_status, CASE WHEN h IS NULL THEN 'not measurable' WHEN h < 6 THEN 'EXHAUSTED' WHEN h < 12 THEN 'fast' WHEN h < 36 THEN 'slow' ELSE 'very slow' END AS hl_status, CASE WHEN h IS NULL THEN 'noisy' WHEN h < 3 THEN 'exhausted' WHEN h < 10 THEN 'decaying' WHEN h < 24 THEN 'slow' ELSE 'stable' END AS label, (s > 0.7) != (h < 12) AS disagree FROM sat JOIN half USING (benchmark)")
def status_labels(spark, sf):
    s = V.scores(spark, sf)
    x = power.saturation_index(s).select("benchmark", "saturation").join(fit.loglinear_halflife(power.topk_variance(s), ["benchmark"]), "benchmark")
    s, h = F.col("saturation"), F.col("halflife")
    return x.select("benchmark", power.saturation_status(s).alias("sat_status"), power.halflife_status(h).alias("hl_status"), power.decay_label(h).alias("label"), power.disagreement(s, h).alias("disagree"))


SOTA = V.HISTORY + f", gap AS (SELECT benchmark, release_date, date_diff('day', min(release_date) OVER (PARTITION BY benchmark), release_date) / {D(30.44)} AS t, 100 - max(score) OVER (PARTITION BY benchmark ORDER BY release_date ROWS UNBOUNDED PRECEDING) AS gap FROM history)"


@query(f"WITH {SOTA} SELECT benchmark, CAST(release_date AS VARCHAR) AS day, {R(months='t', gap='gap')} FROM gap")
def sota_gap(spark, sf):
    g = power.sota_gap(V.history(spark, sf))
    return tidy(g.select("benchmark", F.col("release_date").cast("string").alias("day"), "months", "gap"))


@query(f"WITH {TOOLKIT}, {fit_sql('ser', 'benchmark')} SELECT benchmark, n, {R(rate='rate', amplitude='amp', floor='flr', halflife='h')} FROM best")
def decay_fit_grid(spark, sf):
    return tidy(fit.decay_fit(power.topk_variance(V.scores(spark, sf)), ["benchmark"]).drop("rss"))


@query(f"WITH {SOTA}, s AS (SELECT benchmark, t, gap AS v FROM gap), {fit_sql('s', 'benchmark', fit.GAP)} SELECT benchmark, n, {R(rate='rate', amplitude='amp', floor='flr')} FROM best")
def gap_decay_fit(spark, sf):
    g = power.sota_gap(V.history(spark, sf)).select("benchmark", F.col("months").alias("t_months"), F.col("gap").alias("value"))
    return tidy(fit.decay_fit(g, ["benchmark"], fit.GAP).select("benchmark", "n", "rate", "amplitude", "floor"))


KS = [0.1, 0.15, 0.2, 0.25, 0.3]


@query(f"WITH {RANKED}, " + ", ".join(pctl_series(k, 10, name=f"s{i}") for i, k in enumerate(KS)) + ", every AS (" + " UNION ALL ".join(f"SELECT benchmark, {D(k)} AS k, q, v FROM s{i}" for i, k in enumerate(KS)) + f") SELECT benchmark, {R(k='k', mean_value='avg(v)', low='min(v)', high='max(v)')}, count(*) AS n_quarters FROM every GROUP BY benchmark, k")
def topk_sweep(spark, sf):
    s = power.topk_sweep(V.scores(spark, sf), KS, "boot_v2")
    return tidy(s.groupBy("benchmark", "k").agg(F.avg("value").alias("mean_value"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n_quarters")))


PANELSQL = "{grid}, tr AS (SELECT {by}, covar_pop(t, v) / nullif(var_pop(t), 0) AS slope FROM {src} GROUP BY ALL), lo AS (SELECT *, greatest(0, 0.9 * min(v) OVER (PARTITION BY {by})) AS fl FROM {src}), ly AS (SELECT *, ln(greatest(v - fl, 1e-9)) AS y FROM lo), lh AS (SELECT {by}, covar_pop(t, y) / nullif(var_pop(t), 0) AS b FROM ly GROUP BY ALL), ph AS (SELECT {by}, coalesce(CASE WHEN slope < 0 AND best.h < 200 THEN best.h END, CASE WHEN b < 0 AND ln(2) / -b < 200 THEN ln(2) / -b END) AS h FROM lh LEFT JOIN best USING ({by}) LEFT JOIN tr USING ({by}))"


def panel_sql(src: str, by: str) -> str:
    return PANELSQL.format(grid=fit_sql(src, by, fit.PANEL), by=by, src=src)


@query(f"WITH {TOOLKIT}, {panel_sql('ser', 'benchmark')} SELECT benchmark, {R(halflife='h')} FROM ph")
def panel_halflife(spark, sf):
    return tidy(fit.panel_halflife(power.topk_variance(V.scores(spark, sf)), ["benchmark"]))


@query(f"WITH {TOOLKIT}, lq AS (SELECT a.benchmark, b.q AS dropped, a.t, a.v FROM ser a JOIN ser b ON a.benchmark = b.benchmark AND a.q <> b.q), {panel_sql('lq', 'benchmark, dropped')} SELECT benchmark, count(h) AS n_fits, {R(low='min(h)', high='max(h)', median='quantile_cont(h, 0.5)')} FROM ph WHERE h IS NOT NULL GROUP BY benchmark")
def loqo_sweep(spark, sf):
    return tidy(fit.loqo(power.topk_variance(V.scores(spark, sf)), ["benchmark"]))


@query(f"WITH {TOOLKIT}, sp AS (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY t) <= floor(count(*) OVER (PARTITION BY benchmark) * {D(0.7)}) AS train FROM ser), tn AS (SELECT * FROM sp WHERE train), {fit_sql('tn', 'benchmark', fit.FORECAST)} SELECT sp.benchmark, count(*) AS n_test, {R(mape='avg(abs(amp * exp(-rate * sp.t) + flr - sp.v) / greatest(sp.v, 1e-6))', mae='avg(abs(amp * exp(-rate * sp.t) + flr - sp.v))')} FROM sp JOIN best ON sp.benchmark = best.benchmark WHERE NOT train GROUP BY 1")
def forecast_split(spark, sf):
    return tidy(fit.forecast(power.topk_variance(V.scores(spark, sf)), ["benchmark"]))


@query(f"WITH {TOOLKIT}, nc AS (SELECT benchmark, min_by(v, t) AS f, max_by(v, t) AS l FROM ser GROUP BY 1) SELECT benchmark, {R(first='f', last='l', change='(l - f) / f')}, l < f AS decaying FROM nc")
def net_change(spark, sf):
    return tidy(fit.net_change(power.topk_variance(V.scores(spark, sf)), ["benchmark"]))


# ---- original against perturbed


@query(f"WITH {V.RESPONSES} SELECT benchmark, model, version, {R(acc='avg(correct)')}, count(correct) AS n FROM responses GROUP BY 1, 2, 3")
def accuracy_by_version(spark, sf):
    return tidy(C.accuracy(V.responses(spark, sf)))


@query(f"WITH {V.GAPS} SELECT benchmark, model, {R(orig='orig', pert='pert', gap='gap')} FROM gaps")
def gap_by_model(spark, sf):
    return tidy(C.gaps(V.responses(spark, sf)).select("benchmark", "model", "orig", "pert", "gap"))


@query(f"WITH {V.WIDE} SELECT benchmark, model, {R(gap='avg(d)')}, count(*) AS n FROM paired GROUP BY 1, 2 HAVING count(*) >= 30")
def gap_paired(spark, sf):
    return tidy(C.paired_gaps(V.responses(spark, sf)))


@query(f"WITH {V.GAPS}, {V.DIM} SELECT vendor, {R(mean_gap='avg(gap)')}, count(*) AS n FROM gaps JOIN dim USING (model) GROUP BY 1")
def vendor_gap(spark, sf):
    return tidy(C.vendor_gaps(C.gaps(V.responses(spark, sf)), V.model_dim(spark)))


PGAPS = V.PANEL + ", pg AS (SELECT *, orig - pert AS gap FROM (SELECT benchmark, model, avg(CASE WHEN version = 'orig' THEN correct END) AS orig, avg(CASE WHEN version = 'pert' THEN correct END) AS pert FROM panel GROUP BY 1, 2) WHERE orig IS NOT NULL AND pert IS NOT NULL)"


@query(f"WITH {PGAPS}, x AS (SELECT benchmark, var_samp(orig) AS vo, var_samp(pert) AS vp, max(orig) AS best FROM pg GROUP BY 1), y AS (SELECT *, greatest(0, vp - vo) AS k, CASE WHEN best >= 0.95 THEN {D(0.3)} * vo ELSE 0 END AS f FROM x) SELECT benchmark, {R(var_orig='vo', var_pert='vp', best='best', k='k', f='f', g='greatest(0, vp - k - f)')} FROM y")
def decomposition_gkf(spark, sf):
    return tidy(C.decomposition(C.gaps(V.panel(spark, sf))))


@query(f"WITH {PGAPS} SELECT benchmark, count(*) AS n_models, {R(mean_gap='avg(gap)', max_abs_gap='max(abs(gap))', ceiling_frac='avg(CASE WHEN orig >= 0.95 THEN 1 ELSE 0 END)', k='greatest(0, coalesce(var_samp(pert), 0) - coalesce(var_samp(orig), 0))')} FROM pg GROUP BY 1")
def decomposition_v2(spark, sf):
    return tidy(C.decomposition_by_model(C.gaps(V.panel(spark, sf))))


@query(f"WITH {V.WIDE}, g AS (SELECT benchmark, item, avg(d) AS m FROM paired GROUP BY 1, 2) SELECT benchmark, item, {R(mean_gap='m')}, CAST(row_number() OVER (PARTITION BY benchmark ORDER BY m DESC, item) AS INTEGER) AS rank, row_number() OVER (PARTITION BY benchmark ORDER BY m DESC, item) <= greatest(1, round_even(count(*) OVER (PARTITION BY benchmark) * {D(0.12)}, 0)) AS top FROM g")
def item_gap_rank(spark, sf):
    return tidy(C.item_gaps(V.responses(spark, sf)))


@query(f"WITH {V.WIDE} SELECT benchmark, item, count(*) AS n_models FROM paired GROUP BY 1, 2 HAVING min(d) = 1")
def universal_items(spark, sf):
    return C.universal_items(V.responses(spark, sf))


FOUR = "('m0', 'm1', 'm2', 'm3')"
DRIFT = V.WIDE + f", {V.DIM}, w4 AS (SELECT w.*, lag(o) OVER (PARTITION BY benchmark, item ORDER BY ord) AS prev FROM wide w JOIN dim USING (model) WHERE model IN {FOUR}), dc AS (SELECT benchmark, item, count(*) FILTER (WHERE o IS NOT NULL AND p IS NOT NULL) AS k, sum(o) AS so, sum(p) AS sp, count(*) FILTER (WHERE o = 1 AND p = 0) AS lost, count(*) FILTER (WHERE o = 0 AND p = 1) AS won, count(*) FILTER (WHERE o < prev) AS falls FROM w4 GROUP BY 1, 2), cl AS (SELECT benchmark, item, CASE WHEN k < 4 THEN 'incomplete' WHEN so = 4 AND sp = 4 THEN 'all_correct' WHEN so = 0 AND sp = 0 THEN 'all_wrong' WHEN lost >= 2 AND won = 0 THEN 'contamination_signature' WHEN falls = 0 AND so > 0 AND so < 4 THEN 'difficulty_drift' WHEN so BETWEEN 1 AND 3 THEN 'discriminating' ELSE 'noisy' END AS class FROM dc)"


@query(f"WITH {DRIFT} SELECT benchmark, item, class FROM cl")
def item_drift(spark, sf):
    return C.item_drift(V.responses(spark, sf), V.model_dim(spark).where("ord < 4"))


@query(f"WITH {DRIFT} SELECT benchmark, class, count(*) AS n, {R(share='count(*) / sum(count(*)) OVER (PARTITION BY benchmark)')} FROM cl GROUP BY 1, 2")
def drift_shares(spark, sf):
    return tidy(power.value_shares(C.item_drift(V.responses(spark, sf), V.model_dim(spark).where("ord < 4")), ["benchmark"], "class"))


SLOPES = V.WIDE + f", {V.DIM}, sl AS (SELECT benchmark, item, count(*) AS n, covar_pop(t_year, d) / nullif(var_pop(t_year), 0) AS slope FROM paired JOIN dim USING (model) GROUP BY 1, 2 HAVING count(*) >= 3)"


@query(f"WITH {SLOPES} SELECT benchmark, item, n, {R(slope='slope')} FROM sl")
def temporal_slope(spark, sf):
    return tidy(C.temporal_slopes(V.responses(spark, sf), V.model_dim(spark)))


@query(f"WITH {SLOPES} SELECT benchmark, {R(mean_slope='avg(slope)', median_slope='quantile_cont(slope, 0.5)', positive='avg(CASE WHEN slope > 1e-9 THEN 1 ELSE 0 END)', steep='avg(CASE WHEN slope > 0.5 THEN 1 ELSE 0 END)')}, count(*) AS n_items FROM sl WHERE slope IS NOT NULL GROUP BY 1")
def temporal_summary(spark, sf):
    return tidy(C.temporal_summary(C.temporal_slopes(V.responses(spark, sf), V.model_dim(spark))))


PUBLISHED = [(f"b{i}", f"202{i // 2 + 1}-0{i + 2}") for i in range(5)]


@query(f"WITH {PGAPS}, {V.DIM}, pu AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', '{m}')" for b, m in PUBLISHED) + f") AS x(benchmark, published)), ts AS (SELECT gap, date_diff('day', CAST(published || '-01' AS DATE), CAST(cutoff || '-01' AS DATE)) / {D(30.44)} AS months FROM pg JOIN dim USING (model) JOIN pu USING (benchmark)) SELECT count(*) AS n, {R(r='covar_pop(months, gap) / nullif(stddev_pop(months) * stddev_pop(gap), 0)')} FROM ts")
def time_shifted(spark, sf):
    x = C.time_shifted(C.gaps(V.panel(spark, sf)), V.model_dim(spark), spark.createDataFrame(PUBLISHED, "benchmark string, published string"))
    return tidy(stats.pearson(x, [], "months", "gap"))


FID = V.WIDE + ", it AS (SELECT benchmark, item, avg(o) AS o, avg(p) AS p FROM paired GROUP BY 1, 2), rf AS (SELECT *, rank() OVER (PARTITION BY benchmark ORDER BY o) + (count(*) OVER (PARTITION BY benchmark, o) - 1) / 2 AS ro, rank() OVER (PARTITION BY benchmark ORDER BY p) + (count(*) OVER (PARTITION BY benchmark, p) - 1) / 2 AS rp, -ln(greatest(least(o, 0.999), 0.001) / (1 - greatest(least(o, 0.999), 0.001))) AS lo, -ln(greatest(least(p, 0.999), 0.001) / (1 - greatest(least(p, 0.999), 0.001))) AS lp FROM it)"
CORR = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)".format


@query(f"WITH {FID} SELECT benchmark, count(*) AS n_items, {R(pearson=CORR('o', 'p'), spearman=CORR('ro', 'rp'), logit_r=CORR('lo', 'lp'), mean_shift='avg(p) - avg(o)', exact='avg(CASE WHEN abs(o - p) < 0.001 THEN 1 ELSE 0 END)', close='avg(CASE WHEN abs(o - p) < 0.25 THEN 1 ELSE 0 END)')} FROM rf GROUP BY 1")
def fidelity(spark, sf):
    return tidy(C.fidelity(V.responses(spark, sf)))


@query(f"WITH {V.WIDE} SELECT benchmark, item, count(*) AS n, {R(r='coalesce(' + CORR('o', 'p') + ', CASE WHEN sum(abs(d)) = 0 THEN 1 ELSE 0 END)', gap='avg(d)')} FROM paired GROUP BY 1, 2")
def per_item_fidelity(spark, sf):
    return tidy(C.per_item_fidelity(V.responses(spark, sf)))


GROUPED = V.WIDE + f", {V.ITEMS}, ig AS (SELECT benchmark, item, avg(d) AS gap FROM paired GROUP BY 1, 2)"


@query(f"WITH {GROUPED} SELECT benchmark, subject, {R(mean_gap='avg(gap)', std_gap='stddev_pop(gap)')}, count(*) AS n_items FROM ig JOIN items USING (item) GROUP BY 1, 2")
def subject_gap(spark, sf):
    return tidy(C.grouped_gaps(V.responses(spark, sf), V.item_dim(spark, sf), "subject", True))


@query(f"WITH {GROUPED} SELECT benchmark, CASE WHEN brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'Humanities' WHEN brand IN ('Brand#21', 'Brand#22', 'Brand#23') THEN 'STEM' ELSE 'Other' END AS cluster, {R(mean_gap='avg(gap)', std_gap='stddev_samp(gap)')}, count(*) AS n_items FROM ig JOIN items USING (item) GROUP BY 1, 2")
def cluster_gap(spark, sf):
    clusters = {"Humanities": ["Brand#11", "Brand#12", "Brand#13"], "STEM": ["Brand#21", "Brand#22", "Brand#23"]}
    dim = V.item_dim(spark, sf).select("item", C.cluster_of(F.col("brand"), clusters).alias("cluster"))
    return tidy(C.grouped_gaps(V.responses(spark, sf), dim, "cluster", False))


@query(f"WITH {V.WIDE}, nm AS (SELECT benchmark, count(DISTINCT model) AS m FROM responses GROUP BY 1) SELECT p.benchmark, item FROM paired p JOIN nm ON p.benchmark = nm.benchmark GROUP BY 1, 2 HAVING count(*) = max(m)")
def complete_items(spark, sf):
    return C.complete_items(V.responses(spark, sf))


SUBSET = V.WIDE + ", nm AS (SELECT benchmark, count(DISTINCT model) AS m FROM responses GROUP BY 1), full_items AS (SELECT p.benchmark, item FROM paired p JOIN nm ON p.benchmark = nm.benchmark GROUP BY 1, 2 HAVING count(*) = max(m)), sub AS (SELECT r.* FROM responses r JOIN full_items f ON r.benchmark = f.benchmark AND r.item = f.item)"


@query(f"WITH {SUBSET} SELECT benchmark, model, {R(gap='''avg(CASE WHEN version = 'orig' THEN correct END) - avg(CASE WHEN version = 'pert' THEN correct END)''')} FROM sub GROUP BY 1, 2")
def subset_gap(spark, sf):
    r = V.responses(spark, sf)
    return tidy(C.gaps(C.on_items(r, C.complete_items(r))).select("benchmark", "model", "gap"))


@query(f"WITH {V.RESPONSES}, a AS (SELECT benchmark, version, avg(correct) AS acc, model FROM responses GROUP BY 1, 2, 4), s AS (SELECT benchmark, version, acc - lag(acc) OVER (PARTITION BY benchmark, version ORDER BY acc) AS step FROM a) SELECT benchmark, version, {R(median_step='quantile_cont(step, 0.5)', mean_step='avg(step)')} FROM s WHERE step IS NOT NULL GROUP BY 1, 2")
def rank_step(spark, sf):
    return tidy(C.rank_steps(C.accuracy(V.responses(spark, sf))))


@query(f"WITH {PGAPS}, a AS (SELECT model, gap FROM pg WHERE benchmark = 'b0'), b AS (SELECT model, gap FROM pg WHERE benchmark = 'b1') SELECT count(*) AS n, {R(mean_residual='avg(b.gap - a.gap)', std_residual='stddev_samp(b.gap - a.gap)')} FROM a JOIN b USING (model)")
def cross_set_residual(spark, sf):
    g = C.gaps(V.panel(spark, sf))
    return tidy(C.cross_set_residual(g.where("benchmark = 'b0'"), g.where("benchmark = 'b1'")))


@query(f"WITH {V.RESPONSES}, old AS (SELECT benchmark, model, item, version, CASE WHEN item % 10 = 0 THEN NULL ELSE correct END AS correct FROM responses) SELECT o.benchmark, o.model, count(coalesce(o.correct, n.correct)) AS answered, CAST(sum(coalesce(o.correct, n.correct)) AS BIGINT) AS right_answers FROM old o LEFT JOIN responses n USING (benchmark, model, item, version) GROUP BY 1, 2")
def retry_merge(spark, sf):
    r = V.responses(spark, sf)
    m = C.retry_merge(r.withColumn("correct", F.when(F.col("item") % 10 != 0, F.col("correct"))), r)
    return m.groupBy("benchmark", "model").agg(F.count("correct").alias("answered"), F.sum("correct").alias("right_answers"))


@query(f"WITH {V.RESPONSES}, wanted AS (SELECT DISTINCT 'm' || CAST(s_suppkey % 9 AS VARCHAR) AS model FROM supplier) SELECT 'lines' AS benchmark, model FROM wanted WHERE model NOT IN (SELECT model FROM responses GROUP BY model HAVING count(correct) > 50)")
def resume_antijoin(spark, sf):
    wanted = V.table(spark, sf, "supplier").select(F.lit("lines").alias("benchmark"), F.concat(F.lit("m"), (F.col("s_suppkey") % 9).cast("string")).alias("model")).distinct()
    return C.unfinished(wanted, V.responses(spark, sf))


@query(f"WITH {PGAPS}, m AS (SELECT model, item, version, correct FROM panel WHERE benchmark = 'b0'), e AS (SELECT model, item, version, correct FROM panel WHERE benchmark = 'b1'), u AS (SELECT * FROM m UNION ALL SELECT model, item + (SELECT max(item) + 1 FROM m), version, correct FROM e WHERE model IN (SELECT model FROM m)) SELECT model, count(*) AS n, max(item) AS last_item, {R(acc='avg(correct)')} FROM u GROUP BY 1")
def append_items(spark, sf):
    p = V.panel(spark, sf)
    u = C.append_items(p.where("benchmark = 'b0'"), p.where("benchmark = 'b1'").withColumn("benchmark", F.lit("b0")))
    return tidy(u.groupBy("model").agg(F.count("*").alias("n"), F.max("item").alias("last_item"), F.avg("correct").alias("acc")))


@query("WITH s AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 1 ELSE 2 END AS rk, o_custkey AS c, o_totalprice AS score, o_orderdate AS d FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY rk, d, score) AS n FROM s) SELECT 'm' || CAST(c AS VARCHAR) AS model, CAST(rk AS INTEGER) AS source_rank, score FROM r WHERE n = 1")
def dedup_sources(spark, sf):
    from wanescope.sources.files import merge_sources

    o = V.table(spark, sf, "orders").select(F.lit("all").alias("benchmark"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("model"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("eval_date"), "o_orderpriority")
    first, second = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM")
    parts = {n: o.where(c).drop("o_orderpriority") for n, c in (("scores", first), ("pwc", second), ("epoch", ~(first | second)))}
    return merge_sources(parts).select("model", "source_rank", "score")
