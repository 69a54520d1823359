"""Queries over text functions, statistics, resampling, item response models, generators and triage; see `catalog`."""

from __future__ import annotations

from pyspark.sql import functions as F

from wanescope.functions import text as X
from wanescope.operators import contamination as C
from wanescope.operators import fit, irt, power, resample, stats, synth, triage
from wanescope.plans import views as V
from wanescope.plans.catalog import CORR, FID, KS, ORACLES, PGAPS, QUERIES, RANKED, TOOLKIT, D, R, panel_sql, pctl_series, query
from wanescope.plans.views import tidy

# ---- text


def docs(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "text")


@query("SELECT doc_id, trim(regexp_replace(text, '^\\s*[A-Da-d][).:]\\s*', '')) AS cleaned, nullif(regexp_extract(upper(trim(text)), '[ABCD]', 0), '') AS letter, CASE WHEN text IS NULL THEN NULL WHEN nullif(regexp_extract(upper(trim(text)), '[ABCD]', 0), '') IS NOT DISTINCT FROM chr(CAST(65 + doc_id % 4 AS INTEGER)) THEN 1 ELSE 0 END AS grade, CAST(nullif(regexp_extract(text, '[0-9]', 0), '') AS INTEGER) AS digit FROM (SELECT doc_id, 'b) ' || text AS text FROM documents)")
def grade_mc(spark, sf):
    d = docs(spark, sf).select("doc_id", F.concat(F.lit("b) "), F.col("text")).alias("text"))
    t = F.col("text")
    return d.select("doc_id", X.clean_choice(t).alias("cleaned"), X.first_letter(t).alias("letter"), X.grade_mc(t, X.index_letter(F.col("doc_id") % 4)).alias("grade"), X.first_digit(t).alias("digit"))


NUM = "regexp_extract_all({0}, '(-?[0-9]+\\.?[0-9]*)', 1)".format


@query(f"WITH {V.ANSWERS}, f AS (SELECT *, coalesce(nullif(replace(regexp_extract(answer, '####\\s*([-0-9,.]+)', 1), ',', ''), ''), {NUM('answer')}[-1]) AS final FROM answers) SELECT l_orderkey, l_linenumber, final, CAST(coalesce(CASE WHEN abs(try_cast(final AS DOUBLE) - (q + n)) < 0.0001 THEN 1 ELSE 0 END, 0) AS INTEGER) AS grade, CAST(len(regexp_extract_all(answer, '(<<[^>]*>>)', 1)) AS INTEGER) AS n_ops, CAST(try_cast(final AS DOUBLE) AS BIGINT) AS final_int, CAST(len({NUM('answer')}) AS INTEGER) AS n_numbers FROM f")
def final_answer(spark, sf):
    a = F.col("answer")
    d = V.answers(spark, sf).withColumn("final", X.final_answer(a))
    return d.select("l_orderkey", "l_linenumber", "final", X.grade_numeric(F.col("final"), (F.col("q") + F.col("n")).cast("string")).alias("grade"), X.op_count(a).alias("n_ops"), X.final_integer(a).alias("final_int"), F.size(X.all_numbers(a)).alias("n_numbers"))


DS = "CAST(list_sum(list_transform(regexp_extract_all(CAST({0} AS VARCHAR), '[0-9]'), lambda x: CAST(x AS INTEGER))) AS INTEGER)".format


@query(f"WITH {V.ANSWERS} SELECT l_orderkey, l_linenumber, CAST(({DS('q')} + {DS('n')} - {DS('q + n')}) / 9 AS INTEGER) AS carries, CAST(length(CAST(n AS VARCHAR)) AS INTEGER) AS digits, CAST(2 AS INTEGER) AS n_ops, CAST(greatest(length(CAST(q AS VARCHAR)), length(CAST(n AS VARCHAR))) AS INTEGER) AS max_operand_digits, CAST(2 * length(CAST(q AS VARCHAR)) + length(CAST(n AS VARCHAR)) + 1 AS INTEGER) AS sum_operand_digits FROM answers")
def arithmetic_features(spark, sf):
    f = X.arithmetic_features(F.col("answer"))
    return V.answers(spark, sf).select("l_orderkey", "l_linenumber", f["carries"].alias("carries"), X.digit_count(F.col("n").cast("double")).alias("digits"), f["n_ops"].alias("n_ops"), f["max_operand_digits"].alias("max_operand_digits"), f["sum_operand_digits"].alias("sum_operand_digits"))


@query("SELECT event_id, regexp_extract('see ' || props || ' ok', '(?s)(\\{.*\\})', 1) AS object, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.concat(F.lit("see "), F.col("props"), F.lit(" ok")).alias("said"))
    return e.withColumn("object", X.json_object(F.col("said"))).select("event_id", "object", F.get_json_object("object", "$.k").cast("bigint").alias("k"))


@query("SELECT p_partkey, 'def ' || replace(p_brand, '#', '_') || '(x):' || chr(10) || '    return x' AS code, replace(p_brand, '#', '_') AS name, 'assert g(' || CAST(p_size AS VARCHAR) || ')' AS test FROM part")
def code_cleanup(spark, sf):
    p = V.table(spark, sf, "part").withColumn("raw", F.concat(F.lit("```python\ndef "), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("(x):\n    return x\n```\n")))
    p = p.withColumn("code", X.strip_fences(F.col("raw"))).withColumn("name", X.function_name(F.col("raw")))
    return p.select("p_partkey", "code", "name", X.rename(F.concat(F.lit("assert "), F.col("name"), F.lit("("), F.col("p_size").cast("string"), F.lit(")")), F.col("name"), F.lit("g")).alias("test"))


@query("SELECT p_partkey, p_name || chr(10) || 'A) ' || p_type || chr(10) || 'B) ' || p_brand || chr(10) || 'Answer with one letter.' AS prompt, p_brand || '|' || p_type AS reordered, CAST(1 AS INTEGER) AS gold FROM part")
def prompt_build(spark, sf):
    choices = F.array("p_type", "p_brand")
    return V.table(spark, sf, "part").select("p_partkey", X.mc_prompt(F.col("p_name"), choices).alias("prompt"), F.array_join(X.gold_first(choices, F.lit(1)), "|").alias("reordered"), X.gold_index(choices, F.col("p_brand")).cast("int").alias("gold"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || '/2' AS norm, p_partkey % 2 = 0 AS same, p_partkey % 3 = 0 AS same_grouped, CASE WHEN p_size >= 8 THEN 'dark' WHEN p_size >= 3 THEN 'medium' WHEN p_size >= 0 THEN 'light' ELSE 'negative' END AS shade, replace(replace(p_brand, 'Brand', 'B'), '#', '') AS short FROM part")
def answer_match(spark, sf):
    size = F.col("p_size").cast("string")
    frac, half = F.concat(F.lit("$ \\Frac{"), size, F.lit("}{2} $")), ((F.col("p_size") + F.col("p_partkey") % 2) / 2).cast("string")
    thousands, number = F.format_number(F.col("p_size") * 1000, 0), (F.col("p_size") * 1000 + F.col("p_partkey") % 3).cast("string")
    same = [X.answers_match(frac, half).alias("same"), X.answers_match(thousands, number).alias("same_grouped")]
    return V.table(spark, sf, "part").select("p_partkey", X.normalize_answer(frac).alias("norm"), *same, X.shade(F.col("p_size")).alias("shade"), X.short_name(F.col("p_brand"), {"Brand": "B", "#": ""}).alias("short"))


@query(f"WITH {V.ANSWERS}, w AS (SELECT *, l_linenumber AS n_right, CASE WHEN q % 3 = 0 THEN q + n ELSE q + n + 1 END AS other FROM answers) SELECT CASE WHEN NOT (q + n > 0) THEN 'final_type' WHEN other = q + n THEN 'same_final' WHEN n_right < 3 THEN 'few_correct' ELSE 'kept' END AS reason, count(*) AS n FROM w GROUP BY 1")
def verified_subset(spark, sf):
    a = V.answers(spark, sf).withColumn("other", F.when(F.col("q") % 3 == 0, F.col("q") + F.col("n")).otherwise(F.col("q") + F.col("n") + 1))
    pert = F.concat(F.lit("x <<1+1=2>> <<2+2=4>> #### "), F.col("other").cast("string"))
    reason = X.subset_reason(F.col("answer"), pert, F.col("answer"), pert, F.col("l_linenumber"), 3)
    return a.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


# ---- statistics


@query(f"WITH {FID} SELECT benchmark, count(*) AS n, {R(rho=CORR('ro', 'rp'))} FROM rf GROUP BY 1")
def spearman(spark, sf):
    items = C.paired_items(V.responses(spark, sf)).groupBy("benchmark", "item").agg(F.avg("o").alias("o"), F.avg("p").alias("p"))
    return tidy(stats.spearman(items, ["benchmark"], "o", "p"))


@query(f"WITH {PGAPS}, k AS (SELECT a.benchmark, sum(sign(a.orig - b.orig) * sign(a.pert - b.pert)) / nullif(sqrt(sum(abs(sign(a.orig - b.orig))) * sum(abs(sign(a.pert - b.pert)))), 0) AS tau FROM pg a JOIN pg b ON a.benchmark = b.benchmark AND a.model < b.model GROUP BY 1) SELECT benchmark, (SELECT count(*) FROM pg p WHERE p.benchmark = k.benchmark) AS n, {R(tau='tau')} FROM k")
def kendall_tau(spark, sf):
    return tidy(stats.kendall(C.gaps(V.panel(spark, sf)), ["benchmark"], "orig", "pert", "model"))


def kendall_tau_grouped(spark, sf):
    return tidy(stats.kendall_grouped(C.gaps(V.panel(spark, sf)), ["benchmark"], "orig", "pert"))


QUERIES["kendall_tau_grouped"], ORACLES["kendall_tau_grouped"] = kendall_tau_grouped, ORACLES["kendall_tau"]


@query(f"WITH {TOOLKIT}, n AS (SELECT benchmark, count(*) AS n FROM ser GROUP BY 1), s AS (SELECT a.benchmark, CAST(sum(sign(b.v - a.v)) AS BIGINT) AS s FROM ser a JOIN ser b ON a.benchmark = b.benchmark AND a.q < b.q GROUP BY 1) SELECT benchmark, n, s, {R(tau='s / (n * (n - 1) / 2)')} FROM n JOIN s USING (benchmark)")
def mann_kendall(spark, sf):
    return tidy(stats.mann_kendall(power.topk_variance(V.scores(spark, sf)), ["benchmark"], "q", "value"))


@query(f"WITH c AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS po, avg(quality) AS a, avg(toxic) AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), e AS (SELECT *, a * b + (1 - a) * (1 - b) AS pe FROM c) SELECT n, {R(observed='po', expected='pe', kappa='CASE WHEN pe < 1 - 1e-12 THEN (po - pe) / (1 - pe) END')} FROM e")
def cohen_kappa(spark, sf):
    return tidy(stats.cohen_kappa(V.table(spark, sf, "labels"), "quality", "toxic"))


@query(f"WITH r AS (SELECT doc_id AS unit, quality AS label FROM labels UNION ALL SELECT doc_id, toxic FROM labels), c AS (SELECT unit, label, count(*) AS k FROM r WHERE label IS NOT NULL GROUP BY 1, 2), u AS (SELECT unit, sum(k) AS m, sum(k * k) AS kk FROM c GROUP BY 1 HAVING sum(k) > 1), o AS (SELECT CAST(sum(m) AS BIGINT) AS n, sum(CAST(m * m - kk AS DOUBLE) / (m - 1)) AS off FROM u), t AS (SELECT sum(k) AS t FROM c WHERE unit IN (SELECT unit FROM u) GROUP BY label), a AS (SELECT CAST(sum(t) AS DOUBLE) AS s, CAST(sum(t * t) AS DOUBLE) AS tt FROM t) SELECT n, {R(alpha='1 - off / nullif((s * s - tt) / (s - 1), 0)')} FROM o, a")
def krippendorff(spark, sf):
    marks = F.explode(F.array("quality", "toxic")).alias("label")
    return tidy(stats.krippendorff_alpha(V.table(spark, sf, "labels").select(F.col("doc_id").alias("unit"), marks)))


ICC = V.WIDE + ", nm AS (SELECT count(DISTINCT model) AS m FROM responses), fi AS (SELECT item FROM paired GROUP BY 1 HAVING count(*) = (SELECT m FROM nm)), x AS (SELECT item, model, CAST(o AS DOUBLE) AS v FROM paired WHERE item IN (SELECT item FROM fi)), sz AS (SELECT CAST(count(DISTINCT item) AS DOUBLE) AS n, CAST(count(DISTINCT model) AS DOUBLE) AS k, var_pop(v) * count(*) AS sst FROM x), r AS (SELECT var_pop(m) AS vr FROM (SELECT avg(v) AS m FROM x GROUP BY item)), c AS (SELECT var_pop(m) AS vc FROM (SELECT avg(v) AS m FROM x GROUP BY model)), ms AS (SELECT n, k, n * k * vr / (n - 1) AS bms, n * k * vc / (k - 1) AS jms, {rest} / ((n - 1) * (k - 1)) AS ems FROM sz, r, c) SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, {icc} FROM ms"
ICC_VALUE = R(icc="(bms - ems) / nullif(bms + (k - 1) * ems + k * (jms - ems) / n, 0)")


def _icc(spark, sf, mode):
    r = V.responses(spark, sf)
    x = C.paired_items(C.on_items(r, C.complete_items(r))).withColumn("v", F.col("o").cast("double"))
    return tidy(stats.icc21(x, [], "item", "model", "v", mode))


@query("WITH " + ICC.format(rest="(sst - n * k * vr - n * k * vc)", icc=ICC_VALUE))
def icc21(spark, sf):
    return _icc(spark, sf, "textbook")


@query("WITH " + ICC.format(rest="(sst - n * k * vr / k - n * k * vc / n)", icc=ICC_VALUE))
def icc21_legacy(spark, sf):
    return _icc(spark, sf, "legacy")


@query(f"WITH {V.PARAMS}, f AS (SELECT item, min_by(a, t) AS a0, max_by(a, t) AS a1, min_by(b, t) AS b0, max_by(b, t) AS b1 FROM params GROUP BY 1), x AS (SELECT item, pow((a1 - a0) / {D(0.2)}, 2) / 2 + pow((b1 - b0) / {D(0.3)}, 2) / 2 AS c FROM f) SELECT item, {R(chi2='c', p='exp(-c / 2)')} FROM x")
def lord_chi2(spark, sf):
    e = V.item_params(spark, sf).groupBy("item").agg(*[f(c, "t").alias(n) for f, c, n in ((F.min_by, "a", "a0"), (F.max_by, "a", "a1"), (F.min_by, "b", "b0"), (F.max_by, "b", "b1"))])
    x, p = stats.lord_chi2(*map(F.col, ("a0", "a1", "b0", "b1")))
    return tidy(e.select("item", x.alias("chi2"), p.alias("p")))


@query(f"WITH {V.PARAMS} SELECT item, count(*) AS n, {R(slope='covar_pop(t, b) / nullif(var_pop(t), 0)', r2='pow(covar_pop(t, b), 2) / nullif(var_pop(t) * var_pop(b), 0)', stderr='sqrt(greatest(0, (1 - pow(covar_pop(t, b), 2) / nullif(var_pop(t) * var_pop(b), 0)) * var_pop(b)) / nullif(var_pop(t), 0) / (count(*) - 2))')} FROM params GROUP BY 1")
def linear_regression(spark, sf):
    return tidy(stats.linear_regression(V.item_params(spark, sf), ["item"], "t", "b").drop("intercept"))


@query(f"WITH {V.PARAMS}, f AS (SELECT item, exp(-abs(covar_pop(t, b) / nullif(var_pop(t), 0)) * 100) AS p FROM params GROUP BY 1), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS k FROM f) SELECT item, {R(q='least(1, min(p * m / k) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} FROM r")
def false_discovery(spark, sf):
    f = V.item_params(spark, sf).groupBy("benchmark", "item").agg(F.exp(-F.abs(stats.safe_slope(F.col("b"), F.col("t"))) * 100).alias("p"))
    return tidy(stats.benjamini_hochberg(f, "p", ["benchmark"]).select("item", "q"))


def irt_trend_drift(spark, sf):
    """Trend tests of a and b with their classes and the p-value of b."""
    p = V.item_params(spark, sf)
    a, b = stats.detect_drift(p, value="a"), stats.detect_drift(p, value="b")
    both = a.select("benchmark", "item", F.col("slope").alias("a_slope"), F.col("significant").alias("a_sig")).join(b.select("benchmark", "item", F.col("slope").alias("b_slope"), F.col("significant").alias("b_sig"), "p"), ["benchmark", "item"])
    return tidy(both.select("item", stats.drift_class(F.lit(0.5), F.col("a_sig"), F.col("a_slope"), F.col("b_sig"), F.col("b_slope")).alias("class"), "a_slope", "b_slope", "p"))


QUERIES["irt_trend_drift"] = irt_trend_drift


@query(f"SELECT {R(slope='covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity)', intercept='avg(l_extendedprice) - covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity) * avg(l_quantity)', r2='pow(covar_pop(l_quantity, l_extendedprice), 2) / (var_pop(l_quantity) * var_pop(l_extendedprice))')} FROM lineitem".replace(", 6)", ", 2)"))
def partial_ols(spark, sf):
    beta, r2 = stats.ols_frame(V.table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return tidy(spark.createDataFrame([(float(beta[1]), float(beta[0]), float(r2))], "slope double, intercept double, r2 double"), 2)


# ---- resampling

HASH = "((({0} * 1000003 + {1} * 7919 + 42) % 2147483647 * (({0} * 1000003 + {1} * 7919 + 42) % 2147483647) + {1}) % 2147483647 * 48271 + {0}) % 2147483647"


def pick_sql(rep: str, k: str) -> str:
    h = HASH.format(rep, k)
    return f"((({h}) * ({h}) + 12345) % 2147483647)"


def boot_sql(reps: int) -> str:
    return V.WIDE + f", nb AS (SELECT benchmark, CAST(row_number() OVER (PARTITION BY benchmark ORDER BY item) - 1 AS BIGINT) AS k, count(*) OVER (PARTITION BY benchmark) AS n, d FROM (SELECT benchmark, item, avg(d) AS d FROM paired GROUP BY 1, 2)), dr AS (SELECT g.benchmark, CAST(r.i AS BIGINT) AS rep, {pick_sql('CAST(r.i AS BIGINT)', 'g.k')} % g.n AS k FROM nb g, range({reps}) AS r(i))"


@query(f"WITH {boot_sql(1000)}, st AS (SELECT dr.benchmark, rep, avg(d) AS s FROM dr JOIN nb ON dr.benchmark = nb.benchmark AND dr.k = nb.k GROUP BY 1, 2) SELECT benchmark, count(*) AS n_boot, {R(median='quantile_cont(s, 0.5)', lo='quantile_cont(s, 0.025)', hi='quantile_cont(s, 0.975)')} FROM st GROUP BY 1")
def bootstrap_gap_hash(spark, sf):
    items = C.paired_items(V.responses(spark, sf)).groupBy("benchmark", "item").agg(F.avg("d").alias("d"))
    return tidy(resample.interval(resample.bootstrap_mean(items, ["benchmark"], ["item"], "d"), ["benchmark"], "stat"))


@query(f"WITH {boot_sql(1)}, fl AS (SELECT benchmark, CAST(r.i AS BIGINT) AS rep, sum(d * (1 - 2 * ({pick_sql('CAST(r.i AS BIGINT)', 'k')} % 2))) AS f, sum(d) AS s, max(n) AS n FROM nb, range(10000) AS r(i) GROUP BY 1, 2) SELECT benchmark, {R(observed='max(s) / max(n)', p='avg(CASE WHEN abs(f) >= abs(s) - 1e-9 THEN 1 ELSE 0 END)')} FROM fl GROUP BY 1")
def permutation_flip(spark, sf):
    items = C.paired_items(V.responses(spark, sf)).groupBy("benchmark", "item").agg(F.avg("d").alias("d"))
    return tidy(resample.permutation_flip(items, ["benchmark"], ["item"], "d"))


@query(f"WITH {V.GAPS}, {V.DIM}, g AS (SELECT ord, gap, vendor FROM gaps JOIN dim USING (model)), s AS (SELECT i FROM range(128) AS r(i) WHERE bit_count(CAST(i AS BIGINT)) = 4), e AS (SELECT i, abs(avg(CASE WHEN (i >> ord) & 1 = 1 THEN gap END) - avg(CASE WHEN (i >> ord) & 1 = 0 THEN gap END)) AS d FROM s, g GROUP BY 1), o AS (SELECT abs(avg(CASE WHEN vendor = 'gpt' THEN gap END) - avg(CASE WHEN vendor <> 'gpt' THEN gap END)) AS observed FROM g) SELECT count(*) AS n_splits, {R(observed='max(observed)', p='avg(CASE WHEN d >= observed - 1e-12 THEN 1 ELSE 0 END)')} FROM e, o")
def vendor_permutation_exact(spark, sf):
    g = C.gaps(V.responses(spark, sf)).join(V.model_dim(spark), "model")
    return tidy(resample.exact_label_permutation(g, "gap", "vendor", "gpt"))


@query(f"WITH h AS (SELECT p_brand, p_partkey, {pick_sql('p_partkey', 'CAST(42 AS BIGINT)')} AS h FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY h, p_partkey) AS rn FROM h) SELECT p_brand, p_partkey FROM r WHERE rn <= 5")
def seeded_sample(spark, sf):
    return resample.seeded_sample(V.table(spark, sf, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 5)


def golden_bootstrap(spark, sf):
    return tidy(resample.golden_gaps(C.paired_items(V.panel(spark, sf)), ["benchmark", "model"]))


# ---- item response models, generators, triage


def rasch_delta_b(spark, sf):
    return tidy(irt.delta_summary(irt.delta_b(V.responses(spark, sf))), 4)


def rasch_windows(spark, sf):
    w = irt.model_windows(V.responses(spark, sf).where("version = 'orig'"), V.model_dim(spark), 2)
    return tidy(irt.rasch(w, ["benchmark", "window"]), 4)


def irt_longitudinal(spark, sf):
    r = V.table(spark, sf, "lineitem").select(F.lit("lines").alias("benchmark"), F.year("l_shipdate").cast("string").alias("epoch"), (F.col("l_suppkey") % 7).cast("string").alias("model"), (F.col("l_partkey") % 50).alias("item"), F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("c"))
    return tidy(irt.longitudinal(r.groupBy("benchmark", "epoch", "model", "item").agg(F.max("c").alias("correct"))), 3)


for _f in (golden_bootstrap, rasch_delta_b, rasch_windows, irt_longitudinal):
    QUERIES[_f.__name__] = _f


@query(f"WITH {V.PARAMS}, e AS (SELECT item, max_by(a, t) AS a, max_by(b, t) AS b FROM params GROUP BY 1) SELECT item, {R(p='1 / (1 + exp(-greatest(least(a * (1 - b), 30), -30)))', difficulty='-ln(greatest(least((1 - b) / 2, 0.999), 0.001) / (1 - greatest(least((1 - b) / 2, 0.999), 0.001)))')} FROM e")
def item_curves(spark, sf):
    e = V.item_params(spark, sf).groupBy("item").agg(F.max_by("a", "t").alias("a"), F.max_by("b", "t").alias("b"))
    return tidy(e.select("item", irt.prob_2pl(F.lit(1.0), F.col("a"), F.col("b")).alias("p"), irt.empirical_difficulty((1 - F.col("b")) / 2).alias("difficulty")))


TRIAGE = [("b0", 0, 0.9, 5.0), ("b1", 1, 0.2, None), ("b2", 2, None, 30.0), ("b3", 3, 0.5, 12.0), ("b4", 4, 0.5, 12.0)]
TSQL = "td AS (SELECT benchmark, ord, CAST(sat AS DOUBLE) AS sat, CAST(hl AS DOUBLE) AS hl FROM (VALUES " + ", ".join(f"('{b}', {o}, {'NULL' if s is None else s}, {'NULL' if h is None else h})" for b, o, s, h in TRIAGE) + ") AS x(benchmark, ord, sat, hl)), pk AS (SELECT 'saturation_low' AS policy, benchmark, ord, coalesce(sat, 1) AS key FROM td UNION ALL SELECT 'saturation_high', benchmark, ord, -coalesce(sat, 0) FROM td UNION ALL SELECT 'halflife_long', benchmark, ord, -coalesce(hl, 0) FROM td UNION ALL SELECT 'halflife_short', benchmark, ord, coalesce(hl, 60) FROM td), pl AS (SELECT policy, benchmark, CAST(row_number() OVER (PARTITION BY policy ORDER BY key, ord) AS INTEGER) AS place FROM pk)"


def triage_dim(spark):
    return spark.createDataFrame(TRIAGE, "benchmark string, ord int, saturation double, halflife double")


def panel_acc(spark, sf):
    return C.accuracy(V.panel(spark, sf).where("version = 'pert'"), 50).select("benchmark", "model", "acc")


@query(f"WITH {TSQL} SELECT * FROM pl WHERE place <= 3")
def triage_policies(spark, sf):
    return triage.pick_benchmarks(triage_dim(spark), 3)


ACC = V.PANEL + ", acc AS (SELECT benchmark, model, avg(correct) AS acc FROM panel WHERE version = 'pert' GROUP BY 1, 2 HAVING count(correct) >= 50), ab AS (SELECT model, avg(acc) AS ability FROM acc GROUP BY 1)"


@query(f"WITH {ACC}, {TSQL}, pt AS (SELECT policy, model, avg(acc) AS part FROM acc JOIN pl USING (benchmark) WHERE place <= 3 GROUP BY 1, 2), rk AS (SELECT policy, rank() OVER (PARTITION BY policy ORDER BY part) + (count(*) OVER (PARTITION BY policy, part) - 1) / 2 AS a, rank() OVER (PARTITION BY policy ORDER BY ability) + (count(*) OVER (PARTITION BY policy, ability) - 1) / 2 AS b FROM pt JOIN ab USING (model)) SELECT policy, count(*) AS n, {R(rho=CORR('a', 'b'))} FROM rk GROUP BY 1")
def oracle_rho(spark, sf):
    return tidy(triage.policy_rho(panel_acc(spark, sf), triage.pick_benchmarks(triage_dim(spark), 3)))


@query(
    f"WITH {ACC}, bs AS (SELECT DISTINCT benchmark FROM acc), "
    "ch AS (SELECT a.benchmark || b.benchmark || c.benchmark AS policy, [a.benchmark, b.benchmark, c.benchmark] AS picks "
    "FROM bs a JOIN bs b ON a.benchmark < b.benchmark JOIN bs c ON b.benchmark < c.benchmark), "
    "pt AS (SELECT policy, model, avg(acc) AS part FROM ch JOIN acc ON list_contains(picks, acc.benchmark) GROUP BY 1, 2), "
    "rk AS (SELECT policy, rank() OVER (PARTITION BY policy ORDER BY part) + (count(*) OVER (PARTITION BY policy, part) - 1) / 2 AS a, "
    "rank() OVER (PARTITION BY policy ORDER BY ability) + (count(*) OVER (PARTITION BY policy, ability) - 1) / 2 AS b FROM pt JOIN ab USING (model)), "
    "rh AS (SELECT policy, corr(a, b) AS rho FROM rk GROUP BY 1) "
    f"SELECT count(*) AS n_subsets, {R(rho='avg(CASE WHEN isnan(rho) THEN NULL ELSE rho END)')} FROM rh"
)
def random_rho(spark, sf):
    return tidy(triage.random_policy_rho(panel_acc(spark, sf), 3))


def head_to_head(spark, sf):
    answers = V.panel(spark, sf).where("version = 'pert'").select("benchmark", "model", "item", "correct")
    return tidy(triage.head_to_head(triage.bootstrap_policies(answers, triage.pick_benchmarks(triage_dim(spark), 3)), "halflife_long", "saturation_low"))


QUERIES["head_to_head"] = head_to_head


def synth_sql(epochs: int, models: int, items: int) -> str:
    u = lambda x, y, s: pick_sql(f"CAST({x} AS BIGINT)", f"CAST({y} AS BIGINT)").replace("+ 42)", f"+ {42 + s})") + f" / {D('2147483647')}"
    bell = lambda x, s: "(" + " + ".join(u(x, k, s) for k in (1, 2, 3, 4)) + f" - 2) * sqrt({D(3)})"
    return f"""c AS (SELECT i % {items} AS item, (i // {items}) % {models} AS model, i // {items * models} AS epoch FROM range({epochs * models * items}) AS r(i)),
    p1 AS (SELECT *, {bell('model', 11)} + {D(0.08)} * epoch AS theta, {D(0.5)} + {D(1.5)} * {u('item', 5, 13)} AS a, {bell('item', 17)} AS b, {u('item', 6, 19)} AS ic, {u('model', 7, 23)} AS lk FROM c),
    p2 AS (SELECT * REPLACE (CASE WHEN epoch >= {epochs} / 2 AND ic > 1 - {D(0.1)} THEN b - 3 ELSE b END AS b) FROM p1),
    p3 AS (SELECT *, CASE WHEN {u(f'(epoch * {models} + model)', 'item', 29)} < 1 / (1 + exp(-a * (theta - b))) THEN 1 ELSE 0 END AS clean FROM p2),
    rows_ AS (SELECT epoch, model, item, clean, CASE WHEN epoch >= {epochs} / 2 AND ic < {D(0.1)} AND lk < {D(0.5)} THEN 1 ELSE clean END AS correct FROM p3)"""


GKF = synth_sql(20, 30, 500) + ", ac AS (SELECT epoch, model, avg(correct) AS x, avg(clean) AS y FROM rows_ GROUP BY 1, 2), sp AS (SELECT epoch, var_samp(x) AS dt, var_samp(y) AS dc, max(x) AS best FROM ac GROUP BY 1), kf AS (SELECT *, greatest(0, dc - dt) AS k, CASE WHEN best >= 0.95 THEN 0.3 * dt ELSE 0 END AS f FROM sp)"


@query(f"WITH {synth_sql(20, 30, 500)} SELECT epoch, model, CAST(sum(correct) AS BIGINT) AS right_answers, CAST(sum(clean) AS BIGINT) AS clean_answers FROM rows_ GROUP BY 1, 2")
def synthetic_responses(spark, sf):
    return synth.responses(spark).groupBy("epoch", "model").agg(F.sum("correct").alias("right_answers"), F.sum("clean").alias("clean_answers"))


@query(f"WITH {GKF} SELECT epoch, {R(d_total='dt', d_clean='dc', best='best', k='k', f='f', g='greatest(0, dc - k - f)')} FROM kf")
def synthetic_gkf(spark, sf):
    return tidy(synth.ground_truth(synth.responses(spark)))


@query(
    f"WITH {synth_sql(20, 30, 500)}, ac AS (SELECT epoch, model, avg(correct) AS x, avg(clean) AS y FROM rows_ GROUP BY 1, 2), "
    "sp AS (SELECT epoch, avg(x) AS mo, avg(y) AS mc, var_samp(x) AS vo, var_samp(y) AS vc FROM ac GROUP BY 1), "
    "it AS (SELECT epoch, item, avg(correct) AS p FROM rows_ GROUP BY 1, 2), fr AS (SELECT epoch, avg(CASE WHEN p >= 0.95 THEN 1.0 ELSE 0 END) AS frac FROM it GROUP BY 1), "
    "en AS (SELECT max_by(mo - mc, epoch) AS k_mu, max_by(vc - vo, epoch) AS k_sigma, min_by(vo, epoch) AS d0, max_by(frac, epoch) AS frac, "
    "min_by(vc, epoch) - max_by(vc, epoch) AS fall FROM sp JOIN fr USING (epoch)), fg AS (SELECT *, 0.3 * frac * d0 AS f FROM en) "
    f"SELECT {R(k_mu='k_mu', k_sigma='k_sigma', d0='d0', frac='frac', fall='fall', f='f', g='greatest(0, fall - f)')} FROM fg"
)
def synthetic_sweep(spark, sf):
    return tidy(synth.sweep_decomposition(synth.responses(spark)))


# ---- windows of quarters, sweeps and models


@query(f"WITH {V.SCORES} SELECT benchmark, count(*) AS n, {R(mean_score='avg(score)')} FROM scores WHERE q BETWEEN {1996 * 4 + 1} AND {1997 * 4} GROUP BY 1")
def quarter_window(spark, sf):
    w = power.quarter_window(V.scores(spark, sf), "1996Q2", "1997Q1")
    return tidy(w.groupBy("benchmark").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")))


@query(f"WITH {V.PARAMS} SELECT benchmark, CAST(q AS VARCHAR) AS epoch, {R(mean_a='avg(a)')} FROM params GROUP BY 1, 2")
def mean_discrimination(spark, sf):
    return tidy(power.mean_discrimination(V.item_params(spark, sf).withColumn("epoch", F.col("q").cast("string"))))


@query(f"WITH {RANKED}, " + ", ".join(pctl_series(k, 10, name=f"s{i}") for i, k in enumerate(KS)) + ", ser AS (" + " UNION ALL ".join(f"SELECT benchmark, {D(k)} AS k, q, t, v FROM s{i}" for i, k in enumerate(KS)) + f"), {panel_sql('ser', 'benchmark, k')} SELECT benchmark, count(*) AS n_fits, {R(low='min(h)', high='max(h)', ratio='max(h) / min(h)')} FROM ph WHERE h IS NOT NULL GROUP BY 1")
def halflife_sweep(spark, sf):
    return tidy(fit.halflife_sweep(power.topk_sweep(V.scores(spark, sf), KS, "boot_v2")))


MODEL_BOOT = V.GAPS + f", nb AS (SELECT benchmark, CAST(row_number() OVER (PARTITION BY benchmark ORDER BY model) - 1 AS BIGINT) AS k, count(*) OVER (PARTITION BY benchmark) AS n, gap FROM gaps), dr AS (SELECT g.benchmark, CAST(r.i AS BIGINT) AS rep, {pick_sql('CAST(r.i AS BIGINT)', 'g.k')} % g.n AS k FROM nb g, range(5000) AS r(i)), st AS (SELECT dr.benchmark, rep, avg(gap) AS s FROM dr JOIN nb ON dr.benchmark = nb.benchmark AND dr.k = nb.k GROUP BY 1, 2)"


@query(f"WITH {MODEL_BOOT} SELECT benchmark, count(*) AS n_boot, {R(median='quantile_cont(s, 0.5)', lo='quantile_cont(s, 0.025)', hi='quantile_cont(s, 0.975)')} FROM st GROUP BY 1")
def bootstrap_gap_models(spark, sf):
    g = C.gaps(V.responses(spark, sf))
    return tidy(resample.interval(resample.bootstrap_mean(g, ["benchmark"], ["model"], "gap", 5000), ["benchmark"], "stat"))


def correlation_tests(spark, sf):
    """Correlations of the two versions' accuracies with p-values and a bootstrap interval, one row per benchmark. The exact p of Kendall's
    tau counts permutations, so there is no SQL; correlation_intervals has the rest."""
    g = C.gaps(V.panel(spark, sf)).select("benchmark", "model", "orig", "pert")
    r = stats.correlation_tests(g, ["benchmark"], "orig", "pert").join(resample.correlation_bootstrap(g, ["benchmark"], ["model"], "orig", "pert"), "benchmark")
    tau = stats.kendall(g, ["benchmark"], "orig", "pert", "model").select("benchmark", "tau", F.udf(lambda t, n: None if t is None else stats.kendall_exact_p(t, n), "double")("tau", "n").alias("tau_p"))  # a row a benchmark
    return tidy(r.join(tau, "benchmark").select("benchmark", "r", "p", "lo", "hi", "tau", "tau_p"))


QUERIES["correlation_tests"] = correlation_tests
