"""Queries over text repairs, vendors, likelihoods, grids and label stability; see `catalog`."""

from __future__ import annotations

from pyspark.sql import functions as F

from wanescope.functions import text as X
from wanescope.operators import contamination as C
from wanescope.operators import fit, irt, power, synth
from wanescope.plans import views as V
from wanescope.plans.catalog import ORACLES, QUERIES, TOOLKIT, D, R, panel_sql, query
from wanescope.plans.catalog2 import synth_sql
from wanescope.plans.views import tidy


@query(
    "SELECT o_orderkey, o_orderpriority AS marked, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, "
    "'{\"status\": \"' || o_orderstatus || '\"}' AS repaired FROM orders"
)
def text_repairs(spark, sf):
    """The line behind the mark, months as dates, quotes of a near-JSON object."""
    said = F.concat(F.lit("so\n#### "), F.col("o_orderpriority"), F.lit(" \nand more"))
    quoted = F.concat(F.lit("{'status': '"), F.col("o_orderstatus"), F.lit("'}"))
    return V.table(spark, sf, "orders").select(
        "o_orderkey", X.marked_line(said).alias("marked"), X.month_start(F.date_format("o_orderdate", "yyyy-MM")).alias("month"), X.repair_quotes(quoted).alias("repaired")
    )


@query(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '\\frac{' || CAST(p_size AS VARCHAR) || '}{2}' WHEN 1 THEN CAST(p_size AS VARCHAR) || ' of' || chr(10) || p_brand "
    "WHEN 2 THEN 'last ' || p_brand ELSE '\\boxed{' || p_brand END AS answer FROM part"
)
def boxed_answers(spark, sf):
    """Boxed answers with nested braces, marks before boxes, last lines, and a box that never closes."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    said = F.when(kind == 0, F.concat(F.lit("is \\boxed{1} or \\boxed{\\frac{"), size, F.lit("}{2}}.")))
    said = said.when(kind == 1, F.concat(F.lit("so \\boxed{7}\n#### "), size, F.lit(" of\n"), F.col("p_brand")))
    said = said.when(kind == 2, F.concat(F.lit("first\nlast "), F.col("p_brand"), F.lit(" \n"))).otherwise(F.concat(F.lit("see\n\\boxed{"), F.col("p_brand")))
    return V.table(spark, sf, "part").select("p_partkey", X.boxed_answer(said).alias("answer"))


@query(
    f"WITH {V.GAPS}, {V.DIM}, vd AS (SELECT CASE vendor WHEN 'gpt' THEN 'openai' WHEN 'claude' THEN 'anthropic' WHEN 'gemini' THEN 'google' ELSE 'other' END AS vendor, gap "
    f"FROM gaps JOIN dim USING (model)) SELECT vendor, count(*) AS n, {R(mean_gap='avg(gap)')} FROM vd GROUP BY 1"
)
def vendor_by_prefix(spark, sf):
    """Gaps by the vendor that a model's full name begins with."""
    named = V.model_dim(spark).select("model", C.vendor_of(F.concat_ws("-", "vendor", "model")).alias("vendor"))
    return tidy(C.vendor_gaps(C.gaps(V.responses(spark, sf)), named))


NLL = (
    V.RESPONSES + f", {V.DIM}, pr AS (SELECT p_partkey AS item, {D(0.5)} + p_size / {D(50)} AS a, (p_partkey % 7 - 3) / {D(2)} AS b FROM part), "
    f"th AS (SELECT model, ord / {D(3)} - 1 AS theta FROM dim), z AS (SELECT correct, 1 / (1 + exp(-greatest(least(a * (theta - b), 30), -30))) AS p "
    "FROM responses JOIN pr USING (item) JOIN th USING (model) WHERE correct IS NOT NULL)"
)


@query(
    f"WITH {NLL} SELECT round((SELECT -sum(CASE WHEN correct = 1 THEN ln(p) ELSE ln(1 - p) END) FROM z) + (SELECT sum(theta * theta) / 2 FROM th) "
    "+ (SELECT sum(ln(a) * ln(a)) / 0.5 FROM pr), 4) + 0.0 AS nll"
)
def likelihood_2pl(spark, sf):
    """Penalised likelihood of all responses under given item parameters and abilities."""
    items = V.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), (0.5 + F.col("p_size") / 50).alias("a"), ((F.col("p_partkey") % 7 - 3) / 2).alias("b"))
    abilities = V.model_dim(spark).select("model", (F.col("ord") / 3 - 1).alias("theta"))
    return tidy(irt.nll_2pl(V.responses(spark, sf), items, abilities), 4)


@query(
    f"WITH {V.WIDE}, it AS (SELECT item, min(d) AS least FROM paired GROUP BY 1), ct AS (SELECT count(*) AS n, count(CASE WHEN least = 1 THEN 1 END) AS x FROM it), "
    f"tm AS (SELECT n, x, unnest(range(x, n + 1)) AS k FROM ct) SELECT n AS n_items, x AS n_universal, "
    f"{R(p='least(1, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.01) + (n - k) * ln(0.99))))')} FROM tm GROUP BY 1, 2"
)
def universal_excess(spark, sf):
    """Whether more items are universal than one in a hundred would be by chance."""
    r = V.responses(spark, sf)
    n = C.paired_items(r).agg(F.countDistinct("item")).first()[0]
    x = C.universal_items(r).count()
    return tidy(spark.createDataFrame([(n, x, C.binomial_excess(x, n, 0.01))], "n_items long, n_universal long, p double"))


LEVELS, GROWTHS, SWEEP_REPS = [0.0, 0.1, 0.25, 0.5], [0.0, 0.04, 0.08], 5


@query(
    f"SELECT c AS contamination, g AS growth, CAST(r AS INTEGER) AS rep, CAST(42 + 100 * r + floor(100 * c) + floor(1000 * g) AS BIGINT) AS seed "
    f"FROM unnest([{', '.join(D(x) for x in LEVELS)}]) AS x(c), unnest([{', '.join(D(x) for x in GROWTHS)}]) AS y(g), range({SWEEP_REPS}) AS z(r)"
)
def sweep_grid(spark, sf):
    return synth.config_grid(spark, LEVELS, GROWTHS, SWEEP_REPS)


@query(
    f"WITH {synth_sql(20, 30, 500)}, ac AS (SELECT epoch, model, avg(correct) AS x, avg(clean) AS y FROM rows_ GROUP BY 1, 2) "
    f"SELECT epoch, {R(d_total='var_samp(x)', d_clean='var_samp(y)', mean='avg(x)', best='max(x)')} FROM ac GROUP BY 1"
)
def synthetic_validation(spark, sf):
    """The true spread of each epoch beside what its answers show."""
    rows = synth.responses(spark)
    truth = synth.ground_truth(rows).select("epoch", "d_total", "d_clean")
    return tidy(synth.validation(truth, synth.spread(rows, "correct").select("epoch", "mean", "best")))


@query(
    f"WITH {V.PARAMS} SELECT item, q, {R(exponential='ln(2) / a', stretched='pow(ln(2), 1 / (0.5 + a)) / a', logistic='b')} FROM params"
)
def halflife_formulas(spark, sf):
    p = V.item_params(spark, sf)
    rate, beta = F.col("a"), 0.5 + F.col("a")
    return tidy(p.select("item", "q", *[fit.halflife_of(s, rate, beta, F.col("b")).alias(s) for s in ("exponential", "stretched", "logistic")]))


LABELS = "CASE WHEN h IS NULL THEN 'noisy' WHEN h < 3 THEN 'exhausted' WHEN h < 10 THEN 'decaying' WHEN h < 24 THEN 'slow' ELSE 'stable' END"


@query(
    f"WITH {TOOLKIT}, lq AS (SELECT a.benchmark, b.q AS dropped, a.t, a.v FROM ser a JOIN ser b ON a.benchmark = b.benchmark AND a.q <> b.q "
    f"UNION ALL SELECT benchmark, -1, t, v FROM ser), {panel_sql('lq', 'benchmark, dropped')}, lb AS (SELECT s.benchmark, s.dropped, {LABELS} AS label "
    "FROM (SELECT DISTINCT benchmark, dropped FROM lq) s LEFT JOIN ph ON s.benchmark = ph.benchmark AND s.dropped = ph.dropped) "
    f"SELECT a.benchmark, m.label, count(*) AS n_fits, {R(stability='avg(CASE WHEN a.label = m.label THEN 1.0 ELSE 0 END)')} "
    "FROM lb a JOIN lb m ON a.benchmark = m.benchmark AND m.dropped = -1 WHERE a.dropped <> -1 GROUP BY 1, 2"
)
def label_stability(spark, sf):
    return tidy(fit.label_stability(power.topk_variance(V.scores(spark, sf)), ["benchmark"]))


__all__ = ["ORACLES", "QUERIES"]
