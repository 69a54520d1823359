import json
import math
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wanescope.functions import text as X
from wanescope.operators import contamination as C
from wanescope.operators import fit, irt, power, resample, stats


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_exponential_fit_recovers_halflife():
    t = np.arange(0, 36, 3.0)
    found = fit.fit_exponential(t, 0.04 * np.exp(-0.12 * t) + 0.01)
    assert found["halflife"] == pytest.approx(math.log(2) / 0.12, rel=1e-3)
    assert fit.fit_exponential(t, np.full(12, 0.5)) is None
    assert fit.fit_exponential(t[:2], np.array([2.0, 1.0])) is None


def test_shapes_rank_the_true_one_first():
    t = np.arange(0, 60, 3.0)
    for shape, v in (("exponential", 2 * np.exp(-0.1 * t) + 0.3), ("logistic", 2 / (1 + np.exp(0.3 * (t - 20))) + 0.3)):
        v = v + 1e-3 * np.sin(7 * t)
        found = fit.fit_shapes(t, v)
        assert found[0]["shape"] == shape
        assert found[0]["delta_aic"] == 0


def test_grid_fit_and_fallbacks(spark):
    rows = [("down", i, 3.0 * i, 0.05 * math.exp(-0.1 * 3 * i) + 0.01) for i in range(8)] + [("up", i, 3.0 * i, 0.01 * (i + 1)) for i in range(8)] + [("flat", i, 3.0 * i, 0.5) for i in range(8)] + [("two", i, 3.0 * i, 1.0 - i / 4) for i in range(2)]
    s = spark.createDataFrame(rows, "benchmark string, q int, t_months double, value double")
    grid = {r.benchmark: r for r in fit.decay_fit(s, ["benchmark"]).collect()}
    assert grid["down"].halflife == pytest.approx(math.log(2) / 0.1, rel=1e-3)
    assert grid["up"].halflife is None and grid["flat"].halflife is None and "two" not in grid
    panel = {r.benchmark: r.halflife for r in fit.panel_halflife(s, ["benchmark"]).collect()}
    assert panel["up"] is None and panel["flat"] is None and panel["two"] is not None


def test_small_groups_and_skipped_first_quarter(spark):
    rows = [("b", f"m{i}", i / 10, "2023-02-01") for i in range(9)] + [("b", f"m{i}", i / 10, "2023-05-01") for i in range(10)] + [("b", f"m{i}", i / 20, "2023-08-01") for i in range(10)] + [("b", "x", None, "2023-08-01")]
    s = spark.createDataFrame(rows, "benchmark string, model string, score double, d string").withColumn("eval_date", F.to_timestamp("d"))
    assert [r.t_months for r in power.topk_variance(s, "toolkit").orderBy("q").collect()] == [3.0, 6.0]  # from the first observed quarter
    assert power.topk_variance(s, "nlargest").count() == 0
    assert power.quarter_summary(s).where("quarter = '2023Q3'").first().n_models == 10


def test_item_drift_names_every_pattern(spark):
    rows, want = [], {}
    for i, bits in enumerate(product((0, 1), repeat=8)):
        o, p = bits[:4], bits[4:]
        for m in range(4):
            rows += [("b", f"m{m}", i, "orig", o[m]), ("b", f"m{m}", i, "pert", p[m])]
        lost, won = sum(a > b for a, b in zip(o, p)), sum(a < b for a, b in zip(o, p))
        want[i] = "all_correct" if sum(bits) == 8 else "all_wrong" if sum(bits) == 0 else "contamination_signature" if lost >= 2 and not won else "difficulty_drift" if list(o) == sorted(o) and 0 < sum(o) < 4 else "discriminating" if 0 < sum(o) < 4 else "noisy"
    rows += [("b", "m0", 999, "orig", None), ("b", "m0", 999, "pert", 1)]
    dim = spark.createDataFrame([(f"m{m}", m) for m in range(4)], "model string, ord int")
    got = {r.item: r["class"] for r in C.item_drift(spark.createDataFrame(rows, "benchmark string, model string, item long, version string, correct int"), dim).collect()}
    assert got == want | {999: "incomplete"}


def test_null_answers_are_not_wrong(spark):
    r = spark.createDataFrame([("b", "m", 1, "orig", 1), ("b", "m", 2, "orig", None), ("b", "m", 1, "pert", 0), ("b", "n", 1, "orig", 1)], "benchmark string, model string, item long, version string, correct int")
    assert [(x.model, x.gap) for x in C.gaps(r).collect()] == [("m", 1.0)]
    assert C.paired_items(r).count() == 1


def test_zero_variance_gives_null(spark):
    d = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 4.0)], "g int, x double, y double")
    assert stats.pearson(d, ["g"], "x", "y").first().r is None
    assert stats.linear_regression(d, ["g"], "x", "y").first().slope is None


def test_kendall_both_ways(spark):
    rng = np.random.RandomState(0)
    rows = [(g, i, float(rng.randint(5)), float(rng.randint(5))) for g in range(3) for i in range(20)]
    d = spark.createDataFrame(rows, "g int, k int, x double, y double")
    a = {r.g: r.tau for r in stats.kendall(d, ["g"], "x", "y", "k").collect()}
    b = {r.g: r.tau for r in stats.kendall_grouped(d, ["g"], "x", "y").collect()}
    assert all(a[g] == pytest.approx(b[g]) for g in a)


def test_distributions():
    assert stats.binomial_sf(11, 200, 0.01) == pytest.approx(1 - sum(math.comb(200, k) * 0.01**k * 0.99 ** (200 - k) for k in range(11)), rel=1e-6)
    assert stats.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.kendall_exact_p(1.0, 4) == pytest.approx(2 / 24)
    assert stats.mann_kendall_p(0, 10) == 1.0 and 0 < stats.mann_kendall_p(45, 10) < 1e-3


@given(st.integers(0, 10**9), st.integers(0, 10**9))
@settings(max_examples=50, deadline=None)
def test_digit_sum_identity(a, b):
    carries, c = 0, 0
    x, y = a, b
    while x or y or c:
        c = (x % 10 + y % 10 + c) >= 10
        carries += c
        x, y = x // 10, y // 10
    s = lambda n: sum(map(int, str(n)))
    assert carries == (s(a) + s(b) - s(a + b)) // 9


def test_text_functions(spark):
    lit = F.lit
    r = one(spark, carry=X.carry_count(lit(999), lit(1)), none=X.carry_count(lit(0), lit(0)), final=X.final_answer(lit("x #### 1,234")), last=X.final_answer(lit("is 7 or 8.5")), nothing=X.final_answer(lit("no")), digits=X.digit_count(lit(-42.0)), dec=X.digit_count(lit(12.5)),
            mc=X.grade_mc(lit(" b) yes"), lit("B")), bad=X.grade_mc(lit("??"), lit("B")), missing=X.grade_mc(lit(None).cast("string"), lit("B")), num=X.grade_numeric(lit("3."), lit("3")), junk=X.grade_numeric(lit("abc"), lit("3")),
            same=X.answers_match(lit("\\frac{1}{2}"), lit("$0.5$")), obj=X.json_object(lit('a {"k": {"x": 1}} b')), fenced=X.strip_fences(lit("```python\nx = 1\n```")), fn=X.function_name(lit("def f_1 (x):")), gold=X.gold_index(F.array(lit("A"), lit("B")), lit("C")))
    assert (r.carry, r.none, r.final, r.last, r.nothing, r.digits, r.dec) == (3, 0, "1234", "8.5", None, 2, 3)
    assert (r.mc, r.bad, r.missing, r.num, r.junk) == (1, 0, None, 1, 0)
    assert r.same and json.loads(r.obj) == {"k": {"x": 1}} and (r.fenced, r.fn, r.gold) == ("x = 1", "f_1", None)
    assert X.boxed("so \\boxed{\\frac{1}{2}} ok") == "\\frac{1}{2}" and X.boxed("a\n#### 5\n") == "5" and X.boxed("so \\boxed{7}\n#### 12") == "12" and X.boxed("open \\boxed{7\nlast") == "last" and X.boxed("a\nb\n") == "b" and X.boxed("") == ""


def test_rasch_is_symmetric_and_two_pl_orders_items():
    rng = np.random.RandomState(1)
    theta, b = rng.normal(size=40), np.linspace(-2, 2, 60)
    x = (rng.rand(40, 60) < 1 / (1 + np.exp(-(theta[:, None] - b)))).astype(float)
    _, b1 = irt.fit_rasch(x)
    assert np.corrcoef(b1, b)[0, 1] > 0.9
    assert np.allclose(irt.fit_rasch(x)[1], b1)
    _, b2, _ = irt.fit_2pl(x)
    assert np.corrcoef(b2, b)[0, 1] > 0.85
    a0 = np.linspace(0.5, 2, 60)
    scale, shift = irt.equating(a0, b, a0 * 1.5, (b - 0.3) / 1.5)
    assert (scale, shift) == (pytest.approx(1.5, abs=0.01), pytest.approx(0.3, abs=0.01))


def test_golden_bootstrap_is_reproducible():
    o, p = np.array([1] * 30 + [0] * 10), np.array([1] * 20 + [0] * 20)
    gap, lo, hi = resample.golden_gap(o, p)
    assert gap == 0.25 and lo < gap < hi and resample.golden_gap(o, p) == (gap, lo, hi)


def test_sources_cli_and_stream(spark, tmp_path, capsys):
    from wanescope.__main__ import main
    from wanescope.sources import files, plug
    from wanescope.streaming.incremental import accumulators, daily, quarters

    rng = np.random.RandomState(0)
    lines = ["model,accuracy,date"] + [f"m{i},{0.5 + rng.rand() * 0.4 * math.exp(-q / 3):.4f},{2023 + q // 4}-{q % 4 * 3 + 1:02d}-15" for q in range(8) for i in range(30)] + ["bad,x,2023-01-01", "bad,0.5,never"]
    path = tmp_path / "demo.csv"
    path.write_text("\n".join(lines))
    rows = files.read_scores_csv(spark, str(path))
    assert rows.count() == 240 and rows.first().benchmark == "demo"
    assert main([str(path), "--n-boot", "5", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["n_quarters"] == 8
    (tmp_path / "r.json").write_text(json.dumps({"gpt": {"orig": [1, 0, None], "pert": [0, 0, 1]}}))
    r = files.read_responses_json(spark, str(tmp_path / "r.json"), "b")
    assert r.count() == 6 and r.where("correct is null").count() == 1
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "epoch_00.csv").write_text("0,1\n1,0\n0,1\n")
    assert files.read_epochs_csv(spark, str(tmp_path / "e" / "*.csv"), "b", 2).count() == 4
    assert files.empty_scores(spark).count() == 0
    items = spark.createDataFrame([("What is 2+2? A) 4 B) 5",), (None,)], "prompt string")
    assert {x.response for x in plug.solve(items, plug.FirstLetter(), parallelism=1).collect()} == {"A", None}
    waits = []
    assert plug.Retry(3, sleep=waits.append)(lambda: 1 / 0) is None and len(waits) == 2
    rows.write.parquet(str(tmp_path / "in"))
    closed = daily(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = closed.writeStream.outputMode("append").format("memory").queryName("acc").start()
    q.processAllAvailable()
    q.stop()
    last = rows.agg(F.max("eval_date")).first()[0]  # days within the watermark's delay aren't closed yet
    assert quarters(spark.table("acc")).count() == accumulators(rows.where(F.col("eval_date") < last)).count() == 7
    got, want = ({(r.benchmark, r.q): r.variance for r in x.collect()} for x in (accumulators(rows), power.with_quarter(rows).groupBy("benchmark", "q").agg(F.var_samp("score").alias("variance"))))
    assert got == {k: pytest.approx(v) for k, v in want.items()}
