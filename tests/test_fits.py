"""Native decay fits: published half-lives from their published inputs, the whole range of rates, plain versions, and bootstrap rules."""

import math

import pytest
from pyspark.sql import functions as F

from wanescope.operators import contamination as C
from wanescope.operators import fit, power, resample

# Score and release date of each benchmark's leading systems, and the half-life published for the gap to 100.
HISTORY = {
    "glue": (4.947, "78.3,2018-10-01;80.5,2018-10-01;72.8,2018-06-01;82.7,2019-01-01;88.4,2019-06-01;88.5,2019-07-01;89.4,2019-09-01;89.7,2019-10-01;89.0,2019-08-01;89.4,2020-03-01;90.0,2020-06-01;91.1,2021-11-01;90.8,2021-07-01;90.4,2022-01-01"),
    "superglue": (1.452, "66.1,2019-06-01;69.0,2019-06-01;71.5,2019-07-01;84.6,2019-08-01;84.6,2019-09-01;89.3,2019-10-01;87.6,2019-12-01;89.9,2020-06-01;90.3,2020-11-01;90.4,2020-12-01;90.4,2021-01-01;91.1,2021-11-01;91.2,2022-02-01"),
    "squad11": (10.830, "70.3,2016-12-01;77.3,2017-02-01;82.9,2017-07-01;84.6,2018-04-01;88.5,2018-10-01;90.9,2018-10-01;94.6,2019-07-01;94.5,2019-06-01;94.6,2019-07-01;94.8,2019-09-01;94.9,2020-03-01;95.4,2020-10-01;95.6,2021-02-01"),
    "squad20": (3.926, "75.1,2018-10-01;81.8,2018-10-01;88.7,2019-07-01;88.8,2019-06-01;89.4,2019-07-01;89.7,2019-09-01;90.9,2020-03-01;90.2,2020-10-01;91.3,2019-10-01;90.8,2020-11-01;91.0,2021-11-01"),
    "coqa": (1.035, "52.6,2018-08-01;68.4,2018-12-01;76.5,2018-12-01;75.0,2018-09-01;76.6,2018-12-01;82.5,2019-07-01;86.7,2019-08-01;89.9,2019-10-01;90.7,2019-11-01;91.4,2021-11-01"),
}
# Answers right of 200 as written and as perturbed, by vendor.
RIGHT = [("gpt", 193, 162), ("gpt", 191, 166), ("gpt", 159, 135), ("gpt", 192, 165), ("claude", 181, 160), ("claude", 198, 171), ("claude", 197, 166)]


def test_published_halflives_of_the_glue_family(spark):
    rows = [(b, f"s{i}", float(x.split(",")[0]), x.split(",")[1]) for b, (_, told) in HISTORY.items() for i, x in enumerate(told.split(";"))]
    history = spark.createDataFrame(rows, "benchmark string, model string, score double, d string").select("benchmark", "model", "score", F.to_date("d").alias("release_date"))
    gap = power.sota_gap(history).groupBy("benchmark", F.col("months").alias("t_months")).agg(F.min("gap").alias("value"))
    got = {r.benchmark: r.halflife for r in fit.decay_fit(gap, ["benchmark"], fit.GAP).collect()}
    assert got == {b: pytest.approx(h, abs=2e-3) for b, (h, _) in HISTORY.items()}


def test_published_vendor_p_and_universal_items(spark):
    gaps = spark.createDataFrame([(v, (o - p) / 200) for v, o, p in RIGHT], "vendor string, gap double")
    assert gaps.where("vendor = 'gpt'").agg(F.avg("gap")).first()[0] == pytest.approx(0.13375)
    r = resample.exact_label_permutation(gaps, "gap", "vendor", "gpt").first()
    assert (r.n_splits, r.p) == (35, pytest.approx(0.942857, abs=1e-6))
    assert C.binomial_excess(11, 200, 0.5**7) == pytest.approx(6.64e-07, rel=1e-3)


def curves(spark, halves, span=60, step=3.0, noise=0.0):
    rows = [(str(h), i, step * i, 0.05 * math.exp(-math.log(2) / h * step * i) + 0.01 + noise * math.sin(7 * i)) for h in halves for i in range(span)]
    return spark.createDataFrame(rows, "benchmark string, q int, t_months double, value double")


def test_every_halflife_is_found(spark):
    """From a third of a month to centuries, as the plain version finds them."""
    halves = [0.35, 0.4, 1.0, 7.3, 39.3, 100.0, 300.0, 1000.0, 5000.0]
    s = curves(spark, halves, step=0.5)
    got = {r.benchmark: r.halflife for r in fit.decay_fit(s, ["benchmark"]).collect()}
    plain = {r.benchmark: r.halflife for r in fit.refined(s, ["benchmark"]).collect()}
    assert got == {str(h): pytest.approx(plain[str(h)], rel=1e-3) for h in halves}
    assert got == {str(h): pytest.approx(h, rel=1e-2) for h in halves}


def test_bounds_hold(spark):
    s = spark.createDataFrame([("up", 0.0, 1.0), ("up", 1.0, 2.0), ("up", 2.0, 4.0), ("flat", 0.0, 1.0), ("flat", 1.0, 1.0), ("flat", 2.0, 1.0), ("two", 0.0, 4.0), ("two", 1.0, 2.0), ("two", None, 9.0), (None, 0.0, 4.0), (None, 1.0, 2.0), (None, 2.0, 1.0)], "k string, t_months double, value double")
    got = {r.k: r for r in fit.decay_fit(s, ["k"]).collect()}
    assert set(got) == {"up", "flat", None} and got["up"].halflife is None and got["flat"].halflife is None
    assert got["up"].amplitude == 0 and got["up"].floor == pytest.approx(7 / 3) and got[None].halflife == pytest.approx(1.0, rel=1e-3)
    two = {r.k: r for r in fit.decay_fit(s, ["k"], fit.FORECAST).collect()}["two"]
    assert (two.rate, two.amplitude, two.floor) == (pytest.approx(math.log(2), rel=1e-3), pytest.approx(4.0, rel=1e-3), 0.0)


def test_three_shapes_as_the_plain_version(spark):
    t = [3.0 * i for i in range(20)]
    told = {"exponential": lambda x: 2 * math.exp(-0.1 * x) + 0.3, "stretched": lambda x: 2 * math.exp(-((0.05 * x) ** 2.2)) + 0.3, "logistic": lambda x: 2 / (1 + math.exp(0.3 * (x - 20))) + 0.3}
    rows = [(k, x, curve(x) + 1e-3 * math.sin(7 * x)) for k, curve in told.items() for x in t]
    s = spark.createDataFrame(rows, "k string, t_months double, value double")
    got = {(r.k, r["shape"]): r for r in fit.three_shapes(s, ["k"]).collect()}
    for k in told:
        plain = {d["shape"]: d for d in fit.fit_shapes([x for x in t], [v for q, _, v in rows if q == k])}
        assert min(told, key=lambda n: got[k, n].aic) == k
        assert got[k, k].halflife == pytest.approx(plain[k]["halflife"], rel=5e-3)
        assert got[k, k].rss <= plain[k]["rss"] * 1.5 + 1e-9


def test_intervals_have_their_variants_rules(spark):
    rows = [("b", f"m{i}", 0.5 + (0.4 * math.exp(-q / 3) + 0.02) * math.sin(i * 12.9898 + q), f"{2023 + q // 4}-{q % 4 * 3 + 1:02d}-15") for q in range(6) for i in range(12)]
    s = spark.createDataFrame(rows, "benchmark string, model string, score double, d string").select("benchmark", "model", "score", F.to_timestamp("d").alias("eval_date"))
    few = resample.bootstrap_halflife(s, reps=20).first()
    assert 0 < few.n_boot <= 20 and few.lo <= few.median <= few.hi  # one success is enough on the command line
    gated = resample.bootstrap_halflife(s, "boot_v2", reps=20).first()
    assert gated is None or (gated.n_boot < 50 and gated.lo is None and gated.median is None)
    assert resample.pair_bootstrap(curves(spark, [5.0], span=8, noise=1e-3), ["benchmark"], reps=9).first().lo is None  # under ten
