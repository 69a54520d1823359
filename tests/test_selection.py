"""Order statistics by narrowing histograms, and the top strata that rest on them, against sorted lists."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanescope.operators import power, selection


@pytest.fixture(params=[(16, 5), (selection.BINS, selection.FEW)], ids=["narrowed", "sorted"])
def bounds(request, monkeypatch):
    monkeypatch.setattr(selection, "BINS", request.param[0])
    monkeypatch.setattr(selection, "FEW", request.param[1])


GROUPS = {
    "spread": [random.Random(1).random() for _ in range(300)],
    "ties": [random.Random(2).choice([0.25, 0.5, 0.75]) for _ in range(200)],
    "flat": [0.5] * 60,
    "steep": [2.0**-i for i in range(24)] + [-(2.0**-i) for i in range(12)] + [0.0],
    "one": [0.125],
    None: [float(i) for i in range(30)],
}


def test_every_place(spark, bounds):
    rows = spark.createDataFrame([(k, v) for k, vs in GROUPS.items() for v in [*vs, None]], "k string, v double").repartition(5)
    n = F.col("n")
    got = selection.order_values(rows, ["k"], "v", F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.floor(n / 3), F.floor(n / 2), n - 1, n, F.lit(-1).cast("long"))).collect()
    want = {(k, p): sorted(v)[p] for k, v in GROUPS.items() for p in {0, 1, len(v) // 3, len(v) // 2, len(v) - 1} if p < len(v)}
    assert {(r.k, r.place): r.at for r in got} == want and len(got) == len(want)
    assert all(r.n == len(GROUPS[r.k]) for r in got)


def test_no_rows(spark):
    rows = spark.createDataFrame([], "k string, v double")
    assert selection.order_values(rows, ["k"], "v", F.array(F.lit(0).cast("long"))).count() == 0


def frame(spark):
    day = datetime.date(2024, 1, 2)
    return spark.createDataFrame([(k, f"m{i}", v, day) for k, vs in GROUPS.items() for i, v in enumerate([*vs, None])], "benchmark string, model string, score double, eval_date date").repartition(5)


@pytest.mark.parametrize("variant, ddof, least", [("toolkit", 0, 10), ("nlargest", 1, 20)])
def test_variance_of_the_top(spark, bounds, variant, ddof, least):
    got = {r.benchmark: (r.n, r.value) for r in power._top_rows(power.with_quarter(frame(spark)), ["benchmark", "q"], 0.2, power.VARIANTS[variant]).collect()}
    want = {k: (len(v), pytest.approx(np.var(sorted(v)[-math.ceil(len(v) * 0.2) :], ddof=ddof), rel=1e-9, abs=1e-15)) for k, v in GROUPS.items() if len(v) >= least}
    assert got == want


def test_compression_and_saturation(spark, bounds):
    got = {r.benchmark: r for r in power.ceiling_compression(frame(spark)).collect()}
    assert set(got) == set(GROUPS)
    iqr = lambda v: np.subtract(*np.percentile(v, [75, 25]))
    for k, v in GROUPS.items():
        top = sorted(v)[-max(2, int(len(v) * 0.25)) :]
        want = None if len(v) < 4 else 1.0 if iqr(v) < 1e-10 else pytest.approx(1 - iqr(top) / iqr(v), abs=1e-12)
        assert (got[k].n, got[k].compression) == (len(v), want)
    for r in power.saturation_index(frame(spark)).collect():
        v = sorted(GROUPS[r.benchmark])
        assert (r.n, r.top, r.kth) == (len(v), v[-1], v[-5] if len(v) >= 5 else None)
        assert r.saturation == (None if len(v) < 6 else 1.0 if np.std(v, ddof=1) < 1e-9 else pytest.approx(math.exp(-(((v[-1] - v[-5]) / np.std(v, ddof=1)) ** 2))))
