"""Replicates drawn in arrays against the same draws as rows: equal picks and statistics, ties, small groups and null keys included."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanescope.operators import power, replicates, resample, triage


def test_picks_are_those_of_columns(spark):
    rng = random.Random(3)
    for n, seed in ((1, 42), (7, 43), (16_385, 42), (40_000, 7)):
        marks = [0, 1, 999, 2147483646, rng.randrange(2147483647)]
        rows = spark.range(n).select(*[resample.pick(F.lit(m).cast("long"), F.col("id"), F.lit(n).cast("long"), seed).alias(f"m{m}") for m in dict.fromkeys(marks)], "id").orderBy("id").toPandas()
        for m in marks:
            assert (replicates.picks(m, n, seed, np.empty(n, np.int64)) == rows[f"m{m}"].to_numpy()).all()


def scores(spark):
    """Quarters of 3 to 60 rows, some with many equal scores, and rows without a benchmark, a date or a score."""
    rng, rows = random.Random(5), []
    for b in ("x", "y"):
        for q in range(12):
            for i in range((3, 11, 60)[q % 3]):
                rows.append((b, f"m{i}", rng.choice((0.5, 0.75, rng.random())) * (1 - q / 20), datetime.date(2020 + q // 4, q % 4 * 3 + 1, 1 + i % 5)))
    rows += [(None, "m", 0.5, datetime.date(2020, 1, 1)), ("x", "m", None, datetime.date(2019, 1, 1)), ("y", "m", 0.5, None)]
    return spark.createDataFrame(rows, "benchmark string, model string, score double, eval_date date")


@pytest.mark.parametrize("draws", [1 << 25, 1000])
def test_means_as_from_rows(spark, monkeypatch, draws):
    monkeypatch.setattr(replicates, "DRAWS", draws)
    monkeypatch.setattr(replicates, "CHUNK", 8)
    of = lambda: {(r.benchmark, r.rep): r.stat for r in resample.bootstrap_mean(scores(spark), ["benchmark"], ["eval_date", "model", "score"], "score", 40).collect()}
    got = of()
    monkeypatch.setattr(replicates, "HELD", 0)
    want = of()
    assert len(got) == 80 and got == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(replicates, "HELD", 1 << 23)
    monkeypatch.setattr(resample, "draws", None)  # no draw is a row
    assert of() == got


@pytest.mark.parametrize("variant", ["toolkit", "boot_v1", "boot_v2", "nlargest"])
def test_series_as_from_rows(spark, variant):
    rows, group, order = power.with_quarter(scores(spark)), ["benchmark", "q"], ["eval_date", "model", "score"]
    columns = ["rep", "benchmark", "q", "quarter", "t_months", "n", "value"]
    want = power.topk_variance(resample.bootstrap_rows(rows, group, order, 6).drop("q"), variant, keys=["rep"])
    observed = rows.groupBy("benchmark").agg(F.min("q").alias("observed"))
    got = power.resampled_topk(resample.numbered(rows, group, order), observed, 60, variant, 0.2, 6, 42)
    want, got = ({tuple(r)[:-1]: r.value for r in x.select(*columns).collect()} for x in (want, got))
    assert len(got) > 40 and got == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_halflives_without_rows_of_draws(spark, monkeypatch):
    monkeypatch.setattr(resample, "draws", None)
    assert {r.benchmark for r in resample.bootstrap_halflife(scores(spark), reps=3).collect()} == {"x", "y"}


def test_report_without_rows_of_draws(spark, monkeypatch):
    from wanescope.plans import halflife

    monkeypatch.setattr(resample, "draws", None)
    got = {r.benchmark: r.n_boot for r in halflife.report(scores(spark).dropna(), reps=3).collect()}
    assert got.keys() == {"x", "y"} and max(got.values()) <= 3


@pytest.mark.parametrize("draws", [1 << 25, 500])
def test_policies_as_from_rows(spark, monkeypatch, draws):
    """Few items, so that some replicates draw no item that a model has answered; two models without a name or a benchmark."""
    rng = random.Random(7)
    rows = [(f"b{b}", f"m{m}", i, rng.choice((0, 1, None))) for b in range(3) for m in range(5) for i in range(9) if m < 4 or i == 2]
    rows += [("b0", "m1", 3, 1), ("b0", "m1", 3, 0), (None, "m1", 3, 1), ("b1", None, 4, 1)]
    answers = spark.createDataFrame(rows, "benchmark string, model string, item long, correct int")
    picks = spark.createDataFrame([("p", "b0"), ("p", "b1"), ("q", "b2")], "policy string, benchmark string")
    of = lambda **how: {(r.rep, r.policy): r.rho for r in triage.bootstrap_policies(answers, picks, 40, **how).collect()}
    monkeypatch.setattr(replicates, "DRAWS", draws)
    monkeypatch.setattr(replicates, "CHUNK", 4)
    monkeypatch.setattr(replicates, "HELD", 0)
    want = [of(), of(models_too=True)]
    monkeypatch.setattr(replicates, "HELD", 1 << 23)
    got = [of(models_too=False), of(models_too=True)]
    assert len(got[0]) == 80
    for x, y in zip(got, want):
        assert x == pytest.approx(y, rel=1e-9, nan_ok=True)
    monkeypatch.setattr(triage, "_drawn", None)
    assert of() == pytest.approx(want[0], rel=1e-9, nan_ok=True)
