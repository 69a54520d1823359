import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanescope.operators import triage


@pytest.fixture(scope="module")
def answers(spark):
    rng = random.Random(1)
    rows = [(f"b{b}", f"m{m}", i, int(rng.random() < 0.2 + 0.1 * m)) for b in range(3) for m in range(6) for i in range(20 + b) if (m + i) % 7]
    return spark.createDataFrame([*rows, ("b0", "m0", 3, None)], "benchmark string, model string, item long, correct int")


def test_policies_on_drawn_items(spark, answers, monkeypatch):
    """Against pandas on the same draws, and without the answers ever being gathered."""
    picks = spark.createDataFrame([("p", "b0"), ("p", "b1"), ("q", "b2")], "policy string, benchmark string")
    items = triage._placed(answers.where("correct is not null"), ["benchmark"], "item")
    drawn = triage._drawn(items, ["benchmark"], 4, 42).toPandas()
    assert list(drawn.groupby(["rep", "benchmark"]).times.sum()) == [20, 21, 22] * 4
    table = answers.where("correct is not null").join(items, ["benchmark", "item"]).toPandas()
    monkeypatch.setattr(DataFrame, "toPandas", None)
    got = {(r.rep, r.policy): r.rho for r in triage.bootstrap_policies(answers, picks, 4).collect()}
    all_rows = table.merge(drawn[["rep", "benchmark", "k", "times"]], on=["benchmark", "k"])
    all_rows["right"] = all_rows.correct * all_rows.times
    sums = all_rows.groupby(["rep", "benchmark", "model"])[["right", "times"]].sum()
    acc = (sums.right / sums.times).unstack("benchmark")
    for rep in range(4):
        for policy, chosen in (("p", ["b0", "b1"]), ("q", ["b2"])):
            one = acc.loc[rep]
            ranks = [x.mean(axis=1).round(12).rank() for x in (one[chosen], one)]
            assert got[rep, policy] == pytest.approx(np.corrcoef(*ranks)[0, 1])
    assert len(got) == 8 and isinstance(ranks[0], pd.Series)


def test_places_and_undefined_rho(spark, answers):
    placed = triage._placed(answers, ["benchmark"], "item").collect()
    assert sorted((r.benchmark, r.k) for r in placed) == [(f"b{b}", k) for b in range(3) for k in range(20 + b)]
    picks = spark.createDataFrame([("p", "b0")], "policy string, benchmark string")
    flat = triage.bootstrap_policies(answers.where("model < 'm2'"), picks, 3).collect()
    assert len(flat) == 3 and all(math.isnan(r.rho) for r in flat)
    assert triage.bootstrap_policies(answers, picks, 5, models_too=True).where(~F.isnan("rho")).count() > 0
