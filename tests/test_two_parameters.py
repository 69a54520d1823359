"""Two-parameter fits in rounds take the steps of the whole matrix's fit; equating by summed curves finds the plain version's constants."""

import numpy as np
import pytest

from wanescope.operators import irt


def answers(spark, seed=4):
    rng = np.random.RandomState(seed)
    rows = []
    for k, models, items, missing in (("b", 5, 12, 0.0), (None, 4, 9, 0.2), ("two", 2, 3, 0.0)):
        a, b, theta = rng.uniform(0.5, 2, items), rng.randn(items), rng.randn(models)
        y = rng.rand(models, items) < 1 / (1 + np.exp(-a * (theta[:, None] - b)))
        rows += [(k, f"m{i}", j, int(y[i, j]) if rng.rand() >= missing else None) for i in range(models) for j in range(items)]
    rows += [("b", "m0", 0, 0), ("b", None, 0, 1), ("b", "m0", None, 1)]  # a repeat, and rows that belong nowhere
    return spark.createDataFrame(rows, "benchmark string, model string, item int, correct int").repartition(3)


@pytest.mark.parametrize("steps", [1, 4])
def test_rounds_are_the_same_steps(spark, steps):
    r = answers(spark)
    alone = {(x.benchmark, x.item): (x.a, x.b) for x in irt.two_pl(r, ["benchmark"], steps=steps).collect()}
    rounds = {(x.benchmark, x.item): (x.a, x.b) for x in irt.two_pl(r, ["benchmark"], most_cells=0, steps=steps).collect()}
    assert {k for k, _ in alone} == {"b", None} and alone.keys() == rounds.keys()
    for k, pair in alone.items():
        assert rounds[k] == pytest.approx(pair, abs=1e-9)


def test_groups_that_converge_leave(spark):
    """Equal answers everywhere converge in a few rounds, before the other group does; all items are there at the end."""
    r = spark.createDataFrame([("still", f"m{i}", j, 1) for i in range(3) for j in range(2)], "benchmark string, model string, item int, correct int").unionByName(answers(spark).where("benchmark = 'b'"))
    cells = r.dropna().groupBy("benchmark", "model", "item").agg({"correct": "max"}).withColumnRenamed("max(correct)", "correct")
    got = irt._two_pl_in_rounds(cells, ["benchmark"], 6, tolerance=0.05)
    assert got.count() == 14 == got.select("benchmark", "item").distinct().count()


def test_no_answers(spark):
    r = spark.createDataFrame([("b", "m", 1, None)], "benchmark string, model string, item int, correct int")
    assert irt.two_pl(r, ["benchmark"]).count() == 0 == irt.two_pl(r, ["benchmark"], most_cells=-1).count()


def test_equating_by_curves(spark):
    rng = np.random.RandomState(6)
    rows, want = [], {}
    for k, scale, shift, noise in (("same", 1.0, 0.0, 0.0), ("moved", 1.5, -0.4, 0.0), (None, 0.6, 0.8, 0.0), ("noisy", 1.2, 0.3, 0.15), ("far", 0.2, 2.5, 0.0)):
        a0, b0 = rng.uniform(0.5, 2, 40), rng.randn(40)
        a, b = a0 * scale * np.exp(noise * rng.randn(40)), (b0 - shift) / scale + noise * rng.randn(40)
        rows += [(k, *map(float, x)) for x in zip(a, b, a0, b0)]
        want[k] = (scale, shift) if noise == 0 else irt.equating(a0, b0, a, b)
    both = spark.createDataFrame(rows, "k string, a double, b double, a0 double, b0 double").repartition(4)
    got = {r.k: (r.scale, r.shift) for r in irt.equating_constants(both, ["k"]).collect()}
    assert got == {k: pytest.approx(v, abs=1e-5) for k, v in want.items()}
    assert irt.equating_constants(both.where("false"), ["k"]).count() == 0


def test_epochs_on_the_first_scale(spark):
    items = [(0, 1.0, -1.0), (1, 1.4, 0.0), (2, 0.8, 0.7), (3, 1.1, 1.3)]
    rows = [("x", "e1", *i) for i in items] + [("x", "e2", i, a * 1.25, (b - 0.5) / 1.25) for i, a, b in items] + [("x", "e2", 9, 1.0, 0.0), ("y", "e5", 1, 1.0, 0.5)]
    got = {(r.benchmark, r.epoch, r.item): (r.a, r.b) for r in irt.equated(spark.createDataFrame(rows, "benchmark string, epoch string, item int, a double, b double")).collect()}
    assert got == {(k, e, i): pytest.approx((a, b), abs=1e-6) for k, e, told in (("x", "e1", items), ("x", "e2", items), ("y", "e5", [(1, 1.0, 0.5)])) for i, a, b in told}
