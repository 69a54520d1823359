"""Rasch fits from item classes: as the whole matrix's fit, solved alone and in rounds."""

import numpy as np
import pytest

from wanescope.operators import irt


def matrix(models, items, missing, seed):
    rng = np.random.RandomState(seed)
    theta, b = rng.randn(models), rng.randn(items) * 1.5
    x = (rng.rand(models, items) < 1 / (1 + np.exp(-(theta[:, None] - b[None])))).astype(float)
    x[rng.rand(models, items) < missing] = np.nan
    return x


@pytest.mark.parametrize("most", [irt.MOST_CELLS, 0])
def test_rasch_by_classes(spark, most):
    told = {"whole": matrix(6, 300, 0.0, 1), "gaps": matrix(5, 40, 0.2, 2)}
    rows = [(k, f"m{i}", j, None if np.isnan(x[i, j]) else int(x[i, j])) for k, x in told.items() for i in range(len(x)) for j in range(x.shape[1])]
    rows += [("whole", "m0", 0, 0)]  # a repeat: the better answer counts
    r = spark.createDataFrame(rows, "benchmark string, model string, item long, correct int")
    got = {(x.benchmark, x.item): x for x in irt.rasch(r, ["benchmark"], most_cells=most).collect()}
    for k, x in told.items():
        answered = ~np.isnan(x).all(0)
        b = irt.fit_rasch(x[:, answered])[1]
        for j, want in zip(np.flatnonzero(answered), b):
            assert got[k, j].b == pytest.approx(want, abs=1e-6) and got[k, j].n_models == len(x)
    assert len(got) == sum((~np.isnan(x).all(0)).sum() for x in told.values())


def test_many_items_are_few_classes(spark):
    r = spark.range(200_000).selectExpr("'b' AS benchmark", "id AS item", "explode(array(0, 1, 2, 3)) AS k").selectExpr("benchmark", "item", "concat('m', k) AS model", "cast(pmod(xxhash64(item, k), 10) < 3 + k AS int) AS correct")
    items, cells = irt.item_classes(r, ["benchmark"])
    assert cells.count() == 4 * 5 and items.count() == 200_000
    assert irt.rasch(r, ["benchmark"]).select("b").distinct().count() == 5


def test_rasch_of_nothing(spark):
    r = spark.createDataFrame([("b", "m", 1, None)], "benchmark string, model string, item long, correct int")
    assert irt.rasch(r, ["benchmark"]).count() == 0
