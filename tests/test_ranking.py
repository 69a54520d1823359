"""Places, ranks and running minima against windows, with chunks and ranges smaller than groups."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanescope.operators import ranking, stats


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.random(), 0.5, 0.25]), i) for i in range(500)] + [("c", 0.5, i) for i in range(1000, 1300)]
    return spark.createDataFrame(data, "k string, v double, id long").repartition(7)


def test_places(spark, rows):
    got = ranking.numbered(rows, ["k"], ["v", "id"], "at")
    want = rows.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")) - 1)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).withColumn("at", F.col("at").cast("long")).collect()))
    assert ranking.numbered(rows.where("false"), ["k"], ["v"], "at").count() == 0
    assert sorted(r["at"] for r in ranking.numbered(rows, [], ["v", "id"], "at").collect()) == list(range(800))


def test_average_ranks(spark, rows):
    got = {r.id: r.rank for r in ranking.average_ranks(rows, ["k"], {"v": "rank"}).collect()}
    want = {r.id: r.rank for r in rows.withColumn("rank", stats.average_rank("v", ["k"])).collect()}
    assert got == want


def test_false_discovery_rates_in_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK", 16)
    p = rows.withColumn("v", F.when(F.col("id") % 10 != 0, F.col("v")))
    got = {r.id: r.q for r in stats.benjamini_hochberg(p, "v", ["k"]).collect()}
    groups = {}
    for r in p.collect():
        groups.setdefault(r.k, []).append(r)
    for own in groups.values():
        told = sorted((r.v, r.id) for r in own if r.v is not None)
        least = 1.0
        want = {}
        for place in range(len(told), 0, -1):
            least = min(least, told[place - 1][0] * len(told) / place)
            want[told[place - 1]] = least
        for r in own:
            if r.v is None:
                assert got[r.id] is None
            else:  # equal values share their rate
                assert got[r.id] == pytest.approx(min(q for (v, _), q in want.items() if v == r.v), abs=1e-12) or got[r.id] == pytest.approx(want[r.v, r.id], abs=1e-12)


def test_t_distribution_as_an_expression(spark):
    cases = [(t, n) for t in (0.0, 0.3, -1.5, 2.228138852, 8.0, 60.0) for n in (1, 2, 3, 4, 5, 10, 25, 400)]
    d = spark.createDataFrame(cases, "t double, n long")
    got = {(r.t, r.n): r.p for r in d.withColumn("p", stats.t_two_sided_p(F.col("t"), F.col("n"))).collect()}
    assert got == {(t, n): pytest.approx(stats.t_two_sided(t, n), abs=1e-9) for t, n in cases}


@pytest.mark.parametrize("chunk", [7, 65_536])
def test_kendall_counts_inversions(spark, monkeypatch, chunk):
    """Against all pairs, with ties in both columns, chunks smaller than groups, a group of one row and a constant one."""
    monkeypatch.setattr(ranking, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [("many", i, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for i in range(200)] + [("few", i, rng.random(), rng.random()) for i in range(9)]
    rows += [("one", 0, 1.0, 2.0), ("flat", 0, 1.0, 2.0), ("flat", 1, 1.0, 3.0), (None, 0, 1.0, 2.0), (None, 1, 2.0, 1.0), ("gap", 0, None, 1.0), ("gap", 1, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "k string, id long, x double, y double").repartition(5)
    got = {r.k: (r.n, r.tau) for r in stats.kendall(d, ["k"], "x", "y", "id").collect()}
    for k in ("many", "few", "one", "flat", "gap", None):
        own = [(a, b) for q, _, a, b in rows if q == k and a is not None]
        sign = lambda v: (v > 0) - (v < 0)
        pairs = [(sign(a - c), sign(b - e)) for i, (a, b) in enumerate(own) for c, e in own[:i]]
        root = (sum(abs(p) for p, _ in pairs) * sum(abs(q) for _, q in pairs)) ** 0.5
        assert got[k] == (len(own), pytest.approx(sum(p * q for p, q in pairs) / root) if root else None)


def test_leave_one_out_by_downdating(spark):
    import numpy as np

    rng = np.random.RandomState(5)
    x, y = rng.rand(12), rng.rand(12)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert stats.leave_one_out_mae(d, [], "x", "y").first().mae == pytest.approx(stats.loo_log_mae(x[:, None], y))
