import pytest
from oracle import connection, differences

from wanescope.plans import catalog, catalog2, catalog3, catalog4

assert catalog2.QUERIES is catalog.QUERIES is catalog3.QUERIES is catalog4.QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["benchmark", "n_quarters", "halflife", "status"]


@pytest.mark.parametrize("parts", [1, 8])
def test_partitioning_does_not_matter(spark, sf_dir, parts):
    from wanescope.operators import power, resample
    from wanescope.plans import views

    rows = views.scores(spark, sf_dir).repartition(parts)
    series = power.topk_variance(rows).orderBy("benchmark", "q").collect()
    again = resample.bootstrap_mean(rows.withColumnRenamed("benchmark", "b"), ["b"], ["eval_date", "model", "score"], "score", 5)
    total = again.selectExpr("sum(round(stat, 9))").first()[0]
    want = getattr(test_partitioning_does_not_matter, "seen", None)
    test_partitioning_does_not_matter.seen = ([(r.benchmark, r.q, round(r.value, 12)) for r in series], round(total, 6))
    assert want is None or want == test_partitioning_does_not_matter.seen
