"""Registered queries without an oracle run their operators at the default replicate counts and sizes."""

import inspect

import pytest

from wanescope.operators import resample, synth, triage
from wanescope.plans import catalog2, catalog4  # noqa: F401  adds to catalog2's queries
from wanescope.plans import halflife as H


class Seen(Exception):
    pass


@pytest.mark.parametrize(
    "query, module, operator, sizes",
    [
        ("halflife_report", H, "report", {"reps": 1000}),
        ("bootstrap_halflife", resample, "bootstrap_halflife", {"reps": 1000}),
        ("pair_bootstrap", resample, "pair_bootstrap", {"reps": 1000}),
        ("golden_bootstrap", resample, "golden_gaps", {"reps": 1000}),
        ("head_to_head", triage, "bootstrap_policies", {"reps": 2000}),
        ("permutation_flip", resample, "permutation_flip", {"reps": 10000}),
        ("bootstrap_gap_hash", resample, "bootstrap_mean", {"reps": 1000}),
        ("bootstrap_gap_models", resample, "bootstrap_mean", {"reps": 5000}),
        ("meta_regression", resample, "slope_bootstrap", {"reps": 2000}),
        ("correlation_tests", resample, "correlation_bootstrap", {"reps": 5000}),
        ("synthetic_sweep", synth, "responses", {"epochs": 20, "models": 30, "items": 500}),
    ],
)
def test_default_counts(spark, sf_dir, monkeypatch, query, module, operator, sizes):
    whole = inspect.signature(getattr(module, operator))

    def stop(*args, **kwargs):
        given = whole.bind(*args, **kwargs)
        given.apply_defaults()
        raise Seen({k: given.arguments[k] for k in sizes})

    monkeypatch.setattr(module, operator, stop)
    with pytest.raises(Seen) as seen:
        catalog2.QUERIES[query](spark, sf_dir)
    assert seen.value.args[0] == sizes


def test_few_successes_have_no_interval(spark):
    from wanescope.operators import resample

    rows = spark.createDataFrame([("a", float(i)) for i in range(49)] + [("b", float(i)) for i in range(51)], "k string, s double")
    got = {r.k: (r.n_boot, r.median, r.lo) for r in resample.interval(rows, ["k"], "s", least=50).collect()}
    assert got == {"a": (49, None, None), "b": (51, 25.0, 1.25)}
