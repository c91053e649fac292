"""A second run of the gap engine moves its estimates once."""

from assurelake.operators import taxgap
from assurelake.plans import jobs
from assurelake.plans.domain import Domain
from assurelake.sources.catalog import merge_by_key


def test_estimates_of_the_same_signals_are_made_once(spark, sf, monkeypatch):
    runs, make = [], taxgap.estimates
    monkeypatch.setattr(taxgap, "estimates", lambda *a: runs.append(1) or make(*a))
    est, _ = jobs.gaps_again(Domain(spark, sf))
    assert len(runs) == 1 and est.filter("deterministic_key <> 'STALE'").count() == est.count() - 1


def test_a_merge_that_keeps_nothing_joins_once(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 2, "y"), ("c", 3, "z")], "k string, v int, more string")
    new = spark.createDataFrame([("a", 10), (None, 20), ("d", 40)], "k string, v int")
    out = merge_by_key(old, new, ["k"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 10, None), ("c", 3, "z"), ("d", 40, None), (None, 20, None)]
