"""What several tables are made of is made once for a query."""

from assurelake.plans import jobs, queries
from assurelake.plans.domain import Domain
from assurelake.sources import catalog


def counted(monkeypatch):
    names = []
    monkeypatch.setattr("assurelake.plans.domain.written", lambda df, name: names.append(name) or catalog.written(df, name))
    return names


def test_lines_are_joined_once(spark, sf, monkeypatch):
    names, d = counted(monkeypatch), Domain(spark, sf)
    d["invoices"]  # made of the lines before they are kept
    plan = queries.all_signals(d)._jdf.queryExecution().optimizedPlan().toString()
    assert names == ["lines"] and "l_extendedprice" not in plan and "o_custkey" not in plan
    assert "l_extendedprice" not in d["invoices"]._jdf.queryExecution().optimizedPlan().toString()


def test_signals_and_estimates_are_made_once(spark, sf, monkeypatch):
    names = counted(monkeypatch)
    estimates, scores = jobs.gaps_again(Domain(spark, sf))
    assert sorted(names) == ["estimates", "lines", "signals"]
    for df in (estimates, scores):
        assert "invoice_sides" not in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and "month_start" not in plan
