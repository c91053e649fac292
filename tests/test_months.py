"""Sums by month are the same as by SQL, and move little."""

import pytest
from pyspark.sql import functions as F

from assurelake.operators import rules, scoring, taxgap
from assurelake.plans import queries
from assurelake.plans.domain import AS_OF, BASE, PLANS, SQL, Domain, with_tables
from assurelake.sources.catalog import written


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Tables with lines without a supplier, order, flag, discount or day, and views of them."""
    path = str(tmp_path_factory.mktemp("odd"))
    for n in BASE:
        df = spark.read.parquet(f"{sf}/{n}.parquet")
        if n == "lineitem":
            changed = {"l_suppkey": 3, "l_orderkey": 5, "l_returnflag": 7, "l_linestatus": 11, "l_discount": 13, "l_shipdate": 17}
            df = df.withColumns({c: F.when(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(40)) != k, F.col(c)) for c, k in changed.items()})
        df.write.parquet(f"{path}/{n}.parquet")
        spark.read.parquet(f"{path}/{n}.parquet").createOrReplaceTempView(n)
    yield path
    for n in BASE:
        spark.catalog.dropTempView(n)


@pytest.mark.parametrize("name", sorted(PLANS.keys() & SQL.keys()))
def test_plans_give_the_rows_of_the_sql(spark, odd, name):
    ours, theirs = Domain(spark, odd)[name], spark.sql(with_tables(f"SELECT * FROM {{{name}}}"))
    assert [(f.name, f.dataType) for f in ours.schema] == [(f.name, f.dataType) for f in theirs.schema]
    assert ours.count() and ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()


def test_given_sums_are_those_of_the_rows(spark, odd):
    d = Domain(spark, odd)
    rows = {n: d[n] for n in ("invoices", "tax_returns")}  # without sums of their own
    for ours, theirs in ((rules.invoiced(d, "supplier", "taxable_amount"), rules.invoiced(rows, "supplier", "taxable_amount")), (rules.return_periods(d), rules.return_periods(rows))):
        theirs = theirs.select(*ours.columns)
        assert ours.count() and ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()


def test_comparisons_in_a_row_are_those_of_joins(spark, odd):
    d = Domain(spark, odd)
    rows = {n: d[n] for n in ("invoices", "tax_returns", "customs_declarations", "withholding_certificates")}  # without sums of their own
    low = {"minimumGap": "0", "minimumGapPercent": "0", "minimumInvoiceSales": "0", "periodGraceDays": 0}
    for find in (rules.vat_output, rules.vat_input, rules.imports, rules.withholding, rules.nil_filers):
        ours = find(d, low, AS_OF)
        theirs = find(rows, low, AS_OF).select(*ours.columns)
        assert ours.count() and ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty(), find


def test_margins_and_observations_from_sums_are_those_of_the_rows(spark, odd):
    d = Domain(spark, odd)
    rows = {n: d[n] for n in ("taxpayers", "invoices", "tax_returns", "customs_declarations", "withholding_certificates")}
    for sales in ("1", "0"):
        limits = {"minimumSales": sales, "minimumGap": "0", "minimumPeerCount": 1, "minimumMarginShortfallPercent": "0"}
        ours, theirs = rules.margins(d, limits, AS_OF), rules.margins(rows, limits, AS_OF)
        assert ours.count() and ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()
    signals = rules.run_rules(d, AS_OF, ["PAYE_RATIO_ANOMALY"])
    ours, theirs = (scoring.observations(t, signals, queries.rule_scores(d), AS_OF) for t in (d, rows))
    assert ours.count() and ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()


def test_kept_sums_are_compared_without_moving_them(spark, sf):
    """What was seen and declared in a month is in one row of the kept sums; purchases are added up for suspect suppliers only."""
    d = Domain(spark, sf)
    queries.all_signals(d)
    t = queries.months(d)
    for code in ("VAT_OUTPUT_MISMATCH", "VAT_INPUT_MISMATCH", "WHT_INCOME_MISMATCH", "NIL_FILER_ISSUING_INVOICES"):
        plan = rules.run_rules(t, AS_OF, [code])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "line_items" not in plan
    plan = rules.run_rules(t, AS_OF, ["EXPENSE_FROM_NON_COMPLIANT_SUPPLIER"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Exchange hashpartitioning")  # the last one to run comes first


def test_partial_sums_are_cents(spark, sf):
    """A decimal's buffer has a flag, isEmpty, beside 16 bytes."""
    d = Domain(spark, sf)
    codes = [c for c in rules.CODES if c.startswith(("VAT_", "NIL_", "WHT_", "IMPORT_", "PAYE_", "EXPENSE_"))]
    plan = rules.run_rules(queries.months(d), AS_OF, codes)._jdf.queryExecution().executedPlan().toString()
    assert "isEmpty" not in plan


def test_single_signals_are_moved_to_their_estimate(spark, sf):
    signals = written(queries.all_signals(Domain(spark, sf)), "signals")
    plan = taxgap.estimates(signals)._jdf.queryExecution().executedPlan().toString()
    first = plan.index("Exchange hashpartitioning")  # the last one to run comes first
    assert "collect_list" in plan[:first] and "collect_" not in plan[first:]
