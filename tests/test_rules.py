"""One firing row per rule, thresholds, grace days and idempotence."""

import json
from datetime import date
from decimal import Decimal

import pytest

from assurelake.operators import rules, taxgap
from assurelake.sources.catalog import merge_by_key

AS_OF = date(2026, 3, 1)
D = Decimal
S, E = date(2025, 1, 1), date(2025, 1, 31)


@pytest.fixture(scope="module")
def tables(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    returns = [("v1", "VAT", S, E, D(50000), None, None, "FILED"), ("v2", "VAT", S, E, D(10**9), None, D(10000), "FILED"), ("i3", "INCOME_TAX", S, E, None, D(100000), None, "FILED"), ("w4", "INCOME_TAX", S, E, None, D(10000), None, "FILED"), ("n5", "VAT", S, E, D(0), None, None, "Nil"), ("r9", "RENTAL_INCOME", S, E, None, D(10000), None, "FILED")]
    returns += [(t, "INCOME_TAX", S, E, D(300000), D(x), None, "FILED") for t, x in (("m1", 3000), ("m2", 150000), ("m3", 150000))]
    names = ["v1", "v2", "i3", "w4", "n5", "r9", "m1", "m2", "m3", "p7", "dormant", "buyer"]
    sector = {"m1": "A", "m2": "A", "m3": "A"}
    inv = lambda s, b, x, t=0, day=date(2025, 1, 10), st="ISSUED": (s, b, day, st, D(x), D(t))
    invoices = [inv("v1", None, 200000), inv("v1", "v2", 500000, 80000, date(2025, 1, 11)), inv("v1", None, 999999, st="void"), inv("n5", None, 25000), inv("dormant", "buyer", 80000)]
    obligations = [(t, "VAT", "ACTIVE", None, None) for t in names if t not in ("p7", "buyer")]
    return {
        "taxpayers": df([(n, "P" + n, n, None, None, sector.get(n), sector.get(n), "N", "DORMANT" if n == "dormant" else "ACTIVE") for n in names], "id string, kra_pin string, legal_name string, trading_name string, registration_number string, sector_code string, sector_name string, county string, status string"),
        "tax_returns": df(returns, "taxpayer_id string, tax_head string, period_start date, period_end date, declared_sales decimal(18,2), declared_income decimal(18,2), declared_input_tax decimal(18,2), filing_status string"),
        "invoices": df(invoices, "supplier_taxpayer_id string, buyer_taxpayer_id string, invoice_date date, invoice_status string, taxable_amount decimal(18,2), tax_amount decimal(18,2)"),
        "customs_declarations": df([("i3", date(2025, 1, 5), D(400000), D(500000))], "taxpayer_id string, declaration_date date, customs_value decimal(18,2), total_landed_cost decimal(18,2)"),
        "withholding_certificates": df([("w4", date(2025, 1, 9), None, D(100000))], "payee_taxpayer_id string, certificate_date date, payment_period_end date, gross_amount decimal(18,2)"),
        "payroll_returns": df([("v1", S, E, D(200000), D(1000))], "taxpayer_id string, period_start date, period_end date, gross_pay decimal(18,2), paye_due decimal(18,2)"),
        "business_permits": df([("p7", "B1", S, None, D(20000), "active")], "taxpayer_id string, permit_number string, valid_from date, valid_to date, permit_fee decimal(18,2), permit_status string"),
        "tax_obligations": df(obligations, "taxpayer_id string, tax_head string, obligation_status string, effective_from date, effective_to date"),
        "properties": df([("r9", D(10000))], "owner_taxpayer_id string, estimated_monthly_rent decimal(18,2)"),
        "payment_transactions": df([("KRA", "M", date(2025, 1, 15), D(50000), "PAID")], "collecting_agency string, revenue_channel string, payment_date date, amount decimal(18,2), payment_status string"),
        "settlement_records": df([], "collecting_agency string, revenue_channel string, settlement_date date, settled_amount decimal(18,2), settlement_status string"),
    }


EXPECTED = {
    "VAT_OUTPUT_MISMATCH": 650000, "VAT_INPUT_MISMATCH": 70000, "IMPORT_TO_SALES_MISMATCH": 400000, "WHT_INCOME_MISMATCH": 90000, "NIL_FILER_ISSUING_INVOICES": 25000, "PAYE_RATIO_ANOMALY": 15000,
    "PERMIT_ACTIVE_TAX_INACTIVE": 20000, "PAYMENT_SETTLEMENT_MISMATCH": 50000, "RENTAL_INCOME_MISMATCH": 110000, "SECTOR_MARGIN_DEVIATION": 98000, "EXPENSE_FROM_NON_COMPLIANT_SUPPLIER": 80000,
}


def test_every_rule_fires_once_and_again_alike(tables):
    signals = rules.run_rules(tables, AS_OF).persist()
    got = {r.rule_code: r.estimated_gap for r in signals.collect()}
    assert signals.count() == 11
    assert got == {k: D(v) for k, v in EXPECTED.items()}
    assert merge_by_key(signals, rules.run_rules(tables, AS_OF), ["deterministic_key"]).count() == 11
    assert taxgap.source_signals(signals).first()[0] == 11


def test_thresholds_grace_and_unknown_codes(tables):
    strict = [rules.with_thresholds(r, {"minimumGap": "999999"} if r.code == "VAT_OUTPUT_MISMATCH" else None) for r in rules.RULES]
    assert rules.run_rules(tables, AS_OF, ["VAT_OUTPUT_MISMATCH"], strict).count() == 0
    assert rules.run_rules(tables, date(2025, 2, 10), ["VAT_OUTPUT_MISMATCH"]).count() == 0
    with pytest.raises(ValueError):
        rules.run_rules(tables, AS_OF, ["NO_SUCH_RULE"])


def test_gap_amounts(spark):
    kinds = [("VAT_OUTPUT_MISMATCH", "VAT", 200000), ("VAT_INPUT_MISMATCH", "VAT", 70000), ("WHT_INCOME_MISMATCH", "WITHHOLDING_TAX", -40000), ("PAYE_RATIO_ANOMALY", "PAYE", 0)]
    rows = [(f"k{i}", "t", k, h, S, E, None, D(1), D(g), D(90), "OPEN") for i, (k, h, g) in enumerate(kinds)]
    signals = spark.createDataFrame(rows, "deterministic_key string, taxpayer_id string, signal_type string, tax_head string, period_start date, period_end date, declared_amount decimal(18,2), observed_amount decimal(18,2), estimated_gap decimal(18,2), confidence_score decimal(5,2), status string")
    [one] = taxgap.estimates(signals).collect()
    assert (one.estimated_gap, one.recoverable_tax, one.declared_amount) == (D(270000), D(102000), D(0))
    [score] = taxgap.scores(taxgap.estimates(signals)).collect()
    assert score.score == D("10.20") and json.loads(score.tax_heads) == [{"taxHead": "VAT", "periodStart": "2025-01-01", "periodEnd": "2025-01-31", "estimatedRecoverableTax": 102000.0, "confidenceScore": 90.0}]
    assert [(b.signal_type, b.basis) for b in one.bases] == [("VAT_INPUT_MISMATCH", "excess input VAT"), ("VAT_OUTPUT_MISMATCH", "undeclared taxable sales")]


def test_heads_of_the_engine(tables):
    """Six estimates of eleven signals: one has no taxpayer, and those of a taxpayer, head and period are one."""
    est = taxgap.estimates(rules.run_rules(tables, AS_OF)).persist()
    heads = {r.tax_head: r.recoverable_tax for r in taxgap.summary_by_head(est).collect()}
    assert heads == {
        "VAT": D(650000) * D("0.16") + D(70000) + D(25000) * D("0.16") + D(80000) * D("0.16"), "INCOME_TAX": (D(400000) + D(20000) + D(98000)) * D("0.3"), "WITHHOLDING_TAX": D(4500), "PAYE": D(15000), "RENTAL_INCOME": D(11000),
    }
    assert {r.severity for r in rules.run_rules(tables, AS_OF, ["RENTAL_INCOME_MISMATCH"]).collect()} == {"HIGH"}
    early = taxgap.estimate_list(est, start=date(2025, 1, 2)).collect()
    assert {r.tax_head for r in early} == {"RENTAL_INCOME"} - {"RENTAL_INCOME"} or all(r.period_start >= date(2025, 1, 2) for r in early)
    amounts = [r.recoverable_tax for r in taxgap.estimate_list(est).collect()]
    assert amounts == sorted(amounts, reverse=True)
    ranked = [r.taxpayer_id for r in taxgap.ranking(taxgap.scores(est), tables["taxpayers"].filter("id <> 'v1'")).collect()]
    assert "v1" not in ranked and ranked[0] == "i3"


def test_evidence_names_rule_records_and_thresholds(tables):
    got = {r.rule_code: json.loads(r.evidence) for r in rules.run_rules(tables, AS_OF).collect()}
    assert got["VAT_OUTPUT_MISMATCH"] == {"ruleCode": "VAT_OUTPUT_MISMATCH", "invoiceCount": 2, "thresholds": {"minimumGap": "100000", "minimumGapPercent": "10", "periodGraceDays": 45}}
    assert got["PERMIT_ACTIVE_TAX_INACTIVE"]["permitNumber"] == "B1" and got["PERMIT_ACTIVE_TAX_INACTIVE"]["thresholds"]["requiredTaxHeads"] == ["VAT", "INCOME_TAX"]
    assert got["EXPENSE_FROM_NON_COMPLIANT_SUPPLIER"]["supplierTaxpayerId"] == "dormant" and got["SECTOR_MARGIN_DEVIATION"]["peerCount"] == 3


def test_one_rule_alone_is_the_same(tables):
    """Rules that share the monthly sums, and each with its own."""
    together = {tuple(r) for r in rules.run_rules(tables, AS_OF).collect()}
    assert {tuple(r) for c in rules.CODES for r in rules.run_rules(tables, AS_OF, [c]).collect()} == together


def test_rules_are_stored_and_updated(spark, tmp_path):
    from assurelake.operators import settings
    from assurelake.sources.catalog import Catalog

    cat = Catalog(spark, f"file://{tmp_path}/c")
    settings.store_rules(cat, "2024-01-01 00:00:00")
    schema = "code string, severity string, active boolean, thresholds string, seq int"
    changes = [("vat_output_mismatch ", "LOW", None, None, 1), ("VAT_OUTPUT_MISMATCH", " ", None, '{"minimumGap": "7", "other": [1]}', 2), ("NIL_FILER_ISSUING_INVOICES", None, False, None, 1)]
    settings.update_rules(cat, spark.createDataFrame(changes, schema), "2024-02-02 00:00:00")
    got = {r.code: r for r in settings.stored_rules(cat)}
    assert len(got) == 11 and not got["NIL_FILER_ISSUING_INVOICES"].active and got["NIL_FILER_ISSUING_INVOICES"].severity == "HIGH"
    changed = got["VAT_OUTPUT_MISMATCH"]
    assert (changed.severity, changed.active, changed.thresholds["minimumGap"], changed.thresholds["periodGraceDays"], changed.thresholds["other"]) == ("LOW", True, "7", 45, (1,))
    with pytest.raises(ValueError):
        settings.update_rules(cat, spark.createDataFrame([("NO_RULE", None, True, None, 1)], schema), "2024-02-02 00:00:00")
    assert cat.read(settings.RULES).filter("updated_at > '2024-02-01'").count() == 2
