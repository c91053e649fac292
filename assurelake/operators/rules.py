"""Deterministic mismatch rules.

Each rule is a function of the domain tables, its thresholds and `as_of` that returns the flagged rows
as one common shape; run_rules() stacks the active ones into signals. The monthly rules share a
plan: both sides are aggregated to taxpayer and period first (partial sums before the shuffle), so
the join is between at most one row a key on either side. Invoices and returns, which most rules need,
are aggregated once for all of them (see Months).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assurelake.functions.scalar import PAID, SETTLED, VOID, clamp, keyed, money, month_start, total, zero
from assurelake.sources.catalog import written

Tables = Mapping[str, DataFrame]
PERIOD = ["taxpayer_id", "period_start", "period_end"]
SIGNAL_COLUMNS = [
    "deterministic_key", "taxpayer_id", "rule_code", "signal_type", "tax_head", "period_start", "period_end", "observed_amount",
    "declared_amount", "estimated_gap", "confidence_score", "severity", "explanation", "evidence", "status",
]


@dataclass(frozen=True)
class Rule:
    code: str
    tax_head: str
    severity: str
    confidence: str
    explanation: str
    find: Callable[[Tables, dict, date], DataFrame]
    thresholds: dict = field(default_factory=dict)
    #: what the evidence names: name -> column of the found rows
    evidence: dict = field(default_factory=dict)
    active: bool = True


def monthly(rows: DataFrame, day: Column, by: list[str], **sums: Column) -> DataFrame:
    """Sums by the columns `by` and the calendar month of `day`."""
    out = rows.withColumns({"period_start": month_start(day), "period_end": F.last_day(day)})
    return out.groupBy(*by, "period_start", "period_end").agg(*[total(c).alias(n) for n, c in sums.items()], F.count("*").alias("n"))


SIDES = {"supplier": "supplier_taxpayer_id", "buyer": "buyer_taxpayer_id"}


def _dated(t: Tables) -> DataFrame:
    return t["invoices"].withColumns({"period_start": month_start(F.col("invoice_date")), "period_end": F.last_day("invoice_date"), "void": F.upper("invoice_status").isin(*VOID)})


def return_periods(t: Tables) -> DataFrame:
    """Returns by taxpayer, tax head and period: sums, `returns`, their number, and whether one says nil. Tables
    whose returns have a row each have them as `period_returns`."""
    if "period_returns" in t:
        return t["period_returns"]
    sales, income = zero(F.col("declared_sales")), zero(F.col("declared_income"))
    sums = {"declared_sales": sales, "declared_income": income, "declared_input_tax": zero(F.col("declared_input_tax")), "activity": F.greatest(sales, income)}
    nil = F.coalesce(F.bool_or(F.upper("filing_status").isin("NIL", "NO_ACTIVITY")), F.lit(False))
    each = [total(c).alias(n) for n, c in sums.items()]
    return t["tax_returns"].groupBy("taxpayer_id", "tax_head", "period_start", "period_end").agg(*each, nil.alias("nil"), F.count("*").alias("returns"))


def customs_periods(t: Tables) -> DataFrame:
    """Declarations by taxpayer and month: what they are worth, `landed`, their stated cost, and `n`, their number."""
    if "customs_periods" in t:
        return t["customs_periods"]
    rows = t["customs_declarations"].filter("taxpayer_id IS NOT NULL")
    return monthly(rows, F.col("declaration_date"), ["taxpayer_id"], observed=F.coalesce("total_landed_cost", "customs_value"), landed=F.col("total_landed_cost"))


class Months(Mapping):
    """Tables with two more, `customs_periods` and `return_periods`, each written once when it is asked for, unless the
    tables have the sums themselves."""

    MADE = {"customs_periods": customs_periods, "return_periods": return_periods}
    GIVEN = {"customs_periods": "customs_periods", "return_periods": "period_returns"}

    def __init__(self, tables: Tables):
        self.tables, self.made = tables, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.MADE and name not in self.made:
            made = self.MADE[name](self.tables)
            self.made[name] = made if self.GIVEN[name] in self.tables else written(made, name, "zstd")
        return self.made[name] if name in self.MADE else self.tables[name]

    def __contains__(self, name: object) -> bool:
        return name in self.MADE or name in self.tables

    def __iter__(self):
        return iter([*self.tables, *self.MADE])

    def __len__(self) -> int:
        return len(self.tables) + len(self.MADE)


def periods_of(t: Tables) -> DataFrame:
    return t["return_periods"] if "return_periods" in t else return_periods(t)


def customs_of(t: Tables) -> DataFrame:
    return t["customs_periods"] if "customs_periods" in t else customs_periods(t)


def invoiced(t: Tables, side: str, amount: str) -> DataFrame:
    """Live invoices of a side's taxpayers by month: `observed`, their sum, and `n`, their number. Tables may have them
    as `<side>_<amount>_months`."""
    if (name := f"{side}_{amount}_months") in t:
        return t[name]
    rows = _dated(t).filter(~F.coalesce("void", F.lit(True)) & F.col(SIDES[side]).isNotNull())
    return rows.groupBy(F.col(SIDES[side]).alias("taxpayer_id"), *PERIOD[1:]).agg(total(F.col(amount)).alias("observed"), F.count("*").alias("n"))


def declared(t: Tables, heads: tuple[str, ...], amount: str) -> DataFrame:
    """What was declared by taxpayer and period, where it isn't nothing: most taxpayers state only some of the amounts."""
    rows = periods_of(t).filter(F.col("tax_head").isin(*heads) & (F.col(amount) != 0))
    return rows.groupBy(*PERIOD).agg(total(F.col(amount)).alias("declared"))


def compared(t: Tables, name: str, observed: Callable[[], DataFrame], stated: Callable[[], DataFrame]) -> DataFrame:
    """Observed months with what was declared for exactly the same period, if anything. Tables whose sums of both are in
    one row have them as `<name>_compared`."""
    if (given := f"{name}_compared") in t:
        return t[given]
    return observed().join(stated(), PERIOD, "left").withColumn("declared", zero(F.col("declared")))


def mismatch(rows: DataFrame, p: dict, as_of: date) -> DataFrame:
    """Compared months in which what was observed exceeds what was declared by both thresholds."""
    due = rows.filter(F.col("period_end") <= F.date_sub(F.lit(as_of), p["periodGraceDays"]))
    gap = F.col("observed") - F.col("declared")
    share = gap / F.greatest(F.col("declared"), F.lit(Decimal(1))) * 100
    return due.withColumn("gap", gap).filter((gap >= Decimal(p["minimumGap"])) & (share >= Decimal(p["minimumGapPercent"])))


def vat_output(t: Tables, p: dict, as_of: date) -> DataFrame:
    rows = compared(t, "vat_output", lambda: invoiced(t, "supplier", "taxable_amount"), lambda: declared(t, ("VAT",), "declared_sales"))
    return mismatch(rows, p, as_of)


def vat_input(t: Tables, p: dict, as_of: date) -> DataFrame:
    rows = compared(t, "vat_input", lambda: invoiced(t, "buyer", "tax_amount"), lambda: declared(t, ("VAT",), "declared_input_tax"))
    return mismatch(rows, p, as_of)


def imports(t: Tables, p: dict, as_of: date) -> DataFrame:
    rows = compared(t, "imports", lambda: customs_of(t).drop("landed"), lambda: declared(t, ("VAT", "INCOME_TAX"), "activity"))
    return mismatch(rows, p, as_of)


def certified(t: Tables) -> DataFrame:
    """Income of which tax was withheld, by payee and month: `observed`, the sum, and `n`, the certificates."""
    rows = t["withholding_certificates"].filter("payee_taxpayer_id IS NOT NULL").withColumn("taxpayer_id", F.col("payee_taxpayer_id"))
    return monthly(rows, F.coalesce("payment_period_end", "certificate_date"), ["taxpayer_id"], observed=F.col("gross_amount"))


def withholding(t: Tables, p: dict, as_of: date) -> DataFrame:
    return mismatch(compared(t, "withholding", lambda: certified(t), lambda: declared(t, ("INCOME_TAX",), "declared_income")), p, as_of)


def nil_sales(t: Tables) -> DataFrame:
    """Months with invoices for which a VAT return says nil or states no sales; such tables may have as `nil_filers_compared`."""
    if "nil_filers_compared" in t:
        return t["nil_filers_compared"]
    nil = periods_of(t).filter("tax_head = 'VAT' AND (declared_sales = 0 OR nil)").select(*PERIOD, F.col("declared_sales").alias("declared"))
    return invoiced(t, "supplier", "taxable_amount").join(nil, PERIOD)


def nil_filers(t: Tables, p: dict, as_of: date) -> DataFrame:
    due = (F.col("period_end") <= F.date_sub(F.lit(as_of), p["periodGraceDays"])) & (F.col("observed") >= Decimal(p["minimumInvoiceSales"]))
    return nil_sales(t).filter(due).withColumn("gap", F.col("observed"))


def paye_ratio(t: Tables, p: dict, as_of: date) -> DataFrame:
    ratio = F.lit(Decimal(p["minimumPayeToGrossRatio"]))
    rows = t["payroll_returns"].filter((F.col("gross_pay") >= Decimal(p["minimumGrossPay"])) & (F.col("gross_pay") > 0))
    rows = rows.filter(F.col("period_end") <= F.date_sub(F.lit(as_of), p["periodGraceDays"]))
    due, expected = zero(F.col("paye_due")), F.col("gross_pay") * ratio
    rows = rows.filter((due / F.col("gross_pay") < ratio) & (expected - due >= Decimal(p["minimumGap"])))
    return rows.select(*PERIOD, money(expected).alias("observed"), due.alias("declared"), money(expected - due).alias("gap"))


def permits(t: Tables, p: dict, as_of: date) -> DataFrame:
    """Active permits whose holder has no active obligation of the required heads in the permit's time."""
    today, fee = F.lit(as_of), zero(F.col("permit_fee"))
    rows = t["business_permits"].filter((F.upper("permit_status") == "ACTIVE") & F.col("taxpayer_id").isNotNull() & (fee >= Decimal(p["minimumPermitFee"])))
    rows = rows.select(
        "taxpayer_id", F.coalesce("valid_from", today).alias("period_start"), F.coalesce("valid_to", today).alias("period_end"), fee.alias("observed"), "permit_number"
    )
    heads = F.col("tax_head").isin(*p["requiredTaxHeads"]) & (F.upper("obligation_status") == "ACTIVE")
    held = t["tax_obligations"].filter(heads).select(F.col("taxpayer_id").alias("_t"), "effective_from", "effective_to")
    overlaps = (
        (F.col("taxpayer_id") == F.col("_t"))
        & (F.col("effective_from").isNull() | (F.col("effective_from") <= F.col("period_end")))
        & (F.col("effective_to").isNull() | (F.col("effective_to") >= F.col("period_start")))
    )
    rows = rows.join(held, overlaps, "left_anti")
    return rows.withColumns({"declared": money(F.lit(0)), "gap": F.col("observed"), "key_tail": keyed(F.col("taxpayer_id"), F.col("permit_number"))})


def days_of(rows: DataFrame, day: str, span: int) -> DataFrame:
    """Each row once for every day of the `span` + 1 days that end at `day`: an interval join of short
    intervals becomes a join by equality."""
    return rows.withColumn("_day", F.explode(F.sequence(F.date_sub(day, span), F.col(day))))


def settlements(t: Tables, p: dict, as_of: date) -> DataFrame:
    delay = p["settlementDelayDays"]
    paid = t["payment_transactions"].filter(F.upper("payment_status").isin(*PAID))
    paid = paid.groupBy("collecting_agency", "revenue_channel", F.to_date("payment_date").alias("period_start")).agg(F.sum("amount").cast("decimal(18,2)").alias("observed"))
    got = t["settlement_records"].filter(F.upper("settlement_status").isin(*SETTLED))
    got = days_of(got.select(F.lower("collecting_agency").alias("_a"), F.lower("revenue_channel").alias("_c"), "settlement_date", "settled_amount"), "settlement_date", delay)
    got = got.groupBy("_a", "_c", "_day").agg(F.sum("settled_amount").cast("decimal(18,2)").alias("declared"))
    on = (F.lower("collecting_agency") == F.col("_a")) & (F.lower("revenue_channel") == F.col("_c")) & (F.col("period_start") == F.col("_day"))
    rows = paid.join(got, on, "left").withColumn("declared", zero(F.col("declared"))).withColumn("gap", F.col("observed") - F.col("declared"))
    rows = rows.filter((F.col("period_start") <= F.date_sub(F.lit(as_of), delay + 1)) & (F.col("gap") >= Decimal(p["minimumGap"])))
    tail = keyed(F.lower("collecting_agency"), F.lower("revenue_channel"), F.col("period_start"))
    return rows.withColumns({"taxpayer_id": F.lit(None).cast("string"), "period_end": F.col("period_start"), "key_tail": tail})


def rental(t: Tables, p: dict, as_of: date) -> DataFrame:
    start, end = date(as_of.year - 1, 1, 1), date(as_of.year - 1, 12, 31)
    rent = zero(F.col("estimated_monthly_rent"))
    owned = t["properties"].filter(F.col("owner_taxpayer_id").isNotNull() & (rent > 0)).groupBy(F.col("owner_taxpayer_id").alias("taxpayer_id"))
    owned = owned.agg((F.sum(rent) * p["annualizationMonths"]).cast("decimal(18,2)").alias("observed"), F.count("*").alias("n"))
    said = periods_of(t).filter(F.col("tax_head").isin("INCOME_TAX", "RENTAL_INCOME") & (F.col("period_start") >= F.lit(start)) & (F.col("period_end") <= F.lit(end)))
    said = said.groupBy("taxpayer_id").agg(F.sum("declared_income").cast("decimal(18,2)").alias("declared"))
    rows = owned.join(said, "taxpayer_id", "left").withColumn("declared", zero(F.col("declared")))
    rows = rows.withColumns({"gap": F.col("observed") - F.col("declared"), "period_start": F.lit(start), "period_end": F.lit(end)})
    return rows.filter((F.col("n") >= p["minimumProperties"]) & (F.col("gap") >= Decimal(p["minimumGap"])))


def margin_periods(t: Tables) -> DataFrame:
    """Sales and income that returns for income tax and VAT state. Tables may have them added up by period, those with any."""
    return t["margin_periods"] if "margin_periods" in t else periods_of(t).filter(F.col("tax_head").isin("INCOME_TAX", "VAT"))


def margins(t: Tables, p: dict, as_of: date) -> DataFrame:
    """Taxpayers whose declared margin falls short of the average of their sector in the period. The
    averages, one row a sector and period, are aggregated by partial sums and joined back: however many
    taxpayers a sector has, no task gets them all."""
    who = t["taxpayers"].filter("sector_code IS NOT NULL").select(F.col("id").alias("taxpayer_id"), "sector_code", "sector_name")
    if Decimal(p["minimumSales"]) > 0:  # what states nothing adds nothing, and without sales there is no margin
        rows = margin_periods(t).filter("declared_sales <> 0 OR declared_income <> 0")
    else:
        rows = periods_of(t).filter(F.col("tax_head").isin("INCOME_TAX", "VAT"))
    rows = rows.join(who, "taxpayer_id")
    rows = rows.groupBy("taxpayer_id", "sector_code", "sector_name", "period_start", "period_end").agg(
        total(F.col("declared_sales")).alias("sales"), total(F.col("declared_income")).alias("declared")
    )
    rows = rows.filter(F.col("sales") >= Decimal(p["minimumSales"]))
    margin = (F.col("declared").cast("double") / F.greatest(F.col("sales"), F.lit(Decimal(1))).cast("double")).cast("decimal(20,12)")
    rows = rows.withColumn("margin", margin)
    peers = ["sector_code", "period_start", "period_end"]
    means = rows.groupBy(*peers).agg(F.count("*").alias("n"), F.sum("margin").cast("decimal(28,12)").alias("total"))
    means = means.select(*peers, "n", (F.col("total").cast("double") / F.col("n")).cast("decimal(20,12)").alias("average"))
    rows = rows.join(means, peers)
    expected = (F.col("average") * F.col("sales")).cast("decimal(38,14)")
    gap = F.round(F.greatest(expected - F.col("declared"), F.lit(Decimal(0))), 2).cast("decimal(18,2)")
    short = (F.col("average") - F.col("margin")) * 100 >= Decimal(p["minimumMarginShortfallPercent"])
    rows = rows.withColumns({"observed": F.round(expected, 2).cast("decimal(18,2)"), "gap": gap})
    return rows.filter((F.col("n") >= p["minimumPeerCount"]) & short & (F.col("gap") >= Decimal(p["minimumGap"])))


def bad_suppliers(t: Tables, p: dict, as_of: date) -> DataFrame:
    due = F.col("period_end") <= F.date_sub(F.lit(as_of), p["periodGraceDays"])
    live = _dated(t).filter(~F.col("void") & F.col("buyer_taxpayer_id").isNotNull() & F.col("supplier_taxpayer_id").isNotNull() & due)
    good = t["tax_obligations"].filter(F.col("tax_head").isin("VAT", "INCOME_TAX") & (F.upper("obligation_status") == "ACTIVE"))
    good = good.select(F.col("taxpayer_id").alias("id")).distinct().withColumn("_ok", F.lit(True))
    # suppliers are judged once each, before the purchases meet them; written, so that they go to the purchases where they are few
    suspect = t["taxpayers"].select("id", "status").join(good, "id", "left").filter(~F.upper("status").isin("ACTIVE", "REGISTERED") | F.col("_ok").isNull())
    suspect = written(suspect.select(F.col("id").alias("supplier_taxpayer_id")), "suspects")
    live = live.join(suspect, "supplier_taxpayer_id", "left_semi")
    # all keys spread the invoices of a large supplier
    rows = live.groupBy(F.col("buyer_taxpayer_id").alias("taxpayer_id"), "supplier_taxpayer_id", "period_start", "period_end").agg(total(F.col("taxable_amount")).alias("observed"), F.count("*").alias("n"))
    rows = rows.filter(F.col("observed") >= Decimal(p["minimumPurchaseAmount"]))
    tail = keyed(F.col("taxpayer_id"), F.col("supplier_taxpayer_id"), F.col("period_start"), F.col("period_end"))
    return rows.withColumns({"declared": money(F.lit(0)), "gap": F.col("observed"), "key_tail": tail})


_MONTH = {"periodGraceDays": 45}
_INVOICES = {"invoiceCount": "n"}
# Codes, tax heads, confidences and default thresholds of the rules
RULES = [
    Rule("VAT_OUTPUT_MISMATCH", "VAT", "HIGH", "95.00", "Invoiced sales exceed declared sales by ", vat_output, {"minimumGap": "100000", "minimumGapPercent": "10"} | _MONTH, _INVOICES),
    Rule("VAT_INPUT_MISMATCH", "VAT", "HIGH", "92.00", "Purchase tax exceeds declared input tax by ", vat_input, {"minimumGap": "50000", "minimumGapPercent": "10"} | _MONTH, _INVOICES),
    Rule("IMPORT_TO_SALES_MISMATCH", "INCOME_TAX", "HIGH", "90.00", "Imports exceed declared activity by ", imports, {"minimumGap": "250000", "minimumGapPercent": "15"} | _MONTH, {"declarationCount": "n"}),
    Rule("WHT_INCOME_MISMATCH", "WITHHOLDING_TAX", "MEDIUM", "88.00", "Withheld income exceeds declared income by ", withholding, {"minimumGap": "50000", "minimumGapPercent": "10"} | _MONTH, {"certificateCount": "n"}),
    Rule("NIL_FILER_ISSUING_INVOICES", "VAT", "HIGH", "96.00", "Nil filer issued invoices of ", nil_filers, {"minimumInvoiceSales": "10000"} | _MONTH, _INVOICES),
    Rule("PAYE_RATIO_ANOMALY", "PAYE", "MEDIUM", "82.00", "Payroll tax is below the expected ratio by ", paye_ratio, {"minimumGrossPay": "100000", "minimumPayeToGrossRatio": "0.08", "minimumGap": "10000"} | _MONTH),
    Rule("PERMIT_ACTIVE_TAX_INACTIVE", "INCOME_TAX", "MEDIUM", "78.00", "Active permit without an active obligation, fee ", permits, {"minimumPermitFee": "0", "requiredTaxHeads": ("VAT", "INCOME_TAX")}, {"permitNumber": "permit_number"}),
    Rule("PAYMENT_SETTLEMENT_MISMATCH", "REVENUE_ASSURANCE", "HIGH", "90.00", "Collected payments exceed settlements by ", settlements, {"minimumGap": "10000", "settlementDelayDays": 2}, {"collectingAgency": "collecting_agency", "revenueChannel": "revenue_channel"}),
    Rule("RENTAL_INCOME_MISMATCH", "RENTAL_INCOME", "HIGH", "86.00", "Estimated annual rent exceeds declared income by ", rental, {"minimumGap": "50000", "minimumProperties": 1, "annualizationMonths": 12}, {"propertyCount": "n"}),
    Rule("SECTOR_MARGIN_DEVIATION", "INCOME_TAX", "MEDIUM", "74.00", "Margin is below the sector's by ", margins, {"minimumSales": "100000", "minimumGap": "50000", "minimumPeerCount": 2, "minimumMarginShortfallPercent": "20"}, {"peerCount": "n"}),
    Rule("EXPENSE_FROM_NON_COMPLIANT_SUPPLIER", "VAT", "MEDIUM", "79.00", "Purchases from a supplier without compliance of ", bad_suppliers, {"minimumPurchaseAmount": "50000"} | _MONTH, {"supplierTaxpayerId": "supplier_taxpayer_id"} | _INVOICES),
]
CODES = tuple(sorted(r.code for r in RULES))
#: Rules that read neither invoices nor returns.
APART = ("PAYE_RATIO_ANOMALY", "PERMIT_ACTIVE_TAX_INACTIVE", "PAYMENT_SETTLEMENT_MISMATCH")


def with_thresholds(rule: Rule, thresholds: dict | None = None, severity: str | None = None, active: bool | None = None) -> Rule:
    """A partial update: what isn't given stays (thresholds are replaced one by one)."""
    return Rule(
        rule.code, rule.tax_head, severity or rule.severity, rule.confidence, rule.explanation, rule.find, rule.thresholds | (thresholds or {}), rule.evidence, rule.active if active is None else active
    )


def evidence_of(rule: Rule) -> Column:
    """What the signal rests on, as JSON: the rule, the records behind it and the thresholds."""
    plain = lambda x: F.array(*map(F.lit, x)) if isinstance(x, tuple) else F.lit(x)
    limits = F.struct(*[plain(x).alias(k) for k, x in rule.thresholds.items()])
    return F.to_json(F.struct(F.lit(rule.code).alias("ruleCode"), *[F.col(c).alias(k) for k, c in rule.evidence.items()], limits.alias("thresholds")))


def signals_of(rule: Rule, t: Tables, as_of: date) -> DataFrame:
    """The signals of one rule."""
    rows = rule.find(t, rule.thresholds, as_of)
    tail = F.col("key_tail") if "key_tail" in rows.columns else keyed(F.col("taxpayer_id"), F.col("period_start"), F.col("period_end"))
    return rows.select(
        F.concat(F.lit(rule.code + ":"), tail).alias("deterministic_key"),
        "taxpayer_id",
        F.lit(rule.code).alias("rule_code"),
        F.lit(rule.code).alias("signal_type"),
        F.lit(rule.tax_head).alias("tax_head"),
        "period_start",
        "period_end",
        money(F.col("observed")).alias("observed_amount"),
        money(F.col("declared")).alias("declared_amount"),
        money(F.col("gap")).alias("estimated_gap"),
        F.lit(Decimal(rule.confidence)).cast("decimal(5,2)").alias("confidence_score"),
        F.lit(rule.severity).alias("severity"),
        F.concat(F.lit(rule.explanation), money(F.col("gap")).cast("string")).alias("explanation"),
        evidence_of(rule).alias("evidence"),
        F.lit("OPEN").alias("status"),
    )


def run_rules(t: Tables, as_of: date, codes: list[str] | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """Signals of the active rules asked for (all by default), in the order of their codes.

    An unknown code is an error. A signal that repeats a key within a rule (two permits of one number)
    is kept once: the largest.
    """
    if unknown := set(codes or ()) - {r.code for r in rules}:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    some = [r for r in sorted(rules, key=lambda r: r.code) if r.active and (not codes or r.code in codes)]
    if sum(r.code not in APART for r in some) > 1 and "return_periods" not in t:
        t = Months(t)
    out = None
    for r in some:
        got = signals_of(r, t, as_of)
        if r.code == "PERMIT_ACTIVE_TAX_INACTIVE":
            best = F.max_by(F.struct(*[c for c in SIGNAL_COLUMNS if c != "deterministic_key"]), F.struct("estimated_gap", "period_start", "period_end")).alias("v")
            got = got.groupBy("deterministic_key").agg(best).select("deterministic_key", "v.*").select(*SIGNAL_COLUMNS)
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no active rule")
    return out


def rule_list(spark, rules: list[Rule] = RULES) -> DataFrame:
    rows = [(r.code, r.tax_head, r.severity, float(r.confidence), r.active, json.dumps(r.thresholds)) for r in rules]
    return spark.createDataFrame(rows, "code string, tax_head string, severity string, confidence double, active boolean, thresholds string").orderBy("code")


def signal_view(signals: DataFrame, taxpayers: DataFrame, code: str | None = None, taxpayer: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """Signals with their taxpayer's name, the newest first (by period, where they have no time of creation)."""
    for column, value in (("rule_code", code), ("taxpayer_id", taxpayer), ("status", status)):
        if value is not None:
            signals = signals.filter(F.col(column) == value)
    names = taxpayers.select(F.col("id").alias("taxpayer_id"), "kra_pin", "legal_name")
    newest = ["created_at"] if "created_at" in signals.columns else []
    order = [*map(F.desc_nulls_last, [*newest, "period_start"]), F.asc_nulls_last("rule_code"), F.asc_nulls_last("deterministic_key")]
    top = signals.orderBy(*order).limit(clamp(limit, 200))  # the join adds no rows: names are unique by id
    return top.join(names, "taxpayer_id", "left").orderBy(*order)
