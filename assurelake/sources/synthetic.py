"""Seeded synthetic tables with labelled scenarios.

All tables of the ingestion contracts come from spark.range() and hashes of (seed, table, column, row), so
the same seed gives the same rows in any run on any cluster, and every table is made where it is written.
The base rows are clean: returns declare what the invoices say, payments are settled the next day. Each
scenario adds or changes a few rows so that one rule, and only that one, has something to find; the
manifest names the scenario and its taxpayer.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.functions.scalar import month_start, stable_uuid
from assurelake.sources.ingest import CONTRACTS, TYPES

SECTORS, COUNTIES = ("RETAIL", "TRANSPORT", "FARMING", "BUILDING", "SERVICES"), ("Nairobi", "Mombasa", "Kisumu", "Nakuru", "Kiambu", "Machakos")
#: The taxpayers of the scenarios, by rule.
SCENARIOS = {
    "VAT_OUTPUT_MISMATCH": 1,
    "VAT_INPUT_MISMATCH": 2,
    "IMPORT_TO_SALES_MISMATCH": 3,
    "WHT_INCOME_MISMATCH": 4,
    "NIL_FILER_ISSUING_INVOICES": 5,
    "PAYE_RATIO_ANOMALY": 6,
    "PERMIT_ACTIVE_TAX_INACTIVE": 7,
    "PAYMENT_SETTLEMENT_MISMATCH": None,
    "RENTAL_INCOME_MISMATCH": 9,
    "SECTOR_MARGIN_DEVIATION": 10,
    "EXPENSE_FROM_NON_COMPLIANT_SUPPLIER": 14,
}
#: Further taxpayers that scenarios need: a dormant supplier, and peers of a sector.
DORMANT, PEERS, LEAST = 11, (15, 20), 21


class Synthetic:
    """The tables of one seed. `year` is the year of all records."""

    def __init__(self, spark: SparkSession, taxpayers: int = 1000, invoices: int = 5000, seed: int = 202603, year: int = 2025):
        if taxpayers < LEAST:
            raise ValueError(f"the scenarios need {LEAST} taxpayers")
        self.spark, self.n, self.rows, self.seed, self.year = spark, taxpayers, invoices, seed, year

    def pick(self, what: str, most: int, row: str = "i") -> Column:
        """A seeded number from 0 to most - 1 for each row."""
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(what), F.col(row)), F.lit(most)).cast("int")

    def key(self, table: str, row: Column) -> Column:
        return stable_uuid(F.concat_ws(":", F.lit(str(self.seed)), F.lit(table), row.cast("string")))

    def who(self, row: Column) -> Column:
        return self.key("taxpayers", row)

    def pin(self, row: Column) -> Column:
        return F.concat(F.lit("A"), F.lpad(row.cast("string"), 9, "0"), F.lit("Z"))

    def of(self, values: tuple[str, ...], index: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), index + 1)

    def day(self, what: str) -> Column:
        return F.date_add(F.lit(date(self.year, 1, 1)), self.pick(what, 365))

    def typed(self, table: str, rows: DataFrame, row: Column) -> DataFrame:
        """The rows with the contract's columns and types; what isn't given gets an id, a time or a null."""
        fixed = {"id": self.key(table, row), "created_at": F.lit(f"{self.year}-01-01"), "updated_at": F.lit(f"{self.year}-01-01"), "currency": F.lit("KES"), "confidence_score": F.lit(100)}
        spec = CONTRACTS[table]
        value = lambda c: F.col(c) if c in rows.columns else fixed.get(c, F.lit(None))
        return rows.select(*[value(c).cast(TYPES[spec.type_of(c)]).alias(c) for c in spec.columns])

    def planted(self, table: str, schema: str, *rows: tuple) -> DataFrame:
        """Rows of a scenario; their ids don't meet those of the base rows."""
        made = self.spark.createDataFrame([(-1 - i, *r) for i, r in enumerate(rows)], f"i long, {schema}")
        for name in [c for c in made.columns if c.endswith("_no")]:
            made = made.withColumn(f"{name.removesuffix('_no')}_taxpayer_id", self.who(F.col(name)))
        return made

    def taxpayers(self) -> DataFrame:
        i = F.col("i")
        sector = F.when(i.isin(SCENARIOS["SECTOR_MARGIN_DEVIATION"], *PEERS), 0).otherwise(self.pick("sector", len(SECTORS)))
        rows = self.spark.range(1, self.n + 1).withColumnRenamed("id", "i").withColumns(
            {
                "id": self.who(i), "kra_pin": self.pin(i), "taxpayer_type": F.lit("COMPANY"), "legal_name": F.concat(F.lit("Company "), i), "registration_number": F.concat(F.lit("BN-"), i),
                "sector_code": F.concat(F.lit("S"), sector), "sector_name": self.of(SECTORS, sector), "county": self.of(COUNTIES, self.pick("county", len(COUNTIES))),
                "status": F.when(i == DORMANT, "DORMANT").otherwise("ACTIVE"), "registered_at": F.lit(date(self.year - 5, 1, 1)),
            }
        )
        return self.typed("taxpayers", rows, i)

    def taxpayer_identifiers(self) -> DataFrame:
        i = F.col("i")
        rows = self.spark.range(1, self.n + 1).withColumnRenamed("id", "i").withColumns({"taxpayer_id": self.who(i), "identifier_type": F.lit("KRA_PIN"), "identifier_value": self.pin(i)})
        return self.typed("taxpayer_identifiers", rows, i)

    def tax_obligations(self) -> DataFrame:
        i = F.col("i")
        rows = self.spark.range(1, self.n + 1).withColumnRenamed("id", "i").withColumn("tax_head", F.explode(F.array(F.lit("VAT"), F.lit("INCOME_TAX"))))
        status = F.when(i == SCENARIOS["PERMIT_ACTIVE_TAX_INACTIVE"], "SUSPENDED").otherwise("ACTIVE")
        return self.typed("tax_obligations", rows.withColumns({"taxpayer_id": self.who(i), "obligation_status": status, "effective_from": F.lit(date(self.year - 5, 1, 1))}), F.concat_ws(":", i, "tax_head"))

    def _base_invoices(self) -> DataFrame:
        supplier = self.pick("supplier", self.n) + 1
        buyer = F.pmod(supplier + self.pick("buyer", self.n - 1), F.lit(self.n)) + 1
        rows = self.spark.range(self.rows).withColumnRenamed("id", "i").withColumns({"supplier": supplier, "buyer": buyer, "invoice_date": self.day("invoice"), "taxable_amount": (1000 + self.pick("amount", 4000)).cast("decimal(18,2)")})
        return rows.withColumn("tax_amount", (F.col("taxable_amount") * F.lit("0.16").cast("decimal(4,2)")).cast("decimal(18,2)"))

    def invoices(self) -> DataFrame:
        base = self._base_invoices().select("i", "supplier", "buyer", "invoice_date", "taxable_amount", "tax_amount")
        day = date(self.year, 3, 10)
        more = self.spark.createDataFrame(
            [(-1, SCENARIOS["VAT_OUTPUT_MISMATCH"], None, day, 500_000, 0), (-2, None, SCENARIOS["VAT_INPUT_MISMATCH"], day, 500_000, 80_000), (-3, SCENARIOS["NIL_FILER_ISSUING_INVOICES"], None, day, 25_000, 0),
             (-4, DORMANT, SCENARIOS["EXPENSE_FROM_NON_COMPLIANT_SUPPLIER"], day, 80_000, 12_800)],
            "i long, supplier int, buyer int, invoice_date date, taxable_amount int, tax_amount int",
        )
        rows = base.unionByName(more.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("taxable_amount", "tax_amount")}))
        for side in ("supplier", "buyer"):
            rows = rows.withColumns({f"{side}_taxpayer_id": F.when(F.col(side).isNotNull(), self.who(F.col(side))), f"{side}_pin": self.pin(F.col(side))})
        rows = rows.withColumns({"invoice_number": F.concat(F.lit("INV-"), "i"), "invoice_type": F.lit("SALE"), "invoice_status": F.lit("ISSUED"), "total_amount": F.col("taxable_amount") + F.col("tax_amount")})
        return self.typed("invoices", rows, F.col("i"))

    def invoice_lines(self) -> DataFrame:
        rows = self._base_invoices().withColumns({"invoice_id": self.key("invoices", F.col("i")), "line_number": F.lit(1), "quantity": F.lit(1), "unit_price": F.col("taxable_amount")})
        return self.typed("invoice_lines", rows, F.col("i"))

    def tax_returns(self) -> DataFrame:
        base = self._base_invoices().withColumn("period_start", month_start(F.col("invoice_date")))
        sales = base.groupBy(F.col("supplier").alias("no"), "period_start").agg(F.sum("taxable_amount").alias("declared_sales"))
        bought = base.groupBy(F.col("buyer").alias("no"), "period_start").agg(F.sum("tax_amount").alias("declared_input_tax"))
        both = sales.join(bought, ["no", "period_start"], "full").withColumn("filing_status", F.lit("FILED"))
        vat = both.withColumns({"tax_head": F.lit("VAT"), "declared_income": F.lit(None).cast("decimal(28,2)")})
        income = both.filter("declared_sales IS NOT NULL").withColumns({"tax_head": F.lit("INCOME_TAX"), "declared_income": (F.col("declared_sales") * F.lit("0.30").cast("decimal(4,2)")).cast("decimal(28,2)"), "declared_input_tax": F.lit(None).cast("decimal(28,2)")})
        start = date(self.year, 3, 1)
        margin = [(no, start, 1_000_000, None, "INCOME_TAX", int(1_000_000 * share), "FILED") for no, share in ((SCENARIOS["SECTOR_MARGIN_DEVIATION"], 0.001), *((p, 0.5) for p in PEERS))]
        nil = (SCENARIOS["NIL_FILER_ISSUING_INVOICES"], start, 0, None, "VAT", None, "NIL")
        more = self.spark.createDataFrame([*margin, nil], "no int, period_start date, declared_sales long, declared_input_tax long, tax_head string, declared_income long, filing_status string")
        rows = vat.unionByName(income).unionByName(more).withColumns({"taxpayer_id": self.who(F.col("no")), "period_end": F.last_day("period_start")})
        return self.typed("tax_returns", rows, F.concat_ws(":", "no", "tax_head", "period_start", "filing_status", "declared_sales"))

    def customs_declarations(self) -> DataFrame:
        base = self.spark.range(0, self.n, 10).select(F.col("id").alias("i"), (F.col("id") + 1).cast("int").alias("no"), F.lit(1000).alias("customs_value"))
        rows = base.unionByName(self.planted("customs_declarations", "no int, customs_value int", (SCENARIOS["IMPORT_TO_SALES_MISMATCH"], 900_000)))
        rows = rows.withColumns({"taxpayer_id": self.who(F.col("no")), "importer_pin": self.pin(F.col("no")), "declaration_number": F.concat(F.lit("D-"), "i"), "declaration_type": F.lit("IMPORT"), "declaration_date": F.lit(date(self.year, 4, 10)), "hs_code": F.concat(F.lit("HS"), F.pmod("i", F.lit(90))), "duty_amount": F.lit(0), "vat_amount": F.lit(0), "total_landed_cost": F.col("customs_value")})
        return self.typed("customs_declarations", rows, F.col("i"))

    def withholding_certificates(self) -> DataFrame:
        base = self.spark.range(0, self.n, 10).select(F.col("id").alias("i"), (F.col("id") + 1).cast("int").alias("no"), F.lit(1000).alias("gross_amount"))
        rows = base.unionByName(self.planted("withholding_certificates", "no int, gross_amount int", (SCENARIOS["WHT_INCOME_MISMATCH"], 600_000)))
        payer = F.pmod(F.col("no") + 1, F.lit(self.n)) + 1
        rows = rows.withColumns({"payee_taxpayer_id": self.who(F.col("no")), "payee_pin": self.pin(F.col("no")), "payer_taxpayer_id": self.who(payer), "payer_pin": self.pin(payer), "certificate_number": F.concat(F.lit("W-"), "i"), "certificate_date": F.lit(date(self.year, 5, 10)), "withheld_amount": F.col("gross_amount") * 0.05, "tax_rate": F.lit(0.05)})
        return self.typed("withholding_certificates", rows, F.col("i"))

    def payroll_returns(self) -> DataFrame:
        i = F.col("i")
        rows = self.spark.range(1, self.n + 1).withColumnRenamed("id", "i").withColumns({"taxpayer_id": self.who(i), "period_start": F.lit(date(self.year, 2, 1)), "period_end": F.last_day(F.lit(date(self.year, 2, 1))), "employee_count": 1 + self.pick("staff", 50), "gross_pay": F.lit(500_000), "filing_status": F.lit("FILED")})
        return self.typed("payroll_returns", rows.withColumn("paye_due", F.when(i == SCENARIOS["PAYE_RATIO_ANOMALY"], 1000).otherwise(150_000)), i)

    def business_permits(self) -> DataFrame:
        i = F.col("i")
        rows = self.spark.range(1, self.n + 1).withColumnRenamed("id", "i").withColumns({"taxpayer_id": self.who(i), "permit_number": F.concat(F.lit("BP-"), i), "county": self.of(COUNTIES, self.pick("county", len(COUNTIES))), "business_activity": F.concat(F.lit("Company "), i), "valid_from": F.lit(date(self.year, 1, 1)), "valid_to": F.lit(date(self.year, 12, 31)), "permit_fee": F.lit(20_000), "permit_status": F.lit("ACTIVE")})
        return self.typed("business_permits", rows, i)

    def properties(self) -> DataFrame:
        i = F.col("i")
        rent = F.when(i == SCENARIOS["RENTAL_INCOME_MISMATCH"], 500_000).otherwise(1000)
        rows = self.spark.range(1, self.n + 1, 3).union(self.spark.range(SCENARIOS["RENTAL_INCOME_MISMATCH"], SCENARIOS["RENTAL_INCOME_MISMATCH"] + 1)).distinct().withColumnRenamed("id", "i")
        rows = rows.withColumns({"property_reference": F.concat(F.lit("PR-"), i), "owner_taxpayer_id": self.who(i), "owner_pin": self.pin(i), "county": self.of(COUNTIES, self.pick("county", len(COUNTIES))), "estimated_monthly_rent": rent})
        return self.typed("properties", rows, i)

    def _paid(self) -> DataFrame:
        no = self.pick("payer", self.n) + 1
        rows = self.spark.range(self.rows).withColumnRenamed("id", "i").withColumns({"no": no, "payment_day": self.day("payment"), "collecting_agency": F.concat(F.lit("AGENCY-"), self.pick("agency", 3)), "revenue_channel": F.concat(F.lit("CHANNEL-"), self.pick("channel", 3)), "amount": 100 + self.pick("paid", 900)})
        return rows

    def payment_transactions(self) -> DataFrame:
        more = self.planted("payment_transactions", "no int, payment_day date, collecting_agency string, revenue_channel string, amount int", (1, date(self.year, 6, 10), "AGENCY-LOST", "CHANNEL-LOST", 50_000))
        rows = self._paid().unionByName(more.select("i", "no", "payment_day", "collecting_agency", "revenue_channel", "amount"))
        rows = rows.withColumns({"transaction_reference": F.concat(F.lit("TX-"), "i"), "payer_taxpayer_id": self.who(F.col("no")), "payer_pin": self.pin(F.col("no")), "payment_date": F.col("payment_day").cast("timestamp"), "payment_status": F.lit("PAID")})
        return self.typed("payment_transactions", rows, F.col("i"))

    def settlement_records(self) -> DataFrame:
        rows = self._paid().groupBy("collecting_agency", "revenue_channel", "payment_day").agg(F.sum("amount").alias("settled_amount"), F.count("*").alias("transaction_count"))
        name = F.concat_ws("-", F.lit("ST"), "collecting_agency", "revenue_channel", "payment_day")
        rows = rows.withColumns({"settlement_reference": name, "settlement_account": F.lit("CBK-KRA-MAIN"), "settlement_date": F.date_add("payment_day", 1), "settlement_status": F.lit("SETTLED")})
        return self.typed("settlement_records", rows, F.col("settlement_reference"))

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t)() for t in CONTRACTS}

    def manifest(self) -> DataFrame:
        """(scenario, taxpayer_id): what the rules should find. Unsettled payments have no taxpayer."""
        rows = self.spark.createDataFrame(list(SCENARIOS.items()), "scenario string, no int")
        return rows.select("scenario", F.when(F.col("no").isNotNull(), self.who(F.col("no"))).alias("taxpayer_id"))

    def write(self, folder: str) -> None:
        """Every table, and the manifest, as CSV files with a header in a folder of its name."""
        for name, df in (self.tables() | {"manifest": self.manifest()}).items():
            df.write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
