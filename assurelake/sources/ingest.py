"""Ingestion: CSV and JSON files into typed tables, with row-level quarantine.

A record that lacks a required field or doesn't convert is quarantined with an issue for each field;
so is one that breaks a key or is too long for its column. Valid records go on. A file that was loaded before is
not loaded again. Rows, issues and the job's row are one commit of the catalog.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assurelake.functions.scalar import blank_to_null, stable_uuid
from assurelake.sources import quoted_csv
from assurelake.sources.catalog import Catalog, written

#: Logical types of contract columns and the Spark types that hold them.
TYPES = {"STRING": "string", "UUID": "string", "DATE": "date", "TIMESTAMP": "timestamp", "MONEY": "decimal(18,2)", "QUANTITY": "decimal(18,4)", "RATE": "decimal(8,4)", "SCORE": "decimal(5,2)", "INTEGER": "int"}
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


@dataclass(frozen=True)
class Contract:
    """Columns as name -> type, with the greatest length of a text in brackets (required ones end in !), the
    natural key, and parents as column -> table."""

    columns: dict[str, str]
    key: tuple[str, ...] = ()
    parents: dict[str, str] | None = None

    def type_of(self, c: str) -> str:
        return self.columns[c].rstrip("!").partition("(")[0]

    def length(self, c: str) -> int | None:
        found = self.columns[c].rstrip("!)").partition("(")[2]
        return int(found) if found else None

    def required(self, c: str) -> bool:
        return self.columns[c].endswith("!")


# The columns that files of each table have, their types and greatest lengths (! required)
CONTRACTS = {
    "taxpayers": Contract(
        {
            "id": "UUID!",
            "kra_pin": "STRING(40)",
            "taxpayer_type": "STRING(40)!",
            "legal_name": "STRING(240)!",
            "trading_name": "STRING(240)",
            "registration_number": "STRING(80)",
            "sector_code": "STRING(80)",
            "sector_name": "STRING(160)",
            "tax_office": "STRING(160)",
            "county": "STRING(120)",
            "status": "STRING(60)!",
            "registered_at": "DATE",
            "created_at": "TIMESTAMP!",
            "updated_at": "TIMESTAMP!",
        },
        ("kra_pin",),
    ),
    "taxpayer_identifiers": Contract(
        {
            "id": "UUID!",
            "taxpayer_id": "UUID!",
            "identifier_type": "STRING(80)!",
            "identifier_value": "STRING(200)!",
            "source": "STRING(120)",
            "confidence_score": "SCORE!",
            "created_at": "TIMESTAMP!",
        },
        ("identifier_type", "identifier_value"), {"taxpayer_id": "taxpayers"},
    ),
    "tax_obligations": Contract(
        {
            "id": "UUID!",
            "taxpayer_id": "UUID!",
            "tax_head": "STRING(80)!",
            "obligation_status": "STRING(60)!",
            "effective_from": "DATE",
            "effective_to": "DATE",
            "created_at": "TIMESTAMP!",
        },
        (), {"taxpayer_id": "taxpayers"},
    ),
    "invoices": Contract(
        {
            "id": "UUID!",
            "invoice_number": "STRING(120)!",
            "supplier_taxpayer_id": "UUID",
            "buyer_taxpayer_id": "UUID",
            "supplier_pin": "STRING(40)",
            "buyer_pin": "STRING(40)",
            "invoice_date": "DATE!",
            "invoice_type": "STRING(60)!",
            "invoice_status": "STRING(60)!",
            "taxable_amount": "MONEY!",
            "tax_amount": "MONEY!",
            "total_amount": "MONEY!",
            "currency": "STRING(10)!",
            "etims_reference": "STRING(160)",
            "source_job_id": "UUID",
            "created_at": "TIMESTAMP!",
        },
        ("invoice_number", "supplier_pin", "invoice_date"), {"supplier_taxpayer_id": "taxpayers", "buyer_taxpayer_id": "taxpayers"},
    ),
    "invoice_lines": Contract(
        {
            "id": "UUID!",
            "invoice_id": "UUID!",
            "line_number": "INTEGER!",
            "item_description": "STRING",
            "quantity": "QUANTITY",
            "unit_price": "QUANTITY",
            "taxable_amount": "MONEY",
            "tax_amount": "MONEY",
            "hs_code": "STRING(40)",
            "product_code": "STRING(80)",
        },
        (), {"invoice_id": "invoices"},
    ),
    "tax_returns": Contract(
        {
            "id": "UUID!",
            "taxpayer_id": "UUID!",
            "tax_head": "STRING(80)!",
            "period_start": "DATE!",
            "period_end": "DATE!",
            "return_reference": "STRING(120)",
            "declared_sales": "MONEY",
            "declared_income": "MONEY",
            "declared_tax_due": "MONEY",
            "declared_input_tax": "MONEY",
            "declared_output_tax": "MONEY",
            "filing_status": "STRING(60)!",
            "filed_at": "TIMESTAMP",
            "source_job_id": "UUID",
            "created_at": "TIMESTAMP!",
        },
        (), {"taxpayer_id": "taxpayers"},
    ),
    "customs_declarations": Contract(
        {
            "id": "UUID!",
            "taxpayer_id": "UUID",
            "importer_pin": "STRING(40)",
            "declaration_number": "STRING(120)!",
            "declaration_type": "STRING(80)!",
            "declaration_date": "DATE!",
            "hs_code": "STRING(40)",
            "goods_description": "STRING",
            "country_of_origin": "STRING(120)",
            "customs_value": "MONEY!",
            "duty_amount": "MONEY!",
            "vat_amount": "MONEY!",
            "total_landed_cost": "MONEY",
            "source_job_id": "UUID",
            "created_at": "TIMESTAMP!",
        },
        ("declaration_number",), {"taxpayer_id": "taxpayers"},
    ),
    "withholding_certificates": Contract(
        {
            "id": "UUID!",
            "certificate_number": "STRING(120)!",
            "payer_taxpayer_id": "UUID",
            "payee_taxpayer_id": "UUID",
            "payer_pin": "STRING(40)",
            "payee_pin": "STRING(40)",
            "certificate_date": "DATE!",
            "payment_period_start": "DATE",
            "payment_period_end": "DATE",
            "gross_amount": "MONEY!",
            "withheld_amount": "MONEY!",
            "tax_rate": "RATE",
            "source_job_id": "UUID",
            "created_at": "TIMESTAMP!",
        },
        ("certificate_number",), {"payer_taxpayer_id": "taxpayers", "payee_taxpayer_id": "taxpayers"},
    ),
    "payroll_returns": Contract(
        {
            "id": "UUID!",
            "taxpayer_id": "UUID!",
            "period_start": "DATE!",
            "period_end": "DATE!",
            "employee_count": "INTEGER",
            "gross_pay": "MONEY",
            "paye_due": "MONEY",
            "paye_paid": "MONEY",
            "filing_status": "STRING(60)!",
            "source_job_id": "UUID",
            "created_at": "TIMESTAMP!",
        },
        (), {"taxpayer_id": "taxpayers"},
    ),
    "business_permits": Contract(
        {
            "id": "UUID!",
            "taxpayer_id": "UUID",
            "permit_number": "STRING(120)!",
            "county": "STRING(120)!",
            "business_activity": "STRING(200)",
            "premises_location": "STRING(240)",
            "valid_from": "DATE",
            "valid_to": "DATE",
            "permit_fee": "MONEY",
            "permit_status": "STRING(60)!",
            "source_job_id": "UUID",
            "created_at": "TIMESTAMP!",
        },
        (), {"taxpayer_id": "taxpayers"},
    ),
    "properties": Contract(
        {
            "id": "UUID!",
            "property_reference": "STRING(120)!",
            "owner_taxpayer_id": "UUID",
            "owner_pin": "STRING(40)",
            "county": "STRING(120)",
            "location_description": "STRING(240)",
            "property_type": "STRING(80)",
            "valuation_amount": "MONEY",
            "estimated_monthly_rent": "MONEY",
            "source_job_id": "UUID",
            "created_at": "TIMESTAMP!",
        },
        ("property_reference",), {"owner_taxpayer_id": "taxpayers"},
    ),
    "payment_transactions": Contract(
        {
            "id": "UUID!",
            "transaction_reference": "STRING(160)!",
            "payer_taxpayer_id": "UUID",
            "payer_pin": "STRING(40)",
            "collecting_agency": "STRING(160)!",
            "revenue_channel": "STRING(120)!",
            "service_code": "STRING(120)",
            "payment_date": "TIMESTAMP!",
            "amount": "MONEY!",
            "currency": "STRING(10)!",
            "payment_status": "STRING(60)!",
            "provider_reference": "STRING(160)",
            "source_job_id": "UUID",
            "created_at": "TIMESTAMP!",
        },
        ("transaction_reference",), {"payer_taxpayer_id": "taxpayers"},
    ),
    "settlement_records": Contract(
        {
            "id": "UUID!",
            "settlement_reference": "STRING(160)!",
            "collecting_agency": "STRING(160)!",
            "revenue_channel": "STRING(120)!",
            "settlement_account": "STRING(160)",
            "settlement_date": "DATE!",
            "settled_amount": "MONEY!",
            "transaction_count": "INTEGER",
            "settlement_status": "STRING(60)!",
            "source_job_id": "UUID",
            "created_at": "TIMESTAMP!",
        },
        ("settlement_reference",),
    ),
}
# Fields that name a record in its issues, the first that isn't blank
REFERENCES = ("id", "invoice_number", "return_reference", "declaration_number", "certificate_number", "permit_number", "property_reference", "transaction_reference", "settlement_reference", "kra_pin")
ZERO_MONEY = ("taxable_amount", "tax_amount", "total_amount", "customs_value", "duty_amount", "vat_amount")


def contract(table: str) -> Contract:
    """The contract of a table, whatever the case of its name."""
    try:
        return CONTRACTS[table.strip().lower()]
    except KeyError:
        raise ValueError(f"no ingestible table {table!r}") from None


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Raw records, every value a text: CSV with a header (and _row), or JSON as an array or {"records": [...]}.

    A CSV row that is too short and a JSON element that is no object fail the whole file.
    """
    if path.lower().endswith(".csv"):
        return quoted_csv.scan(spark, path).records()
    if path.lower().endswith(".json"):
        rows = spark.read.option("multiLine", True).option("primitivesAsString", True).option("mode", "FAILFAST").json(path)
        if rows.columns == ["records"]:
            rows = rows.select(F.explode("records").alias("r")).select("r.*")
        return rows
    raise ValueError(f"only .csv and .json files can be ingested: {path}")


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, computed where it is read."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def with_row_numbers(raw: DataFrame, columns: list[str]) -> DataFrame:
    """raw with _row: the numbers that numbered() gave, else in the order of the partitions, with gaps."""
    for c in columns:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return raw.select(*columns, F.col("_row") if "_row" in raw.columns else (F.monotonically_increasing_id() + 1).alias("_row"))


def numbered(raw: DataFrame) -> DataFrame:
    """The records of a file with their number in it as _row, as a written table: every value is parsed here, so
    a file that can't be read fails here and nowhere later."""
    parted = F.monotonically_increasing_id()
    rows = written(raw.select(*raw.columns, F.shiftright(parted, 33).alias("_part"), parted.bitwiseAND((1 << 33) - 1).alias("_at")), "raw-records")
    counts = rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # a number a partition
    before, total = {}, 0
    for r in counts:
        before[r["_part"]], total = total, total + r["n"]
    start = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])[F.col("_part")] if before else F.lit(0)
    return rows.withColumn("_row", start + F.col("_at") + 1).drop("_part", "_at")


def default_of(c: str, kind: str, job: str, now: str) -> Column | None:
    if c == "id":
        return stable_uuid(F.concat(F.lit(f"{job}:"), F.col("_row").cast("string")))
    fixed = {"source_job_id": job, "created_at": now, "updated_at": now, "currency": "KES", "confidence_score": "100.00"}
    if c in fixed:
        return F.lit(fixed[c])
    return F.lit("0") if c in ZERO_MONEY else None


def converted(c: Column, kind: str) -> Column:
    """The typed value, null where it can't be converted."""
    if kind == "UUID":
        return F.when(c.rlike(_UUID), F.lower(c))
    return c if kind == "STRING" else c.try_cast(TYPES[kind])


def checked(raw: DataFrame, table: str, job: str, now: str) -> DataFrame:
    """Every record with the contract's types, _row, _raw, _ref and its _issues."""
    spec = contract(table)
    rows = with_row_numbers(raw, list(spec.columns))
    text, typed, problems = {}, {}, []
    for c in spec.columns:
        default = default_of(c, spec.type_of(c), job, now)
        text[c] = F.coalesce(blank_to_null(F.col(c)), default) if default is not None else blank_to_null(F.col(c))
    reference = F.coalesce(*[blank_to_null(F.col(c)) for c in REFERENCES if c in spec.columns], F.concat(F.lit("row:"), F.col("_row").cast("string")))
    rows = rows.select("_row", F.to_json(F.struct(*spec.columns)).alias("_raw"), reference.alias("_ref"), *[x.alias(c) for c, x in text.items()])
    for c in spec.columns:
        kind = spec.type_of(c)
        typed[c] = converted(F.col(c), kind)
        message = lambda code, c=c: F.struct(F.lit(c).alias("field"), F.lit(code).alias("code"))
        if spec.required(c):
            problems.append(F.when(F.col(c).isNull(), message("REQUIRED_FIELD_MISSING")))
        if kind != "STRING":
            problems.append(F.when(F.col(c).isNotNull() & typed[c].isNull(), message("INVALID_FIELD_VALUE")))
    return rows.select("_row", "_raw", "_ref", F.array_compact(F.array(*problems)).alias("_issues"), *[x.alias(c) for c, x in typed.items()])


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, issues) of checked ones."""
    issues = rows.filter(F.size("_issues") > 0).select("_row", F.col("_ref").alias("record_reference"), F.explode("_issues").alias("i"), "_raw")
    return rows.filter(F.size("_issues") == 0).drop("_issues"), issues.select("_row", "record_reference", "i.field", "i.code", F.col("_raw").alias("raw_payload"))


def validate(raw: DataFrame, table: str, job: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows with the contract's types and _row, issues)."""
    return parted(checked(raw, table, job, now))


def constrain(valid: DataFrame, table: str, existing: DataFrame | None = None, parents: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the table's constraints, issues of the others): rows with a text that is too long go first,
    of rows with equal keys in a file the first that is left stays, rows whose key is there already go, as do
    rows whose parent is missing. Null keys don't clash."""
    spec = contract(table)
    long = F.lit(False)
    for c in spec.columns:
        if spec.length(c):
            long = long | (F.coalesce(F.char_length(c), F.lit(0)) > spec.length(c))
    rows = valid.withColumn("_long", long)
    bad = F.col("_long")
    if spec.key:
        whole = F.lit(True)
        for k in spec.key:
            whole = whole & F.col(k).isNotNull()
        # rows without a whole key are each on their own, so that no window gathers them
        first = Window.partitionBy(*spec.key, F.when(~whole | F.col("_long"), F.col("_row"))).orderBy("_row")
        rows = rows.withColumn("_again", whole & (F.row_number().over(first) > 1))
        bad = bad | F.col("_again")
        if existing is not None:
            have = existing.select(*[F.col(k).alias(f"_e_{k}") for k in spec.key]).distinct().withColumn("_have", F.lit(True))
            rows = rows.join(have, [F.col(k) == F.col(f"_e_{k}") for k in spec.key], "left")
            bad = bad | F.col("_have").isNotNull()
    for c, parent in (spec.parents or {}).items():
        if parents and parent in parents:
            ids = parents[parent].select(F.col("id").alias(f"_p_{c}")).distinct()
            rows = rows.join(ids, F.col(c) == F.col(f"_p_{c}"), "left")
            bad = bad | (F.col(c).isNotNull() & F.col(f"_p_{c}").isNull())
    rows = rows.withColumn("_bad", bad)
    issues = rows.filter("_bad").select("_row", F.col("_ref").alias("record_reference"), F.lit(None).cast("string").alias("field"), F.lit("PERSISTENCE_ERROR").alias("code"), F.col("_raw").alias("raw_payload"))
    return rows.filter("NOT _bad").select(*spec.columns), issues


JOBS = "id string, source string, table_name string, file_hash string, total long, valid long, invalid long, status string, error string"
_LOADED = ("COMPLETED", "COMPLETED_WITH_ERRORS")


def ingest(spark: SparkSession, path: str, table: str, source: str, job: str, now: str, catalog: Catalog, jobs: DataFrame | None = None) -> dict:
    """Load a file into a table of the catalog; returns the job's row. jobs: earlier ones (source, table_name,
    file_hash, status), else those of the catalog. Rows, issues and the job are published together."""
    table = table.strip().lower()
    contract(table)
    row = {"id": job, "source": source, "table_name": table, "file_hash": None, "total": 0, "valid": 0, "invalid": 0, "status": "RUNNING", "error": None}

    def record(t, row: dict) -> dict:
        t.append("ingestion_jobs", spark.createDataFrame([tuple(row.values())], JOBS))
        return row

    with catalog.transaction() as t:
        if jobs is None and t.exists("ingestion_jobs"):
            jobs = t.read("ingestion_jobs")
        try:
            scan = quoted_csv.scan(spark, path) if path.lower().endswith(".csv") else None
            row["file_hash"] = scan.digest if scan else file_hash(spark, path)
            if jobs is not None and not jobs.filter((F.col("source") == source) & (F.col("table_name") == table) & (F.col("file_hash") == row["file_hash"]) & F.col("status").isin(*_LOADED)).isEmpty():
                return record(t, row | {"status": "DUPLICATE"})
            raw = scan.records() if scan else numbered(read_file(spark, path))
            total = scan.total if scan else raw.count()
        except Exception as problem:  # a file that can't be parsed is a failed job, not a crash
            issue = (None, "file", None, "FILE_PARSE_ERROR", "{}", job)
            t.append("data_quality_issues", spark.createDataFrame([issue], "_row long, record_reference string, field string, code string, raw_payload string, job_id string"))
            return record(t, row | {"status": "FAILED", "error": str(problem)[:200]})
        valid, issues = parted(written(checked(raw, table, job, now), "checked"))  # checked once for rows and issues
        parents = {p: t.read(p) for p in set((contract(table).parents or {}).values()) if t.exists(p)}
        kept, broken = constrain(valid, table, t.read(table) if t.exists(table) else None, parents)
        issues = issues.unionByName(broken).withColumn("job_id", F.lit(job))
        kept = written(kept, "records")  # before the table that it was compared with changes
        n = kept.count()
        t.append("data_quality_issues", issues)
        t.append(table, kept)
        return record(t, row | {"total": total, "valid": n, "invalid": total - n, "status": "COMPLETED" if n == total else "COMPLETED_WITH_ERRORS"})


def job_list(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc_nulls_last("started_at"), "id")


def issue_list(issues: DataFrame, job: str) -> DataFrame:
    return issues.filter(F.col("job_id") == job).orderBy("_row", F.asc_nulls_last("field"))


def register_source(sources: DataFrame | None, new: DataFrame) -> DataFrame:
    """Sources with a new one (code, name, active); codes are unique whatever their case."""
    if sources is None:
        return new
    if not sources.join(new, F.lower(sources["code"]) == F.lower(new["code"]), "left_semi").isEmpty():
        raise ValueError("a source with this code exists")
    return sources.unionByName(new).orderBy("code")
