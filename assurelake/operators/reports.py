"""Reports, return on investment and dashboard rollups."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cost of a pilot, the rate of collection taken as default, and the scenarios
PILOT_COST, COLLECTION_RATE = Decimal("18500000.00"), Decimal("0.18")
SCENARIOS = (("CONSERVATIVE", Decimal("0.08")), ("EXPECTED", Decimal("0.18")), ("STRETCH", Decimal("0.30")))


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(18,2)").alias(c)


def _gap_by(estimates: DataFrame, taxpayers: DataFrame, column: str, name: str, missing: str) -> DataFrame:
    who = taxpayers.select(F.col("id").alias("taxpayer_id"), column)
    rows = estimates.join(who, "taxpayer_id").groupBy(F.coalesce(column, F.lit(missing)).alias(name), "tax_head")
    return rows.agg(
        F.count("*").alias("estimates"), F.countDistinct("taxpayer_id").alias("taxpayers"), _total("estimated_gap"), _total("recoverable_tax"), _total("total_recoverable"),
        F.round(F.sum("confidence_score").cast("decimal(28,4)") / F.count("confidence_score"), 2).cast("decimal(5,2)").alias("average_confidence"),
    ).orderBy(F.desc("total_recoverable"), name, "tax_head")


def gap_by_sector(estimates: DataFrame, taxpayers: DataFrame) -> DataFrame:
    return _gap_by(estimates, taxpayers, "sector_name", "sector", "Unspecified")


def gap_by_region(estimates: DataFrame, taxpayers: DataFrame) -> DataFrame:
    return _gap_by(estimates, taxpayers, "county", "region", "Unspecified")


def officer_productivity(cases: DataFrame, recovery: DataFrame, as_of: date, fan_out: bool = True) -> DataFrame:
    """Cases and recoveries by officer. Each recovery of a case counts the case again, as the original
    report does; without `fan_out` recoveries are summed to the case first."""
    amounts = recovery.select(F.col("case_id").alias("id"), "assessed_amount", "agreed_amount", "collected_amount")
    if not fan_out:
        amounts = amounts.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("assessed_amount", "agreed_amount", "collected_amount")])
    age = F.datediff(F.coalesce(F.col("closed_on") if "closed_on" in cases.columns else F.lit(None).cast("date"), F.lit(as_of)), F.col("opened_on"))
    rows = cases.withColumn("_age", age).join(amounts, "id", "left").groupBy(F.coalesce("officer", F.lit("UNASSIGNED")).alias("officer"))
    closed = F.col("case_status") == "CLOSED"
    out = rows.agg(
        F.count("*").alias("assigned_cases"), F.count_if(~closed).alias("open_cases"), F.count_if(closed).alias("closed_cases"),
        *[_total(c) for c in ("assessed_amount", "agreed_amount", "collected_amount")],
        F.round(F.sum("_age").cast("decimal(20,0)") / F.count("_age"), 2).cast("decimal(10,2)").alias("average_case_age_days"),
    )
    return out.orderBy(F.desc("collected_amount"), F.desc("assigned_cases"), "officer")


def revenue_recovery(recovery: DataFrame, cases: DataFrame) -> DataFrame:
    """Recoveries of known cases by month and tax head."""
    month = F.trunc(F.coalesce("collection_date", "created_on"), "month").alias("period")
    rows = recovery.join(cases.select(F.col("id").alias("case_id")), "case_id", "left_semi").groupBy(month, F.coalesce("tax_head", F.lit("UNSPECIFIED")).alias("tax_head"))
    out = rows.agg(F.count("*").alias("recovery_records"), *[_total(c) for c in ("assessed_amount", "agreed_amount", "collected_amount")])
    return out.orderBy(F.desc("period"), F.desc("collected_amount"), "tax_head")


def audit_pipeline(cases: DataFrame, recovery: DataFrame) -> DataFrame:
    """Cases by status, once for each recovery (see officer_productivity)."""
    rows = cases.join(recovery.select(F.col("case_id").alias("id"), "assessed_amount", "collected_amount"), "id", "left").groupBy(F.col("case_status").alias("status"))
    out = rows.agg(F.count("*").alias("case_count"), *[_total(c) for c in ("estimated_recoverable", "assessed_amount", "collected_amount")])
    return out.orderBy(F.desc("case_count"), "status")


def write_csv(df: DataFrame, path: str) -> None:
    """Export sink: fields with a comma, a quote or a line break are quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def roi(estimates: DataFrame, recovery: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: what the gaps, recoveries and open cases come to against the cost of a pilot."""
    parts = [
        estimates.agg(_total("estimated_gap"), _total("recoverable_tax")),
        recovery.agg(_total("collected_amount")),
        results.filter("settlement_status <> 'MATCHED'").agg(_total("variance_amount")),
        cases.agg(F.count_if(F.col("case_status") != "CLOSED").alias("open_cases")),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(p)  # one row each
    expected = F.round(F.col("recoverable_tax") * F.lit(COLLECTION_RATE), 2).cast("decimal(18,2)")
    row = row.withColumns({"pilot_cost": F.lit(PILOT_COST).cast("decimal(18,2)"), "expected_recovery": expected})
    return row.withColumns(
        {
            "net_benefit": (F.col("expected_recovery") - F.col("pilot_cost")).cast("decimal(18,2)"),
            "roi_multiple": F.round(F.col("expected_recovery") / F.col("pilot_cost"), 4).cast("decimal(18,4)"),
            "payback_months": F.when(F.col("expected_recovery") == 0, F.lit(Decimal(0))).otherwise(F.round(F.col("pilot_cost") / F.round(F.col("expected_recovery") / 12, 8), 2)).cast("decimal(18,2)"),
        }
    )


def roi_scenarios(estimates: DataFrame) -> DataFrame:
    spark = estimates.sparkSession
    rates = spark.createDataFrame(list(SCENARIOS), "scenario string, rate decimal(4,2)")
    total = estimates.agg(_total("recoverable_tax"))
    out = rates.crossJoin(total)  # three rows and one
    return out.withColumn("expected_recovery", F.round(F.col("recoverable_tax") * F.col("rate"), 2).cast("decimal(18,2)")).drop("recoverable_tax")


def dashboard_heads(estimates: DataFrame, top: int = 8) -> DataFrame:
    """The tax heads with the most to recover."""
    rows = estimates.groupBy("tax_head").agg(_total("estimated_gap"), _total("total_recoverable"))
    return rows.orderBy(F.desc("total_recoverable"), "tax_head").limit(top)


def dashboard_totals(signals: DataFrame, scores: DataFrame, cases: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: the gap of all signals, what the scores say can be recovered, the open cases, the invalid rows of loads."""
    parts = [
        signals.agg(_total("estimated_gap")), scores.agg(_total("recoverable_tax")), cases.agg(F.count_if(F.col("case_status") != "CLOSED").alias("open_cases")),
        jobs.agg(F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid_rows")),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(p)  # one row each
    return row
