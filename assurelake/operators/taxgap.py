"""Tax-gap estimates from signals, scores and rankings."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.functions.scalar import clamp, keyed, money, zero
from assurelake.sources.catalog import merge_by_key, replace_tagged, written

# Tax head, recoverable share, penalty and interest shares, and the basis, by type of signal
RATES = [
    ("VAT_OUTPUT_MISMATCH", "VAT", "0.16", "0.05", "0.01", "undeclared taxable sales"),
    ("VAT_INPUT_MISMATCH", "VAT", "1.00", "0.05", "0.01", "excess input VAT"),
    ("IMPORT_TO_SALES_MISMATCH", "INCOME_TAX", "0.30", "0.05", "0.01", "undeclared import-backed income"),
    ("WHT_INCOME_MISMATCH", "WITHHOLDING_TAX", "0.05", "0.05", "0.01", "withholding certificate income"),
    ("NIL_FILER_ISSUING_INVOICES", "VAT", "0.16", "0.05", "0.01", "nil filer invoice sales"),
    ("PAYE_RATIO_ANOMALY", "PAYE", "1.00", "0.05", "0.01", "expected PAYE shortfall"),
    ("PERMIT_ACTIVE_TAX_INACTIVE", "INCOME_TAX", "0.30", "0.05", "0.01", "active permit exposure"),
    ("PAYMENT_SETTLEMENT_MISMATCH", "REVENUE_ASSURANCE", "1.00", "0.00", "0.00", "unsettled collected revenue"),
    ("RENTAL_INCOME_MISMATCH", "RENTAL_INCOME", "0.10", "0.05", "0.01", "undeclared rental income"),
    ("SECTOR_MARGIN_DEVIATION", "INCOME_TAX", "0.30", "0.05", "0.01", "sector margin shortfall"),
    ("EXPENSE_FROM_NON_COMPLIANT_SUPPLIER", "VAT", "0.16", "0.05", "0.01", "supplier compliance exposure"),
]
SCORE_SOURCE = "TAX_GAP_ENGINE"
KEYS = ["taxpayer_id", "tax_head", "period_start", "period_end"]


def rate_catalog(spark: SparkSession) -> DataFrame:
    """The rates as a relation: eleven rows."""
    kind = "decimal(10,4)"
    rows = spark.createDataFrame([(a, b, *map(Decimal, r), basis) for a, b, *r, basis in RATES], "signal_type string, catalog_head string, recoverable_rate decimal(10,4), penalty_rate decimal(10,4), interest_rate decimal(10,4), basis string")
    return rows.select("signal_type", "catalog_head", *[F.col(c).cast(kind) for c in ("recoverable_rate", "penalty_rate", "interest_rate")], "basis")


def _rates(signals: DataFrame, rates: DataFrame | None) -> DataFrame:
    """The rates given, or the eleven rows of the catalog."""
    return F.broadcast(rate_catalog(signals.sparkSession)) if rates is None else rates


def source_signals(signals: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """How many catalogued signals have a gap, whatever their status."""
    return signals.filter("estimated_gap > 0").join(_rates(signals, rates), "signal_type", "left_semi").agg(F.count("*").alias("source_signals"))


def normalised(signals: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Open signals of a taxpayer with a gap, with their rates; amounts are not below zero."""
    rows = signals.filter(F.col("taxpayer_id").isNotNull() & (F.col("estimated_gap") > 0) & F.col("status").isin("OPEN", "NEW"))
    rows = rows.join(_rates(signals, rates), "signal_type")
    created = F.to_date("created_at") if "created_at" in signals.columns else F.lit(None).cast("date")
    floor = F.lit(Decimal(0))
    return rows.select(
        "deterministic_key", "taxpayer_id", "signal_type", F.coalesce("tax_head", "catalog_head").alias("tax_head"),
        F.coalesce("period_start", created).alias("period_start"), F.coalesce("period_end", created).alias("period_end"),
        money(F.greatest(zero(F.col("declared_amount")), floor)).alias("declared_amount"),
        money(F.greatest(zero(F.col("observed_amount")), floor)).alias("observed_amount"),
        money(F.greatest(F.col("estimated_gap"), floor)).alias("estimated_gap"),
        "confidence_score", "recoverable_rate", "penalty_rate", "interest_rate", "basis",
    )


def _key() -> Column:
    return keyed(F.col("tax_head"), F.col("taxpayer_id"), F.col("period_start"), F.col("period_end"))


def estimates(signals: DataFrame, rates: DataFrame | None = None, by: dict[str, Column] | None = None) -> DataFrame:
    """One estimate per taxpayer, tax head and period, by the rates given (those of the catalog). With `by`, columns made
    of the estimates' deterministic_key, they lie by these."""
    # the signals of a key meet in one task anyway: single rows are less to move there than lists of them
    rows = normalised(signals, rates)
    if by is None:
        rows = rows.repartition(*KEYS)
    else:
        rows = rows.withColumnRenamed("deterministic_key", "_signal").withColumn("deterministic_key", _key()).withColumns(by)
        rows = rows.drop("deterministic_key").withColumnRenamed("_signal", "deterministic_key").repartition(*by)
    gap = F.col("estimated_gap")
    of = lambda *rates: F.sum(F.round(_product(gap, *rates), 2)).cast("decimal(18,2)")
    out = rows.groupBy(*(by or ()), *KEYS).agg(
        *[F.sum(c).cast("decimal(18,2)").alias(c) for c in ("declared_amount", "observed_amount", "estimated_gap")],
        of("recoverable_rate").alias("recoverable_tax"),
        of("recoverable_rate", "penalty_rate").alias("penalty"),
        of("recoverable_rate", "interest_rate").alias("interest"),
        F.round(F.sum("confidence_score").cast("decimal(18,4)") / F.count("confidence_score"), 2).cast("decimal(5,2)").alias("confidence_score"),
        F.count("*").alias("signal_count"),
        F.collect_list(F.struct("signal_type", "deterministic_key", "estimated_gap", "basis", "recoverable_rate")).alias("evidence"),
    )
    fields = lambda *names: F.transform("evidence", lambda e: F.struct(*[e[n].alias(n) for n in names]))
    out = out.withColumns(
        {
            "signal_types": F.sort_array(F.array_distinct(F.transform("evidence", lambda e: e["signal_type"]))),
            # one row per signal type: a period has eleven at most, whatever the number of signals
            "bases": F.sort_array(F.array_distinct(fields("signal_type", "basis", "recoverable_rate"))),
            "evidence": F.sort_array(fields("signal_type", "deterministic_key", "estimated_gap")),
        }
    )
    out = out.select(*[c for c in out.columns if c != "evidence" and c not in (by or ())], "evidence")
    total = (F.col("recoverable_tax") + F.col("penalty") + F.col("interest")).cast("decimal(18,2)")
    return out.select(_key().alias("deterministic_key"), *out.columns, total.alias("total_recoverable"))


def _product(gap, *rates: str):
    out = gap
    for r in rates:
        out = out * F.col(r)
    return out.cast("decimal(38,10)")


def scores(est: DataFrame) -> DataFrame:
    """One score per taxpayer: its recoverable tax against a million, at most 100; with its tax heads and
    periods, the most recoverable first."""
    out = est.groupBy("taxpayer_id").agg(
        F.min("period_start").alias("period_start"),
        F.max("period_end").alias("period_end"),
        *[F.sum(c).cast("decimal(18,2)").alias(c) for c in ("estimated_gap", "recoverable_tax", "total_recoverable")],
        F.round(F.sum("confidence_score").cast("decimal(18,4)") / F.count("confidence_score"), 2).cast("decimal(5,2)").alias("confidence_score"),
        F.count("*").alias("estimate_count"),
        F.collect_list(F.struct((-F.col("recoverable_tax")).alias("v"), "tax_head", "period_start", "period_end", "recoverable_tax", "confidence_score")).alias("h"),
    )
    heads = F.to_json(F.transform(F.array_sort("h"), lambda x: F.struct(*[x[c].alias(n) for c, n in (("tax_head", "taxHead"), ("period_start", "periodStart"), ("period_end", "periodEnd"), ("recoverable_tax", "estimatedRecoverableTax"), ("confidence_score", "confidenceScore"))])))
    out = out.withColumn("tax_heads", heads).drop("h")
    score = F.least(F.lit(Decimal(100)), F.round(F.col("recoverable_tax") / 10000, 2)).cast("decimal(5,2)")
    return out.withColumns({"score": score, "source": F.lit(SCORE_SOURCE)})


def refresh(signals: DataFrame, old_estimates: DataFrame | None = None, old_scores: DataFrame | None = None, made_before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(estimates, scores) after a run: estimates are merged by key, scores of this engine replaced. `made_before` are the
    written estimates of these very signals, if there are such."""
    # scores and the merge read them
    est = written(estimates(signals), "estimates", "zstd") if made_before is None else made_before
    if old_estimates is not None:
        est = merge_by_key(old_estimates, est, ["deterministic_key"])
    made = scores(est)
    return est, made if old_scores is None else replace_tagged(old_scores, made, "source", SCORE_SOURCE)


def estimate_list(est: DataFrame, head: str | None = None, taxpayer: str | None = None, start: date | None = None, end: date | None = None, limit: int = 50, taxpayers: DataFrame | None = None) -> DataFrame:
    """Estimates with the most to recover, of periods that lie within start and end; with `taxpayers`, those of
    known ones with their PIN and name."""
    if taxpayers is not None:
        est = est.join(taxpayers.select(F.col("id").alias("taxpayer_id"), "kra_pin", "legal_name"), "taxpayer_id")
    if head is not None:
        est = est.filter(F.col("tax_head") == head)
    if taxpayer is not None:
        est = est.filter(F.col("taxpayer_id") == taxpayer)
    if start is not None:
        est = est.filter(F.col("period_start") >= F.lit(start))
    if end is not None:
        est = est.filter(F.col("period_end") <= F.lit(end))
    order = [F.desc_nulls_first("recoverable_tax"), F.desc_nulls_first("confidence_score"), F.asc_nulls_last("tax_head"), F.asc_nulls_last("deterministic_key")]
    return est.orderBy(*order).limit(clamp(limit, 200))


def summary_by_head(est: DataFrame) -> DataFrame:
    return est.groupBy("tax_head").agg(
        F.countDistinct("taxpayer_id").alias("taxpayers"),
        F.count("*").alias("estimates"),
        *[F.sum(c).cast("decimal(18,2)").alias(c) for c in ("estimated_gap", "recoverable_tax", "penalty", "interest", "total_recoverable")],
        F.round(F.sum("confidence_score").cast("decimal(28,4)") / F.count("confidence_score"), 2).cast("decimal(5,2)").alias("average_confidence"),
    )


def ranking(made: DataFrame, taxpayers: DataFrame, limit: int = 20) -> DataFrame:
    """Known taxpayers by what can be recovered from them."""
    order = [F.desc_nulls_last("recoverable_tax"), F.desc_nulls_last("confidence_score"), F.desc_nulls_last("score"), F.asc_nulls_last("taxpayer_id")]
    names = taxpayers.select(F.col("id").alias("taxpayer_id"), "kra_pin", "legal_name", "sector_name", "county")
    return made.filter(F.col("source") == SCORE_SOURCE).join(names, "taxpayer_id").orderBy(*order).limit(clamp(limit, 100))
