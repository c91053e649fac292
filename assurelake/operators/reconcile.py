"""Reconciliation of collected payments with bank settlements.

Both interval conditions (within the delay, within 30 days) are answered by a sweep: days of payments and
settlements, each summed up first, are merged in order of the day, and a window of as many days looks ahead from
each day of payments. A settlement is one row whatever the number of days that it could answer, and what meets in a
window's group is bounded by the calendar: days and accounts of one agency, channel (and amount).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assurelake.functions.scalar import PAID, SETTLED, clamp, keyed

# The account that settlements should reach, and the days in which a late one is looked for
EXPECTED_ACCOUNT, LATE_DAYS = "CBK-KRA-MAIN", 30
EXCEPTIONS = ("MISSING_SETTLEMENT", "DUPLICATE_TRANSACTION", "WRONG_ACCOUNT", "DELAYED_SETTLEMENT", "PARTIAL_SETTLEMENT")
GROUP = ["collecting_agency", "revenue_channel", "reconciliation_date"]


def paid(payments: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    day = F.to_date("payment_date")
    rows = payments.filter(F.upper("payment_status").isin(*PAID)).withColumn("reconciliation_date", day)
    if start is not None:
        rows = rows.filter(day >= F.lit(start))
    if end is not None:
        rows = rows.filter(day <= F.lit(end))
    return rows


def default_window(payments: DataFrame) -> DataFrame:
    return payments.agg(F.min(F.to_date("payment_date")).alias("from_date"), F.max(F.to_date("payment_date")).alias("to_date"))


def totals(payments: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    return paid(payments, start, end).groupBy(*GROUP).agg(F.sum("amount").cast("decimal(18,2)").alias("expected_amount"), F.count("*").alias("transaction_count"))


def _settled(settlements: DataFrame, *more: str) -> DataFrame:
    """Settled amounts by agency, channel, day and account (and more columns), names in lower case."""
    rows = settlements.filter(F.upper("settlement_status").isin(*SETTLED)).dropna(subset=["settlement_date", "collecting_agency", "revenue_channel"])
    rows = rows.select(F.lower("collecting_agency").alias("_a"), F.lower("revenue_channel").alias("_c"), F.unix_date(F.to_date("settlement_date")).alias("_day"), F.col("settlement_account").alias("_account"), F.col("settled_amount").alias("_amount"))
    return rows.groupBy("_a", "_c", *more, "_day", "_account").agg(F.sum("_amount").alias("_sum"), F.count("*").alias("_n"))


def swept(days: DataFrame, events: DataFrame, keys: list[str], ahead: int, prefix: str, wrong: Column) -> DataFrame:
    """days with sums over the events of their keys from their day on to `ahead` days later: {prefix}_sum, _count,
    _account (distinct ones, in order), _wrong and _lag (days to the last). Both have keys and _day."""
    at = days.withColumn("_here", F.lit(True))
    both = at.unionByName(events.withColumn("_here", F.lit(False)), allowMissingColumns=True)
    near = Window.partitionBy(*keys).orderBy("_day").rangeBetween(0, ahead)
    event = ~F.col("_here")
    sums = {
        f"{prefix}_sum": F.sum("_sum").over(near).cast("decimal(18,2)"), f"{prefix}_count": F.coalesce(F.sum("_n").over(near), F.lit(0)),
        f"{prefix}_account": F.array_join(F.array_sort(F.collect_set("_account").over(near)), ", "), f"{prefix}_wrong": F.coalesce(F.sum(F.when(event & wrong, F.col("_n"))).over(near), F.lit(0)),
        f"{prefix}_lag": F.max(F.when(event, F.col("_day"))).over(near) - F.col("_day"),
    }
    return both.withColumns(sums).filter("_here").select(*days.columns, *sums)


def reconcile(payments: DataFrame, settlements: DataFrame, delay_days: int = 2, account: str = EXPECTED_ACCOUNT, start: date | None = None, end: date | None = None) -> DataFrame:
    """Results: every paid agency, channel and day classified, and a row for each group of duplicates."""
    delay_days = max(0, delay_days)
    base = totals(payments, start, end).withColumns({"_a": F.lower("collecting_agency"), "_c": F.lower("revenue_channel"), "_day": F.unix_date("reconciliation_date"), "_amount": F.col("expected_amount")})
    wrong = F.lower(F.coalesce("_account", F.lit(""))) != account.lower()
    rows = swept(base, _settled(settlements), ["_a", "_c"], delay_days, "on", wrong)
    # any settlement of exactly the amount in the 30 days
    rows = swept(rows, _settled(settlements, "_amount"), ["_a", "_c", "_amount"], LATE_DAYS, "all", wrong)
    for p in ("on", "all"):  # no settlement has no accounts, rather than none
        rows = rows.withColumn(f"{p}_account", F.when(F.col(f"{p}_count") > 0, F.col(f"{p}_account")))
    rows = rows.drop("_a", "_c", "_day", "_amount")
    rows = rows.fillna(0, ["on_sum", "on_count", "on_wrong", "all_sum", "all_count"])
    late = (F.col("on_count") == 0) & (F.col("all_sum") >= F.col("expected_amount"))
    status = (
        F.when((F.col("on_count") > 0) & (F.col("on_sum") < F.col("expected_amount")), "PARTIAL_SETTLEMENT")
        .when(F.col("all_count") == 0, "MISSING_SETTLEMENT")
        .when(late, "DELAYED_SETTLEMENT")
        .when(F.col("on_wrong") > 0, "WRONG_ACCOUNT")
        .otherwise("MATCHED")
    )
    pick = lambda c: F.when(late, F.col(f"all_{c}")).otherwise(F.col(f"on_{c}"))
    rows = rows.select(
        *GROUP, "expected_amount", pick("sum").cast("decimal(18,2)").alias("settled_amount"), "transaction_count", pick("count").alias("settlement_count"),
        pick("account").alias("settlement_account"), pick("lag").alias("max_lag_days"), status.alias("settlement_status"), F.lit(None).cast("string").alias("duplicate_reference"),
    )
    rows = rows.withColumn("variance_amount", (F.col("expected_amount") - F.col("settled_amount")).cast("decimal(18,2)"))
    out = rows.unionByName(duplicates(payments, start, end))
    # a second group of duplicates on one day has its reference in the key, so that keys are unique
    key = F.when(F.col("duplicate_reference").isNull(), keyed(F.lit("recon"), *map(F.col, GROUP), F.col("settlement_status"))).otherwise(
        keyed(F.lit("recon"), *map(F.col, GROUP), F.col("settlement_status"), F.col("duplicate_reference"))
    )
    names = {"expectedAmount": "expected_amount", "settledAmount": "settled_amount", "varianceAmount": "variance_amount", "settlementAccount": "settlement_account", "maxSettlementLagDays": "max_lag_days", "duplicateReference": "duplicate_reference"}
    known = [F.col(c).alias(k) for k, c in names.items()]
    evidence = F.to_json(F.struct(*known[:3], F.lit(delay_days).alias("settlementDelayDays"), F.lit(account).alias("expectedSettlementAccount"), *known[3:]))
    return out.withColumns({"deterministic_key": key, "evidence": evidence})


def duplicates(payments: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Payments of one agency, channel and day that share a reference."""
    groups = paid(payments, start, end).groupBy(*GROUP, F.coalesce("provider_reference", "transaction_reference").alias("duplicate_reference")).agg(
        F.count("*").alias("transaction_count"), F.sum("amount").cast("decimal(18,2)").alias("expected_amount"), (F.sum("amount") - F.max("amount")).cast("decimal(18,2)").alias("variance_amount")
    )
    return groups.filter("transaction_count > 1").select(
        *GROUP, "expected_amount", F.lit(0).cast("decimal(18,2)").alias("settled_amount"), "transaction_count", F.lit(0).cast("long").alias("settlement_count"),
        F.lit(None).cast("string").alias("settlement_account"), F.lit(None).cast("int").alias("max_lag_days"), F.lit("DUPLICATE_TRANSACTION").alias("settlement_status"),
        "duplicate_reference", "variance_amount",
    )


def signals_of(results: DataFrame) -> DataFrame:
    """Signals of all results that aren't matched. They have no taxpayer."""
    s = F.col("settlement_status")
    confidence = F.when(s == "MISSING_SETTLEMENT", 96).when(s == "DUPLICATE_TRANSACTION", 94).when(s == "WRONG_ACCOUNT", 92).when(s == "DELAYED_SETTLEMENT", 88).otherwise(85)
    text = F.concat(s, F.lit(" for "), F.col("collecting_agency"), F.lit(" "), F.col("revenue_channel"), F.lit(" on "), F.col("reconciliation_date").cast("string"), F.lit(", variance "), F.col("variance_amount").cast("string"))
    return results.filter(s != "MATCHED").select(
        F.concat(F.lit("reconciliation:"), "deterministic_key").alias("deterministic_key"),
        F.lit(None).cast("string").alias("taxpayer_id"),
        F.lit("PAYMENT_SETTLEMENT_MISMATCH").alias("rule_code"),
        F.lit("SETTLEMENT_RECONCILIATION").alias("signal_type"),
        F.lit("REVENUE_ASSURANCE").alias("tax_head"),
        F.col("reconciliation_date").alias("period_start"),
        F.col("reconciliation_date").alias("period_end"),
        F.col("expected_amount").alias("observed_amount"),
        F.col("settled_amount").alias("declared_amount"),
        F.abs("variance_amount").cast("decimal(18,2)").alias("estimated_gap"),
        confidence.cast("decimal(5,2)").alias("confidence_score"),
        F.when(s.isin("MISSING_SETTLEMENT", "WRONG_ACCOUNT"), "HIGH").otherwise("MEDIUM").alias("severity"),
        text.alias("explanation"),
        "evidence",
        F.lit("OPEN").alias("status"),
    )


def link_signals(results: DataFrame, signals: DataFrame) -> DataFrame:
    """results with the id (key) of their signal; null where there is none."""
    ids = signals.select(F.col("deterministic_key").alias("risk_signal_id"))
    return results.join(ids, F.col("risk_signal_id") == F.concat(F.lit("reconciliation:"), "deterministic_key"), "left")


def result_list(results: DataFrame, status: str | None = None, start: date | None = None, end: date | None = None, limit: int = 100) -> DataFrame:
    if status is not None:
        results = results.filter(F.col("settlement_status") == status)
    if start is not None:
        results = results.filter(F.col("reconciliation_date") >= F.lit(start))
    if end is not None:
        results = results.filter(F.col("reconciliation_date") <= F.lit(end))
    order = [F.desc("reconciliation_date"), F.desc(F.abs("variance_amount")), F.asc("settlement_status"), F.asc("deterministic_key")]
    return results.orderBy(*order).limit(clamp(limit, 500))


def summary(results: DataFrame) -> DataFrame:
    s = F.col("settlement_status")
    return results.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(18,2)").alias(c) for c in ("expected_amount", "settled_amount", "variance_amount")],
        *[F.count_if(s == x).alias(x.lower()) for x in ("MATCHED", "MISSING_SETTLEMENT", "DELAYED_SETTLEMENT", "WRONG_ACCOUNT", "DUPLICATE_TRANSACTION")],
    )


def exception_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("settlement_status") != "MATCHED").alias("exceptions"))


def open_cases(results: DataFrame, cases: DataFrame) -> DataFrame:
    """What opening a case for each result does: the newest case of its signal again, or a new one. Matched
    results can't have one. A settlement above what was expected is no high variance."""
    newest = Window.partitionBy("risk_signal_id").orderBy(F.desc("created_at"), F.desc("case_id"))
    known = cases.filter("risk_signal_id IS NOT NULL").withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select(F.col("risk_signal_id").alias("_s"), "case_id")
    rows = results.filter("settlement_status <> 'MATCHED'").withColumn("risk_signal_id", F.concat(F.lit("reconciliation:"), "deterministic_key"))
    high = F.col("settlement_status").isin("MISSING_SETTLEMENT", "WRONG_ACCOUNT") | (F.col("variance_amount") >= 100000)
    rows = rows.join(known, F.col("_s") == F.col("risk_signal_id"), "left")
    return rows.select("risk_signal_id", "case_id", F.col("case_id").isNull().alias("is_new"), F.when(high, "HIGH").otherwise("MEDIUM").alias("priority"), F.abs("variance_amount").alias("amount"))
