"""Settlement matching on streams (beyond the batch jobs): payments meet settlements as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurelake.functions.scalar import PAID, SETTLED


def matched(payments: DataFrame, settlements: DataFrame, delay_days: int = 2, lateness: str = "3 days") -> DataFrame:
    """Payments with the settlements of their agency and channel within the delay. Both are streams with
    event times payment_date and settlement_time; the state is bounded by the watermarks."""
    p = payments.filter(F.upper("payment_status").isin(*PAID)).withWatermark("payment_date", lateness)
    p = p.select("transaction_reference", "amount", "payment_date", F.lower("collecting_agency").alias("a"), F.lower("revenue_channel").alias("c"))
    s = settlements.filter(F.upper("settlement_status").isin(*SETTLED)).withWatermark("settlement_time", lateness)
    s = s.select("settlement_reference", "settled_amount", "settlement_time", F.lower("collecting_agency").alias("sa"), F.lower("revenue_channel").alias("sc"))
    near = F.expr(f"a = sa AND c = sc AND settlement_time >= payment_date AND settlement_time <= payment_date + INTERVAL {delay_days} DAYS")
    return p.join(s, near).drop("sa", "sc")


def daily_totals(payments: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Paid amounts by agency, channel and day, for a stream."""
    rows = payments.filter(F.upper("payment_status").isin(*PAID)).withWatermark("payment_date", lateness)
    rows = rows.groupBy(F.window("payment_date", "1 day"), "collecting_agency", "revenue_channel").agg(F.sum("amount").cast("decimal(18,2)").alias("expected_amount"), F.count("*").alias("transaction_count"))
    return rows.select(F.to_date("window.start").alias("reconciliation_date"), "collecting_agency", "revenue_channel", "expected_amount", "transaction_count")
