"""Taxpayer profiles: counts and totals of everything linked to a taxpayer, for all taxpayers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name of the count, table, column of the taxpayer, and the money column that is totalled with it
PARTS = [
    ("supplier_invoices", "invoices", "supplier_taxpayer_id", "total_amount"),
    ("buyer_invoices", "invoices", "buyer_taxpayer_id", "total_amount"),
    ("tax_returns", "tax_returns", "taxpayer_id", "declared_sales"),
    ("customs_declarations", "customs_declarations", "taxpayer_id", "customs_value"),
    ("wht_as_payer", "withholding_certificates", "payer_taxpayer_id", None),
    ("wht_as_payee", "withholding_certificates", "payee_taxpayer_id", None),
    ("permits", "business_permits", "taxpayer_id", None),
    ("properties", "properties", "owner_taxpayer_id", None),
    ("payments", "payment_transactions", "payer_taxpayer_id", "amount"),
]


def profiles(tables, taxpayer: str | None = None) -> DataFrame:
    """A row per taxpayer (or the one asked for): identity, nine counts and five totals. Every table is
    aggregated to the taxpayer before it is joined, so no join adds rows."""
    out = tables["taxpayers"].select("id", "kra_pin", "legal_name", "county", "status")
    if taxpayer is not None:
        out = out.filter(F.col("id") == taxpayer)
    zeros: list[str] = []
    for name, table, who, money in PARTS:
        rows = tables[table].filter(F.col(who).isNotNull())
        if taxpayer is not None:
            rows = rows.filter(F.col(who) == taxpayer)
        sums = [F.sum(money).cast("decimal(18,2)").alias(f"{name}_total")] if money else []
        out = out.join(rows.groupBy(F.col(who).alias("id")).agg(F.count("*").alias(name), *sums), "id", "left")
        zeros += [name] + ([f"{name}_total"] if money else [])
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast(out.schema[c].dataType)) for c in zeros})


def identifier_list(identifiers: DataFrame, taxpayer: str) -> DataFrame:
    return identifiers.filter(F.col("taxpayer_id") == taxpayer).orderBy("identifier_type", "identifier_value")


def relationships(rel: DataFrame, taxpayer: str) -> DataFrame:
    """Relationships of a taxpayer in either direction, the surest first."""
    out = rel.filter(F.col("source_taxpayer_id") == taxpayer).select(F.lit("OUTGOING").alias("direction"), F.col("target_taxpayer_id").alias("other"), "relationship_type", "confidence_score")
    into = rel.filter(F.col("target_taxpayer_id") == taxpayer).select(F.lit("INCOMING").alias("direction"), F.col("source_taxpayer_id").alias("other"), "relationship_type", "confidence_score")
    return out.unionByName(into).orderBy(F.desc_nulls_last("confidence_score"), "direction", "other")
