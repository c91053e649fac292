"""Settings that jobs keep in the catalog: rules with thresholds, the rates of the gap engine, model versions.

An update changes what it states and leaves the rest: a null is no change, nor is a blank severity. Thresholds
are replaced as a whole; what the stored ones lack, the rules take from their defaults. Of several changes of
a rule in one update, the one with the greatest `seq` counts, for each field on its own.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurelake.functions.scalar import blank_to_null
from assurelake.operators import rules, scoring, taxgap
from assurelake.sources.catalog import Catalog

RULES, RATES, VERSIONS = "risk_rules", "tax_gap_rates", "model_versions"


def store_rules(catalog: Catalog, now: str, some: list[rules.Rule] = rules.RULES) -> None:
    """The rules as rows, where there are none yet."""
    if not catalog.exists(RULES):
        rows = rules.rule_list(catalog.spark, some).withColumns({"created_at": F.lit(now).cast("timestamp"), "updated_at": F.lit(now).cast("timestamp")})
        catalog.write(RULES, rows, ["code"], 1)


def update_rules(catalog: Catalog, changes: DataFrame, now: str) -> None:
    """changes: code, severity, active, thresholds (JSON) and seq. An unknown code is an error."""
    changes = changes.withColumns({"code": F.upper(F.trim("code")), "severity": blank_to_null(F.col("severity"))})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
    new = changes.groupBy("code").agg(*[last(c) for c in ("severity", "active", "thresholds")])
    with catalog.transaction() as t:
        old = t.read(RULES)
        unknown = [r.code for r in new.join(old, "code", "left_anti").limit(10).collect()]
        if unknown:
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        rows = old.join(new, "code")
        for c in ("severity", "active", "thresholds"):
            rows = rows.withColumn(c, F.coalesce(f"_{c}", c))
        t.merge(RULES, rows.withColumn("updated_at", F.lit(now).cast("timestamp")).select(*old.columns), ["code"])


def stored_rules(catalog: Catalog) -> list[rules.Rule]:
    """The rules as they are stored, for run_rules."""
    stored = {r.code: r for r in catalog.read(RULES).collect()}  # a row a rule
    out = []
    for r in rules.RULES:
        if s := stored.get(r.code):
            given = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(s.thresholds).items()}
            out.append(rules.with_thresholds(r, given, s.severity, s.active))
    return out


def store_rates(catalog: Catalog, rates: DataFrame | None = None) -> None:
    """The rates by signal type: given ones replace those that are stored, the others stay."""
    if not catalog.exists(RATES):
        catalog.write(RATES, taxgap.rate_catalog(catalog.spark), ["signal_type"], 1)
    if rates is not None:
        catalog.merge(RATES, rates, ["signal_type"])


def rate_usage(catalog: Catalog, signals: DataFrame) -> DataFrame:
    """The stored rates with the signals of their type that have a gap, and the recoverable share of those."""
    used = signals.filter("estimated_gap > 0").groupBy("signal_type").agg(F.count("*").alias("signals"), F.sum("estimated_gap").cast("decimal(18,2)").alias("estimated_gap"))
    out = catalog.read(RATES).join(used, "signal_type", "left")
    return out.withColumns({"signals": F.coalesce("signals", F.lit(0)), "estimated_gap": F.coalesce("estimated_gap", F.lit(0)).cast("decimal(18,2)")}).orderBy("signal_type")


def store_version(catalog: Catalog, version: DataFrame, now: str) -> None:
    """A model's version (model_name, version) becomes the active one; one that was there keeps its created_at."""
    new = version.withColumn("created_at", F.lit(now))
    with catalog.transaction() as t:
        if not t.exists(VERSIONS):
            t.write(VERSIONS, new.withColumn("active", F.lit(True)), ["model_name", "version"], 1)
            return
        old = t.read(VERSIONS)
        mine = old.join(new.select("model_name").distinct(), "model_name", "left_semi")
        t.merge(VERSIONS, scoring.upsert_version(mine, new), ["model_name", "version"])
