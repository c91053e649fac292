"""Report views that are kept as sums and refreshed by what changed.

The state of a view has a row for each taxpayer and tax head with sums over its estimates, which can be added
and taken away; a taxpayer counts while it has an estimate. A refresh reads the parts of the estimates that came
and went since the last one, adds them up with their sign, and merges the sums by key, which rewrites only the
buckets that they fall into. How far the state has come is part of its table, so that both are published
together. Names of sectors and counties come in when the view is read, so a taxpayer that moves takes its
estimates along.

If the version that the state has come to is no longer kept, the state is made anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurelake.sources.catalog import Catalog

STATE, SOURCE = "gap_view_state", "tax_gap_estimates"
KEY = ["taxpayer_id", "tax_head"]
MONEY = ("estimated_gap", "recoverable_tax", "total_recoverable")


def _sums(rows: DataFrame) -> DataFrame:
    """Signed sums by key of rows with _change."""
    sign = F.col("_change")
    return rows.groupBy(*KEY).agg(
        F.sum(sign).cast("long").alias("estimates"),
        *[F.sum(F.coalesce(c, F.lit(0)) * sign).cast("decimal(28,2)").alias(c) for c in MONEY],
        F.sum(F.coalesce("confidence_score", F.lit(0)) * sign).cast("decimal(28,2)").alias("confidence"),
        F.sum(F.when(F.col("confidence_score").isNotNull(), sign).otherwise(0)).cast("long").alias("confident"),
    )


def refresh(catalog: Catalog, buckets: int = 32) -> int:
    """Bring the state up to the estimates; returns the number of the commit that it has come to."""
    with catalog.transaction() as t:
        state = t.table(STATE)
        t.table(SOURCE)  # a change of the estimates meanwhile is a conflict
        since = int(state.notes["until"]) if state else None
        anew = since is None or since not in catalog.commits()
        rows = catalog.read(SOURCE, t.base).withColumn("_change", F.lit(1)) if anew else catalog.changes(SOURCE, since, t.base)
        notes = {"until": str(t.base)}
        if anew:
            t.write(STATE, _sums(rows), KEY, buckets, notes)
        else:
            delta = _sums(rows)
            old = t.lookup(STATE, delta)
            summed = old.unionByName(delta).groupBy(*KEY).agg(*[F.sum(c).cast(old.schema[c].dataType).alias(c) for c in delta.columns if c not in KEY])
            t.merge(STATE, summed, KEY, (), notes)
        return t.base


def _view(state: DataFrame, taxpayers: DataFrame, column: str, name: str) -> DataFrame:
    who = taxpayers.select(F.col("id").alias("taxpayer_id"), column)
    rows = state.filter("estimates > 0").join(who, "taxpayer_id").groupBy(F.coalesce(column, F.lit("Unspecified")).alias(name), "tax_head")
    return rows.agg(
        F.sum("estimates").alias("estimates"), F.count("*").alias("taxpayers"), *[F.sum(c).cast("decimal(18,2)").alias(c) for c in MONEY],
        F.round(F.sum("confidence").cast("decimal(28,4)") / F.nullif(F.sum("confident"), F.lit(0)), 2).cast("decimal(5,2)").alias("average_confidence"),
    ).orderBy(F.desc("total_recoverable"), name, "tax_head")


def by_sector(catalog: Catalog, taxpayers: DataFrame) -> DataFrame:
    return _view(catalog.read(STATE), taxpayers, "sector_name", "sector")


def by_region(catalog: Catalog, taxpayers: DataFrame) -> DataFrame:
    return _view(catalog.read(STATE), taxpayers, "county", "region")
