"""Runs of the engines that keep their results in the catalog: each publishes all its tables together.

Estimates, results and signals are merged by their deterministic key into tables with buckets, so that a run
rewrites the buckets of its keys only, keeps id and created_at of rows that were there, and leaves
what it didn't find as it was. A second run on the same input changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurelake.functions.scalar import stable_uuid
from assurelake.operators import reconcile, taxgap
from assurelake.sources.catalog import Catalog, Transaction, dealt_by, replace_tagged, written

KEY = ["deterministic_key"]
BUCKETS = 32


def upsert(t: Transaction, name: str, rows: DataFrame, now: str, buckets: int = BUCKETS, dealt: bool = False) -> None:
    """Merge rows by their deterministic key; new ones get an id made of it and `now` as created_at. `dealt`: a new table's
    rows lie by its buckets already."""
    rows = rows.withColumns({"id": stable_uuid(F.concat(F.lit(f"{name}:"), "deterministic_key")), "created_at": F.lit(now).cast("timestamp"), "updated_at": F.lit(now).cast("timestamp")})
    if t.exists(name):
        t.merge(name, rows, KEY)
    else:
        t.write(name, rows, KEY, buckets, dealt=dealt)


def run_gaps(catalog: Catalog, signals: DataFrame, now: str) -> None:
    """Estimates of the signals and scores of all estimates, as one commit. Scores of other engines stay."""
    with catalog.transaction() as t:
        if t.exists("tax_gap_estimates"):  # the merge reads them twice
            upsert(t, "tax_gap_estimates", written(taxgap.estimates(signals), "estimates", "zstd"), now)
        else:
            upsert(t, "tax_gap_estimates", taxgap.estimates(signals, by=dealt_by(KEY, BUCKETS)), now, dealt=True)
        made = taxgap.scores(t.read("tax_gap_estimates")).withColumn("created_at", F.lit(now).cast("timestamp"))
        t.write("risk_scores", replace_tagged(t.read("risk_scores"), made, "source", taxgap.SCORE_SOURCE) if t.exists("risk_scores") else made)


def run_reconciliation(catalog: Catalog, payments: DataFrame, settlements: DataFrame, now: str) -> None:
    """Results, the signals of all results that don't match, and the results' links to them, as one commit."""
    results = written(reconcile.reconcile(payments, settlements), "reconciled")
    with catalog.transaction() as t:
        old = t.read("reconciliation_results").select(*results.columns).join(results, KEY, "left_anti") if t.exists("reconciliation_results") else results.limit(0)
        every = results.unionByName(old)  # signals are those of all results, not of this run's only
        signals = written(reconcile.signals_of(every), "recon-signals")
        upsert(t, "risk_signals", signals, now)
        upsert(t, "reconciliation_results", reconcile.link_signals(results, signals), now)
