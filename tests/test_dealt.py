"""Tables with buckets whose rows lie by them already: merges and runs of the gap engine."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from assurelake.operators import runs, taxgap
from assurelake.sources import catalog as c


def test_merge_dealt_is_the_merge(spark):
    rng = random.Random(5)
    keys = [(rng.choice([None, "a", "b"]), i) for i in range(60)]
    row = lambda k, v: (*k, f"{v}{k[1]}", rng.choice([None, v]), rng.choice([None, "x"]), [k[1]])
    schema = "a string, n int, id string, created_at string, v string, l array<int>"
    old = spark.createDataFrame([row(k, "old") for k in rng.sample(keys, 35)], schema)
    new = spark.createDataFrame([row(k, "new") for k in rng.sample(keys, 35)], schema)
    for made in (new, new.drop("id"), new.drop("created_at", "v"), new.limit(0)):
        want = c.merge_by_key(old, made, ["a", "n"])
        got = c.merge_dealt(old, made, ["a", "n"], c.dealt_by(["a", "n"], 4))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_first_run_moves_signals_only(spark, tmp_path):
    """Estimates are written where they are made: one exchange, of the signals."""
    rows = [(f"K{i}", f"T{i % 7}", "VAT_OUTPUT_MISMATCH", "VAT", f"2024-0{1 + i % 3}-01", Decimal(i), Decimal(0), Decimal(i + 1), Decimal(90), "OPEN") for i in range(40)]
    signals = spark.createDataFrame(rows, "deterministic_key string, taxpayer_id string, signal_type string, tax_head string, p string, observed_amount decimal(18,2), declared_amount decimal(18,2), estimated_gap decimal(18,2), confidence_score decimal(5,2), status string")
    signals = signals.select("*", F.to_date("p").alias("period_start"), F.last_day(F.to_date("p")).alias("period_end")).drop("p")
    plain, by = taxgap.estimates(signals), taxgap.estimates(signals, by=c.dealt_by(runs.KEY, runs.BUCKETS))
    assert by._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert by.columns == plain.columns and sorted(map(str, by.collect())) == sorted(map(str, plain.collect()))
    made = c.Catalog(spark, f"file://{tmp_path}/gaps")
    for now in ("2024-01-01 00:00:00", "2024-02-02 00:00:00"):
        runs.run_gaps(made, signals.filter("taxpayer_id <> 'T3'") if "02-02" in now else signals, now)
    got = made.read("tax_gap_estimates")
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert {tuple(r) for r in got.select(F.col("taxpayer_id") == "T3", F.month("created_at"), F.month("updated_at")).distinct().collect()} == {(True, 1, 1), (False, 1, 2)}
    table = made.table("tax_gap_estimates")
    assert all(made.rows("tax_gap_estimates", table, [p]).filter(c.bucket_of(("deterministic_key",), runs.BUCKETS) != b).count() == 0 for p, b in sorted(table.parts.items())[:3])
