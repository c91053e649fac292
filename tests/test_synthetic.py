from datetime import date

import pytest

from assurelake.operators import rules
from assurelake.sources import ingest, synthetic
from assurelake.sources.catalog import Catalog


@pytest.fixture(scope="module")
def made(spark):
    return synthetic.Synthetic(spark, taxpayers=40, invoices=200)


def test_rules_find_the_scenarios_and_nothing_else(made):
    signals = rules.run_rules({n: t.persist() for n, t in made.tables().items()}, date(2026, 3, 1))
    found = {(r.rule_code, r.taxpayer_id) for r in signals.select("rule_code", "taxpayer_id").collect()}
    assert found == {tuple(r) for r in made.manifest().collect()} and len(found) == 11


def test_same_seed_same_rows(spark, made):
    again, other = synthetic.Synthetic(spark, taxpayers=40, invoices=200), synthetic.Synthetic(spark, taxpayers=40, invoices=200, seed=1)
    rows = lambda s: sorted(map(repr, s.invoices().collect()))
    assert rows(made) == rows(again) != rows(other)
    with pytest.raises(ValueError):
        synthetic.Synthetic(spark, taxpayers=5)


def test_files_are_ingested_whole(spark, made, tmp_path):
    made.write(f"file://{tmp_path}/files")
    cat = Catalog(spark, f"file://{tmp_path}/tables")
    path = max((tmp_path / "files/invoices").glob("*.csv"), key=lambda p: p.stat().st_size)
    job = ingest.ingest(spark, f"file://{path}", "invoices", "s", "00000000-0000-0000-0000-000000000001", "2025-01-01 00:00:00", cat)
    assert job["status"] == "COMPLETED" and job["valid"] == cat.read("invoices").count() == len(path.read_text().splitlines()) - 1
