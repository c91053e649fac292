from decimal import ROUND_HALF_UP, Decimal
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from assurelake.operators import scoring
from assurelake.plans import jobs, queries
from assurelake.sources import ingest
from assurelake.sources.catalog import Catalog


def test_ingest_csv_twice(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("kra_pin,taxpayer_type,legal_name,status,registered_at\nA1,COMPANY, Alpha ,ACTIVE,2020-01-01\nA1,COMPANY,Again,ACTIVE,\nA2,COMPANY,,ACTIVE,\nA3,COMPANY,Gamma,ACTIVE,not-a-date\n,COMPANY,NoPin,ACTIVE,\n,COMPANY,NoPin2,ACTIVE,\n")
    cat = Catalog(spark, f"file://{tmp_path}/cat")
    job = ingest.ingest(spark, str(path), "Taxpayers", "src", "00000000-0000-0000-0000-000000000001", "2024-01-01 00:00:00", cat)
    assert (job["status"], job["total"], job["valid"], job["invalid"]) == ("COMPLETED_WITH_ERRORS", 6, 3, 3)
    codes = sorted((r.record_reference, r.field, r.code) for r in cat.read("data_quality_issues").collect() if r.field)
    assert codes == [("A2", "legal_name", "REQUIRED_FIELD_MISSING"), ("A3", "registered_at", "INVALID_FIELD_VALUE")]
    jobs = spark.createDataFrame([(job["source"], job["table_name"], job["file_hash"], job["status"])], "source string, table_name string, file_hash string, status string")
    assert ingest.ingest(spark, str(path), "Taxpayers", "src", "j2", "2024-01-01 00:00:00", cat, jobs)["status"] == "DUPLICATE"
    assert cat.read("taxpayers").filter("legal_name = 'Alpha' AND id IS NOT NULL").count() == 1


def test_ingest_json_and_bad_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"records": [{"kra_pin": "B1", "taxpayer_type": "X", "legal_name": "Beta", "status": "ACTIVE"}]}')
    valid, issues = ingest.validate(ingest.read_file(spark, str(tmp_path / "t.json")), "taxpayers", "j", "2024-01-01 00:00:00")
    assert valid.count() == 1 and issues.count() == 0
    (tmp_path / "short.csv").write_text("kra_pin,legal_name\nA\n")
    assert ingest.ingest(spark, str(tmp_path / "short.csv"), "taxpayers", "s", "j", "2024-01-01 00:00:00", Catalog(spark, f"file://{tmp_path}/c"))["status"] == "FAILED"
    (tmp_path / "bad.json").write_text('[{"kra_pin": ')
    assert ingest.ingest(spark, str(tmp_path / "bad.json"), "taxpayers", "s", "j", "2024-01-01 00:00:00", Catalog(spark, f"file://{tmp_path}/c"))["status"] == "FAILED"
    with pytest.raises(ValueError):
        ingest.contract("nope")
    with pytest.raises(ValueError):
        ingest.read_file(spark, "x.xlsx")


def test_catalog_versions(spark, tmp_path):
    cat = Catalog(spark, f"file://{tmp_path}/c2")
    cat.write("t", spark.createDataFrame([(1, "a")], "k int, v string"))
    cat.merge("t", spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"])
    cat.append("t", cat.read("t").filter("k = 2"))
    assert sorted((r.k, r.v) for r in cat.read("t").collect()) == [(1, "b"), (2, "c"), (2, "c")]
    parts = lambda: {p.name for p in (tmp_path / "c2/t/parts").iterdir() if not p.name.startswith(".")}
    before = parts()
    cat.append("t", spark.createDataFrame([("d", 3)], "v string, k int"))
    assert len(parts() - before) == 1 and before <= parts() and cat.read("t").count() == 4  # an append leaves the others alone
    with pytest.raises(KeyError):
        cat.read("none")


def test_references_and_row_numbers(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("".join(["kra_pin,taxpayer_type,legal_name,status\n", "K1,X,,ACTIVE\n", ",X,\"A, \"\"B\"\"\",ACTIVE\n", ",X,,ACTIVE\n"]))
    cat = Catalog(spark, f"file://{tmp_path}/c3")
    assert ingest.ingest(spark, str(path), "taxpayers", "s", "j", "2024-01-01 00:00:00", cat)["invalid"] == 2
    assert {r.record_reference for r in cat.read("data_quality_issues").collect()} == {"K1", "row:3"}
    assert [r.legal_name for r in cat.read("taxpayers").collect()] == ['A, "B"']
    raw = spark.createDataFrame([("i", "T", "P", "R")], "id string, transaction_reference string, kra_pin string, return_reference string")
    assert ingest.validate(raw, "payment_transactions", "j", "2024-01-01 00:00:00")[1].first().record_reference == "i"
    assert ingest.validate(raw.drop("id"), "payment_transactions", "j", "2024-01-01 00:00:00")[1].first().record_reference == "T"


def shapley_by_hand(tree, row, features):
    """Over all subsets of the features: known ones follow the row, others the training rows."""
    feature, split, left, length, cover = tree

    def value(known, at=0):
        f = feature[at]
        if f < 0:
            return length[at]
        a, b = left[at], left[at] + 1
        if f in known:
            return value(known, b if row[f] > split[at] else a)
        return (cover[a] * value(known, a) + cover[b] * value(known, b)) / cover[at]

    out = np.zeros(features)
    for i in range(features):
        others = [f for f in range(features) if f != i]
        for size in range(features):
            for known in combinations(others, size):
                out[i] += (value({*known, i}) - value(set(known))) * factorial(size) * factorial(features - size - 1) / factorial(features)
    return out


def test_shapley_values_by_hand(spark):
    """Against all subsets of features; they sum to the path length less the training rows' mean."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 4)).round(1)
    forest = [scoring.grow(x[i * 30 : i * 30 + 30], np.random.default_rng(i), 5) for i in range(3)] + [scoring.grow(x[:1], rng, 3), scoring.grow(x[:40] * 0, rng, 3)]
    explainer = scoring.Explainer(forest, 4)
    got = explainer.values(x)
    want = np.array([sum(shapley_by_hand(t, r, 4) for t in forest) / len(forest) for r in x])
    assert np.abs(got - want).max() < 1e-5
    mean = sum(scoring.paths(t, x) for t in forest) / len(forest)
    assert np.abs(got.sum(axis=1) - (mean - explainer.base)).max() < 1e-5
    rows = spark.range(500).select(F.concat(F.lit("t"), "id").alias("taxpayer_id"), *[(F.pmod(F.col("id") * (i + 3), F.lit(17 + i)) / 3.0).alias(c) for i, c in enumerate(scoring.FEATURES)]).persist()
    forest = scoring.grown_forest(rows, 8, 64)
    for r in scoring.explained(rows, forest).limit(20).collect():
        x = rows.filter(F.col("taxpayer_id") == r.taxpayer_id).select(*scoring.FEATURES).first()
        assert np.allclose([r[c] for c in scoring.FEATURES], sum(shapley_by_hand(t, list(x), 8) for t in forest) / 8, atol=1e-5)
        assert abs(sum(r[c] for c in scoring.FEATURES) - (r.path_length - r.base_length)) < 1e-5


def test_forest_by_hand(spark):
    """Path lengths against a walk down each tree, and samples against the smallest hashes of all."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)).round(1)
    tree = scoring.grow(x[:64], np.random.default_rng(2), 6)
    feature, split, left, length, cover = tree
    for row, path in zip(x, scoring.paths(tree, x), strict=True):
        at = 0
        while feature[at] >= 0:
            at = left[at] + (row[feature[at]] > split[at])
        assert path == length[at]
    assert abs(length[0] - scoring.paths(tree, x[:64]).mean()) < 1e-9 and cover[0] == 64
    rows = spark.range(2000).select(F.concat(F.lit("t"), "id").alias("taxpayer_id"), *[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(scoring.FEATURES)]).persist()
    samples = scoring.tree_samples(rows, 5, 32, 42, "taxpayer_id")
    assert [len(s) for s in samples] == [32] * 5
    for t, s in enumerate(samples):
        h = rows.select(scoring.FEATURES[0], F.pmod(F.xxhash64(F.lit(42), F.lit(t), "taxpayer_id"), F.lit(1 << 30)).alias("h")).orderBy("h").limit(32).collect()
        assert sorted(s[:, 0]) == sorted(r[0] for r in h)


def test_anomaly_scores_highest(spark):
    schema = "taxpayer_id string, sector_name string, declared_sales decimal(18,2), declared_income decimal(18,2), invoice_sales decimal(18,2), customs_landed_cost decimal(18,2), withholding_income decimal(18,2), risk_signal_gap decimal(18,2), rule_score decimal(5,2), return_count long, invoice_count long, customs_count long, withholding_count long, open_signal_count long"
    from decimal import Decimal as D

    rows = [("normal", "Retail", *map(D, (100000, 100000, 110000, 10000, 5000, 0, 10)), 1, 1, 1, 1, 0), ("anomaly", "Retail", *map(D, (100000, 100000, 900000, 700000, 250000, 500000, 80)), 1, 1, 1, 1, 1)]
    out = scoring.predict(spark.createDataFrame(rows, schema)).orderBy("combined_score", ascending=False).collect()
    assert out[0].taxpayer_id == "anomaly" and out[0].combined_score == D("93.00")
    assert "invoiceSalesExceedDeclaredSales" in out[0].main_features
    assert set(out[0].forest_contributions) == set(scoring.LABELS.values()) and all(v >= 0 for v in out[0].forest_contributions.values())
    assert scoring.predict(spark.createDataFrame([], schema)).count() == 0


def test_percentiles_of_common_values(spark):
    """Against counting; a third and more of the rows have no footprint, and many values are equal."""
    rng = np.random.default_rng(5)
    sectors = ["A", "B", None]
    rows = [(f"t{i:04d}", sectors[i % 7 % 3], float(rng.choice([0, 0, 0, 5, 5.5, i, 2 * i]))) for i in range(1500)]
    df = spark.createDataFrame(rows, "taxpayer_id string, sector_name string, x double")
    zero = {c: F.lit(0).cast("decimal(18,2)") for c in ("customs_landed_cost", "withholding_income", "risk_signal_gap")}
    obs = df.withColumn("invoice_sales", F.col("x").cast("decimal(18,2)")).withColumns(zero)
    got = {r.taxpayer_id: (float(r.all_percentile), float(r.sector_percentile)) for r in scoring.percentiles(obs).collect()}

    def share(x, among):
        return float((Decimal(100 * sum(y <= x for y in among)) / len(among)).quantize(Decimal("0.01"), ROUND_HALF_UP))

    every = [x for *_, x in rows]
    assert got == {i: (share(x, every), share(x, [y for _, z, y in rows if z == s])) for i, s, x in rows}
    assert scoring.percentiles(obs.limit(0)).count() == 0


SMALL = [
    "rule_vat_output_mismatch", "rule_expense_from_non_compliant_supplier", "gap_scores", "gap_taxpayer_ranking", "recon_results", "er_run_summary", "graph_county_permits", "graph_import_activity",
    "graph_neighbourhood", "profile_all", "case_recoverable", "integration_redaction", "ingest_constraints", "ingest_csv_job", "ingest_csv_rows", "ingest_csv_issues", "ml_model_version", "ml_dashboard",
]


@pytest.mark.parametrize("name", SMALL)
def test_queries_agree_with_sql(spark, sf, name):
    assert jobs.QUERIES is queries.QUERIES
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    rel = con.sql(queries.ORACLE[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    want = sorted(repr([dict(zip(rel.columns, r, strict=True))[c] for c in order]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == want


def test_streams(spark, tmp_path):
    from assurelake.streaming import settlements

    schema = "transaction_reference string, collecting_agency string, revenue_channel string, payment_date timestamp, amount decimal(18,2), payment_status string"
    spark.sql("SELECT 't' AS transaction_reference, 'A' AS collecting_agency, 'C' AS revenue_channel, TIMESTAMP '2024-01-01 10:00:00' AS payment_date, CAST(5 AS DECIMAL(18,2)) AS amount, 'PAID' AS payment_status").write.parquet(f"{tmp_path}/in")
    q = settlements.daily_totals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("totals").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("totals").count() == 1
