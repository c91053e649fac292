"""Queries of the jobs that load, merge and append, with their SQL equivalents."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurelake.operators import cases, governance, graph, name_index, reconcile, reports, rules, runs, scoring, settings, taxgap, views
from assurelake.plans import rule_sql
from assurelake.plans.domain import Domain
from assurelake.plans.queries import CANDIDATES_SQL, EDGES, ER, GAP, INT, ML, QUERIES, RECON, _RATES, _jobs, _sources, all_signals, gap_estimates, kept_signals, obs, query, recon, rule_scores
from assurelake.sources import ingest
from assurelake.sources.catalog import Catalog, insert_if_absent, merge_by_key, noted, work_dir, written

__all__ = ["QUERIES"]

# files: customers as records of taxpayers, some broken, in a file of their own

_RECORDS = """SELECT CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('A', c_custkey % 400) END AS kra_pin, 'INDIVIDUAL' AS taxpayer_type, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat(c_name, ', "', c_mktsegment, '"') END AS legal_name,
  'ACTIVE' AS status, CASE WHEN c_custkey % 17 = 0 THEN 'not-a-date' ELSE '2020-01-01' END AS registered_at, c_name AS tax_office FROM {customer}"""
_OKAY = "legal_name IS NOT NULL AND try_cast(registered_at AS DATE) IS NOT NULL"
_NOW = "2024-01-01 00:00:00"


def new_catalog(d: Domain, name: str) -> Catalog:
    return Catalog(d.spark, noted(f"{work_dir(d.spark)}/{name}-{uuid.uuid4().hex}"))


def loaded(d: Domain) -> tuple[dict, Catalog]:
    """A job that loads a CSV file of the records, and the catalog that it loads into."""
    folder = noted(f"{work_dir(d.spark)}/ingest-{uuid.uuid4().hex}")
    d.spark.sql(_RECORDS, customer=d["customer"]).coalesce(1).write.option("header", True).option("escape", '"').csv(f"{folder}/in")  # one file
    catalog = Catalog(d.spark, f"{folder}/tables")
    path = d.spark.read.text(f"{folder}/in").inputFiles()[0]
    return ingest.ingest(d.spark, path, "Taxpayers", "SRC-1", "00000000-0000-0000-0000-000000000001", _NOW, catalog), catalog


def job_row(d: Domain) -> DataFrame:
    job, _ = loaded(d)
    return d.spark.createDataFrame([(job["source"], job["table_name"], job["total"], job["valid"], job["invalid"], job["status"])], "source string, table_name string, total long, valid long, invalid long, status string")


_FIRST = f"SELECT kra_pin, count(*) AS n FROM {{raw}} WHERE {_OKAY} AND kra_pin IS NOT NULL GROUP BY 1"
query(
    "ingest_csv_job",
    f"SELECT 'SRC-1' AS source, 'taxpayers' AS table_name, count(*) AS total, CAST(count(*) FILTER (WHERE {_OKAY}) - (SELECT coalesce(sum(n - 1), 0) FROM {{firsts}}) AS BIGINT) AS valid, CAST(count(*) - count(*) FILTER (WHERE {_OKAY}) + (SELECT coalesce(sum(n - 1), 0) FROM {{firsts}}) AS BIGINT) AS invalid, CASE WHEN count(*) = count(*) FILTER (WHERE {_OKAY}) THEN 'COMPLETED' ELSE 'COMPLETED_WITH_ERRORS' END AS status FROM {{raw}}",
    raw=_RECORDS, firsts=_FIRST,
)(job_row)
query(
    "ingest_csv_rows",
    f"SELECT kra_pin, legal_name, tax_office, CAST(registered_at AS DATE) AS registered_at, CAST(TIMESTAMP '{_NOW}' AS VARCHAR) AS created_at, TRUE AS has_id FROM (SELECT *, row_number() OVER (PARTITION BY kra_pin ORDER BY tax_office) AS again FROM {{raw}} WHERE {_OKAY}) WHERE kra_pin IS NULL OR again = 1",
    raw=_RECORDS,
)(lambda d: loaded(d)[1].read("taxpayers").select("kra_pin", "legal_name", "tax_office", "registered_at", F.col("created_at").cast("string").alias("created_at"), F.col("id").isNotNull().alias("has_id")))
query(
    "ingest_csv_issues",
    f"""SELECT * FROM (SELECT coalesce(kra_pin, 'row:' || CAST(1 + CAST(replace(tax_office, 'Customer#', '') AS INT) AS VARCHAR)) AS record_reference, 'legal_name' AS field, 'REQUIRED_FIELD_MISSING' AS code FROM {{raw}} WHERE legal_name IS NULL
    UNION ALL SELECT coalesce(kra_pin, 'row:' || CAST(1 + CAST(replace(tax_office, 'Customer#', '') AS INT) AS VARCHAR)), 'registered_at', 'INVALID_FIELD_VALUE' FROM {{raw}} WHERE try_cast(registered_at AS DATE) IS NULL
    UNION ALL SELECT kra_pin, NULL, 'PERSISTENCE_ERROR' FROM (SELECT *, row_number() OVER (PARTITION BY kra_pin ORDER BY tax_office) AS again FROM {{raw}} WHERE {_OKAY}) WHERE kra_pin IS NOT NULL AND again > 1)""",
    raw=_RECORDS,
)(lambda d: loaded(d)[1].read("data_quality_issues").select("record_reference", "field", "code"))
# records whose names hold line breaks, quotes and commas, some too long, as the export sink writes them
_BROKEN = """SELECT concat('B', c_custkey) AS kra_pin, 'COMPANY' AS taxpayer_type, CASE WHEN c_custkey % 50 = 7 THEN repeat('n', 241) WHEN c_custkey % 3 = 0 THEN concat(c_name, chr(10), 'c/o "', c_mktsegment, '",', chr(10), chr(10), 'Ltd') ELSE c_name END AS legal_name,
  CASE WHEN c_custkey % 50 = 11 THEN repeat('s', 61) ELSE 'ACTIVE' END AS status FROM {customer}"""


def round_trip(d: Domain) -> Catalog:
    """The records exported and ingested again, in a catalog."""
    folder = noted(f"{work_dir(d.spark)}/round-trip-{uuid.uuid4().hex}")
    reports.write_csv(d.spark.sql(_BROKEN, customer=d["customer"]).coalesce(1), f"{folder}/export")
    catalog = Catalog(d.spark, f"{folder}/tables")
    path = d.spark.read.format("binaryFile").load(f"{folder}/export").select("path").first()[0]  # the one file
    ingest.ingest(d.spark, path, "taxpayers", "SRC-2", "00000000-0000-0000-0000-000000000002", _NOW, catalog)
    return catalog


query("ingest_quoted_rows", "SELECT kra_pin, legal_name, status FROM {broken} WHERE length(legal_name) <= 240 AND length(status) <= 60", broken=_BROKEN)(lambda d: round_trip(d).read("taxpayers").select("kra_pin", "legal_name", "status"))
query(
    "ingest_quoted_issues",
    "SELECT kra_pin AS record_reference, 'PERSISTENCE_ERROR' AS code, legal_name FROM {broken} WHERE length(legal_name) > 240 OR length(status) > 60",
    broken=_BROKEN,
)(lambda d: round_trip(d).read("data_quality_issues").select("record_reference", "code", F.get_json_object("raw_payload", "$.legal_name").alias("legal_name")))
query("ingest_quoted_jobs", "SELECT 'taxpayers' AS table_name, count(*) AS total, count(*) FILTER (WHERE length(legal_name) <= 240 AND length(status) <= 60) AS valid, 'COMPLETED_WITH_ERRORS' AS status FROM {broken}", broken=_BROKEN)(
    lambda d: round_trip(d).read("ingestion_jobs").select("table_name", "total", "valid", "status")
)
query(
    "ingest_parents",
    "SELECT invoice_number, CASE WHEN supplier_taxpayer_id LIKE '%3' THEN 'PERSISTENCE_ERROR' WHEN again > 1 THEN 'PERSISTENCE_ERROR' ELSE 'OK' END AS code FROM (SELECT *, row_number() OVER (PARTITION BY invoice_number, supplier_pin, invoice_date ORDER BY supplier_taxpayer_id) AS again FROM {invoices})",
)(
    lambda d: (lambda kept, broken: kept.select("invoice_number", F.lit("OK").alias("code")).unionByName(broken.select(F.col("record_reference").alias("invoice_number"), "code")))(
        *ingest.constrain(
            d["invoices"].select("*", F.monotonically_increasing_id().alias("_row"), F.col("invoice_number").alias("_ref"), F.lit("").alias("_raw"), *[F.lit(None).cast("string").alias(c) for c in ("id", "invoice_type", "currency", "etims_reference", "source_job_id", "created_at")]),
            "invoices",
            parents={"taxpayers": d["taxpayers"].filter("id NOT LIKE '%3' OR id LIKE 'C%'").select("id")},
        )
    )
)
query("ingest_job_list", "SELECT id, status, started_at FROM {jobs} ORDER BY started_at DESC, id", jobs=INT["jobs"])(lambda d: ingest.job_list(_jobs(d)).select("id", "status", "started_at"))
query("ingest_sources", "SELECT code, active FROM {sources} UNION ALL SELECT 'NEW', TRUE", sources=INT["sources"])(
    lambda d: ingest.register_source(_sources(d).select("code", "active"), d.spark.createDataFrame([("NEW", True)], "code string, active boolean"))
)

# rules and gaps

_RULES = ", ".join(f"('{r.code}', '{r.tax_head}', '{r.severity}', {r.confidence}, '{json.dumps(r.thresholds)}')" for r in rules.RULES)
# changes of rules: rows of nation, in the order of their keys
_CODE_LIST = ", ".join(f"'{c}'" for c in rules.CODES)
_CHANGES = f"""SELECT element_at(array({_CODE_LIST}), CAST(n_nationkey % {len(rules.CODES)} + 1 AS INT)) AS code, CASE n_nationkey % 3 WHEN 0 THEN concat('LEVEL-', n_nationkey) WHEN 1 THEN ' ' END AS severity,
  CASE WHEN n_nationkey % 5 = 0 THEN FALSE WHEN n_nationkey % 7 = 0 THEN TRUE END AS active, CASE WHEN n_nationkey % 4 = 0 THEN concat(chr(123), '"minimumGap": "', n_nationkey * 1000, '"', chr(125)) END AS thresholds, n_nationkey AS seq FROM {{nation}}"""


def settled_rules(d: Domain) -> Catalog:
    catalog = new_catalog(d, "rules")
    settings.store_rules(catalog, "2024-01-01 00:00:00")
    settings.update_rules(catalog, d.spark.sql(_CHANGES, nation=d["nation"]), "2024-02-02 00:00:00")
    return catalog


query(
    "rule_list",
    f"""SELECT r.code, r.tax_head, coalesce(c.severity, r.severity) AS severity, CAST(r.confidence AS DOUBLE) AS confidence, coalesce(c.active, TRUE) AS active, coalesce(c.thresholds, r.thresholds) AS thresholds
    FROM (VALUES {_RULES}) AS r(code, tax_head, severity, confidence, thresholds) LEFT JOIN (SELECT code, arg_max(severity, seq) FILTER (WHERE trim(severity) <> '') AS severity, arg_max(active, seq) FILTER (WHERE active IS NOT NULL) AS active, arg_max(thresholds, seq) FILTER (WHERE thresholds IS NOT NULL) AS thresholds FROM {{changes}} GROUP BY 1) c USING (code)""",
    changes=_CHANGES.replace("element_at(array(", "list_extract(list_value("),
)(lambda d: settled_rules(d).read(settings.RULES).select("code", "tax_head", "severity", "confidence", "active", "thresholds"))


def settled_rates(d: Domain) -> Catalog:
    """The rates, some of them replaced by rows of region."""
    catalog = new_catalog(d, "rates")
    settings.store_rates(catalog)
    stored = catalog.read(settings.RATES).filter("signal_type LIKE 'VAT%'")
    top = d["region"].agg((F.max("r_regionkey") / 100).cast("decimal(10,4)").alias("_r"))
    settings.store_rates(catalog, stored.crossJoin(F.broadcast(top)).withColumn("penalty_rate", F.col("_r")).drop("_r"))  # one row
    return catalog


query(
    "gap_rate_catalog",
    f"""SELECT r.signal_type, head AS catalog_head, CAST(rate AS DECIMAL(10,4)) AS recoverable_rate, CAST(CASE WHEN r.signal_type LIKE 'VAT%' THEN (SELECT max(r_regionkey) / 100 FROM {{region}}) ELSE penalty END AS DECIMAL(10,4)) AS penalty_rate, CAST(interest AS DECIMAL(10,4)) AS interest_rate, basis,
    coalesce(s.n, 0) AS signals, CAST(coalesce(s.gap, 0) AS DECIMAL(18,2)) AS estimated_gap FROM (VALUES {_RATES}) AS r(signal_type, head, rate, penalty, interest, basis)
    LEFT JOIN (SELECT rule_code, count(*) AS n, sum(estimated_gap) AS gap FROM {{signals}} WHERE estimated_gap > 0 GROUP BY 1) s ON s.rule_code = r.signal_type""",
    **GAP,
)(lambda d: settings.rate_usage(settled_rates(d), all_signals(d)))
query(
    "rule_signal_view",
    "SELECT s.deterministic_key, t.kra_pin, t.legal_name, s.period_start FROM (SELECT * FROM {signals} WHERE rule_code = 'VAT_OUTPUT_MISMATCH' ORDER BY period_start DESC, deterministic_key LIMIT 200) s LEFT JOIN {taxpayers} t ON t.id = s.taxpayer_id",
    signals=rule_sql.SIGNALS["VAT_OUTPUT_MISMATCH"],
)(lambda d: rules.signal_view(all_signals(d), d["taxpayers"], code="VAT_OUTPUT_MISMATCH", limit=500).select("deterministic_key", "kra_pin", "legal_name", "period_start"))


def signals_again(d: Domain) -> DataFrame:
    """A second run over signals of a first one: those of one rule were closed, with other amounts, and some are stale."""
    new = kept_signals(d).withColumns({"id": F.lit("new"), "created_at": F.lit("2024-02-02")})
    old = new.filter("rule_code = 'VAT_OUTPUT_MISMATCH'").withColumns({"id": F.lit("old"), "created_at": F.lit("2024-01-01"), "status": F.lit("CLOSED"), "estimated_gap": F.lit(1).cast("decimal(18,2)")})
    stale = old.limit(1).withColumn("deterministic_key", F.lit("STALE"))
    return merge_by_key(old.unionByName(stale), new, ["deterministic_key"]).select("deterministic_key", "id", "created_at", "status", "estimated_gap")


query(
    "rule_signal_upsert",
    "SELECT deterministic_key, CASE WHEN rule_code = 'VAT_OUTPUT_MISMATCH' THEN 'old' ELSE 'new' END AS id, CASE WHEN rule_code = 'VAT_OUTPUT_MISMATCH' THEN '2024-01-01' ELSE '2024-02-02' END AS created_at, status, estimated_gap FROM {signals} UNION ALL SELECT 'STALE', 'old', '2024-01-01', 'CLOSED', CAST(1 AS DECIMAL(18,2))",
    signals=rule_sql.ALL_SIGNALS,
)(signals_again)


def gaps_again(d: Domain) -> tuple[DataFrame, DataFrame]:
    """A second run of the gap engine: one old estimate is stale, and scores of other engines are there."""
    est = d.keep("estimates", lambda: taxgap.estimates(kept_signals(d)))
    stale = est.limit(1).withColumns({"deterministic_key": F.lit("STALE"), "taxpayer_id": F.lit("S-STALE")})
    others = taxgap.scores(est).withColumn("source", F.lit("OTHER"))
    old = taxgap.scores(stale).unionByName(others)
    return taxgap.refresh(kept_signals(d), est.filter("tax_head = 'VAT'").unionByName(stale), old, est)


query("gap_refresh_estimates", "SELECT deterministic_key, recoverable_tax FROM {est} UNION ALL SELECT 'STALE', NULL", **GAP)(lambda d: gaps_again(d)[0].select("deterministic_key", F.when(F.col("deterministic_key") != "STALE", F.col("recoverable_tax")).alias("recoverable_tax")))
query("gap_refresh_scores", "SELECT taxpayer_id, source, score FROM {scores} UNION ALL SELECT taxpayer_id, 'OTHER', score FROM {scores} UNION ALL SELECT 'S-STALE', 'TAX_GAP_ENGINE', NULL", **GAP)(
    lambda d: gaps_again(d)[1].select("taxpayer_id", "source", F.when(F.col("taxpayer_id") != "S-STALE", F.col("score")).alias("score"))
)
query("recon_upsert", "SELECT deterministic_key, settlement_status, CASE WHEN settlement_status = 'MATCHED' THEN 'old' ELSE 'new' END AS id FROM {recon}", **RECON)(
    lambda d: merge_by_key(recon(d).filter("settlement_status = 'MATCHED'").withColumns({"id": F.lit("old"), "variance_amount": F.lit(-1).cast("decimal(18,2)")}), recon(d).withColumn("id", F.lit("new")), ["deterministic_key"]).select("deterministic_key", "settlement_status", "id")
)
_EDGE_KEY = ["source_type", "source_id", "target_type", "target_id", "edge_type", "source"]
query("graph_edge_upsert", "SELECT source_id, target_id, edge_type, weight FROM {flow} UNION ALL SELECT source_id, target_id, edge_type, weight FROM {permits}", flow=EDGES["withholding_flow"], permits=EDGES["county_permits"])(
    lambda d: merge_by_key(graph.withholding_flow(d["withholding_certificates"]).withColumn("weight", F.lit(1).cast("decimal(8,4)")), graph.withholding_flow(d["withholding_certificates"]).unionByName(graph.county_permits(d["business_permits"])), _EDGE_KEY).select("source_id", "target_id", "edge_type", "weight")
)
query("graph_node_merge", "SELECT id, legal_name FROM {taxpayers}")(
    lambda d: (lambda have, new: have.unionByName(insert_if_absent(have, new, ["id"])))(d["taxpayers"].filter("id LIKE 'S%'").select("id", "legal_name"), d["taxpayers"].select("id", "legal_name"))
)

# runs that keep their results in the catalog


def orders_merged(d: Domain) -> DataFrame:
    """Orders in a table with buckets; those of a hundredth of the customers are merged with another status, some of them new."""
    catalog, key = new_catalog(d, "merged"), ["order_number"]
    orders = d["orders"].select(F.concat(F.lit("ORD-"), "o_orderkey").alias("order_number"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), "o_custkey", "o_orderkey", F.lit("first").alias("id"))
    catalog.write("orders", orders.filter("o_orderkey % 50 <> 7"), key, 64)
    catalog.merge("orders", orders.filter("o_custkey % 100 = 3 OR o_orderkey % 50 = 7").withColumns({"id": F.lit("second"), "status": F.lit("PAID")}), key)
    return catalog.read("orders")


query(
    "catalog_bucket_merge",
    "SELECT concat('ORD-', o_orderkey) AS order_number, CASE WHEN o_custkey % 100 = 3 OR o_orderkey % 50 = 7 THEN 'PAID' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 50 = 7 THEN 'second' ELSE 'first' END AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM {orders}",
)(lambda d: orders_merged(d).select("order_number", "status", "id", "amount"))


def gap_runs(d: Domain) -> Catalog:
    """Two runs of the gap engine: the second finds the VAT signals only, so other estimates stay as they were."""
    catalog, signals = new_catalog(d, "gap-runs"), kept_signals(d)
    runs.run_gaps(catalog, signals, "2024-01-01 00:00:00")
    runs.run_gaps(catalog, signals.filter("tax_head = 'VAT'"), "2024-02-02 00:00:00")
    return catalog


query(
    "gap_run_estimates",
    "SELECT deterministic_key, recoverable_tax, '2024-01-01' AS created, CASE WHEN tax_head = 'VAT' THEN '2024-02-02' ELSE '2024-01-01' END AS updated FROM {est}",
    **GAP,
)(lambda d: gap_runs(d).read("tax_gap_estimates").select("deterministic_key", "recoverable_tax", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated")))
query("gap_run_scores", "SELECT taxpayer_id, score, recoverable_tax, source FROM {scores}", **GAP)(lambda d: gap_runs(d).read("risk_scores").select("taxpayer_id", "score", "recoverable_tax", "source"))


def recon_runs(d: Domain) -> Catalog:
    catalog = new_catalog(d, "recon-runs")
    for now in ("2024-01-01 00:00:00", "2024-02-02 00:00:00"):
        runs.run_reconciliation(catalog, d["payment_transactions"], d["settlement_records"], now)
    return catalog


query(
    "recon_run_results",
    "SELECT deterministic_key, CASE WHEN settlement_status <> 'MATCHED' THEN 'reconciliation:' || deterministic_key END AS risk_signal_id, '2024-01-01' AS created FROM {recon}",
    **RECON,
)(lambda d: recon_runs(d).read("reconciliation_results").select("deterministic_key", "risk_signal_id", F.date_format("created_at", "yyyy-MM-dd").alias("created")))


def refreshed(d: Domain) -> Catalog:
    """The report views refreshed after a first load of estimates, an append, and a merge."""
    catalog, est = new_catalog(d, "views"), written(gap_estimates(d).select("deterministic_key", *views.KEY, *views.MONEY, "confidence_score"), "estimates", "zstd")
    wrong = est.filter("tax_head = 'VAT' AND taxpayer_id LIKE 'S%'").withColumn("recoverable_tax", F.lit(1).cast("decimal(18,2)"))
    catalog.write(views.SOURCE, wrong.unionByName(est.filter("tax_head = 'VAT' AND taxpayer_id NOT LIKE 'S%'")), ["deterministic_key"], 16)
    views.refresh(catalog)
    catalog.append(views.SOURCE, est.filter("tax_head <> 'VAT'"))
    views.refresh(catalog)
    catalog.merge(views.SOURCE, est.filter("tax_head = 'VAT' AND taxpayer_id LIKE 'S%'"), ["deterministic_key"])
    views.refresh(catalog)
    return catalog


_VIEW = """count(*) AS estimates, count(DISTINCT taxpayer_id) AS taxpayers, CAST(sum(estimated_gap) AS DECIMAL(18,2)) AS estimated_gap, CAST(sum(recoverable_tax) AS DECIMAL(18,2)) AS recoverable_tax,
  CAST(sum(total_recoverable) AS DECIMAL(18,2)) AS total_recoverable, CAST(round(CAST(sum(confidence_score) AS DOUBLE) / count(*), 2) AS DECIMAL(5,2)) AS average_confidence"""
query("report_view_by_sector", f"SELECT coalesce(sector_name, 'Unspecified') AS sector, tax_head, {_VIEW} FROM {{est}} JOIN {{taxpayers}} ON id = taxpayer_id GROUP BY 1, 2", **GAP)(lambda d: views.by_sector(refreshed(d), d["taxpayers"]))
query("report_view_by_region", f"SELECT coalesce(county, 'Unspecified') AS region, tax_head, {_VIEW} FROM {{est}} JOIN {{taxpayers}} ON id = taxpayer_id GROUP BY 1, 2", **GAP)(lambda d: views.by_region(refreshed(d), d["taxpayers"]))

def name_catalog(d: Domain) -> Catalog:
    """An index of taxpayers' names, made in two additions; some names were others at first."""
    catalog, people = new_catalog(d, "names"), d["taxpayers"].select(*name_index.COLUMNS)
    wrong = people.filter("id LIKE '%4'").withColumn("legal_name", F.lit("House of Supplier 000000042"))
    name_index.add(catalog, people.filter("id LIKE 'C%' AND id NOT LIKE '%4'").unionByName(wrong))
    name_index.add(catalog, people.filter("id NOT LIKE 'C%' OR id LIKE '%4'"))
    return catalog


query("er_indexed_candidates", CANDIDATES_SQL, tsets=ER["tsets"])(lambda d: name_index.candidates(name_catalog(d), "House of Supplier 000000042", 20))

query(
    "dashboard_totals",
    "SELECT (SELECT CAST(sum(estimated_gap) AS DECIMAL(18,2)) FROM {signals}) AS estimated_gap, (SELECT CAST(sum(recoverable_tax) AS DECIMAL(18,2)) FROM {scores}) AS recoverable_tax, (SELECT count(*) FROM {cases} WHERE case_status <> 'CLOSED') AS open_cases, (SELECT count(*) FROM {broken} WHERE length(legal_name) > 240 OR length(status) > 60) AS invalid_rows",
    broken=_BROKEN, **GAP,
)(lambda d: (lambda signals: reports.dashboard_totals(signals, taxgap.scores(taxgap.estimates(signals)), d["cases"], round_trip(d).read("ingestion_jobs")))(kept_signals(d)))

# models

_VERSIONS = "model_name string, version string, created_at string, active boolean"
_OLD_VERSIONS = [("taxpayer-risk", "risk-1", "2024-01-01", True), ("taxpayer-risk", "risk-2", "2024-01-02", False), ("other", "risk-1", "2024-01-03", True)]


def versions(d: Domain, new: str = "risk-2") -> DataFrame:
    return scoring.upsert_version(d.spark.createDataFrame(_OLD_VERSIONS, _VERSIONS), d.spark.createDataFrame([("taxpayer-risk", new, "2024-02-01")], "model_name string, version string, created_at string"))


_COLUMNS = sorted(["taxpayer_id", "kra_pin", "legal_name", "sector_name", "county", "period_start", "period_end", *scoring.MONEY, "rule_score", *scoring.COUNTS])
_ROW = "sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _COLUMNS) + "))"
_PIECES = ", ".join(f"sum(CAST(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT AS HUGEINT)) AS h{i}" for i in range(4))
query(
    "ml_model_version",
    f"SELECT 'taxpayer-risk' AS model_name, 'risk-' || substr(sha256(concat_ws('|', 'taxpayer-risk', '42', '{','.join(_COLUMNS)}', CAST(n AS VARCHAR), " + ", ".join(f"CAST(coalesce(h{i}, 0) AS VARCHAR)" for i in range(4)) + f")), 1, 12) AS version FROM (SELECT count(*) AS n, {_PIECES} FROM (SELECT {_ROW} AS h FROM {{obs}}))",
    **ML,
)(lambda d: scoring.model_version(obs(d)))


def stored_versions(d: Domain) -> Catalog:
    """Versions of a model on companies, on all, and on companies again."""
    catalog, rows = new_catalog(d, "versions"), written(obs(d), "observations")
    for n, some in enumerate(("taxpayer_id LIKE 'S%'", "TRUE", "taxpayer_id LIKE 'S%'")):
        settings.store_version(catalog, scoring.model_version(rows.filter(some)), f"2024-01-0{n + 1}")
    return catalog


_VERSION = f"'risk-' || substr(sha256(concat_ws('|', 'taxpayer-risk', '42', '{','.join(_COLUMNS)}', CAST(n AS VARCHAR), " + ", ".join(f"CAST(coalesce(h{i}, 0) AS VARCHAR)" for i in range(4)) + ")), 1, 12)"
query(
    "ml_version_list",
    " UNION ALL ".join(
        f"SELECT 'taxpayer-risk' AS model_name, {_VERSION} AS version, '{created}' AS created_at, {active} AS active FROM (SELECT count(*) AS n, {_PIECES} FROM (SELECT {_ROW} AS h FROM {{obs}} WHERE {some}))"
        for some, created, active in (("taxpayer_id LIKE 'S%'", "2024-01-01", "TRUE"), ("TRUE", "2024-01-02", "FALSE"))
    ),
    **ML,
)(lambda d: scoring.version_list(stored_versions(d).read(settings.VERSIONS)))


def test_predictions(d: Domain) -> DataFrame:
    """Predictions whose scores are a number from the id."""
    return rule_scores(d).select("taxpayer_id", F.col("score").alias("combined_score"), (100 - F.col("score")).cast("decimal(5,2)").alias("model_score"), F.when(F.col("source") == "OTHER", "risk-9").otherwise("risk-2").alias("version"))


query("ml_persist_scores", "SELECT taxpayer_id, score, 'AI_RISK_SCORING' AS source FROM {rscores} UNION ALL SELECT taxpayer_id, score, source FROM {rscores}", **ML)(
    lambda d: scoring.persist_scores(rule_scores(d).unionByName(rule_scores(d).withColumn("source", F.lit(scoring.SOURCE))), test_predictions(d))
)
query(
    "ml_dashboard",
    "SELECT 'risk-2' AS active_version, (SELECT count(*) FROM {rscores} WHERE source <> 'OTHER') AS predictions, (SELECT CAST(round(sum(100 - score)::DOUBLE / count(*), 2) AS DECIMAL(5,2)) FROM {rscores} WHERE source <> 'OTHER') AS average_model_score, count(*) FILTER (WHERE score >= 70) AS high_risk, CAST(round(sum(score)::DOUBLE / count(*), 2) AS DECIMAL(5,2)) AS average_combined_score FROM {rscores}",
    **ML,
)(lambda d: scoring.dashboard(test_predictions(d), scoring.persist_scores(rule_scores(d), test_predictions(d)), versions(d)))

# cases, messages, reports, governance

query("case_events", "SELECT id AS case_id, 'CREATED' AS event_type FROM {cases} UNION ALL SELECT id, 'CLOSED' FROM {cases} WHERE case_status = 'CLOSED'")(
    lambda d: cases.append_event(d["cases"].select(F.col("id").alias("case_id"), F.lit("CREATED").alias("event_type")), d["cases"].filter("case_status = 'CLOSED'").select(F.col("id").alias("case_id"), F.lit("CLOSED").alias("event_type")))
)
_MOVED = "SELECT id, CASE WHEN id LIKE '%1' THEN 'IN_REVIEW' ELSE 'CLOSED' END AS to_status, CASE WHEN id LIKE '%7' THEN NULL ELSE 'done' END AS reason FROM {cases}"
query(
    "case_after_transitions",
    "SELECT c.id, CASE WHEN c.case_status IN ('OPEN', 'IN_REVIEW') AND r.to_status = 'CLOSED' AND trim(coalesce(r.reason, '')) <> '' THEN 'CLOSED' WHEN c.case_status = 'OPEN' AND r.to_status = 'IN_REVIEW' THEN 'IN_REVIEW' ELSE c.case_status END AS case_status FROM {cases} c JOIN {moved} r USING (id)",
    moved=_MOVED,
)(lambda d: cases.apply_transitions(d["cases"], cases.transitions(d["cases"], d.spark.sql(_MOVED, cases=d["cases"]))).select("id", "case_status"))
query("notify_respond", "SELECT id, CASE WHEN case_status = 'OPEN' THEN 'RESPONDED' ELSE 'SENT' END AS status, CASE WHEN case_status = 'OPEN' THEN 'paid' END AS response FROM {cases}")(
    lambda d: cases.respond(d["cases"].select("id", F.lit("SENT").alias("status"), F.lit(None).cast("string").alias("response")), d["cases"].filter("case_status = 'OPEN'").select("id", F.lit("paid").alias("response"))).select("id", "status", "response")
)


def exported(d: Domain) -> DataFrame:
    """A report written as CSV, with fields that need quotes, and read back."""
    path = noted(f"{work_dir(d.spark)}/export-{uuid.uuid4().hex}")
    reports.write_csv(reports.audit_pipeline(d["cases"], d["recovery_records"]).withColumn("note", F.concat(F.lit('a "b", c\n'), "status")), path)
    return d.spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).select("status", "case_count", "note")


query("report_csv_export", """SELECT case_status AS status, CAST(count(*) AS VARCHAR) AS case_count, 'a "b", c' || chr(10) || case_status AS note FROM {cases} c LEFT JOIN {recovery_records} r ON r.case_id = c.id GROUP BY 1""")(exported)
_OVERVIEW = {"users": "customer", "roles": "nation", "permissions": "part", "role_permissions": "supplier", "data_sources": "region", "risk_rules": "region", "model_versions": "nation", "audit_logs": "events"}
_ITEMS = "SELECT n_name AS data_category, n_nationkey % 5 <> 0 AS completed, n_regionkey <> 2 AS active, n_nationkey * 30 AS retention_days FROM {nation}"
query(
    "admin_governance_overview",
    "SELECT " + ", ".join(f"(SELECT count(*) FROM {{{t}}}) AS {n}" for n, t in _OVERVIEW.items()) + ", count(*) FILTER (WHERE active) AS retention_policies, count(*) AS privacy_items, count(*) FILTER (WHERE completed) AS completed_privacy_items, count(*) > 0 AND count(*) = count(*) FILTER (WHERE completed) AS privacy_complete FROM {items}",
    items=_ITEMS,
)(lambda d: governance.governance_overview({n: d[t] for n, t in _OVERVIEW.items()}, d.spark.sql(_ITEMS, nation=d["nation"]), d.spark.sql(_ITEMS, nation=d["nation"])))
query("admin_retention", "SELECT data_category, retention_days, active FROM {items}", items=_ITEMS)(lambda d: governance.by_category(d.spark.sql(_ITEMS, nation=d["nation"])).select("data_category", "retention_days", "active"))
query("admin_privacy", "SELECT data_category, completed FROM {items}", items=_ITEMS)(lambda d: governance.by_category(d.spark.sql(_ITEMS, nation=d["nation"])).select("data_category", "completed"))
query("admin_export_roles", "SELECT DISTINCT concat('NATION_', s_nationkey) AS role FROM {supplier} WHERE s_suppkey % 9 = 4")(
    lambda d: governance.export_roles(d["supplier"].select(F.concat(F.lit("NATION_"), "s_nationkey").alias("role"), F.when(F.col("s_suppkey") % 9 == 4, governance.EXPORT).otherwise("OTHER").alias("permission")))
)
query("recon_signal_evidence", "SELECT deterministic_key, evidence FROM {recon}", **RECON)(lambda d: reconcile.reconcile(d["payment_transactions"], d["settlement_records"]).select("deterministic_key", "evidence"))
