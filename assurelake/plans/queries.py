"""All queries of the revenue-assurance engine with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.operators import cases, duplicates, governance, graph, profile, reconcile, reports, resolution, rules, scoring, taxgap
from assurelake.plans import rule_sql
from assurelake.plans.domain import AS_OF, EVENTS_AS_OF, MONTHS, Domain, with_tables
from assurelake.sources import catalog, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, **more: str):
    """Register a function of the domain tables under a name, with its SQL."""

    def register(f: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLE[name] = with_tables(sql, **more)
        return f

    return register


TEST_RULES = [rules.with_thresholds(r, rule_sql.THRESHOLDS.get(r.code)) for r in rules.RULES]
COMPARED = [c for c in rules.SIGNAL_COLUMNS if c not in ("signal_type", "explanation")]


def _day(code: str):
    return EVENTS_AS_OF if code == "PAYMENT_SETTLEMENT_MISMATCH" else AS_OF


def all_signals(d: Domain) -> DataFrame:
    """Signals of all rules: those on events run for their own day. The lines behind most of their tables are joined
    and written once, and so are the sums by month."""
    d.keep("lines")
    for name in MONTHS:
        if name not in d.kept:
            d.put(name, catalog.written(d[name], name, "zstd"))
            d.kept.add(name)
    others = [c for c in rules.CODES if _day(c) == AS_OF]
    events = [c for c in rules.CODES if _day(c) != AS_OF]
    return rules.run_rules(months(d), AS_OF, others, TEST_RULES).unionByName(rules.run_rules(d, EVENTS_AS_OF, events, TEST_RULES))


def kept_signals(d: Domain) -> DataFrame:
    """all_signals() as a written table, for queries that read them several times."""
    return d.keep("signals", lambda: all_signals(d))


def months(d: Domain) -> rules.Months:
    """The tables with their monthly sums, which are made once for a query."""
    return d.made.setdefault("months", rules.Months(d))


for _code in rules.CODES:
    query(f"rule_{_code.lower()}", rule_sql.SIGNALS[_code])(lambda d, code=_code: rules.run_rules(d, _day(code), [code], TEST_RULES).select(*COMPARED))
query("rules_all", rule_sql.ALL_SIGNALS)(lambda d: all_signals(d).select(*COMPARED))

# tax gap

_RATES = ", ".join(f"('{a}', '{b}', {r}, {p}, {i}, '{basis}')" for a, b, r, p, i, basis in taxgap.RATES)
_EST = f"""SELECT tax_head || ':' || taxpayer_id || ':' || CAST(period_start AS VARCHAR) || ':' || CAST(period_end AS VARCHAR) AS deterministic_key, taxpayer_id, tax_head, period_start, period_end,
  CAST(sum(declared_amount) AS DECIMAL(18,2)) AS declared_amount, CAST(sum(observed_amount) AS DECIMAL(18,2)) AS observed_amount, CAST(sum(estimated_gap) AS DECIMAL(18,2)) AS estimated_gap,
  CAST(sum(t) AS DECIMAL(18,2)) AS recoverable_tax, CAST(sum(p) AS DECIMAL(18,2)) AS penalty, CAST(sum(i) AS DECIMAL(18,2)) AS interest,
  CAST(round(CAST(sum(confidence_score) AS DOUBLE) / count(*), 2) AS DECIMAL(5,2)) AS confidence_score, count(*) AS signal_count, CAST(sum(t) + sum(p) + sum(i) AS DECIMAL(18,2)) AS total_recoverable,
  string_agg(DISTINCT rule_code || '=' || basis, ',' ORDER BY rule_code || '=' || basis) AS bases
FROM (SELECT s.*, r.basis, round(estimated_gap * CAST(r.rate AS DECIMAL(10,4)), 2) AS t, round(estimated_gap * CAST(r.rate AS DECIMAL(6,4)) * CAST(r.penalty AS DECIMAL(6,4)), 2) AS p, round(estimated_gap * CAST(r.rate AS DECIMAL(6,4)) * CAST(r.interest AS DECIMAL(6,4)), 2) AS i
      FROM {{signals}} s JOIN (SELECT * FROM (VALUES {_RATES}) AS v(signal_type, head, rate, penalty, interest, basis)) r ON r.signal_type = s.rule_code
      WHERE s.taxpayer_id IS NOT NULL AND s.estimated_gap > 0 AND s.status IN ('OPEN', 'NEW'))
GROUP BY taxpayer_id, tax_head, period_start, period_end"""
_SCORES = """SELECT taxpayer_id, min(period_start) AS period_start, max(period_end) AS period_end, CAST(sum(estimated_gap) AS DECIMAL(18,2)) AS estimated_gap,
  CAST(sum(recoverable_tax) AS DECIMAL(18,2)) AS recoverable_tax, CAST(sum(total_recoverable) AS DECIMAL(18,2)) AS total_recoverable,
  CAST(round(CAST(sum(confidence_score) AS DOUBLE) / count(*), 2) AS DECIMAL(5,2)) AS confidence_score, count(*) AS estimate_count,
  CAST(least(100, round(CAST(sum(recoverable_tax) AS DECIMAL(18,2)) * CAST(0.0001 AS DECIMAL(5,4)), 2)) AS DECIMAL(5,2)) AS score, 'TAX_GAP_ENGINE' AS source,
  '[' || string_agg('{"taxHead":"' || tax_head || '","periodStart":"' || CAST(period_start AS VARCHAR) || '","periodEnd":"' || CAST(period_end AS VARCHAR) || '","estimatedRecoverableTax":' || CAST(recoverable_tax AS VARCHAR) || ',"confidenceScore":' || CAST(confidence_score AS VARCHAR) || '}', ',' ORDER BY recoverable_tax DESC, tax_head, period_start, period_end) || ']' AS tax_heads
  FROM {est} GROUP BY taxpayer_id"""
GAP = {"signals": rule_sql.ALL_SIGNALS, "est": _EST, "scores": _SCORES}


def gap_estimates(d: Domain) -> DataFrame:
    return taxgap.estimates(all_signals(d))


def flat_estimates(d: Domain) -> DataFrame:
    """Estimates with their bases as one text."""
    rows = gap_estimates(d)
    return rows.drop("signal_types", "evidence").withColumn("bases", F.array_join(F.transform("bases", lambda b: F.concat(b["signal_type"], F.lit("="), b["basis"])), ","))


query("gap_source_signals", "SELECT count(*) AS source_signals FROM {signals} WHERE estimated_gap > 0", signals=rule_sql.ALL_SIGNALS)(lambda d: taxgap.source_signals(all_signals(d)))
query("gap_estimates", "SELECT * FROM {est}", **GAP)(flat_estimates)
query(
    "gap_estimate_list",
    "SELECT deterministic_key, kra_pin, legal_name, recoverable_tax, confidence_score FROM {est} JOIN {taxpayers} t ON t.id = taxpayer_id WHERE tax_head = 'VAT' AND period_start >= DATE '1993-01-15' AND period_end <= DATE '1997-12-15' ORDER BY recoverable_tax DESC, confidence_score DESC, tax_head, deterministic_key LIMIT 100",
    **GAP,
)(
    lambda d: taxgap.estimate_list(gap_estimates(d), head="VAT", start=date(1993, 1, 15), end=date(1997, 12, 15), limit=100, taxpayers=d["taxpayers"]).select("deterministic_key", "kra_pin", "legal_name", "recoverable_tax", "confidence_score")
)
query("gap_scores", "SELECT * FROM {scores}", **GAP)(lambda d: taxgap.scores(gap_estimates(d)))
query(
    "gap_summary_by_head",
    """SELECT tax_head, count(DISTINCT taxpayer_id) AS taxpayers, count(*) AS estimates, CAST(sum(estimated_gap) AS DECIMAL(18,2)) AS estimated_gap, CAST(sum(recoverable_tax) AS DECIMAL(18,2)) AS recoverable_tax,
    CAST(sum(penalty) AS DECIMAL(18,2)) AS penalty, CAST(sum(interest) AS DECIMAL(18,2)) AS interest, CAST(sum(total_recoverable) AS DECIMAL(18,2)) AS total_recoverable,
    CAST(round(CAST(sum(confidence_score) AS DOUBLE) / count(*), 2) AS DECIMAL(5,2)) AS average_confidence FROM {est} GROUP BY tax_head""",
    **GAP,
)(lambda d: taxgap.summary_by_head(gap_estimates(d)))
query(
    "gap_taxpayer_ranking",
    "SELECT s.*, t.kra_pin, t.legal_name, t.sector_name, t.county FROM {scores} s JOIN {taxpayers} t ON t.id = s.taxpayer_id ORDER BY s.recoverable_tax DESC, s.confidence_score DESC, s.score DESC, s.taxpayer_id LIMIT 20",
    **GAP,
)(lambda d: taxgap.ranking(taxgap.scores(gap_estimates(d)), d["taxpayers"]))

# reconciliation

_PAID = "upper(payment_status) IN ('PAID', 'SUCCESS', 'SUCCESSFUL', 'COMPLETED')"
_S_ON = "lower(s.collecting_agency) = lower(p.collecting_agency) AND lower(s.revenue_channel) = lower(p.revenue_channel) AND upper(s.settlement_status) IN ('SETTLED', 'SUCCESS', 'COMPLETED') AND s.settlement_date >= p.reconciliation_date"
_AGG = """coalesce(sum(s.settled_amount), 0) AS settled, count(s.settlement_reference) AS n, string_agg(DISTINCT s.settlement_account, ', ' ORDER BY s.settlement_account) AS account,
  count(s.settlement_reference) FILTER (WHERE lower(coalesce(s.settlement_account, '')) <> 'cbk-kra-main') AS wrong, max(s.settlement_date - p.reconciliation_date) AS lag"""
RECON = {
    "pay": f"SELECT collecting_agency, revenue_channel, CAST(payment_date AS DATE) AS reconciliation_date, CAST(sum(amount) AS DECIMAL(18,2)) AS expected_amount, count(*) AS transaction_count FROM {{payment_transactions}} WHERE {_PAID} GROUP BY 1, 2, 3",
    "ont": f"SELECT p.collecting_agency, p.revenue_channel, p.reconciliation_date, {_AGG} FROM {{pay}} p LEFT JOIN {{settlement_records}} s ON {_S_ON} AND s.settlement_date <= p.reconciliation_date + 2 GROUP BY 1, 2, 3",
    "als": f"SELECT p.collecting_agency, p.revenue_channel, p.reconciliation_date, {_AGG} FROM {{pay}} p LEFT JOIN {{settlement_records}} s ON {_S_ON} AND s.settlement_date <= p.reconciliation_date + 30 AND s.settled_amount = p.expected_amount GROUP BY 1, 2, 3",
    "recon_rows": f"""SELECT *, CAST(expected_amount - settled_amount AS DECIMAL(18,2)) AS variance_amount, 'recon:' || collecting_agency || ':' || revenue_channel || ':' || CAST(reconciliation_date AS VARCHAR) || ':' || settlement_status AS deterministic_key FROM (
  SELECT p.*, CAST(CASE WHEN o.n = 0 AND a.settled >= p.expected_amount THEN a.settled ELSE o.settled END AS DECIMAL(18,2)) AS settled_amount,
    CASE WHEN o.n = 0 AND a.settled >= p.expected_amount THEN a.n ELSE o.n END AS settlement_count,
    CASE WHEN o.n = 0 AND a.settled >= p.expected_amount THEN a.account ELSE o.account END AS settlement_account,
    CAST(CASE WHEN o.n = 0 AND a.settled >= p.expected_amount THEN a.lag ELSE o.lag END AS INTEGER) AS max_lag_days,
    CASE WHEN o.n > 0 AND o.settled < p.expected_amount THEN 'PARTIAL_SETTLEMENT' WHEN a.n = 0 THEN 'MISSING_SETTLEMENT' WHEN o.n = 0 AND a.settled >= p.expected_amount THEN 'DELAYED_SETTLEMENT'
         WHEN o.wrong > 0 THEN 'WRONG_ACCOUNT' ELSE 'MATCHED' END AS settlement_status, CAST(NULL AS VARCHAR) AS duplicate_reference
  FROM {{pay}} p JOIN {{ont}} o USING (collecting_agency, revenue_channel, reconciliation_date) JOIN {{als}} a USING (collecting_agency, revenue_channel, reconciliation_date))
UNION ALL BY NAME
SELECT *, 'recon:' || collecting_agency || ':' || revenue_channel || ':' || CAST(reconciliation_date AS VARCHAR) || ':DUPLICATE_TRANSACTION:' || duplicate_reference AS deterministic_key FROM (
  SELECT collecting_agency, revenue_channel, CAST(payment_date AS DATE) AS reconciliation_date, CAST(sum(amount) AS DECIMAL(18,2)) AS expected_amount, count(*) AS transaction_count, CAST(0 AS DECIMAL(18,2)) AS settled_amount,
    CAST(0 AS BIGINT) AS settlement_count, CAST(NULL AS VARCHAR) AS settlement_account, CAST(NULL AS INTEGER) AS max_lag_days, 'DUPLICATE_TRANSACTION' AS settlement_status,
    coalesce(provider_reference, transaction_reference) AS duplicate_reference, CAST(sum(amount) - max(amount) AS DECIMAL(18,2)) AS variance_amount
  FROM {{payment_transactions}} WHERE {_PAID} GROUP BY 1, 2, 3, 11 HAVING count(*) > 1)""",
    "recon": """SELECT *, '{"expectedAmount":' || CAST(expected_amount AS VARCHAR) || ',"settledAmount":' || CAST(settled_amount AS VARCHAR) || ',"varianceAmount":' || CAST(variance_amount AS VARCHAR)
  || ',"settlementDelayDays":2,"expectedSettlementAccount":"CBK-KRA-MAIN"' || coalesce(',"settlementAccount":"' || settlement_account || '"', '') || coalesce(',"maxSettlementLagDays":' || CAST(max_lag_days AS VARCHAR), '')
  || coalesce(',"duplicateReference":"' || duplicate_reference || '"', '') || '}' AS evidence FROM {recon_rows}""",
}


def recon(d: Domain) -> DataFrame:
    return reconcile.reconcile(d["payment_transactions"], d["settlement_records"])


_RSIG = "SELECT 'reconciliation:' || deterministic_key AS deterministic_key, abs(variance_amount) AS estimated_gap, CAST(CASE settlement_status WHEN 'MISSING_SETTLEMENT' THEN 96 WHEN 'DUPLICATE_TRANSACTION' THEN 94 WHEN 'WRONG_ACCOUNT' THEN 92 WHEN 'DELAYED_SETTLEMENT' THEN 88 ELSE 85 END AS DECIMAL(5,2)) AS confidence_score, CASE WHEN settlement_status IN ('MISSING_SETTLEMENT', 'WRONG_ACCOUNT') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, evidence FROM {recon} WHERE settlement_status <> 'MATCHED'"
query("recon_default_window", "SELECT CAST(min(payment_date) AS DATE) AS from_date, CAST(max(payment_date) AS DATE) AS to_date FROM {payment_transactions}")(lambda d: reconcile.default_window(d["payment_transactions"]))
query("recon_payment_totals", "SELECT * FROM {pay}", pay=RECON["pay"])(lambda d: reconcile.totals(d["payment_transactions"]))
query("recon_results", "SELECT * FROM {recon}", **RECON)(recon)
query("recon_signals", _RSIG, **RECON)(lambda d: reconcile.signals_of(recon(d)).select("deterministic_key", "estimated_gap", "confidence_score", "severity", "evidence"))
query(
    "recon_signal_links",
    "SELECT deterministic_key, CASE WHEN settlement_status <> 'MATCHED' THEN 'reconciliation:' || deterministic_key END AS risk_signal_id FROM {recon}",
    **RECON,
)(lambda d: reconcile.link_signals(recon(d), reconcile.signals_of(recon(d))).select("deterministic_key", "risk_signal_id"))
query("recon_result_list", "SELECT deterministic_key, variance_amount FROM {recon} WHERE settlement_status = 'MISSING_SETTLEMENT' ORDER BY reconciliation_date DESC, abs(variance_amount) DESC, settlement_status, deterministic_key LIMIT 10", **RECON)(
    lambda d: reconcile.result_list(recon(d), "MISSING_SETTLEMENT", limit=10).select("deterministic_key", "variance_amount")
)
query(
    "recon_summary",
    "SELECT CAST(sum(expected_amount) AS DECIMAL(18,2)) AS expected_amount, CAST(sum(settled_amount) AS DECIMAL(18,2)) AS settled_amount, CAST(sum(variance_amount) AS DECIMAL(18,2)) AS variance_amount, "
    + ", ".join(f"count(*) FILTER (WHERE settlement_status = '{s}') AS {s.lower()}" for s in ("MATCHED", "MISSING_SETTLEMENT", "DELAYED_SETTLEMENT", "WRONG_ACCOUNT", "DUPLICATE_TRANSACTION"))
    + " FROM {recon}",
    **RECON,
)(lambda d: reconcile.summary(recon(d)))
query("recon_exception_count", "SELECT count(*) AS exceptions FROM {recon} WHERE settlement_status <> 'MATCHED'", **RECON)(lambda d: reconcile.exception_count(recon(d)))
query(
    "recon_case_opening",
    "SELECT 'reconciliation:' || deterministic_key AS risk_signal_id, CASE WHEN settlement_status IN ('MISSING_SETTLEMENT', 'WRONG_ACCOUNT') OR variance_amount >= 100000 THEN 'HIGH' ELSE 'MEDIUM' END AS priority, settlement_status = 'MISSING_SETTLEMENT' AS has_case FROM {recon} WHERE settlement_status <> 'MATCHED'",
    **RECON,
)(
    lambda d: reconcile.open_cases(
        recon(d), recon(d).filter("settlement_status = 'MISSING_SETTLEMENT'").select(F.concat(F.lit("reconciliation:"), "deterministic_key").alias("risk_signal_id"), F.lit("K").alias("case_id"), F.lit(1).alias("created_at"))
    ).select("risk_signal_id", "priority", (~F.col("is_new")).alias("has_case"))
)

# entity resolution

_WORDS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda w: w <> '')"
_TRI = f"list_distinct(flatten(list_transform({_WORDS}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIM = "CASE WHEN len({0}) + len({1}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
_TSETS = f"SELECT *, {_TRI.format('legal_name')} AS gl, {_TRI.format('trading_name')} AS gt FROM {{taxpayers}}"
_PAIRS = f"""SELECT source_id, target_id, source_name, target_name, CASE WHEN same THEN 1.0 ELSE c END AS confidence, CASE WHEN same THEN 'REGISTRATION_NUMBER' ELSE 'FUZZY_NAME' END AS basis FROM (
  SELECT a.id AS source_id, b.id AS target_id, a.legal_name AS source_name, b.legal_name AS target_name, coalesce(lower(a.registration_number) = lower(b.registration_number) AND a.registration_number <> '', FALSE) AS same,
    greatest({_SIM.format("a.gl", "b.gl")}, {_SIM.format("a.gt", "b.gt")}) AS c FROM {{tsets}} a JOIN {{tsets}} b ON a.id < b.id) WHERE same OR c >= 0.9"""
ER = {"tsets": _TSETS, "pairs": _PAIRS}
query("er_identifiers", "SELECT * FROM (SELECT 'KRA_PIN' AS identifier_type, kra_pin AS identifier_value, min(id) AS taxpayer_id FROM {taxpayers} GROUP BY 2 UNION ALL SELECT 'REGISTRATION_NUMBER', registration_number, min(id) FROM {taxpayers} WHERE registration_number <> '' GROUP BY 2)")(
    lambda d: resolution.identifiers(d["taxpayers"])
)
query("er_link_by_pin", "SELECT i.invoice_number, coalesce(i.supplier_taxpayer_id, t.id) AS supplier_taxpayer_id, i.total_amount FROM {open_invoices} i LEFT JOIN {taxpayers} t ON upper(t.kra_pin) = upper(i.supplier_pin)")(
    lambda d: resolution.link_by_pin(d["open_invoices"], d["taxpayers"], "supplier_pin", "supplier_taxpayer_id").select("invoice_number", "supplier_taxpayer_id", "total_amount")
)
_PERMIT_LINKS = f"""SELECT permit_number, taxpayer_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY permit_number ORDER BY similarity DESC, taxpayer_id) AS n FROM (
      SELECT p.permit_number, t.id AS taxpayer_id, greatest({_SIM.format("p.g", "t.gl")}, {_SIM.format("p.g", "t.gt")}) AS similarity
      FROM (SELECT *, {_TRI.format("business_activity")} AS g FROM {{open_permits}}) p JOIN {{tsets}} t ON p.county IS NULL OR t.county IS NULL OR lower(p.county) = lower(t.county))) WHERE n = 1 AND similarity >= 0.55"""
query("er_link_permits", _PERMIT_LINKS, tsets=_TSETS)(lambda d: resolution.link_permits(d["open_permits"], d["taxpayers"]))
query("er_duplicate_pairs", "SELECT source_id, target_id, confidence, basis FROM {pairs}", **ER)(lambda d: resolution.duplicate_pairs(d["taxpayers"]))
query("er_duplicate_candidates", "SELECT * FROM {pairs}", **ER)(lambda d: resolution.duplicate_candidates(d["taxpayers"]))
# links between two taxpayers by kind, from all pairs
_KIND_LINKS = f"""SELECT id, other, kind FROM (
    SELECT a.id, b.id AS other, unnest(['n', 'l', 't']) AS kind, unnest([coalesce(a.registration_number <> '' AND lower(a.registration_number) = lower(b.registration_number), FALSE), len(a.gl) > 0 AND {_SIM.format("a.gl", "b.gl")} >= 0.9, len(a.gt) > 0 AND {_SIM.format("a.gt", "b.gt")} >= 0.9]) AS linked
    FROM {{tsets}} a JOIN {{tsets}} b ON a.id <> b.id) WHERE linked"""
query(
    "er_duplicate_classes",
    """SELECT l.id AS taxpayer_id, c.class_id, count(*) FILTER (WHERE kind = 'n') AS number_links, count(*) FILTER (WHERE kind = 'l') AS legal_name_links, count(*) FILTER (WHERE kind = 't') AS trading_name_links
    FROM {klinks} l JOIN (WITH RECURSIVE reach AS (SELECT id, id AS other FROM {klinks} UNION SELECT r.id, k.other FROM reach r JOIN {klinks} k ON k.id = r.other) SELECT id, min(other) AS class_id FROM reach GROUP BY id) c ON c.id = l.id GROUP BY 1, 2""",
    tsets=_TSETS, klinks=_KIND_LINKS,
)(lambda d: duplicates.classified(d["taxpayers"])[0])
query(
    "er_duplicate_links",
    "SELECT CASE kind WHEN 'n' THEN 'REGISTRATION_NUMBER' WHEN 'l' THEN 'LEGAL_NAME' ELSE 'TRADING_NAME' END AS kind, CAST(count(*) / 2 AS BIGINT) AS pairs FROM {klinks} GROUP BY 1",
    tsets=_TSETS, klinks=_KIND_LINKS,
)(lambda d: duplicates.classified(d["taxpayers"])[1].groupBy("kind").agg(F.sum("pairs").alias("pairs")))
query("graph_registration_classes", "SELECT registration_number, min(id) AS representative, count(*) AS members, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS edges FROM {taxpayers} WHERE registration_number IS NOT NULL GROUP BY 1 HAVING count(*) > 1")(
    lambda d: duplicates.registration_classes(d["taxpayers"])
)
query("er_new_relationships", "SELECT source_id AS source_taxpayer_id, target_id AS target_taxpayer_id, 'POSSIBLE_DUPLICATE' AS relationship_type, CAST(confidence * 100 AS DECIMAL(5,2)) AS confidence_score FROM {pairs} WHERE basis = 'FUZZY_NAME'", **ER)(
    lambda d: resolution.new_relationships(
        d.keep("pairs", lambda: resolution.duplicate_pairs(d["taxpayers"])),
        d.keep("pairs").filter("basis <> 'FUZZY_NAME'").select(F.col("source_id").alias("source_taxpayer_id"), F.col("target_id").alias("target_taxpayer_id"), F.lit("POSSIBLE_DUPLICATE").alias("relationship_type")),
    ).drop("source")
)
CANDIDATES_SQL = f"""SELECT id, kra_pin, legal_name, greatest(l, t) AS confidence, CASE WHEN l >= t THEN 'LEGAL_NAME' ELSE 'TRADING_NAME' END AS basis, greatest(l, t) >= 0.55 AS auto_link_eligible FROM (
      SELECT *, {_SIM.format("gl", "g")} AS l, {_SIM.format("gt", "g")} AS t FROM {{tsets}}, (SELECT {_TRI.format("'House of Supplier 000000042'")} AS g)) WHERE greatest(l, t) > 0
    ORDER BY confidence DESC, legal_name, id LIMIT 20"""
query(
    "er_match_candidates",
    CANDIDATES_SQL,
    tsets=_TSETS,
)(lambda d: resolution.match_candidates(d["taxpayers"], "House of Supplier 000000042", 20))
#: Tables with open links: its domain table and its key, by the table's name.
OPEN = {"invoices": ("open_invoices", "invoice_number"), "customs_declarations": ("open_customs", "declaration_number"), "withholding_certificates": ("open_certificates", "certificate_number"), "properties": ("open_properties", "property_reference"), "payment_transactions": ("open_payments", "transaction_reference")}
_LINKED = []
for _table, _pin, _link in resolution.PIN_LINKS:
    _open, _key = OPEN[_table]
    query(f"er_link_{_table}_{_pin.removesuffix('_pin')}", f"SELECT o.{_key}, coalesce(o.{_link}, t.id) AS {_link} FROM {{{_open}}} o LEFT JOIN {{taxpayers}} t ON upper(t.kra_pin) = upper(o.{_pin})")(
        lambda d, o=_open, k=_key, p=_pin, x=_link: resolution.link_by_pin(d[o], d["taxpayers"], p, x).select(k, x)
    )
    _LINKED.append(f"SELECT '{_table}.{_link}' AS step, count(*) AS links FROM {{{_open}}} o JOIN {{taxpayers}} t ON upper(t.kra_pin) = upper(o.{_pin}) WHERE o.{_link} IS NULL")
_STEPS_MADE = " UNION ALL ".join([*_LINKED, "SELECT 'business_permits.taxpayer_id', count(*) FROM {permit_links}"])
query(
    "er_run_counters",
    """SELECT step, CAST(links AS BIGINT) AS created FROM {steps} UNION ALL SELECT 'total', CAST(sum(links) AS BIGINT) FROM {steps} UNION ALL SELECT 'identifiers.KRA_PIN', count(DISTINCT kra_pin) FROM {taxpayers} WHERE kra_pin <> ''
    UNION ALL SELECT 'identifiers.REGISTRATION_NUMBER', count(DISTINCT registration_number) FROM {taxpayers} WHERE registration_number <> '' UNION ALL SELECT 'relationships.POSSIBLE_DUPLICATE', count(*) FROM {pairs}""",
    **ER, permit_links=_PERMIT_LINKS, steps=_STEPS_MADE,
)(lambda d: resolution.run_counters({"taxpayers": d["taxpayers"], "business_permits": d["open_permits"]} | {t: d[o] for t, (o, _) in OPEN.items()}))
query("er_run_summary", "SELECT step, CAST(links AS BIGINT) AS links FROM {steps} UNION ALL SELECT 'total', CAST(sum(links) AS BIGINT) FROM {steps}", tsets=_TSETS, permit_links=_PERMIT_LINKS, steps=_STEPS_MADE)(
    lambda d: resolution.run_summary({"taxpayers": d["taxpayers"], "business_permits": d["open_permits"]} | {t: d[o] for t, (o, _) in OPEN.items()})
)

# profiles

_COUNTS = " ".join(
    f"LEFT JOIN (SELECT {who} AS id, count(*) AS {n}" + (f", CAST(sum({m}) AS DECIMAL(18,2)) AS {n}_total" if m else "") + f" FROM {{{t}}} WHERE {who} IS NOT NULL GROUP BY 1) USING (id)" for n, t, who, m in profile.PARTS
)
_ZERO = ", ".join(f"coalesce({n}, 0) AS {n}" + (f", CAST(coalesce({n}_total, 0) AS DECIMAL(18,2)) AS {n}_total" if m else "") for n, _, _, m in profile.PARTS)
query("profile_all", f"SELECT id, kra_pin, legal_name, county, status, {_ZERO} FROM {{taxpayers}} {_COUNTS}")(profile.profiles)
query("profile_lookup", f"SELECT id, kra_pin, legal_name, county, status, {_ZERO} FROM {{taxpayers}} {_COUNTS} WHERE id = 'S7'")(lambda d: profile.profiles(d, "S7"))
query("profile_identifiers", "SELECT 'KRA_PIN' AS identifier_type, kra_pin AS identifier_value, id AS taxpayer_id FROM {taxpayers} WHERE id = 'S7' UNION ALL SELECT 'REGISTRATION_NUMBER', registration_number, id FROM {taxpayers} WHERE id = 'S7' AND id = (SELECT min(id) FROM {taxpayers} WHERE registration_number = 'BN-7')")(
    lambda d: profile.identifier_list(resolution.identifiers(d["taxpayers"]), "S7")
)
query(
    "profile_relationships",
    "SELECT 'OUTGOING' AS direction, target_id AS other, 'POSSIBLE_DUPLICATE' AS relationship_type, CAST(confidence * 100 AS DECIMAL(5,2)) AS confidence_score FROM {pairs} WHERE source_id = 'S57' UNION ALL SELECT 'INCOMING', source_id, 'POSSIBLE_DUPLICATE', CAST(confidence * 100 AS DECIMAL(5,2)) FROM {pairs} WHERE target_id = 'S57'",
    **ER,
)(lambda d: profile.relationships(resolution.duplicate_pairs(d["taxpayers"]).select(F.col("source_id").alias("source_taxpayer_id"), F.col("target_id").alias("target_taxpayer_id"), F.lit("POSSIBLE_DUPLICATE").alias("relationship_type"), (F.col("confidence") * 100).cast("decimal(5,2)").alias("confidence_score")), "S57"))

# graph


def _uuid(x: str) -> str:
    return f"substr(md5({x}), 1, 8) || '-' || substr(md5({x}), 9, 4) || '-' || substr(md5({x}), 13, 4) || '-' || substr(md5({x}), 17, 4) || '-' || substr(md5({x}), 21, 12)"


def _edge(kind: str, source: str, s: str, node: str, t: str, label: str, weight: str, n: str, x: str, rows: str) -> str:
    return f"""SELECT 'TAXPAYER' AS source_type, {s} AS source_id, '{node}' AS target_type, {t} AS target_id, '{kind}' AS edge_type, CAST(least({weight}, 9999.9999) AS DECIMAL(8,4)) AS weight,
      CAST({n} AS BIGINT) AS evidence_count, CAST({x} AS DECIMAL(18,2)) AS evidence_amount, {label} AS target_label, '{source}' AS source FROM ({rows})"""


def _flow_sql(kind: str, source: str, table: str, a: str, b: str, x: str) -> str:
    return _edge(kind, source, "s", "TAXPAYER", "t", "CAST(NULL AS VARCHAR)", "n", "n", "x", f"SELECT {a} AS s, {b} AS t, count(*) AS n, sum({x}) AS x FROM {{{table}}} WHERE {a} <> {b} GROUP BY 1, 2")


def _act_sql(kind: str, node: str, source: str, table: str, who: str, name: str, label: str, x: str) -> str:
    return _edge(kind, source, "s", node, _uuid(f"'{node}:' || k"), "l", "n", "n", "x", f"SELECT {who} AS s, {name} AS k, {label} AS l, count(*) AS n, coalesce(sum({x}), 0) AS x FROM {{{table}}} WHERE {who} IS NOT NULL GROUP BY 1, 2, 3")


EDGES = {
    "invoice_trade": _flow_sql("INVOICE_TRADE", "ETIMS_INVOICES", "invoices", "supplier_taxpayer_id", "buyer_taxpayer_id", "total_amount"),
    "withholding_flow": _flow_sql("WITHHOLDING_FLOW", "WITHHOLDING_CERTIFICATES", "withholding_certificates", "payer_taxpayer_id", "payee_taxpayer_id", "gross_amount"),
    "shared_registration": _edge("SHARED_REGISTRATION_NUMBER", "TAXPAYER_REGISTRY", "s", "TAXPAYER", "t", "CAST(NULL AS VARCHAR)", "1", "2", "0", "SELECT a.id AS s, b.id AS t FROM {taxpayers} a JOIN {taxpayers} b ON a.registration_number = b.registration_number AND a.id < b.id"),
    "county_permits": _act_sql("COUNTY_PERMIT_ACTIVITY", "PERMIT_COUNTY", "BUSINESS_PERMITS", "business_permits", "taxpayer_id", "coalesce(county, 'UNKNOWN')", "coalesce(county, 'Unknown county') || ' permits'", "CASE WHEN upper(permit_status) = 'ACTIVE' THEN 1 ELSE 0 END"),
    "channel_usage": _act_sql("PAYMENT_CHANNEL_USAGE", "PAYMENT_CHANNEL", "PAYMENT_TRANSACTIONS", "payment_transactions", "payer_taxpayer_id", "collecting_agency || ':' || revenue_channel", "collecting_agency || ' / ' || revenue_channel", "amount"),
    "import_activity": _act_sql("IMPORT_ACTIVITY", "IMPORT_ACTIVITY", "CUSTOMS_DECLARATIONS", "customs_declarations", "taxpayer_id", "coalesce(hs_code, 'UNCLASSIFIED')", "'HS ' || coalesce(hs_code, 'unclassified')", "total_landed_cost"),
}
_EDGE_TABLES = {"invoice_trade": "invoices", "withholding_flow": "withholding_certificates", "shared_registration": "taxpayers", "county_permits": "business_permits", "channel_usage": "payment_transactions", "import_activity": "customs_declarations"}
_ALL_EDGES = "\nUNION ALL\n".join(EDGES.values())
#: Scores for the graph queries: a number from the id, so that they depend on nothing else.
_TEST_SCORES = "SELECT id AS taxpayer_id, CAST(CAST(substring(id, 2) AS INT) * 37 % 100 AS DECIMAL(5,2)) AS score FROM {taxpayers}"
#: Trade that goes round: all suppliers sell to suppliers.
_TEST_RING = "SELECT 'TAXPAYER' AS source_type, concat('S', s_suppkey) AS source_id, 'TAXPAYER' AS target_type, concat('S', (s_suppkey * 3 + k) % n) AS target_id, 'INVOICE_TRADE' AS edge_type, CAST(s_suppkey % 13 + k + 1 AS DECIMAL(8,4)) AS weight FROM {supplier} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) CROSS JOIN (SELECT count(*) AS n FROM {supplier})"
GRAPH = {"edges": _ALL_EDGES, "test_scores": _TEST_SCORES, "ring": _TEST_RING}
_SCORED = """FROM {edges} e JOIN {taxpayers} a ON a.id = e.source_id JOIN {taxpayers} b ON b.id = e.target_id JOIN {test_scores} x ON x.taxpayer_id = e.source_id JOIN {test_scores} y ON y.taxpayer_id = e.target_id
  WHERE e.source_type = 'TAXPAYER' AND e.target_type = 'TAXPAYER'"""


def test_scores(d: Domain) -> DataFrame:
    return d.spark.sql(_TEST_SCORES, taxpayers=d["taxpayers"])


def test_ring(d: Domain) -> DataFrame:
    return d.spark.sql(_TEST_RING, supplier=d["supplier"])


def relationships_of(d: Domain) -> DataFrame:
    """The duplicates that a resolution run relates."""
    return resolution.new_relationships(resolution.duplicate_pairs(d["taxpayers"]), d.spark.createDataFrame([], "source_taxpayer_id string, target_taxpayer_id string, relationship_type string"))


def strongest_edges(d: Domain, most: int) -> DataFrame:
    """All edges but those of shared numbers that are not among the `most` first of either end."""
    d.keep("lines")
    return graph.extract(d, strongest=most)


def edge_counts(d: Domain) -> DataFrame:
    """Edges by type; those between members of a group are counted from its size."""
    made = resolution.Duplicates(d["taxpayers"]).count().filter("n > 0").select(F.lit("POSSIBLE_DUPLICATE").alias("edge_type"), F.col("n").alias("edges"))
    return graph.counted(d).unionByName(made)


for _name, _sql in EDGES.items():
    query(f"graph_{_name}", _sql)(lambda d, n=_name: getattr(graph, n)(d[_EDGE_TABLES[n]]))
query("graph_relationship_edges", "SELECT source_id, target_id, 'POSSIBLE_DUPLICATE' AS edge_type, CAST(CAST(confidence * 100 AS DECIMAL(5,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(8,4)) AS weight FROM {pairs}", **ER)(
    lambda d: graph.relationship_edges(relationships_of(d)).select("source_id", "target_id", "edge_type", "weight")
)
query("graph_edge_counts", "SELECT edge_type, count(*) AS edges FROM {edges} GROUP BY 1 UNION ALL SELECT 'POSSIBLE_DUPLICATE', count(*) FROM {pairs}", edges=_ALL_EDGES, **ER)(edge_counts)
_GAP_SCORES = "SELECT taxpayer_id, max(score) AS score FROM {scores} GROUP BY 1"
query(
    "graph_run_counters",
    """SELECT edge_type AS counter, count(*) AS n FROM {edges} GROUP BY 1 UNION ALL SELECT 'EDGES', count(*) FROM {edges} UNION ALL SELECT 'HIGH_RISK_CLUSTERS', least(50, count(*)) FROM {edges} e LEFT JOIN {gap_scores} a ON a.taxpayer_id = e.source_id
    LEFT JOIN {gap_scores} b ON b.taxpayer_id = e.target_id WHERE e.source_type = 'TAXPAYER' AND e.target_type = 'TAXPAYER' AND greatest(coalesce(a.score, 0), coalesce(b.score, 0)) >= 70""",
    edges=_ALL_EDGES, **GAP, gap_scores=_GAP_SCORES,
)(lambda d: (lambda scores: graph.run_counters(catalog.written(graph.extract(d, strongest=50), "edges"), scores, d["taxpayers"], limit=50, counts=graph.counted(d)))(catalog.written(taxgap.scores(gap_estimates(d)), "scores")))
query(
    "graph_nodes_merged",
    "SELECT 'TAXPAYER' AS node_type, t.id, CASE WHEN t.id LIKE 'S%' THEN t.legal_name ELSE 'old ' || t.id END AS label, CAST(CASE WHEN t.id LIKE 'S%' THEN coalesce(s.score, CASE WHEN t.id LIKE '%1' OR t.id LIKE '%2' THEN 12 END, 0) ELSE 12 END AS DECIMAL(5,2)) AS risk_score FROM {taxpayers} t LEFT JOIN {gap_scores} s ON s.taxpayer_id = t.id WHERE t.id LIKE 'S%' OR t.id LIKE '%1' OR t.id LIKE '%2'",
    **GAP, gap_scores=_GAP_SCORES,
)(lambda d: graph.merge_nodes(
    d["taxpayers"].filter("id LIKE '%1' OR id LIKE '%2'").select(F.lit("TAXPAYER").alias("node_type"), "id", F.concat(F.lit("old "), "id").alias("label"), F.lit(12).cast("decimal(5,2)").alias("risk_score")),
    d["taxpayers"].filter("id LIKE 'S%'").join(taxgap.scores(gap_estimates(d)).select(F.col("taxpayer_id").alias("id"), F.col("score").alias("risk_score")), "id", "left").select(F.lit("TAXPAYER").alias("node_type"), "id", F.col("legal_name").alias("label"), "risk_score"),
))
query(
    "graph_neighbourhood",
    """SELECT e.*, st.legal_name AS source_label, coalesce(tt.legal_name, e.target_label, e.target_type) AS label FROM {edges} e LEFT JOIN {taxpayers} st ON st.id = e.source_id LEFT JOIN {taxpayers} tt ON e.target_type = 'TAXPAYER' AND tt.id = e.target_id
    WHERE e.source_id = 'S7' OR (e.target_type = 'TAXPAYER' AND e.target_id = 'S7') OR (e.target_type = 'TAXPAYER' AND e.source_id IN (
      SELECT target_id FROM {edges} WHERE source_id = 'S7' AND target_type = 'TAXPAYER' UNION SELECT source_id FROM {edges} WHERE target_type = 'TAXPAYER' AND target_id = 'S7'))
    ORDER BY e.weight DESC, e.edge_type, label NULLS LAST, e.source_id, e.target_id LIMIT 80""".replace("e.*, st", "e.* EXCLUDE (target_label), st").replace("AS label", "AS target_label").replace(", label NULLS", ", target_label NULLS").replace("e.edge_type, target_label", "e.edge_type, coalesce(tt.legal_name, e.target_label, e.target_type)"),
    edges=_ALL_EDGES,
)(lambda d: graph.neighbourhood(graph.extract(d), d["taxpayers"], "S7"))
query("graph_high_risk_clusters", f"SELECT e.source_id, a.legal_name AS source_name, e.target_id, b.legal_name AS target_name, e.edge_type, e.weight, x.score AS source_score, y.score AS target_score {_SCORED} AND (x.score >= 70 OR y.score >= 70) ORDER BY greatest(x.score, y.score) DESC, e.weight DESC, e.edge_type, e.source_id, e.target_id LIMIT 50", **GRAPH)(
    lambda d: graph.high_risk_clusters(graph.extract(d), test_scores(d), d["taxpayers"])
)
query("graph_clusters_of", f"SELECT * FROM (SELECT e.source_id, a.legal_name AS source_name, e.target_id, b.legal_name AS target_name, e.edge_type, e.weight, x.score AS source_score, y.score AS target_score {_SCORED} AND (x.score >= 70 OR y.score >= 70) ORDER BY greatest(x.score, y.score) DESC, e.weight DESC, e.edge_type, e.source_id, e.target_id LIMIT 50) WHERE source_id = 'S27' OR target_id = 'S27'", **GRAPH)(
    lambda d: graph.clusters_of(graph.high_risk_clusters(graph.extract(d), test_scores(d), d["taxpayers"]), "S27")
)
query(
    "graph_high_risk_pairs",
    f"SELECT * FROM (SELECT e.source_id, e.target_id, e.edge_type, e.weight, x.score AS source_score, y.score AS target_score {_SCORED} AND x.score >= 70 AND y.score >= 70 UNION ALL SELECT e.target_id, e.source_id, e.edge_type, e.weight, y.score, x.score {_SCORED} AND x.score >= 70 AND y.score >= 70) ORDER BY weight DESC, source_score DESC, target_score DESC, source_id, target_id, edge_type LIMIT 100",
    **GRAPH,
)(lambda d: graph.high_risk_pairs(graph.extract(d), test_scores(d), d["taxpayers"]))
query("graph_shared_identifiers", "SELECT * FROM (SELECT source_id, target_id, edge_type, weight FROM {e} UNION ALL SELECT target_id, source_id, edge_type, weight FROM {e}) ORDER BY weight DESC, source_id, target_id, edge_type LIMIT 100", e=EDGES["shared_registration"])(
    lambda d: graph.shared_identifiers(graph.extract(d))
)
query(
    "graph_nodes",
    "SELECT n.node_type, n.id, coalesce(t.legal_name, n.l, n.node_type) AS label, CAST(coalesce(s.score, 0) AS DECIMAL(5,2)) AS risk_score FROM (SELECT node_type, id, max(l) AS l FROM (SELECT source_type AS node_type, source_id AS id, NULL AS l FROM {edges} UNION ALL SELECT target_type, target_id, target_label FROM {edges}) GROUP BY 1, 2) n LEFT JOIN {taxpayers} t ON t.id = n.id LEFT JOIN {test_scores} s ON s.taxpayer_id = n.id",
    **GRAPH,
)(lambda d: graph.nodes(strongest_edges(d, 1), test_scores(d), d["taxpayers"]))
query(
    "graph_invoice_rings",
    """SELECT * FROM (SELECT a.source_id AS taxpayer_id, 2 AS cycle_length, CAST(a.weight + b.weight AS DECIMAL(18,4)) AS cycle_weight, a.source_id || '>' || a.target_id || ' ' || b.source_id || '>' || b.target_id AS path
      FROM {ring} a JOIN {ring} b ON b.source_id = a.target_id WHERE b.target_id = a.source_id AND b.source_id || b.target_id <> a.source_id || a.target_id
    UNION ALL SELECT a.source_id, 3, CAST(a.weight + b.weight + c.weight AS DECIMAL(18,4)), a.source_id || '>' || a.target_id || ' ' || b.source_id || '>' || b.target_id || ' ' || c.source_id || '>' || c.target_id
      FROM {ring} a JOIN {ring} b ON b.source_id = a.target_id JOIN {ring} c ON c.source_id = b.target_id WHERE c.target_id = a.source_id AND len(list_distinct([a.source_id || '>' || a.target_id, b.source_id || '>' || b.target_id, c.source_id || '>' || c.target_id])) = 3
    UNION ALL SELECT a.source_id, 4, CAST(a.weight + b.weight + c.weight + e.weight AS DECIMAL(18,4)), a.source_id || '>' || a.target_id || ' ' || b.source_id || '>' || b.target_id || ' ' || c.source_id || '>' || c.target_id || ' ' || e.source_id || '>' || e.target_id
      FROM {ring} a JOIN {ring} b ON b.source_id = a.target_id JOIN {ring} c ON c.source_id = b.target_id JOIN {ring} e ON e.source_id = c.target_id WHERE e.target_id = a.source_id
        AND len(list_distinct([a.source_id || '>' || a.target_id, b.source_id || '>' || b.target_id, c.source_id || '>' || c.target_id, e.source_id || '>' || e.target_id])) = 4)
    ORDER BY cycle_weight DESC, path LIMIT 50""",
    ring=_TEST_RING,
)(lambda d: graph.invoice_rings(test_ring(d)))
# firms that sell as suppliers and buy as customers: edges extracted from their invoices
_FIRMS = "SELECT concat('F', CAST(substring(supplier_taxpayer_id, 2) AS INT) % n) AS supplier_taxpayer_id, concat('F', CAST(substring(buyer_taxpayer_id, 2) AS INT) % n) AS buyer_taxpayer_id, total_amount FROM {invoices} CROSS JOIN (SELECT count(*) AS n FROM {supplier})"
_TRADE = "SELECT supplier_taxpayer_id AS s, buyer_taxpayer_id AS t, CAST(least(count(*), 9999.9999) AS DECIMAL(18,4)) AS w, supplier_taxpayer_id || '>' || buyer_taxpayer_id AS e FROM {firms} WHERE supplier_taxpayer_id <> buyer_taxpayer_id GROUP BY 1, 2"
query(
    "graph_trade_rings",
    """SELECT * FROM (
      SELECT a.s AS taxpayer_id, 2 AS cycle_length, CAST(a.w + b.w AS DECIMAL(18,4)) AS cycle_weight, a.e || ' ' || b.e AS path FROM {trade} a JOIN {trade} b ON b.s = a.t AND b.t = a.s
      UNION ALL SELECT a.s, 3, CAST(a.w + b.w + c.w AS DECIMAL(18,4)), a.e || ' ' || b.e || ' ' || c.e FROM {trade} a JOIN {trade} b ON b.s = a.t JOIN {trade} c ON c.s = b.t AND c.t = a.s WHERE b.t <> a.s
    ) ORDER BY cycle_weight DESC, path LIMIT 50""",
    firms=_FIRMS, trade=_TRADE,
)(lambda d: graph.invoice_rings(graph.invoice_trade(d.spark.sql(_FIRMS, invoices=d["invoices"], supplier=d["supplier"])), 3))

# scoring

_RULE_SCORES = "SELECT id AS taxpayer_id, CAST(CAST(substring(id, 2) AS INT) * 37 % 100 AS DECIMAL(5,2)) AS score, CASE WHEN CAST(substring(id, 2) AS INT) % 4 = 0 THEN 'OTHER' ELSE 'TAX_GAP_ENGINE' END AS source FROM {taxpayers}"
_OBS = f"""SELECT t.id AS taxpayer_id, t.kra_pin, t.legal_name, t.sector_name, t.county, coalesce(r.ps, DATE '{AS_OF}' - 30) AS period_start, coalesce(r.pe, DATE '{AS_OF}') AS period_end,
  CAST(coalesce(r.ds, 0) AS DECIMAL(18,2)) AS declared_sales, CAST(coalesce(r.di, 0) AS DECIMAL(18,2)) AS declared_income, CAST(coalesce(i.x, 0) AS DECIMAL(18,2)) AS invoice_sales, CAST(coalesce(c.x, 0) AS DECIMAL(18,2)) AS customs_landed_cost,
  CAST(coalesce(w.x, 0) AS DECIMAL(18,2)) AS withholding_income, CAST(coalesce(s.x, 0) AS DECIMAL(18,2)) AS risk_signal_gap, CAST(coalesce(k.x, 0) AS DECIMAL(5,2)) AS rule_score,
  coalesce(r.n, 0) AS return_count, coalesce(i.n, 0) AS invoice_count, coalesce(c.n, 0) AS customs_count, coalesce(w.n, 0) AS withholding_count, coalesce(s.n, 0) AS open_signal_count
FROM {{taxpayers}} t
LEFT JOIN (SELECT taxpayer_id, min(period_start) AS ps, max(period_end) AS pe, sum(declared_sales) AS ds, sum(declared_income) AS di, count(*) AS n FROM {{tax_returns}} GROUP BY 1) r ON r.taxpayer_id = t.id
LEFT JOIN (SELECT supplier_taxpayer_id AS id, sum(total_amount) AS x, count(*) AS n FROM {{invoices}} GROUP BY 1) i ON i.id = t.id
LEFT JOIN (SELECT taxpayer_id AS id, sum(total_landed_cost) AS x, count(*) AS n FROM {{customs_declarations}} GROUP BY 1) c ON c.id = t.id
LEFT JOIN (SELECT payee_taxpayer_id AS id, sum(gross_amount) AS x, count(*) AS n FROM {{withholding_certificates}} GROUP BY 1) w ON w.id = t.id
LEFT JOIN (SELECT taxpayer_id AS id, sum(greatest(coalesce(estimated_gap, 0), 0)) AS x, count(*) FILTER (WHERE upper(status) IN ('OPEN', 'NEW')) AS n FROM {{signals}} GROUP BY 1) s ON s.id = t.id
LEFT JOIN (SELECT taxpayer_id AS id, max(score) AS x FROM {{rscores}} WHERE source IN ('TAX_GAP_ENGINE', 'RULE_ENGINE') GROUP BY 1) k ON k.id = t.id
WHERE upper(t.status) = 'ACTIVE'"""
_PCT = "CAST(round(CAST(count(*) OVER (PARTITION BY {0} ORDER BY f) * 100 AS DOUBLE) / count(*) OVER (PARTITION BY {0}), 2) AS DECIMAL(5,2))"
_FEAT = f"""SELECT *, greatest(invoice_sales - declared_sales, 0)::DOUBLE / greatest(declared_sales, 1)::DOUBLE AS f1, greatest(customs_landed_cost - declared_income, 0)::DOUBLE / greatest(declared_income, 1)::DOUBLE AS f2,
  greatest(withholding_income - declared_income, 0)::DOUBLE / greatest(declared_income, 1)::DOUBLE AS f3, risk_signal_gap::DOUBLE / 100000.0::DOUBLE AS f4, rule_score::DOUBLE / 100.0::DOUBLE AS f5, p_all::DOUBLE / 100.0::DOUBLE AS f6, p_sec::DOUBLE / 100.0::DOUBLE AS f7
  FROM (SELECT *, {_PCT.format("1")} AS p_all, {_PCT.format("sector_name")} AS p_sec FROM (SELECT *, invoice_sales + customs_landed_cost + withholding_income + risk_signal_gap AS f FROM {{obs}}))"""
_POINTS = ", ".join(f"CAST(round(CAST(f{i} AS DECIMAL(24,10)) * {w}, 2) AS DECIMAL(18,2)) AS c{i}" for i, w in ((1, 30), (2, 24), (3, 18), (4, 12), (6, 10), (7, 10), (5, 6)))
ML = {"signals": rule_sql.ALL_SIGNALS, "rscores": _RULE_SCORES, "obs": _OBS, "feat": _FEAT}


def rule_scores(d: Domain) -> DataFrame:
    return d.spark.sql(_RULE_SCORES, taxpayers=d["taxpayers"])


def obs(d: Domain) -> DataFrame:
    signals = all_signals(d)
    return scoring.observations(months(d), signals, rule_scores(d), AS_OF)


query("ml_observations", "SELECT * FROM {obs}", **ML)(obs)
query("ml_percentiles", "SELECT taxpayer_id, p_all AS all_percentile, p_sec AS sector_percentile FROM {feat}", **ML)(lambda d: scoring.percentiles(obs(d)).select("taxpayer_id", "all_percentile", "sector_percentile"))
query(
    "ml_features",
    "SELECT taxpayer_id, round(f1, 8) AS invoice_to_declared_sales, round(f2, 8) AS customs_to_declared_income, round(f3, 8) AS withholding_to_declared_income, round(f4, 8) AS risk_signal_gap_scaled, round(f5, 8) AS rule_score_scaled, round(f6, 8) AS peer_group_percentile, round(f7, 8) AS sector_peer_percentile, round(f::DOUBLE / (SELECT greatest(max(f)::DOUBLE, 1) FROM {feat}), 8) AS revenue_footprint_scaled FROM {feat}",
    **ML,
)(lambda d: scoring.features(obs(d)).select("taxpayer_id", *[F.round(c, 8).alias(c) for c in scoring.FEATURES]))
query(
    "ml_contributions",
    f"SELECT taxpayer_id, CAST(least(100, c1 + c2 + c3 + c4 + c5 + c6 + c7) AS DECIMAL(5,2)) AS contribution_score, CAST(least(95, 55 + 8 * ((return_count > 0)::INT + (invoice_count > 0)::INT + (customs_count > 0)::INT + (withholding_count > 0)::INT + (open_signal_count > 0)::INT)) AS DECIMAL(5,2)) AS confidence_score FROM (SELECT *, {_POINTS} FROM {{feat}})",
    **ML,
)(lambda d: scoring.with_contributions(scoring.features(obs(d))).select("taxpayer_id", "contribution_score", "confidence_score"))
# the largest contributions of each taxpayer, of equals in the stated order
_FACTORS = ", ".join(f"{{'n': '{n}', 'c': c{k}, 'i': {i}}}".replace("{", "{{").replace("}", "}}") for i, (n, k) in enumerate(zip(scoring.WEIGHTS, (1, 2, 3, 4, 6, 7, 5), strict=True)))
query(
    "ml_top_factors",
    f"SELECT taxpayer_id, coalesce((SELECT string_agg(n, ',' ORDER BY c DESC, i) FROM (SELECT f.n, f.c, f.i FROM (SELECT unnest(fs) AS f) WHERE f.c > 0 ORDER BY f.c DESC, f.i LIMIT 4)), '') AS main_features FROM (SELECT taxpayer_id, [{_FACTORS}] AS fs FROM (SELECT *, {_POINTS} FROM {{feat}}))".replace("{{", "{").replace("}}", "}"),
    **ML,
)(lambda d: scoring.with_contributions(scoring.features(obs(d))).select("taxpayer_id", "main_features"))
query("ml_predictions")(lambda d: scoring.predict(obs(d)).select("taxpayer_id", "isolation_score", "model_score", "combined_score", "confidence_score", "main_features"))


def shapley_values(d: Domain) -> DataFrame:
    """What each feature gives the forest's mean path length of each taxpayer."""
    rows = catalog.written(scoring.features(obs(d)), "features")
    return scoring.explained(rows, scoring.grown_forest(rows))


query("ml_shapley_values")(shapley_values)
query("ml_prediction_list")(lambda d: scoring.prediction_list(scoring.predict(obs(d))).select("taxpayer_id", "combined_score"))
query("ml_run_metrics")(lambda d: scoring.run_metrics(scoring.predict(obs(d))))

# reports and return on investment

_CONF = "CAST(round(CAST(sum(confidence_score) AS DOUBLE) / count(*), 2) AS DECIMAL(5,2)) AS average_confidence"
_REP = "count(*) AS estimates, count(DISTINCT taxpayer_id) AS taxpayers, CAST(sum(estimated_gap) AS DECIMAL(18,2)) AS estimated_gap, CAST(sum(recoverable_tax) AS DECIMAL(18,2)) AS recoverable_tax, CAST(sum(total_recoverable) AS DECIMAL(18,2)) AS total_recoverable, " + _CONF
query("report_gap_by_sector", f"SELECT coalesce(sector_name, 'Unspecified') AS sector, tax_head, {_REP} FROM {{est}} JOIN {{taxpayers}} ON id = taxpayer_id GROUP BY 1, 2", **GAP)(lambda d: reports.gap_by_sector(gap_estimates(d), d["taxpayers"]))
query("report_gap_by_region", f"SELECT coalesce(county, 'Unspecified') AS region, tax_head, {_REP} FROM {{est}} JOIN {{taxpayers}} ON id = taxpayer_id GROUP BY 1, 2", **GAP)(lambda d: reports.gap_by_region(gap_estimates(d), d["taxpayers"]))
_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS DECIMAL(18,2)) AS {c}" for c in ("assessed_amount", "agreed_amount", "collected_amount"))
query(
    "report_officer_productivity",
    f"SELECT coalesce(officer, 'UNASSIGNED') AS officer, count(*) AS assigned_cases, count(*) FILTER (WHERE case_status <> 'CLOSED') AS open_cases, count(*) FILTER (WHERE case_status = 'CLOSED') AS closed_cases, {_SUMS}, CAST(round(CAST(sum(DATE '{AS_OF}' - opened_on) AS DOUBLE) / count(*), 2) AS DECIMAL(10,2)) AS average_case_age_days FROM {{cases}} c LEFT JOIN {{recovery_records}} r ON r.case_id = c.id GROUP BY 1",
)(lambda d: reports.officer_productivity(d["cases"], d["recovery_records"], AS_OF))
query("report_revenue_recovery", f"SELECT CAST(date_trunc('month', coalesce(collection_date, created_on)) AS DATE) AS period, coalesce(tax_head, 'UNSPECIFIED') AS tax_head, count(*) AS recovery_records, {_SUMS} FROM {{recovery_records}} r JOIN {{cases}} c ON c.id = r.case_id GROUP BY 1, 2")(
    lambda d: reports.revenue_recovery(d["recovery_records"], d["cases"])
)
query("report_audit_pipeline", "SELECT case_status AS status, count(*) AS case_count, CAST(sum(estimated_recoverable) AS DECIMAL(18,2)) AS estimated_recoverable, CAST(coalesce(sum(assessed_amount), 0) AS DECIMAL(18,2)) AS assessed_amount, CAST(coalesce(sum(collected_amount), 0) AS DECIMAL(18,2)) AS collected_amount FROM {cases} c LEFT JOIN {recovery_records} r ON r.case_id = c.id GROUP BY 1")(
    lambda d: reports.audit_pipeline(d["cases"], d["recovery_records"])
)
query(
    "roi_summary",
    """SELECT *, CAST(expected_recovery - pilot_cost AS DECIMAL(18,2)) AS net_benefit, CAST(round(expected_recovery::DOUBLE / pilot_cost::DOUBLE, 4) AS DECIMAL(18,4)) AS roi_multiple, CAST(round(pilot_cost::DOUBLE / (expected_recovery::DOUBLE / 12), 2) AS DECIMAL(18,2)) AS payback_months FROM (
      SELECT *, CAST(18500000 AS DECIMAL(18,2)) AS pilot_cost, CAST(round(recoverable_tax * CAST(0.18 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS expected_recovery FROM
      (SELECT CAST(sum(estimated_gap) AS DECIMAL(18,2)) AS estimated_gap, CAST(sum(recoverable_tax) AS DECIMAL(18,2)) AS recoverable_tax FROM {est}), (SELECT CAST(sum(collected_amount) AS DECIMAL(18,2)) AS collected_amount FROM {recovery_records}),
      (SELECT CAST(sum(variance_amount) AS DECIMAL(18,2)) AS variance_amount FROM {recon} WHERE settlement_status <> 'MATCHED'), (SELECT count(*) AS open_cases FROM {cases} WHERE case_status <> 'CLOSED'))""",
    **GAP, **RECON,
)(lambda d: reports.roi(gap_estimates(d), d["recovery_records"], recon(d), d["cases"]))
query("roi_scenarios", "SELECT s.scenario, CAST(s.rate AS DECIMAL(4,2)) AS rate, CAST(round(r * CAST(s.rate AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS expected_recovery FROM (VALUES ('CONSERVATIVE', 0.08), ('EXPECTED', 0.18), ('STRETCH', 0.30)) AS s(scenario, rate), (SELECT CAST(sum(recoverable_tax) AS DECIMAL(18,2)) AS r FROM {est})", **GAP)(
    lambda d: reports.roi_scenarios(gap_estimates(d))
)
query("dashboard_heads", "SELECT tax_head, CAST(sum(estimated_gap) AS DECIMAL(18,2)) AS estimated_gap, CAST(sum(total_recoverable) AS DECIMAL(18,2)) AS total_recoverable FROM {est} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 8", **GAP)(lambda d: reports.dashboard_heads(gap_estimates(d)))

# cases and notifications

_CSUMS = ", ".join(f"CAST(coalesce(sum(r.{c}), 0) AS DECIMAL(18,2)) AS {c}" for c in ("assessed_amount", "agreed_amount", "collected_amount"))
query("case_list", f"SELECT c.*, {_CSUMS} FROM (SELECT * FROM {{cases}} WHERE case_status = 'OPEN' ORDER BY opened_on DESC, id LIMIT 100) c LEFT JOIN {{recovery_records}} r ON r.case_id = c.id GROUP BY ALL")(
    lambda d: cases.case_list(d["cases"], d["recovery_records"], status="OPEN", limit=100)
)
_PRIO = "CASE WHEN {0} IS NULL THEN 'MEDIUM' WHEN {0} >= 1000000 THEN 'CRITICAL' WHEN {0} >= 250000 THEN 'HIGH' WHEN {0} >= 50000 THEN 'MEDIUM' ELSE 'LOW' END"
query("case_default_priority", f"SELECT id, {_PRIO.format('estimated_recoverable')} AS priority FROM {{cases}}")(lambda d: d["cases"].select("id", cases.default_priority(F.col("estimated_recoverable")).alias("priority")))
query(
    "case_recoverable",
    f"SELECT deterministic_key, recoverable, {_PRIO.format('recoverable')} AS priority FROM (SELECT s.deterministic_key, CAST(coalesce(e.recoverable_tax, s.estimated_gap) AS DECIMAL(18,2)) AS recoverable FROM {{signals}} s LEFT JOIN {{est}} e ON e.taxpayer_id = s.taxpayer_id AND e.tax_head = s.tax_head AND e.period_start = s.period_start AND e.period_end = s.period_end)",
    **GAP,
)(lambda d: cases.recoverable_of(kept_signals(d), taxgap.estimates(kept_signals(d))))
_REQ = "SELECT id, CASE WHEN id LIKE '%1' THEN 'CLOSED' WHEN id LIKE '%2' THEN 'AWAITING_TAXPAYER' ELSE 'IN_REVIEW' END AS to_status, CASE WHEN id LIKE '%11' THEN ' ' ELSE 'done' END AS reason FROM {cases}"
_STEPS = ", ".join(f"('{a}', '{b}')" for a, b in cases.TRANSITIONS)
query(
    "case_transitions",
    f"SELECT c.id, c.case_status AS from_status, r.to_status, p IS NULL AS accepted, p AS problem FROM (SELECT c.id, c.case_status, r.to_status, CASE WHEN s.a IS NULL THEN 'NOT_ALLOWED' WHEN r.to_status = 'CLOSED' AND trim(r.reason) = '' THEN 'REASON_REQUIRED' END AS p FROM {{cases}} c JOIN {{req}} r ON r.id = c.id LEFT JOIN (VALUES {_STEPS}) AS s(a, b) ON s.a = c.case_status AND s.b = r.to_status) c JOIN {{req}} r ON r.id = c.id",
    req=_REQ,
)(lambda d: cases.transitions(d["cases"], d.spark.sql(_REQ, cases=d["cases"])))
query("case_next_version", "SELECT case_id, max(CAST(length(case_id) AS INTEGER)) + 1 AS next_version FROM {recovery_records} GROUP BY 1")(lambda d: cases.next_version(d["recovery_records"].select("case_id", F.length("case_id").alias("version"))))
query(
    "case_linked_entities",
    "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY taxpayer_id ORDER BY weight DESC, edge_type, other) AS INTEGER) AS n FROM (SELECT source_id AS taxpayer_id, target_id AS other, edge_type, weight FROM {edges} UNION ALL SELECT target_id, source_id, edge_type, weight FROM {edges} WHERE target_type = 'TAXPAYER')) WHERE n <= 25",
    edges=_ALL_EDGES,
)(lambda d: cases.linked_entities(strongest_edges(d, 25)))


def _case_signals(d: Domain, signals: DataFrame) -> DataFrame:
    """Cases with a signal of their taxpayer: the one with the smallest key."""
    first = signals.filter("taxpayer_id IS NOT NULL").groupBy("taxpayer_id").agg(F.min("deterministic_key").alias("risk_signal_id"))
    return d["cases"].join(first, "taxpayer_id", "left")


def packs(d: Domain) -> DataFrame:
    """Evidence packs of all cases; every third case has a pack already."""
    old = d["cases"].filter("id LIKE '%3'").select(F.col("id").alias("case_id"), F.lit(1).alias("version"))
    signals = kept_signals(d)
    return cases.evidence_packs(_case_signals(d, signals), signals, d["taxpayers"], strongest_edges(d, 25), old)


_PACK = {
    "case_number": "case.caseNumber", "priority": "case.priority", "status": "case.status", "taxpayer": "taxpayer.id", "pin": "taxpayer.kraPin", "name": "taxpayer.name", "period_start": "period.start", "period_end": "period.end",
    "rule_code": "rule.code", "signal_type": "rule.signalType", "tax_head": "rule.taxHead", "observed": "gap.observedAmount", "estimated_gap": "gap.estimatedGap", "recoverable": "gap.estimatedRecoverableAmount", "confidence": "gap.confidenceScore",
    "check": "officerChecklist[0]", "note": "legalPolicyNotes[2]", "advice": "recommendation",
}
#: What is read of a pack, in one pass over its text.
_PACK_SCHEMA = """case struct<caseNumber string, priority string, status string>, taxpayer struct<id string, kraPin string, name string>, period struct<start string, end string>,
  rule struct<code string, signalType string, taxHead string>, gap struct<observedAmount decimal(18,2), estimatedGap decimal(18,2), estimatedRecoverableAmount decimal(18,2), confidenceScore decimal(18,2)>,
  sourceRecords string, linkedEntities array<struct<sourceId string, targetId string, edgeType string, weight decimal(8,4)>>, officerChecklist array<string>, legalPolicyNotes array<string>, recommendation string"""
_LINKED = "array_join(transform(p.linkedEntities, e -> concat_ws('/', e.edgeType, e.sourceId, e.targetId, e.weight)), ',')"
query(
    "case_evidence_packs",
    f"""SELECT c.id, CASE WHEN c.id LIKE '%3' THEN 2 ELSE 1 END AS version, 'Evidence pack for ' || c.id || ' covering ' || coalesce(s.rule_code, '') AS summary, c.id AS case_number, c.priority, c.case_status AS status, c.taxpayer_id AS taxpayer, coalesce(t.kra_pin, '') AS pin, coalesce(t.legal_name, '') AS name,
    CAST(s.period_start AS VARCHAR) AS period_start, CAST(s.period_end AS VARCHAR) AS period_end, s.rule_code, s.rule_code AS signal_type, s.tax_head, s.observed_amount AS observed, s.estimated_gap, c.estimated_recoverable AS recoverable, CAST(s.confidence_score AS DECIMAL(18,2)) AS confidence,
    '{cases.CHECKLIST[0]}' AS check, '{cases.NOTES[2]}' AS note, '{cases.RECOMMENDATION}' AS advice, coalesce(l.linked, '') AS linked, s.deterministic_key IS NOT NULL AS has_records
    FROM {{cases}} c LEFT JOIN (SELECT taxpayer_id, min(deterministic_key) AS k FROM {{signals}} WHERE taxpayer_id IS NOT NULL GROUP BY 1) f ON f.taxpayer_id = c.taxpayer_id LEFT JOIN {{signals}} s ON s.deterministic_key = f.k LEFT JOIN {{taxpayers}} t ON t.id = c.taxpayer_id
    LEFT JOIN (SELECT taxpayer_id, string_agg(edge_type || '/' || source_id || '/' || target_id || '/' || CAST(CAST(weight AS DECIMAL(8,4)) AS VARCHAR), ',' ORDER BY n) AS linked FROM (
      SELECT *, row_number() OVER (PARTITION BY taxpayer_id ORDER BY weight DESC, edge_type, source_id, target_id, source) AS n FROM (SELECT source_id AS taxpayer_id, * FROM {{edges}} UNION ALL SELECT target_id, * FROM {{edges}} WHERE target_type = 'TAXPAYER')) WHERE n <= 25 GROUP BY 1) l ON l.taxpayer_id = c.taxpayer_id""",
    edges=_ALL_EDGES, signals=rule_sql.ALL_SIGNALS,
)(
    lambda d: packs(d).select("id", "version", "summary", F.from_json("pack", _PACK_SCHEMA).alias("p"))
    .select("id", "version", "summary", *[F.expr(f"p.{x}").alias(n) for n, x in _PACK.items()], F.expr(_LINKED).alias("linked"), F.coalesce(F.substring("p.sourceRecords", 1, 1) == "{", F.lit(False)).alias("has_records"))
)
_TEMPLATES = [
    ("A_CODE_BEFORE_ALL", "EMAIL", "no", "no", True),
    ("CASE_FOLLOW_UP_EMAIL", "EMAIL", "old", "old", False),
    ("CASE_FOLLOW_UP_EMAIL", "EMAIL", "Case {{case}}", "Dear {{name}}, please review {{taxHead}} of {{amount}}.", True),
    ("SOFT_COMPLIANCE_EMAIL", "EMAIL", "Your return", "Dear {{name}}, {{taxHead}} of {{amount}} may be due.", True),
]
_TEMPLATE_SCHEMA = "code string, channel string, subject string, body string, active boolean"
query(
    "notify_nudges",
    "SELECT c.id AS case_id, CAST(NULL AS VARCHAR) AS risk_signal_id, 'EMAIL' AS channel, regexp_replace(lower(t.kra_pin), '[^a-z0-9]', '', 'g') || '@example.test' AS recipient, 'Case ' || c.id AS subject, 'Dear ' || t.legal_name || ', please review tax of ' || CAST(c.estimated_recoverable AS VARCHAR) || '.' AS body, 'SENT' AS status FROM {cases} c JOIN {taxpayers} t ON t.id = c.taxpayer_id",
)(
    lambda d: cases.nudges(
        d["cases"].withColumn("risk_signal_id", F.lit(None).cast("string")), d["taxpayers"],
        d.spark.createDataFrame([], "deterministic_key string, taxpayer_id string, tax_head string, estimated_gap decimal(18,2)"), d.spark.createDataFrame(_TEMPLATES, _TEMPLATE_SCHEMA),
    )
)
query(
    "notify_signal_nudges",
    "SELECT s.deterministic_key AS risk_signal_id, coalesce(regexp_replace(lower(t.kra_pin), '[^a-z0-9]', '', 'g'), 'taxpayer') || '@example.test' AS recipient, 'Dear ' || coalesce(t.legal_name, 'Taxpayer') || ', ' || s.tax_head || ' of ' || CAST(s.estimated_gap AS VARCHAR) || ' may be due.' AS body FROM {signals} s LEFT JOIN {taxpayers} t ON t.id = s.taxpayer_id",
    signals=rule_sql.ALL_SIGNALS,
)(lambda d: cases.nudges(None, d["taxpayers"], all_signals(d), d.spark.createDataFrame(_TEMPLATES, _TEMPLATE_SCHEMA)).select("risk_signal_id", "recipient", "body"))
query("notify_history", "SELECT id, taxpayer_id, opened_on AS sent_at FROM {cases} WHERE case_status = 'OPEN' ORDER BY opened_on DESC, id LIMIT 100")(
    lambda d: cases.notification_history(d["cases"].select("id", "taxpayer_id", F.col("case_status").alias("status"), F.col("opened_on").alias("sent_at")), status="OPEN").select("id", "taxpayer_id", "sent_at")
)

# integration and governance: jobs and sources from the event log

_JOBS = """SELECT concat('J-', event_id) AS id, concat('SRC-', user_id % 30) AS source_code, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_id % 7 = 0 THEN 'RETRY_SCHEDULED' ELSE 'COMPLETED' END AS status,
  ts AS started_at, ts AS completed_at, CAST(event_id % 5 AS INT) AS retries, 3 AS max_retries FROM {events}"""
_SOURCES = "SELECT concat('SRC-', r_regionkey * 8) AS code, r_regionkey <> 3 AS active, CAST(600 + 300 * r_regionkey AS INT) AS expected_minutes, CAST(NULL AS TIMESTAMP) AS last_loaded_at FROM {region}"
_NOW = "2024-01-31 00:00:00"
_FRESH = f"SELECT code, expected_minutes, minutes AS minutes_since, minutes > expected_minutes AS late, CASE WHEN minutes > expected_minutes THEN 'LATE' ELSE 'CURRENT' END AS alert_level FROM (SELECT s.*, CAST(coalesce(greatest(0, floor((epoch(TIMESTAMP '{_NOW}') - epoch(c)) / 60)), expected_minutes + 1) AS BIGINT) AS minutes FROM {{sources}} s LEFT JOIN (SELECT source_code, max(date_trunc('second', completed_at)) AS c FROM {{jobs}} WHERE status = 'COMPLETED' GROUP BY 1) j ON j.source_code = s.code WHERE s.active)"
INT = {"jobs": _JOBS, "sources": _SOURCES, "fresh": _FRESH}


def _jobs(d: Domain) -> DataFrame:
    return d.spark.sql(_JOBS, events=d["events"])


def _sources(d: Domain) -> DataFrame:
    return d.spark.sql(_SOURCES, region=d["region"])


_AT = datetime.fromisoformat(_NOW).replace(tzinfo=UTC)
query("integration_freshness", "SELECT * FROM {fresh}", **INT)(lambda d: governance.freshness(_sources(d), _jobs(d), _AT))
query("integration_errors", "SELECT id, status, retries <= max_retries AS retry_controlled FROM {jobs} WHERE status IN ('FAILED', 'RETRY_SCHEDULED') ORDER BY started_at DESC, id LIMIT 25", jobs=_JOBS)(lambda d: governance.integration_errors(_jobs(d)).select("id", "status", "retry_controlled"))
query("integration_readiness", "SELECT (SELECT count(*) FROM {fresh}) AS active_sources, (SELECT count(*) FROM {fresh} WHERE late) AS late_sources, count(*) FILTER (WHERE status = 'FAILED') AS failed_jobs, count(*) FILTER (WHERE status = 'RETRY_SCHEDULED' AND retries <= max_retries) AS controlled_retries FROM {jobs}", **INT)(
    lambda d: governance.readiness(_sources(d), _jobs(d), _AT)
)
query("integration_mapping", "SELECT r_regionkey AS region_id, r_name AS name FROM {region}")(lambda d: governance.mapped(d["region"], {"region_id": "r_regionkey", "name": "r_name"}))
_KEYS = ("password", "secret", "clientSecret", "client_secret", "token", "apiKey", "privateKey", "passphrase", "db_Password", "plain")
query("integration_redaction", "SELECT r_regionkey, " + ", ".join(f"'***' AS k{i}" for i in range(9)) + ", r_name AS k9, '{\"host\":\"' || r_name || '\",\"inner\":{\"token\":\"***\",\"privateKey\":\"***\",\"port\":1,\"db_Password\":\"***\"}}' AS profile FROM {region}")(
    lambda d: d["region"].select("r_regionkey", governance.redacted(F.create_map(*[x for k in _KEYS for x in (F.lit(k), F.col("r_name"))])).alias("m"), governance.redacted_json(F.concat(F.lit('{"host":"'), "r_name", F.lit('","inner":{"token":"a\\"b","privateKey":"x","port":1,"db_Password":7}}'))).alias("profile")).select(
        "r_regionkey", *[F.col("m")[k].alias(f"k{i}") for i, k in enumerate(_KEYS)], "profile"
    )
)
# a profile with secret names whose values are texts, numbers, objects, lists and null, at several depths
_PROFILE = """concat('{"host" : "', c_name, '", "token": {"value": ["', c_mktsegment, '", {"x": 1}]}, "inner":{"secret":[1, {"a": "}"}],"apiKey":null,"port":', c_custkey, ',"deep":{"Old_PASSWORD_1":', c_acctbal, ',"clientSecrets":"seen","list":[{"token":"seen in a list"}], "passphrase":"a\\\\"b" }}}')"""
_HIDDEN = """concat('{"host" : "', c_name, '", "token": "***", "inner":{"secret":"***","apiKey":"***","port":', c_custkey, ',"deep":{"Old_PASSWORD_1":"***","clientSecrets":"seen","list":[{"token":"seen in a list"}], "passphrase":"***"}}}')"""
query("integration_profiles", f"SELECT c_custkey, {_HIDDEN} AS profile FROM {{customer}}")(lambda d: d["customer"].select("c_custkey", governance.redacted_json(F.expr(_PROFILE)).alias("profile")))
_ROLES = ("SELECT n_name AS role FROM {nation}", "SELECT concat('NATION_', c_nationkey) AS role, c_custkey % 100 AS user_id FROM {customer} WHERE c_nationkey <> 5", "SELECT concat('NATION_', s_nationkey) AS role, concat('P', s_suppkey % 9) AS permission FROM {supplier}")
query("admin_role_counts", "SELECT r.role, coalesce(u.n, 0) AS users, coalesce(p.n, 0) AS permissions FROM {roles} r LEFT JOIN (SELECT role, count(DISTINCT user_id) AS n FROM {urole} GROUP BY 1) u USING (role) LEFT JOIN (SELECT role, count(DISTINCT permission) AS n FROM {perm} GROUP BY 1) p USING (role)", roles=_ROLES[0], urole=_ROLES[1], perm=_ROLES[2])(
    lambda d: governance.role_counts(d.spark.sql(_ROLES[0], nation=d["nation"]), d.spark.sql(_ROLES[1], customer=d["customer"]), d.spark.sql(_ROLES[2], supplier=d["supplier"]))
)
query("admin_role_permissions", "SELECT r.role, coalesce(string_agg(p.permission, ',' ORDER BY p.permission), '') AS permissions FROM {roles} r LEFT JOIN {perm} p USING (role) GROUP BY 1", roles=_ROLES[0], perm=_ROLES[2])(
    lambda d: governance.role_permission_arrays(d.spark.sql(_ROLES[0], nation=d["nation"]), d.spark.sql(_ROLES[2], supplier=d["supplier"])).select("role", F.array_join("permissions", ",").alias("permissions"))
)
query("admin_overview", "SELECT (SELECT count(*) FROM {region}) AS region, (SELECT count(*) FROM {nation}) AS nation, (SELECT count(*) FROM {supplier}) AS supplier, TRUE AS complete")(lambda d: governance.overview({n: d[n] for n in ("region", "nation", "supplier")}))
query("admin_audit_view", "SELECT id, actor, action FROM (SELECT concat('J-', event_id) AS id, concat('U', user_id) AS actor, event_type AS action, ts FROM {events}) WHERE action = 'click' ORDER BY ts DESC, id LIMIT 250")(
    lambda d: governance.audit_view(d["events"].select(F.concat(F.lit("J-"), "event_id").alias("id"), F.concat(F.lit("U"), "user_id").alias("actor"), F.col("event_type").alias("action"), F.col("ts").alias("created_at")), action="click", limit=1000).select("id", "actor", "action")
)

# rows of tables with quarantine: customers as records, some broken

_RAW = """SELECT CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('A', c_custkey % 400) END AS kra_pin, 'INDIVIDUAL' AS taxpayer_type, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS legal_name, 'ACTIVE' AS status,
  CASE WHEN c_custkey % 17 = 0 THEN 'not-a-date' ELSE '2020-01-01' END AS registered_at FROM {customer}"""


def _checked(d: Domain) -> tuple[DataFrame, DataFrame]:
    return ingest.validate(d.spark.sql(_RAW, customer=d["customer"]), "taxpayers", "job-1", "2024-01-01 00:00:00")


query("ingest_issues", "SELECT field, code, count(*) AS n FROM (SELECT 'legal_name' AS field, 'REQUIRED_FIELD_MISSING' AS code FROM {raw} WHERE trim(legal_name) = '' UNION ALL SELECT 'registered_at', 'INVALID_FIELD_VALUE' FROM {raw} WHERE try_cast(registered_at AS DATE) IS NULL) GROUP BY 1, 2", raw=_RAW)(
    lambda d: _checked(d)[1].groupBy("field", "code").agg(F.count("*").alias("n"))
)
query("ingest_valid", "SELECT kra_pin, legal_name, CAST(registered_at AS DATE) AS registered_at FROM (SELECT * FROM {raw} WHERE trim(legal_name) <> '' AND try_cast(registered_at AS DATE) IS NOT NULL)", raw=_RAW)(lambda d: _checked(d)[0].select("kra_pin", "legal_name", "registered_at"))
query("ingest_constraints", "SELECT 'PERSISTENCE_ERROR' AS code, count(kra_pin) - count(DISTINCT kra_pin) AS n FROM {raw} WHERE trim(legal_name) <> '' AND try_cast(registered_at AS DATE) IS NOT NULL HAVING count(kra_pin) > count(DISTINCT kra_pin)", raw=_RAW)(
    lambda d: ingest.constrain(_checked(d)[0], "taxpayers")[1].groupBy("code").agg(F.count("*").alias("n"))
)

# keyed merges

query("table_merge", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM {customer}")(
    lambda d: catalog.merge_by_key(d["customer"].select("c_custkey", "c_name", F.lit("old").alias("v")), d["customer"].filter("c_custkey % 2 = 0").select("c_custkey", "c_name", F.lit("new").alias("v")), ["c_custkey"])
)
query("table_insert_if_absent", "SELECT c_nationkey, min(c_name) AS c_name FROM {customer} WHERE c_nationkey > 4 GROUP BY 1")(
    lambda d: catalog.insert_if_absent(d["nation"].filter("n_nationkey <= 4").select(F.col("n_nationkey").alias("c_nationkey")), d["customer"].select("c_nationkey", "c_name"), ["c_nationkey"])
)
query("table_replace_tagged", "SELECT s_nationkey AS k, 'b' AS tag FROM {supplier} WHERE s_suppkey % 2 = 1 UNION ALL SELECT n_nationkey, 'a' FROM {nation}")(
    lambda d: catalog.replace_tagged(d["supplier"].select(F.col("s_nationkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 1, "b").otherwise("a").alias("tag")), d["nation"].select(F.col("n_nationkey").alias("k"), F.lit("a").alias("tag")), "tag", "a")
)
