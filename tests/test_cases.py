"""Evidence packs and redaction against the same written in plain Python."""

import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from assurelake.operators import cases, governance


def sanitized(x, in_lists=False):
    if isinstance(x, dict):
        return {k: "***" if k in governance.SECRET_KEYS or "password" in k.lower() else sanitized(v, in_lists) for k, v in x.items()}
    return [sanitized(v, True) for v in x] if in_lists and isinstance(x, list) else x


def anything(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 6)
    if kind < 6:
        return [None, True, rng.randrange(10**6), 1.5, 'a "quoted", {text}: \\ é\n', ""][kind]
    if kind == 6:
        return [anything(rng, depth + 1) for _ in range(rng.randrange(4))]
    keys = [*governance.SECRET_KEYS, "db_PassWord", "plain", "tokens", "Token", "a", 'quote"key', "é", ""]
    return {rng.choice(keys): anything(rng, depth + 1) for _ in range(rng.randrange(5))}


def test_redaction_is_the_walk(spark):
    rng = random.Random(8)
    values = [{rng.choice(["token", "a", "inner"]): anything(rng) for _ in range(3)} for _ in range(400)]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for v in values]
    for in_lists in (False, True):
        got = [governance.hidden(t, in_lists) for t in texts]
        assert [json.loads(g) for g in got] == [sanitized(v, in_lists) for v in values]
    assert governance.hidden('{"n": 1.50, "pass\\u0077ord": [1, {"x": "}"}], "m" : 1e5}') == '{"n": 1.50, "pass\\u0077ord":"***", "m" : 1e5}'.replace(":\"***\"", ": \"***\"")
    odd = [None, "", "text", "[1]", '{"a":', "{}", '"x"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, texts[0]])], "i int, t string")
    out = [r[0] for r in df.orderBy("i").select(governance.redacted_json(F.col("t"))).collect()]
    assert out == [None] * 5 + ["{}", None, governance.hidden(texts[0])]


def test_evidence_packs(spark):
    one = Decimal("1.5000")
    edges = [("TAXPAYER", "T1", "TAXPAYER", f"X{i:02d}", "TRADE", Decimal(i % 7), i, Decimal(i), None, "INV") for i in range(40)]
    edges += [("TAXPAYER", "X99", "TAXPAYER", "T1", "FLOW", Decimal(9), 1, Decimal(1), None, None), ("TAXPAYER", "T1", "TAXPAYER", "T1", "SELF", Decimal(8), 1, Decimal(1), None, "S"), ("TAXPAYER", "T2", "COUNTY", "c", "PERMIT", one, 2, Decimal(3), "L", "P")]
    edge_schema = "source_type string, source_id string, target_type string, target_id string, edge_type string, weight decimal(8,4), evidence_count long, evidence_amount decimal(18,2), target_label string, source string"
    signal = ("K1", "T1", "RULE", "TYPE", None, "2024-01-01", "2024-01-31", Decimal(10), Decimal(4), Decimal(6), Decimal(90), '{"ruleCode": "RULE", "thresholds": {"a": [1, 2]}}')
    signals = spark.createDataFrame([signal], "deterministic_key string, taxpayer_id string, rule_code string, signal_type string, tax_head string, period_start string, period_end string, observed_amount decimal(18,2), declared_amount decimal(18,2), estimated_gap decimal(18,2), confidence_score decimal(5,2), evidence string")
    rows = [("c1", "N-1", "T1", "OPEN", "HIGH", Decimal(5), "K1"), ("c2", "N-2", None, "OPEN", "LOW", None, None), ("c3", "N-3", "T2", "CLOSED", "LOW", Decimal(7), "gone")]
    given = spark.createDataFrame(rows, "id string, case_number string, taxpayer_id string, case_status string, priority string, estimated_recoverable decimal(18,2), risk_signal_id string")
    taxpayers = spark.createDataFrame([("T1", "P1", "Name"), ("T2", None, None)], "id string, kra_pin string, legal_name string")
    packs = spark.createDataFrame([("c1", 1), ("c1", 4)], "case_id string, version int")
    got = {r.id: r for r in cases.evidence_packs(given, signals, taxpayers, spark.createDataFrame(edges, edge_schema), packs).collect()}
    assert [(got[c].version, got[c].summary) for c in ("c1", "c2", "c3")] == [(5, "Evidence pack for N-1 covering RULE"), (1, "Evidence pack for N-2 covering "), (1, "Evidence pack for N-3 covering ")]
    pack = json.loads(got["c1"].pack)
    assert pack["case"] == {"id": "c1", "caseNumber": "N-1", "priority": "HIGH", "status": "OPEN"} and pack["taxpayer"] == {"id": "T1", "kraPin": "P1", "name": "Name"}
    assert pack["period"] == {"start": "2024-01-01", "end": "2024-01-31"} and pack["rule"] == {"code": "RULE", "signalType": "TYPE", "taxHead": ""}
    assert pack["gap"] == {"observedAmount": 10, "declaredAmount": 4, "estimatedGap": 6, "estimatedRecoverableAmount": 5, "confidenceScore": 90}
    assert pack["sourceRecords"] == json.loads(signal[-1])
    mine = sorted((e for e in edges if "T1" in (e[1], e[3])), key=lambda e: (-e[5], e[4], e[1], e[3]))[:25]
    assert [(e["sourceId"], e["targetId"], e["edgeType"], e["weight"], e["source"], e["evidence"]) for e in pack["linkedEntities"]] == [(e[1], e[3], e[4], e[5], e[9] or "", {"count": e[6], "amount": e[7]}) for e in mine]
    assert pack["officerChecklist"] == list(cases.CHECKLIST) and pack["recommendation"] == cases.RECOMMENDATION
    bare = json.loads(got["c2"].pack)
    assert bare["taxpayer"] == {"id": "", "kraPin": "", "name": ""} and bare["linkedEntities"] == [] and "sourceRecords" not in bare
    assert json.loads(got["c3"].pack)["linkedEntities"][0]["targetType"] == "COUNTY"


def test_a_pack_is_read_in_one_pass(spark, sf):
    """Each pack's text is parsed once, whatever is read of it, and a taxpayer's edges are made text once for all its cases."""
    from assurelake.plans.queries import QUERIES

    plan = QUERIES["case_evidence_packs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("get_json_object(") == 0 and plan.count("from_json(") == 1
    one = "source_type string, source_id string, target_type string, target_id string, edge_type string, weight decimal(8,4), evidence_count long, evidence_amount decimal(18,2), target_label string, source string"
    edges = spark.createDataFrame([("TAXPAYER", "T1", "COUNTY", "c", "PERMIT", Decimal(1), 2, Decimal(3), "L", "P")], one)
    signals = spark.createDataFrame([], "deterministic_key string, taxpayer_id string, rule_code string, signal_type string, tax_head string, period_start string, period_end string, observed_amount decimal(18,2), declared_amount decimal(18,2), estimated_gap decimal(18,2), confidence_score decimal(5,2), evidence string")
    given = spark.createDataFrame([(f"c{i}", "T1", "OPEN", "HIGH", Decimal(5), None) for i in range(3)], "id string, taxpayer_id string, case_status string, priority string, estimated_recoverable decimal(18,2), risk_signal_id string")
    taxpayers = spark.createDataFrame([("T1", "P1", "Name")], "id string, kra_pin string, legal_name string")
    packs = [json.loads(r.pack) for r in cases.evidence_packs(given, signals, taxpayers, edges).collect()]
    assert len(packs) == 3 and all(len(p["linkedEntities"]) == 1 and p["recommendation"] == cases.RECOMMENDATION for p in packs)
