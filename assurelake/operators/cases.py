"""Cases and notifications: lists, priorities, workflow, evidence packs and rendered messages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assurelake.functions.scalar import clamp

# The workflow's transitions
TRANSITIONS = [
    ("OPEN", "IN_REVIEW"),
    ("OPEN", "CLOSED"),
    ("IN_REVIEW", "AWAITING_TAXPAYER"),
    ("IN_REVIEW", "CLOSED"),
    ("AWAITING_TAXPAYER", "IN_REVIEW"),
    ("AWAITING_TAXPAYER", "CLOSED"),
]


def default_priority(amount: Column) -> Column:
    """Priority by the recoverable amount; an unknown amount is MEDIUM."""
    return F.when(amount.isNull(), "MEDIUM").when(amount >= 1_000_000, "CRITICAL").when(amount >= 250_000, "HIGH").when(amount >= 50_000, "MEDIUM").otherwise("LOW")


def case_list(cases: DataFrame, recovery: DataFrame, status: str | None = None, officer: str | None = None, limit: int = 50) -> DataFrame:
    """Newest cases with their recoveries; recoveries are summed only for the cases that are listed."""
    if status is not None:
        cases = cases.filter(F.col("case_status") == status)
    if officer is not None:
        cases = cases.filter(F.col("officer") == officer)
    order = [F.desc_nulls_last("opened_on"), F.asc("id")]
    top = cases.orderBy(*order).limit(clamp(limit, 200))
    sums = recovery.join(top.select(F.col("id").alias("case_id")), "case_id", "left_semi").groupBy(F.col("case_id").alias("id"))
    sums = sums.agg(*[F.sum(c).cast("decimal(18,2)").alias(c) for c in ("assessed_amount", "agreed_amount", "collected_amount")])
    out = top.join(sums, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("decimal(18,2)") for c in sums.columns if c != "id"}).orderBy(*order)


def recoverable_of(signals: DataFrame, estimates: DataFrame) -> DataFrame:
    """What a case on each signal would recover: the estimate of exactly its taxpayer, head and period,
    else the signal's gap."""
    keys = ["taxpayer_id", "tax_head", "period_start", "period_end"]
    best = estimates.groupBy(*keys).agg(F.max("recoverable_tax").alias("_r"))
    rows = signals.join(best, keys, "left")
    amount = F.coalesce("_r", "estimated_gap").cast("decimal(18,2)")
    return rows.select("deterministic_key", amount.alias("recoverable"), default_priority(amount).alias("priority"))


def transitions(cases: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (id, to_status, reason) with whether the workflow allows them and why not."""
    steps = cases.sparkSession.createDataFrame(TRANSITIONS, "from_status string, to_status string").withColumn("_ok", F.lit(True))
    rows = requests.join(cases.select("id", F.col("case_status").alias("from_status")), "id", "left").join(F.broadcast(steps), ["from_status", "to_status"], "left")
    no_reason = (F.col("to_status") == "CLOSED") & (F.trim(F.coalesce("reason", F.lit(""))) == "")
    problem = F.when(F.col("from_status").isNull(), "UNKNOWN_CASE").when(F.col("_ok").isNull(), "NOT_ALLOWED").when(no_reason, "REASON_REQUIRED")
    return rows.select("id", "from_status", "to_status", problem.isNull().alias("accepted"), problem.alias("problem"))


def apply_transitions(cases: DataFrame, decided: DataFrame) -> DataFrame:
    """cases with the accepted statuses (one request a case)."""
    new = decided.filter("accepted").select("id", F.col("to_status").alias("_s"))
    return cases.join(new, "id", "left").withColumn("case_status", F.coalesce("_s", "case_status")).select(*cases.columns)


def append_event(events: DataFrame, new: DataFrame) -> DataFrame:
    return events.unionByName(new)


def next_version(packs: DataFrame) -> DataFrame:
    """The number of each case's next evidence pack, from its packs (case_id, version)."""
    return packs.groupBy("case_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def linked_entities(edges: DataFrame, per_taxpayer: int = 25) -> DataFrame:
    """The strongest edges of every taxpayer, from either end."""
    near = edges.filter("source_type = 'TAXPAYER'").select(F.col("source_id").alias("taxpayer_id"), F.col("target_id").alias("other"), "edge_type", "weight")
    far = edges.filter("target_type = 'TAXPAYER'").select(F.col("target_id").alias("taxpayer_id"), F.col("source_id").alias("other"), "edge_type", "weight")
    best = Window.partitionBy("taxpayer_id").orderBy(F.desc("weight"), "edge_type", "other")
    return near.unionByName(far).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= per_taxpayer)


# Texts of every pack
CHECKLIST = (
    "Validate source-record identifiers against operational systems.",
    "Contact taxpayer or counterparty for documented explanation.",
    "Confirm tax-head treatment, exemptions, and period cut-off.",
    "Record recovery assessment and decision notes before closure.",
)
NOTES = (
    "Evidence pack is decision support and requires officer validation before assessment.",
    "Use only for authorized revenue administration workflows.",
    "Preserve audit trail when exporting or sharing sensitive records.",
)
RECOMMENDATION = "Review source records, linked entities, and taxpayer explanation before confirming recoverable amount."


def linked_records(edges: DataFrame, per_taxpayer: int = 25) -> DataFrame:
    """(taxpayer_id, linkedEntities): the strongest edges of every taxpayer, from either end, as a list."""
    edge = F.struct(
        F.col("source_type").alias("sourceType"), F.col("source_id").alias("sourceId"), F.col("target_type").alias("targetType"), F.col("target_id").alias("targetId"), F.col("edge_type").alias("edgeType"), "weight",
        F.coalesce("source", F.lit("")).alias("source"), F.struct(F.col("evidence_count").alias("count"), F.col("evidence_amount").alias("amount")).alias("evidence"),
    )
    ends = [edges.filter(F.col(f"{s}_type") == "TAXPAYER").select(F.col(f"{s}_id").alias("taxpayer_id"), edge.alias("e")) for s in ("source", "target")]
    # an edge from a taxpayer to itself is one edge
    rows = ends[0].unionByName(ends[1].filter("e.sourceType <> 'TAXPAYER' OR e.sourceId <> e.targetId"))
    best = Window.partitionBy("taxpayer_id").orderBy(F.desc("e.weight"), "e.edgeType", "e.sourceId", "e.targetId", "e.source")
    top = rows.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= per_taxpayer)
    return top.groupBy("taxpayer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]).alias("linkedEntities"))  # per_taxpayer at most


def evidence_packs(cases: DataFrame, signals: DataFrame, taxpayers: DataFrame, edges: DataFrame, packs: DataFrame | None = None) -> DataFrame:
    """(id, version, summary, pack): a nested document per case as JSON - case, taxpayer, period, rule, gap, source
    records (the signal's evidence), the 25 strongest edges of the taxpayer, checklist and notes.

    `cases` has risk_signal_id, and case_number where that isn't its id. Unknown names are empty, a case without a
    taxpayer has no linked entities, amounts and dates that aren't known are left out. The version follows the
    case's packs (case_id, version). Edges are made text once for a taxpayer, whatever the number of its cases.
    """
    empty = lambda c: F.coalesce(c, F.lit(""))
    number = F.col("case_number") if "case_number" in cases.columns else F.col("id")
    one = cases.select(
        "id", "taxpayer_id", "risk_signal_id", number.alias("_number"), F.col("estimated_recoverable").alias("_recoverable"),
        F.struct("id", number.alias("caseNumber"), "priority", F.col("case_status").alias("status")).alias("case"),
    )
    who = taxpayers.select(F.col("id").alias("taxpayer_id"), "kra_pin", "legal_name")
    sig = signals.select(
        F.col("deterministic_key").alias("risk_signal_id"), "rule_code", F.struct(F.col("period_start").alias("start"), F.col("period_end").alias("end")).alias("period"),
        F.struct(F.col("rule_code").alias("code"), F.col("signal_type").alias("signalType"), empty("tax_head").alias("taxHead")).alias("rule"),
        "observed_amount", "declared_amount", "estimated_gap", "confidence_score", F.parse_json("evidence").alias("sourceRecords"),
    )
    # cases without a signal are spread: as nulls they would all go to one task
    one = one.withColumn("_sig", F.coalesce("risk_signal_id", F.concat(F.lit("\0"), "id")))
    linked = linked_records(edges).select("taxpayer_id", F.to_json("linkedEntities").alias("_linked"))
    rows = one.join(who, "taxpayer_id", "left").join(sig.withColumnRenamed("risk_signal_id", "_sig"), "_sig", "left").join(linked, "taxpayer_id", "left")
    amounts = (("observed_amount", "observedAmount"), ("declared_amount", "declaredAmount"), ("estimated_gap", "estimatedGap"), ("_recoverable", "estimatedRecoverableAmount"), ("confidence_score", "confidenceScore"))
    parts = [
        "case", F.struct(empty("taxpayer_id").alias("id"), empty("kra_pin").alias("kraPin"), empty("legal_name").alias("name")).alias("taxpayer"), "period", "rule",
        F.struct(*[F.col(c).alias(n) for c, n in amounts]).alias("gap"), "sourceRecords",
    ]
    last = json.dumps({"officerChecklist": CHECKLIST, "legalPolicyNotes": NOTES, "recommendation": RECOMMENDATION}, separators=(",", ":"))
    own = F.to_json(F.struct(*parts))  # of which `case` is there in any case
    pack = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"linkedEntities":'), F.coalesce("_linked", F.lit("[]")), F.lit("," + last[1:]))
    if packs is not None:
        rows = rows.join(next_version(packs).withColumnRenamed("case_id", "id"), "id", "left")
    version = F.coalesce("next_version", F.lit(1)) if packs is not None else F.lit(1)
    summary = F.concat(F.lit("Evidence pack for "), "_number", F.lit(" covering "), empty("rule_code"))
    return rows.select("id", version.cast("int").alias("version"), summary.alias("summary"), pack.alias("pack"))


# notifications


def render(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {{key}} replaced; a null value is empty."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return template


def default_recipient(channel: Column, pin: Column, sms: str = "+254700000000") -> Column:
    """The test number, or an address from the PIN; a taxpayer without one is `taxpayer`."""
    name = F.when(F.trim(F.coalesce(pin, F.lit(""))) == "", "taxpayer").otherwise(F.regexp_replace(F.lower(pin), "[^a-z0-9]", ""))
    return F.when(channel == "SMS", sms).otherwise(F.concat(name, F.lit("@example.test")))


# The default template's code for a text message, a message on a case, and one on a signal
SMS_CODE, CASE_CODE, SIGNAL_CODE = "SOFT_COMPLIANCE_SMS", "CASE_FOLLOW_UP_EMAIL", "SOFT_COMPLIANCE_EMAIL"


def nudge_sources(cases: DataFrame | None, signals: DataFrame, taxpayers: DataFrame) -> DataFrame:
    """What messages are about: each case with its signal (the taxpayer is the case's, else the signal's), or
    without cases each signal."""
    sig = signals.select(F.col("deterministic_key").alias("risk_signal_id"), F.col("taxpayer_id").alias("_st"), F.col("tax_head").alias("_head"), "estimated_gap")
    if cases is None:
        rows = sig.select(F.lit(None).cast("string").alias("id"), "risk_signal_id", F.col("_st").alias("taxpayer_id"), F.col("_head").alias("tax_head"), F.col("estimated_gap").alias("amount"))
    else:
        rows = cases.join(sig, "risk_signal_id", "left")
        amount = F.coalesce("estimated_gap", "estimated_recoverable", F.lit(0).cast("decimal(18,2)"))
        rows = rows.select("id", "risk_signal_id", F.coalesce("taxpayer_id", "_st").alias("taxpayer_id"), F.col("_head").alias("tax_head"), amount.alias("amount"))
    return rows.join(taxpayers.select(F.col("id").alias("taxpayer_id"), "kra_pin", "legal_name"), "taxpayer_id", "left")


def nudges(cases: DataFrame | None, taxpayers: DataFrame, signals: DataFrame, templates: DataFrame, channel: str = "EMAIL", code: str | None = None) -> DataFrame:
    """A message for each case (or, without cases, each signal) from the active template of a code, by default
    that of the channel and kind of source. No such template, no message."""
    code = code or (SMS_CODE if channel == "SMS" else CASE_CODE if cases is not None else SIGNAL_CODE)
    t = templates.filter((F.col("code") == code) & F.col("active")).limit(1).select("subject", "body")
    rows = nudge_sources(cases, signals, taxpayers).crossJoin(F.broadcast(t))  # one template
    values = {"name": F.coalesce("legal_name", F.lit("Taxpayer")), "case": F.col("id"), "amount": F.col("amount"), "taxHead": F.coalesce("tax_head", F.lit("tax"))}
    return rows.select(
        F.col("id").alias("case_id"), "risk_signal_id", F.lit(channel).alias("channel"), default_recipient(F.lit(channel), F.col("kra_pin")).alias("recipient"),
        render(F.col("subject"), values).alias("subject"), render(F.col("body"), values).alias("body"), F.lit("SENT").alias("status"),
    )


def notification_history(sent: DataFrame, taxpayer: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    if taxpayer is not None:
        sent = sent.filter(F.col("taxpayer_id") == taxpayer)
    if status is not None:
        sent = sent.filter(F.col("status") == status)
    return sent.orderBy(F.desc_nulls_last("sent_at"), "id").limit(clamp(limit, 500))


def respond(sent: DataFrame, answers: DataFrame) -> DataFrame:
    """sent with the answered ones marked RESPONDED (answers: id, response)."""
    rows = sent.join(answers.select("id", F.col("response").alias("_r")), "id", "left")
    return rows.withColumns({"status": F.when(F.col("_r").isNotNull(), "RESPONDED").otherwise(F.col("status")), "response": F.coalesce("_r", "response")}).select(*sent.columns)
