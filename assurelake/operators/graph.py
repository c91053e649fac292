"""Relationship graph: edge extraction, neighbourhoods, high-risk pairs and rings.

Edges are one table: source_type, source_id, target_type, target_id, edge_type, weight and a few
figures of evidence. Nodes that aren't taxpayers have ids derived from their name.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assurelake.functions.scalar import clamp, stable_uuid
from assurelake.sources.catalog import written

# Fixed value: weights are clamped to what the column holds
MOST_WEIGHT = Decimal("9999.9999")


def _weight(c: Column) -> Column:
    return F.least(c.cast("decimal(24,4)"), F.lit(MOST_WEIGHT)).cast("decimal(8,4)")


def _edges(rows: DataFrame, kind: str, source: str, target_type: str, target: Column, label: Column, weight: Column, count: Column, amount: Column) -> DataFrame:
    return rows.select(
        F.lit("TAXPAYER").alias("source_type"), F.col("_s").alias("source_id"), F.lit(target_type).alias("target_type"), target.alias("target_id"), F.lit(kind).alias("edge_type"),
        _weight(weight).alias("weight"), count.cast("long").alias("evidence_count"), amount.cast("decimal(18,2)").alias("evidence_amount"), label.alias("target_label"), F.lit(source).alias("source"),
    )


def _flows(rows: DataFrame, a: str, b: str, amount: str, kind: str, source: str) -> DataFrame:
    """Edges from pairs of taxpayers that trade."""
    rows = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    rows = rows.groupBy(F.col(a).alias("_s"), F.col(b).alias("_t")).agg(F.count("*").alias("n"), F.sum(amount).alias("x"))
    return _edges(rows, kind, source, "TAXPAYER", F.col("_t"), F.lit(None).cast("string"), F.col("n"), F.col("n"), F.col("x"))


def _activity(rows: DataFrame, who: str, name: Column, label: Column, amount: Column, kind: str, node: str, source: str) -> DataFrame:
    """Edges from taxpayers to nodes whose id is derived from their name."""
    rows = rows.filter(F.col(who).isNotNull()).groupBy(F.col(who).alias("_s"), name.alias("_n"), label.alias("_l")).agg(F.count("*").alias("n"), F.sum(amount).alias("x"))
    amount = F.coalesce("x", F.lit(0))
    return _edges(rows, kind, source, node, stable_uuid(F.concat(F.lit(node + ":"), "_n")), F.col("_l"), F.col("n"), F.col("n"), amount)


def relationship_edges(rel: DataFrame) -> DataFrame:
    rows = rel.filter("target_taxpayer_id IS NOT NULL")
    return rows.select(
        F.lit("TAXPAYER").alias("source_type"), F.col("source_taxpayer_id").alias("source_id"), F.lit("TAXPAYER").alias("target_type"), F.col("target_taxpayer_id").alias("target_id"),
        F.col("relationship_type").alias("edge_type"), _weight(F.col("confidence_score") / 100).alias("weight"), F.lit(1).cast("long").alias("evidence_count"),
        F.lit(0).cast("decimal(18,2)").alias("evidence_amount"), F.lit(None).cast("string").alias("target_label"), F.lit("REGISTRY").alias("source"),
    )


def invoice_trade(invoices: DataFrame) -> DataFrame:
    return _flows(invoices, "supplier_taxpayer_id", "buyer_taxpayer_id", "total_amount", "INVOICE_TRADE", "ETIMS_INVOICES")


def withholding_flow(certificates: DataFrame) -> DataFrame:
    return _flows(certificates, "payer_taxpayer_id", "payee_taxpayer_id", "gross_amount", "WITHHOLDING_FLOW", "WITHHOLDING_CERTIFICATES")


def shared_registration(taxpayers: DataFrame) -> DataFrame:
    """Pairs with equal registration numbers, as they are written; empty ones are equal too."""
    t = taxpayers.filter("registration_number IS NOT NULL").select(F.col("id").alias("_s"), "registration_number")
    pairs = t.join(t.withColumnRenamed("_s", "_t"), "registration_number").filter("_s < _t")
    return _edges(pairs, "SHARED_REGISTRATION_NUMBER", "TAXPAYER_REGISTRY", "TAXPAYER", F.col("_t"), F.lit(None).cast("string"), F.lit(1), F.lit(2), F.lit(0))


def county_permits(permits: DataFrame) -> DataFrame:
    """Counts of permits by county; an unknown county is a node too. The amount is the number of active ones."""
    active = F.when(F.upper("permit_status") == "ACTIVE", 1).otherwise(0)
    label = F.concat(F.coalesce("county", F.lit("Unknown county")), F.lit(" permits"))
    return _activity(permits, "taxpayer_id", F.coalesce("county", F.lit("UNKNOWN")), label, active, "COUNTY_PERMIT_ACTIVITY", "PERMIT_COUNTY", "BUSINESS_PERMITS")


def channel_usage(payments: DataFrame) -> DataFrame:
    name, label = (F.concat("collecting_agency", F.lit(x), "revenue_channel") for x in (":", " / "))
    return _activity(payments, "payer_taxpayer_id", name, label, F.col("amount"), "PAYMENT_CHANNEL_USAGE", "PAYMENT_CHANNEL", "PAYMENT_TRANSACTIONS")


def import_activity(customs: DataFrame) -> DataFrame:
    label = F.concat(F.lit("HS "), F.coalesce("hs_code", F.lit("unclassified")))
    return _activity(customs, "taxpayer_id", F.coalesce("hs_code", F.lit("UNCLASSIFIED")), label, F.col("total_landed_cost"), "IMPORT_ACTIVITY", "IMPORT_ACTIVITY", "CUSTOMS_DECLARATIONS")


def strongest_shared(taxpayers: DataFrame, most: int) -> DataFrame:
    """shared_registration() without the edges that are not among the `most` first of either end: all are equally heavy, so
    those of a taxpayer that come first lead to the smallest ids that have its number. `most` edges a taxpayer are
    made at most."""
    t = taxpayers.filter("registration_number IS NOT NULL").select("registration_number", "id")
    # partial minima: no task gets a whole group
    smallest = t.withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(256)))
    for keys in (["registration_number", "_p"], ["registration_number"]):
        order = Window.partitionBy(*keys).orderBy("id")
        smallest = smallest.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most + 1)
    first = smallest.groupBy("registration_number").agg(F.array_sort(F.collect_list("id")).alias("_ids"))  # most + 1
    pairs = t.join(first, "registration_number").select("id", F.explode("_ids").alias("_o")).filter("id <> _o")
    pairs = pairs.select(F.least("id", "_o").alias("_s"), F.greatest("id", "_o").alias("_t")).distinct()
    return _edges(pairs, "SHARED_REGISTRATION_NUMBER", "TAXPAYER_REGISTRY", "TAXPAYER", F.col("_t"), F.lit(None).cast("string"), F.lit(1), F.lit(2), F.lit(0))


def counted(tables) -> DataFrame:
    """edge_counts() of all edges, of which those of shared numbers are counted from the sizes of groups."""
    sizes = tables["taxpayers"].filter("registration_number IS NOT NULL").groupBy("registration_number").agg(F.count("*").alias("n"))
    shared = sizes.agg(F.coalesce(F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)), F.lit(0)).cast("long").alias("edges")).filter("edges > 0")
    return edge_counts(extract(tables, strongest=0)).unionByName(shared.select(F.lit("SHARED_REGISTRATION_NUMBER").alias("edge_type"), "edges"))


def extract(tables, relationships: DataFrame | None = None, strongest: int | None = None) -> DataFrame:
    """All edges; with `strongest`, of those of shared registration numbers only the ones among so many first of either
    end (none, if 0)."""
    shared = shared_registration(tables["taxpayers"]) if strongest is None else strongest_shared(tables["taxpayers"], strongest)
    parts = [
        invoice_trade(tables["invoices"]), withholding_flow(tables["withholding_certificates"]), *([shared] if strongest != 0 else []),
        county_permits(tables["business_permits"]), channel_usage(tables["payment_transactions"]), import_activity(tables["customs_declarations"]),
    ]
    if relationships is not None:
        parts.append(relationship_edges(relationships))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("edges"))


def run_counters(edges: DataFrame, scores: DataFrame, taxpayers: DataFrame, minimum: int = 70, limit: int = 50, counts: DataFrame | None = None) -> DataFrame:
    """(counter, n): edges by type, all edges, and the high-risk clusters that a run reports (`limit` at most). With
    `counts`, those of all edges, `edges` may lack shared numbers beyond the `limit` first of either end: a
    taxpayer that lacks one has `limit` others."""
    counts = written((edge_counts(edges) if counts is None else counts).select(F.col("edge_type").alias("counter"), F.col("edges").alias("n")), "edge-counts")
    clusters = high_risk_clusters(edges, scores, taxpayers, minimum, limit).agg(F.count("*").alias("n")).select(F.lit("HIGH_RISK_CLUSTERS").alias("counter"), "n")
    return counts.unionByName(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("EDGES").alias("counter"), "n")).unionByName(clusters)


def merge_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes (node_type, id, label, risk_score) after rows are merged: a node that is there takes the new label, and the new
    score if there is one; one that isn't is added, with the score 0 if none is known. Keys are unique in both."""
    key = ["node_type", "id"]
    rows = nodes.join(new.select(*key, F.col("label").alias("_l"), F.col("risk_score").alias("_s"), F.lit(True).alias("_new")), key, "full")
    score = F.coalesce("_s", "risk_score", F.lit(0)).cast(nodes.schema["risk_score"].dataType)
    return rows.select(*key, F.when(F.col("_new"), F.col("_l")).otherwise(F.col("label")).alias("label"), F.when(F.col("_new"), score).otherwise(F.col("risk_score")).alias("risk_score"))


def _between(edges: DataFrame) -> DataFrame:
    return edges.filter("source_type = 'TAXPAYER' AND target_type = 'TAXPAYER'")


def neighbourhood(edges: DataFrame, taxpayers: DataFrame, taxpayer: str, limit: int = 80) -> DataFrame:
    """Edges of a taxpayer, and edges between taxpayers that start at one of its neighbours."""
    pairs = _between(edges)
    near = pairs.filter(F.col("source_id") == taxpayer).select(F.col("target_id").alias("id")).union(pairs.filter(F.col("target_id") == taxpayer).select("source_id")).distinct()
    own = edges.filter(((F.col("source_type") == "TAXPAYER") & (F.col("source_id") == taxpayer)) | ((F.col("target_type") == "TAXPAYER") & (F.col("target_id") == taxpayer)))
    more = pairs.filter((F.col("source_id") != taxpayer) & (F.col("target_id") != taxpayer)).join(near, F.col("source_id") == F.col("id"), "left_semi")
    rows = own.unionByName(more)
    names = taxpayers.select("id", "legal_name")
    rows = rows.join(names.select(F.col("id").alias("source_id"), F.col("legal_name").alias("source_label")), "source_id", "left")
    tt = names.select(F.col("id").alias("_tid"), F.col("legal_name").alias("_tname"))
    rows = rows.join(tt, (F.col("target_type") == "TAXPAYER") & (F.col("target_id") == F.col("_tid")), "left")
    rows = rows.withColumn("target_label", F.coalesce("_tname", "target_label", "target_type")).drop("_tid", "_tname")
    return rows.orderBy(F.desc("weight"), "edge_type", F.asc_nulls_last("target_label"), "source_id", "target_id").limit(limit)


def nodes(edges: DataFrame, scores: DataFrame, taxpayers: DataFrame) -> DataFrame:
    """The distinct ends of edges with their highest score."""
    ends = edges.select(F.col("source_type").alias("node_type"), F.col("source_id").alias("id"), F.lit(None).cast("string").alias("l"))
    ends = ends.unionByName(edges.select(F.col("target_type").alias("node_type"), F.col("target_id").alias("id"), F.col("target_label").alias("l")))
    ends = ends.groupBy("node_type", "id").agg(F.max("l").alias("l"))
    ends = ends.join(taxpayers.select("id", "legal_name"), "id", "left").join(highest(scores).withColumnRenamed("taxpayer_id", "id"), "id", "left")
    return ends.select("node_type", "id", F.coalesce("legal_name", "l", "node_type").alias("label"), F.coalesce("top", F.lit(0).cast("decimal(5,2)")).alias("risk_score"))


def highest(scores: DataFrame) -> DataFrame:
    return scores.groupBy("taxpayer_id").agg(F.max("score").alias("top"))


def _scored(edges: DataFrame, scores: DataFrame, taxpayers: DataFrame) -> DataFrame:
    known = taxpayers.select("id", "legal_name").join(highest(scores).withColumnRenamed("taxpayer_id", "id"), "id", "left").withColumn("top", F.coalesce("top", F.lit(0).cast("decimal(5,2)")))
    out = _between(edges)
    for side in ("source", "target"):
        out = out.join(known.select(F.col("id").alias(f"{side}_id"), F.col("legal_name").alias(f"{side}_name"), F.col("top").alias(f"{side}_score")), f"{side}_id")
    return out


def high_risk_clusters(edges: DataFrame, scores: DataFrame, taxpayers: DataFrame, minimum: int = 70, limit: int = 50) -> DataFrame:
    """Edges between taxpayers of which either has the score."""
    rows = _scored(edges, scores, taxpayers).filter((F.col("source_score") >= minimum) | (F.col("target_score") >= minimum))
    order = [F.desc(F.greatest("source_score", "target_score")), F.desc("weight"), F.asc("edge_type"), F.asc("source_id"), F.asc("target_id")]
    return rows.orderBy(*order).limit(limit).select("source_id", "source_name", "target_id", "target_name", "edge_type", "weight", "source_score", "target_score")


def clusters_of(clusters: DataFrame, taxpayer: str) -> DataFrame:
    return clusters.filter((F.col("source_id") == taxpayer) | (F.col("target_id") == taxpayer))


def high_risk_pairs(edges: DataFrame, scores: DataFrame, taxpayers: DataFrame, minimum: int = 70, limit: int = 100) -> DataFrame:
    """Pairs, from either end, of which both have the score."""
    rows = _scored(edges, scores, taxpayers).filter((F.col("source_score") >= minimum) & (F.col("target_score") >= minimum))
    both = _both_ways(rows, ("name", "score"))
    order = [F.desc("weight"), F.desc("source_score"), F.desc("target_score"), F.asc("source_id"), F.asc("target_id"), F.asc("edge_type")]
    return both.orderBy(*order).limit(limit).select("source_id", "target_id", "edge_type", "weight", "source_score", "target_score")


def _both_ways(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    swapped = {f"{a}_{c}": F.col(f"{b}_{c}") for c in ("id", *more) for a, b in (("source", "target"), ("target", "source"))}
    return rows.unionByName(rows.select(*[swapped[c].alias(c) if c in swapped else F.col(c) for c in rows.columns]))


def shared_identifiers(edges: DataFrame, limit: int = 100) -> DataFrame:
    """Pairs that share an identifier or an owner, from either end."""
    rows = _both_ways(_between(edges).filter(F.col("edge_type").isin("SHARED_REGISTRATION_NUMBER", "DIRECTOR", "BENEFICIAL_OWNER")))
    return rows.orderBy(F.desc("weight"), "source_id", "target_id", "edge_type").limit(limit).select("source_id", "target_id", "edge_type", "weight")


#: Heaviest edges among which the first rings are sought; four times as many while they have too few rings.
HEAVY = 2000


def _traded(edges: DataFrame) -> DataFrame:
    """(s, t, w) of the edges whose ends both sell and buy: only those can be on a ring."""
    # written, so that it goes to the edges where it is small
    on_both = written(edges.select(F.col("s").alias("x")).intersect(edges.select(F.col("t").alias("x"))), "traders")
    return edges.join(on_both.withColumnRenamed("x", "s"), "s", "left_semi").join(on_both.withColumnRenamed("x", "t"), "t", "left_semi").select("s", "t", "w")


def _heaviest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, out) and (x, into): the weight of each vertex's heaviest edge from and to it."""
    return edges.groupBy(F.col("s").alias("x")).agg(F.max("w").alias("out")), edges.groupBy(F.col("t").alias("x")).agg(F.max("w").alias("into"))


def _pruned(edges: DataFrame, longest: int, floor) -> DataFrame:
    """Edges that a ring of the weight `floor` can have: with the heaviest edges that can follow and precede them,
    and the heaviest of all between those, they reach it."""
    for _ in range(3):
        out, into = _heaviest(edges)
        most = edges.agg(F.max("w").alias("most"))  # one row
        rows = edges.join(out.withColumnRenamed("x", "t"), "t").join(into.withColumnRenamed("x", "s"), "s").crossJoin(F.broadcast(most))
        reach = F.col("w") + F.col("out") + (F.col("into") if longest > 2 else 0) + F.col("most") * max(0, longest - 3)
        edges = written(_traded(rows.filter(reach >= F.lit(floor))), "ring-edges")
    return edges


def _short_rings(edges: DataFrame, longest: int, floor) -> DataFrame:
    """_rings() of two and three edges that weigh `floor` at least. A ring of three is its two heaviest edges, which meet,
    and a third that weighs no more than either: so only paths of two are made whose lighter edge, counted twice, reaches
    the floor with the other. Few of the light edges, which are the most, are on such a path."""
    most = edges.agg(F.max("w")).first()[0]
    if most is None:
        return _rings(edges, longest)
    low = F.lit(floor)
    step = lambda *ends: F.concat_ws(" ", *(F.concat(F.col(a), F.lit(">"), F.col(b)) for a, b in ends))

    def found(rows: DataFrame, length: int, *starts: str) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.col(s[0]).alias("x"), step(*zip(s, s[1:] + s[0], strict=True)).alias("p")) for s in starts)))
        rows = rows.select(each.alias("r"), F.col("total").cast("decimal(18,4)").alias("cycle_weight"))
        return rows.select(F.col("r.x").alias("taxpayer_id"), F.lit(length).alias("cycle_length"), "cycle_weight", F.col("r.p").alias("path"))

    edge = lambda rows, a, b, w: rows.select(F.col("s").alias(a), F.col("t").alias(b), F.col("w").alias(w))
    pair = edges.filter((F.col("w") + most >= low) & (F.col("s") != F.col("t")))
    two = edge(pair, "x", "y", "w1").join(edge(pair, "y", "x", "w2"), ["x", "y"]).withColumn("total", F.col("w1") + F.col("w2"))
    out = found(two.filter(F.col("total") >= low), 2, "xy")
    if longest < 3:
        return out
    heavy, light = edges.filter(F.col("w") * 3 >= low), edges.filter(F.col("w") * 2 + most >= low)
    before, after = (heavy.groupBy(F.col(c).alias(v)).agg(F.max("w").alias("m")) for c, v in (("t", "y"), ("s", "y")))
    reaches = lambda more, less: (F.col(less) * 2 + F.col(more) >= low) & ~((F.col("x") == F.col("y")) & (F.col("y") == F.col("z")))
    # the first edge is the heavier one, or the second is
    follows = edge(light, "y", "z", "w2").join(before, "y").filter(F.col("w2") * 2 + F.col("m") >= low).drop("m")
    leads = edge(light, "x", "y", "w1").join(after, "y").filter(F.col("w1") * 2 + F.col("m") >= low).drop("m")
    columns = ["x", "y", "z", "w1", "w2"]
    paths = edge(heavy, "x", "y", "w1").join(follows, "y").filter((F.col("w2") <= F.col("w1")) & reaches("w1", "w2")).select(*columns)
    paths = paths.unionByName(leads.join(edge(heavy, "y", "z", "w2"), "y").filter((F.col("w1") < F.col("w2")) & reaches("w2", "w1")).select(*columns))
    last = edge(edges.filter(F.col("w") + 2 * most >= low), "z", "x", "w3")
    three = written(paths, "ring-paths").join(last, ["z", "x"]).withColumn("total", F.col("w1") + F.col("w2") + F.col("w3")).filter(F.col("total") >= low)
    # of equal weights the edges' names decide which is the third
    order = lambda w, a, b: F.struct(F.col(w).alias("w"), F.col(a).alias("a"), F.col(b).alias("b"))
    three = three.filter((order("w3", "z", "x") < order("w1", "x", "y")) & (order("w3", "z", "x") < order("w2", "y", "z")))
    return out.unionByName(found(three, 3, "xyz", "yzx", "zxy"))


def _rings(edges: DataFrame, longest: int, floor=None) -> DataFrame:
    """(taxpayer_id, cycle_length, cycle_weight, path) of all rings of 2 to `longest` (4 at most) different edges, a row for
    each start. Rings of four meet from paths of two, of which those go that can't reach `floor`."""
    if floor is not None and longest < 4:
        return _short_rings(edges, longest, floor)
    edge = lambda a, b: F.concat(F.col(a), F.lit(">"), F.col(b))
    one = edges.withColumn("e", edge("s", "t"))
    then = one.select(F.col("s").alias("t"), F.col("t").alias("u"), F.col("w").alias("w2"), F.col("e").alias("e2"))
    two = one.join(then, "t").filter("e <> e2").select(F.col("s").alias("x"), F.col("u").alias("z"), (F.col("w") + F.col("w2")).cast("decimal(18,4)").alias("w"), "e", "e2")

    def rows(found: DataFrame, length: int, *steps: str) -> DataFrame:
        return found.select(F.col("x").alias("taxpayer_id"), F.lit(length).alias("cycle_length"), F.col("total").cast("decimal(18,4)").alias("cycle_weight"), F.concat_ws(" ", *steps).alias("path"))

    out = rows(two.filter("x = z").withColumn("total", F.col("w")), 2, "e", "e2")
    if longest < 3:
        return out
    if floor is not None:
        leave, arrive = _heaviest(edges)
        last = F.col("out") if longest == 3 else F.col("out") + F.col("into")
        two = two.join(leave.withColumnRenamed("x", "z"), "z").join(arrive, "x").filter(F.col("w") + last >= F.lit(floor)).drop("out", "into")
    two = written(two, "ring-paths")
    back = one.select(F.col("s").alias("z"), F.col("t").alias("x"), F.col("w").alias("w3"), F.col("e").alias("e3"))
    three = two.join(back, ["x", "z"]).filter("e3 <> e AND e3 <> e2").withColumn("total", F.col("w") + F.col("w3"))
    out = out.unionByName(rows(three, 3, "e", "e2", "e3"))
    if longest < 4:
        return out
    other = two.select(F.col("x").alias("z"), F.col("z").alias("x"), F.col("w").alias("w3"), F.col("e").alias("e3"), F.col("e2").alias("e4"))
    four = two.join(other, ["x", "z"]).withColumn("total", F.col("w") + F.col("w3"))
    if floor is not None:
        four = four.filter(F.col("total") >= F.lit(floor))
    return out.unionByName(rows(four.filter("e3 <> e AND e3 <> e2 AND e4 <> e AND e4 <> e2"), 4, "e", "e2", "e3", "e4"))


def invoice_rings(edges: DataFrame, longest: int = 4, limit: int = 50) -> DataFrame:
    """The heaviest rings: cycles of two to `longest` trade edges that are all different, one row per start and path.

    Rings among the heaviest edges give a weight that the last row wanted has at least. Edges and paths of two that
    can't be on a ring of this weight go before anything is joined further. Weights aren't negative.
    """
    if not 2 <= longest <= 4:
        raise ValueError("rings have two to four edges")
    e = edges.filter("edge_type = 'INVOICE_TRADE' AND source_type = 'TAXPAYER' AND target_type = 'TAXPAYER'").select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.col("weight").cast("decimal(18,4)").alias("w"))
    e = written(_traded(e), "trade")
    order = [F.desc("cycle_weight"), F.asc("path")]
    most = HEAVY
    while True:
        heavy = written(e.orderBy(F.desc("w"), "s", "t").limit(most), "heavy")
        best = [r.cycle_weight for r in _rings(heavy, longest).orderBy(*order).limit(limit).select("cycle_weight").collect()]
        if len(best) == limit or heavy.count() < most:
            break
        most *= 4  # without a weight to reach nothing could go
    floor = min(best) if len(best) == limit else None
    if floor is not None and longest > 3:
        e = _pruned(e, longest, floor)
    return _rings(e, longest, floor).orderBy(*order).limit(limit)
