"""Duplicate taxpayers as classes: what is linked, without a row for each pair.

Taxpayers with one registration number, and those whose names have one set of trigrams, are groups. Names are
compared between groups, each once, however many taxpayers have the name. A group's members link with each other and with the
members of similar groups, so links are counted from sizes; classes are what links connect. All results are linear in
the taxpayers and the links between different names; the pairs of one class are made on request.

Null and empty registration numbers and names without a trigram link with nothing. Ids are unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurelake.functions.scalar import trigrams
from assurelake.operators.components import components
from assurelake.operators.resolution import DUPLICATE_AT, duplicate_pairs, similar_pairs
from assurelake.sources.catalog import written

NUMBER, LEGAL, TRADING = "REGISTRATION_NUMBER", "LEGAL_NAME", "TRADING_NAME"


def memberships(taxpayers: DataFrame) -> DataFrame:
    """(kind, group, taxpayer_id, g): three rows a taxpayer at most; g is the trigram set of a name."""
    numbers = taxpayers.filter("registration_number <> ''").select(F.lit(NUMBER).alias("kind"), F.lower("registration_number").alias("group"), F.col("id").alias("taxpayer_id"), F.lit(None).cast("array<string>").alias("g"))
    out = numbers
    for kind, name in ((LEGAL, "legal_name"), (TRADING, "trading_name")):
        g = F.sort_array(trigrams(F.col(name)))
        rows = taxpayers.filter(F.col(name).isNotNull()).select(F.lit(kind).alias("kind"), F.col("id").alias("taxpayer_id"), g.alias("g")).filter(F.size("g") > 0)
        out = out.unionByName(rows.withColumn("group", F.sha2(F.concat_ws("\x00", "g"), 256)))
    return out


def groups(members: DataFrame) -> DataFrame:
    """(kind, group, g, representative, members): the representative is the smallest id."""
    return members.groupBy("kind", "group").agg(F.first("g").alias("g"), F.min("taxpayer_id").alias("representative"), F.count("*").alias("members"))


def name_links(found: DataFrame, at: float = DUPLICATE_AT) -> DataFrame:
    """(kind, a, b, similarity): groups of different names of a kind that resemble each other, a < b."""
    out = None
    for kind in (LEGAL, TRADING):
        sets = found.filter(F.col("kind") == kind).select(F.col("group").alias("key"), F.lit("*").alias("place"), "g")
        pairs = similar_pairs(sets, sets, at).select(F.lit(kind).alias("kind"), "a", "b", "similarity")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def classified(taxpayers: DataFrame, at: float = DUPLICATE_AT) -> tuple[DataFrame, DataFrame]:
    """(classes, links).

    classes: a row for each taxpayer that has a link: taxpayer_id, class_id (the smallest id that it is connected
    with), and with how many others its registration number, legal name and trading name link it.
    links: kind, representatives a and b of the two groups (the same for links within a group), the members of
    both, similarity, and how many pairs of taxpayers it stands for.
    """
    members = written(memberships(taxpayers), "members")
    found = written(groups(members), "groups")
    near = written(name_links(found, at), "name-links")
    size = found.select("kind", "group", "representative", "members")
    ends = [size.select("kind", *(F.col(c).alias(n) for c, n in (("group", s), ("representative", f"rep_{s}"), ("members", f"members_{s}")))) for s in ("a", "b")]
    between = near.join(ends[0], ["kind", "a"]).join(ends[1], ["kind", "b"])
    # links of a group's members: with each other, and with all of each similar group
    more = between.select("kind", F.col("a").alias("group"), F.col("members_b").alias("n")).unionByName(between.select("kind", F.col("b").alias("group"), F.col("members_a").alias("n")))
    more = more.groupBy("kind", "group").agg(F.sum("n").alias("n"))
    counted = size.join(more, ["kind", "group"], "left").select("kind", "group", "representative", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    each = members.select("kind", "group", "taxpayer_id").join(counted.filter("links > 0"), ["kind", "group"])
    per = each.groupBy("taxpayer_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("links"))), F.lit(0)).alias(n) for k, n in ((NUMBER, "number_links"), (LEGAL, "legal_name_links"), (TRADING, "trading_name_links"))])
    # a group is a star around its representative, a link between groups an edge between theirs
    edges = each.select(F.col("taxpayer_id").alias("a"), F.col("representative").alias("b")).unionByName(between.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    classes = per.join(components(edges).select(F.col("node").alias("taxpayer_id"), F.col("component").alias("class_id")), "taxpayer_id")
    within = size.filter("members > 1").select(
        "kind", F.col("representative").alias("a"), F.col("representative").alias("b"), F.col("members").alias("members_a"), F.col("members").alias("members_b"),
        F.lit(1.0).alias("similarity"), F.floor(F.col("members") * (F.col("members") - 1) / 2).cast("long").alias("pairs"),
    )
    across = between.select("kind", F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), F.when(F.col("rep_a") < F.col("rep_b"), F.col("members_a")).otherwise(F.col("members_b")).alias("members_a"),
                            F.when(F.col("rep_a") < F.col("rep_b"), F.col("members_b")).otherwise(F.col("members_a")).alias("members_b"), "similarity", (F.col("members_a") * F.col("members_b")).alias("pairs"))
    return classes.select("taxpayer_id", "class_id", "number_links", "legal_name_links", "trading_name_links"), within.unionByName(across)


def pairs_of(taxpayers: DataFrame, classes: DataFrame, class_id: str) -> DataFrame:
    """The pairs of one class with confidence and basis."""
    mine = classes.filter(F.col("class_id") == class_id).select(F.col("taxpayer_id").alias("id"))
    return duplicate_pairs(taxpayers.join(mine, "id", "left_semi"))


def registration_classes(taxpayers: DataFrame) -> DataFrame:
    """Registration numbers as they are written (empty ones too) that several taxpayers have: the number, the
    smallest id, how many have it, and how many edges between taxpayers that stands for."""
    rows = taxpayers.filter("registration_number IS NOT NULL").groupBy("registration_number").agg(F.min("id").alias("representative"), F.count("*").alias("members"))
    return rows.filter("members > 1").withColumn("edges", F.floor(F.col("members") * (F.col("members") - 1) / 2).cast("long"))
