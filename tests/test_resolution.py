from pyspark.sql import functions as F

from assurelake.functions.scalar import similarity, stable_uuid
from assurelake.operators import resolution
from assurelake.sources.catalog import written

TP = "id string, kra_pin string, legal_name string, trading_name string, registration_number string, county string"


def test_similarity(spark):
    row = spark.range(1).select(
        similarity(F.lit("Amani Wholesale Trader Limited"), F.lit("Amani Wholesale Traders Ltd")).alias("a"), similarity(F.lit(""), F.lit("")).alias("b"), similarity(F.lit("x"), F.lit(None).cast("string")).alias("c"), stable_uuid(F.lit("a")).alias("u")
    ).first()
    assert round(row.a, 4) == 0.6389 and row.b == 0 and row.c == 0
    assert row.u == "0cc175b9-c0f1-b6a8-31c3-99e269772661"


def test_fuzzy_permit_links(spark):
    who = spark.createDataFrame([("a", "P1", "Amani Wholesale Traders Ltd", None, None, "Nairobi"), ("b", "P2", "Rift Valley Logistics Ltd", None, None, "Nakuru")], TP)
    permits = spark.createDataFrame([(None, "1", "NAIROBI", "Amani Wholesale Trader Limited"), (None, "2", "Nakuru", "Downtown Bakery"), (None, "3", None, "Rift Valley Logistics"), (None, "4", "Nakuru", None)], "taxpayer_id string, permit_number string, county string, business_activity string")
    got = {r.permit_number: r.taxpayer_id for r in resolution.link_permits(permits, who).collect()}
    assert got == {"1": "a", "3": "b"}


def test_fuzzy_permit_links_by_either_name(spark):
    """Taxpayers with both names, against the similarity to each of them."""
    names = [("Amani Wholesale Traders Ltd", "Blue Heron Bakery"), ("Rift Valley Logistics Ltd", "Savanna Fresh Produce"), ("Lake Retail Company", "Lake Retail Traders"), ("Omega Tools", "Zebra Motor Spares")]
    who = spark.createDataFrame([(str(i), f"P{i}", n, t, None, "N") for i, (n, t) in enumerate(names)], TP).persist()
    wanted = [x for pair in names for x in pair] + ["Blue Heron Bakeries", "Rift Valley Logistics", "Something Else"]
    permits = spark.createDataFrame([(None, str(i), "n", a) for i, a in enumerate(wanted)], "taxpayer_id string, permit_number string, county string, business_activity string").persist()
    got = {(r.permit_number, r.taxpayer_id, round(r.similarity, 6)) for r in resolution.link_permits(permits, who).collect()}
    each = F.greatest(similarity(F.col("business_activity"), F.col("legal_name")), similarity(F.col("business_activity"), F.col("trading_name")))
    best = {}
    for r in permits.select("permit_number", "business_activity").crossJoin(who).select("permit_number", "id", each.alias("s")).filter("s >= 0.55").orderBy("s", F.desc("id")).collect():
        best[r.permit_number] = (r.permit_number, r.id, round(r.s, 6))
    assert got == set(best.values()) and len(got) == 10


def test_duplicates_against_all_pairs(spark):
    names = ["Lake Retail Traders Ltd", "Lake Retail Traders Ltd.", "LAKE retail traders LTD", "Lake Retail Trader Ltd", "Other Company", "", "Omega Tools", "Omega  tools"]
    who = spark.createDataFrame([(str(i), f"P{i}", n, None, "BN-1" if i in (4, 6) else None, "N") for i, n in enumerate(names)], TP).persist()
    got = {(r.source_id, r.target_id): (round(r.confidence, 6), r.basis) for r in resolution.duplicate_pairs(who).collect()}
    a, b = who.select(F.col("id").alias("x"), F.col("legal_name").alias("n")), who.select(F.col("id").alias("y"), F.col("legal_name").alias("m"))
    near = {(r.x, r.y): (round(r.s, 6), "FUZZY_NAME") for r in a.crossJoin(b).filter("x < y").select("x", "y", similarity(F.col("n"), F.col("m")).alias("s")).filter("s >= 0.9").collect()}
    assert got == near | {("4", "6"): (1.0, "REGISTRATION_NUMBER")}


def test_exact_links_and_identifiers(spark):
    who = spark.createDataFrame([("a", "P1", "A", None, "R", "N"), ("b", "P2", "B", None, "R", "N")], TP)
    rows = spark.createDataFrame([("p1", None), ("P2", "z"), ("P9", None), (None, None)], "pin string, link string")
    got = {(r.pin, r.link) for r in resolution.link_by_pin(rows, who, "pin", "link").collect()}
    assert got == {("p1", "a"), ("P2", "z"), ("P9", None), (None, None)}
    ids = resolution.identifiers(who)
    assert {(r.identifier_type, r.identifier_value, r.taxpayer_id) for r in ids.collect()} == {("KRA_PIN", "P1", "a"), ("KRA_PIN", "P2", "b"), ("REGISTRATION_NUMBER", "R", "a")}
    assert resolution.identifiers(who, ids).count() == 0


def test_linked_rows_are_spread_over_tasks(spark):
    """Rows that have a link, and those without a PIN, don't all go to one task of the join."""
    who = spark.createDataFrame([("a", "P1"), ("1", "5")], "id string, kra_pin string")
    rows = spark.range(4000).select(F.col("id").alias("n"), F.lit("P1").alias("pin"), F.when(F.col("id") % 10 > 0, "z").alias("link"))
    rows = rows.unionByName(spark.range(4000, 8000).select(F.col("id").alias("n"), F.lit(None).cast("string").alias("pin"), F.lit(None).cast("string").alias("link")))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        got = resolution.link_by_pin(rows, who, "pin", "link").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.n, r.link) for r in got} == {(n, ("z" if n % 10 else "a") if n < 4000 else None) for n in range(8000)}
    sizes = [sum(r.task == t for r in got) for t in {r.task for r in got}]
    assert max(sizes) < 3000


def test_keys_of_names_are_made_once(spark):
    """The join of similar names reads keys that were written, once a side, whatever places are known; pairs of a table
    with itself come once, with the similarity of their names."""
    names = ["Customer 000112112", "Customer 000112113", "Customer 000121121", "Customer 000112", "\U00010400\U00010400\U00010400 Traders", "\U00010400\U00010400 Traders", "Other"]
    rows = spark.createDataFrame([(str(i), n, None if i % 3 == 0 else "p") for i, n in enumerate(names * 2)], "id string, n string, c string")
    sets = written(resolution.named(rows, "id", F.col("n"), F.col("c")), "test-names")
    met = resolution.similar_pairs(sets, sets, 0.8)
    assert "Generate" not in met._jdf.queryExecution().optimizedPlan().toString()
    x, y = (rows.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("c").alias(f"c{i}")) for i in "ab")
    every = x.crossJoin(y).filter("a < b AND (ca = cb OR ca IS NULL OR cb IS NULL)").select("a", "b", similarity(F.col("na"), F.col("nb")).alias("s")).filter("s >= 0.8")
    got = sorted((r.a, r.b, round(r.similarity, 9)) for r in met.collect())
    assert got == sorted((r.a, r.b, round(r.s, 9)) for r in every.collect()) and len(got) > 7


def test_names_that_share_too_little_make_no_keys(spark):
    """Of names whose trigrams the other side hardly has, no keys are made."""
    sets = resolution.named(spark.createDataFrame([("1", "Customer 000000123"), ("2", "Supplier 000000123")], "id string, n string"), "id", F.col("n"))
    counts = sets.filter("key = '2'").select(F.explode("g").alias("t")).withColumn("met", F.lit(True))
    counts = sets.select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("n")).join(counts, "t", "left").select("t", "n", resolution.coded(F.col("t")).alias("code"), F.coalesce("met", F.lit(False)).alias("met"))
    assert {r.key for r in resolution.with_prefix(sets, counts, 0.8).select("key").distinct().collect()} == {"2"}
