"""A stored index of names by trigram, for looking up taxpayers that resemble a name.

Three tables with buckets: postings (trigram -> taxpayer, revision), how many postings each trigram has, and the
taxpayers with their current names and revision. An addition appends postings, adds to the counts and merges the
taxpayers, as one commit; postings of a name that has changed since are told by their revision.

A lookup reads the buckets of the name's trigrams only. The lists of the rarest ones give first candidates; the
similarity s of the last one wanted bounds all others: whoever reaches s shares at least s * |name| trigrams, so at
least one of the |name| - s * |name| + 1 rarest. Lists beyond those are never read. Similarities are those
of the current names, so the result is that of comparing everyone.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assurelake.functions.scalar import clamp, trigrams
from assurelake.operators.resolution import match_candidates
from assurelake.sources.catalog import Catalog, written

POSTINGS, COUNTS, NAMED = "name_postings", "name_trigrams", "name_taxpayers"
COLUMNS = ["id", "kra_pin", "legal_name", "trading_name"]
#: Postings that the first candidates come from, at most (one list at least).
FIRST = 10_000


def add(catalog: Catalog, taxpayers: DataFrame, buckets: int = 64) -> None:
    """Index taxpayers (unique ids); those that are there already get the names given here."""
    with catalog.transaction() as t:
        rows = taxpayers.select(*COLUMNS)
        if t.exists(NAMED):
            old = t.lookup(NAMED, rows).select("id", F.col("revision").alias("_r"))
            rows = rows.join(old, "id", "left").withColumn("revision", F.coalesce(F.col("_r") + 1, F.lit(0))).drop("_r")
        else:
            rows = rows.withColumn("revision", F.lit(0))
        rows = written(rows, "named")
        both = F.array_distinct(F.concat(trigrams(F.col("legal_name")), trigrams(F.col("trading_name"))))
        postings = written(rows.select(F.explode(both).alias("trigram"), "id", "revision"), "postings")
        counts = postings.groupBy("trigram").agg(F.count("*").alias("n"))
        if t.exists(COUNTS):
            counts = counts.unionByName(t.lookup(COUNTS, counts)).groupBy("trigram").agg(F.sum("n").alias("n"))
            t.append(POSTINGS, postings)
            t.merge(COUNTS, counts, ["trigram"])
            t.merge(NAMED, rows, ["id"], ())
        else:
            t.write(POSTINGS, postings, ["trigram"], buckets)
            t.write(COUNTS, counts, ["trigram"], buckets)
            t.write(NAMED, rows, ["id"], buckets)


def _candidates(catalog: Catalog, grams: list[str]) -> DataFrame:
    """Current names of the taxpayers that have one of the trigrams."""
    spark = catalog.spark
    met = catalog.lookup(POSTINGS, spark.createDataFrame([(g,) for g in grams], "trigram string")).select("id", "revision").distinct()
    met = written(met, "met")
    return catalog.lookup(NAMED, met.select("id").distinct()).join(met, ["id", "revision"], "left_semi").select(*COLUMNS)


def candidates(catalog: Catalog, name: str, limit: int = 10) -> DataFrame:
    """As resolution.match_candidates over all indexed taxpayers."""
    spark, limit = catalog.spark, clamp(limit, 50)
    grams = spark.range(1).select(F.explode(trigrams(F.lit(name))).alias("trigram"))
    sizes = {r.trigram: r.n for r in catalog.lookup(COUNTS, grams).collect()}  # the name's trigrams
    asked = [r.trigram for r in grams.collect()]
    rare = sorted(asked, key=lambda g: (sizes.get(g, 0), g))
    first, total = 0, 0
    while first < len(rare) and (total == 0 or total + sizes.get(rare[first], 0) <= FIRST):
        total += sizes.get(rare[first], 0)
        first += 1
    found = written(match_candidates(_candidates(catalog, rare[:first]), name, limit), "matched")
    best = [r.confidence for r in found.select("confidence").collect()]  # limit rows
    at = min(best) if len(best) == limit else 0.0
    # the epsilon keeps a bound that is whole from being rounded up
    need = max(1, ceil(at * len(asked) - 1e-9))
    reach = len(asked) - need + 1
    if reach > first:
        found = match_candidates(_candidates(catalog, rare[:reach]), name, limit)
    return found.orderBy(F.desc("confidence"), F.asc_nulls_last("legal_name"), "id")
