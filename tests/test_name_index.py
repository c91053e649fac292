"""Lookups in the index of names against comparing everyone."""

import random

from assurelake.operators import name_index
from assurelake.operators.resolution import match_candidates
from assurelake.sources.catalog import Catalog

SCHEMA = "id string, kra_pin string, legal_name string, trading_name string"


def test_lookups_are_those_of_a_scan(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = ["amani", "baraka", "cedar", "delta", "limited", "traders", "wholesale", "kenya", "foods", "zq"]
    name = lambda: " ".join(rng.choices(words, k=rng.randint(1, 4))) + rng.choice(["", f" {rng.randrange(100)}"]) if rng.random() < 0.9 else rng.choice([None, "", "!!"])
    people = {f"t{i:03d}": (f"t{i:03d}", f"P{i}", name(), name()) for i in range(200)}
    catalog = Catalog(spark, f"file://{tmp_path}/c")
    monkeypatch.setattr(name_index, "FIRST", 40)
    name_index.add(catalog, spark.createDataFrame([(i, p, "Other Name", t) for i, p, _, t in list(people.values())[:150]], SCHEMA), 16)
    name_index.add(catalog, spark.createDataFrame([people[k] for k in list(people)[100:]], SCHEMA))
    name_index.add(catalog, spark.createDataFrame([people[k] for k in list(people)[:100]], SCHEMA))
    every = spark.createDataFrame(list(people.values()), SCHEMA)
    read = []
    candidates = name_index._candidates
    monkeypatch.setattr(name_index, "_candidates", lambda c, grams: read.append(len(grams)) or candidates(c, grams))
    for asked, limit in (("Amani Wholesale Traders Limited", 5), ("zq", 50), ("Baraka Foods 17", 1), ("nothing like it", 10), ("", 3), (people["t007"][2] or "cedar", 3)):
        got = [tuple(r) for r in name_index.candidates(catalog, asked, limit).collect()]
        assert got == [tuple(r) for r in match_candidates(every, asked, limit).collect()], asked
    # a name with few candidates reads few buckets of the postings
    buckets = catalog.lookup(name_index.POSTINGS, spark.createDataFrame([(g,) for g in ("  z", "zq ")], "trigram string"))
    assert len({f.split("_bucket=")[1].split("/")[0] for f in buckets.inputFiles()}) <= 2
