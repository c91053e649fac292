"""Buckets, transactions and the change feed of the catalog; views refreshed by change."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assurelake.operators import views
from assurelake.sources import catalog as module
from assurelake.sources.catalog import Catalog, Conflict

ROWS = "k long, v string, id string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def cat(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/cat")


def test_a_merge_writes_only_its_buckets(spark, cat):
    every = spark.range(5000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit("i").alias("id"))
    cat.write("t", every, ["k"], 256)
    before = cat.table("t")
    assert len(before.parts) == 256
    some = spark.createDataFrame([(7, "new", "j"), (8, "new", "j"), (9000, "new", "j")], ROWS)
    cat.merge("t", some, ["k"])
    after = cat.table("t")
    fresh, gone = set(after.parts) - set(before.parts), set(before.parts) - set(after.parts)
    assert 1 <= len(fresh) == len(gone) <= 3 and cat.rows("t", after, sorted(fresh)).count() < 5000 * 3 / 256 * 3
    found = {r.k: (r.v, r.id) for r in cat.read("t").collect()}
    assert len(found) == 5001 and found[7] == ("new", "i") and found[9000] == ("new", "j") and found[10] == ("old", "i")
    assert rows_of(cat.lookup("t", spark.createDataFrame([(7,), (10,), (12345,)], "k int"))) == [(7, "new", "i"), (10, "old", "i")]


def test_merges_like_a_dictionary(spark, cat):
    rng, have = random.Random(0), {}
    cat.write("t", spark.createDataFrame([], ROWS), ["k"], 8)
    for n in range(6):
        new = {rng.randrange(40): f"v{n}" for _ in range(rng.choice([0, 1, 20]))}
        cat.merge("t", spark.createDataFrame([(k, v, f"id{n}") for k, v in new.items()], ROWS), ["k"])
        have |= {k: (v, have.get(k, (None, f"id{n}"))[1]) for k, v in new.items()}
        assert rows_of(cat.read("t")) == sorted((k, *x) for k, x in have.items())
    cat.merge("t", spark.createDataFrame([(1, "by v", "z")], ROWS), ["v"])  # another key: the whole table
    assert ("by v" in {r.v for r in cat.read("t").collect()}) and cat.table("t").buckets == 8


def test_a_transaction_is_whole_or_nothing(spark, cat, tmp_path):
    one = spark.createDataFrame([(1, "a", "x")], ROWS)
    cat.write("a", one)
    cat.write("b", one, ["k"], 4)
    files = lambda: {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.parquet")}
    before, commits = files(), cat.commits()
    with pytest.raises(ZeroDivisionError), cat.transaction() as t:
        t.append("a", one)
        t.merge("b", one.withColumn("v", F.lit("changed")), ["k"])
        assert t.read("a").count() == 2 and t.read("b").first().v == "changed"  # its own changes
        assert cat.read("a").count() == 1 and cat.read("b").first().v == "a"  # others don't see them
        raise ZeroDivisionError
    assert (files(), cat.commits()) == (before, commits) and cat.read("a").count() == 1
    with cat.transaction() as t:
        t.append("a", one)
        t.write("c", one)
    assert cat.commits() == [*commits, commits[-1] + 1] and cat.read("a").count() == 2 and cat.read("c").count() == 1


def test_two_writers(spark, cat):
    one = spark.createDataFrame([(1, "a", "x")], ROWS)
    cat.write("a", one)
    cat.write("b", one)
    first, second, third, reader = (cat.transaction() for _ in range(4))
    first.append("a", one)
    second.merge("a", one.withColumn("v", F.lit("lost")), ["k"])
    third.append("b", one)
    reader.append("c", reader.read("a"))
    first.commit()
    third.commit()  # another table: no conflict
    for late in (second, reader):
        with pytest.raises(Conflict):
            late.commit()
    assert cat.read("a").count() == 2 and cat.read("b").count() == 2 and not cat.exists("c")
    assert "lost" not in {r.v for r in cat.read("a").collect()}


def test_old_commits_go(spark, cat, tmp_path):
    one = spark.createDataFrame([(1, "a", "x")], ROWS)
    cat.write("still", one)
    for n in range(module.KEPT + 3):
        cat.write("t", one.withColumn("v", F.lit(str(n))))
    assert len(cat.commits()) == module.KEPT and cat.read("still").count() == 1
    parts = [p for p in (tmp_path / "cat/t/parts").iterdir() if not p.name.startswith(".")]
    assert len(parts) == module.KEPT
    assert cat.read("t", cat.commits()[0]).first().v == str(3)


def test_changes_read_what_differs(spark, cat):
    some = lambda *ks: spark.createDataFrame([(k, "a", "x") for k in ks], ROWS)
    cat.write("t", some(*range(100)), ["k"], 16)
    at = cat.commits()[-1]
    cat.append("t", some(200, 201))
    feed = cat.changes("t", at)
    assert rows_of(feed.select("k", "_change")) == [(200, 1), (201, 1)]
    assert {f.rpartition("parts/")[2].split("/")[0] for f in feed.inputFiles()} == {p.split("/")[0] for p in set(cat.table("t").parts) - set(cat.table("t", at).parts)}
    cat.merge("t", some(5).withColumn("v", F.lit("b")), ["k"])
    net = cat.changes("t", at).groupBy("k", "v").agg(F.sum("_change").alias("n")).filter("n <> 0")
    assert rows_of(net) == [(5, "a", -1), (5, "b", 1), (200, "a", 1), (201, "a", 1)]


def test_views_refresh_by_change(spark, cat, monkeypatch):
    schema = "deterministic_key string, taxpayer_id string, tax_head string, estimated_gap decimal(18,2), recoverable_tax decimal(18,2), total_recoverable decimal(18,2), confidence_score decimal(5,2)"
    taxpayers = spark.createDataFrame([(f"t{i}", ["S1", "S2", None][i % 3], f"c{i % 2}") for i in range(20)], "id string, sector_name string, county string")
    rng = random.Random(1)
    have = {}

    def estimates(keys):
        out = {k: (k, f"t{rng.randrange(20)}", rng.choice(["VAT", "PAYE"]), *(Decimal(rng.randrange(10000)) / 100 for _ in range(3)), rng.choice([None, Decimal(90)])) for k in keys}
        have.update(out)
        return spark.createDataFrame(list(out.values()), schema)

    def full(column):
        groups = {}
        where = {r.id: r[column] for r in taxpayers.collect()}
        for _, t, head, *money, confidence in have.values():
            g = groups.setdefault((where[t] or "Unspecified", head), [0, set(), [Decimal(0)] * 3, []])
            g[0], g[2] = g[0] + 1, [a + b for a, b in zip(g[2], money, strict=True)]
            g[1].add(t)
            g[3] += [confidence] if confidence is not None else []
        return sorted((*k, n, len(t), *m, sum(c) / len(c) if c else None) for k, (n, t, m, c) in groups.items())

    def check():
        assert rows_of(views.by_sector(cat, taxpayers)) == full("sector_name") and rows_of(views.by_region(cat, taxpayers)) == full("county")

    cat.write(views.SOURCE, estimates([f"k{i}" for i in range(60)]), ["deterministic_key"], 8)
    views.refresh(cat, 4)
    check()
    reads = []
    changes = Catalog.changes
    monkeypatch.setattr(Catalog, "changes", lambda self, *a: reads.append(changes(self, *a)) or reads[-1])
    cat.append(views.SOURCE, estimates([f"n{i}" for i in range(5)]))
    views.refresh(cat)
    check()
    assert reads[-1].count() == 5  # of 65 rows
    for keys in ([f"k{i}" for i in range(0, 60, 7)], [], ["k1", "new"]):
        cat.merge(views.SOURCE, estimates(keys), ["deterministic_key"])
        views.refresh(cat)
        check()
    have.clear()
    cat.write(views.SOURCE, estimates(["only"]))
    views.refresh(cat)
    check()
    for n in range(module.KEPT + 1):
        cat.append(views.SOURCE, estimates([f"late{n}"]))
    views.refresh(cat)  # the version that the state had come to is gone
    check()


def test_a_scope_leaves_nothing(spark, sf):
    """Queries leave no table in the shared folder once their scope ends; an inner scope keeps to its own."""
    import os

    import __spark_entry__

    folder = module.work_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    queries = __spark_entry__.queries()
    for name in ("recon_run_results", "graph_trade_rings", "ingest_quoted_jobs", "op12_filter_audit", "op9_top_k"):
        if name in queries:
            with module.scope(spark):
                assert queries[name](spark, sf).count() > 0
            assert set(os.listdir(folder)) == before, name
    with module.scope(spark):
        outer = module.written(spark.range(3), "outer")
        with module.scope(spark):
            module.written(spark.range(3), "inner")
        assert outer.count() == 3
    assert set(os.listdir(folder)) == before
