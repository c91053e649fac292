from assurelake.operators import cases, graph
from assurelake.plans import queries
from assurelake.plans.domain import Domain


def test_rings_of_all_suppliers(spark):
    """The query's edges leave every supplier, and their rings are those of brute force."""
    d = Domain(spark, "/root/testdata/sf0.01")
    edges = [(r.source_id, r.target_id, r.weight) for r in queries.test_ring(d).collect()]
    assert len({e[0] for e in edges}) == d["supplier"].count() > 30
    rings, paths = [], [(e,) for e in edges]
    for n in (2, 3, 4):
        paths = [(*p, e) for p in paths for e in edges if e[0] == p[-1][1] and e not in p]
        rings += [(sum(e[2] for e in p), " ".join(f"{e[0]}>{e[1]}" for e in p), p[0][0], n) for p in paths if p[-1][1] == p[0][0]]
    want = sorted(rings, key=lambda r: (-r[0], r[1]))
    got = [(r.cycle_weight, r.path, r.taxpayer_id, r.cycle_length) for r in graph.invoice_rings(queries.test_ring(d), limit=len(want) + 1).collect()]
    assert got == want and any(int(r[2][1:]) >= 30 for r in got)


def test_edges_of_a_large_group_that_come_first(spark):
    """Of shared numbers only the first of either end are made, with the results of all."""
    rows = [(f"T{i:03d}", f"Name {i}", ["", "R", "Q", None][i % 4] if i > 9 else f"own {i // 2}") for i in range(120)]
    who = spark.createDataFrame(rows, "id string, legal_name string, registration_number string")
    every = graph.shared_registration(who)
    few = graph.strongest_shared(who, 5)
    assert few.count() < 120 * 5 < every.count()
    for f in (lambda e: cases.linked_entities(e, 5), lambda e: cases.linked_records(e, 5)):
        assert sorted(map(str, f(few).collect())) == sorted(map(str, f(every).collect()))
    ends = lambda e: {r[0] for r in e.select("source_id").union(e.select("target_id")).collect()}
    assert ends(graph.strongest_shared(who, 1)) == ends(every)
    scores = who.selectExpr("id AS taxpayer_id", "CAST(CASE WHEN id = 'T050' THEN 90 ELSE 0 END AS DECIMAL(5,2)) AS score")
    count = lambda e, **more: {tuple(r) for r in graph.run_counters(e, scores, who, limit=9, **more).collect()}
    assert count(graph.strongest_shared(who, 9), counts=graph.edge_counts(every)) == count(every)
