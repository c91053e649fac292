"""The heaviest rings against walking all paths."""

import random
from decimal import Decimal

import pytest

from assurelake.operators import graph

SCHEMA = "source_type string, source_id string, target_type string, target_id string, edge_type string, weight decimal(8,4)"


def brute(edges, longest, limit):
    follow = {}
    for s, t, w in edges:
        follow.setdefault(s, []).append((t, w))
    out = []

    def walk(start, at, used, total):
        for t, w in follow.get(at, []):
            step = f"{at}>{t}"
            if step in used:
                continue
            if t == start and used:
                out.append((start, len(used) + 1, total + w, " ".join([*used, step])))
            if len(used) + 1 < longest:
                walk(start, t, [*used, step], total + w)

    for s in follow:
        walk(s, s, [], Decimal(0))
    return sorted(out, key=lambda r: (-r[2], r[3]))[:limit]


@pytest.mark.parametrize("longest,limit,heavy,seed", [(4, 50, 2000, 1), (4, 50, 40, 2), (3, 7, 25, 3), (2, 5, 10, 4), (4, 5000, 60, 5)])
def test_rings(spark, monkeypatch, longest, limit, heavy, seed):
    monkeypatch.setattr(graph, "HEAVY", heavy)
    rng = random.Random(seed)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(110)} | {(0, i) for i in range(1, 20)} | {(i, 0) for i in range(10, 25)}  # 0 is a hub
    edges = [(f"v{a:02d}", f"v{b:02d}", Decimal(rng.choice([1, 1, 2, 3, 8, 20]))) for a, b in sorted(pairs) if a != b]
    rows = [("TAXPAYER", s, "TAXPAYER", t, "INVOICE_TRADE", w) for s, t, w in edges] + [("TAXPAYER", "v00", "TAXPAYER", "v01", "OTHER", Decimal(99)), ("TAXPAYER", "v01", "COUNTY", "v00", "INVOICE_TRADE", Decimal(99))]
    got = [tuple(r) for r in graph.invoice_rings(spark.createDataFrame(rows, SCHEMA), longest, limit).collect()]
    assert got == brute(edges, longest, limit)


def test_no_rings(spark):
    assert graph.invoice_rings(spark.createDataFrame([], SCHEMA)).count() == 0
    chain = [("TAXPAYER", f"a{i}", "TAXPAYER", f"a{i + 1}", "INVOICE_TRADE", Decimal(1)) for i in range(5)]
    assert graph.invoice_rings(spark.createDataFrame(chain, SCHEMA)).count() == 0


def test_more_edges_while_rings_are_too_few(spark, monkeypatch):
    """Heaviest edges without a ring still give a weight to reach: not all paths of two are made."""
    monkeypatch.setattr(graph, "HEAVY", 20)
    floors, rings = [], graph._rings
    monkeypatch.setattr(graph, "_rings", lambda edges, longest, floor=None: floors.append(floor) or rings(edges, longest, floor))
    edges = [("hub", f"a{i:02d}", Decimal(90)) for i in range(20)] + [(f"v{i:02d}", f"v{(i + d) % 30:02d}", Decimal(1 + (i * d) % 5)) for i in range(30) for d in (1, 29, 15)] + [("a00", "hub", Decimal(1))]
    edges += [(f"a{i:02d}", "v00", Decimal(1)) for i in range(20)]
    rows = [("TAXPAYER", s, "TAXPAYER", t, "INVOICE_TRADE", w) for s, t, w in edges]
    got = [tuple(r) for r in graph.invoice_rings(spark.createDataFrame(rows, SCHEMA), 3, 20).collect()]
    assert got == brute(edges, 3, 20) and floors[-1] is not None and len(floors) > 2


def test_light_edges_make_no_paths(spark, monkeypatch):
    """Edges of equal weight around a hub can be on a ring heavy enough, but not two of them: their paths are not made."""
    made, written = [], graph.written
    monkeypatch.setattr(graph, "HEAVY", 60)
    monkeypatch.setattr(graph, "written", lambda df, name, *a: made.append((name, (out := written(df, name, *a)).count())) or out)
    edges = [(f"{k}{i:02d}", "hub", Decimal(1)) for k in "ab" for i in range(40)] + [("hub", f"{k}{i:02d}", Decimal(1)) for k in "ab" for i in range(40)]
    edges += [(f"a{i:02d}", f"a{(i + d) % 40:02d}", Decimal(w)) for i in range(40) for d, w in ((1, 4), (2, 3), (37, 2))]
    rows = [("TAXPAYER", s, "TAXPAYER", t, "INVOICE_TRADE", w) for s, t, w in edges]
    got = [tuple(r) for r in graph.invoice_rings(spark.createDataFrame(rows, SCHEMA), 3, 30).collect()]
    assert got == brute(edges, 3, 30)
    assert [n for name, n in made if name == "ring-paths"][-1] < 400  # 6400 lead through the hub


@pytest.mark.parametrize("seed", range(3))
def test_rings_of_three_with_equal_weights_and_loops(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "HEAVY", 30)
    rng = random.Random(seed)
    edges = [(f"v{a:02d}", f"v{b:02d}", Decimal(rng.choice([1, 1, 1, 2, 2, 5]))) for a, b in sorted({(rng.randrange(15), rng.randrange(15)) for _ in range(110)})]
    rows = [("TAXPAYER", s, "TAXPAYER", t, "INVOICE_TRADE", w) for s, t, w in edges]
    for limit in (12, 60):
        assert [tuple(r) for r in graph.invoice_rings(spark.createDataFrame(rows, SCHEMA), 3, limit).collect()] == brute(edges, 3, limit)
