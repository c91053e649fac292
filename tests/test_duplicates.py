"""Components against union-find, classes of duplicates against all pairs."""

import random
import re

import pytest

from assurelake.operators import components, duplicates, resolution


def united(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("case", ["random", "path", "star", "backward path", "none"])
def test_components(spark, case):
    rng = random.Random(4)
    n = 300
    edges = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)],
        "path": [(i, i + 1) for i in range(120)],
        "star": [(500, i) for i in range(400)] + [(7, 7), (1000, 1001)],
        "backward path": [((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)],
        "none": [],
    }[case]
    df = spark.createDataFrame([(f"n{a:04d}", f"n{b:04d}") for a, b in edges] + [(None, "x")], "a string, b string")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == united([(f"n{a:04d}", f"n{b:04d}") for a, b in edges])


def grams(name):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[a-z0-9]+", (name or "").lower()) for i in range(len(w) + 1)}


def test_classes_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    names = ["Amani Wholesale Traders Limited", "Amani Wholesale Traders Limitd", "amani  wholesale TRADERS limited", "Baraka Foods International Kenya", "Baraka Foods Internationals Kenya", "Cedar", "Cedars", "", "!!", None]
    rows = [(f"t{i:03d}", rng.choice(["R1", "r1", "R2", "", None, *(f"R{j}" for j in range(10, 40))]), rng.choice([*names, *(f"Unlike {j} {chr(97 + j) * 6}" for j in range(20))]), rng.choice([None, None, "Hot Name", *names])) for i in range(160)]
    df = spark.createDataFrame(rows, "id string, registration_number string, legal_name string, trading_name string")
    classes, links = duplicates.classified(df)
    sim = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    linked = {}
    for a, ra, la, ta in rows:
        for b, rb, lb, tb in rows:
            if a != b:
                kinds = (bool(ra) and ra.lower() == (rb or "").lower(), bool(grams(la)) and sim(grams(la), grams(lb)) >= 0.9, bool(grams(ta)) and sim(grams(ta), grams(tb)) >= 0.9)
                if any(kinds):
                    linked[a, b] = kinds
    roots = united(linked)
    want = {a: (roots[a], *(sum(k[n] for (x, _), k in linked.items() if x == a) for n in range(3))) for a in roots}
    got = {r.taxpayer_id: tuple(r)[1:] for r in classes.collect()}
    assert got == want and classes.count() == len(want)
    by_kind = {}
    for r in links.collect():
        by_kind[r.kind] = by_kind.get(r.kind, 0) + r.pairs
    assert [by_kind[k] for k in (duplicates.NUMBER, duplicates.LEGAL, duplicates.TRADING)] == [sum(k[n] for k in linked.values()) // 2 for n in range(3)]
    one = min(set(roots.values()), key=lambda c: (list(roots.values()).count(c), c))
    pairs = {(r.source_id, r.target_id) for r in duplicates.pairs_of(df, classes, one).collect()}
    assert pairs == {(a, b) for a, b in linked if a < b and roots[a] == one}
    assert duplicates.classified(df.limit(0))[0].count() == 0


def test_pairs_and_their_number_against_all_pairs(spark):
    """Kinds that overlap: each pair once, a number before a name, the larger similarity of two."""
    rng = random.Random(7)
    names = ["Amani Wholesale Traders Limited", "Amani Wholesale Traders Limitd", "Baraka Foods International Kenya", "Baraka Foods Internationals Kenya", "A", "a", "Ab", "x y", "", None]
    rows = [(f"t{i:03d}", rng.choice(["R1", "r1", "R2", "", None, None]), rng.choice([*names, f"Unlike {i} {i % 9}"]), rng.choice([None, *names])) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, registration_number string, legal_name string, trading_name string")
    sim = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    want = {}
    for a, ra, la, ta in rows:
        for b, rb, lb, tb in rows:
            near = max(sim(grams(la), grams(lb)), sim(grams(ta), grams(tb)))
            if a < b and ((same := bool(ra) and ra.lower() == (rb or "").lower()) or near >= 0.9):
                want[a, b] = (1.0 if same else round(near, 9), "REGISTRATION_NUMBER" if same else "FUZZY_NAME")
    made = resolution.Duplicates(df)
    got = made.pairs().collect()
    assert {(r.source_id, r.target_id): (round(r.confidence, 9), r.basis) for r in got} == want and len(got) == len(want)
    assert made.count().first().n == len(want)


def test_equal_names_are_counted_without_pairs(spark):
    n = 60_000
    df = spark.range(n).selectExpr("concat('T', id) AS id", "'R' AS registration_number", "'Amani Wholesale Traders' AS legal_name", "'Hot Name' AS trading_name")
    assert resolution.Duplicates(df).count().first().n == n * (n - 1) // 2
