"""The keys that the Jaccard join moves, where lists are long."""

import random

import pytest
from pyspark.sql import functions as F

from assurelake.llm import jaccard


def brute(texts, percent=75):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in range(len(texts))}


def test_long_lists_make_no_more_keys(spark, monkeypatch):
    """Each passage is in many texts: pairs seem cheaper than lists up to large sets, but they'd be many times the keys."""
    rng = random.Random(7)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(60)]
    texts = [" ".join(rng.sample(passages, 5)) for _ in range(200)]
    texts += [f"{t} one more" for t in texts[:30]]
    made = []
    keyed = jaccard.keyed
    monkeypatch.setattr(jaccard, "keyed", lambda *a: made.append((keyed(*a).count(), a[2])) or keyed(*a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute(texts)
    lists = sum(jaccard.prefix(len(t.split()) - 4, 75, 1) for t in texts)
    assert made[0][0] <= lists * (1 + 1 / jaccard.ONE_MORE)


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_affordable_boundary_is_the_largest(spark, percent):
    rng = random.Random(percent)
    sizes = [rng.randrange(1, 40) for _ in range(300)] + [rng.randrange(40, 4000) for _ in range(30)]

    def keys(light):
        out = 0
        for n in sizes:
            if n >= 2:
                p1, p2 = jaccard.prefix(n, percent, 1), jaccard.prefix(n, percent, 2)
                out += p2 * (p2 - 1) // 2 * (n <= light) + p1 * (n > light or 100 * n >= percent * (light + 1))
        return out

    frame = spark.createDataFrame([(n,) for n in sizes], "n long")
    want = max((m for m in range(2, 301) if keys(m) <= keys(0) * (1 + 1 / jaccard.ONE_MORE)), default=0)
    assert jaccard.affordable(frame, 300, percent) == want
    assert jaccard.affordable(frame.filter(F.lit(False)), 300, percent) in (0, 300)
