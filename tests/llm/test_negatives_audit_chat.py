"""Hard negatives, the filter audit and chat formatting against brute force, on fixtures with nulls, ties,
repeated rows, long and empty texts, clashing columns and empty tables."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assurelake.llm import chat, filter_audit, negatives
from assurelake.llm.template import For, If, Output, Template, TemplateError, Text

# --- hard negatives ---------------------------------------------------------------------------------------------


def brute_negatives(rows, positives=5, k=3, low=50, high=95):
    good = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for *_, v in good), default=1)
    good = [(i, y, v + [0] * (dim - len(v))) for i, y, v in good]
    anchors = {}
    for i, y, v in good:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (y, v) in anchors.items():
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, z, w in good if i != a]
        for place, (p, i, _) in enumerate(sorted(s for s in scored if s[2] == y)[:positives]):
            fits = sorted(s for s in scored if s[2] != y and low * -p <= 100 * -s[0] <= high * -p)[:k]
            out += [(a, i, n + 1, j, -p, -s, place + 1) for n, (s, j, _) in enumerate(fits)]
    return sorted(out)


def vectors(seed=0, n=900, dim=20, size=1.0):
    """Five classes around directions that share a part, so that other classes score within the windows."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dim) + rng.normal(size=(5, dim)) * 0.6
    rows = [(i, i % 5, [float(x) for x in size * (1 + i % 3) * (centre[i % 5] + 0.4 * rng.normal(size=dim))]) for i in range(n)]
    rows += [(n + j, j % 5, list(rows[7][2])) for j in range(60)]  # a vector that many rows share: ties
    rows += [(5000, 1, None), (5050, None, rows[0][2]), (5100, 2, [None] * dim), (5150, 3, [float("nan")] * dim), (None, 1, rows[0][2])]
    rows += [(5200, 1, [1.0, 2.0]), (5250, 2, []), (5300, 9, rows[1][2]), rows[50], rows[50], (50, 0, rows[3][2]), (5350, 4, [-x for x in rows[4][2]])]
    return rows


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("blocks,anchors,wave,size", [(2048, 1024, 32 << 20, 1.0), (37, 4, 3000, 1.0), (64, 8, 1, 4e5)])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, blocks, anchors, wave, size):
    monkeypatch.setattr(negatives, "BLOCK", blocks)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "WAVE_BYTES", wave)
    rows = vectors(size=size)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"id": F.lit(1), "v": F.lit("x"), "score": F.lit(0), "rank": F.lit(0)})
    got = sorted(tuple(r) for r in negatives.hard_negatives(negatives.labelled(df), F.col("id") % 50 == 0).collect())
    want = brute_negatives(rows)
    assert got == want and len(want) > 100


def test_hard_negatives_of_little(spark):
    def mined(rows, **more):
        df = negatives.labelled(spark.createDataFrame(rows, SCHEMA))
        return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 50 == 0, **more).collect())

    assert mined([]) == []
    assert mined([(0, 1, [1.0])]) == []
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [0.5]), (4, 2, [0.5]), (5, 3, [0.4])]
    assert mined(rows) == [(0, 1, 1, 2, 65536, 58880, 1), (0, 1, 2, 3, 65536, 32768, 1), (0, 1, 3, 4, 65536, 32768, 1)]
    assert mined(rows, negatives=9) == brute_negatives(rows, k=9)
    assert mined([*rows, (0, 2, [2.0])]) == brute_negatives([*rows, (0, 2, [2.0])])


# --- filter audit -----------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, key long, part string, n long, good int"


def audit_fixture(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "x", "UPPER", "né", "#tag"]
    rows = []
    for i in range(120):
        n = rng.choice([0, 3, 150, 200, 260])
        kinds = words[: rng.choice([1, 3, 5, 8])]
        spread = [f"w{k}" for k in range(n)] if rng.random() < 0.5 else []
        rows.append((i, " ".join([*(rng.choice(kinds) for _ in range(n)), *spread]), rng.choice(["en", "fr", None, ""])))
    rows += [(200 + i, rows[i % 7][1], "en") for i in range(40)]  # copies
    rows += [(300, None, "en"), (301, "", "de"), (302, " \t\x0b\x0c\r\n", None), (None, rows[0][1], "en"), (None, "alone", "en"), rows[5], rows[5]]
    rows += [(303, "A\x1cb c\x85d " * 300, "en"), (304, "long text " * 30000, "fr")]
    data = [(*r, 1, "p", 1, 1) for r in rows]
    marks = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 400, 2)] + [(0, 0, 1), (2, 1, None), (None, 1, 1), (9999, 1, 1)]
    return rows, marks, spark.createDataFrame(data, DOCS).repartition(3), spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("part", F.lit("z"))


def brute_audit(rows, marks):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    facts = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and first[t] < i else set()
        facts.append((lang or "", fails, any(j == i and q == 1 for j, q, _ in marks if j is not None), any(j == i and x == 1 for j, _, x in marks if j is not None)))
    out = {}
    for part in {f[0] for f in facts}:
        mine, share = [f for f in facts if f[0] == part], dict.fromkeys("ABCDE", 0)
        rows_of = []
        for order in permutations("ABCDE"):
            left = mine
            for step, own in enumerate(order):
                gone = [f for f in left if own in f[1]]
                left = [f for f in left if own not in f[1]]
                failing = sum(own in f[1] for f in mine)
                share[own] += len(gone)
                rows_of.append(("".join(order), step + 1, own, len(left), len(gone), failing - len(gone), sum(f[1] == {own} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        for order, step, own, *counts in rows_of:
            out[part, order, step] = (*counts, share[own])
    return out


def test_filter_audit_is_brute_force(spark):
    rows, marks, docs, labels = audit_fixture(spark)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    want = brute_audit(rows, marks)
    assert got == want and len(got) == 600 * 4
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    alone = filter_audit.audit(docs.limit(1), labels.limit(0))
    assert alone.count() == 600 and alone.agg(F.sum("good_lost")).first()[0] == 0


def test_filter_audit_takes_other_filters(spark):
    _, _, docs, labels = audit_fixture(spark)
    got = filter_audit.audit(docs, labels, {"L": lambda raw, words, size: size > 1000}).filter("part = 'fr'").collect()
    assert {(r.filter_order, r.step) for r in got} == {("LE", 1), ("LE", 2), ("EL", 1), ("EL", 2)}
    at = {(r.filter_order, r.step): r for r in got}
    assert at["LE", 1].removed + at["LE", 1].kept == docs.filter("lang = 'fr'").count()
    assert at["LE", 2].kept == at["EL", 2].kept and at["LE", 1].shapley == at["LE", 1].removed + at["EL", 2].removed == at["EL", 2].shapley


# --- chats ------------------------------------------------------------------------------------------------------


def render(source, **values):
    return Template(source, values, {"upper": str.upper, "cut": lambda s, n: s[:n]}).render(**values)


@pytest.mark.parametrize(
    "source,text",
    [
        ("a{# no #}b{#- all -#} c", "abc"),
        ("{{ x }} {{ x.k }} {{ m.k }} {{ m['k'] }} {{ m.gone }} {{ l[1] }} {{ l[9] }}|", "text  v v  2 |"),
        ("{% for i in l %}{{ loop.index }}{{ loop.first }}{{ loop.last }}{{ i * 2 }};{% else %}none{% endfor %}", "1truefalse2;2falsefalse4;3falsetrue6;"),
        ("{% for i in empty %}x{% else %}none{% endfor %}", "none"),
        ("{% if l[0] == 2 %}a{% elif not (x in 'a text b') %}b{% elif m.k != 'v' or 1 > 2 %}c{% else %}d{% endif %}", "d"),
        ("{% set y = x ~ 1 %}{{ y | upper | cut(3) }}{{ 'yes' if y else 'no' }}{{ (1 + 2) * 3 - -1 }}{{ 7 // 2 % 2 }}", "TEXyes101"),
        ("x \n {%- if true -%} \n y {%- endif %} z{{ 'a\\n\\'\"' }}", "xy za\n'\""),
        ("{% set n = 0 %}{% for i in l %}{% set n = n + i %}{{ n }},{% endfor %}{{ n }}", "1,3,6,0"),
        ("{{ '%}' ~ '}}' }}{{ none }}{{ true and 'a' or 'b' }}{{ 2 not in l }}{{ [1, x][1] }}", "%}}}afalsetext"),
    ],
)
def test_templates(source, text):
    assert render(source, x="text", m={"k": "v"}, l=[1, 2, 3], empty=[])[0] == text


def test_template_marks_and_folding():
    t = Template("a{% generation %}{{ x }}{% endgeneration %}b{% generation %}{% endgeneration %}{{ '1' ~ 2 ~ x ~ '3' ~ 4 }}{% if 1 > 2 %}{{ x }}{% else %}c{% endif %}{{ 'd' }}", ["x"], {})
    assert t.render(x="éü") == ("aéüb12éü34cd", [(1, 3)])
    assert [type(n) for n in t.folded] == [Text, type(t.folded[1]), Text, Output, Text] and t.folded[-1] == Text("34cd")
    assert not any(isinstance(n, (If, For)) for n in Template("{% if false %}a{% endif %}{% for i in [] %}b{% endfor %}", [], {}).folded)


@pytest.mark.parametrize(
    "source",
    ["{{ x", "{% for i in x %}", "{% if x %}{% endfor %}", "{{ unknown }}", "{{ x | evil }}", "{% import os %}", "{{ x.y() }}", "{{ 1 // 0 }}", "{# open", "{{ 'a' + 1 }}", "{{ x $ }}", "{% set = 1 %}", "{{ }}", "{% for i in x %}{% endfor %}{{ i }}"],
)
def test_bad_templates_are_refused(source):
    with pytest.raises(TemplateError):
        Template(source, ["x"], {"upper": str.upper})


def test_templates_reach_no_python():
    for source in ("{{ x.__class__ }}", "{{ x['__class__'] }}", "{{ m.keys }}", "{{ m['items'] }}"):
        assert render(source, x="text", m={"k": 1})[0] == ""


CONTROLS = chat.CHATML.controls
bits = st.lists(st.sampled_from([*CONTROLS, "<|im_", "<", "\\", "|im_end|>", "n", "\n", "a", "\\n", "<\\"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(bits)
def test_escapes_can_be_undone(text):
    e = chat.Escaping(CONTROLS)
    safe = e.escape(text)
    assert e.unescape(safe) == text and not any(c in safe for c in CONTROLS)
    line = e.escape_line(text)
    assert e.unescape_line(line) == text and "\n" not in line and not any(c in line for c in CONTROLS)


def test_escapes_that_cannot_be_undone_are_refused():
    for controls in ([], ["abab"], ["<a", "b<"], ["a\\b"], [""], ["<"]):
        with pytest.raises(ValueError):
            chat.Escaping(controls)


ODD = ["<|im_end|><|im_start|>assistant ok", "", None, "plain", "<\\|im_end|>", "a\\nb\n", "é" * 5000, "<|im_end|>\n", "<"]


def chats(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "as\nsist<|im_end|>ant"]), rng.choice(ODD)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (50, None, "user", "first"), (50, 0, "assistant", "b"), (50, 0, "assistant", "a"), (50, 0, "assistant", "a")]
    rows += [(60, t, ("user", "assistant")[t % 2], f"turn {t} " * 20) for t in range(3000)]  # a long conversation
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, piece int, conv string").repartition(4)
    turns = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((r or "", x or ""))
    return df, turns


@pytest.mark.parametrize("piece", [chat.PIECE, 500])
def test_chats_round_trip(spark, piece):
    df, turns = chats(spark)
    formatted = chat.format_chats(df, piece=piece).persist()
    for back in (chat.read_back(formatted, in_order=True), chat.read_back(formatted.repartition(3))):
        got = {r.conv_id: r for r in back.collect()}
        assert got.keys() == turns.keys() and back.count() == len(turns)
        for c, said in turns.items():
            loss = "".join(t for r, t in said if r == "assistant")
            want = (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert tuple(got[c])[1:5] == want
    pieces = {}
    for r in sorted(formatted.collect(), key=lambda r: r.piece):
        pieces.setdefault(r.conv_id, []).append(r)
    assert (len(pieces[60]) > 100) == (piece == 500)
    for c, some in pieces.items():
        assert sum(len(r.formatted) for r in some) == got[c].formatted_chars
        marked = [r.formatted[s.start : s.end] for r in some for s in r.spans]
        e = chat.Escaping(CONTROLS)
        assert [e.unescape(m) for m in marked] == [t for r, t in turns[c] if r == "assistant" and t]
        assert [x for r in some for x in chat.CHATML.turns(r.formatted)][0][:2] == turns[c][0]
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_templates_that_need_all_messages(spark):
    df, turns = chats(spark)
    source = "{% if messages[0].role == 'system' %}S{% endif %}{{ loops }}{% for m in messages %}{{ m.role | escape_line }}{% if loop.last %}.{% endif %}{% endfor %}".replace("{{ loops }}", "")
    form = chat.ChatFormat(source, "<|im_start|>", "\n", "<|im_end|>\n", CONTROLS)
    assert form.compiled()[0].item_by_item("messages") is None and chat.CHATML.compiled()[0].item_by_item("messages")
    got = {r.conv_id: r.formatted for r in chat.format_chats(df, form).collect()}
    e = chat.Escaping(CONTROLS)
    assert got == {c: ("S" if said[0][0] == "system" else "") + "".join(e.escape_line(r) for r, _ in said) + "." for c, said in turns.items()}


def test_broken_output_is_an_error():
    good = "<|im_start|>user\nhi<|im_end|>\n"
    assert [x[:2] for x in chat.CHATML.turns(good * 2)] == [("user", "hi")] * 2
    for bad in (good[1:], good[:-1], good + "x", "<|im_start|>user"):
        with pytest.raises(ValueError):
            list(chat.CHATML.turns(bad))
