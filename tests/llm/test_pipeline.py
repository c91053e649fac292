"""The pipeline against the stages' own functions applied by hand to a small folder."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from assurelake.llm import mixing, pii
from tests.llm.test_corpus import brute_components, texts


def test_pipeline(spark, tmp_path):
    base = texts(7, 30, 60)
    rows = [(i, t, ["en", "fr"][i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate([*base, base[0], base[1] + " extra", None, "12 34", "mail me at a.b@c.de " + base[2][:100]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}

    known = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = brute_components(known)
    kept = [r for r in rows if r[0] in groups and groups[r[0]][1] == r[0]]
    clean = spark.createDataFrame([(i, pii.redact(t), lang, s, 1) for i, t, lang, s, _ in kept], docs.schema)
    drawn = {r.doc_id for r in mixing.mix(clean, mixing.TARGETS, mixing.CAPS).filter("kept").collect()}
    want = {r.doc_id: r.text for r in clean.collect() if r.doc_id in drawn}
    assert set(got) == set(want) and want

    from tokenizers import Tokenizer

    from assurelake.llm.bpe import word_vocabulary

    lib = Tokenizer.from_file(word_vocabulary())
    for i, t in want.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "text of words here", "en", "s", 3), (2, "", "fr", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (docs, docs.limit(0)):
        for _, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, stage, "unused")
            assert out.columns == docs.columns and out.filter(F.lit(False)).count() == 0
            out.count()


def test_stages_keep_columns_whose_names_the_operators_use(spark):
    names = ["weight", "kept", "probability", "_topic", "_lang", "_score", "_source", "_tokens", "row", "go", "none", "key", "sid", "draw", "lang_pred", "score", "c0_", "draw_", "component_id"]
    rows = [(i, t, None if i % 3 else "en", "s", 1, *range(i, i + len(names))) for i, t in enumerate(texts(21, 12, 40))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for _, f in corpus_pipeline.STAGES[:-1]:
        got = f(spark, docs, "unused")
        assert got.columns == docs.columns
        kept = {r.doc_id: tuple(r)[5:] for r in got.collect()}
        assert kept and all(v == rows[i][5:] for i, v in kept.items())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "unused").count() == len(rows)


def test_language_fills_in_what_it_identified(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts(31, 40, 30))] + [(100 + i, t, None, "s", 1) for i, t in enumerate(texts(32, 5, 30))] + [(200, "½ ² 12", None, "s", 1), (201, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, "unused").collect()}
    assert set(got) == {*range(40), *range(100, 105)} and set(got.values()) == {"en"}


def test_near_copies_keeps_one_of_repeated_rows(spark):
    """Rows that repeat an id, share it only, or have none."""
    a, b, c = texts(11, 3, 60)
    rows = [(1, a), (1, a), (2, a), (3, b), (3, c), (None, c), (None, c + " tail"), (4, ""), (5, ""), (None, ""), (None, ""), (None, None)]
    d = texts(12, 1, 60)[0]
    rows += [(None, d), (None, d), (None, d + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "unused").collect()]
    alone = [x for x in got if not (x[0] is None and x[1] in (d, d + " tail"))]
    want = [(1, a), (3, b), (3, c), (4, ""), (5, ""), (None, ""), (None, ""), (None, None)]
    assert sorted(map(repr, alone)) == sorted(map(repr, want)) and len(got) == len(want) + 1
