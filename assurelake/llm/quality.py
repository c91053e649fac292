"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a rejection test on columns. On a sample of the rows each rule's selectivity (share of
rows rejected) and cost are estimated; the rules are then ordered by rejection per cost, and the
verdict is one CASE expression in that order, of which Spark evaluates no branch after the first
that holds. The order decides what is computed, never the verdict: a document is kept if no rule
rejects it. The sample is bounded by a parameter and used for the order alone.

The cost of a rule is the time of one aggregate over its test on the sample, less that of the same
job without it.

Defined results: null and empty texts have no words, all counts 0, and fail the base rule. Repeated
rows are judged alike. Any length of text is judged whole. An empty table gives no rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.llm.common import cut, table

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A rejection test on the columns of counts()."""

    name: str
    rejects: Column
    #: The cost that is taken for it at least: the order of rules too quick to be timed.
    base_cost: float


def word_array(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def counts(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, _text and the base counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows are found by sorting: each 3-word window is a 64-bit number, 40 bits of its hash
    over 24 bits of its place, so equal windows become neighbours in one sort of longs. Neighbours
    whose hash bits agree are compared word by word; should two of them differ (or a text have more
    words than places), that text takes the exact way, a sort of the windows themselves.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(key_col), text.alias("_text"))
    rows = rows.select("*", word_array(F.col("_text")).alias("_w"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    # 40 bits of hash, 24 of place (from 1, as elements are counted)
    windows = F.expr(
        "sort_array(transform(sequence(1, size(_w) - 2), i -> "
        "(xxhash64(_w[i - 1], _w[i], _w[i + 1]) & -16777216L) | i))"
    )
    rows = rows.select("*", F.when(F.size("_w") < 4, F.array().cast("array<bigint>")).otherwise(windows).alias("_h"))
    # places k such that windows k and k + 1 of the sorted ones have the same hash bits
    same = F.expr(
        "CASE WHEN size(_h) < 2 THEN CAST(array() AS array<int>) ELSE "
        "filter(sequence(0, size(_h) - 2), k -> (_h[k] & -16777216L) = (_h[k + 1] & -16777216L)) END"
    )
    rows = rows.select("*", same.alias("_k"))
    place = lambda k: f"CAST(_h[{k}] & 16777215L AS int)"
    equal = " AND ".join(f"_w[{place('k')} + {d}] = _w[{place('k + 1')} + {d}]" for d in (-1, 0, 1))
    clean = F.expr(f"forall(_k, k -> {equal})")
    covered = F.expr(
        f"size(array_distinct(flatten(transform(_k, k -> array({place('k')}, {place('k')} + 1, {place('k')} + 2, "
        f"{place('k + 1')}, {place('k + 1')} + 1, {place('k + 1')} + 2)))))"
    )
    exact = F.expr(
        "aggregate(array(sort_array(transform(sequence(1, size(_w) - 2), i -> struct(_w[i - 1] AS a, _w[i] AS b, _w[i + 1] AS c, i AS i)))), 0, "
        "(z, s) -> size(array_distinct(flatten(transform(filter(sequence(0, size(s) - 1), k -> "
        "(k > 0 AND s[k].a = s[k - 1].a AND s[k].b = s[k - 1].b AND s[k].c = s[k - 1].c) OR "
        "(k < size(s) - 1 AND s[k].a = s[k + 1].a AND s[k].b = s[k + 1].b AND s[k].c = s[k + 1].c)), "
        "k -> array(s[k].i, s[k].i + 1, s[k].i + 2))))))"
    )
    repeats = F.when(F.size("_w") >= 1 << 24, exact).when(F.size("_k") == 0, F.lit(0)).when(clean, covered).otherwise(exact)
    return rows.select(
        key_col, "_text", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        repeats.cast("long").alias("n_repeat_words"),
    )


def rules() -> list[Rule]:
    """The cascade's rules, on the columns of counts(). Those on counted columns are nearly free."""
    c = F.col
    return [
        Rule("mean_word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")), 0.01),
        Rule("symbols", 10 * c("n_symbols") > c("n_words"), 0.01),
        Rule("repeated_lines", (c("n_dup_lines") > 2) & (10 * c("n_dup_lines") > 3 * c("_n_lines")), 0.01),
        Rule("repeated_words", 10 * c("n_repeat_words") > 3 * c("n_words"), 0.01),
        Rule("letters", 10 * F.length(F.regexp_replace("_text", r"[^\p{L}]+", "")) < 6 * c("word_chars"), 1.0),
        Rule("placeholder", F.lower("_text").contains("lorem ipsum"), 0.2),
        Rule("script", F.regexp_count("_text", F.lit(r"[{}]")) * 50 > c("n_words"), 0.5),
    ]


def ordered(counted: DataFrame, some: list[Rule]) -> list[Rule]:
    """The rules by rejection per cost, estimated on `counted`, the counts of a sample."""
    sample = cut(counted, "quality-sample")

    def measure(test: Column) -> tuple[float, float]:
        job = sample.agg(F.avg(F.coalesce(test, F.lit(False)).cast("int")))
        job.first()
        began = time.perf_counter()
        share = job.first()[0]
        return share or 0.0, time.perf_counter() - began

    _, nothing = measure(F.lit(False))
    value = {}
    for r in some:
        share, seconds = measure(r.rejects)
        # rejection first of all counts; a rule too cheap to be timed has its stated cost
        cost = max(r.base_cost, (seconds - nothing) / max(nothing, 1e-3))
        value[r.name] = (share + 1e-6) / cost
    return sorted(some, key=lambda r: (-value[r.name], r.name))


def judge(counted: DataFrame, order: list[Rule]) -> DataFrame:
    """counted with base_failed, rejected_by (the first rule of the order that rejects) and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.when(base, F.lit("base"))
    for r in order:
        verdict = verdict.when(r.rejects, F.lit(r.name))
    out = counted.select("*", base.alias("base_failed"), verdict.alias("rejected_by"))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def quality(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", sample_rows: int = 500) -> DataFrame:
    """The base counts, base_failed, rejected_by and kept of every row. Costs and selectivities are those of
    about `sample_rows` rows, drawn from all partitions alike."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    sampled = counts(docs.sample(share, seed=7), key_col, text_col)
    return judge(counts(docs, key_col, text_col), ordered(sampled, rules())).drop("_text", "_n_lines")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), c AS (
  SELECT d.doc_id, d.text, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(n.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
            OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines) OR 10 * n_repeat_words > 3 * n_words
            OR 10 * length(regexp_replace(text, '[^\p{L}]+', '', 'g')) < 6 * word_chars
            OR contains(lower(text), 'lorem ipsum')
            OR 50 * len(regexp_extract_all(text, '[{}]')) > n_words) AS kept
FROM b
"""
