"""Audit of how filters interact: what each removes, alone and after others, in every order.

1. Each text is read once: four filters look at the text alone, the fifth asks whether a smaller id has the
   same text. The small rows (id, part, failed filters, digest of the text) are a written table.
2. The smallest id of each text is an aggregate by digest, with partial sums before the shuffle. It goes back
   to the rows by the pair (id, digest), so a text that a third of all rows share makes no large key.
3. Counts by part and failed filters form one tensor a part with an axis of two (pass, fail) a filter, for
   documents, good ones and toxic ones. For every step of every order einsum contracts each axis with one of
   three vectors: pass, fail or all.

Defined results: a null text is the empty text, a null part the empty string. Repeated rows count each.
Equal rows with equal ids are no copies of each other; a null id has no smaller id and is none. A document
is good or toxic if any row of the labels says so; labels of unknown documents and null labels count for
nothing. Texts of any length are read whole. Other columns of the tables are left alone, whatever they are
named. An empty table has no part, so it gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.llm.common import batches, cut, small_batches, table

_UPPER = string.ascii_uppercase.encode()
_SYMBOL = re.compile(rb"[#$%&*|]")
#: Texts judged together up to about this many bytes.
TOGETHER = 4_000_000
#: Parts whose tensors are contracted together.
PARTS_TOGETHER = 64
MEASURES = ("n", "good", "toxic")
#: Condition under which a text fails, from its bytes, words and number of code points.
Check = Callable[[bytes, list[bytes], int], bool]
TEXT_FILTERS: dict[str, Check] = {
    "A": lambda raw, words, size: len(words) < 200,
    "B": lambda raw, words, size: 100 * len(set(words)) < 50 * len(words),
    "C": lambda raw, words, size: 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 3 * size,
    "D": lambda raw, words, size: _SYMBOL.search(raw) is not None,
}
COPY_FILTER = "E"


def text_failures(docs: DataFrame, checks: dict[str, Check], key_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(key, part, fails, digest) of every row: bit i of fails is set if check i fails."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key_col).alias("key"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    tests = list(checks.values())

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for some in batches(frame, TOGETHER, 2):
                sizes = pc.utf8_length(some.column(2)).to_pylist()
                fails, digests = [], []
                for raw, size in zip(some.column(2).cast(pa.binary()), sizes, strict=True):
                    raw = raw.as_py()
                    words = raw.split()  # bytes are split at blank and \t to \r only
                    fails.append(sum(1 << i for i, test in enumerate(tests) if test(raw, words, size)))
                    digests.append(hashlib.sha256(raw).digest())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], names=["key", "part", "fails", "digest"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, part string, fails int, digest binary")


def with_copies(facts: DataFrame, bit: int) -> DataFrame:
    """facts with `bit` set in fails where a smaller key has the same digest."""
    firsts = facts.groupBy("digest").agg(F.min("key").alias("key")).filter("key IS NOT NULL").withColumn("_first", F.lit(True))
    copy = F.col("_first").isNull() & F.col("key").isNotNull()
    return facts.join(firsts, ["key", "digest"], "left").withColumn("fails", F.when(copy, F.col("fails").bitwiseOR(1 << bit)).otherwise(F.col("fails"))).drop("_first")


def cells(facts: DataFrame, labels: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(part, fails, n, good, toxic): documents by what they fail, 2^filters rows a part at most."""
    marks = labels.select(F.col(key_col).alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("key IS NOT NULL AND (good OR toxic)")
    marks = marks.groupBy("key").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    count = [F.count("*").alias("n"), *(F.sum(F.when(F.col(c), 1).otherwise(0)).cast("long").alias(c) for c in ("good", "toxic"))]
    return facts.join(marks, "key", "left").groupBy("part", "fails").agg(*count)


def contracted(tensors: np.ndarray, filters: str) -> tuple[list[str], dict[str, np.ndarray]]:
    """All orders of the filters, and arrays [part, order, step] of their counts.

    tensors: [part, measure, 2, ..., 2], an axis a filter, whose places are pass and fail.
    """
    k = len(filters)
    every, passes, fails = np.eye(2, dtype=np.int64).sum(axis=0), np.array([1, 0]), np.array([0, 1])
    orders = list(permutations(range(k)))

    def contract(chosen: list[list[np.ndarray]]) -> np.ndarray:
        """[part, step, measure] for rows of k vectors, one an axis."""
        vectors = np.array(chosen, dtype=np.int64)
        operands: list = [tensors, list(range(2 + k))]
        for axis in range(k):
            operands += [vectors[:, axis], [2 + k, 2 + axis]]
        return np.einsum(*operands, [0, 2 + k, 1], optimize=True)

    kept, removed, alone, failing = [], [], [], []
    for order in orders:
        for step, own in enumerate(order):
            before = set(order[:step])
            kept.append([passes if a in before or a == own else every for a in range(k)])
            removed.append([passes if a in before else fails if a == own else every for a in range(k)])
            alone.append([fails if a == own else passes for a in range(k)])
            failing.append([fails if a == own else every for a in range(k)])
    shape = (len(tensors), len(orders), k, tensors.shape[1])
    kept, removed, alone, failing = (contract(c).reshape(shape) for c in (kept, removed, alone, failing))
    gone = removed[..., 0]
    own = np.array(orders)
    total = np.stack([(gone * (own == f)).sum(axis=(1, 2)) for f in range(k)], axis=1)  # [part, filter]
    found = {
        "kept": kept[..., 0], "removed": gone, "redundant": failing[..., 0] - gone, "unique_fails": alone[..., 0],
        "good_lost": removed[..., 1], "toxic_lost": removed[..., 2], "shapley": total[:, own],
    }
    return ["".join(filters[f] for f in o) for o in orders], found


def interactions(counted: DataFrame, filters: str) -> DataFrame:
    """One row per part, order and step from the cells of `filters` (a letter a filter, bit i of fails is letter i)."""
    k, names = len(filters), ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    gathered = counted.groupBy("part").agg(F.collect_list(F.struct("fails", *MEASURES)).alias("cells"))  # 2^k cells at most

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start in range(0, frame.num_rows, PARTS_TOGETHER):
                rows = frame.slice(start, PARTS_TOGETHER).to_pylist()
                flat = np.zeros((len(rows), len(MEASURES), 1 << k), dtype=np.int64)
                for at, row in enumerate(rows):
                    for c in row["cells"]:
                        flat[at, :, c["fails"]] = [c[m] for m in MEASURES]
                # bit 0 varies fastest, so it is the last axis of the reshaped counts
                tensors = flat.reshape(len(rows), len(MEASURES), *[2] * k).transpose(0, 1, *range(k + 1, 1, -1))
                orders, found = contracted(tensors, filters)
                parts = np.repeat([r["part"] for r in rows], len(orders) * k)
                steps = np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows) * len(orders))
                cols = [pa.array(parts, pa.string()), pa.array(np.tile(np.repeat(orders, k), len(rows)), pa.string()), pa.array(steps)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(found[n].ravel()) for n in names)], names=["part", "filter_order", "step", *names])

    return gathered.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))


def audit(docs: DataFrame, labels: DataFrame, checks: dict[str, Check] | None = None) -> DataFrame:
    """Counts of every step of every order of the checks and the filter of copies, for each part."""
    checks = TEXT_FILTERS if checks is None else checks
    facts = cut(text_failures(docs, checks), "filter-facts")
    return interactions(cells(with_copies(facts, len(checks)), labels), "".join(checks) + COPY_FILTER)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over all documents, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM d
), m AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN m USING (doc_id) GROUP BY part, fails
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), o AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM l a JOIN l b ON b.l <> a.l JOIN l c ON c.l NOT IN (a.l, b.l) JOIN l d ON d.l NOT IN (a.l, b.l, c.l) JOIN l e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o)
), r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS failing,
         length(translate(before, fails, '')) = step - 1 AS reached
  FROM c CROSS JOIN s
), g AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
         sum(CASE WHEN reached AND NOT failing THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN reached AND failing THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failing AND NOT reached THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN reached AND failing THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN reached AND failing THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""
