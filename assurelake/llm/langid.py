"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language in one Spark aggregation and turns them into a
(buckets x languages) matrix of log probabilities, whose size is fixed by the parameters; it is
broadcast. Scoring takes a batch of texts at once: its n-grams are the entries of a sparse (texts x
buckets) matrix in row order, whose product with the log probabilities numpy computes by gathering the
matrix's rows and summing them by text.

Defined results: a null text or one without a letter gives `und` with score 0 (numerals that aren't
letters, like a half or a raised two, don't count). Without any labelled row every text gives `und`, 0.
Ties go to the alphabetically first language. Repeated rows are scored alike. Other columns of the input
are ignored; those named like the results give way to them. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.llm.common import batches, small_batches, table

WORD = re.compile(r"[^\W\d_]")
#: Texts are scored together up to about this many bytes, and a longer text in pieces of so many characters,
#: so that memory is bounded for any text.
TOGETHER, PIECE = 1 << 19, 1 << 18
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prob: np.ndarray  # (buckets, languages)
    prior: np.ndarray
    orders: tuple[int, ...]


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; the pattern alone also finds numerals that aren't decimal digits."""
    return text is not None and any(m[0].isalpha() for m in WORD.finditer(text))


def pieces(texts: list[str], overlap: int) -> Iterator[tuple[list[int], list[str]]]:
    """The lower-cased, space-padded texts in groups of about PIECE characters, with the number of the text
    that each part is of. A long text is cut into parts that overlap by `overlap` characters."""
    which, parts, size = [], [], 0
    for i, text in enumerate(texts):
        text = f" {text.lower()} "
        for at in range(0, len(text), PIECE):
            part = text[at : at + PIECE + overlap]
            which.append(i)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield which, parts
                which, parts, size = [], [], 0
    if parts:
        yield which, parts


def gram_rows(texts: list[str], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sparse matrix of the texts' n-grams, in slices: the texts that have any, where each one's entries
    begin, and the bucket of every entry (each counts one)."""
    for which, parts in pieces(texts, max(orders) - 1):
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(p) for p in parts])
        ends = np.cumsum(size)
        for n in orders:
            if len(codes) < n:
                continue
            h = codes[: len(codes) - n + 1] * _M1
            for k in range(1, n):
                h = (h ^ codes[k : k + len(h)]) * _M1
                h ^= h >> np.uint32(15)
            h = (h + np.uint32(n)) * _M2
            bucket = (h >> np.uint32(32 - int(buckets).bit_length() + 1)).astype(np.int64)
            # a longer order's overlap completes no gram of a shorter one, and none crosses two parts
            count = np.minimum(np.maximum(size - n + 1, 0), PIECE)
            inside = np.arange(len(bucket)) - np.repeat(ends - size, size)[: len(bucket)] < np.repeat(count, size)[: len(bucket)]
            has = np.flatnonzero(count)
            if len(has):
                yield np.array(which)[has], np.r_[0, np.cumsum(count[has])[:-1]], bucket[inside]


def train(
    labelled: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    key_col: str = "doc_id",
    buckets: int = 1 << 15,
    orders: tuple[int, ...] = (1, 2, 3),
    alpha: float = 0.5,
    max_train_rows: int = 20_000,
) -> Model:
    """Fit on at most about `max_train_rows` labelled rows (a sample by the hash of key_col, over all
    of the table); `buckets` must be a power of two. Rows with a null label or text don't count."""
    rows = labelled.select(F.col(key_col).alias("k"), F.col(text_col).alias("t"), F.col(label_col).alias("y"))
    rows = rows.filter("t IS NOT NULL AND y IS NOT NULL")
    n = labelled.filter(F.col(label_col).isNotNull()).count()
    if n > max_train_rows:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("train"), "k"), F.lit(1 << 30)) < int((1 << 30) * max_train_rows / n))

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for frame in frames:
            for part in batches(frame, TOGETHER, 0):
                by: dict[str, list[str]] = {}
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if has_letter(text):
                        by.setdefault(y, []).append(text)
                for y, texts in by.items():
                    acc = total.setdefault(y, np.zeros(buckets, dtype=np.int64))
                    docs[y] = docs.get(y, 0) + len(texts)
                    for _, _, b in gram_rows(texts, orders, buckets):
                        acc += np.bincount(b, minlength=buckets)
        for y, acc in total.items():
            hit = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([y] * (len(hit) + 1), pa.string()), pa.array(np.append(hit, -1), pa.int32()), pa.array(np.append(acc[hit], docs[y]), pa.int64())],
                names=["y", "bucket", "n"],
            )

    counted = rows.select("t", "y").mapInArrow(count, "y string, bucket int, n long")
    got = counted.groupBy("y", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    languages = sorted(got["y"].unique())
    counts = np.zeros((buckets, len(languages)))
    prior = np.zeros(len(languages))
    for j, y in enumerate(languages):
        own = got[got["y"] == y]
        grams = own[own["bucket"] >= 0]
        counts[grams["bucket"].to_numpy(), j] = grams["n"].to_numpy()
        prior[j] = own.loc[own["bucket"] < 0, "n"].sum()
    log_prob = np.log(counts + alpha) - np.log(counts.sum(axis=0) + alpha * buckets) if languages else counts
    return Model(languages, np.ascontiguousarray(log_prob), np.log(prior / prior.sum()) if languages else prior, orders)


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """(languages, posterior probabilities) of the texts."""
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
    names, score = ["und"] * len(texts), np.zeros(len(texts))
    if not known:
        return names, score
    total = np.tile(model.prior, (len(known), 1))
    for row, start, bucket in gram_rows([texts[i] for i in known], model.orders, len(model.log_prob)):
        np.add.at(total, row, np.add.reduceat(model.log_prob[bucket], start, axis=0))
    best = total.argmax(axis=1)
    score[known] = 1.0 / np.exp(total - total[np.arange(len(known)), best][:, None]).sum(axis=1)
    for i, b in zip(known, best.tolist(), strict=True):
        names[i] = model.languages[b]
    return names, score


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with two more columns: the predicted language and its probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages

    small_batches(docs.sparkSession)
    text_at = docs.columns.index(text_col)
    schema = docs.drop(lang_out, score_out).withColumns({lang_out: F.lit("").cast("string"), score_out: F.lit(0.0)}).schema
    kept = [i for i, c in enumerate(docs.columns) if c not in (lang_out, score_out)]

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in batches(frame, TOGETHER, text_at):
                names, score = score_texts(part.column(text_at).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return docs.mapInArrow(score, schema)


def held_out() -> F.col:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
