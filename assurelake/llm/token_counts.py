"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer version, content digest) -> n_tokens. Documents are joined
to it by the digest of their normalised content and of the tokenizer; only distinct contents that
miss are encoded, once each, and appended; every document then takes its count from the cache.
The content is normalised only as far as the tokenizer itself does: byte-level vocabularies have no
normaliser, so here a null becomes the empty text and nothing else changes.

Copies: the distinct misses are found by an aggregation that combines before its shuffle, so a text
that is repeated a million times crosses the network once per task. The join back by digest is
between plain scans, which Spark splits where one digest is hot.

Defined results: null and empty texts have 0 bytes and 0 tokens. An empty table gives no rows and
leaves the cache as it is. Repeated rows each get a row. A special token's string in a text counts
as the one special token, as the library does by default.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.llm.common import batches, table, work_path

#: A run of this many characters without a break is left to the library whose merges aren't quadratic.
LONG_RUN = re.compile(r"\S{3000}|\s{3000}")
CACHE_SCHEMA = "version string, digest binary, n_tokens long"

_encoders: dict[str, tuple] = {}


def _encoder(vocabulary: str, ranks: str | None, pattern: str):
    """(tokenizers' encoder, the faster reader of the same vocabulary's ranks or None), once a worker."""
    if vocabulary not in _encoders:
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        slow, fast = Tokenizer.from_file(vocabulary), None
        if ranks:
            with open(ranks, "rb") as f:
                merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
            fast = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=merge, special_tokens=special)
        _encoders[vocabulary] = slow, fast
    return _encoders[vocabulary]


def count_tokens(text: str, vocabulary: str, ranks: str | None, pattern: str) -> int:
    slow, fast = _encoder(vocabulary, ranks, pattern)
    if fast is None or LONG_RUN.search(text):
        return len(slow.encode(text, add_special_tokens=False).ids)
    return len(fast.encode(text, allowed_special="all"))


def tokenizer_version(vocabulary: str) -> str:
    """Digest of the vocabulary file: another file is another version."""
    with open(vocabulary, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_with_cache(
    docs: DataFrame, cache_path: str, vocabulary: str, ranks: str | None, pattern: str, limit: int = 1024, key_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: the key, n_bytes, n_tokens and over_limit. Appends what it had to count to cache_path.

    `cache_path` is a folder that all executors share; it need not exist. `ranks` is an optional file
    with the same vocabulary as ranks, which is quicker to encode with.
    """
    spark = docs.sparkSession
    version = tokenizer_version(vocabulary)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(key_col), text.alias("_text"))
    digest = F.unhex(F.sha2("_text", 256)).alias("_digest")
    contents = rows.select(digest, "_text").filter("_text <> ''")
    # copies are one before they meet the cache, so that a hot digest is no hot key of the join
    distinct = contents.groupBy("_digest").agg(F.first("_text").alias("_text"))
    missing = distinct.join(_read(spark, cache_path, version), "_digest", "left_anti")

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in batches(frame, 4_000_000):
                n = [count_tokens(t, vocabulary, ranks, pattern) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(n)), part.column(0), pa.array(n, pa.int64())], names=["version", "digest", "n_tokens"])

    missing.mapInArrow(count, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # a retried append can hold a digest twice, with the same count
    cached = _read(spark, cache_path, version)
    known = rows.select(key_col, digest, F.octet_length("_text").cast("long").alias("n_bytes"))
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return known.join(cached, "_digest", "left").select(key_col, "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def _read(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The stored counts of a tokenizer; none where there is no cache yet."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    rows = (spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)).filter(F.col("version") == version)
    return rows.select(F.col("digest").alias("_digest"), F.col("n_tokens").alias("_n"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, from a cache that starts empty."""
    import public_tokenizers

    path = public_tokenizers.path
    return count_with_cache(
        table(spark, sf_dir, "documents"), work_path(spark, "token-cache"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
