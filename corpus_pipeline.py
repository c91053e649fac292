"""The corpus pipeline: every stage works on all documents that the one before it kept.

Language identification drops documents without an identifiable language, the Jaccard join keeps one
document of each group of near copies, personal data is redacted, documents are sampled to target
weights, and what is left is encoded and decoded as tokens.

Every stage keeps columns that aren't its own as they are, whatever they are named, and gives no rows for
an empty table. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.llm.bpe import encode_decode, word_vocabulary
from assurelake.llm.common import drop_path, fresh, work_path
from assurelake.llm.jaccard import representatives
from assurelake.llm.langid import held_out, identify, train
from assurelake.llm.mixing import CAPS, TARGETS, sampled
from assurelake.llm.pii import redact_documents

#: Probability under which a language is not taken for identified.
MIN_SCORE = 0.5
#: No SQL: the language model, the redaction and the tokens have no SQL form.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that have no identifiable language: null texts, texts without a letter, and those whose
    best language has less than MIN_SCORE. A document without a language gets the one identified; a stated
    one stays. Repeated rows are judged alike."""
    model = train(docs.filter(~held_out()))
    lang, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = identify(docs, model, "text", lang, score).filter((F.col(lang) != "und") & (F.col(score) >= MIN_SCORE))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: of those with the smallest id (a null one comes last)
    one. Rows that repeat id and text are one; rows that share an id only are not. Rows without an id and
    without words (null and empty texts) are in no group and stay."""
    return representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; n_chars follows the text. Null and empty texts stay as
    they are, no row goes, and repeated rows are redacted alike."""
    return redact_documents(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents by the calibrated probabilities of their source, language and topic. Nulls of source
    and language are a category of their own; null and empty texts are drawn by the weight of their cell;
    rows that repeat an id are drawn alike."""
    return sampled(docs, TARGETS, CAPS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left: a row per row, null and empty texts with no tokens."""
    return encode_decode(docs, word_vocabulary())


STAGES = [("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage on what all the others keep. A stage's table goes when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            drop_path(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
