"""A corpus pipeline of five operators: each stage's result is written as Parquet and read back as the next one's documents.

All stages take texts of any length, rows with null ids, rows that share an id or repeat each other, and further columns of
any name, which pass through unchanged; an empty table gives an empty one with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import bpe, decontaminate, langid, secrets, simhash
from treeloom.llm.common import materialize, table


def free_name(docs: DataFrame) -> str:
    """A name that no column of docs begins with."""
    name = "_found_"
    while any(c.startswith(name) for c in docs.columns):
        name = "_" + name
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go; the others carry the language predicted.

    Null texts and texts without a letter are rejected. Without any labelled document nothing can be learned, and all go. Ties go to
    the language first in order. Repeated rows share their fate.
    """
    prefix = free_name(docs)
    found = langid.predict(docs, langid.train(docs), prefix=prefix)
    return found.where(~F.col(f"{prefix}rejected")).withColumn("lang", F.col(f"{prefix}lang_pred")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Groups go by texts, not by ids: of a group's rows that share the smallest id one stays, null ids come last, and rows of other groups
    with that id stay, too. Null and empty texts are one group. Of equal rows one stays.
    """
    return simhash.keep_one(docs).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, be it one of a few words.

    Null texts, and all texts if there is no item, stay. Rows that share an id are judged by their own texts; repeated rows share
    their fate. A document that reaches the threshold exactly goes.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), short_inside=True)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, private keys with their bodies, are replaced by a mark; n_chars is that of the new text.

    Overlapping secrets become one mark. Texts without any, null ones included, stay as they are, n_chars with them.
    """
    rest = [c for c in docs.columns if c != "doc_id"]
    name = free_name(docs)
    found = secrets.scan_secrets(docs, secrets.REDACT_RULES, keep=rest, found_col=name)
    hit = F.size(name) > 0
    clean = found.withColumn("text", F.when(hit, secrets.redact(F.col("text"), F.col(name))).otherwise(F.col("text")))
    changed = F.when(hit, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of the ids and of what they decode to.

    A null text counts as empty and has no ids. Every row gives one, repeated rows and null ids as well.
    """
    return bpe.encode_documents(docs, *bpe.public_vocab(), output="full")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("bpe_encoding", encoded),
]
#: The first stage's models can't be said in SQL; tests/llm/test_pipeline.py checks run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
