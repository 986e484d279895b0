"""The corpus pipeline: documents through five of the operators of tally.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns is the
next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import exact_dedup, near_dedup, packing, pii, toxicity
from tally.llm.common import free_name, table, written
from tally.llm.queries import byte_bpe_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go. It learns from the labelled documents among ``docs``.

    Null and empty texts match nothing and stay, unless most labelled ones are toxic; repeated rows are decided alike.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Of equal texts, the smallest doc_id stays; null texts count as empty, and of repeated rows one stays."""
    return exact_dedup.exact_dedup(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Of documents whose 5-word shingles are 80 % alike, one of each group stays; so do texts without words and rows without a doc_id."""
    return near_dedup.near_dedup(docs, size=5, percent=80)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Personal data becomes pseudonyms; n_chars follows the text. Null texts and all columns of the caller's stay."""
    changed = free_name(docs.columns, "pii_changed")
    out = pii.pseudonyms(docs, changed=changed)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(changed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """What is left, in sequences of 2048 ids; a null or empty text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs, byte_bpe_path(), capacity=2048, end=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

#: Tokens and learned weights can't be had in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
