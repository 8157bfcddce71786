"""Documents to packed training sequences: quality classifier, line rules, near-duplicates, secrets, packing.

Each stage takes the documents that the one before kept, as written to a table, and returns a table of its own.  Tables may
be empty and may have more columns, which go through; repeated rows, and rows with the same id, are documents of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.functions.folders import shared_folder
from fathom.llm import byte_cnn, line_rules, near_copies, packing, secrets
from fathom.llm.graph import delete
from fathom.llm.queries import WORD_BPE, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject; a null text is judged as an empty one."""
    return byte_cnn.keep_quality(docs, byte_cnn.train(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep enough of their lines, without the lines that fail; null and empty texts go."""
    return line_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 at least.

    Documents without a word are copies of each other; a null id stays only where its group has no other.
    """
    return near_copies.keep_representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of every secret; a null text stays null."""
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids; a null or empty text is its end mark alone."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("rules", rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.

    The tables between the stages are in the folder that driver and executors share, so a lost executor costs its own tasks
    only.  Each is deleted once the next is written; the last one stays, since the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, written = written, f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before:
            delete(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
