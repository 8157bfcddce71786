"""Queries over the corpus tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import byte_cnn, language
from fathom.llm.codec import codec_digests
from fathom.llm.line_rules import clean_documents
from fathom.llm.oracles import ORACLE_SQL  # noqa: F401
from fathom.llm.packing import pack_documents
from fathom.llm.periods import find_runs, loop_tails, run_digests
from fathom.llm.pseudonyms import KEY_REDACTION, pseudonymise
from fathom.llm.secrets import scan_secrets
from fathom.llm.simhash import near_duplicates
from fathom.llm.sketches import compare_edited
from fathom.llm.token_counts import count_tokens
from fathom.llm.vectors import near_vectors
from fathom.llm.whitening import whiten_vectors

#: Names of vocabularies; every worker finds its own file.
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"

#: Long digit groups, as a later masking pass would edit them.
LONG_NUMBER = r"\d[\d ().-]{6,}\d"
#: A deployment passes a secret of its own.
PSEUDONYM_KEY = "not-a-secret"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, with_ids=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, edit_pattern=LONG_NUMBER, edit_with="#")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    if not spark.conf.get("spark.sql.redaction.string.regex", None):
        spark.conf.set("spark.sql.redaction.string.regex", KEY_REDACTION)
    return pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_documents(table(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.score_quality(docs, byte_cnn.train(docs, table(spark, sf_dir, "labels")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify_languages(docs, language.fit(docs, PIECE_BPE), PIECE_BPE)


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(find_runs(loop_tails(table(spark, sf_dir, "documents"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_vectors(table(spark, sf_dir, "embeddings"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_line_rules": op6_line_rules,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_vectors": op8_vectors,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
    "op11_periods": op11_periods,
    "op12_whitening": op12_whitening,
    "op13_fingerprints": op13_fingerprints,
}
