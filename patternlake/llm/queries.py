"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import codebooks, htmltext, language, licenses, mixing, neighbours, phrases, quality, rulefit, secrets, simhash
from .common import shared_path, table
from .packing import pack_documents
from .tokenfile import read_token_file, write_token_file


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all `documents` in sequences. A null text is empty and has its end id alone, repeated rows are packed each, equal ones in any order; other columns are not read, and an empty table gives no rows."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all `documents` as a file's blocks give them back. A null or empty text has its end id alone; a null doc_id goes first, equal ids by their texts' hash; an empty table gives no rows."""
    write_token_file(table(spark, sf_dir, "documents"), path := shared_path(spark, "tokens"))
    return read_token_file(spark, path)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all `documents`. A null or empty text has no words and is not kept; repeated rows give a row each, and an empty table none."""
    return quality.clean_lines(table(spark, sf_dir, "documents")).drop("lost_words", "clean_text")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all `pages`. Null or empty html, and pages without content, give an empty text; repeated rows give a row each, and an empty table none."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all `documents`. A null text is empty; texts without words have the fingerprint zero and are linked like any other; an empty table gives no rows."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all `embeddings`. Vectors that are null, zero or not finite link with nothing; equal vectors count each; an empty table gives no rows."""
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all `documents`. Null texts and those without a letter are `und`; rows without lang, or with a null id, teach nothing; an empty table gives no rows."""
    return language.identify(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all `documents`. A null text has size 0; a null source is one of its own, the last; of rows that tie by id and size each has its own share by the row's hash; an empty table gives no rows."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all `documents`. A null text is empty and has none; repeated rows give a row each; a null source or lang is a folder of its own; an empty table gives no rows."""
    return licenses.license_of_documents(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all `documents`. A null or empty text has none, and the hash of an empty list; repeated rows give a row each, and an empty table none."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language of `documents`. Null texts count as empty, a null lang is `und`; an empty table gives no rows."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all fit vectors of `embeddings`; rows with null or non-finite components are left out. An empty table gives no rows."""
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all `documents`, null and empty texts too, learned from `labels`. An empty table gives no rows; without labels all score alike."""
    docs = table(spark, sf_dir, "documents")
    return rulefit.score(docs, rulefit.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_token_output, op3_quality_rules, op4_html_extraction, op5_simhash, op6_nn_descent, op7_language_id, op8_mixing, op9_license_scans, op10_secrets, op11_phrases, op12_vector_codes, op13_quality_classifier)
}
ORACLE_SQL: dict[str, str] = {"op3_quality_rules": quality.ORACLE, "op11_phrases": phrases.ORACLE, "op12_vector_codes": codebooks.oracle()}
