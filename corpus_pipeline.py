"""A corpus pipeline of five operators: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.llm import language, mixing, packing, secrets, simhash
from patternlake.llm.common import cut, shared_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told."""
    return language.keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: that of the smallest doc_id, null last; of equal ones by a hash of the row. Rows that share a doc_id, or have none, are rows of their own."""
    path = shared_path(spark, "rows")
    docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)  # written, so that a row's id stays
    rows = spark.read.parquet(path)
    found = simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text", "lang", "source", "n_chars").alias("hash"), "row")
    first = found.join(rows.select("row", order.alias("order")), "row").groupBy("component_id").agg(F.min("order").alias("m"))
    kept = cut(first.select(F.col("m.row").alias("row")))
    # Texts meet the kept rows by a shuffle at every size: as many rows are kept as there are documents.
    return rows.join(kept.hint("shuffle_hash"), "row", "left_semi").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in all documents."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents to their sources' targets."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into training sequences."""
    return packing.pack_documents(docs)


STAGES = [(f.__name__, f) for f in (language_id, simhash_dedup, secret_scan, mix_sources, pack_sequences)]
#: The language network and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
