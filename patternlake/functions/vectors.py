"""Embeddings of texts: their binary form, what is missing, and search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import retrieve as R


def to_bytes(vector: Column) -> Column:
    """Little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(vector)


def from_bytes(raw: Column) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return unpack(raw)


def embed_missing(rows: DataFrame, text: str, dimensions: int) -> DataFrame:
    """rows with the hash embedding of their text where embedding is null; all of them, not some at a time."""
    own = rows.where(F.col("embedding").isNull()).withColumn("embedding", R.hash_embed(dimensions)(F.col(text)))
    return rows.where(F.col("embedding").isNotNull()).unionByName(own)


def rebuild(rows: DataFrame, text: str, dimensions: int) -> DataFrame:
    """All embeddings anew."""
    return embed_missing(rows.withColumn("embedding", F.lit(None).cast("array<float>")), text, dimensions)


def status(rows: DataFrame, dimensions: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.lit(dimensions).alias("dims"))


def index_add(index: DataFrame, rows: DataFrame, dimensions: int) -> DataFrame:
    """index (id, v) with rows, whose vectors must have dimensions; a known id's vector is replaced."""
    right = rows.where(F.assert_true(F.size("v") == dimensions, F.lit("wrong dimensions")).isNull())
    return index.join(right.select("id"), "id", "left_anti").unionByName(right)


def index_remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids, "id", "left_anti")


def index_bytes(n: int, dimensions: int) -> int:
    """Size of an index file of n vectors: header, ids, vectors."""
    return 12 + 8 * n + 4 * n * dimensions


def similarity(a: Column, b: Column, dimensions: int) -> Column:
    """Cosine of two texts' hash embeddings."""
    embed = R.hash_embed(dimensions)
    return R.cosine(embed(a), embed(b))


def search(queries: DataFrame, rows: DataFrame, k: int, dimensions: int) -> DataFrame:
    """queries (query_id, text), a stated set, against rows (id, text, success, failure): the k nearest of each, score their cosine times their success rate (0 without uses)."""
    embed = R.hash_embed(dimensions)
    near = R.nearest_vectors(queries.select("query_id", embed("text").alias("q")), rows.select("id", embed("text").alias("v")), 2 * k)
    met = R.with_context(near, rows.select("id", "success", "failure"), k)
    rate = F.coalesce(F.try_divide("success", F.col("success") + F.col("failure")), F.lit(0.0))
    return met.select("query_id", F.col("place").cast("long"), "id", F.round("sim", 4).alias("sim"), F.round(F.col("sim") * rate, 4).alias("score"))
