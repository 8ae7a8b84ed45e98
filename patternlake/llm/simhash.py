"""SimHash near-duplicates by covering locality-sensitive hashing.

Every fingerprint bit gets a non-zero vector of RADIUS + 1 bits; a table belongs to each such vector v and keeps the
fingerprint bits whose vector has an odd product with v. The vectors of RADIUS differing bits leave some v orthogonal
to all of them, whose table ignores exactly these bits: so every pair within the radius collides in some table, surely
and not just probably. Equal fingerprints are one node, and a fingerprint that shares no bucket has no link.

Pairs are compared within the buckets, where these are small. In a large one each member names the points within 1 bit
of it instead: two fingerprints differ in at most 2 bits just if some point lies within 1 bit of both, so those that name
the same point link to the smallest of them. That is exact and linear in the size of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, spread_join
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42); without a word, 0."""
    import re

    import xxhash

    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text.lower() if text.isascii() else text.translate(LOWER)) if x]
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < shingle else list(map(" ".join, zip(*(w[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(grams), 8192):  # a very long text takes no more memory
        rows = np.frombuffer(b"".join(digest(g.encode(), seed=SEED) for g in grams[lo : lo + 8192]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                fps = np.array([simhash(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """2 ** (radius + 1) - 1 masks. Of any radius bits, some mask has none."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def close_pairs(nodes: DataFrame, pairwise: int = 48) -> DataFrame:
    """nodes: distinct fp. Edges (a, b) between fingerprints within RADIUS bits, enough of them that what is linked stays linked.

    A bucket of at most pairwise members compares them with one another. In a larger one, which chance alone seldom
    makes, members name the points about them instead: those of the bits that the table ignores, for the others are equal.
    """
    masks = F.array(*(F.struct(F.lit(signed(m)).alias("mask"), F.array(F.lit(0), *(F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1)).alias("flips")) for m in covering_masks()))
    tables = nodes.select("fp", F.posexplode(F.transform(masks, lambda m: m["mask"])).alias("t", "mask"))
    buckets = tables.select("fp", F.struct("t", F.col("fp").bitwiseAND(F.col("mask")).alias("masked")).alias("key"))
    sizes = cut(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    small, large = cut(sizes.where(F.col("n") <= pairwise).select("key")), cut(sizes.where(F.col("n") > pairwise).select("key"))
    members = buckets.join(broadcast_if_small(small), "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda x, i: F.transform(F.filter(F.slice("fps", i + 2, pairwise), lambda y: within(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    compared = members.select(F.explode(pairs).alias("e")).select("e.a", "e.b")
    if large.isEmpty():
        return compared.distinct()
    flips = F.get(F.transform(masks, lambda m: m["flips"]), F.col("key.t"))
    crowded = spread_join(cut(buckets), large, "key", "left_semi")
    points = crowded.select("fp", "key", F.explode(flips).alias("flip")).select("fp", F.struct("key", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).alias("at"))
    least = points.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("at", "a")
    named = points.join(least, "at").where("fp > a").select("a", F.col("fp").alias("b"))
    return compared.union(named).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most RADIUS bits) of documents (doc_id, text).

    Null or empty text: fingerprint zero, linked like any other. Every row gives one row, repeated ids too; a null
    doc_id is kept and counts as no doc_id in a component (component_id is null where all are null). Other columns are
    not read. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(close_pairs(nodes.select("fp")))
    placed = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    named = cut(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = cut(spread_join(placed, named, "root").select("fp", "component_id"))
    return spread_join(prints, classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
