"""Conflict-free merge of pattern tables from several nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "key, tool_type, category, context, success, failure, ts, node, version, deleted"
COLUMNS = tuple(ENTRY.split(", "))


def merge(replicas: list[DataFrame] | DataFrame, strategy: str = "last_write") -> DataFrame:
    """One entry a key of replicas' entries (COLUMNS; version maps nodes to longs), in the replicas' order or by a column replica.

    last_write takes the entry that is last by time, then node, then replica. add_only takes the greatest counters, the
    first category there is, and the newest context, the first replica's of equals; it is deleted only where all agree.
    Either way, each node's greatest version stays.
    """
    if not isinstance(replicas, DataFrame):
        numbered = [r.withColumn("replica", F.lit(i)) for i, r in enumerate(replicas)]
        replicas = numbered[0]
        for r in numbered[1:]:
            replicas = replicas.unionByName(r)
    versions = replicas.select("key", F.explode_outer("version").alias("n", "v")).groupBy("key", "n").agg(F.max("v").alias("v"))
    versions = versions.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "v"))))).alias("version"))  # an entry a node
    if strategy == "last_write":
        won = replicas.groupBy("key").agg(F.max_by(F.struct("tool_type", "category", "context", "success", "failure", "ts", "node", "deleted"), F.struct("ts", "node", "replica")).alias("x")).select("key", "x.*")
    else:
        newest, first = F.struct("ts", -F.col("replica")), F.col("replica")
        won = replicas.groupBy("key").agg(
            F.min_by("tool_type", first).alias("tool_type"), F.min_by("category", F.when(F.col("category").isNotNull(), first)).alias("category"), F.max_by("context", newest).alias("context"), F.max("success").alias("success"), F.max("failure").alias("failure"),
            F.max("ts").alias("ts"), F.max_by("node", newest).alias("node"), F.bool_and("deleted").alias("deleted"),
        )
    return won.join(versions, "key").select(*COLUMNS)


def insert(entries: DataFrame, patterns: DataFrame, node: str, strategy: str = "last_write") -> DataFrame:
    """entries with a node's patterns (key, tool_type, category, context, success, failure, ts: when each was last changed)."""
    new = patterns.withColumns({"node": F.lit(node), "version": F.create_map(F.lit(node), F.lit(1).cast("long")), "deleted": F.lit(False)})
    return merge([entries, new.select(*COLUMNS)], strategy)


def delete(entries: DataFrame, keys: DataFrame, node: str, ts: int) -> DataFrame:
    """entries with those of keys (key) marked as deleted at ts, and the node's version of them one higher."""
    gone = entries.join(keys.select("key").distinct().withColumn("gone", F.lit(True)), "key", "left")
    higher = F.map_concat(F.map_filter("version", lambda n, v: n != node), F.create_map(F.lit(node), F.coalesce(F.try_element_at("version", F.lit(node)), F.lit(0)) + 1))
    hit = F.coalesce("gone", F.lit(False))
    return gone.withColumns({"deleted": F.col("deleted") | hit, "ts": F.when(hit, F.lit(ts).cast("long")).otherwise(F.col("ts")), "version": F.when(hit, higher).otherwise(F.col("version"))}).select(*COLUMNS)


def alive(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("deleted"))


def state_vector(entries: DataFrame) -> DataFrame:
    """node, version: the greatest version of each node over all entries."""
    return entries.select(F.explode("version").alias("node", "version")).groupBy("node").agg(F.max("version").alias("version"))
