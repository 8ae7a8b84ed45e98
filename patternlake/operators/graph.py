"""Co-occurrence graph with exponentially averaged lift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First and later lift of a common success or failure, rate of learning, bands, and the least support.
FIRST, LATER, ALPHA = (1.2, 0.8), (1.5, 0.3), 0.3
CONFLICT, SYNERGY, SUPPORT = 0.5, 1.5, 3


def pairs(baskets: DataFrame) -> DataFrame:
    """baskets (basket, seq, ok, items array): a row for each pair a < b of a basket's distinct items. Pairs are made within a row, so nothing is joined."""
    items = F.array_sort(F.array_distinct("items"))
    made = F.flatten(F.transform(items, lambda a, i: F.transform(F.filter(items, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return baskets.select("basket", "seq", "ok", F.explode(made).alias("p")).select("basket", "seq", "ok", "p.a", "p.b")


def folded(occurrences: DataFrame) -> DataFrame:
    """occurrences (a, b, seq, ok): a, b, lift after all of them in order of seq, co_occurrences, and factor and offset, by which they would go on from a lift before them.

    A step takes x to (1 - ALPHA) x + c, so any run of steps is a factor and an offset. Rows are dealt to tasks by
    ranges of (a, b, seq): a pair with very many is folded by several, a batch at a time, and its few runs are joined.
    """
    kind = occurrences.schema["seq"].dataType.simpleString()
    n = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = occurrences.select("a", "b", "seq", "ok").repartitionByRange(n, "a", "b", "seq").sortWithinPartitions("a", "b", "seq")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ok = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1, 3))
            ok = ok.astype(bool)
            starts = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)]) if len(a) else np.zeros(0, int)
            sizes = np.diff(np.append(starts, len(a)))
            left = np.repeat(starts + sizes, sizes) - np.arange(len(a)) - 1  # steps of the run after each
            share = np.where(ok, *LATER) * ALPHA * (1 - ALPHA) ** left
            offset = np.add.reduceat(share, starts) if len(starts) else share
            cols = [pa.array(a[starts]), pa.array(b[starts]), batch.column(2).take(pa.array(starts)), pa.array(sizes, pa.int64()), pa.array(offset), pa.array(share[starts]), pa.array(ok[starts])]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "seq", "n", "offset", "share", "ok"])

    parts = ordered.mapInArrow(runs, f"a {occurrences.schema['a'].dataType.simpleString()}, b {occurrences.schema['b'].dataType.simpleString()}, seq {kind}, n long, offset double, share double, ok boolean")
    keep = lambda x, less=0: F.pow(F.lit(1.0 - ALPHA), x["n"] - F.lit(less))
    first = lambda x: F.when(x["ok"], FIRST[0]).otherwise(FIRST[1]) * keep(x, 1) + x["offset"] - x["share"]
    whole = parts.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "offset", "share", "ok"))).alias("r"))  # a run a batch
    after = lambda acc, x: acc * keep(x) + x["offset"]
    return whole.select(
        "a", "b", F.aggregate(F.slice("r", F.lit(2), F.size("r")), first(F.get("r", F.lit(0))), after).alias("lift"), F.aggregate("r", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("co_occurrences"),
        F.aggregate("r", F.lit(1.0), lambda acc, x: acc * keep(x)).alias("factor"), F.aggregate("r", F.lit(0.0), after).alias("offset"),
    )


def lift(occurrences: DataFrame) -> DataFrame:
    """occurrences (a, b, seq, ok): a, b, lift after all of them in order of seq, co_occurrences."""
    return folded(occurrences).select("a", "b", "lift", "co_occurrences")


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of edges as (id, other, lift, co_occurrences)."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "lift", "co_occurrences").select("e.id", "e.other", "lift", "co_occurrences").distinct()


def conflicts(edges: DataFrame) -> DataFrame:
    return neighbours(edges.where((F.col("lift") < CONFLICT) & (F.col("co_occurrences") >= SUPPORT)))


def band_counts(edges: DataFrame) -> DataFrame:
    well = F.col("co_occurrences") >= SUPPORT
    return edges.agg(
        F.count("*").alias("edges"), F.count_if(well & (F.col("lift") > SYNERGY)).alias("synergies"), F.count_if(well & (F.col("lift") < CONFLICT)).alias("conflicts"),
        F.round(F.avg("co_occurrences"), 6).alias("avg_co_occurrences"),
    )


def without_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two different nodes that both exist."""
    ids = nodes.select("id").distinct()
    kept = edges.where("a <> b").join(ids, edges["a"] == ids["id"], "left_semi")
    return kept.join(ids, kept["b"] == ids["id"], "left_semi")


def edges_of(edges: DataFrame, node: int) -> DataFrame:
    """A node's edges, the least lift first."""
    return edges.where((F.col("a") == node) | (F.col("b") == node)).orderBy("lift", "a", "b")
