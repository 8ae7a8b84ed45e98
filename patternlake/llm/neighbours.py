"""Embedding near-duplicates by NN-descent.

A graph of each vector's nearest known neighbours is refined: a neighbour's neighbours are likely neighbours too. It
starts from windows along random projections. In each round, every vector hosts its neighbours, forwards and backwards,
and compares them with one another; what beats the weakest entry of a list goes in, until few entries change.

A list is saturated if it is full and its weakest entry is still a link: it may lack links. Its component is then
enlarged to hold all of its members' links, which are counted by comparing the component's rows in blocks. What such
lists hold are siblings, so the descent goes on among the components' pivots, which look for neighbours of other
components only; members of near pivots are compared, and components that a link joins are one from then on.

A sample of rows is compared with all others to audit the recall of links; while it is too low, lists are made twice as
long, and at last all rows are compared. The links are the edges at the threshold or above.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join
from .components import components

log = logging.getLogger(__name__)

WINDOW = 256  # rows of a projection's order that are compared with one another
HOSTED = 64  # guests that a host compares at a time
BLOCK = 2048  # rows of a component, or of a ball, that are compared with as many at a time
AUDITED = 2048  # vectors that the audit asks at a time
SHARE = 50  # vectors whose id it divides are in the audit's sample
FEWEST = 512  # vectors in the audit's sample at least
PASS_BYTES = 64 << 20  # of the sample that are broadcast at a time
SETTLED = 0.02  # share of near entries that may be new when a descent ends
ROUNDS = 8  # rounds of a descent
EDGE = "node long, other long, sim double"


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, scaled to length 1."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def edges_batch(node: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    """Edges, their cosines rounded so that a pair that is compared twice gives the same."""
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(np.round(sim, 12), pa.float64())], names=["node", "other", "sim"])


def best_of(node: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best edges of each node of a batch."""
    order = np.lexsort((-sim, node))
    node, other, sim = node[order], other[order], sim[order]
    starts = np.flatnonzero(np.diff(node, prepend=node[:1] - 1))
    place = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    return edges_batch(node[place < k], other[place < k], sim[place < k])


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k best of each node's edges; equal pairs count once. Batches give k of a node's edges at most, so no node gathers all its pairs."""
    best = F.slice(F.sort_array(F.array_distinct(F.collect_list(F.struct("sim", "other"))), asc=False), 1, k)
    return edges.groupBy("node").agg(best.alias("list")).select("node", F.explode("list").alias("e")).select("node", "e.other", "e.sim")


def windows(nodes: DataFrame, k: int, trees: int, seed: int) -> DataFrame:
    """nodes (node, root, vector): the nearest of other roots to each within windows of seeded orders, by the signs of 12 random projections, then by another one. All orders take one shuffle."""
    size = nodes.select(F.size("vector")).first()[0]
    planes = np.random.default_rng(seed).normal(size=(trees, size, 13))
    kind = nodes.schema["vector"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(2))
            for tree in range(trees):
                p = rows @ planes[tree]
                cell = ((p[:, :12] > 0) @ (1 << np.arange(12))).astype(np.int64)
                at = tree * 4096 + cell + 0.5 + np.tanh(p[:, 12]) / 2.001
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["node", "root", "vector", "place"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root, tree, rows = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(3)), matrix(batch.column(2))
            found = []
            for lo in range(0, len(node), WINDOW // 2):
                own = slice(lo, lo + WINDOW)
                sims = rows[own] @ rows[own].T
                sims[(root[own, None] == root[None, own]) | (tree[own, None] != tree[None, own])] = -2
                top = np.argpartition(-sims, min(k, len(sims)) - 1, axis=1)[:, :k]
                i, j = np.repeat(np.arange(len(sims)), top.shape[1]), top.ravel()
                good = sims[i, j] > -2
                found.append((node[own][i[good]], node[own][j[good]], sims[i[good], j[good]]))
            yield best_of(*map(np.concatenate, zip(*found)), k)

    placed = nodes.select("node", "root", "vector").mapInArrow(place, f"node long, root long, vector {kind}, place double")
    # A partition holds several windows: rows that are alone in theirs meet nobody.
    n = max(1, min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), trees * nodes.count() // (2 * WINDOW)))
    ordered = placed.repartitionByRange(n, "place", "node").sortWithinPartitions("place", "node")
    return ordered.select("node", "root", "vector", F.floor(F.col("place") / 4096).alias("tree")).mapInArrow(near, EDGE)


def refine(graph: DataFrame, nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """One round: every node's neighbours in either direction that have different roots are compared with one another.

    A host of many deals them anew in each round into parts of about HOSTED, so that it is no one's whole work.
    """
    floors = graph.groupBy("node").agg(F.when(F.count("*") < k, F.lit(-2.0)).otherwise(F.min("sim")).alias("floor"))
    guests = nodes.select("node", "root", "vector").join(floors, "node")
    hosted = graph.select(F.col("node").alias("host"), F.col("other").alias("node")).union(graph.select(F.col("other").alias("host"), "node")).distinct()
    crowds = cut(graph.groupBy(F.col("other").alias("host")).agg(F.ceil(F.count("*") / HOSTED).cast("int").alias("parts")))
    hosted = spread_join(cut(hosted), crowds, "host", "left")
    hosted = hosted.select("host", "node", F.coalesce(F.pmod(F.xxhash64("node", "host", F.lit(seed)), "parts"), F.lit(0)).alias("part"))
    met = spread_join(cut(hosted), cut(guests), "node", max_bytes=0, always=True)  # a node that very many hold is dealt at every size
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n, "host", "part").sortWithinPartitions("host", "part").select("host", "part", "node", "root", "floor", "vector")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, part, node, root, floor = (np.asarray(batch.column(i)) for i in range(5))
            rows = matrix(batch.column(5))
            cuts = np.flatnonzero(np.diff(host) | np.diff(part)) + 1
            found = []
            for a, b in zip([0, *cuts], [*cuts, len(host)]):
                sims = rows[a:b] @ rows[a:b].T
                sims[root[a:b, None] == root[None, a:b]] = -3
                i, j = np.nonzero(sims > floor[a:b, None])
                found.append((node[a + i], node[a + j], sims[i, j]))
            yield best_of(*map(np.concatenate, zip(*found)), k)

    return nearest(graph.union(met.mapInArrow(meet, EDGE)), k)


def descend(nodes: DataFrame, k: int, trees: int, seed: int, near: float, graph: DataFrame | None = None) -> DataFrame:
    """The k nearest known nodes of other roots of each of nodes (node, root, vector): windows, with what is known of graph, refined until few entries of cosine near or more are new."""
    start = windows(nodes, k, trees, seed)
    graph = cut(nearest(start if graph is None else start.union(graph), k))
    for round_ in range(ROUNDS):
        old, graph = graph, cut(refine(graph, nodes, k, seed + round_))
        both = old.select("node", "other", F.lit(1).alias("was"), F.col("sim")).union(graph.select("node", "other", F.lit(0), "sim")).where(F.col("sim") >= near)
        new = both.groupBy("node", "other").agg(F.max("was").alias("was")).agg(F.count_if(F.col("was") == 0).alias("new"), F.count("*").alias("all")).first()
        if round_ and new["new"] <= SETTLED * new["all"]:
            break
    return graph


def blocked(members: DataFrame, key: str) -> DataFrame:
    """Adds blocks, how many a key's rows are dealt into, and block: of at most about BLOCK rows, and fewer where that makes enough of them to share the work."""
    n = F.count("*")
    sizes = members.groupBy(key).agg(F.greatest(F.ceil(n / BLOCK), F.least(F.lit(8), F.ceil(n / 64))).cast("int").alias("blocks"))
    return spread_join(members, cut(sizes), key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def block_links(members: DataFrame, threshold: float) -> DataFrame:
    """members (node, root, weight, vector), a cut() table: how many links each node has within its root's component, weights counted.

    A component's rows are dealt into blocks; each pair of blocks is compared in one go and gives one count a row, never
    its pairs. A pair of blocks is the largest group.
    """
    met = blocked(members, "root").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "weight", "vector")

    def count(table: pa.Table) -> pa.Table:
        node, weight, block = (np.asarray(table[c]) for c in ("node", "weight", "block"))
        rows, left = matrix(table["vector"].combine_chunks()), block == table["i"][0].as_py()
        if table["i"][0] == table["j"][0]:
            linked = rows @ rows.T >= threshold
            np.fill_diagonal(linked, False)
            return pa.table({"node": node, "n": linked.sum(axis=1), "w": (linked @ weight).astype(np.int64)})
        linked = rows[left] @ rows[~left].T >= threshold
        both = [(linked.sum(axis=1), linked @ weight[~left]), (linked.sum(axis=0), weight[left] @ linked)]
        return pa.table({"node": np.concatenate([node[left], node[~left]]), "n": np.concatenate([n for n, _ in both]), "w": np.concatenate([w for _, w in both]).astype(np.int64)})

    return met.groupBy("root", "i", "j").applyInArrow(count, "node long, n long, w long").groupBy("node").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of some True cells of a matrix, enough of them that rows and columns that are connected stay so; fewer than its rows and columns."""
    fresh_rows, fresh_cols, out = linked.any(axis=1), linked.any(axis=0), []
    for start in np.flatnonzero(fresh_rows):
        if not fresh_rows[start]:
            continue
        fresh_rows[start], todo = False, [(start, True)]
        while todo:
            x, is_row = todo.pop()
            new = np.flatnonzero(linked[x] & fresh_cols if is_row else linked[:, x] & fresh_rows)
            (fresh_cols if is_row else fresh_rows)[new] = False
            out += [(x, y) if is_row else (y, x) for y in new]
            todo += [(y, not is_row) for y in new]
    found = np.array(out, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def balls(graph: DataFrame, full: DataFrame) -> DataFrame:
    """node, pivot, sim (their cosine) of the nodes of full, whose lists are saturated: the pivot is the smallest such node in the list, the node included."""
    inner = graph.join(full, "node").join(full.withColumnRenamed("node", "other"), "other", "left_semi")
    least = inner.groupBy("node").agg(F.min(F.struct(F.col("other").alias("pivot"), "sim")).alias("m"))
    moves = F.coalesce(F.col("m.pivot") < F.col("node"), F.lit(False))
    return full.join(least, "node", "left").select("node", F.when(moves, F.col("m.pivot")).otherwise(F.col("node")).alias("pivot"), F.when(moves, F.col("m.sim")).otherwise(1.0).alias("sim"))


def bridges(members: DataFrame, roots: DataFrame, vectors: DataFrame, threshold: float, k: int, trees: int, seed: int) -> DataFrame:
    """Links (a, b) between members (node, pivot, sim) of balls of different roots, as far as a descent among the pivots finds them near.

    By the triangle inequality of angles, balls can hold a link only if their pivots are no farther apart than the
    threshold's angle and both balls' own. Members of such balls are compared in blocks, which give enough links to
    connect what they connect.
    """
    sizes = cut(members.groupBy("pivot").agg(F.min("sim").alias("low")))
    pivots = sizes.select(F.col("pivot").alias("node"), "low").join(roots, "node").join(vectors.select("node", "vector"), "node")
    pivots = cut(pivots.select("node", "root", "low", "vector"))
    near = descend(pivots, k, trees, seed, 2 * threshold**2 - 1)
    angle = lambda c: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))
    lows = pivots.select("node", "low")
    ends = near.join(lows.withColumnRenamed("low", "low_a"), "node")
    ends = spread_join(cut(ends), lows.withColumnRenamed("node", "other"), "other")
    reach = angle(F.col("low_a")) + angle(F.col("low")) + F.acos(F.lit(threshold)) + 1e-6
    pairs = cut(ends.where(angle(F.col("sim")) <= reach).select(F.least("node", "other").alias("p"), F.greatest("node", "other").alias("q")).distinct())
    if pairs.isEmpty():
        return pairs.select(F.col("p").alias("a"), F.col("q").alias("b"))
    dealt = blocked(cut(members.select(F.col("pivot").alias("root"), "node")), "root")
    counts = dealt.select(F.col("root").alias("p"), F.col("blocks").alias("np")).distinct()
    pairs = pairs.join(counts, "p").join(counts.withColumnsRenamed({"p": "q", "np": "nq"}), "q")
    dealt = cut(dealt.join(vectors.select("node", "vector"), "node"))
    side = lambda own, part, other, n, asks: pairs.join(dealt.select(F.col("root").alias(own), F.col("block").alias(part), "node", "vector"), own).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).select("p", "pp", "q", "qq", F.lit(asks).alias("asks"), "node", "vector")

    def link(table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"].combine_chunks().to_numpy(zero_copy_only=False))
        node, rows = np.asarray(table["node"]), matrix(table["vector"].combine_chunks())
        i, j = forest(rows[asks] @ rows[~asks].T >= threshold)
        return pa.table({"a": node[asks][i], "b": node[~asks][j]})

    met = side("p", "pp", "qq", "nq", True).union(side("q", "qq", "pp", "np", False))
    return met.groupBy("p", "pp", "q", "qq").applyInArrow(link, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def true_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """node, t: how many links each sample vector has, by comparing it with all others. The sample is all vectors whose id SHARE divides, or where these are fewer than FEWEST, as many, the first by a hash.

    The sample is broadcast in as many passes as its bytes ask for; a task compares AUDITED of it at a time.
    """
    spark, hashed = vectors.sparkSession, vectors.select("node", "vector", "first", F.xxhash64("node", F.lit(11)).alias("h"))
    asked = cut(hashed.where(F.col("first") % SHARE == 0))
    if asked.count() < FEWEST:
        asked = cut(hashed.orderBy("h").limit(FEWEST))
    row = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")).first()
    passes, truth = max(1, -(-row["n"] * 8 * (row["size"] or 1) // PASS_BYTES)), None

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = shared.value
        counts = np.zeros(len(ids), np.int64)
        for batch in batches:
            node, own = np.asarray(batch.column(0)), matrix(batch.column(1))
            for lo in range(0, len(ids), AUDITED):
                some = slice(lo, lo + AUDITED)
                counts[some] += ((own @ rows[some].T >= threshold) & (node[:, None] != ids[None, some])).sum(axis=0)
        held = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[held], pa.int64()), pa.array(counts[held], pa.int64())], names=["node", "t"])

    for part in range(passes):
        block = asked.where(F.pmod(F.xxhash64("node", F.lit(12)), F.lit(passes)) == part).select("node", "vector").toArrow()
        if not block.num_rows:
            continue
        shared = spark.sparkContext.broadcast((np.asarray(block["node"]), matrix(block["vector"].combine_chunks())))
        found = cut(vectors.select("node", "vector").mapInArrow(ask, "node long, t long").groupBy("node").agg(F.sum("t").alias("t")))
        truth = found if truth is None else truth.union(found)
    return truth if truth is not None else spark.createDataFrame([], "node long, t long")


def audit(found: DataFrame, truth: DataFrame) -> float | None:
    """Recall of the links of truth (node, t: how many a sample vector has); None, unproved, if it has none. found (node, n): the number of distinct vectors linked to each node."""
    row = truth.join(found, "node", "left").agg(F.sum("t").alias("t"), F.sum(F.least("t", F.coalesce("n", F.lit(0)))).alias("n")).first()
    return row["n"] / row["t"] if row["t"] else None


class Linked(NamedTuple):
    """roots (node, root) of nodes with a link; plain (a, b), links of components without saturated lists; members (node, root, weight, vector) of the others."""

    roots: DataFrame
    plain: DataFrame
    members: DataFrame


def link(graph: DataFrame, vectors: DataFrame, threshold: float, k: int, trees: int, seed: int) -> Linked:
    """Components of the links of a settled graph, those of saturated lists joined by bridges until no more are found."""
    near = graph.where(F.col("sim") >= threshold).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    links = cut(near.distinct())
    roots = components(links)
    full = cut(graph.groupBy("node").agg(F.count("*").alias("n"), F.min("sim").alias("floor")).where((F.col("n") >= k) & (F.col("floor") >= threshold)).select("node"))
    if not full.isEmpty():
        members = cut(balls(graph, full))
        while not (found := cut(bridges(members, roots, vectors, threshold, k, trees, seed))).isEmpty():
            links = cut(links.union(found).distinct())
            roots, seed = components(links), seed + ROUNDS
    large = cut(roots.join(full, "node", "left_semi").select("root", F.lit(True).alias("large")).distinct())
    flagged = cut(spread_join(roots, large, "root", "left"))
    members = cut(flagged.where("large").select("node", "root").join(vectors.select("node", "weight", "vector"), "node"))
    plain = links.join(flagged.where("large is null").select(F.col("node").alias("a")), "a", "left_semi")
    return Linked(roots, cut(plain.select("a", "b")), members)


def all_links(vectors: DataFrame, threshold: float) -> Linked:
    """All links of vectors (node, weight, vector), by comparing all blocks of rows with one another: the exact way, whose work grows with the square of the rows."""
    members = cut(vectors.select("node", F.lit(0).cast("long").alias("root"), "weight", "vector"))
    met = blocked(members, "root").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "vector")

    def join(table: pa.Table) -> pa.Table:
        node, rows, left = np.asarray(table["node"]), matrix(table["vector"].combine_chunks()), np.asarray(table["block"]) == table["i"][0].as_py()
        right = ~left if table["i"][0] != table["j"][0] else left
        i, j = forest(rows[left] @ rows[right].T >= threshold)
        return pa.table({"a": node[left][i], "b": node[right][j]})

    found = met.groupBy("i", "j").applyInArrow(join, "a long, b long").where("a <> b")
    roots = components(cut(found))
    return Linked(roots, found.limit(0), members)


def near_vectors(embeddings: DataFrame, threshold: float = 0.95, k: int = 12, trees: int = 4, min_recall: float = 0.98, max_doublings: int = 4) -> DataFrame:
    """Link the rows of embeddings (vec_id, embedding) by cosine.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included),
    kept (vec_id is its component's smallest). A vector that is null, empty, zero or holds null or non-finite numbers
    links with nothing; vectors of different lengths don't link. Rows with equal vectors are compared once
    and counted each; repeated ids stay repeated, and all of them that equal the component's smallest are kept. A null
    vec_id is never kept; component_id is null where all ids are. Other columns are not read. An empty table gives no rows.
    min_recall is asked of the audit, whose links are not added to the result; the recall is logged. Below it, lists of
    k are made twice as long, max_doublings times at most; if it is then still too low, all rows are compared with one
    another, in blocks.
    """
    value = F.col("embedding") if dict(embeddings.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    fine = value.isNotNull() & (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = embeddings.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), value).alias("vector"))
    rows = cut(rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))))
    alone = F.col("vec_id").isNotNull()
    out = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), alone.alias("kept"))
    sizes = rows.where("node is not null").select(F.size("vector").alias("size")).distinct().collect()  # one row a length
    for size in sorted(x["size"] for x in sizes):
        out = out.union(near_of_one_length(rows.where(F.size("vector") == size), threshold, k, trees, min_recall, max_doublings))
    return out


def near_of_one_length(rows: DataFrame, threshold: float, k: int, trees: int, min_recall: float, max_doublings: int) -> DataFrame:
    """near_vectors() of rows (vec_id, vector, node), whose vectors have one length and are fit to compare."""
    vectors = cut(rows.groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("first")))
    truth, graph = true_links(vectors, threshold), None
    nodes = vectors.select("node", F.col("node").alias("root"), "vector")
    for doubling in range(max_doublings + 1):
        graph = descend(nodes, k, trees, 100 * doubling, threshold, graph)
        linked = link(graph, vectors, threshold, k, trees, 100 * doubling + 50)
        both = linked.plain.union(linked.plain.select("b", "a")).join(vectors.select(F.col("node").alias("b"), "weight"), "b")
        plain = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
        counts = cut(plain.union(block_links(linked.members, threshold)))
        recall = audit(counts, truth)
        log.info("vectors of length %s, lists of %s: recall of links %s", vectors.select(F.size("vector")).first()[0], k, recall)
        if recall is None or recall >= min_recall:
            break
        k *= 2
    else:
        log.warning("recall of links is %s with lists of %s, below %s: all rows are compared", recall, k // 2, min_recall)
        linked = all_links(vectors, threshold)
        counts = cut(block_links(linked.members, threshold))
    placed = vectors.select("node", "weight", "first").join(linked.roots, "node", "left").join(counts.select("node", "w"), "node", "left")
    placed = cut(placed.select("node", "weight", "first", F.coalesce("root", "node").alias("root"), F.coalesce("w", F.lit(0)).alias("w")))
    named = cut(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    placed = cut(spread_join(placed, named, "root").select("node", (F.col("w") + F.col("weight") - 1).alias("n_links"), "component_id"))
    out = spread_join(rows.select("vec_id", "node"), placed, "node")
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
