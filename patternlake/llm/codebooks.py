"""Compression of vectors to codes by product quantisation, whose codebooks are refined by Heap Lloyd.

Vectors are cut into parts; each part position has a codebook of integer entries. Rows lie in blocks, and a block keeps
for each entry of each position a heap of its assigned parts, keyed by their slack: the lower bound of the distance to
any other entry minus the upper bound of that to their own. When entries move, the slack of an entry's parts shrinks by
at most its drift and the greatest drift of the others. That sum is kept for each entry, not for each part; parts are
keyed by slack plus the sum when they came. A round pops only those whose key the sum has reached, compares them exactly
with all entries, and pushes them again. The others are not looked at: their nearest entry is proven.

Blocks and heaps are two bucketed tables, so a round joins them without moving a vector; it writes heaps and counts
alone. All that goes to the driver are sums by position, entry and component.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_path, spread_join

SCALE = 4096  # a component's unit
BLOCK_BYTES = 1 << 20  # of a block's integers
LIMIT = 1 << 28  # integers stay below, so that squared distances fit 64 bits
MARGIN = 1e-6  # of slack, above the rounding of roots and sums
BLOCK = "block long, ids array<long>, labels array<long>, ints binary"
STATE = "block long, codes binary, sizes array<int>, rows binary, keys binary, sums array<long>, counts array<long>, looked long"


def bounds(size: int, parts: int) -> list[int]:
    """Where parts of a vector begin and end: equal ones, or such that differ by one."""
    return [i * size // parts for i in range(parts + 1)]


def distances(own: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts (rows) to entries, exact."""
    out = np.zeros((len(own), len(book)), np.int64)
    for j in range(own.shape[1]):
        out += (own[:, j, None] - book[None, :, j]) ** 2
    return out


def nearest(own: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part its nearest entry, the first of equals, its squared distance, and the slack up to the second nearest."""
    d = distances(own, book)
    code = d.argmin(axis=1)
    best = d[np.arange(len(d)), code]
    if len(book) == 1:
        return code, best, np.full(len(d), np.inf)
    d[np.arange(len(d)), code] = np.iinfo(np.int64).max
    return code, best, np.sqrt(d.min(axis=1)) - np.sqrt(best)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By entry, how much the slack of its parts may shrink: its own move and the longest of the others."""
    moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1))
    others = np.array([max(np.delete(moved, i), default=0.0) for i in range(len(moved))])
    return moved + others


class Position:
    """Heaps of one block's parts at one position, an entry each, with the sums and counts of the parts."""

    def __init__(self, own: np.ndarray, entries: int):
        self.own, self.codes = own, np.zeros(len(own), np.int64)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(entries)]
        self.sums, self.counts, self.looked = np.zeros((entries, own.shape[1]), np.int64), np.zeros(entries, np.int64), 0

    def place(self, rows: np.ndarray, book: np.ndarray, drift: np.ndarray) -> None:
        """Compare rows with all entries and push each to the heap of its nearest."""
        code, _, slack = nearest(self.own[rows], book)
        self.codes[rows] = code
        np.add.at(self.sums, code, self.own[rows])
        np.add.at(self.counts, code, 1)
        keys = (slack + drift[code]).tolist()
        for c, key, row in zip(code.tolist(), keys, rows.tolist()):
            heapq.heappush(self.heaps[c], (key, row))
        self.looked += len(rows)

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """Pop the rows whose slack may be used up; ties of distances are never within proven slack."""
        out: list[int] = []
        for c, heap in enumerate(self.heaps):
            limit = drift[c] + MARGIN * (1 + drift[c])
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        rows = np.array(out, np.int64)
        np.subtract.at(self.sums, self.codes[rows], self.own[rows])
        np.subtract.at(self.counts, self.codes[rows], 1)
        return rows


def stored(block: int, positions: list[Position]) -> pa.RecordBatch:
    heaps = [h for p in positions for h in p.heaps]
    flat = [x for h in heaps for x in h]
    cols = [
        [block], [np.stack([p.codes for p in positions]).astype(np.uint8).tobytes()], [[len(h) for h in heaps]], [np.array([r for _, r in flat], "<i4").tobytes()], [np.array([k for k, _ in flat], "<f8").tobytes()],
        [np.concatenate([p.sums.ravel() for p in positions]).tolist()], [np.concatenate([p.counts for p in positions]).tolist()], [sum(p.looked for p in positions)],
    ]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in STATE.split(", ")])


def restored(row: dict, own: list[np.ndarray], entries: int) -> list[Position]:
    """What stored() wrote: a heap stays one."""
    keys, rows, at, summed, out = np.frombuffer(row["keys"], "<f8").tolist(), np.frombuffer(row["rows"], "<i4").tolist(), 0, 0, []
    codes = np.frombuffer(row["codes"], np.uint8).reshape(len(own), -1).astype(np.int64)
    for i, part in enumerate(own):
        p = Position(part, entries)
        p.codes = codes[i].copy()
        for c, size in enumerate(row["sizes"][i * entries : (i + 1) * entries]):
            p.heaps[c] = list(zip(keys[at : at + size], rows[at : at + size]))
            at += size
        p.sums = np.array(row["sums"][summed : summed + p.sums.size], np.int64).reshape(p.sums.shape)
        summed += p.sums.size
        p.counts = np.array(row["counts"][i * entries : (i + 1) * entries], np.int64)
        out.append(p)
    return out


def split(ints: bytes, n: int, cuts: list[int]) -> list[np.ndarray]:
    """A block's parts by position."""
    rows = np.frombuffer(ints, "<i4").reshape(n, -1).astype(np.int64)
    return [np.ascontiguousarray(rows[:, a:b]) for a, b in zip(cuts, cuts[1:])]


def integers(column: pa.Array) -> np.ndarray:
    """Components as integers, rounded down; an error where their squares wouldn't fit."""
    flat = np.floor(np.asarray(column.flatten(), np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() >= LIMIT:
        raise ValueError(f"components must be below {LIMIT // SCALE} in size")
    return flat.astype(np.int64).reshape(len(column), -1)


def fine_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector of the rows whose vector has no null or non-finite component."""
    value = F.col("embedding") if dict(embeddings.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    fine = value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), value.alias("vector"))


def compress(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """Codes of the rows of embeddings (vec_id, embedding, label).

    Returns vec_id, code (the index of each part's entry, two hexadecimal digits each), error (squared distances to these
    entries, summed), label_error (error summed over equal labels, nulls together) and codebooks_sha256 (of all final
    entries' components by part, entry and place, as decimals joined by commas).

    Components count as floor(4096 x). A codebook starts as the parts of the vectors of the smallest ids (null last; of
    equal ids the smallest vectors); there are fewer entries where there are fewer rows. Each round takes every part to
    the nearest entry, the first of equals, then entries to the mean of their parts, rounded down; unused ones stay.

    Rows whose vector is null or has a null or non-finite component are left out; components of 65 536 or more are an
    error. Vectors of each length have codebooks of their own; where parts doesn't divide the length, parts differ by
    one, and empty vectors have empty parts. Repeated rows give a row each. Other columns are not read. An empty table
    gives no rows.
    """
    rows = cut(fine_rows(embeddings))
    sizes = sorted(x["size"] for x in rows.select(F.size("vector").alias("size")).distinct().collect())  # one row a length
    out = None
    for size in sizes:
        own = coded(rows.where(F.size("vector") == size), size, parts, min(entries, 256), rounds)
        out = own if out is None else out.union(own)
    if out is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    out = cut(out.withColumn("key", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label"))))
    sums = cut(out.groupBy("key").agg(F.sum("error").alias("label_error")))
    return spread_join(out, sums, "key").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def coded(rows: DataFrame, size: int, parts: int, entries: int, rounds: int) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of rows (vec_id, label, vector), vectors of one size."""
    spark, cuts, names = rows.sparkSession, bounds(size, parts), []
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()  # a codebook's entries
    start = np.floor(np.array([x["vector"] for x in first], np.float64).reshape(len(first), size) * SCALE).astype(np.int64)
    books = [start[:, a:b].copy() for a, b in zip(cuts, cuts[1:])]
    k, held = len(start), max(1, BLOCK_BYTES // (4 * max(1, size)))

    def saved(df: DataFrame, name: str) -> DataFrame:
        """df as a table of n buckets by block, in the shared folder."""
        names.append(table := f"patternlake_{name}_{uuid.uuid4().hex}")
        df.repartition(n, "block").write.bucketBy(n, "block").sortBy("block").option("path", shared_path(spark, name)).saveAsTable(table)
        return spark.table(table)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, held):
                ids, labels, vectors = batch.slice(lo, held).columns
                made = [[(task << 32) + nth], [ids.to_pylist()], [labels.to_pylist()], [integers(vectors).astype("<i4").tobytes()]]
                nth += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["block", "ids", "labels", "ints"])

    blocks = saved(rows.mapInArrow(block, BLOCK), "blocks")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, ids, ints in zip(*(c.to_pylist() for c in batch.columns)):
                positions = [Position(own, k) for own in split(ints, len(ids), cuts)]
                for p, book in zip(positions, books):
                    p.place(np.arange(len(ids)), book, np.zeros(k))
                yield stored(b, positions)

    def moved(drift: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    positions = restored(row, split(row["ints"], len(row["ids"]), cuts), k)
                    for p, book, d in zip(positions, books, drift):
                        p.place(p.violated(d), book, d)
                    yield stored(row["block"], positions)

        return run

    def means(state: DataFrame) -> list[np.ndarray]:
        """The codebooks that the sums of all blocks give."""
        total = lambda c: state.select(F.posexplode(c)).groupBy("pos").agg(F.sum("col").alias("x")).orderBy("pos").toPandas()["x"].to_numpy(np.int64)  # noqa: E731: k sums a component
        sums, counts, out, at = total("sums"), total("counts").reshape(parts, k), [], 0
        for i, book in enumerate(books):
            own = sums[at : at + book.size].reshape(book.shape)
            at += book.size
            out.append(np.where(counts[i][:, None] > 0, own // np.maximum(counts[i], 1)[:, None], book))
        return out

    state, drift = saved(blocks.select("block", "ids", "ints").mapInArrow(begin, STATE), "heaps"), [np.zeros(k)] * parts
    for _ in range(rounds):
        new = means(state) if size else books
        drift = [d + drifts(a, b) for d, a, b in zip(drift, books, new)]
        books = new
        met = blocks.drop("labels").join(state.hint("merge"), "block")
        state = saved(met.mapInArrow(moved(drift), STATE), "heaps")
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, codes = split(row["ints"], len(row["ids"]), cuts), np.frombuffer(row["codes"], np.uint8).reshape(parts, -1)
                error = sum(((part - book[c]) ** 2).sum(axis=1) for part, book, c in zip(own, books, codes))
                raw = np.ascontiguousarray(codes.T)
                cols = [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.int64()), pa.array([r.tobytes().hex() for r in raw]), pa.array(error, pa.int64()), pa.array([digest] * len(raw))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    out = cut(blocks.join(state.select("block", "codes").hint("merge"), "block").mapInArrow(told, "vec_id long, label long, code string, error long, codebooks_sha256 string"))
    for name in names:  # the catalogue's entries; their files lie in the shared folder
        spark.sql(f"DROP TABLE {name}")
    return out


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB SQL of compress() over `embeddings`, whose vectors have one length that parts divides: every round compares all parts with all entries."""
    near = lambda c: f"SELECT v.r, v.part, arg_min(entry, (list_sum(list_transform(list_zip(v.x, {c}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry)) AS entry, min(list_sum(list_transform(list_zip(v.x, {c}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) AS error FROM v JOIN {c} USING (part) GROUP BY 1, 2"
    steps = "".join(
        f""", a{i} AS MATERIALIZED ({near(f'c{i}')}), m{i} AS (SELECT part, entry, pos, floor(sum(val) / count(*))::BIGINT AS mean FROM (SELECT part, entry, unnest(x) AS val, unnest(range(len(x))) AS pos FROM a{i} JOIN v USING (r, part)) GROUP BY 1, 2, 3),
    c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.x, c{i}.x) AS x FROM c{i} LEFT JOIN (SELECT part, entry, list(mean ORDER BY pos) AS x FROM m{i} GROUP BY 1, 2) n USING (part, entry))"""
        for i in range(rounds)
    )
    return f"""WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
    v AS MATERIALIZED (SELECT r, p AS part, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM e, range({parts}) t(p)),
    c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM v WHERE r <= {entries}){steps}, z AS MATERIALIZED ({near(f'c{rounds}')}),
    h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
    o AS (SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM z GROUP BY 1)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN e USING (r), h"""
