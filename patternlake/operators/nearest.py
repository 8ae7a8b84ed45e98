"""Exact search for the nearest vectors of a stated set of queries, by products of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

PASS_BYTES = 64 << 20  # of queries that are broadcast at a time
ROWS = 8192  # vectors that a task compares at a time
DIGITS = 6  # decimals of a cosine; of equal ones the smaller id is nearer
FAR = np.iinfo(np.int64).min


def unit_rows(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of a size at length 1, a row each; zeros for null ones, those of other sizes, those that are shorter than 1e-10, and those that aren't finite."""
    sizes, out = np.diff(np.asarray(column.offsets)), np.zeros((len(column), size))
    good = (sizes == size) & np.asarray(column.is_valid())
    flat = np.array(column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(int(good.sum()), size)
    norms = np.linalg.norm(flat, axis=1)
    fit = np.isfinite(norms) & (norms > 1e-10)
    flat[fit] /= norms[fit, None]
    flat[~fit] = 0
    out[good] = flat
    return out


def groups(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Places of rows by the nearest of about as many pivots as a root of their number, which are rows."""
    n = max(1, int(len(rows) ** 0.5) // 2)
    own = (rows @ rows[:: max(1, len(rows) // n)].T).argmax(axis=1)
    order = np.argsort(own, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(own[order])) + 1)


class Best:
    """The k best so far of each of some queries (rows of length 1 or 0): their ids and cosines in units of the last decimal."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k, self.compared = queries, k, 0
        self.ids, self.sims = np.full((len(queries), k), FAR), np.full((len(queries), k), FAR)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Compare rows with the queries whose k-th best a row might reach: by the angles to a group's centre and of the group about it, none of the others can."""
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        for at in groups(rows):
            some, centre = rows[at], rows[at].sum(axis=0)
            size, asks = np.linalg.norm(centre), np.arange(len(self.queries))
            full = self.sims[:, -1] > FAR
            if size > 1e-9 and full.all() and np.abs(some).sum(axis=1).min() > 0:
                angle = lambda x: np.arccos(np.clip(x, -1, 1))
                nearest = np.maximum(0, angle(self.queries @ (centre / size)) - angle(some @ (centre / size)).max())
                asks = np.flatnonzero(np.cos(nearest) >= self.sims[:, -1] / 10**DIGITS - 2 * 10.0**-DIGITS)
            for lo in range(0, len(asks), 2048):
                self._take(asks[lo : lo + 2048], ids[at], some)

    def _take(self, asks: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(asks):
            return
        sims = np.round((self.queries[asks] @ rows.T) * 10**DIGITS).astype(np.int64)
        self.compared += sims.size
        if sims.shape[1] > self.k:  # of equal cosines the first by id, as ids ascend
            near = np.argpartition((2 * 10**DIGITS - sims) * sims.shape[1] + np.arange(sims.shape[1]), self.k - 1, axis=1)[:, : self.k]
            sims, ids = np.take_along_axis(sims, near, 1), ids[near]
        else:
            ids = np.broadcast_to(ids, sims.shape)
        both, known = np.concatenate([self.sims[asks], sims], axis=1), np.concatenate([self.ids[asks], ids], axis=1)
        order = np.argsort(known, axis=1, kind="stable")
        both, known = np.take_along_axis(both, order, 1), np.take_along_axis(known, order, 1)
        order = np.argsort(-both.astype(np.float64), axis=1, kind="stable")[:, : self.k]
        self.sims[asks], self.ids[asks] = np.take_along_axis(both, order, 1), np.take_along_axis(known, order, 1)


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """queries (query_id, q), a stated set, against all vectors (id, v); query_id, id, sim, place of the k best by cosine (6 decimals), then id.

    Queries are broadcast, in as many passes as their bytes ask for; each task keeps its own k best of each query, block
    by block, and the tasks' best are merged. A null vector or one without length has a cosine of 0 with all, and so
    have vectors of different lengths. ids are longs. Empty tables give no rows.
    """
    spark = queries.sparkSession
    asked = cut(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q")))
    bytes_ = asked.agg(F.sum(8 * F.greatest(F.size("q"), F.lit(0)) + 16).alias("n")).first()["n"] or 0
    passes, out = max(1, -(-bytes_ // pass_bytes)), None
    own = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(ids, Best(rows, k)) for ids, rows in shared.value]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids = np.asarray(part.column(0), np.int64)
                column = pa.concat_arrays([part.column(1)])
                for _, b in best:
                    b.add(ids, unit_rows(column, b.queries.shape[1]))
        for asks, b in best:
            held = b.sims > FAR
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asks, held.sum(axis=1))), pa.array(b.ids[held]), pa.array(b.sims[held] / 10**DIGITS)], names=["query_id", "id", "sim"])

    for n in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n).toArrow()
        if not rows.num_rows:
            continue
        column = rows["q"].combine_chunks()
        sizes = np.where(np.asarray(column.is_valid()), np.asarray(column.value_lengths().fill_null(0)), 0)
        ids = np.asarray(rows["query_id"])
        shared = spark.sparkContext.broadcast([(ids[sizes == s], unit_rows(pa.concat_arrays([column.filter(pa.array(sizes == s))]), int(s))) for s in np.unique(sizes)])
        found = own.mapInArrow(scan, "query_id long, id long, sim double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "id"))  # k rows of each task
        best = cut(found.withColumn("place", place).where(F.col("place") <= k))
        out = best if out is None else out.union(best)
    return spark.createDataFrame([], "query_id long, id long, sim double, place int") if out is None else out
