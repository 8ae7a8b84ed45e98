"""Token ids in Simple-8b blocks.

A 64-bit word holds a selector in its top 4 bits and, below it, as many ids as fit at the selector's width: of the
words that could come next, the one that holds most ids is taken. An id of over 60 bits is escaped: a word with the
escape selector, then the id in a word of its own. A block holds whole documents: their ids and lengths, its packed
words, and for about every SPAN words the place of a word and the number of ids before it, from which a reader decodes
any span by itself: read_documents() decodes only the spans that hold the documents it is asked for. A reader decodes
all words of one selector at a time, with array operations.

Blocks lie in Parquet files, ordered by document: Spark's committer makes the files appear whole or not at all, on any
file system that Spark reads, and a task that is lost is written again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, cut
from .tokenization import encoder

#: Fixed values of the format: by selector, how many ids a word holds, and of how many bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
SPAN = 256  # words
BLOCK_IDS = 1 << 16  # a block is closed once it holds so many ids


def pack_words(ids: np.ndarray) -> np.ndarray:
    """ids: unsigned 64-bit. Returns unsigned 64-bit words."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    choice = np.full(n, len(COUNTS), np.int8)  # what no selector holds is escaped
    top, at = int(ids.max()), np.arange(n, dtype=np.int32)
    narrow = ids.astype(np.uint32) if top >> 32 == 0 else ids
    for s in range(len(COUNTS) - 1, -1, -1):  # narrower selectors hold more and so come last
        if top >> WIDTHS[s]:
            ends = np.append(np.flatnonzero(narrow >> narrow.dtype.type(WIDTHS[s])), n)  # each ends a run of ids that are narrow enough
            begins = np.append(0, ends[:-1] + 1)
            # Words may begin where a run still has as many ids as the selector holds, and anywhere in a last run of fewer.
            counts = ends - begins - COUNTS[s] + 1
            counts[-1] = ends[-1] - begins[-1]
            held = counts > 0
            if not held.any():
                break  # nor do the narrower ones hold any id
            begins, counts = begins[held], counts[held]
            choice[np.repeat(begins - np.cumsum(counts) + counts, counts) + at[: counts.sum()]] = s
        else:
            choice[:] = s
    steps = np.array([*COUNTS, 1])[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    picked = choice[starts]
    size = 1 + (picked == len(COUNTS))
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(picked).tolist():
        rows = np.flatnonzero(picked == s)
        if s == len(COUNTS):
            words[where[rows]] = np.uint64(ESCAPE) << np.uint64(60)
            words[where[rows] + 1] = ids[starts[rows]]
            continue
        word = np.full(len(rows), np.uint64(s) << np.uint64(60))
        for k in range(COUNTS[s]):
            word |= padded[starts[rows] + k] << np.uint64(k * WIDTHS[s])
        words[where[rows]] = word
    return words


def word_counts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each of a row of words holds, of which the first isn't an escaped id; and which words are escaped ids."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw, i = np.zeros(len(words), bool), 0
    for e in np.flatnonzero(selector == ESCAPE).tolist():  # an escaped id may look like any word
        if e >= i:
            raw[e + 1] = True
            i = e + 2
    counts = np.array([*COUNTS, 0, 0])[selector]
    counts[raw] = 1
    return counts, raw


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of packed words that start at a word's begin (not at an escaped id)."""
    counts, raw = word_counts(words)
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    begin = ends - counts
    selector = np.where(raw, ESCAPE, (words >> np.uint64(60)).astype(np.int64))
    for s in np.unique(selector).tolist():
        if s == ESCAPE:
            continue
        rows = np.flatnonzero(selector == s)
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            out[begin[rows] + k] = (words[rows] >> np.uint64(k * WIDTHS[s])) & mask
    out[begin[raw]] = words[raw]
    return out[:n]


def span_offsets(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each span: the place of its first word, every SPAN words or one after that where it is an escaped id, and the number of ids before it."""
    counts, raw = word_counts(words)
    places = np.arange(0, len(words), SPAN)
    places += raw[places]
    places = places[places < len(words)]
    return places, (np.cumsum(counts) - counts)[places]


def decode_range(words: np.ndarray, places: np.ndarray, before: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start to stop (exclusive) of a block, from the spans that hold them alone."""
    if stop <= start:
        return np.zeros(0, np.uint64)
    lo = int(np.searchsorted(before, start, side="right")) - 1
    hi = int(np.searchsorted(before, stop, side="left"))
    own = words[places[lo] : places[hi] if hi < len(places) else len(words)]
    return unpack_words(own, stop - int(before[lo]))[start - int(before[lo]) :]


BLOCK_SCHEMA = "shard int, block int, first_id long, n_ids long, doc_ids array<long>, doc_lengths array<long>, span_places array<long>, span_ids array<long>, words binary"


def write_token_file(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, partitions: int | None = None) -> None:
    """Encode documents (doc_id, text) with an end id each, and write them to path in ascending doc_id order.

    Shards are ranges of doc_id in ascending order (null first; equal ids by a hash of their text, then by text). Null or empty text: end_id alone.
    Other columns are not read. An empty table gives a file set without blocks.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, shard = encoder(tokenizer, False), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        ids: list[int] = []
        parts: list[bytes] = []
        held = first = block = 0

        def close() -> pa.RecordBatch:
            joined = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
            words = pack_words(joined)
            rows = [[shard], [block], [first], [len(joined)], [ids], [[len(p) // 4 for p in parts]], *([x.tolist()] for x in span_offsets(words)), [words.astype("<u8").tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc, own in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    ids.append(doc)
                    parts.append(own + end)
                    held += len(own) // 4 + 1
                    if held >= BLOCK_IDS:
                        yield close()
                        first, held, block, ids, parts = first + held, 0, block + 1, [], []
        if ids:
            yield close()

    order = (F.col("doc_id").asc_nulls_first(), F.col("tie"))  # a hash: range bounds go to the driver
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32, decoded from the file's words."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row a shard: their number is that of the writer's partitions, whatever the data.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_words(np.frombuffer(row["words"], "<u8"), row["n_ids"]).astype("<u4")
                ends = np.cumsum(row["doc_lengths"])
                starts = ends - row["doc_lengths"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                shift = row["first_id"] + row["base"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + shift), pa.array(row["doc_lengths"], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.drop("span_places", "span_ids", "block").join(broadcast_if_small(cut(base)), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids (array of longs, with the end id) of some documents of a file, decoded from the spans that hold them. Repeated ids give a row each; those that the file lacks give none."""
    wanted = F.array(*(F.lit(i).cast("long") for i in doc_ids))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).where(F.arrays_overlap("doc_ids", wanted))
    some = frozenset(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends, spans = np.cumsum(row["doc_lengths"]), [np.array(row[c]) for c in ("span_places", "span_ids")]
                words = np.frombuffer(row["words"], "<u8")
                found = [(doc, decode_range(words, *spans, int(end) - n, int(end)).astype(np.int64)) for doc, n, end in zip(row["doc_ids"], row["doc_lengths"], ends) if doc in some]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return blocks.select("doc_ids", "doc_lengths", "span_places", "span_ids", "words").mapInArrow(run, "doc_id long, ids array<long>")
