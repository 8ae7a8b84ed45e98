"""Vector bin packing of examples into training sequences.

A sequence has limits on tokens, segments and loss-bearing tokens at once. It is filled by the dot-product heuristic:
of the pieces that fit in every dimension, the one whose sizes line up best with what is left of the sequence
(sum over dimensions of size x rest, each as a share of its limit, weighted by how scarce the dimension is) goes in
next. Work is done where the rows lie: each partition packs its own rows in blocks of bounded size, so nothing is
shuffled, a lost task is recomputed alike, and no task holds more than a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokenization import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
BLOCK = 4096  # pieces packed together


def fill_bins(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of row numbers of sizes (n x dimensions). A row over a limit on its own gets a bin of its own."""
    share = sizes / limits
    scarce = share.mean(axis=0) if len(share) else np.ones(len(limits))
    score, free, bins = share * scarce, np.ones(len(share), bool), []
    alone = (sizes > limits).any(axis=1)
    bins += [[int(i)] for i in np.flatnonzero(alone)]
    free &= ~alone
    order = np.flatnonzero(free)[np.argsort(-score[free].sum(axis=1), kind="stable")]
    while len(order):
        rest, own = limits.astype(float), []
        while len(order):
            fits = np.flatnonzero((sizes[order] <= rest).all(axis=1))
            if not len(fits):
                break
            pick = fits[np.argmax(score[order[fits]] @ (rest / limits))]
            own.append(int(order[pick]))
            rest -= sizes[order[pick]]
            order = np.delete(order, pick)
        bins.append(own)
    return bins


class TextPacker:
    """Packs the pieces of whole documents; a document is cut where that saves padding.

    Every piece of max_tokens ids fills a sequence. What is left of a document is a piece to pack, with its tokens, one
    segment, and its loss-bearing tokens: all but its first, which nothing before it foretells. A piece that fits
    nowhere is cut if at least min_cut ids of it fill up a sequence. What is left at the end goes into sequences whose
    lengths are powers of two, which need no padding. All sequences keep all limits.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss_tokens: int, min_cut: int, base: int):
        self.limits = np.array([max_tokens, max_segments, max_loss_tokens])
        self.room = min(max_tokens, max_loss_tokens + 1)  # a piece of so many ids fills a sequence by itself
        self.min_cut, self.next_id, self.waiting = min_cut, base, []

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, self.next_id, at, n - 1
            at += n
        self.next_id += 1

    def _rest(self, own: list[tuple]) -> int:
        """How many ids one more piece may have in a sequence of own; 0 if it may have none."""
        used = sum(len(p[2]) // 4 for p in own)
        if len(own) >= self.limits[1]:
            return 0
        return int(min(self.limits[0] - used, self.limits[2] - (used - len(own)) + 1))

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """ids: little-endian unsigned 32-bit ids of the document with its end id."""
        room, total = self.room, len(ids) // 4
        whole = total // room * room
        for start in range(0, whole, room):
            yield from self._emit([(doc, start, ids[4 * start : 4 * (start + room)], total)])
        if whole < total:
            self.waiting.append((doc, whole, ids[4 * whole :], total))
        if len(self.waiting) >= BLOCK:
            yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[tuple]:
        """Fills sequences from the pieces that wait. Unless it is the last call, the sequences that stay short wait on."""
        items = self.waiting
        sizes = np.array([[len(p[2]) // 4, 1, len(p[2]) // 4 - 1] for p in items]).reshape(-1, 3)
        bins = [[items[i] for i in b] for b in fill_bins(sizes, self.limits)]
        self.waiting, short = [], []
        bins.sort(key=lambda b: sum(len(p[2]) for p in b))
        while bins:
            own = bins.pop()
            while bins and (rest := self._rest(own)) >= self.min_cut:
                # The emptiest sequence gives a piece; where own may take only one more, one that fills it.
                full = len(own) + 1 >= self.limits[1]
                giver = next((b for b in bins if not full or max(len(p[2]) for p in b) >= 4 * rest), None)
                if giver is None:
                    break
                giver.sort(key=lambda p: len(p[2]))
                doc, start, ids, total = giver.pop()
                own.append((doc, start, ids[: 4 * rest], total))
                if len(ids) > 4 * rest:
                    giver.append((doc, start + rest, ids[4 * rest :], total))
                if not giver:
                    bins.remove(giver)
            if self.limits[0] - sum(len(p[2]) // 4 for p in own) < self.min_cut:
                yield from self._emit(own)
            else:
                short += own
        if not last:
            self.waiting = short
            return
        short.sort(key=lambda p: len(p[2]))
        while short:
            reach = short[-int(self.limits[1]) :]
            tokens = sum(len(p[2]) // 4 for p in reach)
            length = 1 << min(tokens, int(self.limits[0]), int(self.limits[2]) + 1).bit_length() - 1
            own, rest = [], length
            while rest:
                doc, start, ids, total = short.pop()
                own.append((doc, start, ids[: 4 * rest], total))
                if len(ids) > 4 * rest:
                    short.append((doc, start + rest, ids[4 * rest :], total))
                    short.sort(key=lambda p: len(p[2]))
                rest -= len(own[-1][2]) // 4
            yield from self._emit(own)


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, max_tokens: int = 2048, max_segments: int = 12, max_loss_tokens: int = 2047, min_cut: int = 16) -> DataFrame:
    """Tokenise documents (doc_id, text) and pack all their ids into sequences.

    A row is a piece: doc_id, start (ids of its document before it), length, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers), doc_tokens (ids of the document with end_id), sequence_id, offset (in the sequence,
    gapless from 0), loss_tokens (all of a piece's but the first). A sequence holds at most max_tokens ids, max_segments
    pieces and max_loss_tokens loss-bearing ids. Null or empty text: end_id alone. A null doc_id is kept as null;
    repeated rows are packed once each, and of pieces that fit alike the first goes in. Other columns are not read. An
    empty table gives no rows.
    """
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, True), int(end_id).to_bytes(4, "little")
        packer = TextPacker(max_tokens, max_segments, max_loss_tokens, min_cut, TaskContext.get().partitionId() << 38)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                        yield from packer.add(doc, ids + end)
            yield from packer.pack(last=True)

        out: list[tuple] = []
        for row in rows():
            out.append(row)
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, max_tokens: int, max_segments: int, max_loss_tokens: int) -> DataFrame:
    """Pack uncut examples (example_id long, n_tokens, n_segments, n_loss_tokens), as in instruction data.

    Returns example_id, n_tokens, n_segments, n_loss_tokens, sequence_id, offset. Null sizes count as 0. An example
    over a limit on its own gets a sequence of its own (oversize true), so that no row is lost. Of examples that fit
    alike the first goes in; repeated rows are packed once each. An empty table gives no rows.
    """
    limits = np.array([max_tokens, max_segments, max_loss_tokens])
    names = ("example_id", "n_tokens", "n_segments", "n_loss_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 38
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ids = part.column(0).to_pylist()
                sizes = np.array([[v or 0 for v in part.column(i).to_pylist()] for i in (1, 2, 3)], dtype=np.int64).T.reshape(-1, 3)
                out = []
                for own in fill_bins(sizes, limits):
                    at = 0
                    for i in own:
                        out.append((ids[i], *map(int, sizes[i]), next_id, at, bool((sizes[i] > limits).any())))
                        at += int(sizes[i][0])
                    next_id += 1
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.bool_())], names=[*names, "sequence_id", "offset", "oversize"])

    longs = examples.select(*(examples[n].cast("long").alias(n) for n in names))
    return longs.mapInArrow(run, ", ".join(f"{n} long" for n in (*names, "sequence_id", "offset")) + ", oversize boolean")
