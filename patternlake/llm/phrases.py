"""Phrase collocations by suffix arrays of word ids.

Each task turns its texts into a stream of word ids, a piece's end being the id 0, and sorts the stream's suffixes by
prefix doubling: ranks of the first word, then of the first two, four and so on, up to the longest phrase. Neighbours in
that order share a prefix of so many words (LCP), and each interval of the array whose LCPs reach n is an n-gram with as
many occurrences as the interval is long. These counts, a row a distinct n-gram of a part of the stream, are merged
by language and phrase, combined before they are shuffled.

Phrases are counted a length at a time, and none whose two parts of one word less can't both be frequent: these are
known by their bits in a filter of fixed size, which goes to all tasks. A bit that another phrase has set, or a filter
that is full, costs rows and never a count. Phrases are then scored against the counts of their parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, spread_join

STREAM = 1 << 20  # word ids of a task that are sorted at a time
FILTER_BITS = 1 << 27  # bits of the filter of frequent phrases: 16 MB
BLOCK_BITS = 1 << 19  # of them in a row
SLICE = 4 << 20  # bytes of a text that are taken apart at a time
#: Bytes that end a piece, and a byte that UTF-8 never has, which stands for them.
PIECE_ENDS, END = b".,;:!?\x0a\x0b\x0c\x0d", b"\xff"
FOLDED = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS, bytes(range(97, 123)) + END * len(PIECE_ENDS))
COUNT = "lang string, phrase string, f long"


class Words(dict):
    """Ids of a language's words, given when first asked for from a list that all languages share."""

    def __init__(self, known: list[bytes]):
        self.known = known

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self.known)
        self.known.append(word)
        return out


def slices(text: bytes) -> Iterator[bytes]:
    """A folded text in parts of about SLICE, each but the last ending in a space or a piece's end; a longer word is whole."""
    at = 0
    while len(text) - at > SLICE:
        ends = [x + 1 for x in (text.find(b" ", at + SLICE), text.find(END, at + SLICE)) if x >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:]


def ranks(ids: np.ndarray, n: int) -> np.ndarray:
    """Keys in the order of the suffixes by their first n words, by prefix doubling: ranks by h words and by h words of what follows them make ranks by 2 h. The last step's keys order as ranks do, and are left as they are."""
    rank, h = ids.astype(np.int64), 1
    while h < n:
        if h > 1:
            rank = np.unique(rank, return_inverse=True)[1]
        step = min(h, n - h)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1
        rank = rank * (int(rank.max()) + 2) + after
        h += step
    return rank


def intervals(ids: np.ndarray, wanted: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct n-gram begins, and how often it occurs, of those that begin at wanted places of a stream.

    The suffix array is the order of the ranks. An interval ends where the LCP with the suffix before is below n.
    """
    order = np.flatnonzero(wanted)
    order = order[np.argsort(ranks(ids, n)[order])]
    padded, new = np.concatenate([ids, np.zeros(n, ids.dtype)]), np.zeros(len(order), bool)
    new[:1] = True
    for k in range(n):
        word = padded[order + k]
        new[1:] |= word[1:] != word[:-1]
    starts = np.flatnonzero(new)
    return order[starts], np.diff(np.append(starts, len(order)))


def hashed(lang: str, words: list[bytes]) -> np.ndarray:
    """Hashes of a language's words."""
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def bits_of(hashes: list[np.ndarray]) -> np.ndarray:
    """Bits of the filter of phrases by their words' hashes, in the words' order."""
    out = np.zeros_like(hashes[0])
    for h in hashes:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out % np.uint64(FILTER_BITS)).astype(np.int64)


class Counter:
    """Counts of a task's phrases of n words, in parts of its stream; with a filter, of those whose two parts of n - 1 words have their bits set."""

    def __init__(self, n: int, passing: np.ndarray | None):
        self.n, self.passing = n, passing
        self.clear()

    def clear(self) -> None:
        self.known: list[bytes] = [END]
        self.langs: dict[str, Words] = {}
        self.parts: list[np.ndarray] = []
        self.held = 0

    def words(self, lang: str) -> Words:
        if lang not in self.langs:
            self.langs[lang] = Words(self.known)
            self.langs[lang][END] = 0
        return self.langs[lang]

    def add(self, lang: str, text: str) -> Iterator[pa.RecordBatch]:
        for part in slices(text.encode().translate(FOLDED)):
            tokens = part.replace(END, b" \xff ").split()
            self.parts.append(np.fromiter(map(self.words(lang).__getitem__, tokens), np.int32, len(tokens)))
            self.held += len(tokens)
            if self.held >= STREAM:
                # What begins in the last words goes on in the next part, whose text has the same language.
                tail = np.concatenate(self.parts)[-self.n + 1 :] if self.n > 1 else np.zeros(0, np.int32)
                yield from self.counts(len(tail))
                rest = [self.known[i] for i in tail]
                self.clear()
                self.parts.append(np.fromiter((self.words(lang)[w] for w in rest), np.int32, len(rest)))
                self.held = len(rest)
        self.parts.append(np.zeros(1, np.int32))
        self.held += 1

    def wanted(self, ids: np.ndarray, own: int) -> np.ndarray:
        """Places before own at which a phrase of n words begins, and one that may be frequent."""
        padded = np.concatenate([ids, np.zeros(self.n, ids.dtype)])
        out = np.arange(len(ids)) < own
        for k in range(self.n):
            out &= padded[k : k + len(ids)] > 0
        if self.passing is not None:
            hashes = np.zeros(len(self.known), np.uint64)
            for lang, words in self.langs.items():
                names = list(words)[1:]
                hashes[np.fromiter((words[w] for w in names), np.int64, len(names))] = hashed(lang, names)
            at = hashes[padded]
            bits = bits_of([at[k : len(ids) + 1 + k] for k in range(self.n - 1)])
            may = (self.passing[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 > 0
            out &= may[:-1] & may[1:]
        return out

    def counts(self, rest: int = 0) -> Iterator[pa.RecordBatch]:
        """Counts of all phrases that begin before the stream's last rest ids."""
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        if len(ids) == rest:
            return
        lang_of = np.zeros(len(self.known), np.int32)
        for i, words in enumerate(self.langs.values()):
            lang_of[np.fromiter(words.values(), np.int64, len(words))] = i
        known, langs = pa.array(self.known[1:], pa.binary()).cast(pa.string()), pa.array(list(self.langs), pa.string())
        at, f = intervals(ids, self.wanted(ids, len(ids) - rest), self.n)
        for lo in range(0, len(at), 1 << 18):
            some = at[lo : lo + (1 << 18)]
            words = [known.take(pa.array(ids[some + k] - 1)) for k in range(self.n)]
            phrase = words[0] if self.n == 1 else pc.binary_join_element_wise(*words, " ")
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang_of[ids[some]])), phrase, pa.array(f[lo : lo + (1 << 18)], pa.int64())], names=["lang", "phrase", "f"])


def passing_bits(phrases: DataFrame) -> np.ndarray:
    """The filter with the bits of phrases (lang, phrase) set; FILTER_BITS in rows of BLOCK_BITS come to the driver, whatever the phrases."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, dict[bytes, int]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known.setdefault(lang, {})[phrase.encode()] = 0
            for lang, held in known.items():
                rows = [p.split(b" ") for p in held]
                yield pa.RecordBatch.from_arrays([pa.array(bits_of([hashed(lang, list(w)) for w in zip(*rows)]))], names=["bit"])

    def pack(table: pa.Table) -> pa.Table:
        own, row = np.zeros(BLOCK_BITS, np.uint8), int(table["row"][0].as_py())
        own[np.asarray(table["bit"]) - row * BLOCK_BITS] = 1
        return pa.table({"row": [row], "held": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    rows = phrases.select("lang", "phrase").mapInArrow(bits, "bit long").distinct().withColumn("row", F.floor(F.col("bit") / BLOCK_BITS))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row, held in rows.groupBy("row").applyInArrow(pack, "row long, held binary").collect():
        out[row * BLOCK_BITS // 8 : (row + 1) * BLOCK_BITS // 8] = np.frombuffer(held, np.uint8)
    return out


def phrase_counts(docs: DataFrame, n: int, frequent: DataFrame | None = None) -> DataFrame:
    """lang, phrase, f: how often each phrase of n words occurs within the pieces of each language's documents (lang, text); with frequent (lang, phrase), of those whose parts of n - 1 words are all in it, and some others.

    A null lang is `und`, a null text empty. Overlapping occurrences count. Other columns are not read; repeated rows
    count each. An empty table gives no rows.
    """
    passing = docs.sparkSession.sparkContext.broadcast(passing_bits(frequent)) if frequent is not None and n > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(n, passing.value if passing else None)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    yield from counter.add(lang, text)
        yield from counter.counts()

    rows = docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(run, COUNT).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def part_of(phrase: Column, first: Column | int, size: Column | int) -> Column:
    """size words of a phrase from place first (from 0) on."""
    return F.array_join(F.slice(F.split(phrase, " "), F.lit(first) + 1, F.lit(size)), " ")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside_percent: int = 50, best: int = 2000) -> DataFrame:
    """The best collocations of each language of documents (lang, text): lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to longest words that occur least times or more, a times. Of a candidate's cuts into two
    phrases, which occur l and r times, the one whose score floor(1000000 a a / (l r)) is lowest counts, of equals that
    with the shortest first phrase. A candidate goes if it lies within a longer one that occurs inside_percent of a or
    more. n counts all words of the language. best is a limit of the report: rows are ordered by score and a, both
    descending, then by phrase in UTF-8 byte order. Nulls and empty tables are as in phrase_counts(); other columns
    are not read.
    """
    words = cut(phrase_counts(docs, 1))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [words.where(F.col("f") >= least)]
    for n in range(2, longest + 1):
        levels.append(cut(phrase_counts(docs, n, levels[-1]).where(F.col("f") >= least)))
    # A part of a frequent phrase is frequent, so that these counts hold all that is looked up.
    made = [x.select(F.struct("lang", "phrase").alias("key"), F.lit(i + 1).alias("size"), "f") for i, x in enumerate(levels)]
    counts = cut(reduce(DataFrame.union, made))
    found = counts.where("size > 1").select(F.col("key").alias("whole"), "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda first, size: F.struct(F.col("whole.lang").alias("lang"), part_of(F.col("whole.phrase"), first, size).alias("phrase"))
    cuts = cut(found.withColumns({"key": part(0, F.col("k")), "right": part(F.col("k"), F.col("size") - F.col("k"))}))
    known = counts.select("key", "f")
    half = cut(spread_join(cuts, known.withColumnRenamed("f", "l"), "key").drop("key").withColumnRenamed("right", "key"))
    both = spread_join(half, known.withColumnRenamed("f", "r"), "key")
    big = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731: 38 digits hold all products
    scored = both.select("whole", "size", "a", "k", "l", "r", F.call_function("div", big("a") * big("a") * F.lit(1000000).cast("decimal(7,0)"), big("l") * big("r")).alias("score"))
    worst = F.min(F.struct("score", "k", "l", "r")).alias("m")
    cand = cut(scored.groupBy("whole").agg(F.first("size").alias("size"), F.first("a").alias("a"), worst).select(F.col("whole").alias("key"), "size", "a", "m.l", "m.r", "m.score"))
    # The most frequent longer phrase that each phrase lies within.
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(0), F.col("size") - s), lambda i: F.struct(i.alias("i"), s.alias("s")))))
    inner = cand.where("size > 2").select("key", "a", F.explode(places).alias("x"))
    within = inner.groupBy(F.struct(F.col("key.lang").alias("lang"), part_of(F.col("key.phrase"), F.col("x.i"), F.col("x.s")).alias("phrase")).alias("key")).agg(F.max("a").alias("longer"))
    kept = cand.join(within, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))  # both sides have a key once
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    rows = kept.select("key.lang", "key.phrase", "a", "l", "r", "score")
    # Rows lie in ranges of their order; a rank is what is before a range, and the place within it.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(rows.repartitionByRange(parts, "lang", *order).withColumn("part", F.spark_partition_id()))
    sizes = ordered.groupBy("lang", "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = sizes.withColumn("before", before).where(F.col("before") < best).drop("size")  # a row a range
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    ranked = ordered.join(heads, ["lang", "part"]).withColumn("rank", F.col("before") + place).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, piece, unnest(w) AS w0, unnest(range(len(w))) AS i FROM w),
v AS (SELECT lang, w0, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM u WINDOW o AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, 1 AS size, w0 AS phrase FROM v UNION ALL SELECT lang, 2, w0 || ' ' || w1 FROM v WHERE w1 IS NOT NULL UNION ALL SELECT lang, 3, w0 || ' ' || w1 || ' ' || w2 FROM v WHERE w2 IS NOT NULL),
c AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE size = 1 GROUP BY 1),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS x FROM c WHERE size > 1 AND f >= 10),
cuts AS (SELECT *, lang || chr(10) || array_to_string(x[1 : k], ' ') AS pl, lang || chr(10) || array_to_string(x[k + 1 :], ' ') AS pr FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
often AS MATERIALIZED (SELECT lang || chr(10) || phrase AS key, f FROM c WHERE f >= 10),
s AS (SELECT cuts.*, cl.f AS l, cr.f AS r, ((1000000::HUGEINT * a * a) // (cl.f::HUGEINT * cr.f))::BIGINT AS score FROM cuts JOIN often cl ON cl.key = pl JOIN often cr ON cr.key = pr),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS rn FROM s) WHERE rn = 1),
inn AS (SELECT lang, array_to_string(x[1 : 2], ' ') AS phrase, a FROM cand WHERE size = 3 UNION ALL SELECT lang, array_to_string(x[2 : 3], ' '), a FROM cand WHERE size = 3),
big AS (SELECT lang, phrase, max(a) AS longer FROM inn GROUP BY 1, 2),
k AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank FROM m LEFT JOIN big USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN t USING (lang) WHERE rank <= 2000
"""
