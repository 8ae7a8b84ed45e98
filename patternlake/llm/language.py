"""Language ID by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into segments of SEGMENT bytes. Over each, one gated recurrent unit runs forwards and one
backwards; a softmax over both states labels every position, and a document's probability of a language is the mean
over all its positions. Training is backpropagation through time, written in numpy. Whole texts are read; segments of
many texts run side by side, so memory is bounded whatever their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 96
LOT = 2048  # segments that run side by side
F32 = np.float32


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; a null id counts as an empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def segments(text: str) -> np.ndarray:
    """The bytes of a text as rows of SEGMENT, letter case aside; the last is filled up with the id 256."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    out = np.full(-(-len(raw) // SEGMENT) * SEGMENT, 256, np.int16)
    out[: len(raw)] = raw
    return out.reshape(-1, SEGMENT)


class Network:
    """Parameters: for either direction x (257 x 3H: what a byte adds to update, reset and candidate), u (H x 2H), c (H x H); w (2H x L), b."""

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(F32)
            self.p[f"u{d}"] = rng.normal(0, hidden**-0.5, (hidden, 2 * hidden)).astype(F32)
            self.p[f"c{d}"] = rng.normal(0, hidden**-0.5, (hidden, hidden)).astype(F32)
        self.p["w"] = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(F32)
        self.p["b"] = np.zeros(len(languages), F32)

    def _run(self, bytes_: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time x hidden x batch) of one direction; the batch lies last, so that every step works on long rows."""
        h_n, (n, steps) = self.hidden, bytes_.shape
        table, u, c = self.p[f"x{d}"].T.copy(), self.p[f"u{d}"].T.copy(), self.p[f"c{d}"].T.copy()
        table[: 2 * h_n] *= 0.5  # the logistic function is taken by way of tanh at half the argument
        u *= 0.5
        times = bytes_.T.astype(np.intp)
        out, h = np.empty((steps, h_n, n), F32), np.zeros((h_n, n), F32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = np.take(table, times[t], axis=1)
            gates = u @ h
            gates += x[: 2 * h_n]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:h_n], gates[h_n:]
            cand = c @ (r * h)
            cand += x[2 * h_n :]
            np.tanh(cand, out=cand)
            if keep is not None:
                keep.append((t, h, z, r, cand))
            step = cand - h
            step *= z
            h = np.add(h, step, out=out[t]) if keep is None else h + step
            if keep is not None:
                out[t] = h
        return out

    def positions(self, bytes_: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every position (time x language x batch)."""
        w = self.p["w"].T
        both = np.matmul(w[:, : self.hidden], self._run(bytes_, "f")) + np.matmul(w[:, self.hidden :], self._run(bytes_, "b"))
        both += self.p["b"][:, None]
        both -= both.max(axis=1, keepdims=True)
        np.exp(both, out=both)
        both /= both.sum(axis=1, keepdims=True)
        return both

    def pooled(self, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each segment: the sums of its positions' probabilities, and its number of bytes."""
        real = (bytes_ < 256).T.astype(F32)
        return np.einsum("tln,tn->nl", self.positions(bytes_), real), real.sum(axis=0)

    def gradients(self, bytes_: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions, and its gradients by backpropagation through time."""
        n, steps = bytes_.shape
        h_n, kept = self.hidden, {"f": [], "b": []}
        states = {d: self._run(bytes_, d, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=1)
        logits = np.matmul(self.p["w"].T, both) + self.p["b"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        real = (bytes_ < 256).T.astype(F32)
        loss = float(-(np.log(prob[:, labels, np.arange(n)] + 1e-9) * real).sum() / real.sum())
        err = prob
        err[:, labels, np.arange(n)] -= 1
        err *= (real / real.sum())[:, None, :]
        g = {"w": np.einsum("tkn,tln->kl", both, err), "b": err.sum(axis=(0, 2))}
        into = np.matmul(self.p["w"], err)
        for d, part in (("f", into[:, :h_n]), ("b", into[:, h_n:])):
            u, c = self.p[f"u{d}"], self.p[f"c{d}"]
            gx, gu, gc = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u), np.zeros_like(c)
            back = np.zeros((h_n, n), F32)
            for t, h, z, r, cand in reversed(kept[d]):
                back = back + part[t]
                d_cand = back * z * (1 - cand * cand)
                d_rh = c @ d_cand
                d_gates = np.concatenate([back * (cand - h) * z * (1 - z), d_rh * h * r * (1 - r)])
                gc += (r * h) @ d_cand.T
                gu += h @ d_gates.T
                np.add.at(gx, bytes_[:, t], np.concatenate([d_gates, d_cand]).T)
                back = back * (1 - z) + d_rh * r + u @ d_gates
            g |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return loss, g

    def fit(self, bytes_: np.ndarray, labels: np.ndarray, steps: int, batch: int = 128, rate: float = 0.02, seed: int = 7) -> None:
        """Adam, with languages drawn alike often."""
        rng = np.random.default_rng(seed)
        rows = [np.flatnonzero(labels == i) for i in range(len(self.languages))]
        rows = [r for r in rows if len(r)]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            own = np.concatenate([rng.choice(r, batch // len(rows) + 1) for r in rows])
            _, g = self.gradients(bytes_[own], labels[own])
            pace = rate * (1 - step / (steps + 1))
            for k, x in g.items():
                np.clip(x, -1, 1, out=x)
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                self.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(F32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def sample(docs: DataFrame, per_language: int, segments_per_text: int, max_languages: int, seed: int = 7) -> list[tuple[str, bytes]]:
    """Segments (lang, bytes) of about per_language labelled texts of each language, outside the held-out part, by a hash of doc_id; of each text segments_per_text.

    They are cut where the texts lie: what goes to the driver is bounded by max_languages (those with most texts)
    x per_language x 4 x segments_per_text x SEGMENT bytes.
    """
    mod4 = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (mod4 != 2))
    counts = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max_languages).collect()
    if not counts:
        return []
    parts = 1 << 30
    bound = F.create_map(*(F.lit(x) for c in counts for x in (c["lang"], min(parts, parts * per_language // c["count"] + 1))))
    rank = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts))
    picked = known.where(rank < F.try_element_at(bound, F.col("lang"))).select("lang", "text", "doc_id").limit(4 * per_language * len(counts))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text, doc_id in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if has_letter(text):
                    rows, rng = segments(text), np.random.default_rng(zlib.crc32(f"{seed} {doc_id}".encode()))
                    out += [(lang, x.astype("<i2").tobytes()) for x in rows[rng.permutation(len(rows))[:segments_per_text]]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], names=["lang", "segment"])

    return sorted((r["lang"], bytes(r["segment"])) for r in picked.mapInArrow(some, "lang string, segment binary").collect())


def train(docs: DataFrame, per_language: int = 300, segments_per_text: int = 8, max_languages: int = 256, steps: int = 250, hidden: int = 5) -> Network | None:
    """Learn from text and lang of documents (doc_id, text, lang) that aren't held out; None if there are none. Rows whose doc_id is null share one hash."""
    labelled = sample(docs, per_language, segments_per_text, max_languages)
    if not labelled:
        return None
    languages = sorted({lang for lang, _ in labelled})
    net = Network(languages, hidden)
    net.fit(np.stack([np.frombuffer(x, "<i2") for _, x in labelled]), np.array([languages.index(lang) for lang, _ in labelled]), steps)
    return net


def label_texts(net: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and pooled probability of each text; und and 0 for those without a letter, or without anything learned."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if net is None:
        return out
    sums, sizes = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    n = 0

    def run(last: bool) -> None:
        nonlocal held, owners, n
        rows, own = np.concatenate(held), np.concatenate(owners)
        whole = len(rows) if last else len(rows) // LOT * LOT
        for lo in range(0, whole, LOT):
            p, k = net.pooled(rows[lo : lo + LOT])
            np.add.at(sums, own[lo : lo + LOT], p)
            np.add.at(sizes, own[lo : lo + LOT], k)
        held, owners, n = [rows[whole:]], [own[whole:]], len(rows) - whole

    for i, text in enumerate(texts):
        if has_letter(text):
            rows = segments(text)
            held.append(rows)
            owners.append(np.full(len(rows), i))
            n += len(rows)
            if n >= LOT:
                run(last=False)
    if n:
        run(last=True)
    for i in np.flatnonzero(sizes):
        best = int(sums[i].argmax())
        out[i] = (net.languages[best], float(min(1.0, sums[i][best] / sizes[i])))
    return out


def identify(docs: DataFrame, net: Network | None = None, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """Predict the language of documents (doc_id, text; lang too where net isn't given and is trained here).

    Returns doc_id, held_out, lang_pred, score (the mean probability over all positions). Null texts and those without
    a letter are und, score 0; so is all if nothing is labelled. Of equal probabilities the first language by name wins. Every row gives one row, repeated ids too. Columns
    named in carry are handed on; others are not read. An empty table gives no rows.
    """
    net = net or train(docs, **options)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 10 kB: 257 bytes x 3 gates x 2 directions x 5
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"carry_{c} {kinds[c]}" for c in carry), "doc_id long, held_out boolean, lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids = part.column(0).to_pylist()
                found = label_texts(shared.value, part.column(1).to_pylist())
                own = [pa.array(ids, pa.int64()), pa.array(map(held_out, ids), pa.bool_()), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(2 + i) for i in range(len(carry))), *own], names=[*(f"carry_{c}" for c in carry), "doc_id", "held_out", "lang_pred", "score"])

    out = docs.select("doc_id", "text", *(F.col(c).alias(f"carry_{c}") for c in carry)).mapInArrow(run, schema)
    return out.select("doc_id", "held_out", "lang_pred", "score", *(F.col(f"carry_{c}").alias(c) for c in carry))


def keep_identified(docs: DataFrame, min_score: float = 0.4) -> DataFrame:
    """Documents whose language is told with at least min_score; und ones go. Returns the columns of documents as they are."""
    return identify(docs, carry=("text", "lang", "source", "n_chars")).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("doc_id", "text", "lang", "source", "n_chars")
