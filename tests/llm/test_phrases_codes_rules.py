"""Phrases, vector codes and rule ensembles against plain loops; nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternlake.llm import codebooks, phrases, rulefit


def plain_counts(rows, longest):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    f[lang or "und"][tuple(words[i : i + n])] += 1
    return f


def plain_collocations(rows, longest, least, percent, best):
    out = []
    for lang, f in plain_counts(rows, longest).items():
        total, cand, kept = sum(c for p, c in f.items() if len(p) == 1), {}, []
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                score, k = min((math.floor(Fraction(1000000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
                cand[p] = (a, f[p[:k]], f[p[k:]], score)
        for p, (a, left, right, score) in cand.items():
            inside = any(len(q) > len(p) and 100 * cand[q][0] >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in cand)
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def corpus(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(("The", "of", "new", "york", "city", "être", "a b", "x\x1cy", "big", "APPLE", "ß")) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(("en", "fr", None)), "".join(w + rng.choice((" ", " ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!?")) for w in words)))
    return rows + [("en", None), ("en", ""), (None, " \n"), ("fr", "new york " * 5000), ("en", "new york city"), ("en", "new york city"), ("de", "a b")]


@pytest.mark.parametrize("longest, best", [(3, 2000), (4, 7)])
def test_collocations_equal_plain_loops(spark, longest, best):
    rows = corpus(1, 700)
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("clash") for c in ("phrase", "n", "f", "key", "size", "score", "rank", "part", "a")})
    got = sorted(tuple(r) for r in phrases.collocations(df, longest, 10, 50, best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    want = plain_collocations(rows, longest, 10, 50, best)
    assert len(want) > 12 and got == want
    assert phrases.collocations(df.limit(0)).count() == 0


def test_streams_are_cut_anywhere(monkeypatch):
    monkeypatch.setattr(phrases, "STREAM", 37)
    monkeypatch.setattr(phrases, "SLICE", 64)
    rows = [(lang or "und", text) for lang, text in corpus(2, 40) if text is not None]
    want = plain_counts(rows, 3)
    for n in (1, 2, 3):
        counter, got = phrases.Counter(n, None), Counter()
        for batch in [b for lang, text in rows for b in counter.add(lang, text)] + list(counter.counts()):
            for lang, phrase, f in zip(*(c.to_pylist() for c in batch.columns)):
                got[lang, tuple(phrase.split(" "))] += f
        assert got == {(lang, p): c for lang, f in want.items() for p, c in f.items() if len(p) == n}


def test_a_full_filter_changes_no_count(spark, monkeypatch):
    df = spark.createDataFrame(corpus(3, 40), "lang string, text string")
    frequent = phrases.phrase_counts(df, 1).where("f >= 10")
    some = {tuple(r) for r in phrases.phrase_counts(df, 2, frequent).where("f >= 10").collect()}
    monkeypatch.setattr(phrases, "passing_bits", lambda _: np.full(phrases.FILTER_BITS // 8, 255, np.uint8))
    assert some == {tuple(r) for r in phrases.phrase_counts(df, 2, frequent).where("f >= 10").collect()} and some


def test_products_beyond_64_bits(spark):
    a, b = 3 * 10**12, 5 * 10**12
    big = spark.createDataFrame([(a, b)], "a long, l long").select(*(F.col(c).cast("decimal(19,0)").alias(c) for c in ("a", "l")))
    assert big.select(F.call_function("div", F.col("a") * F.col("a") * F.lit(1000000).cast("decimal(7,0)"), F.col("l") * F.col("l"))).first()[0] == 1000000 * a * a // (b * b)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows (id, vector, label) of one length, fit."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(4096 * x) for x in v] for _, v, _ in rows]
    size = len(ints[0])
    cuts = [(p * size // parts, (p + 1) * size // parts) for p in range(parts)]
    books = [[r[a:b] for r in ints[:entries]] for a, b in cuts]
    near = lambda x, book: min((sum((p - q) ** 2 for p, q in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            held = defaultdict(list)
            for r in ints:
                held[near(r[a:b], books[p])[1]].append(r[a:b])
            books[p] = [[sum(c) // len(held[i]) for c in zip(*held[i])] if held[i] else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[near(r[a:b], book) for (a, b), book in zip(cuts, books)] for r in ints]
    errors, labels = [sum(d for d, _ in x) for x in found], Counter()
    for (_, _, label), e in zip(rows, errors):
        labels[label] += e
    return sorted((str(i), "".join(f"{c:02x}" for _, c in x), e, labels[label], digest) for (i, _, label), x, e in zip(rows, found, errors))


def coded(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codebooks.compress(df).collect())


def test_codes_equal_plain_loops(spark):
    rng = random.Random(4)
    own = lambda: [rng.choice((0.0, 0.25, -0.25, rng.uniform(-1, 1))) for _ in range(20)]  # noqa: E731: ties
    rows = [(i, own(), rng.choice((1, 2, None))) for i in range(150)]
    rows += [rows[7], (7, own(), 1), (None, own(), 2), rows[9]]
    bad = [(900, None, 1), (901, [float("nan")] * 20, 1), (902, [None] + [0.5] * 19, 1), (903, [float("inf")] * 20, None)]
    schema = "vec_id long, embedding array<double>, label int"
    clash = {c: F.lit("clash") for c in ("code", "error", "key", "block", "ids", "vector", "label_error")}
    df = spark.createDataFrame(rows + bad, schema).withColumns(clash)
    assert coded(df) == plain_codes(rows)
    few = rows[:5]
    assert coded(spark.createDataFrame(few, schema)) == plain_codes(few)  # fewer rows than entries
    assert codebooks.compress(df.limit(0)).count() == 0 and codebooks.compress(spark.createDataFrame(bad, schema)).count() == 0
    two = [(i, [float(i % 7)] * 8, 3) for i in range(20)]
    both = coded(spark.createDataFrame(two + [(50, [], 4), (51, [1.0, 2.0, 3.0], 4)], schema))
    assert [r for r in both if r[0] not in ("50", "51")] == plain_codes(two) and [r[1:3] for r in both if r[0] == "50"] == [("00" * 8, 0)]
    with pytest.raises(Exception, match="below 65536"):
        codebooks.compress(spark.createDataFrame([(1, [1e6] * 8, 1)], schema)).collect()


def test_heaps_pop_what_drift_violates_alone():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 4))
    own = centres[rng.integers(0, 16, 2000)] + rng.integers(-200, 200, (2000, 4))
    book, drift, looked = own[:16].copy(), np.zeros(16), []
    p = codebooks.Position(own, 16)
    p.place(np.arange(2000), book, drift)
    for _ in range(8):
        new = np.where(p.counts[:, None] > 0, p.sums // np.maximum(p.counts, 1)[:, None], book)
        drift, book, before = drift + codebooks.drifts(book, new), new, p.looked
        p.place(p.violated(drift), book, drift)
        looked.append(p.looked - before)
        d = ((own[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (p.codes == d.argmin(axis=1)).all() and sum(map(len, p.heaps)) == 2000
        assert (p.counts == np.bincount(p.codes, minlength=16)).all() and (p.sums == [own[p.codes == c].sum(axis=0) for c in range(16)]).all()
    assert sum(looked[3:]) < 2000  # later rounds look at few
    again = codebooks.restored({k: v[0] for k, v in codebooks.stored(5, [p]).to_pydict().items()}, [own], 16)[0]
    assert again.heaps == p.heaps and (again.sums == p.sums).all() and (again.codes == p.codes).all()


def test_a_compiled_ensemble_equals_its_rules(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)).round(2)
    y = ((x[:, 0] > 0.3) & (x[:, 1] <= 0.5) | (x[:, 2] > 1)).astype(float)
    made = rulefit.fit(["a", "b", "c"], x, y)
    z = made.score(x)
    assert np.mean((z > 0.5) == (y > 0)) > 0.97 and 0 < len(made.rules) < 80
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double")
    got = {r["i"]: r["s"] for r in df.select("i", made.column().alias("s")).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(z.tolist())
    assert rulefit.fit(["a"], x[:9, :1], np.ones(9)).score(x[:2, :1]) == pytest.approx([10 / 11] * 2)
    assert rulefit.fit(["a"], np.zeros((0, 1)), np.zeros(0)).score(x[:1, :1]) == pytest.approx([0.5])


def test_lasso_meets_the_conditions_of_its_optimum():
    rng = np.random.default_rng(5)
    a = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * a[:, 0] - 3 * a[:, 1] + 0.5)))).astype(float)
    w, b = rulefit.lasso(a, y, 0.02, np.zeros(12), 0.0, 4000)
    p = 1 / (1 + np.exp(-(a @ w + b)))
    slope = a.T @ (y - p) / 400
    assert abs(np.mean(y - p)) < 1e-6 and w[0] > 0 > w[1] and (w == 0).any()
    assert np.allclose(slope[w != 0], 0.02 * np.sign(w[w != 0]), atol=1e-5) and (np.abs(slope[w == 0]) <= 0.02 + 1e-6).all()


def test_quality_scores(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(("the", "house", "is", "near", "water")) + rng.choice(("", "", ".")) for _ in range(60)) + ".\nAnd so it ends."
    bad = lambda: " | ".join(rng.choice(("home", "news", "about", "##")) for _ in range(60))
    rows = [(i, bad() if i % 3 == 0 else good(), "en") for i in range(400)] + [(500, None, "en"), (501, "", None), (502, " \n", "x"), (None, good(), "en"), (7, good(), "en"), (503, "word " * 200_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("score", "held_out", "w_", "n_", "s_words", "y", "h", "quality")})
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)] + [(None, 1), (9999, 0), (3, None)], "doc_id long, quality int")
    made = rulefit.train(docs, labels)
    out = rulefit.score(docs, made).collect()
    import zlib

    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 50 and all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held)
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rulefit.train(docs, turned) == made
    assert rulefit.score(docs.limit(0), made).count() == 0
    alone = rulefit.train(docs, labels.limit(0))
    assert {r["score"] for r in rulefit.score(docs, alone).collect()} == {0.5}
