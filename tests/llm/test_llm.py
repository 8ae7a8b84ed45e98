"""The training-data operators on small inputs: brute force, round trips, nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternlake.llm import components, htmltext, language, licenses, mixing, neighbours, packing, quality, secrets, simhash, tokenfile
from patternlake.llm.common import shared_path
from patternlake.llm.tokenization import ChunkEncoder, resolve

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta. " * 6000
TEXTS = [None, "", " \n ", "one", "Über die Wälder geht der Wind, sagt man.", LONG, "same text here\nsame text here", "same text here\nsame text here", "x" * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, a repeated one and a null id; the columns of every operator's results clash with extra ones."""
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", 0) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "en", "s1", 0), (None, "no id at all", "en", "s0", 0)]
    clash = {c: F.lit("clash") for c in ("start", "length", "fp", "node", "size", "taken", "kept", "n_words", "w", "row", "spans", "base", "found", "score", "path", "license", "sequence_id", "root", "rank", "tie", "held_out")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(tokenizer, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(resolve(tokenizer))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(name, spaces):
    random.seed(1)
    parts = ["a", "Th", " ", "  ", "\n", "\t", "é", "ß", "'s", "'", "1", "²", ".", "!!", "|", "’", "œ", "́", "漢", "\x85", "\xa0", "<|endoftext|>", "İ", "ſ", "Σ", "😀", "-", "(", "\r\n"]
    e = ChunkEncoder(name, spaces)
    for _ in range(1500):
        text = "".join(random.choices(parts, k=random.randint(0, 12)))
        assert e.encode([text])[0] == e._whole(text), text


def test_packing(docs, none):
    rows = packing.pack_documents(docs).collect()
    have = {}
    for r in rows:
        have.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for i, text in enumerate(TEXTS):
        ids = ids_of("byte_bpe_50k.json", text, 1)
        own = sorted(have[i, len(ids)], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) * (2 if i == 7 else 1)
        assert all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in own)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = total = 0
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * total
    assert packing.pack_documents(none).count() == 0
    assert packing.pack_examples(none.select(F.lit(1).alias("example_id"), *(F.lit(1).alias(c) for c in ("n_tokens", "n_segments", "n_loss_tokens"))), 8, 8, 8).count() == 0


def test_packing_keeps_all_limits(spark):
    random.seed(3)
    rows = [(i, random.randint(1, 900), random.randint(1, 4), random.randint(0, 500)) for i in range(800)] + [(800, 5000, 1, 1), (801, None, None, None)]
    out = packing.pack_examples(spark.createDataFrame(rows, "example_id long, n_tokens long, n_segments long, n_loss_tokens long"), 2048, 8, 1200).toPandas()
    assert sorted(out.example_id) == list(range(802)) and out[out.oversize].example_id.tolist() == [800]
    sums = out[~out.oversize].groupby("sequence_id")[["n_tokens", "n_segments", "n_loss_tokens"]].sum().max()
    assert sums.n_tokens <= 2048 and sums.n_segments <= 8 and sums.n_loss_tokens <= 1200


@pytest.mark.parametrize("limits", [(64, 3, 60), (64, 8, 63), (100, 2, 40)])
def test_text_packer_keeps_limits_and_ids(limits):
    rng = random.Random(18)
    packer, docs, rows = packing.TextPacker(*limits, 4, 0), {}, []
    for doc in range(400):
        docs[doc] = np.array([rng.randrange(50_000) for _ in range(rng.choice([1, 2, 5, 30, 70, 300]))], "<u4")
        rows += packer.add(doc, docs[doc].tobytes())
    rows += packer.pack(last=True)
    sequences, have = {}, {}
    for doc, start, length, check, total, sequence, offset, loss in rows:
        assert check == crc(docs[doc][start : start + length]) and total == len(docs[doc]) and loss == length - 1
        have.setdefault(doc, []).append((start, length))
        sequences.setdefault(sequence, []).append((offset, length, loss))
    for doc, ids in docs.items():
        assert [start for start, _ in sorted(have[doc])] == list(np.cumsum([0, *(n for _, n in sorted(have[doc]))])[:-1]) and sum(n for _, n in have[doc]) == len(ids)
    for own in sequences.values():
        assert sum(n for _, n, _ in own) <= limits[0] and len(own) <= limits[1] and sum(x for *_, x in own) <= limits[2]


def test_fill_bins_equals_a_plain_loop():
    """The dot-product heuristic, a pick at a time."""
    rng = random.Random(19)
    for _ in range(30):
        limits = [rng.randint(20, 60), rng.randint(2, 5), rng.randint(10, 40)]
        sizes = [[rng.randint(1, 40), 1, rng.randint(0, 20)] for _ in range(rng.randint(0, 25))]
        left = [i for i, x in enumerate(sizes) if all(a <= b for a, b in zip(x, limits))]
        bins = [[i] for i in range(len(sizes)) if i not in left]
        scarce = [sum(x[d] / limits[d] for x in sizes) / max(1, len(sizes)) for d in range(3)]
        left.sort(key=lambda i: -round(sum(sizes[i][d] / limits[d] * scarce[d] for d in range(3)), 12))
        while left:
            rest, own = list(limits), []
            while fits := [i for i in left if all(sizes[i][d] <= rest[d] for d in range(3))]:
                pick = max(fits, key=lambda i: (round(sum(sizes[i][d] / limits[d] * scarce[d] * rest[d] / limits[d] for d in range(3)), 12), -left.index(i)))
                own.append(pick)
                left.remove(pick)
                rest = [a - b for a, b in zip(rest, sizes[pick])]
            bins.append(own)
        got = packing.fill_bins(np.array(sizes).reshape(-1, 3), np.array(limits))
        fill = lambda bs: sorted(tuple(sum(sizes[i][d] for i in b) for d in range(3)) for b in bs)
        assert fill(got) == fill(bins)


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2**60, 2**64 - 1])
def test_simple8b_round_trip(n, top):
    v = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64, endpoint=True)
    words = tokenfile.pack_words(v)
    assert (tokenfile.unpack_words(words, n) == v).all()
    places, before = tokenfile.span_offsets(words)
    assert (np.diff(before) > 0).all() and len(places) == len(before) and (not n or before[0] == 0)
    rng = random.Random(n)
    for a, b in [(0, n), (n, n), *(sorted(rng.choices(range(n + 1), k=2)) for _ in range(20))]:
        assert (tokenfile.decode_range(words, places, before, a, b) == v[a:b]).all()


def test_token_file(spark, docs, none):
    tokenfile.write_token_file(docs, path := shared_path(spark, "t"), partitions=3)
    rows = tokenfile.read_token_file(spark, path).collect()
    start = 0
    found = {}
    for r in tokenfile.read_documents(spark, path, [1, 5, 7, 99]).collect():
        found.setdefault(r["doc_id"], []).append(r["ids"])
    assert found == {i: [ids_of("word_bpe_49k.json", TEXTS[i], 2)] * (2 if i == 7 else 1) for i in (1, 5, 7)}
    for r, (i, text) in zip(sorted(rows, key=lambda r: r["start"]), [(None, "no id at all"), *sorted([*enumerate(TEXTS), (7, TEXTS[7])], key=lambda x: x[0])]):
        ids = ids_of("word_bpe_49k.json", text, 2)
        assert tuple(r) == (i, start, len(ids), crc(ids))
        start += len(ids)
    tokenfile.write_token_file(none, path := shared_path(spark, "t"), partitions=2)
    assert tokenfile.read_token_file(spark, path).count() == 0


def test_quality(docs, none, spark):
    rows = quality.clean_lines(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[r["doc_id"]] or "" if r["doc_id"] is not None else "no id at all"
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.split()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered))
    prose = "This is a line of plain prose that ends well. So does the next one, which is somewhat longer than that. Words, more of them, and an end."
    menu = "Home | News | Sport | About | Contact"
    got = {r["doc_id"]: r for r in quality.clean_lines(spark.createDataFrame([(1, prose + "\n" + menu, ""), (2, "\n".join([menu] * 9), "")], "doc_id long, text string, x string")).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == prose and not got[2]["kept"]
    bad = ["Home\tNews » Sport", "Read more about it.", "Tous droits réservés.", "An end. and then none", "BUY NOW AND SAVE BIG.", "if (x) { y(); }.", "what??? how!!!."]
    good = ["It ends with a quote.\"", "Ja, so ist es!", "¿Y tú? Sí:", "Trailing space.  "]
    rows = spark.createDataFrame([(x, x in bad) for x in bad + good], "line string, bad boolean").select("line", "bad", quality.bad_line(F.col("line")).alias("found")).collect()
    assert [r["line"] for r in rows if r["bad"] != r["found"]] == []
    assert quality.clean_lines(none).count() == 0


PAGE = """<html><head><title>T</title></head><body><header><p>Site name</p></header><nav><a href=/>Home</a></nav><div class="cookie-banner">We use cookies</div><article><h1>Title</h1>
<p>First&amp;   <b>para</b>graph.<aside>Aside words</aside><div class="ad">Buy now</div><p>Second<script>var x = "<p>no</p>";</script></article><section id="comments"><p>Nice post, well done</p></section><footer>&copy; me</footer>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>lone words"), (1, "u", PAGE), (5, "u", "<nav>only menu</nav>"), (6, "u", "<p>" + "long words " * 20_000)]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    text = [r["text"] for r in out]
    assert text[:6] == ["Title\nFirst& paragraph.\nSecond", "", "", "lone words", "Title\nFirst& paragraph.\nSecond", ""]
    assert out[6]["n_chars"] == len("long words " * 20_000) - 1
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_best_region_equals_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        x = [rng.choice([-2, -1, 0.5, 1, 3]) for _ in range(rng.randint(0, 9))]
        lo, hi = htmltext.best_region(x)
        assert sum(x[lo:hi]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def test_main_text_equals_brute_force_on_unseen_layouts():
    """All regions of a page's tokens are tried, a word and a tag each; held-out accuracy, with and without the region."""
    scorer, wrong, loose, total = htmltext.trained(), 0, 0, 0
    for html in htmltext.labelled_pages(90, seed=77):
        page = list(htmltext.blocks(html))
        tokens = [(i, s) for i, (b, t, s) in enumerate(zip(page, scorer.tags(page), scorer.words(page))) for s in [*[t] * b.tags, *[s] * b.words]]
        sums = np.concatenate([[0.0], np.cumsum([s for _, s in tokens])])
        best = max(((sums[j] - sums[i], -i, -j) for i in range(0, len(sums), 1) for j in [i + int(np.argmax(sums[i:]))]), key=lambda x: round(x[0], 6))
        inside = {i for i, _ in tokens[-best[1] : -best[2]]}
        want = [b.text for i, (b, s) in enumerate(zip(page, scorer.words(page))) if i in inside and s > 0]
        assert htmltext.main_text(html) == "\n".join(want)
        for b, s in zip(page, scorer.words(page)):
            content = b.text.startswith("yes")
            total += b.words
            wrong += b.words * ((b.text in want) != content)
            loose += b.words * ((s > 0) != content)
    assert wrong <= 0.03 * total and loose > 1.5 * wrong  # without the region, much more is taken in


TEXT = "This is a first paragraph of the article with quite some words in it, as articles have them.\nA second one follows and it says more about the same thing, at some length too, so that it counts.\nIt ends."
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in TEXT.split("\n"))


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>One line of it.</p><noscript><p>Two lines of it.</p><p>Three lines of it.</p>", "One line of it.\nTwo lines of it.\nThree lines of it."),
        ("<p>One line of it.</p><svg><g><svg>x</svg>y</g></svg><p>Three lines of it.</p>", "One line of it.\nThree lines of it."),
        ("<p>One line of it.</p><script>var x = '<p>no</p>'", "One line of it."),
        ('<body class="no-sidebar has-comments"><form action=x><article class="post tag-search category-legal"><p>Some words here.</p></article></form>', "Some words here."),
        ('<div class="content has-comments"><p>Some words here.</p><div class="ad">Buy this now</div><p>So.</p></div>', "Some words here.\nSo."),
        ('<article><p>Some words here.</p><p>So.</p></article><section class="comments"><article class="comment"><p>Nice words there.</p></article></section>', "Some words here.\nSo."),
        (f"<body><h1>Title of page</h1>{PARAGRAPHS}</body>", f"Title of page\n{TEXT}"),
        (f"<nav><a href=/>Home</a> <a href=/b>News</a></nav><h1>Title</h1>{PARAGRAPHS}", f"Title\n{TEXT}"),
        (f'<div class="mw-parser-output"><h1>Title</h1>{PARAGRAPHS}<ul><li>One item</li><li>Two</li></ul></div><div id=footer>Copyright</div>', f"Title\n{TEXT}\nOne item\nTwo"),
        (f'<article><h1>Title</h1>{PARAGRAPHS}</article><div class="discussion"><p>A reader said this is a great article and they like it a lot.</p></div>', f"Title\n{TEXT}"),
        (f"<h1>Title</h1><article>{PARAGRAPHS}</article>", f"Title\n{TEXT}"),
        ('<main><nav>Menu here</nav><p>Some words here.</p><div hidden>secret words</div><footer>By me</footer></main>', "Some words here."),
    ],
)
def test_html_layouts(html, want):
    assert htmltext.main_text(html) == want


def test_masks_cover_every_pair():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    assert all(any(not m & (1 << i | 1 << j) for m in masks) for i in range(64) for j in range(64))


def test_simhash(spark, docs, none):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40)
    fps = [int(b) ^ sum(1 << int(i) for i in rng.choice(63, k, replace=False)) for b in base for k in (0, 1, 2, 2, 4)]
    group = {f: f for f in fps}
    for _ in range(8):
        for a in fps:
            group[a] = min(group[b] for b in fps if (a ^ b).bit_count() <= 2)
    for pairwise in (1, 3, 48):  # all buckets by points, some, none
        edges = simhash.close_pairs(spark.createDataFrame([(f,) for f in set(fps)], "fp long"), pairwise)
        roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
        assert all(roots.get(f, f) == group[f] for f in fps)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    got = {r["doc_id"]: r for r in rows}
    assert got[0]["fingerprint"] == "0" * 16 and {got[i]["component_id"] for i in (0, 1, 2)} == {0} and got[7]["component_id"] == 6
    assert got[None]["component_id"] is None
    assert simhash.near_duplicates(none).count() == 0


def test_fingerprint_equals_a_plain_loop():
    import xxhash

    rng = random.Random(13)
    for text in [*TEXTS, "Ä b", "A\x0bB\x0cc  D", *(" ".join(rng.choices(["The", "ÖL", "cat", "x", "漢字", "a\xa0b"], k=rng.randint(1, 30))) for _ in range(60))]:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        counts = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), seed=42)
            for bit in range(64):
                counts[bit] += h >> bit & 1
        assert simhash.simhash(text) == sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(grams))


def test_components_of_a_long_path(spark):
    ids = list(range(300))
    random.Random(6).shuffle(ids)
    path = spark.createDataFrame(list(zip(ids, ids[1:])) + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(path).collect()}
    assert {roots[i] for i in ids} == {0} and roots[1001] == 1000 and len(roots) == 302


def test_near_vectors(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(60, 16))
    rows = [(i, (centers[i % 60] + rng.normal(size=16) * 0.12).tolist()) for i in range(600)]
    rows += [(600 + i, (centers[0] + rng.normal(size=16) * 0.05).tolist()) for i in range(300)] + [(900, rows[3][1]), (901, [0.0] * 16), (902, None), (903, [float("nan")] * 16), (904, [1.0]), (905, []), (905, [None] * 16)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = {r["vec_id"]: r for r in neighbours.near_vectors(e).collect()}
    x = np.array([v for i, v in rows if i <= 900])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.95
    true = links.sum(axis=1) - 1
    have = np.array([got[i]["n_links"] for i in range(901)])
    assert (have <= true).all() and have.sum() >= 0.98 * true.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(901, 906))
    assert neighbours.near_vectors(e.where("1 = 0")).count() == 0


def test_near_vectors_across_saturated_lists(spark):
    """12 tight sub-clusters of 25 whose members are all links of one another: 12 neighbours are siblings, no list holds a link to another sub-cluster."""
    rng = np.random.default_rng(8)
    centre, steps = rng.normal(size=64), rng.normal(size=(12, 64))
    centre /= np.linalg.norm(centre)
    subs = centre + 0.15 * steps / np.linalg.norm(steps, axis=1, keepdims=True)
    x = np.repeat(subs, 25, axis=0) + rng.normal(size=(300, 64)) * 0.0005
    x = np.vstack([x, rng.normal(size=(60, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    assert links[:300, :300].all()
    # Lists of siblings only, as a descent leaves them in a large table.
    vectors = spark.createDataFrame([(i, v.tolist(), 1, i) for i, v in enumerate(x)], "node long, vector array<double>, weight long, first long")
    graph = [(i, j, float(unit[i] @ unit[j])) for i in range(300) for j in sorted(set(range(i // 25 * 25, i // 25 * 25 + 25)) - {i}, key=lambda j: -unit[i] @ unit[j])[:12]]
    graph = spark.createDataFrame(graph, "node long, other long, sim double")
    linked = neighbours.link(graph, vectors, 0.95, 12, 4, 0)
    assert {r["root"] for r in linked.roots.collect()} == {0} and linked.members.count() == linked.roots.count() == 300 and linked.plain.isEmpty()
    got = {r["vec_id"]: r for r in neighbours.near_vectors(vectors.withColumnsRenamed({"node": "vec_id", "vector": "embedding"}), trees=1).collect()}
    assert [got[i]["n_links"] for i in range(360)] == (links.sum(axis=1) - 1).tolist() and sum(got[i]["kept"] for i in range(300)) == 1


def test_near_vectors_of_two_lengths_and_audit(spark):
    rows = [(i, [float(i % 3 == d) for d in range(8)]) for i in range(9)] + [(9, [1.0, 0.0, 0.0]), (10, [1.0, 0.01, 0.0]), (11, [0.0, 0.0, 1.0])]
    got = {r["vec_id"]: r for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i]["n_links"] for i in range(12)] == [2] * 9 + [1, 1, 0] and [got[i]["component_id"] for i in (0, 3, 9, 10, 11)] == [0, 0, 9, 9, 11]
    vectors = spark.createDataFrame([(i, [float(i == d) for d in range(4)], i) for i in range(4)], "node long, vector array<double>, first long")
    found = spark.createDataFrame([(0, 1)], "node long, n long")
    assert neighbours.audit(found, neighbours.true_links(vectors, 0.95)) is None
    assert neighbours.audit(found, spark.createDataFrame([(0, 2)], "node long, t long")) == 0.5


def test_what_the_audit_never_accepts_is_compared_exactly(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 12))
    rows = [(i, (centres[i % 30] + 0.12 * rng.normal(size=12)).tolist()) for i in range(400)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.95) & ~np.eye(400, dtype=bool)
    out = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), min_recall=1.5, max_doublings=0).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert linked.any() and {i: n for i, (n, _) in got.items()} == dict(enumerate(linked.sum(axis=1).tolist()))
    root = np.arange(400)
    while True:
        new = np.where(linked, root[None, :], 400).min(axis=1, initial=400)
        new = np.minimum(root, new)
        if (new == root).all():
            break
        root = new
    assert {i: c for i, (_, c) in got.items()} == dict(enumerate(root.tolist()))


def test_the_audit_asks_all_of_its_sample(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PASS_BYTES", 4000)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(700, 6)), 2, axis=0) + 1e-3 * rng.normal(size=(1400, 6))
    v = spark.createDataFrame([(i, a.tolist(), 50 * i) for i, a in enumerate(x)], "node long, vector array<double>, first long")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.95) & ~np.eye(1400, dtype=bool)).sum(axis=1)
    assert {r["node"]: r["t"] for r in neighbours.true_links(v, 0.95).collect()} == {i: n for i, n in enumerate(want.tolist()) if n}


def test_near_vectors_with_null_and_repeated_ids(spark):
    v = [[1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(None, v[0]), (5, v[1]), (5, v[1]), (None, v[2]), (7, v[3]), (None, None)]
    out = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, False), (7, 0, 7, True), (None, 0, None, False)]))


def test_a_crowd_about_one_vector(spark):
    """All copies list the original, which hosts them in parts."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=32)
    x = np.vstack([base, base + rng.normal(size=(700, 32)) * 0.15, rng.normal(size=(50, 32))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    got = {r["vec_id"]: r for r in neighbours.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert [got[i]["n_links"] for i in range(751)] == (links.sum(axis=1) - 1).tolist()


def test_spread_join_deals_hot_keys(spark):
    from patternlake.llm.common import spread_join

    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"))
    right = spark.createDataFrame([(-1, "hot"), (0, "zero"), (3, "three")], "k long, v string")
    for how, n in (("inner", 2002), ("left", 3000), ("left_semi", 2002)):
        plain = left.join(right, "k", how)
        dealt = spread_join(left, right, "k", how, max_bytes=0)
        assert dealt.columns == plain.columns and dealt.count() == n and sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))


def test_gradients_by_differences():
    net = language.Network(["a", "b", "c"], 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 257, (5, 6)).astype(np.int16), rng.integers(0, 3, 5)
    language.F32, old = np.float64, language.F32
    try:
        _, g = net.gradients(x, y)
        for k in net.p:
            for _ in range(5):
                at = tuple(rng.integers(0, n) for n in net.p[k].shape) if not k.startswith("x") else (int(x[0, rng.integers(0, 6)]), int(rng.integers(0, 9)))
                keep = net.p[k][at]
                loss = []
                for d in (1e-5, -1e-5):
                    net.p[k][at] = keep + d
                    loss.append(net.gradients(x, y)[0])
                net.p[k][at] = keep
                assert abs((loss[0] - loss[1]) / 2e-5 - g[k][at]) < 1e-5, k
    finally:
        language.F32 = old


def test_forward_pass_equals_a_plain_loop():
    import math

    net = language.Network(["a", "b"], 3)
    text = "Grüße, und so weiter; bis morgen. " * 5
    rows = language.segments(text)
    sums, size = [0.0, 0.0], 0
    logistic = lambda v: 1 / (1 + math.exp(-v))
    for row in rows.tolist():
        states = {}
        for d in "fb":
            x, u, c = (net.p[k + d].astype(float) for k in "xuc")
            h, states[d] = [0.0] * 3, {}
            for t in range(len(row)) if d == "f" else reversed(range(len(row))):
                z, r = ([logistic(x[row[t], g * 3 + j] + sum(h[i] * u[i, g * 3 + j] for i in range(3))) for j in range(3)] for g in (0, 1))
                cand = [math.tanh(x[row[t], 6 + j] + sum(r[i] * h[i] * c[i, j] for i in range(3))) for j in range(3)]
                h = [a + z[j] * (cand[j] - a) for j, a in enumerate(h)]
                states[d][t] = h
        for t, byte in enumerate(row):
            if byte < 256:
                both = states["f"][t] + states["b"][t]
                e = [math.exp(sum(both[i] * float(net.p["w"][i, k]) for i in range(6)) + float(net.p["b"][k])) for k in (0, 1)]
                sums, size = [s + x / sum(e) for s, x in zip(sums, e)], size + 1
    lang, score = language.label_texts(net, [text])[0]
    assert size == len(text.encode()) and lang == "ab"[sums.index(max(sums))] and score == pytest.approx(max(sums) / size, abs=1e-4)


def test_language(spark, docs, none):
    en, de = "the cat sat on the mat and looked at the rain".split(), "der hund lief über die straße und bellte laut".split()
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(en if i % 2 else de, k=rng.randint(5, 60))), "en" if i % 2 else "de") for i in range(600)]
    net = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=60)
    found = language.label_texts(net, [t for _, t, _ in rows])
    own = [(f[0], lang) for f, (i, _, lang) in zip(found, rows) if language.held_out(i)]
    assert len(own) > 100 and sum(a == b for a, b in own) >= 0.97 * len(own)
    out = {r["doc_id"]: r for r in language.identify(docs, net).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and out[4]["lang_pred"] == "de" and 0 <= out[5]["score"] <= 1
    assert language.identify(none).count() == 0 and language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def plain_targets(sizes):
    """Targets of sources by their sizes, one capped round after another."""
    weights = dict(zip(sorted(sizes), [3, 1, 2] * len(sizes)))
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        target = {s: 2 * n if s in capped else rest * weights[s] / w for s, n in sizes.items()}
        over = {s for s, n in sizes.items() if target[s] > 2 * n}
        if not over:
            return target
        capped |= over


def test_mixing(spark, docs, none):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randint(0, 60), None, None if i % 9 == 0 else f"s{i * i % 7}", 0) for i in range(700)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    got["source"] = got.source.fillna("~")
    by = got.groupby("source").agg(size=("size", "sum"), given=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.given).all() and ((by.taken - by.target).abs() <= 1).all() and (got.taken <= 2 * got["size"]).all()
    target = plain_targets(by["size"].to_dict())
    assert all(abs(target[s] - by.target[s]) < 1e-6 for s in by.index)
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA)).toPandas()
    assert sorted(zip(again.doc_id, again.taken)) == sorted(zip(got.doc_id, got.taken))
    assert mixing.mix(docs).count() == len(TEXTS) + 2 and mixing.mix(none).count() == 0
    same = spark.createDataFrame([(1, f"{w} " * 5, None, "s", 0) for w in "abcdefg"], SCHEMA)
    twice = [sorted(r["text"] for r in mixing.apply_mix(x).collect()) for x in (same, same.orderBy(F.desc("text")))]
    assert twice[0] == twice[1]
    copies = mixing.apply_mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert copies.text.str.split().str.len().sum() == got.taken.sum()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secrets(spark, docs, none):
    rng = random.Random(11)
    parts = ["password", "Token", "api_key", "secret", '"', "'", " ", ":", "=", "abcdef", "x", "é", "😀", "AKIA", "ABCDEFGH01234567", "0123456789abcdef01234567", "-", "\n", "the"]
    rows = [(i, "".join(rng.choices(parts, k=14))) for i in range(600)]
    for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        t = rows[r["doc_id"]][1]
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    key = "q9Zx7Lm2Vt8Kp4Wd6Rb1Yc3Nf5Hs0Jg"
    rows = [(1, f"use {key} now"), (2, "internationalization_configuration_manager2 is fine"), (3, "see https://example.com/some/long/path/index2.html and user.name+tag@mail.example"), (4, 'token = "abcdef123"'), (5, None)]
    out = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert out == {1: f"markov:4:{4 + len(key)}", 2: "", 3: "", 4: "assign:0:18", 5: ""}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert clean[1] == "use [REDACTED] now" and clean[4] == '[REDACTED]"' and clean[2] == rows[1][1]
    assert secrets.scan(docs).count() == len(TEXTS) + 2 and secrets.scan(none).count() == 0


def test_best_part_equals_brute_force(spark):
    model = secrets.train(secrets.labelled_samples(spark, 500))
    k, rng = len(secrets.ALPHABET) + 1, random.Random(14)
    tokens = ["".join(rng.choices("abcdeABC0123_=/-", k=rng.randint(1, 14))) for _ in range(60)]
    for token, got in zip(tokens, spark.createDataFrame([(t,) for t in tokens], "t string").coalesce(1).select(secrets.best_part(F.col("t"), model).alias("p")).collect()):
        code = [secrets.ALPHABET.index(c) + 1 for c in token]
        steps = [model[a * k + b] for a, b in zip(code, code[1:])]
        sums = {(i, j + 1): sum(steps[i:j]) for i in range(len(steps)) for j in range(i + 1, len(steps) + 1)}
        assert got["p"]["ratio"] == pytest.approx(max([0.0, *sums.values()]), abs=1e-9)
        if got["p"]["ratio"] > 0:
            assert sums[got["p"]["start"], got["p"]["end"]] == pytest.approx(got["p"]["ratio"], abs=1e-9)


def test_random_keys_are_found_and_ordinary_tokens_left(spark):
    rng, letters = random.Random(15), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    alphabets = {"base62": letters, "base64": letters + "+/", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
    rows = [(name, prefix, prefix + "".join(rng.choices(a, k=n))) for name, a in alphabets.items() for n in (32, 40) for prefix in ("", "aws_secret_access_key=", "client_key=", "sk_live_") for _ in range(25)]
    docs = [(i, f"say {t} here.") for i, (*_, t) in enumerate(rows)]
    out = {r["doc_id"]: r for r in secrets.redact(spark.createDataFrame(docs, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})).collect()}
    hits = [len(out[i]["text"]) < len(f"say {prefix} here.") + 16 for i, (_, prefix, _) in enumerate(rows)]
    for name in alphabets:
        own = [h for h, (n, *_) in zip(hits, rows) if n == name]
        assert sum(own) >= 0.95 * len(own), name
    plain = ["a_rather_long_identifier_with_words2", "/usr/share/doc/packages/readme-2024/index3", "https://example.org/2021/05/the-title-of-a-long-article-about-nothing-7", "SomeVeryLongClassNameFactoryBuilder2Test", "MAXIMUM_NUMBER_OF_RETRIES_ALLOWED_3", "2024-01-15_daily_report_final_version2"]
    assert all(r["spans"] == "" for r in secrets.digest(secrets.scan(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string"))).collect())


def test_secrets_in_very_long_texts(spark):
    """A token of a million characters, and tens of thousands of tokens in a text, take seconds."""
    import time

    rng = random.Random(16)
    token = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789ABCDEF", k=1_000_000))
    many = " ".join("password=" + "".join(rng.choices("abcdef", k=8)) for _ in range(40_000))
    began = time.time()
    docs = spark.createDataFrame([(1, token), (2, many)], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert len(got[1]) < 1000 and got[2] == " ".join(["[REDACTED]"] * 40_000)
    assert time.time() - began < 60


def test_licenses(spark, docs, none):
    mit = licenses.TEMPLATES["MIT"][3]
    rows = [(1, "a/LICENSE", f"The licence\n\n{mit}"), (2, "a/b/c/x.py", "import os"), (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (4, "a/b/y.py", "# Released under the MIT License.\ncode"), (5, "z/y.py", "license to kill"), (6, None, None), (7, "a/x.py", ""),
            (8, "z/notes.txt", "Licensed under the MIT license."), (9, "z/w.py", "x = 1"), (10, "q/NOTICE", "Licensed under the MIT license."), (11, "q/COPYING", "Licensed under the MIT license."), (12, "q/r.py", None), (13, "m/x.c", "Licensed under CC BY-SA 4.0.\nSPDX-License-Identifier: AGPL-3.0-or-later")]
    got = {r["file_id"]: r for r in licenses.inherit(licenses.scan_files(spark.createDataFrame(rows, "file_id long, path string, text string").withColumn("dir", F.lit(1)))).collect()}
    assert {i: r["effective_license"] for i, r in got.items() if i < 13} == {1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0", 4: "MIT", 5: None, 6: None, 7: "MIT", 8: "MIT", 9: None, 10: "MIT", 11: "MIT", 12: "MIT"}
    assert got[2]["inherited_from"] == "a/b" and got[4]["inherited_from"] is None and got[13]["licenses"] == ["AGPL-3.0", "CC-BY-SA-4.0"]
    assert licenses.license_of_documents(docs).count() == len(TEXTS) + 2 and licenses.license_of_documents(none).count() == 0


def test_each_template_is_nearest_to_itself():
    templates = licenses.Templates(1000, {})
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            near = templates.near(licenses.terms(f"// {text} (c) 2024"), 0.6)
            assert max(near, key=near.get) == name


def test_licence_cosines_equal_brute_force(spark):
    """Every line and paragraph against every template by plain vectors, without bounds or postings."""
    import math
    from collections import Counter

    rng = random.Random(17)
    known = [t for texts in licenses.TEMPLATES.values() for x in texts for t in x.split()]
    some = [" ".join(rng.choices(known, k=rng.randint(2, 30))) for _ in range(40)] + [x for t in licenses.TEMPLATES.values() for x in t] + ["the quick brown fox", ""]
    rows = [(i, f"d{i % 3}/{rng.choice(['LICENSE', 'x.c', 'y'])}{i}", "\n".join(rng.choice(some) for _ in range(rng.randint(1, 4))).replace("\n", rng.choice(["\n", "\n\n"]))) for i in range(80)]
    holding = Counter(t for *_, text in rows for t in set(licenses.terms(text)))
    weigh = lambda text: {t: (1 + math.log(c)) * (math.log((len(rows) + 1) / ((holding[t] if t in licenses.VOCABULARY else 0) + 1)) + 1) for t, c in Counter(licenses.terms(text)).items()}
    cosine = lambda a, b: sum(x * b.get(t, 0) for t, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    vectors = [(name, weigh(x)) for name in sorted(licenses.TEMPLATES) for x in licenses.TEMPLATES[name]]
    got = {r["file_id"]: r for r in licenses.scan_files(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    for i, path, text in rows:
        found = set()
        for paragraph in text.split("\n\n"):
            for passage in [*paragraph.split("\n"), *([paragraph] if "\n" in paragraph else [])]:
                if licenses.terms(passage):
                    best = max(round(cosine(weigh(passage), v), 9) for _, v in vectors)
                    if best >= 0.6:
                        found.add(next(name for name, v in vectors if round(cosine(weigh(passage), v), 9) == best))
        assert got[i]["licenses"] == sorted(found), text


def test_pipeline_over_odd_rows(spark, docs, none, tmp_path):
    import corpus_pipeline

    for name, rows in (("some", docs), ("empty", none)):
        rows.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns[:3] == ["doc_id", "start", "length"]
        assert (out.count() > 0) == (name == "some")


def test_pipeline_stages_equal_brute_force(spark, tmp_path, monkeypatch):
    """Each stage's table against plain loops over the table before it."""
    import corpus_pipeline

    rng = random.Random(14)
    words = {"en": "the cat sat on a mat and looked out at rain while people went home to eat supper by their fire".split(), "de": "der hund lief über die straße und bellte laut als es am abend dunkel wurde weil niemand da war".split()}
    texts = [" ".join(rng.choices(words["de" if i % 3 == 0 else "en"], k=rng.randint(30, 90))) for i in range(240)]
    texts = [t + " password = hunter2abc" if i % 11 == 0 else t for i, t in enumerate(texts)]
    texts += [t.replace(" ", "  ") for t in texts[5:45]] + [texts[50]] * 30 + [None, "", "12 34", "... !"]
    rows = [(i, t, "de" if i % 3 == 0 and i < 240 else "en", (None, "a", "b", "c")[i * i % 7 % 4], len(t or "")) for i, t in enumerate(texts)]
    given = spark.createDataFrame(rows, SCHEMA)
    given.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "shared_path", lambda _, name: f"{tmp_path}/{name}")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tables = {name: spark.read.parquet(f"{tmp_path}/{name}").collect() for name, _ in corpus_pipeline.STAGES[:-1]}

    net = language.train(given)
    labels = language.label_texts(net, [t for _, t, *_ in rows])
    told = {r[0] for r, (lang, score) in zip(rows, labels) if lang != "und" and score >= 0.4 and any(c.isalpha() for c in r[1] or "")}
    assert {r["doc_id"] for r in tables["language_id"]} == told == set(range(310))

    fps = {r["doc_id"]: simhash.simhash(r["text"]) for r in tables["language_id"]}
    root = {i: i for i in fps}
    for _ in range(len(fps)):
        new = {i: min(root[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2) for i in fps}
        if new == root:
            break
        root = new
    assert sorted(r["doc_id"] for r in tables["simhash_dedup"]) == sorted(set(root.values()))

    hidden = {r["doc_id"]: ASSIGN.sub("[REDACTED]", r["text"]) for r in tables["simhash_dedup"]}
    assert {r["doc_id"]: r["text"] for r in tables["secret_scan"]} == hidden and sum("[REDACTED]" in t for t in hidden.values()) > 10

    sizes, taken = {}, {}
    for r in tables["secret_scan"]:
        sizes[r["source"] or "~"] = sizes.get(r["source"] or "~", 0) + len(r["text"].split())
    for r in tables["mix_sources"]:
        whole = hidden[r["doc_id"]].split()
        assert r["text"].split() == whole[: len(r["text"].split())]
        taken[r["source"] or "~"] = taken.get(r["source"] or "~", 0) + len(r["text"].split())
        own = [len(x["text"].split()) for x in tables["mix_sources"] if x["doc_id"] == r["doc_id"]]
        assert sum(own) <= 2 * len(whole)
    target = plain_targets(sizes)
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in sizes)

    want, have, sequences = {}, {}, {}
    for r in tables["mix_sources"]:
        ids = ids_of("byte_bpe_50k.json", r["text"], 1)
        want.setdefault(r["doc_id"], []).extend(ids)
    for p in packed:
        have[p["doc_id"]] = have.get(p["doc_id"], 0) + p["length"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert have == {i: len(ids) for i, ids in want.items()}
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048


def test_dedup_keeps_rows_with_repeated_and_null_ids(spark):
    import corpus_pipeline

    rng = random.Random(12)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(60)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (1, texts[4]), (None, texts[5]), (3, texts[5]), (4, texts[5])]
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA), "").collect()
    assert sorted((texts.index(r["text"]), r["doc_id"]) for r in kept if r["doc_id"] is not None) == [(0, 1), (1, 1), (4, 1), (5, 3)]
    assert sorted(texts.index(r["text"]) for r in kept if r["doc_id"] is None) == [2, 3]


def test_quality_equals_its_sql(spark):
    """Over the smallest tables."""
    from pathlib import Path

    import duckdb

    from patternlake.llm import queries

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    out = queries.op3_quality_rules(spark, str(data))
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.ORACLE_SQL['op3_quality_rules']})").fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_documents_inherit_from_notices(spark):
    """A document that says little but a licence stands for its folder's licence file."""
    long = "\n".join(f"line {i} of some other text" for i in range(20))
    rows = [(1, "Hello there.\nThis work is licensed under the GNU General Public License, version 3.", "en", "s"), (2, long, "en", "s"), (3, long, "fr", "s"), (4, f"{long}\nReleased under the MIT License.", "en", "s"), (5, f"{long}\nReleased under the MIT License.", "de", "s"), (6, long, "de", "s"), (7, None, "en", "s")]
    got = {r["doc_id"]: r for r in licenses.license_of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i: r["effective_license"] for i, r in got.items()} == {1: "GPL-3.0", 2: "GPL-3.0", 3: None, 4: "MIT", 5: "MIT", 6: None, 7: "GPL-3.0"}
    assert got[2]["inherited_from"] == "s/en" and got[4]["inherited_from"] is None and got[1]["license_file"] and not got[4]["license_file"]
