"""Secret scan, in DataFrame functions alone.

Base patterns find assignments, access keys and long hexadecimal runs. Beyond them, two character Markov models, one of
random strings and one of ordinary identifiers, trained from labelled samples, are compared on every long token by the
logarithm of their likelihood ratio. The part of a token whose ratio is greatest is found in one pass, so that a name or
prefix before a key doesn't hide it; a part that random strings explain far better than ordinary ones is a secret too.
How much better is told by labelled ordinary samples that the models haven't seen.

All steps take time in proportion to a text's length, but for the logarithm of its number of matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let

#: The base patterns, and by kind the least length of the whole match or, for assign, of its value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: A token that the models score: at least so many characters of this alphabet, with no more of them on either side.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: A secret part is so long at least.
LEAST = 16
CHUNK = 1024  # characters of a text that are copied together
#: Words from which ordinary identifiers are made.
ORDINARY = (
    "the and for with this that from have not are was were which there would about their could other these some them then than time into more"
    " user name value index count list node item table column row file path line text data type class object function method return result error"
    " create update delete insert select request response server client session config option default source target buffer stream channel message"
    " handler manager factory service controller model view template context module package import export number string array length width height"
    " der die und das nicht ist von mit auf ein eine werden haben sich dem les des une dans pour que qui sur avec par pas est sont el los las una"
    " por con para como más pero sus hay estar version length internationalization configuration initialize synchronize implementation performance"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000, first: int = 0) -> DataFrame:
    """n labelled samples (text, random) of either kind, numbered from first: hashes written in Base64, base 62, Base32 and hexadecimal of either case, and identifiers, paths, constants and calls joined from words in the usual cases."""
    ids = spark.range(first, first + n, numPartitions=1)
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.substring(F.base64(F.unhex(digest)), 1, 40)
    kinds = (b64, F.translate(b64, "+/=", "xQ7"), F.translate(b64, "+/=", "xQ7"), F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)), F.translate(F.upper(b64), "+/=01", "XQ723"), F.lower(F.translate(b64, "+/=", "xq7")))
    pick_kind = lambda options: F.get(F.array(*options), F.pmod("id", F.lit(len(options))).cast("int"))
    random = ids.select(pick_kind(kinds).alias("text"))
    all_words = F.split(F.lit(" ".join(ORDINARY)), " ")
    pick = lambda k: F.get(all_words, F.pmod(F.xxhash64("id", F.lit(k)), F.size(all_words)).cast("int"))
    a, b, c, d = pick(1), pick(2), pick(3), pick(4)
    number = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2100)).cast("string")
    joined = (
        F.concat_ws("_", a, b, c, d), F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d)), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("-", a, b, c, number), F.concat_ws("/", a, b, c, d), F.concat(a, b, c, d),
        F.concat(F.initcap(a), F.initcap(b), F.initcap(c), number), F.concat(F.lit("/"), F.concat_ws("/", a, F.concat_ws("-", b, c), F.concat(d, number))), F.concat(F.concat_ws("_", a, b), F.lit("="), F.concat_ws("_", c, d)), F.concat_ws("--", a, b, c, d),
        F.concat_ws("-", number, number, a, b, c),
    )
    return random.withColumn("random", F.lit(True)).unionByName(ids.select(pick_kind(joined).alias("text")).withColumn("random", F.lit(False)))


def codes(text: Column) -> Column:
    """The places of a text's characters in the alphabet, 0 for those that aren't in it."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def pair(c: Column, i: Column) -> Column:
    return F.get(c, i) * (len(ALPHABET) + 1) + F.get(c, i + 1)


def train(samples: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) by the pair a, b; add-half smoothing. Its size is that of the alphabet squared."""
    k = len(ALPHABET) + 1
    coded = samples.where(F.length("text") > 1).select("random", codes(F.col("text")).alias("c"))
    pairs = coded.select("random", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: pair(F.col("c"), i))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o")).collect()  # at most k * k rows
    import math

    table = {x["pair"]: (x["r"], x["o"]) for x in counts}
    firsts = [[sum(table.get(a * k + b, (0, 0))[side] for b in range(k)) for side in (0, 1)] for a in range(k)]
    score = lambda a, b, side: math.log((table.get(a * k + b, (0, 0))[side] + 0.5) / (firsts[a][side] + 0.5 * k))
    return [round(score(a, b, 0) - score(a, b, 1), 4) for a in range(k) for b in range(k)]


def before(x: Column) -> Column:
    """How many letters and digits of a token lie right before its part."""
    return F.length(F.regexp_extract(F.reverse(F.substring(x["token"], F.lit(1), x["start"])), "^[A-Za-z0-9]*", 0))


def after(x: Column) -> Column:
    return F.length(F.regexp_extract(F.substring(x["token"], x["end"] + 1, F.length(x["token"])), "^[A-Za-z0-9]*=*", 0))


def best_part(token: Column, model: list[float]) -> Column:
    """The part of a token whose log-likelihood ratio under the two models is greatest, the earliest of equals: ratio, start, end (exclusive). It may be empty."""
    weights = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to one literal
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("begin"), F.lit(0).alias("at"), F.lit(0.0).alias("best"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(acc: Column, w: Column) -> Column:
        going = F.struct((F.greatest(acc["sum"], F.lit(0.0)) + w).alias("sum"), F.when(acc["sum"] < 0, acc["at"]).otherwise(acc["begin"]).alias("begin"))
        grown = lambda g: F.when(g["sum"] > acc["best"], F.struct(g["sum"].alias("sum"), g["begin"].alias("begin"), (acc["at"] + 1).alias("at"), g["sum"].alias("best"), g["begin"].alias("start"), (acc["at"] + 2).alias("end"))).otherwise(
            F.struct(g["sum"].alias("sum"), g["begin"].alias("begin"), (acc["at"] + 1).alias("at"), acc["best"].alias("best"), acc["start"].alias("start"), acc["end"].alias("end")))
        return let(going, grown)

    steps = let(codes(token), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.get(weights, pair(c, i))))
    return F.aggregate(steps, state, step, lambda acc: F.struct(acc["best"].alias("ratio"), acc["start"].alias("start"), acc["end"].alias("end")))


def threshold(samples: DataFrame, model: list[float], margin: float) -> float:
    """margin times the greatest ratio of a part of the ordinary ones among samples."""
    return margin * (samples.where(~F.col("random")).agg(F.max(best_part(F.col("text"), model)["ratio"]).alias("m")).first()["m"] or 0.0)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums, maxima or the like of an array: of steps that double, as many as it is long, each in one pass over it."""
    def pass_(far: int) -> Callable[[Column], Column]:
        return lambda v: F.when(F.size(v) > far, F.transform(v, lambda x, i: F.when(i >= far, join(F.get(v, i - far), x)).otherwise(x))).otherwise(v)

    for step in range(30):
        values = let(values, pass_(1 << step))
    return values


SPAN = "array<struct<start:int,rank:int,end:int,hit:string,value:string>>"


def spans(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """Where a pattern matches, leftmost first and without overlap, in code points: the text between matches gives the places."""

    def found(hits: Column) -> Column:
        between, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        gone = running(F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit)), lambda a, b: a + b)
        parts = F.arrays_zip(hits.alias("hit"), values.alias("value"), gone.alias("end"))
        return F.transform(parts, lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["hit"].alias("hit"), x["value"].alias("value")))

    return F.when(F.rlike(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)).otherwise(F.array().cast(SPAN))


def outside(found: Column) -> Column:
    """Spans by start, then kind, without those of the models that lie within one of the base patterns."""
    ends = lambda s: running(F.transform(s, lambda x: F.when(x["rank"] < 3, x["end"]).otherwise(0)), F.greatest)
    return let(found, lambda s: let(ends(s), lambda e: F.filter(s, lambda x, i: (x["rank"] < 3) | (i == 0) | (F.get(e, i - 1) < x["end"]))))


def scan(docs: DataFrame, margin: float = 1.1, min_ratio: float = 0.5, n_samples: int = 4000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Find secrets in documents (doc_id, text).

    Returns doc_id, text, base (spans of the base patterns) and found (those and the models'), arrays by start, then
    kind. A token's best part is a secret if it has LEAST characters, a digit and a letter, at least min_ratio as its
    log-likelihood ratio per pair of characters, and in all margin times as much as any of n_samples ordinary samples; it
    takes with it the letters and digits that adjoin it.
    One that lies within a base span adds nothing. n_samples bounds the training samples of either kind. Null
    text counts as empty: no spans. Every row gives one row, repeated ids too; columns named in carry are handed on, others not read.
    """
    spark = docs.sparkSession
    model = train(labelled_samples(spark, n_samples))
    least = threshold(labelled_samples(spark, n_samples, n_samples), model, margin)
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *carry)
    text = F.col("text")
    base = base.select("*", F.filter(spans(text, ASSIGN, 0, 2), lambda x: F.length(x["value"]) >= 6).alias("assign"), spans(text, ACCESS, 1).alias("access"), spans(text, HEX, 2).alias("hex"), spans(text, TOKEN, 3).alias("tokens"))
    part = lambda x: let(best_part(x["hit"], model), lambda p: F.struct(x["start"].alias("at"), p["start"].alias("start"), p["end"].alias("end"), x["hit"].alias("token"), F.substring(x["hit"], p["start"] + 1, p["end"] - p["start"]).alias("hit"), p["ratio"].alias("ratio")))
    parts = F.transform(F.filter("tokens", lambda x: F.rlike(x["hit"], F.lit("[0-9]")) & F.rlike(x["hit"], F.lit("[A-Za-z]"))), part)
    long_ = lambda x: F.length(x["hit"])
    random = F.filter(parts, lambda x: (long_(x) >= LEAST) & (x["ratio"] >= least) & (x["ratio"] >= min_ratio * (long_(x) - 1)) & F.rlike(x["hit"], F.lit("[0-9]")) & F.rlike(x["hit"], F.lit("[A-Za-z]")))
    random = F.transform(random, lambda x: F.struct((x["at"] + x["start"] - before(x)).alias("start"), F.lit(3).alias("rank"), (x["at"] + x["end"] + after(x)).alias("end"), x["hit"], x["hit"].alias("value")))
    base = base.select("doc_id", "text", *carry, F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.when(F.size("tokens") > 0, random).otherwise(F.array().cast(SPAN)).alias("random"))
    return base.select("doc_id", "text", *carry, "base", F.when(F.size("random") > 0, outside(F.array_sort(F.concat("base", "random")))).otherwise(F.col("base")).alias("found"))


def written(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    kind = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["rank"])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def between(text: Column, found: Column) -> Column:
    """The parts of a text that lie outside of all spans (by start), first and last included, empty ones too; overlapping spans go together. Each part is copied from the few chunks that hold it."""
    last = F.length(text)
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    part = lambda c, a, b: F.substring(F.array_join(F.slice(c, F.floor(a / CHUNK).cast("int") + 1, F.floor(b / CHUNK).cast("int") - F.floor(a / CHUNK).cast("int") + 1), ""), a % CHUNK + 1, b - a)
    begins = lambda s, e: F.transform(s, lambda x, i: F.struct(F.when(i > 0, F.get(e, i - 1)).otherwise(0).alias("a"), x["start"].alias("b")))
    gaps = lambda s: let(running(F.transform(s, lambda x: x["end"]), F.greatest), lambda e: F.array_append(F.filter(begins(s, e), lambda g: g["b"] >= g["a"]), F.struct(F.element_at(e, -1).alias("a"), last.alias("b"))))
    return let(found, lambda s: let(chunks, lambda c: F.transform(gaps(s), lambda g: part(c, g["a"], g["b"]))))


def redact(docs: DataFrame, mark: str = "[REDACTED]", **options) -> DataFrame:
    """Documents (doc_id, text, lang, source) with every span replaced by mark; overlapping spans go together. n_chars follows the text; null text becomes empty."""
    scanned = scan(docs, carry=("lang", "source"), **options)
    clean = F.when(F.size("found") == 0, F.col("text")).otherwise(F.array_join(between(F.col("text"), F.col("found")), mark))
    return scanned.select("doc_id", clean.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))
