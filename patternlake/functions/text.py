"""Text functions as Column expressions. Lengths are in bytes where the semantics say so."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without weight in token lists.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must can to of in for on with at by from as it that this these those and or but if then else when where how"
).split()
#: Words that the quick similarity passes over, and those that count twice when they match.
QUICK_STOP_WORDS = ("the", "and", "for", "to", "in", "of", "is", "it")
QUICK_BONUS = ("rs", "js", "ts", "py", "go", "rb", "sh", "tsx", "jsx")
#: By stack, substrings worth 3 and worth 2, in the order in which ties are settled.
STACKS = {
    "rust": ((".rs", "cargo", "rust"), ("toml", "crate")),
    "javascript": ((".js", ".ts", ".tsx", ".jsx", "npm", "node"), ("typescript", "javascript", "yarn", "package.json")),
    "python": ((".py", "python", "pip"), ("pytest", "conda", "venv")),
    "go": ((".go", "golang"), ("go mod", "go.mod")),
    "shell": ((".sh", "bash"), ("shell", "zsh")),
}
#: Term weights; others weigh by length.
TERM_WEIGHTS = {
    3.0: "rs js ts tsx jsx py go rb java cpp c h md json yaml yml toml sh html css sql vue svelte".split(),
    2.5: "rust python javascript typescript golang ruby shell".split(),
    2.0: "bash edit write read grep task glob npm cargo git error fail cannot undef miss invalid null panic".split(),
    1.5: "fix add creat updat delet implement refactor test build run".split(),
}
#: Task categories by words that all must occur (alternatives divided by |), the first that fits counts.
TASKS = (
    ("fix", "type", "error", "Fix type error"), ("fix", "error|bug", "Fix error or bug"), ("add", "feature", "Add new feature"), ("implement", "Implement functionality"), ("refactor", "Refactor code"),
    ("test", "write|add|create", "Write tests"), ("run", "test", "Run tests"), ("debug", "Debug issue"), ("build|compile", "Build/compile project"), ("install|setup", "Install/setup dependencies"),
    ("deploy", "Deploy application"), ("create", "api|endpoint", "Create API endpoint"), ("create", "component", "Create UI component"), ("update|modify", "Update existing code"), ("delete|remove", "Remove code/feature"),
    ("document|docs", "Documentation"), ("config|configure", "Configure settings"), ("migrate", "Migration task"), ("search|find", "Search codebase"), ("read|understand|explain|summarize|analyze|review", "Understand code"),
)
TASK_VERBS = ("add", "create", "fix", "update", "run", "write", "build", "delete", "move", "rename", "check")
TOKEN = r"[\p{IsAlphabetic}\p{N}_-]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is evaluated once: within a lambda, an outer expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def byte_truncate(text: Column, n: int) -> Column:
    """At most n bytes, cut at a character's border."""
    raw = text.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n - i).cast("string")) for i in range(4)]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*cuts))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """After the last dot; the whole string without one."""
    return F.substring_index(path, ".", -1)


def space_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def first_word(text: Column) -> Column:
    return F.get(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), F.lit(0))


def tech_stack(text: Column) -> Column:
    """The stack with most signals, at least 2, or 'unknown'."""
    low = F.lower(text)
    points = {s: F.when(any_of(low, strong), 3).otherwise(0) + F.when(any_of(low, weak), 2).otherwise(0) for s, (strong, weak) in STACKS.items()}
    top = F.greatest(*points.values())
    out = F.when(top < 2, F.lit("unknown"))
    for name, p in points.items():
        out = out.when(p == top, F.lit(name))
    return out


def tokens(text: Column) -> Column:
    """Lower-case terms of 2 bytes or more that aren't stop words, stemmed if longer than 4."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    kept = F.filter(found, lambda t: (F.octet_length(t) >= 2) & ~t.isin(*STOP_WORDS))
    return F.transform(kept, lambda t: F.when(F.octet_length(t) <= 4, t).otherwise(stem(t)))


def stem(word: Column) -> Column:
    n = F.octet_length(word)
    root = F.left(word, F.length(word) - 3)
    undoubled = F.when((F.length(root) >= 2) & (F.right(root, F.lit(1)) == F.left(F.right(root, F.lit(2)), F.lit(1))), F.left(root, F.length(root) - 1)).otherwise(root)
    return (
        F.when((n > 5) & F.endswith(word, F.lit("ing")), undoubled)
        .when((n > 4) & F.endswith(word, F.lit("ed")), F.left(word, F.length(word) - 2))
        .when((n > 3) & F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")), F.left(word, F.length(word) - 1))
        .otherwise(word)
    )


def counted(terms: Column) -> Column:
    """Distinct terms of an array with how often each occurs: (term, n), by term. Sorted runs are counted, so nothing is shuffled."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s: let(starts(s), lambda at: F.transform(at, lambda a, i: F.struct(F.get(s, a).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(s)) - a).cast("long").alias("n"))))
    return let(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<term:string,n:bigint>>")))


def term_weight(term: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for weight, terms in TERM_WEIGHTS.items():
        out = out.when(term.isin(terms), F.lit(weight))
    n = F.octet_length(term)
    return out.when(n >= 8, 1.5).when(n >= 5, 1.2).otherwise(1.0)


def quick_words(query: Column) -> Column:
    """Words of a short query that count."""
    return F.filter(space_words(F.lower(query)), lambda w: (F.octet_length(w) >= 2) & ~w.isin(*QUICK_STOP_WORDS))


def quick_match(words: Column, query_stack: Column, pattern: Column, pattern_stack: Column) -> Column:
    """Share of a short query's words that occur in a pattern (lower case), raised where both are of one tech stack; 0.03 where the stacks differ, 0 without words that count."""
    known = (query_stack != "unknown") & (pattern_stack != "unknown")
    factor = F.when(known & (query_stack == pattern_stack), 1.5).otherwise(1.0)
    total = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.when(F.octet_length(w) >= 4, 2.0).otherwise(1.0))
    hits = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.when(F.contains(pattern, w), F.when(w.isin(*QUICK_BONUS), 2.0).otherwise(1.0)).otherwise(0.0))
    share = F.when(total > 0, F.least(F.least(F.try_divide(hits, total), F.lit(1.0)) * factor, F.lit(2.0))).otherwise(0.0)
    return F.when(pattern == "", 0.0).when(known & (query_stack != pattern_stack), 0.1 * 0.3).otherwise(share)


def quick_score(query: Column, pattern: Column) -> Column:
    return F.when(query == "", 0.0).otherwise(quick_match(quick_words(query), tech_stack(query), F.lower(pattern), tech_stack(pattern)))


def task_category(query: Column) -> Column:
    low = F.lower(query)
    first = F.get(F.split(query, r"\r?\n"), F.lit(0))
    words = space_words(first)
    verb = F.lower(F.get(words, F.lit(0)))
    out = F.when(F.lit(False), F.lit(""))
    for *needs, name in TASKS:
        out = out.when(reduce(lambda a, b: a & b, (any_of(low, need.split("|")) for need in needs)), F.lit(name))
    short = F.array_join(F.slice(words, 1, 4), " ")
    out = out.when((F.size(words) >= 2) & verb.isin(*TASK_VERBS), F.concat(F.upper(F.left(verb, F.lit(1))), F.substring(verb, 2, 100), F.lit(" code/files")))
    return out.when(F.octet_length(short) > 40, F.concat(byte_truncate(short, 40), F.lit("..."))).otherwise(short)


def term_match(query: Column, pattern: Column) -> Column:
    """Weighted term frequencies of a long query against a pattern's, over the query's length alone; both features().

    Raised where both are of one tech stack and lowered where the stacks differ; then 0.015 if none of the query's
    first five words, of 4 bytes or more, occurs in the pattern.
    """
    known = (query["stack"] != "unknown") & (pattern["stack"] != "unknown")
    other = known & (query["stack"] != pattern["stack"])
    factor = F.when(other, 0.3).when(known, 1.5).otherwise(1.0)
    common = F.exists(query["firsts"], lambda w: F.contains(pattern["low"], w))
    # Zipped maps meet by hash; a look-up in a map would walk it for each term.
    products = F.map_values(F.map_zip_with(query["weights"], pattern["weights"], lambda _, x, y: x * y))
    dot = F.aggregate(products, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when(other & ~common, 0.05 * 0.3).otherwise(F.coalesce(F.try_divide(dot, query["norm"]), F.lit(0.0)) * factor)


def term_weights(terms: Column) -> Column:
    """counted() terms as a map of their numbers times their weights."""
    return F.map_from_entries(F.transform(terms, lambda x: F.struct(x["term"], (x["n"] * term_weight(x["term"])).alias("w"))))


def features(text: Column) -> Column:
    """What scoring needs of a text, once for each and not for each pair: low, stack, words, firsts (of the first five words those of 4 bytes or more), weights by term, norm, bytes."""
    low = F.lower(text)
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, w: a + w * w))
    weighed = let(term_weights(counted(tokens(text))), lambda m: F.struct(m.alias("weights"), norm(m).alias("norm")))
    firsts = F.filter(F.slice(space_words(low), 1, 5), lambda w: F.octet_length(w) >= 4)
    return let(weighed, lambda x: F.struct(low.alias("low"), tech_stack(text).alias("stack"), quick_words(text).alias("words"), firsts.alias("firsts"), x["weights"].alias("weights"), x["norm"].alias("norm"), F.octet_length(text).alias("bytes")))


def lexical_score(query: Column, pattern: Column) -> Column:
    """Score of a query against a pattern, both features(): the quick one where the query has fewer than 100 bytes and the pattern fewer than 400, else by weighted terms; 0 without text."""
    quick = quick_match(query["words"], query["stack"], pattern["low"], pattern["stack"])
    slow = term_match(query, pattern)
    empty = (F.coalesce(query["bytes"], F.lit(0)) == 0) | (F.coalesce(pattern["bytes"], F.lit(0)) == 0)
    return F.when(empty, 0.0).when((query["bytes"] < 100) & (pattern["bytes"] < 400), quick).otherwise(slow)


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def text_lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n"), trimmed)


def after(line: Column, label: str) -> Column:
    """What follows a line's label, however often that is repeated."""
    return trimmed(F.regexp_replace(line, f"^(?:{label})+", ""))


def labelled(text: Column, label: str, least: int) -> Column:
    """Of a text's lines that begin with a label what follows, where that has least bytes or more."""
    return F.filter(F.transform(F.filter(text_lines(text), lambda x: F.startswith(x, F.lit(label))), lambda x: after(x, label)), lambda x: F.octet_length(x) >= least)


def long_words(text: Column) -> Column:
    """Distinct words of 3 bytes or more."""
    return F.array_distinct(F.filter(space_words(text), lambda w: F.octet_length(w) >= 3))


def version(text: Column) -> Column:
    """The first three numbers of a version as a struct that orders as versions do; parts that are no numbers are passed over, missing ones are 0."""
    digits = F.filter(F.split(text, r"\."), lambda p: F.rlike(p, F.lit(r"^[0-9]{1,10}$")))
    return F.struct(*(F.coalesce(F.get(digits, F.lit(i)).cast("long"), F.lit(0)).alias(f"v{i}") for i in range(3)))
