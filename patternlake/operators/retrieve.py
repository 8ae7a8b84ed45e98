"""Set-oriented retrieval of patterns, and vector search."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import cut
from .nearest import nearest_vectors  # noqa: F401: part of this module's face
from .patterns import SORTS, score, top_per_type


def combined(sim: Column) -> Column:
    return F.lit(0.6) * sim + F.lit(0.4) * F.greatest(score(), F.lit(0)) / F.lit(10.0)


#: The stored types that a tool asks for, in their order; others ask for their own.
TYPES = {
    "edit": ("Edit", "Write", "MultiEdit"), "bash": ("Bash",), "task": ("Task",), "read": ("Read", "Glob", "Grep"), "grep": ("Grep", "Read", "Glob"), "web": ("WebSearch", "WebFetch"),
}


def types_of(tool: Column) -> Column:
    out = F.array(tool)
    for name, types in TYPES.items():
        out = F.when(tool == name, F.array(*map(F.lit, types))).otherwise(out)
    return out


def with_features(patterns: DataFrame, text: str = "context") -> DataFrame:
    return patterns.withColumn("pf", T.features(F.col(text)))


def scored(queries: DataFrame, patterns: DataFrame, per_type: int) -> DataFrame:
    """Each query (query_id, query, tool_type) with its type's per_type best patterns and sim, their lexical score. Texts are taken apart once each, before they meet."""
    candidates = with_features(top_per_type(patterns, per_type)).select("tool_type", "id", "context", "success", "failure", "rank", "pf")
    asked = queries.withColumn("qf", T.features(F.col("query")))
    return asked.join(candidates, "tool_type").withColumn("sim", T.lexical_score(F.col("qf"), F.col("pf"))).drop("qf", "pf")


def retrieve(queries: DataFrame, patterns: DataFrame, per_type: int = 8, k: int = 3, threshold: float = 0.35) -> DataFrame:
    """For each query (query_id, query, tool_type) the k best of its type's per_type best patterns, if similar enough.

    Patterns are cut to per_type a type before they meet the queries, so the join's larger side stays small.
    """
    met = scored(queries, patterns, per_type).where(F.col("sim") >= threshold).withColumn("score", combined(F.col("sim")))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank", "id"))
    return met.withColumn("place", best).where(F.col("place") <= k).select("query_id", "place", "id", F.round("sim", 6).alias("sim"), F.round("score", 6).alias("score"))


def by_text(queries: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """answer(texts) for queries (query_id, tool, query) whose texts may repeat: each text is asked once, as a query, and its rows (query_id and more) go to all that ask it."""
    texts = cut(queries.select("tool", "query").distinct().withColumn("text_id", F.monotonically_increasing_id()))
    told = answer(texts.withColumnRenamed("text_id", "query_id"))
    names = [c for c in told.columns if c != "query_id"]
    told = cut(told.withColumnRenamed("query_id", "text_id").join(texts, "text_id").select("tool", "query", *names))
    same = F.col("q.tool").eqNullSafe(F.col("t.tool")) & F.col("q.query").eqNullSafe(F.col("t.query"))
    return queries.alias("q").join(hinted(told).alias("t"), same).select("q.query_id", *(f"t.{c}" for c in names))


def inject(queries: DataFrame, patterns: DataFrame, conflicts: DataFrame, per_type: int = 8, k: int = 3, threshold: float = 0.35) -> DataFrame:
    """inject_texts() for queries (query_id, tool, query) whose texts may repeat: each text is asked once."""
    return by_text(queries, lambda texts: inject_texts(texts, patterns, conflicts, per_type, k, threshold))


def inject_blocks(queries: DataFrame, patterns: DataFrame, conflicts: DataFrame, per_type: int = 8, k: int = 3, threshold: float = 0.35) -> DataFrame:
    """injection_blocks() for queries (query_id, tool, query) whose texts may repeat: a text's block is made once, and no query's rows are grouped."""
    return by_text(queries, lambda texts: injection_blocks(inject_texts(texts, patterns, conflicts, per_type, k, threshold), patterns))


def inject_texts(queries: DataFrame, patterns: DataFrame, conflicts: DataFrame, per_type: int = 8, k: int = 3, threshold: float = 0.35) -> DataFrame:
    """Retrieval in full for queries (query_id, tool, query): query_id, place, id, generic.

    A tool's types give per_type best patterns each, in the order of the types, and twice per_type in all. Those that
    are similar enough are ranked by the combined score; where there are more than k, those in conflict with the first
    go; k stay. An empty query takes the first k as they are. Where none is similar enough, the patterns of these types
    (in either case) among the per_type best of all types stand in, with generic true.
    """
    best = top_per_type(patterns, per_type)
    typed = queries.select("query_id", "query", F.posexplode(types_of(F.col("tool"))).alias("order", "tool_type"))
    asked = typed.join(best, "tool_type")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("order", "rank", "id"))
    taken = asked.withColumn("first", first).where(F.col("first") <= 2 * per_type).select("query_id", "query", "id", "first", "success", "failure")
    texts = with_features(best.select("id", "context")).select("id", "pf")
    asks = queries.select("query_id", T.features(F.col("query")).alias("qf"))
    met = taken.join(texts, "id").join(asks, "query_id").withColumn("sim", T.lexical_score(F.col("qf"), F.col("pf"))).drop("qf", "pf")
    empty = F.coalesce(F.col("query"), F.lit("")) == ""
    met = met.where(empty | (F.col("sim") >= threshold)).withColumn("score", F.when(~empty, combined(F.col("sim"))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "first"))
    ranked = met.withColumn("place", place)
    kept = without_conflicts(ranked.where(~empty).select("query_id", "place", "id"), conflicts).unionByName(ranked.where(empty).select("query_id", "place", "id"))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    found = kept.withColumn("place", again).where(F.col("place") <= k)
    top = patterns.where("tool_type <> 'failure'").orderBy(*SORTS["score"]()).limit(per_type).select("id", "tool_type", "success", "failure")
    lower = typed.where(~empty).select("query_id", F.lower("tool_type").alias("lower")).distinct()
    spare = lower.join(F.broadcast(top), F.lower(top["tool_type"]) == F.col("lower")).join(found, "query_id", "left_anti")  # top holds per_type rows
    by_score = F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("success") - F.col("failure")).desc(), F.col("success").desc(), "id"))
    spare = spare.withColumn("place", by_score).where(F.col("place") <= k)
    return found.select("query_id", "place", "id", F.lit(False).alias("generic")).union(spare.select("query_id", "place", "id", F.lit(True)))


def hint(approach: Column) -> Column:
    """An approach "tool - command - description" as advice."""
    parts = F.split(approach, " - ", 3)
    tool, command, last = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    cut = T.byte_truncate
    agent = T.trimmed(F.regexp_replace(command, "^(?:delegating to )+", ""))
    three = F.when(tool == "Bash", F.concat(F.lit("Ran `"), command, F.lit("`: "), cut(last, 60))).when(tool.isin("Edit", "MultiEdit", "Write", "Read", "Glob", "Grep"), cut(last, 80))
    three = three.when(tool == "Task", F.concat(F.lit("Delegated to "), agent, F.lit(": "), cut(last, 50))).otherwise(F.concat(tool, F.lit(": "), cut(last, 70)))
    return F.when(F.size(parts) == 3, three).when(F.size(parts) == 2, cut(command, 80)).otherwise(cut(approach, 80))


def insight(text: Column) -> Column:
    """The last pitfall of a pattern's text, else the last approach as a hint, else its first telling line, else its first line."""
    labels = ("Task:", "Outcome:", "User asked:", "Query:", "Approach:")
    telling = F.filter(T.text_lines(text), lambda x: (F.octet_length(x) > 10) & ~F.rlike(x, F.lit("^(" + "|".join(labels) + ")")))
    last = lambda label, n: F.try_element_at(T.labelled(text, label, n), F.lit(-1))
    pitfall, approach = last("Pitfall:", 11), last("Approach:", 6)
    first = F.get(F.split(text, r"\r?\n"), F.lit(0))
    return F.coalesce(F.concat(F.lit("\u26a0\ufe0f "), T.byte_truncate(pitfall, 100)), hint(approach), T.byte_truncate(F.get(telling, F.lit(0)), 100), T.byte_truncate(first, 80))


def injection_blocks(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """inject()'s rows as the text to show, a row a query: query_id, block, ids. Of equal insights (in either case) a query shows the first. Rates are rounded half to even."""
    rate = F.when(F.col("success") + F.col("failure") > 0, 100.0 * F.col("success") / (F.col("success") + F.col("failure"))).otherwise(50.0)
    shown = found.join(patterns.select("id", "tool_type", "context", "success", "failure"), "id").withColumn("insight", insight(F.col("context")))
    shown = shown.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", F.lower("insight")).orderBy("place"))).where("nth = 1")
    entry = F.concat(F.lit("- **"), "tool_type", F.lit("** (score: "), (F.col("success") - F.col("failure")).cast("string"), F.lit(", "), F.bround(rate, 0).cast("long").cast("string"), F.lit("% success rate)\n  "), "insight", F.lit("\n"))
    folded = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("entry"), "id"))).alias("x"), F.bool_or("generic").alias("generic"))  # k rows a query
    head = F.when(F.col("generic"), "**General patterns (no tech-specific matches found):**").otherwise("**Relevant patterns from previous successful operations:**")
    return folded.select("query_id", F.concat(head, F.lit("\n\n"), F.array_join(F.transform("x", lambda y: y["entry"]), "\n")).alias("block"), F.transform("x", lambda y: y["id"]).alias("ids"))


def warnings(patterns: DataFrame) -> DataFrame:
    """Failure patterns as lines of warning: id, line."""
    return patterns.where("tool_type = 'failure'").select("id", F.concat(F.lit("- \u26a0\ufe0f "), insight(F.col("context"))).alias("line"))


#: By extension the language and further signals that an edit's query names.
EDIT_HINTS = {
    "rs": ("rust", "cargo toml crate"), "ts": ("typescript", "npm node package"), "tsx": ("typescript", "npm node package"), "js": ("javascript", "npm node package"), "jsx": ("javascript", "npm node package"),
    "py": ("python", "pip pytest"), "go": ("golang", "mod"), "rb": ("ruby", "gem"), "java": ("java", "maven gradle"), "cpp": ("cpp", "cmake"), "cc": ("cpp", "cmake"), "cxx": ("cpp", "cmake"), "c": ("c", "cmake"), "h": ("c", "cmake"),
    "md": ("markdown", ""), "json": ("json", "npm node package"), "yaml": ("yaml", ""), "yml": ("yaml", ""), "toml": ("toml", "cargo rust"), "sh": ("shell", "bash"), "bash": ("shell", "bash"),
}
#: By command the signals that a command's query names.
COMMAND_HINTS = {
    "javascript npm node": "npm npx yarn pnpm node deno bun", "rust cargo": "cargo rustc rustup", "python pip": "pip python python3 pytest poetry uv", "golang go": "go", "git": "git gh", "docker container": "docker docker-compose", "build make": "make cmake",
}


def query_text(tool: Column, fields: Column) -> Column:
    """The query of a tool's input, a struct of file_path, command, description, subagent_type."""
    path = F.coalesce(fields["file_path"], F.lit("unknown"))
    ext = T.extension(path)
    pairs = F.create_map(*(F.lit(x) for e, (a, b) in EDIT_HINTS.items() for x in (e, f"{a} {b}")))
    first = F.coalesce(T.first_word(fields["command"]), F.lit(""))
    commands = F.create_map(*(F.lit(x) for hint_, words in COMMAND_HINTS.items() for w in words.split() for x in (w, hint_)))
    told = F.coalesce(fields["description"], F.lit(""))
    bash = F.concat(F.lit("Bash "), first, F.lit(" "), F.coalesce(F.try_element_at(commands, first), F.lit("")), F.when(told != "", F.concat(F.lit(" "), told)).otherwise(""))
    return (
        F.when(tool == "edit", F.concat(F.lit("Editing "), ext, F.lit(" "), F.coalesce(F.try_element_at(pairs, ext), F.concat(ext, F.lit(" "))), F.lit(" file "), T.file_name(path)))
        .when(tool == "bash", bash)
        .when(tool == "task", F.concat(F.lit("Agent: "), F.coalesce(fields["subagent_type"], F.lit("unknown")), F.lit(" - "), told))
        .when(tool == "read", F.concat(F.lit("Reading "), T.file_name(F.coalesce(fields["file_path"], F.lit("")))))
        .when(tool == "web", F.lit("Web search"))
        .otherwise(F.concat(F.lit("Tool: "), tool))
    )


def term_scores(queries: DataFrame, texts: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """query_id, id, sim: each of a stated set of queries (query_id, query) against all texts (id, text) that share a term with it, by weighted terms (term_match's first part).

    Texts' terms are counted within their rows and meet the queries' in an inverted index; pairs without a common term,
    whose score is 0, are never made. Texts are dealt to tasks by id before that, so that pairs, of which there are far
    more than texts, are summed where they are made: they aren't shuffled, and none is written.
    """
    weight = F.col("x.n") * T.term_weight(F.col("x.term"))
    # Without outer, Spark would count terms once more, to filter texts that have none; null meets nothing.
    parts = lambda df, name: df.select("*", F.explode_outer("terms").alias("x")).select(*(c for c in df.columns if c != "terms"), F.col("x.term").alias("term"), weight.alias(name))
    terms = lambda text: T.counted(T.tokens(F.col(text))).alias("terms")
    asked = parts(queries.select("query_id", terms("query")), "q")
    norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.pow("q", F.lit(2)))).alias("norm"))
    first = F.filter(F.slice(T.space_words(F.lower("query")), 1, 5), lambda w: F.octet_length(w) >= 4)
    asks = cut(norms.join(queries.select("query_id", T.tech_stack(F.col("query")).alias("a"), first.alias("first")), "query_id"))
    rows = dealt(texts.select("id", "text"), "id", "text")
    stack = T.tech_stack(F.col("text"))
    dots = parts(rows.select("id", stack.alias("b"), terms("text")), "t").join(hinted(cut(asked), max_bytes), "term").groupBy("query_id", "id", "b").agg(F.sum(F.col("q") * F.col("t")).alias("dot"))
    known = (F.col("a") != "unknown") & (F.col("b") != "unknown")
    factor = F.when(known & (F.col("a") == F.col("b")), 1.5).when(known, 0.3).otherwise(1.0)
    met = dots.join(hinted(asks, max_bytes), "query_id").select("query_id", "id", (F.col("dot") / F.col("norm") * factor).alias("sim"), F.when(known & (F.col("a") != F.col("b")), F.col("first")).alias("first"))
    if not asks.where("a <> 'unknown'").isEmpty():
        # Only where stacks differ does a text count beside its terms.
        said = rows.where(stack != "unknown").select(F.col("id").alias("said"), F.lower("text").alias("low"))
        common = F.exists("first", lambda w: F.contains(F.col("low"), w))
        sim = F.when(F.col("first").isNull() | common, F.col("sim")).otherwise(0.015)
        met = met.join(said, (F.col("id") == F.col("said")) & F.col("first").isNotNull(), "left").withColumn("sim", sim)
    return met.select("query_id", "id", F.round("sim", 4).alias("sim"))


def hinted(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """A broadcast hint where df's rows are measured to take at most max_bytes, about twice their length as JSON."""
    size = df.agg(F.sum(2 * F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= max_bytes else df


def dealt(df: DataFrame, key: str, text: str, task_bytes: int = 16 << 20) -> DataFrame:
    """df dealt by key to so many tasks that each holds about task_bytes of text: what a task then groups by key and more stays there, and grows no further with the table."""
    size = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes)), key)


def first_overlap(texts: DataFrame, patterns: DataFrame, min_shared: int = 2, max_bytes: int = 64 << 20) -> DataFrame:
    """query_id, id, shared: of patterns (id, context, rank) the first that shares min_shared distinct words of 3 bytes or more with a text (query_id, query); texts without one are left out.

    Words meet in an inverted index. Texts are dealt to tasks by their bytes, so that a task's counts are bounded.
    """
    own = lambda df, key, text: df.select(*key, F.explode(T.long_words(F.col(text))).alias("word"))
    met = own(dealt(texts.select("query_id", "query"), "query_id", "query"), ["query_id"], "query").join(hinted(own(patterns, ["rank", "id"], "context"), max_bytes), "word")
    shared = met.groupBy("query_id", "rank", "id").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    return shared.groupBy("query_id").agg(F.min(F.struct("rank", "id", "shared")).alias("first")).select("query_id", "first.id", "first.shared")


def without_conflicts(candidates: DataFrame, conflicts: DataFrame, gate: int = 4) -> DataFrame:
    """candidates (query_id, place, id): where a query has more than gate of them, those in conflict with its first go."""
    sized = candidates.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    firsts = sized.where((F.col("place") == 1) & (F.col("n") > gate)).select("query_id", F.col("id").alias("top"))
    bad = firsts.join(conflicts, firsts["top"] == conflicts["id"]).select("query_id", F.col("other").alias("id"))
    return sized.drop("n").join(bad, ["query_id", "id"], "left_anti").select("query_id", "place", "id")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(x: Column) -> Column:
    """x at length 1; null where its length is below 1e-10."""
    size = F.sqrt(dot(x, x))
    return T.let(size, lambda n: F.when(n > 1e-10, F.transform(x, lambda v: v.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 1e-10), dot(a, b) / size).otherwise(0.0)


def with_context(near: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Of each query's nearest (query_id, id, place), of which more than k were sought, the first k that rows (id) still have, with rows' columns."""
    met = near.join(rows, "id")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("place") <= k)


#: Fixed values of the public FNV-1a hash and of a linear congruential generator.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407


def fnv1a(texts: list[str], states: np.ndarray) -> np.ndarray:
    """FNV-1a of each text, each from its own state on; a state goes through all texts' bytes at one place together."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, data = (np.cumsum(sizes) - sizes)[order], np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    left = np.cumsum(np.bincount(sizes)[::-1])[::-1] if len(sizes) else sizes  # how many texts have so many bytes
    h = states[order]
    for at, n in enumerate(left[1:].tolist()):
        h[:n] = (h[:n] ^ data[starts[:n] + at]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def hash_embed(dimensions: int = 384):
    """Arrow UDF text -> array<float>: each token and each pair of neighbours adds a pseudo-random vector seeded by its hash; unit length, or zeros without tokens."""
    step_a, step_c = np.empty(dimensions, np.uint64), np.empty(dimensions, np.uint64)
    a, c = 1, 0
    for i in range(dimensions):  # the generator's state after i + 1 steps is a * seed + c
        a, c = a * MULTIPLIER % 2**64, (c * MULTIPLIER + INCREMENT) % 2**64
        step_a[i], step_c[i] = a, c

    def total(hashes: np.ndarray) -> np.ndarray:
        """Sum of the vectors: 2 * state / 2**64 - 1 in each dimension, by the states' upper halves, whose sum is exact."""
        upper, held = np.zeros(dimensions, np.uint64), np.empty((64, dimensions), np.uint64)
        for lo in range(0, len(hashes), 64):  # few enough to stay in the processor's cache
            part = held[: len(hashes[lo : lo + 64])]
            np.multiply(hashes[lo : lo + 64, None], step_a, out=part)
            part += step_c
            part >>= np.uint64(32)
            upper += part.sum(axis=0)
        return upper / 2.0**31 - len(hashes)

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> np.ndarray:
            words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if len(w.encode()) > 1]
            firsts = fnv1a(words, np.full(len(words), FNV_OFFSET, np.uint64))
            v = total(np.concatenate([firsts, fnv1a([f"_{w}" for w in words[1:]], firsts[:-1])]))
            size = float(np.linalg.norm(v))
            return (v / size if size > 1e-10 else v).astype(np.float32)

        return texts.map(one)

    return embed


#: Tools whose stored type has another name, hits by vector, candidates by type, lines shown and the score they must pass.
RENAMED = {"edit": "Edit", "bash": "Bash", "task": "Task", "read": "Read"}
BY_VECTOR, BY_TYPE, SHOWN, PASSED = 5, 10, 3, 0.35


def input_query(tool: Column, raw: Column) -> Column:
    """What a tool's raw JSON input asks for: its command's first word, else its file; nested inputs go first."""
    from .learn import field

    def told(prefix: str) -> Column:
        command, path = field(raw, f"{prefix}command"), field(raw, f"{prefix}file_path")
        bash = F.concat(F.lit("Bash "), F.coalesce(T.first_word(command), F.lit("")))
        return F.when(command.isNotNull(), bash).when(path.isNotNull(), F.concat(F.lit("Editing "), T.extension(path), F.lit(" file "), T.file_name(path)))

    return F.coalesce(told("input."), told(""), F.concat(F.lit("Tool: "), tool))


def first_line(text: Column, n: int = 100) -> Column:
    """A text's first line in n bytes, with dots where it is longer."""
    line = F.get(F.split(text, r"\r?\n"), F.lit(0))
    return F.when(F.octet_length(line) <= n, line).otherwise(F.concat(T.byte_truncate(line, n - 3), F.lit("...")))


def two_stage(asks: DataFrame, patterns: DataFrame, vectors: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Retrieval in two stages for asks (query_id, tool, input), a stated set: query_id, place, id, tool_type, score, rate, line.

    With vectors (id, v) of patterns and asked (query_id, q) of the asks, an ask's BY_VECTOR nearest patterns are its
    hits, whatever their type, with their id as score. Asks without a hit get the first SHOWN of their type's BY_TYPE
    best that score above PASSED, with their counters' difference as score. rate is in percent, 0 without uses.
    Conflicts are not asked.
    """
    share = F.when(F.col("success") + F.col("failure") > 0, 100.0 * F.col("success") / (F.col("success") + F.col("failure"))).otherwise(0.0)
    told = (F.col("tool_type"), F.bround(share, 0).cast("long").alias("rate"), first_line(F.col("context")).alias("line"))
    hits = None
    if vectors is not None and asked is not None:
        near = nearest_vectors(asked.join(asks.select("query_id"), "query_id", "left_semi"), vectors, 2 * BY_VECTOR)
        hits = with_context(near, patterns, BY_VECTOR).select("query_id", "place", "id", *told[:1], F.col("id").alias("score"), *told[1:])
        asks = asks.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    kind = F.col("tool")
    for name, stored in RENAMED.items():
        kind = F.when(F.col("tool") == name, stored).otherwise(kind)
    # Equal asks are scored once.
    typed = asks.select("query_id", kind.alias("tool_type"), input_query(F.col("tool"), F.col("input")).alias("query"))
    best = hinted(with_features(top_per_type(patterns, BY_TYPE)).select("tool_type", "id", "context", "success", "failure", "rank", "pf"))
    met = typed.select("tool_type", "query").distinct().withColumn("qf", T.features(F.col("query"))).join(best, "tool_type").where(T.lexical_score(F.col("qf"), F.col("pf")) > PASSED)
    place = F.row_number().over(Window.partitionBy("tool_type", "query").orderBy("rank", "id"))
    shown = met.withColumn("place", place).where(F.col("place") <= SHOWN).select("query", "place", "id", *told[:1], score().alias("score"), *told[1:])
    found = typed.join(shown, ["tool_type", "query"]).select("query_id", "place", "id", "tool_type", "score", "rate", "line")
    return found if hits is None else hits.unionByName(found)


def two_stage_block(found: DataFrame, asks: DataFrame, tag: str = "context") -> DataFrame:
    """query_id, text: what is shown before each ask's input, in a tag; the input alone where nothing is found."""
    line = F.concat(F.lit("- **"), "tool_type", F.lit("** (score: "), F.col("score").cast("string"), F.lit(", "), F.col("rate").cast("string"), F.lit("% success rate)\n  "), "line")
    folded = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("x"))  # BY_VECTOR rows at most
    block = F.concat(F.lit(f"<{tag}>\n**Relevant patterns from previous successful operations:**\n\n"), F.array_join(F.transform("x", lambda y: y["line"]), "\n\n"), F.lit(f"\n</{tag}>\n\n"))
    return asks.join(folded, "query_id", "left").select("query_id", F.concat(F.coalesce(block, F.lit("")), "input").alias("text"))
