"""Patterns learned from tool calls and failed results of sessions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import cut

#: By category of commands their names; other commands are their own category.
FAMILIES = {
    "cargo": "cargo rustc rustup rustfmt", "npm": "npm npx yarn pnpm node deno bun", "python": "pip pip3 python python3 pytest poetry uv conda", "go": "go", "git": "git gh", "docker": "docker docker-compose podman", "make": "make cmake ninja",
    "shell": "ls cd cat mkdir rm cp mv grep find sed awk",
}
#: By extension the words that an edit's context names.
STACK_WORDS = {
    "rs": "rust cargo", "ts": "typescript npm node", "tsx": "typescript npm node", "js": "javascript npm node", "jsx": "javascript npm node", "py": "python pip", "go": "golang", "rb": "ruby", "java": "java maven",
    "sh": "shell bash", "bash": "shell bash", "json": "json config", "toml": "toml rust cargo", "yaml": "yaml config", "yml": "yaml config", "md": "markdown docs",
}
#: Tools whose calls make patterns, and the least bytes of a call's context.
LEARNED, LEAST_CONTEXT = ("Edit", "Write", "MultiEdit", "Bash", "Task", "Read", "Grep", "Glob"), 10
#: Cues of an error worth learning from, and what tells output that isn't.
CUES = ("error:", "failed:", "cannot find", "no such file", "permission denied", "command not found", "syntax error", "type error", "does not exist", "undefined", "not found")
PRINTS = ("console.log", "console.err", "print(")
ADVICE = "Verify this approach won't hit the same error"
FAILURES = 3  # failure patterns a session


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for item in pairs.items() for x in item))


def parsed_field(parsed: Column, *names: str) -> Column:
    """field() of an input that is parsed already."""
    text = lambda rest: lambda own: F.when(own.isNull(), rest).when(F.schema_of_variant(own) == "STRING", own.cast("string"))
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = T.let(F.try_variant_get(parsed, f"$.{name}", "variant"), text(out))
    return out


def field(tool_input: Column, *names: str) -> Column:
    """Of some fields of a JSON input the first that is there, if it is a string; null for numbers, objects and null."""
    return T.let(F.try_parse_json(tool_input), lambda parsed: parsed_field(parsed, *names))


def category(tool: Column, tool_input: Column) -> Column:
    """Family of a command, extension of a file, or agent; null without one."""
    return T.let(F.try_parse_json(tool_input), lambda parsed: _category(tool, parsed))


def _category(tool: Column, parsed: Column) -> Column:
    families = literal_map({w: family for family, words in FAMILIES.items() for w in words.split()})
    command = T.let(T.first_word(parsed_field(parsed, "command")), lambda word: F.coalesce(F.try_element_at(families, word), word))
    found = F.when(tool == "Bash", command).when(tool.isin("Edit", "Write", "MultiEdit"), T.extension(parsed_field(parsed, "file_path")))
    found = found.when(tool.isin("Read", "Glob"), T.extension(parsed_field(parsed, "file_path", "path"))).when(tool == "Task", parsed_field(parsed, "subagent_type"))
    return T.let(found, lambda x: F.when(x != "", x))


def context(tool: Column, tool_input: Column, path_too: bool = False) -> Column:
    """What a call does, in words. An edit's file is told by file_path, and with path_too by path where that is missing, as reflection reads it. An input is parsed once."""
    return T.let(F.try_parse_json(tool_input), lambda parsed: _context(tool, parsed, path_too))


def _context(tool: Column, parsed: Column, path_too: bool) -> Column:
    get = lambda default, *names: F.coalesce(parsed_field(parsed, *names), F.lit(default))
    cut, join = T.byte_truncate, lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    signs = lambda ext: join(ext, " ", F.coalesce(F.try_element_at(literal_map(STACK_WORDS), ext), F.lit("")))
    changed = lambda path, old: F.when(old != "", join(signs(T.extension(path)), " editing ", T.file_name(path), " (replacing '", old, "')")).otherwise(join(signs(T.extension(path)), " writing to ", T.file_name(path)))
    edit = T.let(get("unknown", "file_path", *(("path",) if path_too else ())), lambda path: T.let(cut(get("", "old_string"), 40), lambda old: changed(path, old)))
    ran = lambda command, told: F.when(told != "", join(F.coalesce(T.first_word(command), F.lit("cmd")), " - ", cut(told, 60))).otherwise(join("running '", cut(command, 80), "'"))
    bash = T.let(get("unknown command", "command"), lambda command: T.let(get("", "description"), lambda told: ran(command, told)))
    looked = lambda where, sought: F.when(sought != "", join("searching for '", cut(sought, 30), "' in ", where)).when(where != "", join("reading ", where)).otherwise("exploring codebase")
    read = T.let(T.file_name(get("", "file_path", "path")), lambda where: T.let(get("", "pattern"), lambda sought: looked(where, sought)))
    return (
        F.when(tool.isin("Edit", "Write", "MultiEdit"), edit).when(tool == "Bash", bash).when(tool.isin("Read", "Glob", "Grep"), read).when(tool == "Task", join("delegating to ", get("agent", "subagent_type"), " - ", cut(get("", "description"), 60)))
        .when(tool == "TodoWrite", "updating task list").when(tool.isin("WebSearch", "WebFetch"), join("searching web: ", cut(get("", "query", "url"), 60))).otherwise(join("using ", tool, " tool"))
    )


def is_noise(text: Column) -> Column:
    """Whether a result is code or formatting and not a message: over a quarter of its bytes' number are digits and margins, or it prints, or is a tool's own error, or begins like a list."""
    low = F.lower(text)
    signs = F.length(text) - F.length(F.regexp_replace(text, "[0-9→│]", ""))
    return (signs > F.floor(F.octet_length(text) / 4)) | T.any_of(low, PRINTS) | (F.contains(low, F.lit("<tool_use_error>")) & ~F.contains(low, F.lit("command"))) | F.rlike(text, F.lit("^[#*-]"))


def error_message(text: Column) -> Column:
    """The first line of a result that has a cue and, cleaned, is long enough and no noise, in 120 bytes; null without one."""
    clean = lambda x: T.let(F.regexp_replace(x, "^.*?(?=Exit code)", ""), lambda y: F.when(F.contains(y, F.lit("→")), T.trimmed(F.regexp_replace(y, "^[^→]*→", ""))).otherwise(y))
    told = F.filter(T.text_lines(text), lambda x: ~(F.rlike(x, F.lit("^[0-9]")) & F.contains(x, F.lit("→"))) & (F.octet_length(x) >= 15) & T.any_of(F.lower(x), CUES))
    good = F.filter(F.transform(told, clean), lambda x: (F.octet_length(x) >= 20) & ~is_noise(x))
    return F.when(~is_noise(text), T.byte_truncate(F.get(good, F.lit(0)), 120))


PATTERN = ("hash", "tool_type", "category", "context", "success", "failure")


def call_patterns(calls: DataFrame, uses: Column | None = None) -> DataFrame:
    """calls (session_id, seq, user_query, tool_name, tool_input): a success pattern for each call that tells enough, with session_id and seq. uses tells how often a row of calls was made, else once."""
    uses = F.lit(1) if uses is None else uses
    task, tool, done = T.task_category(F.col("user_query")), F.col("tool_name"), context(F.col("tool_name"), F.col("tool_input"))
    text = F.concat(F.lit("Task: "), task, F.lit("\nApproach: "), tool, F.lit(" - "), done, F.lit("\nOutcome: Success"))
    rows = calls.where(tool.isin(*LEARNED) & (F.octet_length(done) >= LEAST_CONTEXT)).select("session_id", "seq", tool.alias("tool_type"), category(tool, F.col("tool_input")).alias("category"), text.alias("context"), uses.alias("uses"))
    return rows.select("session_id", "seq", F.md5(F.col("context").cast("binary")).alias("hash"), "tool_type", "category", "context", F.col("uses").cast("long").alias("success"), F.lit(0).cast("long").alias("failure"))


def failure_patterns(results: DataFrame) -> DataFrame:
    """results (session_id, seq, user_query, content, is_error): of each session's failed results the first FAILURES that have a message, as failure patterns."""
    bad = results.where(F.col("is_error") | F.contains(F.lower("content"), F.lit("error")))
    # Exploded, a message is made once; a filter would make it again.
    bad = bad.select("session_id", "seq", "user_query", F.explode(F.array_compact(F.array(error_message(F.col("content"))))).alias("message"))
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))  # a session's failures
    text = F.concat(F.lit("Task: "), T.task_category(F.col("user_query")), F.lit("\nPitfall: "), "message", F.lit(f"\nAdvice: {ADVICE}"))
    rows = bad.withColumn("nth", nth).where(F.col("nth") <= FAILURES).select("session_id", "seq", text.alias("context"))
    return rows.select("session_id", "seq", F.md5(F.col("context").cast("binary")).alias("hash"), F.lit("failure").alias("tool_type"), F.lit(None).cast("string").alias("category"), "context", F.lit(0).cast("long").alias("success"), F.lit(1).cast("long").alias("failure"))


def distinct_patterns(patterns: DataFrame, dedup: str = "first") -> DataFrame:
    """One row a hash: the first by session and seq, whose counters count once ('first'), or with the counters of all ('sum'). Combined before the shuffle."""
    order = F.struct("session_id", "seq")
    first = F.min_by(F.struct(*PATTERN), order).alias("p")
    if dedup == "first":
        return patterns.groupBy("hash").agg(first).select("p.*")
    sums = patterns.groupBy("hash").agg(first, F.sum("success").alias("s"), F.sum("failure").alias("f"))
    return sums.select("hash", "p.tool_type", "p.category", "p.context", F.col("s").alias("success"), F.col("f").alias("failure"))


def upsert_patterns(table: DataFrame, news: DataFrame, now: str) -> DataFrame:
    """table (PATTERN's columns and last_used) with news: counters of a known hash add up and it is used now; a new one was never used."""
    both = table.select(*PATTERN, "last_used", F.lit(0).alias("age")).unionByName(news.select(*PATTERN, F.lit(None).cast("timestamp").alias("last_used"), F.lit(1).alias("age")))
    kept = F.min_by(F.struct("tool_type", "category", "context", "last_used"), "age").alias("p")
    out = both.groupBy("hash").agg(kept, F.sum("success").alias("success"), F.sum("failure").alias("failure"), F.count_distinct("age").alias("ages"))
    used = F.when(F.col("ages") == 2, F.lit(now).cast("timestamp")).otherwise(F.col("p.last_used"))
    return out.select("hash", "p.tool_type", "p.category", "p.context", "success", "failure", used.alias("last_used"))


def flat_calls(trajectories: DataFrame) -> DataFrame:
    """Tool calls of trajectories as rows (session_id, seq, user_query, tool_name, tool_input)."""
    return trajectories.select("session_id", "user_query", F.posexplode("tool_calls").alias("seq", "x")).select("session_id", "seq", "user_query", "x.tool_name", "x.tool_input")


def flat_results(trajectories: DataFrame) -> DataFrame:
    return trajectories.select("session_id", "user_query", F.posexplode("tool_results").alias("seq", "x")).select("session_id", "seq", "user_query", "x.content", "x.is_error")


def found_patterns(calls: DataFrame, results: DataFrame, dedup: str = "first") -> DataFrame:
    """distinct_patterns() of call_patterns() and failure_patterns(). Equal calls of equal queries are taken apart once: their first by session and seq stands for all."""
    same = calls.where(F.col("tool_name").isin(*LEARNED)).groupBy("user_query", "tool_name", "tool_input").agg(F.min(F.struct("session_id", "seq")).alias("first"), F.count("*").alias("n"))
    once = cut(same.select("first.session_id", "first.seq", "user_query", "tool_name", "tool_input", "n"))  # or what is asked of a text would be asked of every call
    good = call_patterns(once, F.col("n") if dedup == "sum" else None)
    return distinct_patterns(good.unionByName(failure_patterns(results)), dedup)


def learn_calls(calls: DataFrame, results: DataFrame, table: DataFrame, now: str, dedup: str = "first") -> DataFrame:
    """The pattern table after learning from calls and results, all of them."""
    return upsert_patterns(table, found_patterns(calls, results, dedup), now)


def learn(trajectories: DataFrame, table: DataFrame, now: str, dedup: str = "first") -> DataFrame:
    """The pattern table after learning from trajectories, all of them."""
    return learn_calls(flat_calls(trajectories), flat_results(trajectories), table, now, dedup)


def relearn(calls: DataFrame, results: DataFrame, table: DataFrame, now: str) -> DataFrame:
    """What calls and results teach from the start: no row of table stays. Edges are not touched."""
    return learn_calls(calls, results, table.limit(0), now)


def first_matches(best: DataFrame, per_type: int, words: str = "words") -> DataFrame:
    """Ranked patterns (id, tool_type, context, rank) folded to a row a type: tool_type, candidates (id, words), the per_type best in order."""
    own = best.where(F.col("rank") <= per_type).select("tool_type", F.struct("rank", "id", T.long_words(F.col("context")).alias(words)).alias("x"))
    return own.groupBy("tool_type").agg(F.array_sort(F.collect_list("x")).alias("candidates"))  # per_type rows a type


def matching(call: Column, candidates: Column, min_shared: int = 2) -> Column:
    """id of the first of some candidates that shares min_shared words with a call's context; null without one."""
    own = T.long_words(context(call["tool_name"], call["tool_input"]))
    hit = T.let(own, lambda w: F.filter(candidates, lambda c: F.size(F.array_intersect(w, c["words"])) >= min_shared))
    return F.get(hit, F.lit(0))["id"]


def shared_patterns(trajectories: DataFrame, patterns: DataFrame, calls: int = 3, per_type: int = 10) -> DataFrame:
    """Occurrences (a, b, seq, ok) of pairs of patterns (id, tool_type, context, success, failure) that a trajectory's first calls match, each its first match of its type's per_type best.

    Each pair of calls counts, with the smaller id first; a pattern makes no pair with itself. ok is whether the
    trajectory succeeded, by judged(). seq orders by session, then call and later call. Each distinct call is matched
    once; trajectories look its match up and aren't taken apart, by a broadcast where matches are measured to be small.
    """
    from .patterns import top_per_type
    from .reflect import judged
    from .retrieve import hinted

    best = hinted(cut(first_matches(top_per_type(patterns, per_type), per_type)))
    told = judged(trajectories).select("session_id", "success", F.slice("tool_calls", 1, calls).alias("c"))
    asked = cut(told.select(F.explode("c").alias("call")).select("call.tool_name", "call.tool_input").distinct())
    found = asked.join(best, F.col("tool_name") == F.col("tool_type")).select("tool_name", "tool_input", matching(F.struct("tool_name", "tool_input"), F.col("candidates")).alias("m"))
    found = hinted(cut(found).where("m is not null"))
    for i in range(calls):
        call, own = F.get("c", F.lit(i)), found.select(F.col("tool_name").alias("t"), F.col("tool_input").alias("u"), F.col("m").alias(f"m{i}"))
        told = told.join(own, (call["tool_name"] == F.col("t")) & call["tool_input"].eqNullSafe(F.col("u")), "left").drop("t", "u")
    places = [(i, j) for i in range(calls) for j in range(i + 1, calls)]
    # A call without a match doesn't stand between the others.
    pairs = F.array(*(F.struct(F.least(f"m{i}", f"m{j}").alias("a"), F.greatest(f"m{i}", f"m{j}").alias("b"), F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"m{i}").isNotNull() & F.col(f"m{j}").isNotNull() & (F.col(f"m{i}") != F.col(f"m{j}"))).alias("is")) for i, j in places))
    made = told.select("session_id", "success", F.explode(F.filter(pairs, lambda x: x["is"])).alias("x"))
    return made.select("x.a", "x.b", F.struct("session_id", "x.i", "x.j").alias("seq"), F.col("success").alias("ok"))


class Learned(NamedTuple):
    """The tables after a cycle of learning, and its row for the log."""

    patterns: DataFrame
    edges: DataFrame
    log: DataFrame


def learn_cycle(trajectories: DataFrame, table: DataFrame, edges: DataFrame, now: str) -> Learned:
    """A cycle of learning in full: patterns of all trajectories go into the table (PATTERN and last_used), edges (a, b, lift, co_occurrences; ids are xxhash64 of a pattern's hash) go on with the pairs of patterns that trajectories share, and the log's row tells how many there were."""
    from ..streaming.accumulate import fold_lift

    known = cut(learn(trajectories, table, now))
    made = cut(shared_patterns(trajectories, known.withColumn("id", F.xxhash64("hash"))))
    counts = trajectories.agg(F.lit("foreground_learning").alias("event_type"), F.count("*").alias("trajectories"), F.coalesce(F.sum(F.size("tool_calls")), F.lit(0)).cast("long").alias("calls"))
    new = known.join(table.select("hash"), "hash", "left_anti").agg(F.count("*").alias("patterns"))
    log = counts.join(F.broadcast(new)).join(F.broadcast(made.agg(F.count("*").alias("edges")))).withColumn("created_at", F.lit(now).cast("timestamp"))  # a row each
    return Learned(known, fold_lift(edges, made, 0), log)


def used_patterns(calls: DataFrame, patterns: DataFrame, per_type: int = 10, min_shared: int = 2) -> DataFrame:
    """For each call (session_id, seq, tool_name, tool_input) the best ranked of its type's per_type patterns (id, tool_type, context, rank) that shares min_shared words with the call's context: session_id, seq, id."""
    own = calls.withColumn("words", T.long_words(context(F.col("tool_name"), F.col("tool_input"))))
    best = patterns.where(F.col("rank") <= per_type).select(F.col("tool_type").alias("tool_name"), "id", "rank", T.long_words(F.col("context")).alias("theirs"))
    met = own.join(best, "tool_name").where(F.size(F.array_intersect("words", "theirs")) >= min_shared)
    return met.groupBy("session_id", "seq").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))
