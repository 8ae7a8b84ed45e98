"""Registered queries of learning, retrieval in full, reflection and consolidation, over tool calls made from events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as E
from ..operators import consolidate as C
from ..operators import graph as G
from ..operators import learn as L
from ..operators import patterns as P
from ..operators import reflect as X
from ..operators import retrieve as R
from ..operators import sessions as N
from ..operators import similar
from ..session import cut, shared_path
from ..sources import appended
from ..streaming import accumulate
from . import catalog as K
from . import views as V
from .registry import query

TOOLS = ("Edit", "Write", "Bash", "Task", "Read", "Grep", "WebSearch", "TodoWrite", "Glob", "MultiEdit")
INPUTS = (
    '{"file_path": "/src/main.rs", "old_string": "let value: String = 123; // this line is longer than forty bytes"}', '{"command": "cargo build --release", "description": "Build the project for release"}', '{"command": "npx jest --watch"}',
    '{"pattern": "fn main", "path": "/src/lib.rs"}', '{"subagent_type": "tester", "description": "Check all of the tests"}', '{"query": "how to write a parser"}', '{"file_path": "/app/App.tsx"}', '{"command": "make all", "file_path": "notes"}', '{}',
    '{"command": "pytest -q", "file_path": "/lib/run.py", "old_string": "return 1"}', '{"url": "https://example.org/docs"}',
    '{"command": 5, "file_path": {"a": 1}, "path": "/src/not/asked.go", "description": 7}', '{"file_path": null, "path": "x.py", "pattern": ["a"]}', '{"command": "git status", "description": null, "subagent_type": 3, "query": {"q": 1}, "url": "u"}',
)
CONTENTS = (
    "Error: cannot find module 'left-pad' - check it", "ok", "123→ error: at line 4", "error[E0308]: mismatched types\n  expected String\nerror: cannot find value `x` in this scope", "Exit code 127\nbash: foo: command not found anywhere here",
    "12→  fatal error: no such file or directory\nplain", "console.log('error: no')", "# error: in a heading of some text", "Traceback\nthread 'main' panicked at src/main.rs error: overflow", "fn main() { error: never }", "short error: x", "1234567890 error: 1234567890", "\t\terror: cannot find the crate `serde`\t", "plain\n \tPermission denied: /etc/shadow\t\nmore",
)
SAID = ("All done, it works.", "Let me try another approach. Let me try again.", "I cannot do that.", "Here it is.", "trying again, then fixed", "")
CALLED = "event_type NOT IN ('error', 'signup')"


def calls(spark, d):
    """Tool calls: session_id, seq, user_query, tool_name, tool_input."""
    e = V.events_k(spark, d).where(CALLED)
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("session_id"), F.col("event_id").alias("seq"), F.concat(V.pick(V.TASKS, "user_id"), F.lit(" "), V.pick(V.FILES, "user_id div 3")).alias("user_query"),
        V.pick(TOOLS, "k").alias("tool_name"), V.pick(INPUTS, "event_id div 3").alias("tool_input"),
    )


def results(spark, d):
    """Tool results: session_id, seq, user_query, content, is_error."""
    e = V.events_k(spark, d).where(f"not ({CALLED})")
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("session_id"), F.col("event_id").alias("seq"), F.concat(V.pick(V.TASKS, "user_id"), F.lit(" "), V.pick(V.FILES, "user_id div 3")).alias("user_query"),
        V.pick(CONTENTS, "event_id div 5").alias("content"), (F.col("event_type") == "error").alias("is_error"),
    )


def trajectories(spark, d):
    """Sessions of up to a user's day, that calls and results are folded into."""
    day = F.date_format("ts", "yyyyMMdd")
    e = V.events_k(spark, d).withColumn("session_id", F.concat(F.lit("u"), "user_id", F.lit("/"), day))
    call, result = F.expr(CALLED), F.expr(f"not ({CALLED})")
    fold = lambda when, *fields: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("event_id", F.struct(*fields).alias("x"))))), lambda y: y["x"])
    rows = e.groupBy("session_id", "user_id").agg(
        fold(call, V.pick(TOOLS, "k").alias("tool_name"), V.pick(INPUTS, "event_id div 3").alias("tool_input")).alias("tool_calls"),
        fold(result, F.col("event_id").cast("string").alias("tool_use_id"), V.pick(CONTENTS, "event_id div 5").alias("content"), ((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)).alias("is_error")).alias("tool_results"),
        F.min("event_id").alias("first"),
    )
    return rows.select("session_id", F.concat(V.pick(V.TASKS, "user_id"), F.lit(" it")).alias("user_query"), V.pick(SAID, "first").alias("assistant_content"), "tool_calls", "tool_results")


SQL_QUERY = f"{V.sql_pick(V.TASKS, 'user_id')} || ' ' || {V.sql_pick(V.FILES, 'user_id // 3')} AS user_query"
SQL_CALLS = V.EVENTS_K + f""", calls AS (SELECT 'u' || user_id AS session_id, event_id AS seq, {SQL_QUERY}, {V.sql_pick(TOOLS, 'k')} AS tool_name, {V.sql_pick(INPUTS, 'event_id // 3')} AS tool_input FROM events_k WHERE {CALLED}),
    results AS (SELECT 'u' || user_id AS session_id, event_id AS seq, {SQL_QUERY}, {V.sql_pick(CONTENTS, 'event_id // 5')} AS content, event_type = 'error' AS is_error FROM events_k WHERE NOT ({CALLED}))"""


def sql_field(i: str, *names: str) -> str:
    out = "NULL"
    for n in reversed(names):
        out = f"CASE WHEN json_exists({i}, '$.{n}') THEN CASE WHEN json_type({i}, '$.{n}') = 'VARCHAR' THEN json_extract_string({i}, '$.{n}') END ELSE {out} END"
    return out


def sql_map(key: str, pairs: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def sql_category(t: str, i: str) -> str:
    word = f"list_filter(string_split_regex({sql_field(i, 'command')}, '\\s+'), lambda w: w <> '')[1]"
    families = {w: family for family, words in L.FAMILIES.items() for w in words.split()}
    ext = lambda *names: f"string_split({sql_field(i, *names)}, '.')[-1]"
    return f"""nullif(CASE WHEN {t} = 'Bash' THEN coalesce({sql_map(word, families)}, {word}) WHEN {t} IN ('Edit', 'Write', 'MultiEdit') THEN {ext('file_path')}
        WHEN {t} IN ('Read', 'Glob') THEN {ext('file_path', 'path')} WHEN {t} = 'Task' THEN {sql_field(i, 'subagent_type')} END, '')"""


def sql_context(t: str, i: str, path_too: bool = False) -> str:
    get = lambda default, *names: f"coalesce({sql_field(i, *names)}, '{default}')"
    path, old, told, command, sought = get("unknown", "file_path", *(("path",) if path_too else ())), f"left({get('', 'old_string')}, 40)", get("", "description"), get("unknown command", "command"), get("", "pattern")
    ext, where = f"string_split({path}, '.')[-1]", f"string_split({get('', 'file_path', 'path')}, '/')[-1]"
    signs = f"{ext} || ' ' || coalesce({sql_map(ext, L.STACK_WORDS)}, '')"
    return f"""CASE WHEN {t} IN ('Edit', 'Write', 'MultiEdit') THEN CASE WHEN {old} <> '' THEN {signs} || ' editing ' || string_split({path}, '/')[-1] || ' (replacing ''' || {old} || ''')' ELSE {signs} || ' writing to ' || string_split({path}, '/')[-1] END
        WHEN {t} = 'Bash' THEN CASE WHEN {told} <> '' THEN string_split({command}, ' ')[1] || ' - ' || left({told}, 60) ELSE 'running ''' || left({command}, 80) || '''' END
        WHEN {t} IN ('Read', 'Glob', 'Grep') THEN CASE WHEN {sought} <> '' THEN 'searching for ''' || left({sought}, 30) || ''' in ' || {where} WHEN {where} <> '' THEN 'reading ' || {where} ELSE 'exploring codebase' END
        WHEN {t} = 'Task' THEN 'delegating to ' || {get('agent', 'subagent_type')} || ' - ' || left({told}, 60) WHEN {t} = 'TodoWrite' THEN 'updating task list'
        WHEN {t} IN ('WebSearch', 'WebFetch') THEN 'searching web: ' || left({get('', 'query', 'url')}, 60) ELSE 'using ' || {t} || ' tool' END"""


def sql_noise(x: str) -> str:
    return f"""(length({x}) - length(regexp_replace({x}, '[0-9→│]', '', 'g')) > strlen({x}) // 4 OR {K.sql_any(f'lower({x})', L.PRINTS)} OR (contains(lower({x}), '<tool_use_error>') AND NOT contains(lower({x}), 'command')) OR regexp_matches({x}, '^[#*-]'))"""


def sql_message(x: str) -> str:
    lines = f"list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g'))"
    clean = "CASE WHEN contains({0}, '→') THEN regexp_replace(regexp_replace({0}, '^[^→]*→', ''), '^\\s+|\\s+$', '', 'g') ELSE {0} END".format("CASE WHEN contains(l, 'Exit code') THEN substr(l, instr(l, 'Exit code')) ELSE l END")
    told = f"list_filter({lines}, lambda l: NOT (regexp_matches(l, '^[0-9]') AND contains(l, '→')) AND strlen(l) >= 15 AND {K.sql_any('lower(l)', L.CUES)})"
    return f"CASE WHEN NOT {sql_noise(x)} THEN left(list_filter(list_transform({told}, lambda l: {clean}), lambda m: strlen(m) >= 20 AND NOT {sql_noise('m')})[1], 120) END"


SQL_FOUND = SQL_CALLS + f""", good AS (SELECT session_id, seq, tool_name AS tool_type, {sql_category('tool_name', 'tool_input')} AS category,
        'Task: ' || {K.sql_task('user_query')} || chr(10) || 'Approach: ' || tool_name || ' - ' || ({sql_context('tool_name', 'tool_input')}) || chr(10) || 'Outcome: Success' AS context
        FROM calls WHERE tool_name IN ({K.sql_list(L.LEARNED)}) AND strlen({sql_context('tool_name', 'tool_input')}) >= {L.LEAST_CONTEXT}),
    messages AS (SELECT session_id, seq, user_query, {sql_message('content')} AS message FROM results WHERE is_error OR contains(lower(content), 'error')),
    bad AS (SELECT session_id, seq, 'failure' AS tool_type, NULL::VARCHAR AS category, 'Task: ' || {K.sql_task('user_query')} || chr(10) || 'Pitfall: ' || message || chr(10) || 'Advice: {L.ADVICE.replace(chr(39), chr(39) * 2)}' AS context
        FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS nth FROM messages WHERE message IS NOT NULL) WHERE nth <= {L.FAILURES}),
    found AS (SELECT *, md5(context) AS hash, 1 AS success, 0 AS failure FROM good UNION ALL SELECT *, md5(context), 0, 1 FROM bad)"""


@query(f"WITH {SQL_FOUND} SELECT session_id, seq, hash, tool_type, category, context FROM found WHERE tool_type <> 'failure'")
def q50_call_patterns(spark, d):
    return L.call_patterns(calls(spark, d)).drop("success", "failure")


@query(f"WITH {SQL_FOUND} SELECT session_id, seq, context FROM found WHERE tool_type = 'failure'")
def q51_failure_patterns(spark, d):
    return L.failure_patterns(results(spark, d)).select("session_id", "seq", "context")


def half_table(spark, d):
    """A pattern table that knows what even sessions did."""
    even = F.substring("session_id", 2, 20).cast("long") % 2 == 0
    return L.found_patterns(calls(spark, d).where(even), results(spark, d).where(even), "sum").withColumn("last_used", F.lit(None).cast("timestamp"))


HALF = """tab AS (SELECT hash, arg_min(tool_type, (session_id, seq)) AS tool_type, min(category) AS category, min(context) AS context, sum(success)::BIGINT AS success, sum(failure)::BIGINT AS failure FROM found WHERE right(session_id, -1)::BIGINT % 2 = 0 GROUP BY hash)"""


@query(f"""WITH {SQL_FOUND}, {HALF}, news AS (SELECT DISTINCT hash, tool_type, category, context, success, failure FROM found)
    SELECT coalesce(t.hash, n.hash) AS hash, coalesce(t.tool_type, n.tool_type) AS tool_type, coalesce(t.category, n.category) AS category, (coalesce(t.success, 0) + coalesce(n.success, 0))::BIGINT AS success,
    (coalesce(t.failure, 0) + coalesce(n.failure, 0))::BIGINT AS failure, t.hash IS NOT NULL AND n.hash IS NOT NULL AS used FROM tab t FULL JOIN news n ON t.hash = n.hash""")
def q52_learn(spark, d):
    """A cycle of learning from all sessions, into a table that knows half of them."""
    news = L.found_patterns(calls(spark, d), results(spark, d))
    return L.upsert_patterns(half_table(spark, d), news, K.NOW).select("hash", "tool_type", "category", "success", "failure", F.col("last_used").isNotNull().alias("used"))


def learned(spark, d):
    """The patterns that all sessions teach, with ids by hash."""
    p = L.found_patterns(calls(spark, d), results(spark, d), "sum")
    # ids in one order for all: their number is bounded by that of tools, inputs and tasks.
    return cut(p.withColumn("id", F.row_number().over(Window.orderBy("hash")).cast("long")).drop("hash"))


SQL_LEARNED = SQL_FOUND + """, learned AS (SELECT row_number() OVER (ORDER BY hash) AS id, * FROM (SELECT hash, min(tool_type) AS tool_type, min(category) AS category, min(context) AS context, sum(success)::BIGINT AS success, sum(failure)::BIGINT AS failure FROM found GROUP BY hash)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY tool_type ORDER BY success - failure DESC, success DESC, id) AS rank FROM learned)"""
LONG_WORDS = "list_distinct(list_filter(string_split_regex({0}, " + K.SPACES + "), lambda w: strlen(w) >= 3))"


@query(f"""WITH {SQL_LEARNED}, c AS (SELECT session_id, seq, tool_name AS tool_type, {sql_context('tool_name', 'tool_input')} AS done FROM calls)
    SELECT session_id, seq, arg_min(id, rank) AS id FROM c JOIN ranked USING (tool_type) WHERE rank <= 10 AND len(list_intersect({LONG_WORDS.format('done')}, {LONG_WORDS.format('context')})) >= 2 GROUP BY 1, 2""")
def q53_used_patterns(spark, d):
    rank = F.row_number().over(Window.partitionBy("tool_type").orderBy(*P.SORTS["score"]()))
    return L.used_patterns(calls(spark, d), learned(spark, d).withColumn("rank", rank))


ASKED = ("edit", "bash", "task", "read", "grep", "web", "notebook")


def fields(spark, d):
    """Inputs of tools to find patterns for: query_id, tool, fields."""
    e = V.events_k(spark, d)
    path = F.when(F.col("k") % 9 != 0, F.concat(F.lit("/src/"), V.pick(V.FILES, "k")))
    command = F.when(F.col("k") % 11 != 0, V.pick(("cargo test", "npx jest", "git push", "unheard of", "python3 -m x", "docker ps", "make"), "event_id"))
    told = F.when(F.col("k") % 4 == 0, V.pick(V.TASKS, "event_id div 7"))
    agent = F.when(F.col("k") % 5 != 0, "tester")
    return e.select(F.col("event_id").alias("query_id"), V.pick(ASKED, "event_id").alias("tool"), F.struct(path.alias("file_path"), command.alias("command"), told.alias("description"), agent.alias("subagent_type")).alias("fields"))


EDIT_MAP = {e: f"{a} {b}" for e, (a, b) in R.EDIT_HINTS.items()}
COMMAND_MAP = {w: h for h, words in R.COMMAND_HINTS.items() for w in words.split()}
SQL_ASKED = f"""fields AS (SELECT event_id AS query_id, {V.sql_pick(ASKED, 'event_id')} AS tool, CASE WHEN k % 9 <> 0 THEN '/src/' || {V.sql_pick(V.FILES, 'k')} END AS path,
        CASE WHEN k % 11 <> 0 THEN {V.sql_pick(('cargo test', 'npx jest', 'git push', 'unheard of', 'python3 -m x', 'docker ps', 'make'), 'event_id')} END AS command, CASE WHEN k % 4 = 0 THEN {V.sql_pick(V.TASKS, 'event_id // 7')} END AS told, CASE WHEN k % 5 <> 0 THEN 'tester' END AS agent FROM events_k),
    parts AS (SELECT *, string_split(coalesce(path, 'unknown'), '.')[-1] AS ext, coalesce(string_split(command, ' ')[1], '') AS word FROM fields),
    asked AS (SELECT query_id, tool, CASE tool WHEN 'edit' THEN 'Editing ' || ext || ' ' || coalesce({sql_map('ext', EDIT_MAP)}, ext || ' ') || ' file ' || string_split(coalesce(path, 'unknown'), '/')[-1]
        WHEN 'bash' THEN 'Bash ' || word || ' ' || coalesce({sql_map('word', COMMAND_MAP)}, '') || coalesce(' ' || told, '') WHEN 'task' THEN 'Agent: ' || coalesce(agent, 'unknown') || ' - ' || coalesce(told, '')
        WHEN 'read' THEN 'Reading ' || coalesce(string_split(path, '/')[-1], '') WHEN 'web' THEN 'Web search' ELSE 'Tool: ' || tool END AS query FROM parts)"""


@query(f"WITH {V.EVENTS_K}, {SQL_ASKED} SELECT query_id, tool, query FROM asked")
def q54_query_text(spark, d):
    return fields(spark, d).select("query_id", "tool", R.query_text(F.col("tool"), F.col("fields")).alias("query"))


def conflicts(patterns):
    return patterns.where("id % 3 = 0").select("id", (F.col("id") + 1).alias("other")).union(patterns.where("id % 5 = 0").select("id", (F.col("id") - 2).alias("other")))


SQL_TYPES = "CASE tool " + " ".join(f"WHEN '{t}' THEN [{K.sql_list(types)}]" for t, types in R.TYPES.items()) + " ELSE [tool] END"


@query(f"""WITH {SQL_LEARNED}, {SQL_ASKED}, conflicts AS (SELECT id, id + 1 AS other FROM learned WHERE id % 3 = 0 UNION ALL SELECT id, id - 2 FROM learned WHERE id % 5 = 0),
    texts AS (SELECT DISTINCT tool, query FROM asked), typed AS (SELECT tool, query, unnest({SQL_TYPES}) AS tool_type, unnest(range(len({SQL_TYPES}))) AS pos FROM texts),
    taken AS (SELECT *, row_number() OVER (PARTITION BY tool, query ORDER BY pos, rank, id) AS nth FROM typed JOIN ranked USING (tool_type) WHERE rank <= 8),
    s AS (SELECT *, {K.sql_quick('query', 'context')} AS sim FROM taken WHERE nth <= 16),
    m AS (SELECT *, row_number() OVER (PARTITION BY tool, query ORDER BY 0.6::DOUBLE * sim + 0.4::DOUBLE * greatest(success - failure, 0) / 10.0::DOUBLE DESC, nth) AS place, count(*) OVER (PARTITION BY tool, query) AS n FROM s WHERE sim >= 0.35::DOUBLE),
    kept AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m t JOIN conflicts c ON t.id = c.id WHERE t.tool = m.tool AND t.query = m.query AND t.place = 1 AND t.n > 4 AND c.other = m.id)),
    found_ AS (SELECT tool, query, id, row_number() OVER (PARTITION BY tool, query ORDER BY place) AS place FROM kept),
    top AS (SELECT * FROM learned WHERE tool_type <> 'failure' ORDER BY success - failure DESC, success DESC, id LIMIT 8),
    spare AS (SELECT tool, query, top.id, row_number() OVER (PARTITION BY tool, query ORDER BY success - failure DESC, success DESC, top.id) AS place FROM typed JOIN top ON lower(typed.tool_type) = lower(top.tool_type) WHERE NOT EXISTS (SELECT 1 FROM found_ f WHERE f.tool = typed.tool AND f.query = typed.query)),
    all_ AS (SELECT tool, query, id, place, false AS generic FROM found_ WHERE place <= 3 UNION ALL SELECT tool, query, id, place, true FROM spare WHERE place <= 3)
    SELECT query_id, place, id, generic FROM asked JOIN all_ USING (tool, query)""")
def q55_inject(spark, d):
    """Retrieval in full for every event's input."""
    p = learned(spark, d)
    asked = fields(spark, d).select("query_id", "tool", R.query_text(F.col("tool"), F.col("fields")).alias("query"))
    return R.inject(asked, p, conflicts(p)).withColumn("place", F.col("place").cast("long"))


SQL_INSIGHT = """CASE WHEN tool_type = 'failure' THEN '⚠️ ' || left(substr(l, 10), 100) WHEN len(x) >= 3 THEN CASE WHEN x[1] = 'Bash' THEN 'Ran `' || x[2] || '`: ' || left(array_to_string(x[3:], ' - '), 60)
    WHEN x[1] = 'Task' THEN 'Delegated to ' || trim(replace(x[2], 'delegating to ', '')) || ': ' || left(array_to_string(x[3:], ' - '), 50) ELSE left(array_to_string(x[3:], ' - '), 80) END WHEN len(x) = 2 THEN left(x[2], 80) ELSE left(x[1], 80) END"""


@query(f"""WITH {SQL_LEARNED}, y AS (SELECT id, tool_type, string_split(context, chr(10))[2] AS l, string_split(trim(substr(string_split(context, chr(10))[2], 11)), ' - ') AS x FROM learned) SELECT id, {SQL_INSIGHT} AS insight FROM y""")
def q56_insight(spark, d):
    return learned(spark, d).select("id", R.insight(F.col("context")).alias("insight"))


@query()
def q57_injection_blocks(spark, d):
    """What is shown for each input: a text a query, made of at most three patterns."""
    p = learned(spark, d)
    asked = fields(spark, d).select("query_id", "tool", R.query_text(F.col("tool"), F.col("fields")).alias("query"))
    return R.inject_blocks(asked, p, conflicts(p))


SQL_TRAJECTORIES = V.EVENTS_K + f""", e AS (SELECT *, 'u' || user_id || '/' || strftime(ts, '%Y%m%d') AS session_id, {CALLED} AS is_call, {V.sql_pick(CONTENTS, 'event_id // 5')} AS content, event_type = 'error' AND event_id % 3 = 0 AS is_error,
        {V.sql_pick(TOOLS, 'k')} AS tool_name, {V.sql_pick(INPUTS, 'event_id // 3')} AS tool_input FROM events_k),
    r AS (SELECT *, lower(content) AS low FROM e WHERE NOT is_call),
    severe AS (SELECT session_id, event_id FROM (SELECT *, {K.sql_error('lower(content)')} AS kind FROM r WHERE strlen(content) <= {X.LONGEST} AND {K.sql_any('low', X.FORMATS)} AND NOT ({K.sql_any('low', X.CODE)} OR (contains(low, '::') AND contains(low, '{{')))) WHERE {K.SEVERITY} >= {X.SEVERE}),
    said AS (SELECT session_id, lower({V.sql_pick(SAID, 'min(event_id)')}) AS t FROM e GROUP BY 1),
    sums AS (SELECT e.session_id, t, count(*) FILTER (NOT is_call AND is_error) AS flagged, count(*) FILTER (NOT is_call) AS total, count(*) FILTER (is_call) AS calls, (SELECT count(*) FROM severe s WHERE s.session_id = e.session_id) AS severe FROM e JOIN said USING (session_id) GROUP BY 1, 2),
    flags AS (SELECT *, CASE WHEN flagged > 0 THEN flagged ELSE severe END AS errors, ({K.sql_count('t', N.RETRIES)})::BIGINT AS retries, {K.sql_any('t', N.GIVEN_UP)} AS abandoned, {K.sql_any('t', N.SUCCESS)} AS good FROM sums),
    outcomes AS (SELECT *, CASE WHEN abandoned THEN false WHEN good THEN true WHEN errors > 0 AND total = flagged THEN false WHEN errors = 0 AND calls > 0 THEN true WHEN errors > 0 AND 2 * (total - flagged) > total THEN true ELSE errors = 0 END AS success,
        CASE WHEN errors > 0 THEN 0.85::DOUBLE WHEN good THEN 0.9::DOUBLE WHEN calls > 0 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM flags)"""


@query(f"WITH {SQL_TRAJECTORIES} SELECT session_id, success, retries, errors::BIGINT AS errors, abandoned, confidence FROM outcomes")
def q58_outcomes(spark, d):
    return X.outcomes(trajectories(spark, d)).select("session_id", "success", "retries", F.size("error_types").cast("long").alias("errors"), "abandoned", "confidence")


SQL_FOUND_2 = SQL_LEARNED.split(V.EVENTS_K)[1]
SQL_VERDICTS = SQL_TRAJECTORIES + SQL_FOUND_2 + f""", firsts AS (SELECT session_id, arg_min(tool_name, event_id) AS tool_type, arg_min(tool_input, event_id) AS tool_input FROM e WHERE is_call GROUP BY 1),
    q AS (SELECT session_id, tool_type, {sql_context('tool_type', 'tool_input', True)} AS query FROM firsts),
    sims AS (SELECT session_id, id, rank, {K.sql_quick('query', 'context')} AS sim FROM q JOIN ranked USING (tool_type) WHERE rank <= 20),
    matched AS (SELECT session_id, arg_min(id, (-sim, rank)) AS pattern_id FROM sims WHERE sim > 0.05::DOUBLE GROUP BY 1),
    v AS (SELECT session_id, CASE WHEN success THEN 'EFFECTIVE' WHEN abandoned THEN 'INEFFECTIVE' WHEN errors > 0 AND flagged = 0 THEN 'HARMFUL' WHEN errors > 0 THEN 'INEFFECTIVE' ELSE 'NEUTRAL' END AS verdict,
        CASE WHEN success AND retries > 0 THEN confidence * greatest(1.0::DOUBLE - retries * 0.1::DOUBLE, 0.3::DOUBLE) WHEN success OR abandoned OR (errors > 0 AND flagged = 0) THEN confidence WHEN errors > 0 THEN confidence * 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CASE WHEN retries > 0 THEN 2 ELSE 5 END AS boost FROM outcomes),
    verdicts AS (SELECT session_id, pattern_id, verdict, confidence, (CASE verdict WHEN 'EFFECTIVE' THEN round(boost * confidence) WHEN 'HARMFUL' THEN round(-5 * confidence) WHEN 'INEFFECTIVE' THEN -1 ELSE 0 END)::BIGINT AS impact FROM v LEFT JOIN matched USING (session_id))"""


@query(f"WITH {SQL_VERDICTS} SELECT session_id, coalesce(pattern_id, -1) AS pattern_id, verdict, round(confidence, 6) AS confidence, impact FROM verdicts")
def q59_verdicts(spark, d):
    return X.verdicts(trajectories(spark, d), learned(spark, d)).select("session_id", F.coalesce("pattern_id", F.lit(-1)).alias("pattern_id"), "verdict", F.round("confidence", 6).alias("confidence"), "impact")


@query(f"""WITH {SQL_VERDICTS}, c AS (SELECT pattern_id AS id, greatest(-5, least(5, round(impact * confidence))) AS x FROM verdicts WHERE confidence >= 0.6::DOUBLE AND session_id NOT LIKE '%5'), s AS (SELECT id, sum(greatest(x, 0)) AS up, sum(greatest(-x, 0)) AS down FROM c GROUP BY 1)
    SELECT id, (success + coalesce(up, 0))::BIGINT AS success, (failure + coalesce(down, 0))::BIGINT AS failure FROM learned LEFT JOIN s USING (id)""")
def q60_reflect(spark, d):
    """Counters after a cycle; trajectories of days ending in 5 have a verdict already."""
    t = trajectories(spark, d)
    stored = t.where("session_id like '%5'").select(X.trajectory_hash().alias("trajectory_hash"))
    return X.reflect(t, learned(spark, d), stored, K.NOW)[0]


@query(f"WITH {K.VERDICTS}, s AS (SELECT pattern_id, sum(CASE WHEN verdict = 'EFFECTIVE' THEN confidence ELSE 0 END) AS eff, sum(CASE WHEN verdict = 'HARMFUL' THEN confidence ELSE 0 END) AS harm FROM verdicts GROUP BY 1) SELECT pattern_id FROM s WHERE harm > eff * 0.1::DOUBLE")
def q61_demotions(spark, d):
    return X.demotions(K._verdicts(spark, d), 0.1)


@query(f"""WITH {V.PATTERNS_CTX}, s AS (SELECT a.id AS a, b.id AS b, {K.sql_quick('a.context', 'b.context')} AS sim FROM patterns_ctx a JOIN patterns_ctx b USING (tool_type, category)
    WHERE (a.failure - a.success, -a.success, a.id) < (b.failure - b.success, -b.success, b.id)) SELECT a, b, round(sim, 6) AS sim FROM s WHERE sim >= 0.5::DOUBLE""")
def q27_similar_pairs(spark, d):
    """Pairs of a tool type and category that cluster; all of these texts are short enough for the quick score, the other one has tests."""
    return similar.similar_pairs(V.patterns_ctx(spark, d), ("tool_type", "category"), C.CLUSTER, False).select("a", "b", F.round("sim", 6).alias("sim"))


@query()
def q28_greedy_merge(spark, d):
    return C.merge_similar(learned(spark, d)).select("id", "tool_type", "success", "failure")


@query()
def q29_skills(spark, d):
    return C.skills(learned(spark, d))


@query()
def q29c_skill_members(spark, d):
    """Which patterns each cluster holds, a row each."""
    return C.clusters(learned(spark, d))


@query()
def q29b_skills_by_type(spark, d):
    return C.skills(learned(spark, d)).groupBy("tool_type").agg(F.count("*").alias("skills"), F.sum("pattern_count").alias("patterns"))


MODES = {
    "category": ("SELECT id FROM patterns_ev WHERE tool_type = 't3' AND category = 'c1' ORDER BY success - failure DESC, success DESC, id LIMIT 5", lambda p: P.in_category(p, "t3", "c1", 5)),
    "no category": ("SELECT id FROM patterns_ev WHERE tool_type = 't3' ORDER BY success - failure DESC, success DESC, id LIMIT 5", lambda p: P.in_category(p, "t3", None, 5)),
    "not type": ("SELECT id FROM patterns_ev WHERE tool_type <> 't1'", lambda p: p.where("tool_type <> 't1'")),
    "lookup": ("SELECT id FROM patterns_ev WHERE id = 3017", lambda p: p.where("id = 3017")),
    "either case": ("SELECT id FROM patterns_ev WHERE lower(tool_type) = lower('T2')", lambda p: p.where(F.lower("tool_type") == F.lower(F.lit("T2")))),
    "any of": ("SELECT id FROM patterns_ev WHERE tool_type = 't1' OR category = 'c2' OR success > 9", lambda p: p.where("tool_type = 't1' or category = 'c2' or success > 9")),
    "prunable": ("SELECT id FROM patterns_ev WHERE success - failure < 0", lambda p: P.prunable(p, 0)),
    "latest": ("SELECT id FROM patterns_ev ORDER BY last_used DESC NULLS LAST, id DESC LIMIT 5", lambda p: p.orderBy(F.desc_nulls_last("last_used"), F.desc("id")).limit(5)),
    "first categories": ("SELECT id FROM (SELECT *, nullif(category, 'c0') AS c FROM patterns_ev) ORDER BY tool_type, c NULLS FIRST, success - failure DESC, id LIMIT 7", lambda p: p.orderBy("tool_type", F.when(F.col("category") != "c0", F.col("category")).asc_nulls_first(), F.desc(F.col("success") - F.col("failure")), "id").limit(7)),
}


@query(f"WITH {V.PATTERNS_EV} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM ({sql})" for m, (sql, _) in MODES.items()))
def q62_reports(spark, d):
    p = V.patterns_ev(spark, d)
    out = None
    for mode, (_, make) in MODES.items():
        own = make(p).select(F.lit(mode).alias("mode"), "id")
        out = own if out is None else out.union(own)
    return out


@query(f"""WITH {V.PATTERNS_EV} SELECT count(*) AS patterns, coalesce(sum(success), 0)::BIGINT AS success, coalesce(sum(failure), 0)::BIGINT AS failure, round(100.0::DOUBLE * sum(success) / nullif(sum(success) + sum(failure), 0), 6) AS rate,
    round(avg(success::DOUBLE / nullif(success + failure, 0) * 100), 6) AS mean_rate, count(*) FILTER (last_used IS NULL) AS unused FROM patterns_ev""")
def q63_status(spark, d):
    return P.status(V.patterns_ev(spark, d))


@query(f"WITH {V.EDGES} SELECT a, b, round(lift + 1e-8::DOUBLE, 6) AS lift FROM edges WHERE a = 3 OR b = 3 ORDER BY edges.lift")
def q64_edges_of_a_node(spark, d):
    return G.edges_of(G.lift(G.pairs(V.baskets_ev(spark, d))), 3).select("a", "b", F.round(F.col("lift") + 1e-8, 6).alias("lift"))


@query("SELECT count(*) AS total, count(*) FILTER (doc_id % 4 <> 0) AS embedded, count(*) FILTER (doc_id % 4 = 0) AS missing, 64 AS dims FROM documents")
def q65_embedding_status(spark, d):
    """Embeddings of some documents, read back from their binary form; status tells what is missing."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    some = E.embed_missing(docs.where("id % 4 <> 0").withColumn("embedding", F.lit(None).cast("array<float>")), "text", 64)
    stored = some.select("id", E.from_bytes(E.to_bytes(F.col("embedding"))).alias("embedding"))
    return E.status(docs.join(stored, "id", "left"), 64)


@query()
def q66_search_text(spark, d):
    """The 5 documents nearest to each benchmark item by hash embedding, with sim x rate as their score."""
    items = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 5).alias("success"), (F.col("doc_id") % 3).alias("failure"))
    return E.search(items, docs, 5, 64)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q48_incremental_log_scan(spark, d):
    """Events as lines of logs, in two parts that two runs of a stream take in; the second goes on where the first stopped."""
    base = shared_path(spark, "logs")
    e = V.table(spark, d, "events")
    folder, state = f"{base}/lines", f"{base}/run"
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).select(F.to_json(F.struct("event_type", "event_id")).alias("value")).write.text(f"{folder}/part{part}")
        lines = appended.appended_lines(spark, folder, ".txt")
        typed = lines.select(F.get_json_object("value", "$.event_type").alias("event_type"))
        out = accumulate.run_available(typed, state, "event_type string, n long", accumulate.count_by("event_type"))
    return out


@query(f"WITH {V.EDGES} SELECT a, b, round(lift + 1e-8::DOUBLE, 6) AS lift, co_occurrences FROM edges")
def q67_stream_lift(spark, d):
    """Lifts as a stream's state, which each batch goes on from."""
    base = shared_path(spark, "lifts")
    cut_ = G.pairs(V.baskets_ev(spark, d)).select("a", "b", F.struct("seq.day", "seq.user_id").alias("seq"), "ok")
    cut_.write.parquet(f"{base}/rows")
    stream = spark.readStream.schema(cut_.schema).parquet(f"{base}/rows")
    return accumulate.run_available(stream, f"{base}/run", "a long, b long, lift double, co_occurrences long", accumulate.fold_lift).withColumn("lift", F.round(F.col("lift") + 1e-8, 6))


@query("""WITH RECURSIVE p AS (SELECT user_id % 7 % 5 AS i, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1), enough AS (SELECT count(*) // 3 AS x FROM events),
    r AS (SELECT -1::BIGINT AS i, 0::BIGINT AS cycle, 0::BIGINT AS n, 0::BIGINT AS e, false AS ran UNION ALL
        SELECT r.i + 1, cycle + CASE WHEN ran THEN 1 ELSE 0 END, CASE WHEN ran THEN 0 ELSE r.n END + p.n, CASE WHEN ran THEN 0 ELSE r.e END + p.e, CASE WHEN ran THEN 0 ELSE r.n END + p.n >= x FROM r JOIN p ON p.i = r.i + 1, enough)
    SELECT cycle, n AS rows, e AS errors, ran AS done FROM r WHERE ran OR i = 4""")
def q68_threshold_cycle(spark, d):
    """Events come in five uneven parts; once a third of them wait, a cycle is given all that wait. Its rows and errors, and those that wait at last."""
    base, e = shared_path(spark, "cycles"), V.table(spark, d, "events")
    told = lambda rows, n, done: rows.agg(F.lit(n).cast("long").alias("cycle"), F.count("*").alias("rows"), F.count_if(F.col("event_type") == "error").alias("errors")).withColumn("done", F.lit(done))
    acc = accumulate.Accumulator(spark, f"{base}/run", e.schema, lambda rows, n: accumulate.append_once(told(rows, n, True), f"{base}/log", n), enough=e.count() // 3)
    for part in range(5):
        e.where(F.col("user_id") % 7 % 5 == part).write.mode("append").parquet(f"{base}/rows")
        acc.run_available(spark.readStream.schema(e.schema).parquet(f"{base}/rows"))
    waits = told(acc.waiting(), acc.held().cycles, False).where("rows > 0")
    return spark.read.parquet(f"{base}/log").drop("batch").union(waits) if acc.held().cycles else waits


@query(f"WITH {SQL_FOUND} SELECT DISTINCT hash, tool_type, category, success::BIGINT AS success, failure::BIGINT AS failure, false AS used FROM found")
def q69_relearn(spark, d):
    """The pattern table made anew from all sessions; what it knew is forgotten."""
    out = L.relearn(calls(spark, d), results(spark, d), half_table(spark, d), K.NOW)
    return out.select("hash", "tool_type", "category", "success", "failure", F.col("last_used").isNotNull().alias("used"))


@query()
def q70_session_end(spark, d):
    """Sessions of events end in two parts, and the pattern table learns from them as enough wait."""
    base = shared_path(spark, "ended")
    rows = cut(trajectories(spark, d))  # both parts are of the same fold
    half = F.pmod(F.xxhash64("session_id"), F.lit(2))
    for part in (0, 1):
        rows.where(half == part).write.mode("append").parquet(f"{base}/rows")
        ended = accumulate.session_end(spark.readStream.schema(rows.schema).parquet(f"{base}/rows"), f"{base}/run", K.NOW)
    return ended.patterns.select("hash", "tool_type", "category", "success", "failure")


SQL_SHARED = SQL_TRAJECTORIES + SQL_FOUND_2 + f""", c3 AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS pos, tool_name AS tool_type, {sql_context('tool_name', 'tool_input')} AS done FROM e WHERE is_call),
    m AS (SELECT session_id, pos, arg_min(id, rank) AS id FROM c3 JOIN ranked USING (tool_type) WHERE pos <= 3 AND rank <= 10 AND len(list_intersect({LONG_WORDS.format('done')}, {LONG_WORDS.format('context')})) >= 2 GROUP BY 1, 2),
    oks AS (SELECT session_id, NOT coalesce(bool_or(is_error OR {K.sql_any('lower(content)', X.FAILED)}) FILTER (NOT is_call), false) AS ok FROM e GROUP BY 1),
    folded AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, list(ok ORDER BY session_id, x.pos, y.pos) AS h FROM m x JOIN m y USING (session_id) JOIN oks USING (session_id) WHERE x.pos < y.pos AND x.id <> y.id GROUP BY 1, 2),
    edges AS (SELECT a, b, list_reduce(h[2:], lambda acc, x: acc * (1.0::DOUBLE - 0.3::DOUBLE) + (CASE WHEN x THEN 1.5::DOUBLE ELSE 0.3::DOUBLE END) * 0.3::DOUBLE, CASE WHEN h[1] THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END) AS lift, len(h)::BIGINT AS co_occurrences FROM folded)"""


@query(f"WITH {SQL_SHARED} SELECT a, b, round(lift + 1e-8::DOUBLE, 6) AS lift, co_occurrences FROM edges")
def q71_learned_edges(spark, d):
    """Edges between the patterns that the first calls of each trajectory match, with the lift of its outcomes."""
    return G.lift(L.shared_patterns(trajectories(spark, d), learned(spark, d))).withColumn("lift", F.round(F.col("lift") + 1e-8, 6))
