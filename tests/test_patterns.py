"""Counter tables, graph, sessions and retrieval on small inputs."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternlake.functions import sanitize, text, vectors
from patternlake.operators import consolidate, graph, learn, nearest, patterns, reflect, replicas, retrieve, sessions
from patternlake.sources import appended, bundles, logs
from patternlake.streaming import accumulate


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first()["x"]


def test_upsert_adds_and_keeps_the_old_label(spark):
    old, new = (spark.createDataFrame(r, "key long, label string, success long, failure long") for r in ([(1, "a", 5, 1)], [(1, "b", 3, 2), (2, "c", 1, 0)]))
    assert {tuple(r) for r in patterns.upsert(old, new).collect()} == {(1, "a", 8, 3), (2, "c", 1, 0)}


def test_keep_best_takes_only_better_rates(spark):
    schema = "key long, label string, success long, failure long"
    old = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 9, 1), (4, "failure", 9, 0)], schema)
    new = spark.createDataFrame([(1, "a", 3, 1), (2, "b", 1, 1), (3, "c", 0, 0), (4, "failure", 0, 1)], schema)
    assert {r["key"]: r["success"] for r in patterns.merge_best(old, new, "keep_best").collect()} == {1: 4, 2: 9, 3: 0, 4: 9}


def test_upsert_into_buckets_shuffles_the_news_alone(spark, tmp_path):
    rows = [(i, f"l{i}", i, 1) for i in range(40)]
    old, news = spark.createDataFrame(rows, "key long, label string, success long, failure long"), spark.createDataFrame([(5, "b", 1, 0), (5, "a", 2, 0), (99, "z", 1, 1)], "key long, label string, success long, failure long")
    spark.sql("DROP TABLE IF EXISTS counters_of_tests")
    table = patterns.save_bucketed(old, "counters_of_tests", str(tmp_path / "t"), buckets=4)
    got = patterns.upsert_bucketed(table, news)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, patterns.upsert(old, news).collect()))
    plan = patterns.upsert_bucketed(table, news)._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("FileScan")]
    assert plan.count("FileScan") == 1 and "Exchange" not in scan.rsplit("SortMergeJoin", 1)[-1]  # between the table's scan and the join
    spark.sql("DROP TABLE counters_of_tests")


def test_outcomes_are_counted(spark):
    p = spark.createDataFrame([(1, 5, 1), (2, 0, 0)], "id long, success long, failure long")
    uses = spark.createDataFrame([(1, True), (1, True), (1, False), (9, True)], "id long, success boolean")
    assert sorted(map(tuple, patterns.count_outcomes(p, uses).collect())) == [(1, 7, 2), (2, 0, 0)]


def test_versions(spark):
    newer = lambda a, b: spark.range(1).select(text.version(F.lit(a)) > text.version(F.lit(b))).first()[0]
    assert newer("0.1.1", "0.1.0") and newer("0.2", "0.1.0") and not newer("1.0", "1.0.0") and newer("v1.2.beta.3", "2.2") and not newer("", "0.0.1") and newer("1.10", "1.9")


def test_decay_and_prune(spark):
    rows = [(1, 5, 0, None), (2, 5, 0, "2024-01-14 00:00:00"), (3, 0, 0, "2024-01-01 00:00:00"), (4, 0, 4, None)]
    p = spark.createDataFrame(rows, "id long, success long, failure long, u string").withColumn("last_used", F.to_timestamp("u"))
    assert [r["success"] for r in patterns.decay(p, "2024-01-20 00:00:00").orderBy("id").collect()] == [4, 5, 0, 0]
    assert [r["id"] for r in patterns.prune(p).orderBy("id").collect()] == [1, 2, 3]


def test_top_per_type_breaks_ties_by_id(spark):
    p = spark.createDataFrame([(3, "t", 2, 0), (1, "t", 2, 0), (2, "t", 3, 1)], "id long, tool_type string, success long, failure long")
    assert [r["id"] for r in patterns.top_per_type(p, 2).orderBy("rank").collect()] == [2, 1]


@pytest.mark.parametrize("outcomes, bound", [([False] * 4, (0, 0.5)), ([False] * 3, (0.5, 0.6)), ([True] * 40, (1.49, 1.5))])
def test_lift(spark, outcomes, bound):
    rows = [(1, 2, i, ok) for i, ok in enumerate(outcomes)]
    lift = graph.lift(spark.createDataFrame(rows, "a long, b long, seq long, ok boolean")).first()
    assert bound[0] <= lift["lift"] <= bound[1] and lift["co_occurrences"] == len(outcomes)


def test_pairs_have_no_self_pair(spark):
    b = spark.createDataFrame([("x", 1, True, [2, 1, 2, 3])], "basket string, seq long, ok boolean, items array<long>")
    assert {(r["a"], r["b"]) for r in graph.pairs(b).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_conflicts_only_beyond_the_gate(spark):
    bad = spark.createDataFrame([(1, 3)], "id long, other long")
    for n, left in ((4, 4), (5, 4)):
        c = spark.createDataFrame([(0, i, i) for i in range(1, n + 1)], "query_id long, place long, id long")
        assert retrieve.without_conflicts(c, bad).count() == left


@pytest.mark.parametrize("value, want", [("fix main.rs with cargo", "rust"), ("run the app.tsx by npm", "javascript"), ("pytest it", "python"), ("go.mod", "go"), ("zsh", "shell"), ("hello", "unknown")])
def test_tech_stack(spark, value, want):
    assert one(spark, value, text.tech_stack) == want


@pytest.mark.parametrize("value, want", [("running", "run"), ("edited", "edit"), ("tests", "test"), ("class", "class"), ("missing", "mis")])
def test_stem(spark, value, want):
    assert one(spark, value, text.stem) == want


@pytest.mark.parametrize("value, want", [("abcdef", "abcd"), ("aé€x", "aé"), ("ééé", "éé"), ("😀😀", "😀"), ("", "")])
def test_byte_truncate(spark, value, want):
    assert one(spark, value, lambda c: text.byte_truncate(c, 4)) == want


@pytest.mark.parametrize("value, want", [("Fix the type error in main.rs", "Fix type error"), ("run the tests", "Run tests"), ("rename it now", "Rename code/files"), ("what about that then", "what about that then")])
def test_task_category(spark, value, want):
    assert one(spark, value, text.task_category) == want


@pytest.mark.parametrize("value, want", [("error[E0308]: cannot find type", "compile"), ("panicked at", "runtime"), ("No such file or directory", "not_found"), ("operation timed out", "timeout"), ("0 errors: error: x", None), ("", None)])
def test_error_type(spark, value, want):
    assert one(spark, value, sessions.error_type) == want


def test_impact_rounds_half_away_from_zero(spark):
    r = spark.range(1).select(sessions.score_impact(F.lit("EFFECTIVE"), F.lit(0.5)), sessions.score_impact(F.lit("HARMFUL"), F.lit(0.8))).first()
    assert tuple(r) == (3, -4)


@pytest.mark.parametrize("value, want", [("api_key = abcdefghij0123456789", "api_key[REDACTED]"), ("mail me@x.org", "mail [email]"), ("at 10.0.0.1", "at [ip]"), ("open /usr/local/bin/tool", "open tool"), ("in ~/x", "in x"), (None, None)])
def test_sanitize(spark, value, want):
    assert one(spark, value, sanitize.sanitize) == want


def test_trajectories(spark, tmp_path):
    item = lambda **x: x
    lines = [
        {"type": "user", "sessionId": "s", "message": {"content": "<command-name>"}},
        {"type": "user", "sessionId": "s", "message": {"content": "please fix it"}},
        {"type": "assistant", "sessionId": "s", "message": {"content": [item(type="text", text="ok"), item(type="tool_use", name="Edit", input={"file_path": "a.rs"})]}},
        {"type": "user", "sessionId": "s", "message": {"content": [item(type="tool_result", tool_use_id="1", content="done", is_error=False)]}},
        {"type": "user", "message": {"content": "no tools here"}},
    ]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    (tmp_path / "b.jsonl").write_text("")
    rows = logs.trajectories(logs.messages(logs.read_lines(spark, str(tmp_path)))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["user_query"], r["assistant_content"], r["session_id"]) == ("please fix it", "ok", "s")
    assert r["tool_calls"][0]["tool_name"] == "Edit" and json.loads(r["tool_calls"][0]["tool_input"]) == {"file_path": "a.rs"}
    assert r["tool_results"][0]["content"] == "done"


def test_hash_embed_equals_a_plain_loop(spark):
    def fnv(data):
        h = retrieve.FNV_OFFSET
        for x in data:
            h = (h ^ x) * retrieve.FNV_PRIME % 2**64
        return h

    texts = ["running npm install", "Über_die Wälder, 漢字 aa", "x", "", None, "word " * 400 + "y" * 5000]
    for text, got in zip(texts, (r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(retrieve.hash_embed(16)("t").alias("v")).collect())):
        words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if len(w.encode()) > 1]
        sums = [0.0] * 16
        for term in [*words, *(f"{a}_{b}" for a, b in zip(words, words[1:]))]:
            state = fnv(term.encode())
            for i in range(16):
                state = (state * retrieve.MULTIPLIER + retrieve.INCREMENT) % 2**64
                sums[i] += state / 2**63 - 1
        size = sum(x * x for x in sums) ** 0.5
        assert got == pytest.approx([x / size if size else 0.0 for x in sums], abs=1e-5)


def test_hash_embed(spark):
    rows = spark.createDataFrame([("running npm install",), ("npm install packages",), ("cargo build",), ("",)], "t string").select(retrieve.hash_embed(64)("t").alias("v")).collect()
    a, b, c, zero = (r["v"] for r in rows)
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert abs(dot(a, a) - 1) < 1e-5 and not any(zero) and dot(a, b) > dot(a, c)


def test_first_overlap_takes_the_best_ranked_pattern(spark):
    p = spark.createDataFrame([(1, "run the tests of app", 2), (2, "fix the tests of run.py", 3), (4, None, 1)], "id long, context string, rank long")
    q = spark.createDataFrame([(1, "fix the tests"), (2, "fix it"), (3, None), (4, "")], "query_id long, query string")
    assert [tuple(r) for r in retrieve.first_overlap(q, p).collect()] == [(1, 1, 2)]


def test_term_score_is_not_normalised_by_the_pattern(spark):
    p = spark.createDataFrame([(1, "parser parser lexer"), (2, ""), (3, "main.rs parser cargo")], "id long, text string")
    q = spark.createDataFrame([(1, "parser words"), (2, ""), (3, "pytest parser run.py")], "query_id long, query string")
    got = {(r["query_id"], r["id"]): r["sim"] for r in retrieve.term_scores(q, p).collect()}
    weights = {"parser": 1.2, "word": 1.0}
    assert got[1, 1] == pytest.approx(2 * 1.2 * 1.2 / (weights["parser"] ** 2 + weights["word"] ** 2) ** 0.5, abs=1e-4)
    assert set(got) == {(1, 1), (1, 3), (3, 1), (3, 3)} and got[3, 3] < got[3, 1]  # stacks differ, but a word is shared


def test_term_scores_neither_deal_nor_keep_pairs(spark, monkeypatch):
    words = ["parser", "lexer", "grammar", "cargo", "pytest", "main.rs", "run.py", "words", "of", ""]
    rows = lambda n, seed: [(i, " ".join(random.Random(seed + i).choices(words, k=i % 7))) for i in range(n)]
    q, p = spark.createDataFrame(rows(12, 0), "query_id long, query string"), spark.createDataFrame([*rows(60, 99), (60, None)], "id long, text string")
    kept, cut = [], retrieve.cut
    monkeypatch.setattr(retrieve, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = retrieve.term_scores(q, p)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and all("id" not in x.columns for x in kept)
    f = q.withColumn("qf", text.features(F.col("query"))).crossJoin(p.withColumn("pf", text.features(F.col("text"))))
    shared = F.size(F.array_intersect(F.map_keys("qf.weights"), F.map_keys("pf.weights"))) > 0
    want = f.where(shared).select("query_id", "id", F.round(text.term_match(F.col("qf"), F.col("pf")), 4).alias("sim"))
    of = lambda df: {(r["query_id"], r["id"]): r["sim"] for r in df.collect()}
    assert of(got) == pytest.approx(of(want), abs=1.01e-4) and got.count() == want.count() > 200


@pytest.mark.parametrize("query, pattern, quick", [("x" * 93 + " parser", "parser " * 57, False), ("x" * 92 + " parser", "parser " * 57, True), ("parser words", "parser " * 58, False)])
def test_the_score_depends_on_both_lengths(spark, query, pattern, quick):
    row = spark.createDataFrame([(query, pattern)], "q string, p string").select(text.lexical_score(text.features(F.col("q")), text.features(F.col("p"))).alias("s"), text.quick_score(F.col("q"), F.col("p")).alias("quick")).first()
    assert (row["s"] == row["quick"]) == quick and (row["s"] > 1) != quick


@pytest.mark.parametrize("query, pattern, low, high", [
    ("Editing js javascript npm node package file App.js", "Task: Fix error or bug\nApproach: Edit - js javascript npm node editing index.js\nOutcome: Success", 0.35, 9), ("cargo build main.rs", "bash run.sh with zsh", 0, 0.35), ("", "anything", 0, 0), ("anything", "", 0, 0), ("fix bug", "fix the bug in parser", 1, 1), ("fix the bug in parser", "fix bug", 0, 0.6),
])
def test_score_bounds(spark, query, pattern, low, high):
    s = spark.createDataFrame([(query, pattern)], "q string, p string").select(text.lexical_score(text.features(F.col("q")), text.features(F.col("p")))).first()[0]
    assert low <= s <= high


def test_counted_terms(spark):
    assert one(spark, "b a b", lambda c: text.counted(F.split(c, " "))) == [("a", 1), ("b", 2)]
    assert one(spark, "", lambda c: text.counted(text.tokens(c))) == []


@pytest.mark.parametrize("tool, given, want", [
    ("Bash", {"command": "cargo build"}, "cargo"), ("Bash", {"command": "npx jest"}, "npm"), ("Bash", {"command": "pytest -q"}, "python"), ("Bash", {"command": "gh pr list"}, "git"), ("Bash", {"command": "frob x"}, "frob"), ("Bash", {}, None),
    ("Edit", {"file_path": "/a/main.rs"}, "rs"), ("Write", {"file_path": "App.tsx"}, "tsx"), ("Read", {"path": "/x/y.py"}, "py"), ("Task", {"subagent_type": "tester"}, "tester"), ("Grep", {"path": "a.b"}, None), ("Edit", {}, None),
])
def test_command_category(spark, tool, given, want):
    assert one(spark, json.dumps(given), lambda c: learn.category(F.lit(tool), c)) == want


@pytest.mark.parametrize("tool, given, want", [
    ("Edit", {"file_path": "/p/main.rs", "old_string": "let x: String = 123;"}, "rs rust cargo editing main.rs (replacing 'let x: String = 123;')"), ("Write", {"file_path": "/p/a.zz"}, "zz  writing to a.zz"), ("Edit", {}, "unknown  writing to unknown"),
    ("Bash", {"command": "cargo test --all", "description": "Run it"}, "cargo - Run it"), ("Bash", {"command": "ls"}, "running 'ls'"), ("Bash", {}, "running 'unknown command'"), ("Grep", {"pattern": "x+", "path": "/a/b"}, "searching for 'x+' in b"),
    ("Read", {"file_path": "/a/b"}, "reading b"), ("Glob", {}, "exploring codebase"), ("Task", {"description": "do"}, "delegating to agent - do"), ("TodoWrite", {}, "updating task list"), ("WebFetch", {"url": "u"}, "searching web: u"), ("Odd", {}, "using Odd tool"),
])
def test_tool_context(spark, tool, given, want):
    assert one(spark, json.dumps(given), lambda c: learn.context(F.lit(tool), c)) == want


@pytest.mark.parametrize("value, want", [
    ("Error: cannot find module 'missing-module' - check your dependencies", "Error: cannot find module 'missing-module' - check your dependencies"), ("123→    console.error('test')", None), ("fine", None), ("short error: x", None),
    ("plain\n  Exit code 1 then command not found: frobnicate", "Exit code 1 then command not found: frobnicate"), ("# error: in a heading of a text", None), ("<tool_use_error>error: something went wrong here</tool_use_error>", None), ("x error: " + "y" * 200, ("x error: " + "y" * 200)[:120]),
])
def test_error_message(spark, value, want):
    assert one(spark, value, learn.error_message) == want


TRAJECTORY = "session_id string, user_query string, assistant_content string, tool_calls array<struct<tool_name string, tool_input string>>, tool_results array<struct<tool_use_id string, content string, is_error boolean>>"


def trajectory(session="s", query="Fix the type error in main.rs", said="", calls=(), results=()):
    return (session, query, said, [(t, json.dumps(i)) for t, i in calls], [("1", c, e) for c, e in results])


def test_learning_from_trajectories(spark):
    rows = [
        trajectory("s1", said="I've fixed it", calls=[("Edit", {"file_path": "/src/main.rs", "old_string": "let x"}), ("Edit", {"file_path": "/src/main.rs", "old_string": "let x"}), ("Odd", {})]),
        trajectory("s2", "Run the tests", results=[("Error: cannot find module 'missing-module' - check it", True)] * 5 + [("123→ noise", True)]),
    ]
    t = spark.createDataFrame(rows, TRAJECTORY)
    table = spark.createDataFrame([], "hash string, tool_type string, category string, context string, success long, failure long, last_used timestamp")
    once = learn.learn(t, table, "2024-01-20").persist()
    got = {r["tool_type"]: r for r in once.collect()}
    assert set(got) == {"Edit", "failure"} and (got["Edit"]["success"], got["Edit"]["category"], got["Edit"]["last_used"]) == (1, "rs", None) and got["failure"]["failure"] == 1
    assert "rust" in got["Edit"]["context"] and "Pitfall: Error: cannot find module" in got["failure"]["context"]
    again = {r["tool_type"]: r for r in learn.learn(t, once, "2024-01-20", dedup="sum").collect()}
    assert again["Edit"]["success"] == 3 and again["failure"]["failure"] == 4 and again["Edit"]["last_used"] is not None
    assert learn.failure_patterns(learn.flat_results(t)).count() == 3


def test_inject(spark):
    ctx = "Task: Fix error or bug\nApproach: Edit - rs rust cargo editing main.rs\nOutcome: Success"
    rows = [(i, "Edit", None, ctx.replace("main", f"m{i}"), 20 - i, 0) for i in range(1, 7)] + [(7, "Write", None, "Task: x\nApproach: Write - py python pip writing to a.py\nOutcome: Success", 9, 3), (8, "failure", None, "Task: x\nPitfall: something failed badly here", 0, 1)]
    p = spark.createDataFrame(rows, "id long, tool_type string, category string, context string, success long, failure long")
    bad = spark.createDataFrame([(1, 2)], "id long, other long")
    asks = spark.createDataFrame([(1, "edit", "Editing rs rust cargo toml crate file main.rs"), (2, "edit", ""), (3, "edit", "zsh shell bash"), (4, "bash", "npm"), (5, "WRITE", "zsh shell bash .sh")], "query_id long, tool string, query string")
    found = retrieve.inject(asks, p, bad).persist()
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["place"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["generic"]))
    assert got == {1: [(1, False), (3, False), (4, False)], 2: [(1, False), (2, False), (3, False)], 3: [(1, True), (2, True), (3, True)], 5: [(7, True)]}
    shown = {r["query_id"]: r for r in retrieve.injection_blocks(found, p).collect()}
    assert shown[1]["ids"] == [1, 3, 4] and shown[1]["block"].startswith("**Relevant patterns from previous successful operations:**\n\n- **Edit** (score: 19, 100% success rate)\n  rs rust cargo editing m1.rs\n\n- **Edit**")
    assert shown[5]["block"] == "**General patterns (no tech-specific matches found):**\n\n- **Write** (score: 6, 75% success rate)\n  py python pip writing to a.py\n"
    again = asks.union(asks.withColumn("query_id", F.col("query_id") + 10)).union(spark.createDataFrame([(20, "edit", None), (21, None, None)], asks.schema))
    want = retrieve.injection_blocks(retrieve.inject(again, p, bad), p)
    of = lambda df: sorted(map(str, df.select("query_id", "block", "ids").collect()))
    blocks = retrieve.inject_blocks(again, p, bad)
    assert of(blocks) == of(want) and len(of(want)) == 9
    assert "hashpartitioning(query_id" not in blocks._jdf.queryExecution().executedPlan().toString()  # no query is dealt
    assert retrieve.warnings(p).first()["line"] == "- \u26a0\ufe0f \u26a0\ufe0f something failed badly here"


@pytest.mark.parametrize("value, want", [
    ("Task: x\nApproach: Bash - npm - Initialize project\nOutcome: Success", "Ran `npm`: Initialize project"), ("Approach: Task - delegating to researcher - look it up", "Delegated to researcher: look it up"), ("Approach: Odd - a - b - c", "Odd: b - c"),
    ("Approach: just this thing", "just this thing"), ("Task: something\nA telling line here", "A telling line here"), ("Task: only", "Task: only"), ("Approach: first thing\nPitfall:Pitfall: a really bad mistake\nApproach: last thing", "\u26a0\ufe0f a really bad mistake"), ("", ""),
])
def test_insight(spark, value, want):
    assert one(spark, value, retrieve.insight) == want


def greedy(ids, near):
    owner = {}
    for i in ids:
        if i not in owner:
            for j in ids[ids.index(i) + 1 :]:
                if j not in owner and (i, j) in near:
                    owner[j] = i
    return owner


def test_leaders_equal_the_walk_in_order(spark):
    rng = random.Random(1)
    for density in (0.02, 0.1, 0.5):
        ids = list(range(40))
        near = {(i, j) for i in ids for j in ids if i < j and rng.random() < density}
        pairs = spark.createDataFrame([(a, b, a) for a, b in near], "a long, b long, ra long")
        assert {r["b"]: r["leader"] for r in consolidate.leaders(pairs).collect()} == greedy(ids, near)


def test_merge_and_skills(spark):
    rows = [
        (1, "Bash", "cargo", "Task: Build project\nApproach: cargo build --release", 10, 1), (2, "Bash", "cargo", "Task: Build project\nApproach: cargo build for release", 8, 0), (3, "Edit", "rs", "Task: Fix type error\nApproach: Edit rust file", 5, 1),
        (4, "Edit", None, "Task: Refactor everything now", 150, 2), (5, "failure", None, "Task: Build project\nPitfall: x", 0, 3),
    ]
    p = spark.createDataFrame(rows, "id long, tool_type string, category string, context string, success long, failure long").withColumn("last_used", F.lit(None).cast("timestamp"))
    got = {r["tool_type"]: r for r in consolidate.skills(p).collect()}
    assert set(got) == {"Bash", "Edit"}
    s = got["Bash"]
    assert (s["name"], s["pattern_count"], s["total_success"], s["total_failure"], s["leader"], s["description"]) == ("Bash (cargo) - Build project", 2, 18, 1, 1, "cargo build --release")
    assert got["Edit"]["name"] == "Edit - Refactor everything now" and got["Edit"]["pattern_count"] == 1
    short = p.where("id = 1").select(F.lit(6).cast("long").alias("id"), F.lit("Read").alias("tool_type"), "category", F.lit("fix bug").alias("context"), "success", "failure", "last_used")
    short = short.unionByName(short.withColumns({"id": F.lit(7).cast("long"), "category": F.lit("py"), "context": F.lit("fix bug in the parser"), "success": F.lit(2).cast("long")}))
    merged = {r["id"]: (r["success"], r["failure"]) for r in consolidate.merge_similar(p.unionByName(short)).collect()}
    assert merged == {1: (10, 1), 2: (8, 0), 3: (5, 1), 4: (150, 2), 5: (0, 3), 6: (12, 2)}  # long texts score below the threshold even against nearly equal ones
    edges = spark.createDataFrame([(1, 3, 0.4, 5), (1, 99, 0.4, 5), (3, 3, 1.0, 5)], "a long, b long, lift double, co_occurrences long")
    left, kept, made = consolidate.consolidate(p, edges, "2024-01-20")
    assert [(r["a"], r["b"]) for r in kept.collect()] == [(1, 3)] and {r["id"]: r["success"] for r in left.collect()} == {1: 9, 2: 7, 3: 4, 4: 149, 5: 0} and made.count() == 2
    more = consolidate.insert_similar(p.select("id", "tool_type", "category", "context", "success", "failure", "last_used"), p.where("id = 2").select(F.lit(20).cast("long").alias("id"), "tool_type", "category", "context", "success", "failure", "last_used").unionByName(p.where("id = 4").select(F.lit(21).cast("long").alias("id"), F.lit("New").alias("tool_type"), "category", "context", "success", "failure", "last_used")), "2024-01-20")
    assert {r["id"]: r["success"] for r in more.collect()} == {1: 18, 2: 8, 3: 5, 4: 150, 5: 0, 21: 150}
    gone = consolidate.delete_patterns(p, edges, [1])
    assert gone[0].count() == 4 and gone[1].count() == 1


def outcome_of(spark, **x):
    return reflect.outcomes(spark.createDataFrame([trajectory(**x)], TRAJECTORY)).first()


def test_outcomes(spark):
    edit = [("Edit", {"file_path": "a.rs"})]
    o = outcome_of(spark, said="Successfully fixed", calls=edit, results=[("ok", False)])
    assert (o["success"], o["confidence"], o["retries"]) == (True, 0.9, 0)
    o = outcome_of(spark, calls=edit, results=[("Error: File not found", True)])
    assert (o["success"], o["confidence"], o["error_types"]) == (False, 0.85, ["other"])
    o = outcome_of(spark, said="I cannot do this. Let me try again", calls=edit)
    assert not o["success"] and o["abandoned"] and o["retries"] == 1
    o = outcome_of(spark, calls=edit, results=[("error[E0308]: mismatched types", False), ("fn main() { error: x }", False)])
    assert o["success"] and o["error_types"] == ["compile"]
    j = reflect.judged(spark.createDataFrame([trajectory(calls=edit, results=[("File edited successfully", False)]), trajectory(results=[("Error: File not found", True)]), trajectory(said="done"), trajectory()], TRAJECTORY)).collect()
    assert [(r["success"], r["confidence"]) for r in j] == [(True, 0.85), (False, 0.8), (True, 0.9), (False, 0.5)]


def test_reflection_scales_twice_and_is_applied_once(spark):
    p = spark.createDataFrame([(1, "Edit", None, "Task: x\nApproach: Edit - rs rust cargo editing a.rs\nOutcome: Success", 5, 2)], "id long, tool_type string, category string, context string, success long, failure long")
    edit = [("Edit", {"file_path": "a.rs", "old_string": "x"})]
    t = spark.createDataFrame([trajectory("s1", said="fixed", calls=edit, results=[("ok", False)]), trajectory("s2", said="I cannot do this", calls=edit), trajectory("s3", said="let me try again, fixed", calls=edit, results=[("ok", False)])], TRAJECTORY)
    none = spark.createDataFrame([], "trajectory_hash string")
    changed, new, log = reflect.reflect(t, p, none, "2024-01-20")
    got = {r["session_id"]: (r["verdict"], round(r["confidence"], 4), r["impact"], r["pattern_id"]) for r in new.collect()}
    assert got == {"s1": ("EFFECTIVE", 0.9, 5, 1), "s2": ("INEFFECTIVE", 0.75, -1, 1), "s3": ("EFFECTIVE", 0.81, 2, 1)}
    assert tuple(changed.first()) == (1, 5 + 5 + 2, 2 + 1) and log.first()["verdicts"] == 3  # 0.9 * 5 = 4.5, half away from zero
    assert tuple(reflect.reflect(t, p, new, "2024-01-20")[0].first()) == (1, 5, 2)
    v = spark.createDataFrame([(1, "EFFECTIVE", 0.6), (1, "INEFFECTIVE", 0.9), (1, "HARMFUL", 0.8), (1, "NEUTRAL", 1.0)], "pattern_id long, verdict string, confidence double")
    assert tuple(sessions.apply_verdicts(p.select("id", "success", "failure"), v).first()) == (1, 5 + 2, 2 + 1 + 3)
    assert [one(spark, x, sessions.verdict_name) for x in ("harmful", "Neutral", "odd")] == ["HARMFUL", "NEUTRAL", None]


def test_root_cause_takes_the_last_of_the_most_severe(spark):
    assert one(spark, "syntax,compile,other", lambda c: reflect.root_cause(F.split(c, ","))) == reflect.CAUSES["compile"]
    assert spark.range(1).select(reflect.root_cause(F.array().cast("array<string>"))).first()[0] == "Unknown error"


def entry(key, node, ts, success=1, failure=0, category=None, context=None, deleted=False, v=1):
    return (key, "Bash", category, context or f"{node}{ts}", success, failure, ts, node, {node: v}, deleted)


ENTRIES = "key string, tool_type string, category string, context string, success long, failure long, ts long, node string, version map<string,long>, deleted boolean"


def test_replica_merge_rules(spark):
    a = spark.createDataFrame([entry("h", "n1", 1, 10, 1, context="Build"), entry("t", "n1", 5), entry("x", "n1", 5, deleted=True), entry("only", "n1", 1), entry("s", "n1", 7, context="mine")], ENTRIES)
    b = spark.createDataFrame([entry("h", "n2", 2, 5, 3, "c", "Build and test"), entry("t", "n2", 5), entry("x", "n2", 4), entry("s", "n1", 7, context="theirs")], ENTRIES)
    last = {r["key"]: r for r in replicas.merge([a, b]).collect()}
    assert (last["h"]["success"], last["h"]["context"], last["h"]["version"]) == (5, "Build and test", {"n1": 1, "n2": 1})
    assert last["t"]["node"] == "n2" and last["x"]["deleted"] and last["only"]["version"] == {"n1": 1} and last["s"]["context"] == "theirs"
    adds = {r["key"]: r for r in replicas.merge([a, b], "add_only").collect()}
    assert (adds["h"]["success"], adds["h"]["failure"], adds["h"]["context"], adds["h"]["category"], adds["h"]["ts"]) == (10, 3, "Build and test", "c", 2)
    assert not adds["x"]["deleted"] and adds["s"]["context"] == "mine" and adds["t"]["node"] == "n1"
    gone = {r["key"]: r for r in replicas.delete(a, a.where("key = 'h'").select("key"), "n9", 50).collect()}
    assert gone["h"]["deleted"] and gone["h"]["ts"] == 50 and gone["h"]["version"] == {"n1": 1, "n9": 1} and not gone["t"]["deleted"]
    assert {r["node"]: r["version"] for r in replicas.state_vector(replicas.delete(a, a.select("key"), "n1", 9)).collect()} == {"n1": 2}
    more = replicas.insert(a, spark.createDataFrame([("h", "Bash", "k", "newer", 3, 3, 9)], "key string, tool_type string, category string, context string, success long, failure long, ts long"), "n3")
    assert {r["key"]: r["context"] for r in more.collect()}["h"] == "newer" and replicas.alive(more).count() == 4


def test_bundle_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, "a\nb", 3), (2, None, None), (3, "", 0)], "id long, context string, success long")
    for name, word in (("plain", None), ("sealed", "pass phrase")):
        schema = bundles.export_bundle(p, f"{tmp_path}/{name}", workspace="/home/me/x", passphrase=word)
        assert sorted(map(tuple, bundles.import_bundle(spark, f"{tmp_path}/{name}", schema, word).collect())) == [(1, "a\nb", 3), (2, None, None), (3, "", 0)]
        told = bundles.metadata(spark, f"{tmp_path}/{name}")
        assert told["pattern_count"] == 3 and told["encrypted"] == (word is not None) and len(told["source_workspace"]) == 16
    for word in ("other", None):
        with pytest.raises(Exception):
            bundles.import_bundle(spark, f"{tmp_path}/sealed", schema, word).collect()
    with pytest.raises(ValueError):
        bundles.export_bundle(p.where("1 = 0"), f"{tmp_path}/none")
    assert bundles.exportable(p.where("1 = 0")).isEmpty() and bundles.exportable(p.withColumn("hash", F.lit("h")), key="hash").where("id = 1").first()["hash"] != "h"


def test_a_bundle_is_merged_by_a_strategy(spark, tmp_path):
    table = spark.createDataFrame([(1, "Bash", 4, 4), (2, "Bash", 1, 0)], "key long, label string, success long, failure long")
    news = spark.createDataFrame([(1, "Bash", 3, 1), (2, "Bash", 1, 1), (3, "Edit", 1, 0)], table.schema)
    schema = bundles.export_bundle(news, str(tmp_path / "b"), text="label", passphrase="p")
    merged = lambda strategy: sorted(map(tuple, bundles.merge_bundle(spark, str(tmp_path / "b"), schema, table, strategy, "p").collect()))
    assert merged("add") == [(1, "Bash", 7, 5), (2, "Bash", 2, 1), (3, "Edit", 1, 0)] and merged("keep_best") == [(1, "Bash", 7, 5), (2, "Bash", 1, 0), (3, "Edit", 1, 0)]


def test_appended_lines_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    logs_, state = tmp_path / "logs", str(tmp_path / "state")
    (logs_ / "p" / "deep").mkdir(parents=True)
    (logs_ / "a.jsonl").write_text("one\ntwo\nhal")
    (logs_ / "p" / "b.jsonl").write_text("x\n" * 5)
    (logs_ / "p" / "deep" / "c.jsonl").write_text("too deep\n")
    count = lambda: {r["value"]: r["n"] for r in accumulate.run_available(appended.appended_lines(spark, str(logs_)), state, "value string, n long", accumulate.count_by("value")).collect()}
    assert count() == {"one": 1, "two": 1, "x": 5}
    with open(logs_ / "a.jsonl", "a") as f:
        f.write("f\nnext\n")
    assert count() == {"one": 1, "two": 1, "x": 5, "half": 1, "next": 1}


def test_pieces_of_a_file_give_each_line_once(tmp_path):
    lines = [("é" * (i % 7) + str(i)) for i in range(500)]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(lines) + "\n")
    reader, size = appended.Reader(str(tmp_path), ".jsonl"), path.stat().st_size
    for step in (1, 7, 100, 10_000):
        got = [x for b in range(0, size, step) for batch in reader.read(appended.Piece(str(path), b, min(b + step, size))) for x in batch.column(2).to_pylist()]
        assert got == lines


def test_relearn_forgets_the_table(spark):
    calls = spark.createDataFrame([("s", 1, "fix the bug", "Bash", '{"command": "cargo build --all --release"}')], "session_id string, seq long, user_query string, tool_name string, tool_input string")
    results = spark.createDataFrame([], "session_id string, seq long, user_query string, content string, is_error boolean")
    table = spark.createDataFrame([("h", "Bash", None, "old", 7, 1, None)], accumulate.PATTERNS)
    out = learn.relearn(calls, results, table, "2024-01-01 00:00:00").collect()
    assert [(r["tool_type"], r["success"], r["failure"]) for r in out] == [("Bash", 1, 0)]


def test_lift_in_parts_equals_one_fold(spark):
    rng = random.Random(2)
    rows = [(1, 2, i, rng.random() < 0.5) for i in range(3000)]
    want = 1.2 if rows[0][3] else 0.8
    for *_, ok in rows[1:]:
        want = want * 0.7 + (1.5 if ok else 0.3) * 0.3
    df = spark.createDataFrame(rows, "a long, b long, seq long, ok boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = graph.lift(df).first()
        state = spark.createDataFrame([], "a long, b long, lift double, co_occurrences long")
        for lo in range(0, 3000, 1000):
            state = accumulate.fold_lift(state, df.where(f"seq >= {lo} and seq < {lo + 1000}"), 0)
        streamed = state.first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["lift"] == pytest.approx(want, abs=1e-12) and got["co_occurrences"] == 3000 and streamed["lift"] == pytest.approx(want, abs=1e-12) and streamed["co_occurrences"] == 3000


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0]), (4, [0.0] * 4), (5, [1.0])], "id long, v array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, q array<float>")
    for size in (1, 1 << 20):
        assert [r["id"] for r in retrieve.nearest_vectors(q, v, 2, size).orderBy("place").collect()] == [1, 2]
    assert [r["v"] for r in v.orderBy("id").select(vectors.from_bytes(vectors.to_bytes(F.col("v"))).alias("v")).collect()] == [r["v"] for r in v.orderBy("id").collect()]
    index = v.where("id < 4")
    assert vectors.index_add(index, v.where("id in (3, 4)"), 4).count() == 4 and vectors.index_remove(index, v.where("id = 1").select("id")).count() == 2 and vectors.index_bytes(3, 4) == 12 + 24 + 48
    with pytest.raises(Exception):
        vectors.index_add(index, v.where("id = 5"), 4).collect()
    rows = spark.createDataFrame([(1, "running npm install", 3, 1), (2, "running cargo build", 0, 0), (3, "editing main.rs", 1, 0)], "id long, text string, success long, failure long")
    done = vectors.rebuild(rows.withColumn("embedding", F.lit(None).cast("array<float>")), "text", 64)
    assert tuple(vectors.status(done, 64).first()) == (3, 3, 0, 64)
    best = vectors.search(spark.createDataFrame([(9, "npm install")], "query_id long, text string"), rows, 1, 64).first()
    assert best["id"] == 1 and best["score"] == pytest.approx(best["sim"] * 0.75, abs=1e-4)


def test_nearest_equals_all_products(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.1 * rng.normal(size=8)).tolist()) for i in range(900)]
    rows += [(900, rows[5][1]), (901, None), (902, []), (903, [0.0] * 8), (904, [1.0] * 3), (905, [float("nan")] * 8)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 50 = 0 or id > 900").selectExpr("id as query_id", "v as q")
    m = {i: np.array(x) / max(np.linalg.norm(x), 1e-300) if x and len(x) == 8 and 1e-10 < np.linalg.norm(x) < 1e9 else np.zeros(8) for i, x in rows}
    m[904] = np.zeros(8)
    got = {}
    for r in retrieve.nearest_vectors(q, v, 7, 800).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["sim"], 6)))
    assert len(got) == q.count()
    for i, found in got.items():
        sims = {j: round(float(m[i] @ m[j]), 6) for j in m} if i != 904 else {j: float(j == 904) for j in m}
        assert found == [(j, pytest.approx(sims[j], abs=1e-6)) for j in sorted(sims, key=lambda j: (-sims[j], j))[:7]]
    assert retrieve.nearest_vectors(q.limit(0), v, 3).count() == 0 and retrieve.nearest_vectors(q, v.limit(0), 3).count() == 0


def test_groups_that_are_far_are_passed_over():
    rng = np.random.default_rng(1)
    rows = np.repeat(rng.normal(size=(20, 16)), 100, axis=0) + 0.01 * rng.normal(size=(2000, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    best = nearest.Best(rows[::50], 5)
    for lo in (0, 1000):
        best.add(np.arange(lo, lo + 1000), rows[lo : lo + 1000])
    assert best.compared < 40 * 2000 / 2


def test_log_events_and_lines(spark, tmp_path):
    (tmp_path / "p").mkdir()
    lines = [
        {"type": "system", "subtype": "init", "session_id": "s"}, {"type": "assistant", "session_id": "s", "message": {"role": "assistant", "model": "m", "usage": {"input_tokens": 3, "output_tokens": 4}, "content": [{"type": "tool_use", "name": "Edit"}, {"type": "text", "text": "hi"}]}},
        {"type": "result", "subtype": "success", "total_cost_usd": 0.5, "duration_ms": 12, "is_error": False, "result": "ok"},
    ]
    (tmp_path / "p" / "a.jsonl").write_text("\n".join(json.dumps(x, separators=(",", ":")) for x in lines) + "\n{bad\n")
    (tmp_path / "top.jsonl").write_text("{}\n")
    read = logs.read_lines(spark, str(tmp_path), below_only=True)
    assert read.count() == 4 and logs.read_lines(spark, str(tmp_path)).count() == 5
    assert [r["n"] for r in logs.assistant_lines(read).collect()] == [1]
    got = [(r["type"], r["subtype"], r["tool"], r["input_tokens"], r["cost"], r["text"]) for r in logs.flat_events(read).orderBy("line").collect()]
    assert got == [("system", "init", None, None, None, None), ("assistant", "tool_use", "Edit", 3, None, None), ("assistant", "text", None, 3, None, "hi"), ("result", "success", None, None, 0.5, "ok")]


def test_reports(spark):
    p = spark.createDataFrame([(1, "t", "c", 5, 1, None), (2, "t", None, 0, 3, "2024-01-01"), (3, "u", "c", 0, 0, None)], "id long, tool_type string, category string, success long, failure long, u string").withColumn("last_used", F.to_timestamp("u"))
    assert [r["id"] for r in patterns.in_category(p, "t", "c", 5).collect()] == [1] and [r["id"] for r in patterns.in_category(p, "t", None, 5).collect()] == [1, 2] and [r["id"] for r in patterns.prunable(p).collect()] == [2]
    assert tuple(patterns.status(p).first()) == (3, 5, 4, round(500 / 9, 6), round((500 / 6 + 0) / 2, 6), 2)


def test_counting_sorts_without_a_comparator(spark):
    """Terms sort by their own order, not by a function called for each pair of them."""
    from patternlake.functions import text as T

    df = spark.createDataFrame([(1, "b a b é zz a b"), (2, ""), (3, None)], "id long, text string").select("id", T.counted(F.split("text", " ")).alias("x"))
    assert {r["id"]: [tuple(y) for y in r["x"] or []] for r in df.collect()} == {1: [("a", 2), ("b", 3), ("zz", 1), ("é", 1)], 2: [("", 1)], 3: []}
    assert "sort_array" in (plan := df._jdf.queryExecution().toString()) and "array_sort" not in plan


def test_hash_embeddings_are_arrays_of_floats(spark):
    """A task holds a batch's vectors as 4 bytes a component, not as a Python object each."""
    import pandas as pd

    from patternlake.functions import vectors as E
    from patternlake.operators import retrieve as R

    got = R.hash_embed(8).func(pd.Series(["some words", "", None]))
    assert [(v.dtype.name, v.shape) for v in got] == [("float32", (8,))] * 3
    df = spark.createDataFrame([(1, "some words"), (2, ""), (3, None)], "id long, text string").select("id", R.hash_embed(8)("text").alias("v"))
    back = df.select("id", "v", E.from_bytes(E.to_bytes(F.col("v"))).alias("w")).collect()
    assert all(r["v"] == r["w"] and len(r["v"]) == 8 for r in back)


def test_texts_are_dealt_by_their_bytes(spark):
    """More text makes more tasks, and what they count by text isn't dealt again."""
    df = spark.createDataFrame([(i, f"alpha beta gamma{i}") for i in range(40)], "query_id long, query string")
    assert retrieve.dealt(df, "query_id", "query", 20).rdd.getNumPartitions() > 30 > retrieve.dealt(df, "query_id", "query").rdd.getNumPartitions()
    items = spark.createDataFrame([(1, "beta", 0), (2, "alpha beta gamma3", 1), (3, "gamma3 alpha", 2)], "id long, context string, rank long")
    found = retrieve.first_overlap(df, items)
    assert {(r["query_id"], r["id"], r["shared"]) for r in found.collect()} == {(i, 2, 3 if i == 3 else 2) for i in range(40)}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
