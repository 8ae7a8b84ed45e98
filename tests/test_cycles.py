"""Accumulating streams, cycles of learning, and edges in batch and stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from patternlake.operators import consolidate, graph, learn
from patternlake.streaming import accumulate

CALL = ("Bash", '{"command": "cargo build --release", "description": "Build the project for release"}')
CALL2 = ("Bash", '{"command": "cargo build --all", "description": "Build the project for release too"}')
EDIT = ("Edit", '{"file_path": "/src/main.rs", "old_string": "let x"}')
READ = ("Read", '{"file_path": "/src/lib.rs", "pattern": "fn main"}')
SCHEMA = "session_id string, user_query string, assistant_content string, tool_calls array<struct<tool_name string, tool_input string>>, tool_results array<struct<content string, is_error boolean>>"
NOW = "2024-01-01 00:00:00"


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


class Clock:
    def __init__(self):
        self.now = datetime(2024, 1, 1)

    def __call__(self):
        return self.now


def fed(spark, tmp_path, acc, ids):
    spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    acc.run_available(spark.readStream.schema("id long").parquet(str(tmp_path / "rows")))


def test_all_waiting_rows_are_handed_over(spark, tmp_path):
    seen, fail = [], [False]

    def act(rows, n):
        if fail[0]:
            raise RuntimeError
        seen.append((n, sorted(r["id"] for r in rows.collect())))

    acc = accumulate.Accumulator(spark, str(tmp_path / "run"), spark.range(0).schema, act, enough=15)
    fed(spark, tmp_path, acc, range(10))
    assert not seen and acc.held().pending == 10 and acc.waiting().count() == 10
    fed(spark, tmp_path, acc, range(10, 15))
    assert seen == [(0, list(range(15)))] and acc.held().pending == 0 and acc.waiting().count() == 0
    fail[0] = True
    fed(spark, tmp_path, acc, range(15, 32))
    assert (acc.held().failures, acc.held().pending) == (1, 17)
    fail[0] = False
    acc.tick()  # what failed is tried again with all its rows
    assert seen[1] == (1, list(range(15, 32))) and acc.held().failures == 0
    fail[0] = True
    fed(spark, tmp_path, acc, range(32, 50))
    acc.tick()
    acc.tick()
    held = acc.held()
    assert (held.pending, held.dropped, held.failures, held.cycles) == (0, 18, 0, 2) and acc.set_aside().count() == 18  # set aside, not lost
    n = accumulate.numbered(spark, acc.states.base)[-1]
    acc.take(spark.range(5), held.batch)  # a batch that is run again
    assert accumulate.numbered(spark, acc.states.base)[-1] == n


def test_time_makes_a_cycle_due(spark, tmp_path):
    seen, clock = [], Clock()
    acc = accumulate.Accumulator(spark, str(tmp_path / "run"), spark.range(0).schema, lambda rows, n: seen.append(rows.count()), enough=50, hours=4, clock=clock)
    acc.tick()
    assert not seen  # nothing waits
    fed(spark, tmp_path, acc, range(3))
    assert seen == [3]  # there was no cycle before
    fed(spark, tmp_path, acc, range(3, 5))
    clock.now += timedelta(hours=3, minutes=59)
    acc.tick()
    assert seen == [3]
    clock.now += timedelta(minutes=1)
    acc.run_available(spark.readStream.schema("id long").parquet(str(tmp_path / "rows")))  # nothing new comes
    assert seen == [3, 2]


def test_due(spark):
    due = lambda n, last: spark.range(1).select(accumulate.reflection_due(F.lit(n), F.lit(last).cast("timestamp"), F.lit("2024-01-01 12:00:00").cast("timestamp"))).first()[0]
    assert due(50, "2024-01-01 11:00:00") and due(1, "2024-01-01 08:00:00") and not due(1, "2024-01-01 08:30:00") and due(1, None) and not due(0, None)


def test_an_idle_stream_keeps_its_state(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "k string").write.parquet(str(tmp_path / "rows"))
    run = lambda: accumulate.run_available(spark.readStream.schema("k string").parquet(str(tmp_path / "rows")), str(tmp_path / "run"), "k string, n long", accumulate.count_by("k"))
    first, again = (sorted(map(tuple, run().collect())) for _ in range(2))
    assert first == again == [("a", 2), ("b", 1)]


def trajectories(n, calls=(CALL, EDIT, CALL2)):
    return [(f"s{i:02}", f"fix bug {i}", "done" if i % 3 else "", list(calls), [(f"error: cannot find value number{i} in this scope", True)] if i % 2 else []) for i in range(n)]


def test_session_end(spark, tmp_path):
    base, rows = str(tmp_path / "run"), trajectories(20)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "rows"))
    for part, waiting in ((rows[:10], 10), (rows[10:], 0), (rows[:3], 3)):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(str(tmp_path / "rows"))
        ended = accumulate.session_end(stream(), base, NOW)
        assert ended.waiting.count() == waiting and (ended.patterns.count() == 0) == (waiting == 10)
    t = spark.createDataFrame(rows, SCHEMA)
    new = learn.learn_cycle(t, spark.createDataFrame([], accumulate.PATTERNS), spark.createDataFrame([], accumulate.EDGES), NOW)
    known, kept, skills = consolidate.consolidate(new.patterns.withColumn("id", F.xxhash64("hash")), new.edges, NOW)
    assert kept.count() > 0 and skills.count() > 0
    again = accumulate.session_end(stream(), base, NOW)  # nothing new: what is stored
    for got in (ended, again):
        assert rows_of(got.patterns, "hash", "tool_type", "context", "success", "failure") == rows_of(known, "hash", "tool_type", "context", "success", "failure")
        assert rows_of(got.edges, "a", "b", "lift", "co_occurrences") == rows_of(kept, "a", "b", "lift", "co_occurrences")
        assert rows_of(got.skills, "name", "pattern_count") == rows_of(skills, "name", "pattern_count") and got.waiting.count() == 3
        assert [(r["event_type"], r["trajectories"], r["calls"]) for r in got.log.collect()] == [("foreground_learning", 20, 60)]


def test_shared_patterns(spark):
    p = spark.createDataFrame([
        (1, "Bash", "Approach: Bash - cargo - Build the project for release", 5, 0), (2, "Bash", "Build the project too", 9, 0), (3, "Edit", "rs rust cargo editing main.rs", 1, 0), (4, "Read", "nothing in common", 1, 0),
    ], "id long, tool_type string, context string, success long, failure long")
    rows = [("s1", "q", "", [CALL, EDIT, CALL, READ], []), ("s2", "q", "", [READ, EDIT, CALL], [("error: x", False)]), ("s3", "q", "", [], []), ("s4", "q", None, None, None)]
    got = learn.shared_patterns(spark.createDataFrame(rows, SCHEMA), p).collect()
    # The better ranked of two matches; a call without one doesn't stand between the others; a fourth call doesn't count.
    assert sorted((r["a"], r["b"], r["seq"]["session_id"], r["seq"]["i"], r["seq"]["j"], r["ok"]) for r in got) == [(2, 3, "s1", 0, 1, True), (2, 3, "s1", 1, 2, True), (2, 3, "s2", 1, 2, False)]
    assert learn.shared_patterns(spark.createDataFrame([], SCHEMA), p).count() == 0


def test_edges_of_batch_and_stream_are_equal(spark, tmp_path):
    rows, none = trajectories(18, (CALL, EDIT, READ)), spark.createDataFrame([], accumulate.EDGES)
    table = learn.learn_cycle(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], accumulate.PATTERNS), none, NOW).patterns
    found = lambda part: learn.shared_patterns(spark.createDataFrame(part, SCHEMA), table.withColumn("id", F.xxhash64("hash")))
    whole = {(r["a"], r["b"]): (r["lift"], r["co_occurrences"]) for r in graph.lift(found(rows)).collect()}
    parts, state = [rows[:5], rows[5:6], rows[6:]], none
    for i, part in enumerate(parts):
        found(part).write.mode("append").parquet(str(tmp_path / "pairs"))
        state = accumulate.run_available(spark.readStream.schema(found(rows).schema).parquet(str(tmp_path / "pairs")), str(tmp_path / "run"), accumulate.EDGES, accumulate.fold_lift)
    streamed = {(r["a"], r["b"]): (r["lift"], r["co_occurrences"]) for r in state.collect()}
    assert whole and whole.keys() == streamed.keys() and all(streamed[k][0] == pytest.approx(v[0], abs=1e-12) and streamed[k][1] == v[1] for k, v in whole.items())


def test_logs_are_appended_once(spark, tmp_path):
    for batch, n in ((0, 2), (1, 3), (1, 3), (0, 2)):
        accumulate.append_once(spark.range(n), str(tmp_path / "log"), batch)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5


def test_equal_calls_are_taken_apart_once(spark, monkeypatch):
    """As patterns of each call, but an input is parsed once, and equal calls of equal queries are one row."""
    told = [*(CALL, EDIT, READ, CALL) * 5, ("Read", None), ("Read", '{"path": "/a.b/c"}'), ("Read", '{"path": "/c"}'), ("Bash", "no json"), ("Other", "{}")]
    calls = [(f"s{i % 3}", i, "fix it" if i % 2 else "run the tests", *c) for i, c in enumerate(told)]
    calls = spark.createDataFrame(calls, "session_id string, seq long, user_query string, tool_name string, tool_input string")
    results = spark.createDataFrame([("s1", i, "fix it", "Error: cannot find the file at hand", True) for i in range(5)], "session_id string, seq long, user_query string, content string, is_error boolean")
    plan = calls.select(learn.context(F.col("tool_name"), F.col("tool_input")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") == 1
    kept, cut = [], learn.cut
    monkeypatch.setattr(learn, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    for dedup in ("first", "sum"):
        want = learn.distinct_patterns(learn.call_patterns(calls).unionByName(learn.failure_patterns(results)), dedup)
        got = learn.found_patterns(calls, results, dedup)
        assert rows_of(got, *learn.PATTERN) == rows_of(want, *learn.PATTERN)
        assert kept[-1].count() == calls.where("tool_name <> 'Other'").select("user_query", "tool_name", "tool_input").distinct().count()


def test_equal_calls_are_matched_once(spark, monkeypatch):
    p = spark.createDataFrame([(1, "Bash", "build the project", 5, 0), (2, "Read", "exploring the codebase", 3, 0)], "id long, tool_type string, context string, success long, failure long")
    t = spark.createDataFrame([(f"s{i}", "q", "done", [CALL, ("Read", None), ("Other", "{}")], []) for i in range(20)], SCHEMA)
    kept, cut = [], learn.cut
    monkeypatch.setattr(learn, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = learn.shared_patterns(t, p).collect()
    assert sorted((r["a"], r["b"], r["seq"]["session_id"]) for r in got) == sorted((1, 2, f"s{i}") for i in range(20))
    assert max(x.count() for x in kept) <= 3
