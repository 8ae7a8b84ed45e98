"""Reports, retrieval in two stages, and index files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternlake.operators import reports, retrieve
from patternlake.sources import index_file


def test_index_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {i - 50: rng.normal(size=5).astype(np.float32).tolist() for i in range(101)}
    rows = spark.createDataFrame(list(want.items()), "id long, vector array<float>").repartition(3)
    path = str(tmp_path / "index")
    index_file.write_index(rows, path, 5)
    back = index_file.read_index(spark, path, 200)
    assert back.rdd.getNumPartitions() > 10 and {r["id"]: r["vector"] for r in back.collect()} == want
    files = sorted(p for p in (tmp_path / "index").iterdir() if p.suffix == ".idx")
    raw = files[0].read_bytes()
    n = struct.unpack("<IQ", raw[:12])[1]
    assert len(files) == 3 and len(raw) == 12 + 8 * n + 4 * 5 * n and struct.unpack("<q", raw[12:20])[0] in want
    assert index_file.read_index(spark, str(files[0])).count() == n  # a file by itself
    index_file.write_index(rows.where("id > 0"), path, 5, "append")
    assert index_file.read_index(spark, path).count() == 151
    with pytest.raises(Exception, match="dimensions"):
        index_file.write_index(rows.union(spark.createDataFrame([(7, [1.0])], rows.schema)), path, 5)
    assert index_file.read_index(spark, path).count() == 151  # a failed job changes nothing
    index_file.write_index(rows.limit(0), path, 5)
    assert index_file.read_index(spark, path).count() == 0
    (tmp_path / "bad.idx").write_bytes(raw[:-1])
    with pytest.raises(Exception, match="no index file"):
        index_file.read_index(spark, str(tmp_path / "bad.idx")).count()


def test_two_stages(spark):
    rows = [(1, "Edit", "Approach: editing rs rust cargo file main.rs\nmore", 5, 1), (2, "Bash", "cargo build and cargo test " + "long " * 30, 0, 0), (3, "Edit", "python py file run.py", 9, 0)]
    p = spark.createDataFrame(rows, "id long, tool_type string, context string, success long, failure long")
    asks = spark.createDataFrame([(1, "edit", '{"input": {"file_path": "/src/main.rs"}}'), (2, "bash", '{"command": "cargo test"}'), (3, "read", "not json"), (4, "bash", '{"input": {"command": 7}, "command": "zsh"}')], "query_id long, tool string, input string")
    found = {(r["query_id"], r["place"]): (r["id"], r["score"], r["rate"], r["line"]) for r in retrieve.two_stage(asks, p).collect()}
    assert found[1, 1] == (1, 4, 83, "Approach: editing rs rust cargo file main.rs")
    assert found[2, 1][:3] == (2, 0, 0) and found[2, 1][3].endswith("...") and len(found[2, 1][3]) == 100 and all(q in (1, 2) for q, _ in found)
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [0.0, 1.0]), (99, [1.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(3, [1.0, 0.1])], "query_id long, q array<double>")
    both = retrieve.two_stage(asks, p, v, q)
    got = {(r["query_id"], r["place"]): (r["id"], r["score"]) for r in both.collect()}
    assert got == {(1, 1): (1, 4), (2, 1): (2, 0), (3, 1): (3, 3), (3, 2): (1, 1)}  # hits by vector have any type and their id as score; a pattern that is gone is none
    texts = {r["query_id"]: r["text"] for r in retrieve.two_stage_block(both, asks).collect()}
    assert texts[4] == '{"input": {"command": 7}, "command": "zsh"}' and texts[3] == "<context>\n**Relevant patterns from previous successful operations:**\n\n- **Edit** (score: 3, 100% success rate)\n  python py file run.py\n\n- **Edit** (score: 1, 83% success rate)\n  Approach: editing rs rust cargo file main.rs\n</context>\n\nnot json"
    assert retrieve.two_stage(asks.limit(0), p).count() == 0 and retrieve.two_stage(asks, p.limit(0)).count() == 0


def test_reports_of_odd_tables(spark):
    p = spark.createDataFrame([(1, "Bash", "one\ntwo\nthree", 3, 1), (2, "Bash", "x" * 120, 9, 0), (3, None, None, 0, 0), (4, "Odd", "odd", 50, 0)], "id long, tool_type string, context string, success long, failure long")
    got = {(r["tool_type"], r["total"]): (r["n"], r["success"], r["failure"], r["rate"]) for r in reports.pattern_statistics(p).collect()}
    assert got == {("Bash", False): (2, 12, 1, round(1200 / 13, 6)), (None, False): (1, 0, 0, None), ("Odd", False): (1, 50, 0, 100.0), (None, True): (4, 62, 1, round(6200 / 63, 6))}
    assert [(r["tool_type"], r["place"], r["id"], r["score"], r["preview"]) for r in reports.sample(p, 2).orderBy("place").collect()] == [("Bash", 1, 2, 9, "x" * 100 + "..."), ("Bash", 2, 1, 2, "one | two")]
    assert sorted(r["id"] for r in reports.known_and_best(p, 1, 1).collect()) == [2, 4] and sorted(r["id"] for r in reports.known_and_best(p).collect()) == [1, 2, 3, 4]
    s = spark.createDataFrame([("a", "Bash", 3, 1, 2), ("b", "Bash", 0, 0, 3), ("c", "Edit", 9, 0, 2)], "name string, tool_type string, total_success long, total_failure long, pattern_count long")
    assert {(r["tool_type"], r["total"]): (r["n"], r["patterns"], r["rate"]) for r in reports.skill_statistics(s).collect()} == {("Bash", False): (2, 5, 75.0), ("Edit", False): (1, 2, 100.0), (None, True): (3, 7, 87.5)}
    assert [r["name"] for r in reports.top_skills(s, 2).collect()] == ["c", "a"] and [r["name"] for r in reports.top_skills(s, 5, "Bash").collect()] == ["a", "b"]
    v, log = spark.createDataFrame([("EFFECTIVE",), ("HARMFUL",), ("EFFECTIVE",)], "verdict string"), spark.createDataFrame([("r", 2, "2024-01-01"), ("r", 5, "2024-01-02")], "event_type string, verdicts long, t string").withColumn("created_at", F.to_timestamp("t"))
    row = reports.reflection_status(v, log).first()
    assert (row["total"], row["effective"], row["harmful"], row["neutral"], row["cycles"], row["last_verdicts"]) == (3, 2, 1, 0, 2, 5)
    row = reports.reflection_status(v.limit(0), log.limit(0)).first()
    assert (row["total"], row["effective"], row["cycles"], row["last"], row["last_verdicts"]) == (0, 0, 0, None, 0)
    assert [r["created_at"].day for r in reports.history(log, 1).collect()] == [2]
    assert [r["id"] for r in reports.ranked("two words", p).collect()] == [1] and reports.ranked("", p).count() == 0
