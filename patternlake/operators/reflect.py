"""Reflection: outcomes of trajectories, verdicts on the patterns they used, and what those do to the counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from . import learn as L
from . import sessions as N
from .retrieve import hinted, scored

#: What an error's output contains, and what tells that it is code; "::" counts together with "{".
FORMATS = ("error:", "error[", "failed:", "fatal:", "panic:", "exception:")
CODE = ("fn ", "def ", "function ", "class ", "impl ", "pub fn", "const ", "let ", "=>", "->")
#: Longest content that is looked at, least severity that counts, boost and penalty, and the least confidence of a verdict that is applied.
LONGEST, SEVERE, BOOST, PENALTY, CONFIDENT = 1000, 3, 5, -5, 0.6
#: Cues by which a trajectory is judged.
FAILED, COMPLETE = ("error:", "failed:", "exception:"), ("complete", "done", "success", "finished")
#: Causes by error type.
CAUSES = {
    "compile": "Compilation failed - check syntax and types", "runtime": "Runtime error - check logic and edge cases", "not_found": "File not found - verify path exists", "permission": "Permission denied - check file permissions",
    "timeout": "Operation timed out - consider optimization", "syntax": "Syntax error - review code structure", "test": "Tests failed - check assertions and expected behavior", "other": "Error: explicit error",
}


def judged(trajectories: DataFrame) -> DataFrame:
    """Adds success and confidence by simple cues: no failed result, and tools or words of completion."""
    bad = F.exists("tool_results", lambda r: r["is_error"] | T.any_of(F.lower(r["content"]), FAILED))
    done, tools = T.any_of(F.lower("assistant_content"), COMPLETE), F.size("tool_calls") > 0
    confidence = F.when(bad, 0.8).when(tools, 0.85).when(done, 0.9).otherwise(0.5)
    return trajectories.withColumns({"success": ~bad & (tools | done), "confidence": confidence})


def root_cause(types: Column) -> Column:
    """Cause of the most severe of some error types, the last of equals."""
    worst = F.array_max(F.transform(types, lambda t, i: F.struct(N.severity(t).alias("severity"), i.alias("i"), t.alias("type"))))["type"]
    return F.when(F.size(types) == 0, "Unknown error").otherwise(F.try_element_at(L.literal_map(CAUSES), worst))


def outcomes(trajectories: DataFrame) -> DataFrame:
    """Adds success, retries, error_types, abandoned and confidence to trajectories (assistant_content, tool_calls, tool_results).

    Results flagged as errors count as such and hide all others; else short contents in the format of errors, that
    aren't code, count if they are severe. Giving up fails, words of success succeed, and so do most tools.
    """
    low, said = lambda r: F.lower(r["content"]), F.lower("assistant_content")
    code = lambda t: T.any_of(t, CODE) | (F.contains(t, F.lit("::")) & F.contains(t, F.lit("{")))
    flagged = F.transform(F.filter("tool_results", lambda r: r["is_error"]), lambda r: F.lit("other"))
    output = F.filter("tool_results", lambda r: (F.octet_length(r["content"]) <= LONGEST) & T.any_of(low(r), FORMATS) & ~code(low(r)))
    severe = F.filter(F.transform(output, lambda r: N.error_type(r["content"])), lambda t: N.severity(t) >= SEVERE)
    rows = trajectories.withColumns({"error_types": F.when(F.size(flagged) > 0, flagged).otherwise(severe), "retries": N.phrase_count(F.col("assistant_content"), N.RETRIES), "abandoned": T.any_of(said, N.GIVEN_UP)})
    well, bad, total = F.size(F.filter("tool_results", lambda r: ~r["is_error"])), F.size("error_types") > 0, F.size("tool_results")
    good, tools = T.any_of(said, N.SUCCESS), F.size("tool_calls") > 0
    most = 2 * well > total
    success = F.when(F.col("abandoned"), False).when(good, True).when(bad & (well == 0), False).when(~bad & tools, True).when(bad & (well > 0) & most, True).otherwise(~bad)
    return rows.withColumns({"success": success, "confidence": F.when(bad, 0.85).when(good, 0.9).when(tools, 0.75).otherwise(0.5)})


def trajectory_hash() -> Column:
    return F.md5(F.concat_ws("\0", "session_id", "user_query", F.to_json("tool_calls")).cast("binary"))


def first_call(trajectories: DataFrame) -> DataFrame:
    """Adds tool_type and query of each trajectory's first call, null without calls."""
    first = F.get("tool_calls", F.lit(0))
    return trajectories.withColumns({"tool_type": first["tool_name"], "query": L.context(first["tool_name"], first["tool_input"], path_too=True)})


def matched(asked: DataFrame, patterns: DataFrame, per_type: int = 20, least: float = 0.05) -> DataFrame:
    """tool_type, query, pattern_id: of a type's per_type best patterns the one that scores highest against a query (asked: tool_type, query, each once), the best ranked of equals, if above least."""
    met = scored(asked.where("tool_type is not null"), patterns, per_type).where(F.col("sim") > least)
    return met.groupBy("tool_type", "query").agg(F.min_by("id", F.struct((-F.col("sim")).alias("s"), "rank", "id")).alias("pattern_id"))


def verdicts(trajectories: DataFrame, patterns: DataFrame) -> DataFrame:
    """A verdict on each trajectory: trajectory_hash, session_id, pattern_id (null if none matches), verdict, confidence, impact, root_cause.

    Trajectories are read once; what their first calls ask is scored once where it repeats.
    """
    o = first_call(outcomes(trajectories))
    conf, tried, severe = F.col("confidence"), F.col("retries") > 0, F.exists("error_types", lambda t: N.severity(t) >= SEVERE)
    reduced = conf * F.greatest(F.lit(1.0) - F.col("retries") * 0.1, F.lit(0.3))
    failed, bad = ~F.col("success"), F.size("error_types") > 0
    kind = F.when(F.col("success"), "EFFECTIVE").when(F.col("abandoned"), "INEFFECTIVE").when(bad & severe, "HARMFUL").when(bad, "INEFFECTIVE").otherwise("NEUTRAL")
    own = F.when(F.col("success") & tried, reduced).when(F.col("success") | F.col("abandoned") | (bad & severe), conf).when(bad, conf * 0.8).otherwise(1.0)
    boost = F.when(tried, BOOST // 2).otherwise(BOOST)
    cause = F.when(failed & ~F.col("abandoned") & bad & severe, root_cause(F.col("error_types")))
    rows = cut(o.select("session_id", trajectory_hash().alias("trajectory_hash"), kind.alias("verdict"), own.alias("confidence"), boost.alias("boost"), cause.alias("root_cause"), "tool_type", "query"))
    rows = rows.withColumn("impact", N.score_impact(F.col("verdict"), F.col("confidence"), F.col("boost"), PENALTY))
    found = hinted(cut(matched(rows.select("tool_type", "query").distinct(), patterns)))
    return rows.join(found, ["tool_type", "query"], "left").select("trajectory_hash", "session_id", "pattern_id", "verdict", "confidence", "impact", "root_cause")


def reflect(trajectories: DataFrame, patterns: DataFrame, stored: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One cycle: counters of patterns (id, success, failure) after it, the new verdicts to append to stored, and a row for the log.

    Verdicts below CONFIDENT are dropped. A trajectory that stored already has a verdict on is passed over, so running a
    cycle again changes nothing.
    """
    new = verdicts(trajectories, patterns).where(F.col("confidence") >= CONFIDENT).join(stored.select("trajectory_hash").distinct(), "trajectory_hash", "left_anti")
    new = new.withColumn("created_at", F.lit(now).cast("timestamp"))
    changed = N.apply_verdicts(patterns, new.where("pattern_id is not null"))
    counts = {k.lower(): F.count_if(F.col("verdict") == k).alias(k.lower()) for k in N.VERDICTS}
    log = new.agg(F.count("*").alias("verdicts"), *counts.values(), F.count_distinct("pattern_id").alias("patterns")).withColumn("created_at", F.lit(now).cast("timestamp"))
    return changed, new, log


def demotions(stored: DataFrame, threshold: float = 2.0) -> DataFrame:
    """pattern_id of patterns whose harmful verdicts' confidence is more than threshold times that of the effective ones."""
    sums = stored.where("pattern_id is not null").groupBy("pattern_id").agg(*(F.sum(F.when(F.col("verdict") == k, F.col("confidence")).otherwise(0.0)).alias(k.lower()) for k in ("EFFECTIVE", "HARMFUL")))
    return sums.where(F.col("harmful") > F.col("effective") * threshold).select("pattern_id")
