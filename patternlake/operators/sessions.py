"""Sessions folded from messages, their outcomes, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of

#: Phrases of retries, of giving up and of success.
RETRIES = ("let me try", "trying again", "another approach", "different approach", "let me fix", "i'll retry")
GIVEN_UP = ("i cannot", "i'm unable", "this is not possible", "beyond my capabilities", "i don't have access")
SUCCESS = ("successfully", "completed", "done", "finished", "fixed", "implemented", "working")
#: By error type its severity and its phrases; the first type that has one counts.
ERRORS = {
    "compile": (3, ("error[e", "error: cannot find", "error: expected", "error: mismatched", "undefined reference to", "ld: symbol(s) not found", "cannot find module", "module not found", "import error:")),
    "runtime": (4, ("runtime error:", "panicked at", "thread 'main' panicked", "segmentation fault", "sigsegv", "stack overflow", "abort trap", "core dumped", "process exited with", "unhandled exception")),
    "not_found": (2, ("no such file", "file not found")),
    "permission": (2, ("permission denied", "access denied")),
    "timeout": (5, ("timeout exceeded", "timeout error", "operation timed out", "request timed out", "connection timed out")),
    "syntax": (3, ("syntax error:", "syntaxerror:", "unexpected token", "parse error:", "parsing error:", "invalid syntax", "expected `;`", "expected `{`", "expected `}`", "missing semicolon")),
    "test": (2, ("test result: failed", "tests failed", "assertion failed:", "assertionerror:", "fail: ")),
    "other": (1, ("error: ", "error!", "failed!", "exception:", ": error", "exited with error", "returned error", "threw exception", "fatal error", "critical error")),
}
#: Phrases that tell an unspecified error isn't one.
NO_ERROR = ("0 error", "no error", "without error", "error handling", "error message", "errortype", "errors.is_empty", "expected error")


def error_type(text: Column) -> Column:
    low = F.lower(text)
    hit = {name: any_of(low, phrases) for name, (_, phrases) in ERRORS.items()}
    has = lambda p: F.contains(low, F.lit(p))
    hit["not_found"] |= has("not found") & any_of(low, ("error", "errno", "failed", "cannot"))
    hit["timeout"] |= has("timed out") & ~has("timeout_")
    hit["test"] |= has("failures:") & has("passed")
    hit["other"] &= ~any_of(low, NO_ERROR)
    out = F.when(F.lit(False), F.lit(""))
    for name, found in hit.items():
        out = out.when(found, F.lit(name))
    return out


def severity(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, (n, _) in ERRORS.items():
        out = out.when(kind == name, F.lit(n))
    return out


def phrase_count(text: Column, phrases) -> Column:
    low = F.lower(text)
    return sum(((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p) for p in phrases), F.lit(0)).cast("long")


def fold_sessions(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text): first user text, assistant texts by turn joined by line ends, and counts."""
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    return turns.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("user_query"),
        F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("assistant_content"),
        F.count("*").alias("turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
    )


def outcome(sessions: DataFrame) -> DataFrame:
    """Retries, giving up and success by the assistant's words."""
    said = F.col("assistant_content")
    low = F.lower(said)
    return sessions.select("conv_id", phrase_count(said, RETRIES).alias("retries"), any_of(low, GIVEN_UP).alias("abandoned"), any_of(low, SUCCESS).alias("succeeded"))


VERDICTS = ("EFFECTIVE", "INEFFECTIVE", "HARMFUL", "NEUTRAL")


def score_impact(category: Column, confidence: Column, boost: int | Column = 5, penalty: int = -5) -> Column:
    """Impact of a verdict on a pattern's score, half away from zero."""
    return F.when(category == "EFFECTIVE", F.round(boost * confidence)).when(category == "HARMFUL", F.round(penalty * confidence)).when(category == "INEFFECTIVE", F.lit(-1.0)).otherwise(0.0).cast("long")


def score_change(impact: Column, confidence: Column, boost: int = 5, penalty: int = -5) -> Column:
    """What an impact does to a counter: it is scaled by the confidence once more, and kept within penalty and boost."""
    return F.greatest(F.lit(penalty), F.least(F.lit(boost), F.round(impact * confidence))).cast("long")


def verdict_name(text: Column) -> Column:
    """A verdict's name in upper case, from either case; null if there is none such."""
    return F.when(F.upper(text).isin(*VERDICTS), F.upper(text))


def verdict_stats(verdicts: DataFrame) -> DataFrame:
    """verdicts (pattern_id, verdict, confidence): counts by category, mean confidence, and shares of effective and harmful ones of each pattern."""
    kinds = {k.lower(): F.count_if(F.col("verdict") == k).alias(k.lower()) for k in VERDICTS}
    stats = verdicts.groupBy("pattern_id").agg(F.count("*").alias("total"), *kinds.values(), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"))
    return stats.withColumns({name: F.round(F.col(k) / F.col("total"), 6) for name, k in (("effectiveness", "effective"), ("harm", "harmful"))})


def apply_verdicts(patterns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Positive changes go to success, negative ones to failure. verdicts (pattern_id, verdict, confidence, and impact if it isn't to be told from these); changes are added up before they meet the patterns."""
    impact = F.col("impact") if "impact" in verdicts.columns else score_impact(F.col("verdict"), F.col("confidence"))
    change = score_change(impact, F.col("confidence"))
    sums = verdicts.groupBy(F.col("pattern_id").alias("id")).agg(F.sum(F.greatest(change, F.lit(0))).alias("up"), F.sum(F.greatest(-change, F.lit(0))).alias("down"))
    both = patterns.join(sums, "id", "left")
    return both.select("id", (F.col("success") + F.coalesce("up", F.lit(0))).alias("success"), (F.col("failure") + F.coalesce("down", F.lit(0))).alias("failure"))
