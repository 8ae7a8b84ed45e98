"""Reports on pattern tables, graphs, skills and verdicts, each by one pass over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import sessions as N
from .patterns import SORTS

#: Types that a sample shows, and those that an export asks for by name.
SHOWN = ("failure", "Bash", "Edit", "Write", "Task")
KNOWN = ("Bash", "Edit", "Write", "Read", "Task", "Glob", "Grep", "WebSearch", "failure")


def by_type(rows: DataFrame, *sums: Column) -> DataFrame:
    """tool_type, n and sums of each type and of all rows (whose tool_type is null and total true); a null type is one of its own."""
    out = rows.rollup("tool_type").agg(F.count("*").alias("n"), F.grouping("tool_type").alias("g"), *sums)
    return out.withColumn("total", F.col("g") == 1).drop("g")


def pattern_statistics(patterns: DataFrame) -> DataFrame:
    """tool_type, n, success, failure, rate (percent, null without uses), total: a row a type and one for all."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = by_type(patterns, zero("success"), zero("failure"))
    return out.withColumn("rate", F.round(100.0 * F.try_divide("success", F.col("success") + F.col("failure")), 6))


def skill_statistics(skills: DataFrame) -> DataFrame:
    """tool_type, n, patterns, rate (the mean of the skills' rates in percent), total: a row a type and one for all."""
    rate = F.avg(F.try_divide("total_success", F.col("total_success") + F.col("total_failure")) * 100)
    return by_type(skills, F.coalesce(F.sum("pattern_count"), F.lit(0)).alias("patterns"), F.round(rate, 6).alias("rate"))


def top_skills(skills: DataFrame, limit: int, tool_type: str | None = None) -> DataFrame:
    """The limit best skills by score, of a type or of all."""
    own = skills if tool_type is None else skills.where(F.col("tool_type") == tool_type)
    return own.orderBy((F.col("total_success") - F.col("total_failure")).desc(), "name").limit(limit)


def sample(patterns: DataFrame, limit: int, types: tuple[str, ...] = SHOWN) -> DataFrame:
    """tool_type, place, id, score, preview of the limit best patterns of some types: the first two lines of their text, in 100 bytes."""
    place = F.row_number().over(Window.partitionBy("tool_type").orderBy((F.col("success") - F.col("failure")).desc(), "id"))
    lines = F.array_join(F.slice(F.split("context", r"\r?\n"), 1, 2), " | ")
    preview = F.when(F.octet_length(lines) > 100, F.concat(T.byte_truncate(lines, 100), F.lit("..."))).otherwise(lines)
    best = patterns.where(F.col("tool_type").isin(*types)).withColumn("place", place).where(F.col("place") <= limit)
    return best.select("tool_type", "place", "id", (F.col("success") - F.col("failure")).alias("score"), preview.alias("preview"))


def reflection_status(verdicts: DataFrame, log: DataFrame) -> DataFrame:
    """One row: total, counts by verdict, cycles, and what the last cycle's row of the log (created_at, verdicts) tells; zeros and nulls where there is none."""
    kinds = [F.count_if(F.col("verdict") == k).alias(k.lower()) for k in N.VERDICTS]
    cycles = log.agg(F.count("*").alias("cycles"), F.max("created_at").alias("last"), F.coalesce(F.max_by("verdicts", "created_at"), F.lit(0)).alias("last_verdicts"))
    return verdicts.agg(F.count("*").alias("total"), *kinds).join(F.broadcast(cycles))  # a row each


def history(log: DataFrame, n: int = 5) -> DataFrame:
    """created_at, event_type of the log's last n rows."""
    return log.orderBy(F.col("created_at").desc(), "event_type").limit(n).select("created_at", "event_type")


def known_and_best(patterns: DataFrame, per_type: int = 1000, best: int = 1000) -> DataFrame:
    """Patterns to export, each id once: the per_type best of each known type, and the best of all."""
    first = patterns.where(F.col("tool_type").isin(*KNOWN)).withColumn("place", F.row_number().over(Window.partitionBy("tool_type").orderBy(*SORTS["score"]()))).where(F.col("place") <= per_type).drop("place")
    top = patterns.orderBy(*SORTS["score"]()).limit(best)
    return first.unionByName(top.join(first.select("id"), "id", "left_anti"))


def ranked(query: str, patterns: DataFrame) -> DataFrame:
    """id, sim of the patterns (id, context) that score above 0 against a query, the most similar first."""
    asked = patterns.sparkSession.range(1).select(T.features(F.lit(query)).alias("q"))  # one row
    met = patterns.select("id", T.features(F.col("context")).alias("p")).join(F.broadcast(asked))
    return met.select("id", T.lexical_score(F.col("q"), F.col("p")).alias("sim")).where("sim > 0").orderBy(F.col("sim").desc(), "id")
