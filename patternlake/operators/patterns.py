"""Counter tables of patterns: (id, tool_type, category, success, failure, last_used), and what is done to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SORTS = {
    "score": lambda: [(F.col("success") - F.col("failure")).desc(), F.col("success").desc(), F.col("id")],
    "uses": lambda: [(F.col("success") + F.col("failure")).desc(), F.col("id")],
    "recent": lambda: [F.col("id").desc()],
}


def score() -> Column:
    return F.col("success") - F.col("failure")


def success_rate(default: float, factor: float = 1.0) -> Column:
    """Share of successes times factor; default where nothing was counted."""
    total = F.col("success") + F.col("failure")
    return F.when(total > 0, factor * F.col("success") / total).otherwise(F.lit(float(default)))


def top_per_type(patterns: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("tool_type").orderBy(*SORTS["score"]()))
    return patterns.withColumn("rank", rank).where(F.col("rank") <= n)


def listed(patterns: DataFrame, sort: str = "score", tool_type: str | None = None, min_score: int | None = None, limit: int = 20) -> DataFrame:
    """A filtered, sorted report."""
    if tool_type is not None:
        patterns = patterns.where(F.col("tool_type") == tool_type)
    if min_score is not None:
        patterns = patterns.where(score() >= min_score)
    return patterns.orderBy(*SORTS[sort]()).limit(limit)


def upsert(table: DataFrame, news: DataFrame, key: str = "key") -> DataFrame:
    """Counters of equal keys add up; the key's attributes are those of the table, else of its smallest new row."""
    both = table.select(key, "label", "success", "failure", F.lit(0).alias("age")).unionByName(news.select(key, "label", "success", "failure", F.lit(1).alias("age")))
    return both.groupBy(key).agg(F.min(F.struct("age", "label"))["label"].alias("label"), F.sum("success").alias("success"), F.sum("failure").alias("failure"))


def count_outcomes(table: DataFrame, outcomes: DataFrame) -> DataFrame:
    """table with outcomes (id, success boolean) of uses added to its counters; those of unknown ids change nothing. Outcomes are counted before they meet the table."""
    sums = outcomes.groupBy("id").agg(F.count_if("success").alias("up"), F.count_if(~F.col("success")).alias("down"))
    more = {c: F.col(c) + F.coalesce(d, F.lit(0)) for c, d in (("success", "up"), ("failure", "down"))}
    return table.join(sums, "id", "left").withColumns(more).drop("up", "down")


def save_bucketed(table: DataFrame, name: str, path: str, key: str = "key", buckets: int = 64) -> DataFrame:
    """table in files by hash of its key, as a catalogue's table; upsert() into what this returns leaves its rows where they lie."""
    table.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return table.sparkSession.table(name)


def upsert_bucketed(table: DataFrame, news: DataFrame, key: str = "key") -> DataFrame:
    """upsert() for a table that save_bucketed() saved and that has each key once: only the news are counted and shuffled, into the table's buckets."""
    new = news.groupBy(key).agg(F.min("label").alias("label"), F.sum("success").alias("success"), F.sum("failure").alias("failure"))
    both = table.select(key, "label", "success", "failure").alias("t").join(new.hint("merge").alias("n"), F.col(f"t.{key}") == F.col(f"n.{key}"), "full")
    total = lambda c: (F.coalesce(f"t.{c}", F.lit(0)) + F.coalesce(f"n.{c}", F.lit(0))).alias(c)
    return both.select(F.coalesce(f"t.{key}", f"n.{key}").alias(key), F.when(F.col(f"t.{key}").isNotNull(), F.col("t.label")).otherwise(F.col("n.label")).alias("label"), total("success"), total("failure"))


def stale(now: str, days: int) -> Column:
    return F.col("last_used").isNull() | (F.col("last_used") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def decay(patterns: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Unused patterns lose a success."""
    return patterns.withColumn("success", F.when(stale(now, days), F.greatest(F.lit(0), F.col("success") - 1)).otherwise(F.col("success")))


def decay_by(patterns: DataFrame, now: str, days: int, factor: float) -> DataFrame:
    return patterns.withColumn("success", F.when(stale(now, days), (F.col("success") * F.lit(factor)).cast("bigint")).otherwise(F.col("success")))


def prune(patterns: DataFrame, min_score: int = -3) -> DataFrame:
    return patterns.where(score() >= min_score)


def merge_best(table: DataFrame, news: DataFrame, strategy: str = "add", key: str = "key", failures: str = "failure") -> DataFrame:
    """Import of another table: add and replace add counters; keep_best adds only those whose rate is better than what is there, where rows labelled failures don't count as there."""
    if strategy == "keep_best":
        rate = lambda p: F.coalesce(F.try_divide(f"{p}.success", F.col(f"{p}.success") + F.col(f"{p}.failure")), F.lit(0.5))
        there = table.where(F.col("label") != failures)
        pairs = news.alias("n").join(there.alias("t"), F.col(f"n.{key}") == F.col(f"t.{key}"), "left")
        news = pairs.where(F.col(f"t.{key}").isNull() | (rate("n") > rate("t"))).select("n.*")
    return upsert(table, news, key)


def in_category(patterns: DataFrame, tool_type: str, category: str | None, n: int) -> DataFrame:
    """The n best of a type and category; of the type where category is None."""
    own = patterns.where(F.col("tool_type") == tool_type)
    return (own if category is None else own.where(F.col("category") == category)).orderBy(*SORTS["score"]()).limit(n)


def prunable(patterns: DataFrame, min_score: int = -2) -> DataFrame:
    """What prune() would take, worst first."""
    return patterns.where(score() < min_score).orderBy(score(), "success", "id")


def status(patterns: DataFrame) -> DataFrame:
    """One row on a pattern table: how many, their counters, the rate of all and the mean of theirs, and how many were never used."""
    total = F.sum("success") + F.sum("failure")
    return patterns.agg(
        F.count("*").alias("patterns"), F.coalesce(F.sum("success"), F.lit(0)).alias("success"), F.coalesce(F.sum("failure"), F.lit(0)).alias("failure"), F.round(100.0 * F.try_divide(F.sum("success"), total), 6).alias("rate"),
        F.round(F.avg(F.try_divide("success", F.col("success") + F.col("failure")) * 100), 6).alias("mean_rate"), F.count_if(F.col("last_used").isNull()).alias("unused"),
    )
