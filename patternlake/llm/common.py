"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="patternlake-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read again: work isn't repeated, and a lost executor costs no lineage.

    Unlike a checkpoint, a table that is read has a size of its own; checkpoints keep estimates, which joins multiply:
    after some rounds of joins they are numbers of millions of digits.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def words(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def bytes_of(df: DataFrame) -> Column:
    """About how many bytes a row of df takes."""
    def width(field) -> Column:
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if kind == "array":
            return F.greatest(F.size(c), F.lit(0)) * 16 + 16
        if kind in ("struct", "map"):
            return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) * 2
        return F.lit(8)

    return sum((width(f) for f in df.schema), F.lit(8))


def broadcast_if_small(df: DataFrame, max_bytes: int = 4 << 20) -> DataFrame:
    """A broadcast hint only after measuring that df takes at most max_bytes; a shuffled join otherwise. Give it a cut() table."""
    size = df.agg(F.sum(bytes_of(df)).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= max_bytes else df


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", max_bytes: int = 4 << 20, share: int = 50_000, always: bool = False) -> DataFrame:
    """left join right on key, where right has every key once at most and left may have few of them very often.

    right is broadcast if it is measured to be small. Otherwise, keys that hold more than 1 / share of left's rows are
    dealt over several tasks each, with their row of right repeated; fewer than share keys can, so their list is
    bounded. Give it cut() tables. how is inner, left or left_semi. With always, the most frequent key is in that list
    even where it isn't that frequent, so that the plan is the same with and without hot keys.
    """
    small = broadcast_if_small(right, max_bytes)
    if small is not right:
        return left.join(small, key, how)
    limit = max(256, -(-left.count() // share))
    counts = left.groupBy(key).count()
    hot = counts.where(F.col("count") > limit)
    if always:
        hot = hot.union(counts.orderBy(F.col("count").desc(), key).limit(1)).distinct()
    hot = hot.select(key, F.ceil(F.col("count") / limit).cast("int").alias("parts_"))
    hot = F.broadcast(cut(hot))
    part = F.coalesce(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.col("parts_").cast("long")), F.lit(0).cast("long"))
    dealt = left.join(hot, key, "left").withColumn("part_", part).drop("parts_")
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce("parts_", F.lit(1)).cast("long") - 1)
    repeated = right.join(hot, key, "left").withColumn("part_", F.explode(parts)).drop("parts_")
    return dealt.join(repeated, [key, "part_"], how).drop("part_")
