"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

All sources share a number of words by weight; a source stops at max_epochs times its size, and what it can't take is
reshared by weight among the others until none is above. That rising level is found in closed form: in order of
cap / weight, the level with the first k sources capped is (words - their caps) / (weight of the rest).

A source then takes whole repetitions of all its documents and, of a seeded order of them, the first ones that make up
the fraction; the document on the border gives the words that are still missing. The order is cut into SLICES ranges
of a hash, whose sums tell where the border lies, so that no task sorts a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, cut, n_words, words

WEIGHTS = (3, 1, 2)
SLICES = 4096


def rising_level(sources: DataFrame, share_percent: int = 150, max_epochs: int = 2) -> DataFrame:
    """sources: one row each, with source, source_size, weight. Adds target. Its windows hold one row a source."""
    caps = sources.withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = caps.withColumns({
        "total": F.sum("source_size").over(everything) * share_percent / 100,
        "below": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weights": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    # The sources before the first that isn't capped are capped; the level is then that source's.
    level = level.withColumn("level", (F.col("total") - F.col("below")) / F.col("weights"))
    level = level.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    found = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("last"), F.col("source").alias("source"), F.col("level").alias("level")))).over(everything)["level"]
    return level.withColumn("target", F.least(F.coalesce(found * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))).select("source", "source_size", "weight", "target")


def weigh(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights repeat over the sources by code point, null last."""
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), at))


def mix(docs: DataFrame, seed: int = 8, share_percent: int = 150, max_epochs: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Mix documents (doc_id, text, source).

    Returns doc_id, source, size (words; null text: 0), source_size, target (its source's), taken (words the mix takes,
    repeats counted), whole (repetitions of the whole document) and part_words (words of one more, partial repetition).
    Every row is mixed, repeated ids too; a null source is a source. Columns named in carry are handed on; others are not read. An empty table gives
    no rows. The same rows give the same mix, in whatever order they come.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    base = base.select("*", F.pmod(F.shiftrightunsigned("key", 20), F.lit(SLICES)).alias("slice"))
    sized = cut(base.select("doc_id", "source", "size", "key", "slice"))
    sources = weigh(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = rising_level(sources, share_percent, max_epochs)
    sources = sources.withColumn("whole", F.coalesce(F.least(F.floor(F.try_divide("target", "source_size")), F.lit(max_epochs)), F.lit(0)))
    sources = cut(sources.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))

    # The slice in which a source's rest ends, and how many words of it are still to take there.
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    known = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    edge = known.alias("k").join(broadcast_if_small(sources).alias("s"), same("k", "s")).where("k.before < s.rest and k.before + k.slice_size >= s.rest")
    edge = edge.select(F.col("s.source").alias("source"), F.col("k.slice").alias("edge"), (F.col("s.rest") - F.col("k.before")).alias("edge_words"))
    edge = edge.alias("e")
    levels = cut(sources.alias("s").join(edge, same("s", "e"), "left").select("s.*", "edge", "edge_words"))

    held = [f"carry_{c}" for c in carry]
    rows = (base if carry else sized).alias("d").join(broadcast_if_small(levels).alias("l"), same("d", "l"))
    rows = rows.select("d.doc_id", "d.source", "d.size", "d.key", "d.slice", "l.source_size", "l.target", "l.whole", "l.edge", "l.edge_words", *held)
    on_edge = F.col("slice").eqNullSafe(F.col("edge"))
    within = rows.where(on_edge).withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = within.withColumn("part_words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("edge_words") - F.col("before"))))
    others = rows.where(~on_edge).withColumn("part_words", F.when(F.col("slice") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    columns = ("doc_id", "source", "size", "source_size", "target", "whole", "part_words", *held)
    both = within.select(*columns).unionByName(others.select(*columns))
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part_words")).alias("taken"), "whole", "part_words", *(F.col(f"carry_{c}").alias(c) for c in carry))


def apply_mix(docs: DataFrame, seed: int = 8) -> DataFrame:
    """The mixed corpus itself, with the columns of documents: whole documents repeated, and of a source's border document its first words."""
    mixed = mix(docs, seed=seed, carry=("text", "lang", "n_chars"))
    part = F.when((F.col("part_words") > 0) & (F.col("part_words") < F.col("size")), F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("part_words").cast("int")), " "))
    # An empty document has no words to count; it stays once.
    times = F.col("whole") + F.when((F.col("part_words") >= F.col("size")) & ((F.col("size") > 0) | (F.col("whole") == 0)), 1).otherwise(0)
    copies = F.concat(F.array_repeat(F.col("text"), times.cast("int")), F.when(part.isNotNull(), F.array(part)).otherwise(F.array().cast("array<string>")))
    out = mixed.select("doc_id", F.explode(copies).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long"))

