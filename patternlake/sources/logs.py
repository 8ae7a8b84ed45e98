"""Session logs in JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "type string, sessionId string, message struct<role string, content string>"
ITEM = "array<struct<type string, text string, name string, input string, tool_use_id string, content string, is_error boolean>>"


def read_lines(spark: SparkSession, folder: str, below_only: bool = False) -> DataFrame:
    """Lines of *.jsonl in a folder and one level below, or only there: file, line (its place in the file: block's begin, and number within the task), value."""
    paths = [f"{folder}/*/*.jsonl"] if below_only else [f"{folder}/*.jsonl", f"{folder}/*/*.jsonl"]
    lines = spark.read.option("ignoreMissingFiles", True).text(paths)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("line"), "value")


def is_assistant(value: Column) -> Column:
    """Whether a raw line is an assistant's, without parsing it."""
    has = lambda s: F.contains(value, F.lit(s))
    return has('"type":"assistant"') | (has('"role":"assistant"') & has("tool_use"))


def assistant_lines(lines: DataFrame) -> DataFrame:
    """file, n: how many raw lines of each file are an assistant's."""
    return lines.groupBy("file").agg(F.count_if(is_assistant(F.col("value"))).alias("n"))


def flat_events(lines: DataFrame) -> DataFrame:
    """An event stream's lines, flat: file, line, type, subtype, session_id, tool, model, input_tokens, output_tokens, cost, duration_ms, is_error, text. Lines that aren't JSON or lack a type are passed over."""
    item = "type string, text string, name string, content string, is_error boolean"
    usage = "struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long>"
    schema = f"type string, subtype string, session_id string, total_cost_usd double, duration_ms long, is_error boolean, result string, usage {usage}, message struct<model: string, usage: {usage}, content: array<struct<{item}>>>"
    parsed = lines.withColumn("j", F.from_json("value", schema)).where("j.type is not null").withColumn("x", F.explode_outer("j.message.content"))
    either = lambda a, b: F.coalesce(F.col(a), F.col(b))
    return parsed.select(
        "file", "line", F.col("j.type").alias("type"), either("x.type", "j.subtype").alias("subtype"), F.col("j.session_id").alias("session_id"), F.col("x.name").alias("tool"), F.col("j.message.model").alias("model"),
        either("j.message.usage.input_tokens", "j.usage.input_tokens").alias("input_tokens"), either("j.message.usage.output_tokens", "j.usage.output_tokens").alias("output_tokens"),
        F.col("j.total_cost_usd").alias("cost"), F.col("j.duration_ms").alias("duration_ms"), either("x.is_error", "j.is_error").alias("is_error"), F.coalesce("x.text", "x.content", "j.result").alias("text"),
    )


def messages(lines: DataFrame) -> DataFrame:
    """Parsed lines; those that aren't JSON or lack a type are passed over. Missing sessions are 'default'."""
    parsed = lines.withColumn("j", F.from_json("value", LINE)).where("j.type is not null")
    items = F.when(F.startswith(F.ltrim("j.message.content"), F.lit("[")), F.from_json("j.message.content", ITEM))
    return parsed.select("file", "line", F.col("j.type").alias("type"), F.coalesce("j.sessionId", F.lit("default")).alias("session_id"), F.col("j.message.content").alias("content"), items.alias("items"))


def trajectories(parsed: DataFrame) -> DataFrame:
    """One row per (file, session) with at least one tool call: user_query, assistant_content, tool_calls, tool_results, in order of lines."""
    item = parsed.select("file", "session_id", "line", "type", "content", F.posexplode_outer("items").alias("pos", "item"))
    at = F.struct("line", "pos")
    text = F.when(F.col("item").isNull(), F.col("content")).when(F.col("item.type") == "text", F.col("item.text"))
    plain = (F.octet_length(text) > 5) & ~F.contains(text, F.lit("<command-")) & ~F.contains(text, F.lit("<local-command")) & ~F.contains(text, F.lit("Caveat:"))
    ask = F.when((F.col("type") == "user") & plain, text)
    listed = lambda when, what: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(at.alias("at"), what.alias("x"))))), lambda y: y["x"])
    kind = F.col("item.type")
    folded = item.groupBy("file", "session_id").agg(
        F.min_by(ask, F.when(ask.isNotNull(), at)).alias("user_query"),
        F.array_join(listed((F.col("type") == "assistant") & (kind == "text"), F.col("item.text")), "\n").alias("assistant_content"),
        listed(kind == "tool_use", F.struct(F.col("item.name").alias("tool_name"), F.col("item.input").alias("tool_input"))).alias("tool_calls"),
        listed(kind == "tool_result", F.struct(F.col("item.tool_use_id").alias("tool_use_id"), F.col("item.content").alias("content"), F.coalesce("item.is_error", F.lit(False)).alias("is_error"))).alias("tool_results"),
    )
    return folded.where(F.size("tool_calls") > 0)
