"""Registered queries of reports, retrieval in two stages and index files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..operators import retrieve as R
from ..operators import sessions as N
from ..session import shared_path
from ..sources import index_file
from . import catalog as K
from . import learning as L
from . import views as V
from .registry import query

ASKED = ("edit", "bash", "read", "Task", "Odd")
RAW = (
    '{"input": {"file_path": "/src/main.rs"}}', '{"command": "cargo test --all"}', "not json", '{"input": {"command": 5}, "file_path": "x.py"}', "{}", '{"input": {"command": "  npx jest"}, "command": "make"}', '{"command": null, "file_path": "/app/App.tsx"}',
    '{"input": {"file_path": ["a"]}, "command": ""}',
)


def asks(spark, d):
    """Tools' raw inputs, one an event: query_id, tool, input."""
    return V.table(spark, d, "events").select(F.col("event_id").alias("query_id"), V.pick(ASKED, "event_id").alias("tool"), V.pick(RAW, "event_id div 5").alias("input"))


def _told(prefix: str) -> str:
    text = lambda n: f"CASE WHEN json_valid(input) THEN CASE WHEN json_type(input, '$.{prefix}{n}') = 'VARCHAR' THEN json_extract_string(input, '$.{prefix}{n}') END END"
    command, path = text("command"), text("file_path")
    return f"CASE WHEN {command} IS NOT NULL THEN 'Bash ' || coalesce(list_filter(string_split_regex({command}, '\\s+'), lambda w: w <> '')[1], '') WHEN {path} IS NOT NULL THEN 'Editing ' || string_split({path}, '.')[-1] || ' file ' || string_split({path}, '/')[-1] END"


KINDS = ", ".join(f"count(*) FILTER (verdict = '{k}') AS {k.lower()}" for k in N.VERDICTS)
SQL_ASKS = f"""raw AS (SELECT event_id AS query_id, {V.sql_pick(ASKED, 'event_id')} AS tool, {V.sql_pick(RAW, 'event_id // 5')} AS input FROM events),
    asks AS (SELECT query_id, {L.sql_map('tool', R.RENAMED)[:-4]} ELSE tool END AS tool_type, coalesce({_told('input.')}, {_told('')}, 'Tool: ' || tool) AS query FROM raw)"""


@query(f"""WITH {L.SQL_LEARNED}, {SQL_ASKS}, texts AS (SELECT DISTINCT tool_type, query FROM asks), m AS (SELECT query, tool_type, id, success, failure, context, row_number() OVER (PARTITION BY tool_type, query ORDER BY rank) AS place
    FROM texts JOIN ranked USING (tool_type) WHERE rank <= {R.BY_TYPE} AND {K.sql_quick('query', 'context')} > {R.PASSED}::DOUBLE)
    SELECT query_id, place, id, tool_type, success - failure AS score, CASE WHEN success + failure > 0 THEN round_even(100.0::DOUBLE * success / (success + failure), 0) ELSE 0 END::BIGINT AS rate, string_split(context, chr(10))[1] AS line FROM asks JOIN m USING (tool_type, query) WHERE place <= {R.SHOWN}""")
def q72_two_stage(spark, d):
    """Every event's raw input against the learned patterns; without vectors all asks are lexical."""
    return R.two_stage(asks(spark, d), L.learned(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {V.PATTERNS_EV} SELECT tool_type, count(*) AS n, sum(success)::BIGINT AS success, sum(failure)::BIGINT AS failure, round(100.0::DOUBLE * sum(success) / nullif(sum(success) + sum(failure), 0), 6) AS rate, grouping(tool_type) = 1 AS total FROM patterns_ev GROUP BY ROLLUP (tool_type)""")
def q73_pattern_statistics(spark, d):
    return reports.pattern_statistics(V.patterns_ev(spark, d)).select("tool_type", "n", "success", "failure", "rate", "total")


@query(f"""WITH {L.SQL_LEARNED} SELECT tool_type, place, id, score, CASE WHEN strlen(p) > 100 THEN left(p, 100) || '...' ELSE p END AS preview FROM (SELECT tool_type, id, success - failure AS score, array_to_string(string_split(context, chr(10))[1:2], ' | ') AS p,
    row_number() OVER (PARTITION BY tool_type ORDER BY success - failure DESC, id) AS place FROM learned) WHERE place <= 10 AND tool_type IN ({K.sql_list(reports.SHOWN)})""")
def q74_pattern_sample(spark, d):
    return reports.sample(L.learned(spark, d), 10).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {L.SQL_LEARNED}, o AS (SELECT *, row_number() OVER (ORDER BY success - failure DESC, success DESC, id) AS nth FROM ranked) SELECT id, tool_type, success, failure FROM o WHERE (rank <= 20 AND tool_type IN ({K.sql_list(reports.KNOWN)})) OR nth <= 60""")
def q75_known_and_best(spark, d):
    return reports.known_and_best(L.learned(spark, d), 20, 60).select("id", "tool_type", "success", "failure")


@query(f"WITH {K.VERDICTS}, c AS (SELECT doc_id % 7 AS cycle, count(*) AS verdicts FROM labels GROUP BY 1) SELECT count(*) AS total, {KINDS}, (SELECT count(*) FROM c) AS cycles, (SELECT arg_max(verdicts, cycle) FROM c) AS last_verdicts FROM verdicts")
def q76_reflection_status(spark, d):
    """Verdicts as a log of seven cycles, by the id's remainder."""
    log = V.table(spark, d, "labels").groupBy((F.col("doc_id") % 7).alias("cycle")).agg(F.count("*").alias("verdicts")).withColumn("created_at", F.timestamp_seconds("cycle"))
    return reports.reflection_status(K._verdicts(spark, d), log).drop("last")


@query("SELECT vec_id AS id, len(embedding) AS dimensions, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def q77_index_file(spark, d):
    """All embeddings as index files, read back."""
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index_file.write_index(e, path := shared_path(spark, "index"), 64)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return index_file.read_index(spark, path).select("id", F.size("vector").cast("long").alias("dimensions"), F.round(total, 4).alias("total"))


@query(f"WITH {V.PATTERNS_CTX}, s AS (SELECT id, {K.sql_quick(chr(39) + 'Fix error of main.rs by run' + chr(39), 'context')} AS sim FROM patterns_ctx) SELECT id, round(sim, 6) AS sim FROM s WHERE sim > 0")
def q78_ranked(spark, d):
    """All patterns that a query's words touch."""
    return reports.ranked("Fix error of main.rs by run", V.patterns_ctx(spark, d)).withColumn("sim", F.round("sim", 6))

