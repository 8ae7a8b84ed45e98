"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sanitize as S
from ..functions import text as T
from ..operators import graph as G
from ..operators import patterns as P
from ..operators import retrieve as R
from ..operators import sessions as N
from ..operators import replicas
from ..session import shared_path
from ..sources import bundles
from ..streaming import accumulate
from . import views as V
from .registry import query

NOW = "2024-01-20 00:00:00"


def sql_any(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p.replace(chr(39), chr(39) * 2)}')" for p in parts) + ")"


def sql_list(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def sql_stack(text: str) -> str:
    points = {s: f"(CASE WHEN {sql_any(text, a)} THEN 3 ELSE 0 END + CASE WHEN {sql_any(text, b)} THEN 2 ELSE 0 END)" for s, (a, b) in T.STACKS.items()}
    top = f"greatest({', '.join(points.values())})"
    return f"CASE WHEN {top} < 2 THEN 'unknown' " + " ".join(f"WHEN {p} = {top} THEN '{s}'" for s, p in points.items()) + " END"


SCORE = "success - failure"


@query(f"WITH {V.PATTERNS_SALES} SELECT tool_type, count(*) AS n FROM patterns_sales GROUP BY 1")
def q01_patterns_by_type(spark, d):
    return V.patterns_sales(spark, d).groupBy("tool_type").agg(F.count("*").alias("n"))


@query(f"""WITH {V.PATTERNS_EV} SELECT tool_type, count(*) AS n, sum(success)::BIGINT AS success, sum(failure)::BIGINT AS failure,
    round(avg(CASE WHEN success + failure > 0 THEN 100.0::DOUBLE * success / (success + failure) ELSE 50.0 END), 6) AS rate_50,
    round(avg(CASE WHEN success + failure > 0 THEN 100.0::DOUBLE * success / (success + failure) ELSE 0.0 END), 6) AS rate_0,
    round(avg(CASE WHEN success + failure > 0 THEN 1.0::DOUBLE * success / (success + failure) ELSE 0.5 END), 6) AS rate_half FROM patterns_ev GROUP BY 1""")
def q02_success_rates(spark, d):
    mean = lambda default, factor: F.round(F.avg(P.success_rate(default, factor)), 6)
    return V.patterns_ev(spark, d).groupBy("tool_type").agg(F.count("*").alias("n"), F.sum("success").alias("success"), F.sum("failure").alias("failure"), mean(50, 100.0).alias("rate_50"), mean(0, 100.0).alias("rate_0"), mean(0.5, 1.0).alias("rate_half"))


@query(f"WITH {V.PATTERNS_SALES} SELECT tool_type, id, success, failure, rank FROM (SELECT *, row_number() OVER (PARTITION BY tool_type ORDER BY {SCORE} DESC, success DESC, id) AS rank FROM patterns_sales) WHERE rank <= 8")
def q03_top_n_per_type(spark, d):
    return P.top_per_type(V.patterns_sales(spark, d), 8).select("tool_type", "id", "success", "failure", F.col("rank").cast("long"))


@query(f"""WITH {V.PATTERNS_EV} SELECT 'score' AS mode, * FROM (SELECT id, success, failure FROM patterns_ev WHERE {SCORE} >= 1 ORDER BY {SCORE} DESC, success DESC, id LIMIT 20)
    UNION ALL SELECT 'uses', * FROM (SELECT id, success, failure FROM patterns_ev WHERE tool_type = 't3' ORDER BY success + failure DESC, id LIMIT 20)
    UNION ALL SELECT 'recent', * FROM (SELECT id, success, failure FROM patterns_ev ORDER BY id DESC LIMIT 20)""")
def q04_list_sorted(spark, d):
    p = V.patterns_ev(spark, d)
    part = lambda mode, **x: P.listed(p, mode, **x).select(F.lit(mode).alias("mode"), "id", "success", "failure")
    return part("score", min_score=1).union(part("uses", tool_type="t3")).union(part("recent"))


@query(f"WITH {V.PATTERNS_SALES} SELECT id, tool_type, success, failure FROM patterns_sales WHERE {SCORE} >= 5")
def q05_prune(spark, d):
    return P.prune(V.patterns_sales(spark, d), 5).select("id", "tool_type", "success", "failure")


@query(f"""WITH {V.PATTERNS_EV}, p AS (SELECT *, (last_used IS NULL OR last_used < TIMESTAMP '{NOW}' - INTERVAL 7 DAYS) AS stale FROM patterns_ev)
    SELECT id, CASE WHEN stale THEN greatest(0, success - 1) ELSE success END AS by_one, CASE WHEN stale THEN trunc(success * 0.7::DOUBLE)::BIGINT ELSE success END AS by_factor FROM p""")
def q06_decay(spark, d):
    p = V.patterns_ev(spark, d)
    one, factor = P.decay(p, NOW), P.decay_by(p, NOW, 7, 0.7)
    return one.select("id", F.col("success").alias("by_one")).join(factor.select("id", F.col("success").alias("by_factor")), "id")


HALVES = """WITH h AS (SELECT event_id % 2 AS half, user_id AS key, event_type, value FROM events),
    t AS (SELECT half, key, min(event_type) AS label, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failure FROM h GROUP BY 1, 2)"""


def _half(spark, d, n):
    e = V.table(spark, d, "events").where(F.col("event_id") % 2 == n)
    return e.groupBy(F.col("user_id").alias("key")).agg(F.min("event_type").alias("label"), F.count_if(F.col("event_type") != "error").alias("success"), F.count_if(F.col("event_type") == "error").alias("failure"))


@query(HALVES + " SELECT key, arg_min(label, half) AS label, sum(success)::BIGINT AS success, sum(failure)::BIGINT AS failure FROM t GROUP BY key")
def q07_upsert_counters(spark, d):
    return P.upsert(_half(spark, d, 0), _half(spark, d, 1))


@query("SELECT doc_id, md5(text) AS text_hash FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def q08_dedup_first(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_hash"))
    return docs.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))  # combined before the shuffle, unlike a window


@query("SELECT doc_id, lang FROM documents WHERE text ILIKE '%license%'")
def q09_substring_search(spark, d):
    return V.table(spark, d, "documents").where(F.col("text").ilike("%license%")).select("doc_id", "lang")


def sql_task(text: str) -> str:
    low = f"lower({text})"
    rules = " ".join("WHEN " + " AND ".join(sql_any(low, need.split("|")) for need in needs) + f" THEN '{name}'" for *needs, name in T.TASKS)
    words = f"list_filter(string_split_regex(string_split_regex({text}, '\\r?\\n')[1], '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"CASE {rules} WHEN len({words}) >= 2 AND lower({words}[1]) IN ({sql_list(T.TASK_VERBS)}) THEN upper(lower({words}[1])[1]) || lower({words}[1])[2:] || ' code/files' ELSE array_to_string({words}[1:4], ' ') END"


@query(f"WITH {V.PATTERNS_CTX} SELECT id, {sql_task('context')} AS task FROM patterns_ctx")
def q10_task_category(spark, d):
    return V.patterns_ctx(spark, d).select("id", T.task_category(F.col("context")).alias("task"))


@query(f"WITH {V.PATTERNS_CTX} SELECT id, {sql_stack('lower(context)')} AS stack FROM patterns_ctx")
def q11_tech_stack(spark, d):
    return V.patterns_ctx(spark, d).select("id", T.tech_stack(F.col("context")).alias("stack"))


def sql_stem(w: str) -> str:
    root = f"left({w}, length({w}) - 3)"
    return f"""CASE WHEN strlen({w}) <= 4 THEN {w} WHEN strlen({w}) > 5 AND {w} LIKE '%ing' THEN CASE WHEN length({root}) >= 2 AND right({root}, 1) = left(right({root}, 2), 1) THEN left({root}, length({root}) - 1) ELSE {root} END
    WHEN {w} LIKE '%ed' THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"""


SQL_TOKENS = f"""raw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+')) AS w FROM documents),
    tokens AS (SELECT doc_id, {sql_stem('w')} AS term FROM raw WHERE strlen(w) >= 2 AND w NOT IN ({sql_list(T.STOP_WORDS)}))"""


def _tokens(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.explode(T.counted(T.tokens(F.col("text")))).alias("x")).select("doc_id", "x.term", F.col("x.n").alias("tf"))


@query(f"WITH {SQL_TOKENS} SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2")
def q12_term_frequency(spark, d):
    return _tokens(spark, d)


@query(f"WITH {SQL_TOKENS} SELECT term, count(DISTINCT doc_id) AS df, round(greatest(ln((SELECT count(*) FROM documents)::DOUBLE / count(DISTINCT doc_id)), 0.1), 6) AS idf FROM tokens GROUP BY 1")
def q13_idf(spark, d):
    n = V.table(spark, d, "documents").agg(F.count("*").alias("n"))
    df = _tokens(spark, d).groupBy("term").agg(F.count("*").alias("df"))  # a document has a term once
    return df.join(F.broadcast(n)).select("term", "df", F.round(F.greatest(F.log(F.col("n") / F.col("df")), F.lit(0.1)), 6).alias("idf"))  # n is one row


SQL_WEIGHT = "CASE " + " ".join(f"WHEN term IN ({sql_list(t)}) THEN {w}" for w, t in T.TERM_WEIGHTS.items()) + " WHEN strlen(term) >= 8 THEN 1.5 WHEN strlen(term) >= 5 THEN 1.2 ELSE 1.0 END"


@query(f"WITH {SQL_TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2) SELECT doc_id, round(sqrt(sum(pow(tf * ({SQL_WEIGHT})::DOUBLE, 2))), 4) AS norm FROM tf GROUP BY 1")
def q14_weighted_norm(spark, d):
    weight = lambda x: F.pow(x["n"] * T.term_weight(x["term"]), F.lit(2))
    terms = V.table(spark, d, "documents").select("doc_id", T.counted(T.tokens(F.col("text"))).alias("x")).where("size(x) > 0")
    return terms.select("doc_id", F.round(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + weight(x))), 4).alias("norm"))


def sql_quick(q: str, p: str) -> str:
    words = f"list_filter(string_split_regex(lower({q}), '[\\x20\\x09-\\x0D]+'), lambda w: strlen(w) >= 2 AND w NOT IN ({sql_list(T.QUICK_STOP_WORDS)}))"
    total = f"list_sum(list_transform({words}, lambda w: CASE WHEN strlen(w) >= 4 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END))"
    hits = f"list_sum(list_transform({words}, lambda w: CASE WHEN NOT contains(lower({p}), w) THEN 0.0::DOUBLE WHEN w IN ({sql_list(T.QUICK_BONUS)}) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END))"
    a, b = sql_stack(f"lower({q})"), sql_stack(f"lower({p})")
    return f"""CASE WHEN {a} <> 'unknown' AND {b} <> 'unknown' AND {a} <> {b} THEN 0.03::DOUBLE WHEN len({words}) = 0 THEN 0.0::DOUBLE
    ELSE least(least({hits} / {total}, 1.0::DOUBLE) * CASE WHEN {a} <> 'unknown' AND {a} = {b} THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 2.0::DOUBLE) END"""


ASKS = "asks AS (SELECT id AS query_id, tool_type, context AS query FROM patterns_ctx)"


def _asks(p):
    return p.select(F.col("id").alias("query_id"), "tool_type", F.col("context").alias("query"))


def sql_top(n: int) -> str:
    return f"c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool_type ORDER BY {SCORE} DESC, success DESC, id) AS rank FROM patterns_ctx) WHERE rank <= {n})"


@query(f"WITH {V.PATTERNS_CTX}, {ASKS}, {sql_top(8)} SELECT query_id, id, round({sql_quick('query', 'context')}, 6) AS sim FROM asks JOIN c USING (tool_type)")
def q15_quick_similarity(spark, d):
    """Every pattern's text, as a query, against the 8 best patterns of its type."""
    p = V.patterns_ctx(spark, d)
    return R.scored(_asks(p), p, 8).select("query_id", "id", F.round("sim", 6).alias("sim"))


SPACES = "'[\\x20\\x09-\\x0D]+'"


def sql_terms(key: str, text: str, table: str) -> str:
    raw = f"SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_-]+')) AS w FROM {table}"
    terms = f"SELECT {key}, {sql_stem('w')} AS term FROM ({raw}) WHERE strlen(w) >= 2 AND w NOT IN ({sql_list(T.STOP_WORDS)})"
    return f"(SELECT {key}, term, count(*) AS n, ({SQL_WEIGHT})::DOUBLE AS weight FROM ({terms}) GROUP BY 1, 2)"


@query(f"""WITH qt AS {sql_terms('item_id', 'text', 'benchmark')}, dt AS {sql_terms('doc_id', 'text', 'documents')},
    norms AS (SELECT item_id, sqrt(sum(pow(n * weight, 2))) AS norm FROM qt GROUP BY 1),
    dots AS (SELECT item_id, doc_id, sum(qt.n * qt.weight * dt.n * dt.weight) AS dot FROM qt JOIN dt USING (term) GROUP BY 1, 2)
    SELECT item_id AS query_id, doc_id AS id, round(dot / norm, 4) AS sim FROM dots JOIN norms USING (item_id)""")
def q16_term_similarity(spark, d):
    """Every benchmark item against all documents that share a term with it. No text here tells a tech stack, so the SQL leaves that factor out; q27 has it."""
    items = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.term_scores(items, V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"""WITH {V.PATTERNS_CTX}, {ASKS}, {sql_top(8)},
    s AS (SELECT query_id, id, rank, {sql_quick('query', 'context')} AS sim, success, failure FROM asks JOIN c USING (tool_type)),
    r AS (SELECT *, 0.6::DOUBLE * sim + 0.4::DOUBLE * greatest({SCORE}, 0) / 10.0::DOUBLE AS score FROM s WHERE sim >= 0.35::DOUBLE)
    SELECT query_id, place, id, round(sim, 6) AS sim, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, id) AS place FROM r) WHERE place <= 3""")
def q17_retrieve_topk(spark, d):
    p = V.patterns_ctx(spark, d)
    return R.retrieve(_asks(p), p).withColumn("place", F.col("place").cast("long"))


SIMS = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
    sims AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS sim FROM q, embeddings),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS place FROM sims)"""


def _near(spark, d, k):
    """The vectors whose id 50 divides, as queries, against all."""
    e = V.table(spark, d, "embeddings")
    return R.nearest_vectors(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k)


@query(f"WITH {SIMS} SELECT query_id, place, id, round(sim, 4) AS sim FROM near WHERE place <= 10")
def q18_embeddings_topk(spark, d):
    return _near(spark, d, 10).select("query_id", F.col("place").cast("long"), "id", F.round("sim", 4).alias("sim"))


@query(f"""WITH {SIMS}, f AS (SELECT query_id, id, place, quality, row_number() OVER (PARTITION BY query_id ORDER BY place) AS nth FROM near JOIN labels ON id = doc_id WHERE place <= 20)
    SELECT query_id, id, quality FROM f WHERE nth <= 10""")
def q19_vector_join_context(spark, d):
    """The first 10 of each query's 20 nearest that have a label; many have none."""
    return R.with_context(_near(spark, d, 20), V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), 10).select("query_id", "id", "quality")


@query()
def q20_hash_embed(spark, d):
    """Length and norm of each document's hash embedding."""
    v = V.table(spark, d, "documents").select("doc_id", R.hash_embed(384)("text").alias("v"))
    return v.select("doc_id", F.size("v").alias("dims"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 3).alias("norm"))


@query(f"WITH {V.OCCURRENCES} SELECT a, b, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM occurrences GROUP BY 1, 2")
def q21_cooccurrence(spark, d):
    return G.pairs(V.baskets_ev(spark, d)).groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


def _edges(spark, d):
    return G.lift(G.pairs(V.baskets_ev(spark, d)))


@query(f"WITH {V.EDGES} SELECT a, b, round(lift + 1e-8::DOUBLE, 6) AS lift, co_occurrences FROM edges")
def q22_ema_lift(spark, d):
    return _edges(spark, d).withColumn("lift", F.round(F.col("lift") + 1e-8, 6))


CONFLICTS = V.EDGES + ", conflicts AS (SELECT a AS id, b AS other, lift FROM edges WHERE lift < 0.5 AND co_occurrences >= 3 UNION SELECT b, a, lift FROM edges WHERE lift < 0.5 AND co_occurrences >= 3)"


@query(f"WITH {CONFLICTS} SELECT id, other, round(lift + 1e-8::DOUBLE, 6) AS lift FROM conflicts")
def q23_conflict_neighbours(spark, d):
    return G.conflicts(_edges(spark, d)).select("id", "other", F.round(F.col("lift") + 1e-8, 6).alias("lift"))


@query(f"WITH {V.EDGES} SELECT count(*) AS edges, count(*) FILTER (lift > 1.5 AND co_occurrences >= 3) AS synergies, count(*) FILTER (lift < 0.5 AND co_occurrences >= 3) AS conflicts, round(avg(co_occurrences), 6) AS avg_co_occurrences FROM edges")
def q24_edge_bands(spark, d):
    return G.band_counts(_edges(spark, d))


@query(f"WITH {V.EDGES} SELECT a, b FROM edges WHERE a <> b AND a IN (SELECT k FROM events_k WHERE k % 3 <> 0) AND b IN (SELECT k FROM events_k WHERE k % 3 <> 0)")
def q25_orphan_cleanup(spark, d):
    nodes = V.events_k(spark, d).where("k % 3 <> 0").select(F.col("k").alias("id"))
    return G.without_orphans(_edges(spark, d), nodes).select("a", "b")


@query(f"""WITH {CONFLICTS}, c AS (SELECT user_id AS query_id, k % 20 AS id, count(*) AS n FROM events_k GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) AS place FROM c), s AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS m FROM p WHERE place <= 8)
    SELECT query_id, place, id FROM s WHERE NOT EXISTS (SELECT 1 FROM s t JOIN conflicts x ON t.id = x.id WHERE t.query_id = s.query_id AND t.place = 1 AND t.m > 4 AND x.other = s.id)""")
def q26_conflict_filter(spark, d):
    used = V.events_k(spark, d).groupBy(F.col("user_id").alias("query_id"), (F.col("k") % 20).alias("id")).agg(F.count("*").alias("n"))
    place = F.row_number().over(R.Window.partitionBy("query_id").orderBy(F.col("n").desc(), "id"))
    best = used.withColumn("place", place).where("place <= 8")
    return R.without_conflicts(best, G.conflicts(_edges(spark, d))).withColumn("place", F.col("place").cast("long"))


SESSIONS = """sessions AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS user_query, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'assistant'), '') AS assistant_content,
    count(*) AS turns, count(*) FILTER (role = 'assistant') AS assistant_turns FROM conversations GROUP BY 1)"""


@query(f"WITH {SESSIONS} SELECT * FROM sessions")
def q30_session_fold(spark, d):
    return N.fold_sessions(V.table(spark, d, "conversations"))


def sql_count(text: str, phrases) -> str:
    return " + ".join(f"(length({text}) - length(replace({text}, '{p.replace(chr(39), chr(39) * 2)}', ''))) // {len(p)}" for p in phrases)


CTX_SAID = "said AS (SELECT id AS conv_id, lower(context) AS t FROM patterns_ctx)"


@query(f"WITH {V.PATTERNS_CTX}, {CTX_SAID} SELECT conv_id, ({sql_count('t', N.RETRIES)})::BIGINT AS retries, {sql_any('t', N.GIVEN_UP)} AS abandoned, {sql_any('t', N.SUCCESS)} AS succeeded FROM said")
def q31_outcome_flags(spark, d):
    return N.outcome(V.patterns_ctx(spark, d).select(F.col("id").alias("conv_id"), F.col("context").alias("assistant_content")))


def sql_error(t: str) -> str:
    hit = {name: sql_any(t, phrases) for name, (_, phrases) in N.ERRORS.items()}
    hit["not_found"] += f" OR (contains({t}, 'not found') AND {sql_any(t, ('error', 'errno', 'failed', 'cannot'))})"
    hit["timeout"] += f" OR (contains({t}, 'timed out') AND NOT contains({t}, 'timeout_'))"
    hit["test"] += f" OR (contains({t}, 'failures:') AND contains({t}, 'passed'))"
    hit["other"] += f" AND NOT {sql_any(t, N.NO_ERROR)}"
    return "CASE " + " ".join(f"WHEN {h} THEN '{name}'" for name, h in hit.items()) + " END"


SEVERITY = "CASE kind " + " ".join(f"WHEN '{n}' THEN {s}" for n, (s, _) in N.ERRORS.items()) + " END"


@query(f"WITH {V.PATTERNS_CTX}, e AS (SELECT id, {sql_error('lower(context)')} AS kind FROM patterns_ctx) SELECT id, coalesce(kind, 'none') AS kind, coalesce({SEVERITY}, 0) AS severity FROM e")
def q32_error_types(spark, d):
    e = V.patterns_ctx(spark, d).select("id", N.error_type(F.col("context")).alias("kind"))
    return e.select("id", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce(N.severity(F.col("kind")), F.lit(0)).alias("severity"))


VERDICTS = """verdicts AS (SELECT doc_id % 40 AS pattern_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'EFFECTIVE' WHEN quality = 1 THEN 'NEUTRAL' WHEN toxic = 0 THEN 'INEFFECTIVE' ELSE 'HARMFUL' END AS verdict,
    (doc_id % 7 + 3) / 10.0::DOUBLE AS confidence FROM labels)"""


def _verdicts(spark, d):
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "EFFECTIVE").when(F.col("quality") == 1, "NEUTRAL").when(F.col("toxic") == 0, "INEFFECTIVE").otherwise("HARMFUL")
    return V.table(spark, d, "labels").select((F.col("doc_id") % 40).alias("pattern_id"), kind.alias("verdict"), ((F.col("doc_id") % 7 + 3) / F.lit(10.0)).alias("confidence"))


@query(f"""WITH {V.PATTERNS_EV}, {VERDICTS}, i AS (SELECT pattern_id, confidence, CASE verdict WHEN 'EFFECTIVE' THEN round(5 * confidence) WHEN 'HARMFUL' THEN round(-5 * confidence) WHEN 'INEFFECTIVE' THEN -1 ELSE 0 END AS impact FROM verdicts),
    c AS (SELECT pattern_id, greatest(-5, least(5, round(impact * confidence))) AS x FROM i),
    s AS (SELECT pattern_id AS id, sum(greatest(x, 0)) AS up, sum(greatest(-x, 0)) AS down FROM c GROUP BY 1)
    SELECT id, (success + coalesce(up, 0))::BIGINT AS success, (failure + coalesce(down, 0))::BIGINT AS failure FROM patterns_ev LEFT JOIN s USING (id)""")
def q33_verdict_deltas(spark, d):
    return N.apply_verdicts(V.patterns_ev(spark, d), _verdicts(spark, d))


@query(f"""WITH {VERDICTS} SELECT pattern_id, count(*) AS total, {', '.join(f"count(*) FILTER (verdict = '{k}') AS {k.lower()}" for k in ('EFFECTIVE', 'INEFFECTIVE', 'HARMFUL', 'NEUTRAL'))}, round(coalesce(avg(confidence), 0), 6) AS avg_confidence,
    round(count(*) FILTER (verdict = 'EFFECTIVE')::DOUBLE / count(*), 6) AS effectiveness, round(count(*) FILTER (verdict = 'HARMFUL')::DOUBLE / count(*), 6) AS harm FROM verdicts GROUP BY 1""")
def q34_verdict_stats(spark, d):
    return N.verdict_stats(_verdicts(spark, d))


@query(f"SELECT doc_id, md5({S.as_sql('text', S.SECRETS)}) AS clean FROM documents")
def q35_redact_secrets(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(S.redact(F.col("text")).cast("binary")).alias("clean"))


@query(f"SELECT 'd' AS kind, doc_id AS id, md5({S.as_sql('text', S.PATHS + S.PERSONAL)}) AS clean FROM documents UNION ALL SELECT 'p', page_id, md5({S.as_sql('html', S.PATHS + S.PERSONAL)}) FROM pages")
def q36_generalize(spark, d):
    clean = lambda c: F.md5(S.generalize(S.strip_paths(F.col(c))).cast("binary")).alias("clean")
    docs = V.table(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), clean("text"))
    return docs.union(V.table(spark, d, "pages").select(F.lit("p"), "page_id", clean("html")))


@query("SELECT doc_id, " + " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for p, _ in S.SECRETS) + " AS sensitive FROM documents")
def q37_sensitive(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.is_sensitive(F.col("text")).alias("sensitive"))


@query(f"WITH {V.PATTERNS_CTX} SELECT id, tool_type, category, success, failure, {S.as_sql('context', S.SECRETS + S.PATHS + S.PERSONAL)} AS context FROM patterns_ctx")
def q38_bundle_round_trip(spark, d):
    """Patterns as another workspace reads them from an exported, encrypted bundle."""
    path = shared_path(spark, "bundle")
    schema = bundles.export_bundle(V.patterns_ctx(spark, d).select("id", "tool_type", "category", "success", "failure", "context"), path, passphrase="open it", now=NOW)
    return bundles.import_bundle(spark, path, schema, "open it")


SQL_RATE = "CASE WHEN {0}.success + {0}.failure > 0 THEN {0}.success::DOUBLE / ({0}.success + {0}.failure) ELSE 0.5 END"


@query(HALVES + f""", a AS (SELECT * FROM t WHERE half = 0), b AS (SELECT * FROM t WHERE half = 1), there AS (SELECT * FROM a WHERE label <> 'error'),
    n AS (SELECT b.* FROM b LEFT JOIN there USING (key) WHERE there.key IS NULL OR {SQL_RATE.format('b')} > {SQL_RATE.format('there')}),
    u AS (SELECT 'keep_best' AS strategy, * FROM a UNION ALL SELECT 'keep_best', * FROM n UNION ALL SELECT 'add', * FROM t UNION ALL SELECT 'replace', * FROM t)
    SELECT strategy, key, arg_min(label, half) AS label, sum(success)::BIGINT AS success, sum(failure)::BIGINT AS failure FROM u GROUP BY 1, 2""")
def q39_merge_strategies(spark, d):
    """All of them add counters; rows labelled error stand for failures, which keep_best doesn't see."""
    a, b = _half(spark, d, 0), _half(spark, d, 1)
    outs = [P.merge_best(a, b, s, failures="error").select(F.lit(s).alias("strategy"), "key", "label", "success", "failure") for s in ("keep_best", "add", "replace")]
    return outs[0].union(outs[1]).union(outs[2])


ENTRIES = """entries AS (SELECT user_id AS key, 'n' || event_id % 3 AS node, min(event_type) AS tool_type, CASE WHEN event_id % 3 > 0 THEN 'c' || user_id % 5 END AS category, max(event_type) || event_id % 3 AS context,
    epoch_us(max(ts)) // 864000000000 AS ts, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failure, count(*) AS v, user_id % 7 = 0 AND (event_id % 3 = 1 OR user_id % 2 = 0) AS deleted
    FROM events GROUP BY user_id, event_id % 3),
    versions AS (SELECT key, string_agg(node || '=' || v, ',' ORDER BY node) AS version FROM entries GROUP BY 1)"""
WON = "key, e.tool_type, e.category, e.context, e.success, e.failure, e.ts, e.node, version, e.deleted"


def _entries(spark, d):
    """A replica's entries of each key: times in tens of days, so that many tie."""
    e = V.table(spark, d, "events").groupBy(F.col("user_id").alias("key"), (F.col("event_id") % 3).alias("replica"))
    e = e.agg(F.min("event_type").alias("tool_type"), F.max("event_type").alias("last"), F.floor(F.unix_micros(F.max("ts").cast("timestamp")) / 864000000000).alias("ts"), F.count_if(F.col("event_type") != "error").alias("success"), F.count_if(F.col("event_type") == "error").alias("failure"), F.count("*").alias("v"))
    node = F.concat(F.lit("n"), "replica")
    return e.select(
        "key", "tool_type", F.when(F.col("replica") > 0, F.concat(F.lit("c"), F.col("key") % 5)).alias("category"), F.concat("last", "replica").alias("context"), "success", "failure", "ts", node.alias("node"),
        F.create_map(node, "v").alias("version"), ((F.col("key") % 7 == 0) & ((F.col("replica") == 1) | (F.col("key") % 2 == 0))).alias("deleted"), "replica",
    )


def _told(entries):
    version = F.array_join(F.transform(F.array_sort(F.map_entries("version")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return entries.withColumn("version", version)


@query(f"WITH {ENTRIES} SELECT {WON} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, node DESC) AS rn FROM entries) e JOIN versions USING (key) WHERE rn = 1")
def q40_merge_last_write(spark, d):
    return _told(replicas.merge(_entries(spark, d)))


@query(f"""WITH {ENTRIES}, e AS (SELECT key, arg_min(tool_type, node) AS tool_type, arg_min(category, node) AS category, arg_max(context, ts * 10 - right(node, 1)::INT) AS context, max(success) AS success, max(failure) AS failure, max(ts) AS ts,
    arg_max(node, ts * 10 - right(node, 1)::INT) AS node, bool_and(deleted) AS deleted FROM entries GROUP BY key) SELECT {WON} FROM e JOIN versions USING (key)""")
def q40b_merge_add_only(spark, d):
    return _told(replicas.merge(_entries(spark, d), "add_only"))


@query(f"""WITH {ENTRIES}, a AS (SELECT * FROM entries WHERE node = 'n0'), gone AS (SELECT DISTINCT key FROM a WHERE key % 4 = 1)
    SELECT key, a.context, a.deleted OR gone.key IS NOT NULL AS deleted, CASE WHEN gone.key IS NULL THEN a.ts ELSE 99999 END AS ts, 'n0=' || CASE WHEN gone.key IS NULL THEN a.v ELSE a.v + 1 END AS version FROM a LEFT JOIN gone USING (key)""")
def q40c_delete_entries(spark, d):
    own = _entries(spark, d).where("replica = 0").drop("replica")
    return _told(replicas.delete(own, own.where("key % 4 = 1").select("key"), "n0", 99999)).select("key", "context", "deleted", "ts", "version")


@query(f"WITH {ENTRIES} SELECT node, max(v) AS version FROM entries GROUP BY 1")
def q40d_state_vector(spark, d):
    return replicas.state_vector(_entries(spark, d))


@query("""WITH mine AS (SELECT DISTINCT o_custkey % 25 AS team FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 50 = 0)
    SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey % 10 = 0 OR (c_mktsegment = 'MACHINERY' AND c_nationkey IN (SELECT team FROM mine))""")
def q41_visibility(spark, d):
    c = V.table(spark, d, "customer")
    mine = V.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderkey % 50 = 0").select((F.col("o_custkey") % 25).alias("team")).distinct()
    open_ = (F.col("c_mktsegment") == "BUILDING") | (F.col("c_custkey") % 10 == 0)
    team = c.where(~open_ & (F.col("c_mktsegment") == "MACHINERY")).join(mine, F.col("c_nationkey") == F.col("team"), "left_semi")
    return c.where(open_).union(team).select("c_custkey", "c_nationkey")


@query("""WITH v AS (SELECT p_partkey, p_size % 4 || '.' || p_size % 7 || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.' || p_size % 11 END AS v FROM part),
    s AS (SELECT *, string_split(v, '.') AS x FROM v) SELECT p_partkey, v, (x[1]::INT, x[2]::INT, coalesce(x[3], '0')::INT) > (1, 4, 2) AS newer FROM s""")
def q42_version_compare(spark, d):
    third = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("."), F.col("p_size") % 11))
    v = V.table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size") % 4, F.lit("."), F.col("p_size") % 7, third).alias("v"))
    return v.select("p_partkey", "v", (T.version(F.col("v")) > T.version(F.lit("1.4.2"))).alias("newer"))


@query(f"""WITH own AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, {SPACES})) AS w FROM documents), theirs AS (SELECT DISTINCT item_id, unnest(string_split_regex(text, {SPACES})) AS w FROM benchmark),
    m AS (SELECT doc_id, item_id, count(*) AS shared FROM own JOIN theirs USING (w) WHERE strlen(w) >= 3 GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT doc_id AS query_id, arg_min(item_id, item_id) AS id, arg_min(shared, item_id) AS shared FROM m GROUP BY 1""")
def q43_word_overlap_match(spark, d):
    """Of the benchmark's items the first that shares two words with a document."""
    items = V.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("context"), F.col("item_id").alias("rank"))
    return R.first_overlap(V.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), items)


@query("SELECT page_id, string_split(url, '/')[-1] AS file_name, string_split(url, '.')[-1] AS extension FROM pages")
def q44_path_parts(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.file_name(F.col("url")).alias("file_name"), T.extension(F.col("url")).alias("extension"))


@query("SELECT doc_id, n, prefix FROM (SELECT doc_id, range AS n, left(text, range::INT) AS prefix, row_number() OVER (PARTITION BY doc_id ORDER BY range DESC) AS rn FROM documents, range(0, 42) WHERE strlen(left(text, range::INT)) <= 41 AND range <= length(text)) WHERE rn = 1")
def q45_byte_truncate(spark, d):
    cut = T.byte_truncate(F.col("text"), 41)
    return V.table(spark, d, "documents").select("doc_id", F.length(cut).cast("long").alias("n"), cut.alias("prefix"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.input.k'), json_extract_string(props, '$.tool_input.k'), json_extract_string(props, '$.k')) AS k FROM events")
def q46_json_fallback(spark, d):
    path = lambda p: F.get_json_object("props", p)
    return V.table(spark, d, "events").select("event_id", F.coalesce(path("$.input.k"), path("$.tool_input.k"), path("$.k")).alias("k"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q47_stream_counts(spark, d):
    """The state of a streamed count once all of the input is taken in."""
    stream = spark.readStream.schema(V.table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    return accumulate.run_available(stream, shared_path(spark, "counts"), "event_type string, n long", accumulate.count_by("event_type"))


from . import learning, reports, talk  # noqa: E402, F401: they register their queries
