"""Pattern-shaped views of the driver's tables, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = ("Fix the type error in", "Add a new feature to", "Run the tests of", "Refactor the module", "Build and compile", "Install dependencies for", "Write unit tests for", "Debug a crash of", "Update the config of", "Explain the code in")
FILES = ("main.rs", "app.tsx", "run.py", "go.mod", "start.sh", "Cargo.toml", "index.js", "notes.txt")
LINES = (
    "error[E0308]: mismatched types", "thread 'main' panicked at src", "No such file or directory", "permission denied (os error 13)", "operation timed out", "SyntaxError: unexpected token", "test result: FAILED", "error: unknown failure",
    "0 errors found, all done", "let me try another approach", "completed successfully",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def patterns_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_k(spark, sf_dir).withColumn("b", F.col("user_id") % 8)
    return e.groupBy("b", "k").agg(
        F.count_if(F.col("event_type").isin("purchase", "signup")).alias("success"), F.count_if(F.col("event_type") == "error").alias("failure"), F.max("ts").alias("last_used"), F.min("ts").alias("created"),
    ).select((F.col("b") * 1000 + F.col("k")).alias("id"), F.concat(F.lit("t"), "b").alias("tool_type"), F.concat(F.lit("c"), F.col("k") % 5).alias("category"), "k", "success", "failure", "last_used", "created")


EVENTS_K = "events_k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
PATTERNS_EV = EVENTS_K + """, patterns_ev AS (SELECT user_id % 8 * 1000 + k AS id, 't' || (user_id % 8) AS tool_type, 'c' || (k % 5) AS category, k,
    count(*) FILTER (event_type IN ('purchase', 'signup')) AS success, count(*) FILTER (event_type = 'error') AS failure, max(ts) AS last_used, min(ts) AS created
    FROM events_k GROUP BY user_id % 8, k)"""


def pick(items: tuple[str, ...], by: str):
    return F.get(F.array(*map(F.lit, items)), (F.expr(by) % len(items)).cast("int"))


def sql_pick(items: tuple[str, ...], by: str) -> str:
    listed = ", ".join("'" + x.replace("'", "''") + "'" for x in items)
    return f"([{listed}])[CAST({by} % {len(items)} AS BIGINT) + 1]"


def patterns_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns_ev(spark, sf_dir).withColumn("context", F.concat(pick(TASKS, "k"), F.lit(" "), pick(FILES, "id div 7"), F.lit(": "), pick(LINES, "id div 3")))


PATTERNS_CTX = PATTERNS_EV + f""", patterns_ctx AS (SELECT *, {sql_pick(TASKS, 'k')} || ' ' || {sql_pick(FILES, 'id // 7')} || ': ' || {sql_pick(LINES, 'id // 3')} AS context FROM patterns_ev)"""


def patterns_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count_if(F.col("l_returnflag") != "R").alias("success"), F.count_if(F.col("l_returnflag") == "R").alias("failure"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("tool_type"), F.col("p_type").alias("category"))
    return parts.join(sold, "id")


PATTERNS_SALES = """patterns_sales AS (SELECT p_partkey AS id, p_brand AS tool_type, p_type AS category, success, failure FROM part
    JOIN (SELECT l_partkey, count(*) FILTER (l_returnflag <> 'R') AS success, count(*) FILTER (l_returnflag = 'R') AS failure FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"""


def baskets_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day: the items touched, and whether no error happened."""
    e = events_k(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day"))
    made = e.agg(F.collect_set(F.col("k") % 20).alias("items"), (F.count_if(F.col("event_type") == "error") == 0).alias("ok"))
    return made.select(F.struct("day", "user_id").alias("seq"), F.concat_ws("/", "user_id", "day").alias("basket"), "items", "ok")


OCCURRENCES = EVENTS_K + """, items AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, k % 20 AS item FROM events_k),
    oks AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') = 0 AS ok FROM events_k GROUP BY 1, 2),
    occurrences AS (SELECT x.user_id, x.day, x.item AS a, y.item AS b, ok FROM items x JOIN items y ON x.user_id = y.user_id AND x.day = y.day AND x.item < y.item JOIN oks ON oks.user_id = x.user_id AND oks.day = x.day)"""
EDGES = OCCURRENCES + """, folded AS (SELECT a, b, list(ok ORDER BY day, user_id) AS h FROM occurrences GROUP BY a, b),
    edges AS (SELECT a, b, list_reduce(h[2:], lambda acc, x: acc * (1.0::DOUBLE - 0.3::DOUBLE) + (CASE WHEN x THEN 1.5::DOUBLE ELSE 0.3::DOUBLE END) * 0.3::DOUBLE,
    CASE WHEN h[1] THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END) AS lift, len(h)::BIGINT AS co_occurrences FROM folded)"""
