"""Counting and folding of streams. State lies in tables, one a batch, so that a batch that is run again gives the same."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import numbered

log = logging.getLogger(__name__)

#: New rows that make a cycle run, failures of a cycle after which its rows are let go, and rows or hours after which reflection is due.
ENOUGH, RETRIES, DUE_ROWS, DUE_HOURS = 15, 3, 50, 4


class Snapshots:
    """Tables base/n of a state; the last one before a batch is read, the batch's own is written."""

    def __init__(self, spark: SparkSession, base: str, schema: str | StructType):
        self.spark, self.base, self.schema = spark, base, schema

    def read(self, n: int | None) -> DataFrame:
        if n is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/{n}")

    def before(self, batch: int) -> DataFrame:
        return self.read(max((n for n in numbered(self.spark, self.base) if n < batch), default=None))

    def latest(self) -> DataFrame:
        """The last table written, empty if there is none."""
        return self.read(max(numbered(self.spark, self.base), default=None))

    def write(self, batch: int, state: DataFrame) -> DataFrame:
        state.write.mode("overwrite").parquet(f"{self.base}/{batch}")
        return self.read(batch)


def run_available(stream: DataFrame, base: str, schema: str, step: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """Take in what is there, batch by batch: step(state, rows, batch) gives the next state. Returns the last state, be it of this call or of one before. Run again, it goes on where it stopped."""
    state = Snapshots(stream.sparkSession, f"{base}/state", schema)

    def take(rows: DataFrame, batch: int) -> None:
        state.write(batch, step(state.before(batch), rows, batch))

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state.latest()


def count_by(*keys: str) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """A step that adds a batch's counts by keys to a state (keys, n). A batch is counted before it meets the state."""

    def step(state: DataFrame, rows: DataFrame, batch: int) -> DataFrame:
        new = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        return state.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))

    return step


def fold_lift(state: DataFrame, rows: DataFrame, batch: int) -> DataFrame:
    """A step that goes on with each edge's lift: state (a, b, lift, co_occurrences), rows (a, b, seq, ok)."""
    from ..operators import graph as G

    new = G.folded(rows)
    both = state.withColumnsRenamed({"lift": "old", "co_occurrences": "had"}).join(new, ["a", "b"], "full")
    first = F.coalesce(F.col("old") * F.col("factor") + F.col("offset"), F.col("old"), F.col("lift"))
    return both.select("a", "b", first.alias("lift"), (F.coalesce("had", F.lit(0)) + F.coalesce("co_occurrences", F.lit(0))).alias("co_occurrences"))


class Held(NamedTuple):
    """What an accumulator knows: the last batch taken, how many rows wait, cycles that succeeded, failures in a row of the cycle that is to come, rows set aside, and the folders of those that wait and are set aside; when the last cycle was."""

    batch: int = -1
    pending: int = 0
    cycles: int = 0
    failures: int = 0
    dropped: int = 0
    waiting: tuple[str, ...] = ()
    aside: tuple[str, ...] = ()
    last: datetime | None = None


HELD = "batch long, pending long, cycles long, failures long, dropped long, waiting array<string>, aside array<string>, last timestamp"


class Accumulator:
    """Rows of a stream that wait until there are enough of them, or until hours have passed since the last cycle; then act(rows, cycle) is given all that wait.

    A batch's rows are written once, below base, and wait there; the state is a row with their folders, numbered step by
    step. A batch that is run again is known by its number and changes nothing, and a cycle that is run again has the
    same number, so that act can overwrite what it wrote. Where act fails, its rows wait on for the next batch or tick();
    after retries failures in a row they are set aside: they stay readable, and the next rows don't wait for them. hours
    counts from the first cycle on; before it, any row is due. clock gives the time.
    """

    def __init__(self, spark: SparkSession, base: str, schema: StructType, act: Callable[[DataFrame, int], None], enough: int = ENOUGH, hours: float | None = None, retries: int = RETRIES, clock: Callable[[], datetime] = datetime.now):
        self.spark, self.base, self.schema, self.act, self.enough, self.hours, self.retries, self.clock = spark, base, schema, act, enough, hours, retries, clock
        self.states = Snapshots(spark, f"{base}/held", HELD)

    def held(self) -> Held:
        row = self.states.latest().first()
        return Held(**(row.asDict() | {"waiting": tuple(row["waiting"]), "aside": tuple(row["aside"])})) if row else Held()

    def rows(self, folders: tuple[str, ...]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def waiting(self) -> DataFrame:
        return self.rows(self.held().waiting)

    def set_aside(self) -> DataFrame:
        return self.rows(self.held().aside)

    def due(self, held: Held) -> bool:
        if held.pending >= self.enough:
            return True
        if self.hours is None or not held.pending:
            return False
        return held.last is None or self.clock() - held.last >= timedelta(hours=self.hours)

    def step(self, held: Held) -> None:
        """Run a cycle if one is due, and write the state."""
        if self.due(held):
            try:
                self.act(self.rows(held.waiting), held.cycles)
                held = held._replace(pending=0, waiting=(), cycles=held.cycles + 1, failures=0, last=self.clock())
            except Exception:  # noqa: BLE001: whatever fails is tried again
                log.exception("cycle %s failed", held.cycles)
                held = held._replace(failures=held.failures + 1)
                if held.failures >= self.retries:
                    held = held._replace(pending=0, waiting=(), aside=held.aside + held.waiting, failures=0, dropped=held.dropped + held.pending)
        n = max(numbered(self.spark, self.states.base), default=-1) + 1
        self.states.write(n, self.spark.createDataFrame([tuple(list(x) if isinstance(x, tuple) else x for x in held)], HELD).coalesce(1))

    def take(self, rows: DataFrame, batch: int) -> None:
        held = self.held()
        if batch <= held.batch:
            return
        rows.write.mode("overwrite").parquet(folder := f"{self.base}/rows/{batch}")
        n = self.spark.read.schema(self.schema).parquet(folder).count()
        self.step(held._replace(batch=batch, pending=held.pending + n, waiting=(*held.waiting, folder) if n else held.waiting))

    def tick(self) -> None:
        """Look at the clock: a cycle that is due runs, though no rows came."""
        held = self.held()
        if self.due(held):
            self.step(held)

    def run_available(self, stream: DataFrame) -> None:
        """Take in what the stream has, and look at the clock."""
        before = self.held().batch
        stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        if self.held().batch == before:
            self.tick()


PATTERNS = "hash string, tool_type string, category string, context string, success long, failure long, last_used timestamp"
EDGES = "a long, b long, lift double, co_occurrences long"
LOG = "event_type string, trajectories long, calls long, patterns long, edges long, created_at timestamp"


class Ended(NamedTuple):
    """Tables after the sessions that have ended: patterns, edges and skills as the last cycle left them, the log of all cycles, and the trajectories that wait."""

    patterns: DataFrame
    edges: DataFrame
    skills: DataFrame
    log: DataFrame
    waiting: DataFrame


def session_end(trajectories: DataFrame, base: str, now: str, enough: int = ENOUGH, hours: float | None = None, clock: Callable[[], datetime] = datetime.now) -> Ended:
    """Take in a stream of trajectories that have ended; once enough of them wait (or hours have passed), a cycle learns patterns and edges from all that wait, consolidates them and makes skills anew.

    A cycle writes its own tables below base, which the next one reads; the log has a row a cycle, in a folder of its own,
    so that a cycle that is run again appends nothing twice. A call that finds nothing new returns what is stored.
    """
    from ..operators import consolidate as C
    from ..operators import learn as L

    spark = trajectories.sparkSession
    kinds = {"patterns": PATTERNS, "edges": EDGES, "skills": C.SKILLS, "log": LOG}
    tables = {name: Snapshots(spark, f"{base}/{name}", schema) for name, schema in kinds.items()}

    def cycle(rows: DataFrame, n: int) -> None:
        new = L.learn_cycle(rows, tables["patterns"].before(n), tables["edges"].before(n), now)
        known, edges, skills = C.consolidate(new.patterns.withColumn("id", F.xxhash64("hash")), new.edges, now)
        tables["log"].write(n, new.log)
        tables["edges"].write(n, edges)
        tables["skills"].write(n, skills)
        tables["patterns"].write(n, known.drop("id").select(*tables["patterns"].read(None).columns))

    acc = Accumulator(spark, f"{base}/sessions", trajectories.schema, cycle, enough, hours, clock=clock)
    acc.run_available(trajectories)
    done = [n for n in numbered(spark, f"{base}/log") if n < acc.held().cycles]
    rows = spark.read.schema(LOG).parquet(*(f"{base}/log/{n}" for n in done)) if done else tables["log"].read(None)
    last = {name: t.before(acc.held().cycles) for name, t in tables.items()}
    return Ended(last["patterns"], last["edges"], last["skills"], rows, acc.waiting())


def append_once(rows: DataFrame, path: str, batch: int) -> None:
    """Append a batch's rows to a log that lies in folders by batch; run again, the batch's rows replace its own."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def reflection_due(rows: Column, last: Column, now: Column) -> Column:
    """Whether enough rows, or enough time since the last cycle (null: never), ask for another."""
    return (rows >= DUE_ROWS) | (last.isNull() & (rows > 0)) | (F.timestamp_diff("HOUR", last, now) >= DUE_HOURS)
