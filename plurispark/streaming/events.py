"""Change bursts, followed paths, completion, tails, idleness and results as streams.

Late rows: every operator takes the watermark delay as a parameter. Rows later
than that are dropped by the stream; the batch twins see every row.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plurispark.functions.paths import ancestors
from plurispark.operators.logs import TAIL_BYTES, stderr_tail

#: The quiet time that ends a burst, and how long a marker is waited for.
BURST_GAP = "200 milliseconds"
COMPLETION_DEADLINE_S = 10


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """*df* with its event time as an instant; zone-less times are read in the session's zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


# --- bursts and idleness -------------------------------------------------------


def _sessions(events: DataFrame, gap: Column | str, keys: Sequence[str], delay: str) -> DataFrame:
    return (
        event_time(events).withWatermark("ts", delay)
        .groupBy(*keys, F.session_window("ts", gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
        .select(*keys, F.col("_w.start").alias("first_ts"), "last_ts", F.col("_w.end").alias("end_ts"), "n")
    )


def coalesce_bursts(events: DataFrame, keys: Sequence[str], gap: str = BURST_GAP, delay: str = "10 seconds") -> DataFrame:
    """One row per burst of a stream: events less than *gap* apart, or exactly *gap*."""
    return _sessions(events, gap, keys, delay).drop("end_ts")


#: Width of the time buckets a key's events are first grouped by.
BUCKET_US = 3_600_000_000


def sessions(events: DataFrame, keys: Sequence[str], gap_us: Column, bucket_us: int = BUCKET_US) -> DataFrame:
    """The batch twin: ``first_ts, last_ts, n`` per run of events at most *gap_us* apart.

    A key's events are cut into time buckets, so a hot key is spread over many
    tasks. Runs inside a bucket are final; only the first and last run of each
    bucket can touch a neighbour, and those few rows are joined up per key.
    The gap must be the same for all events of a key and not exceed the bucket.
    """
    keys = list(keys)
    t = F.unix_micros("ts")
    rows = event_time(events).select(*keys, "ts", t.alias("_t"), gap_us.cast("long").alias("_g"), F.floor(t / F.lit(bucket_us)).alias("_b"))

    def runs(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(start)
        before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.when(before.isNull() | (F.col(start) - before > F.col("_g")), 1).otherwise(0)
        return df.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    inner = runs(rows.withColumn("_e", F.col("_t")), [*keys, "_b"], "_t", "_e").groupBy(*keys, "_b", "_run").agg(
        F.min("_t").alias("_s"), F.max("_t").alias("_e"), F.count(F.lit(1)).alias("n"), F.max("_g").alias("_g")
    )
    place = Window.partitionBy(*keys, "_b")
    edges = inner.withColumn("_edge", (F.col("_run") == F.min("_run").over(place)) | (F.col("_run") == F.max("_run").over(place)))
    settled = edges.where(~F.col("_edge")).select(*keys, "_s", "_e", "n")
    joined = runs(edges.where("_edge").drop("_run"), keys, "_s", "_e").groupBy(*keys, "_run").agg(
        F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("n").alias("n")
    )
    return settled.unionByName(joined.select(*keys, "_s", "_e", "n")).select(
        *keys, F.timestamp_micros("_s").alias("first_ts"), F.timestamp_micros("_e").alias("last_ts"), "n"
    )


def idle_end(activity: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """When allocations end: idle for their own ``idle_s``, or at ``walltime_s``, whichever is first.

    *activity* has ``allocation, ts, idle_s, walltime_s`` (NULL walltime for none).
    """
    gap = F.concat(F.col("idle_s").cast("string"), F.lit(" seconds"))
    return _ended(
        event_time(activity).withWatermark("ts", delay)
        .groupBy("allocation", "idle_s", "walltime_s", F.session_window("ts", gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
        .select("allocation", "idle_s", "walltime_s", F.col("_w.start").alias("first_ts"), "last_ts", "n")
    )


def idle_end_batch(activity: DataFrame) -> DataFrame:
    keys = ["allocation", "idle_s", "walltime_s"]
    # Null-safe grouping: a missing walltime is a value of its own.
    return _ended(sessions(activity, keys, F.col("idle_s").cast("long") * 1_000_000, bucket_us=24 * BUCKET_US))


def _ended(rows: DataFrame) -> DataFrame:
    idle = F.col("last_ts") + F.make_dt_interval(secs=F.col("idle_s"))
    hard = F.col("first_ts") + F.make_dt_interval(secs=F.col("walltime_s"))
    return rows.select("allocation", "first_ts", "last_ts", "n", F.least(idle, hard).alias("ended_at"))


# --- followed paths ------------------------------------------------------------


def watch_set(events: DataFrame, follow: DataFrame) -> DataFrame:
    """Events on a followed path or on a folder above one, whose creation announces it."""
    wanted = follow.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return events.join(wanted, "path", "left_semi")


# --- completion ----------------------------------------------------------------


def completion_batch(events: DataFrame, deadline_s: int = COMPLETION_DEADLINE_S) -> DataFrame:
    """``task, complete`` for returned tasks: its marker came no later than the deadline.

    *events* has ``task, ts, kind``: ``returned`` when the task's result arrived,
    ``done`` for the marker after its last bytes.
    """
    seen = events.groupBy("task").agg(
        F.min(F.when(F.col("kind") == "returned", F.col("ts"))).alias("_r"),
        F.min(F.when(F.col("kind") == "done", F.col("ts"))).alias("_d"),
    )
    limit = F.col("_r") + F.make_dt_interval(secs=F.lit(deadline_s))
    return seen.where("_r IS NOT NULL").select("task", F.coalesce(F.col("_d") <= limit, F.lit(False)).alias("complete"))


#: Tasks are dealt to this many groups of state, so that one call into Python judges many of them.
COMPLETION_GROUPS = 4096


def completion(events: DataFrame, deadline_s: int = COMPLETION_DEADLINE_S, delay: str = "10 seconds") -> DataFrame:
    """The stream: a task is reported once, when its marker or its deadline passes.

    State is two instants per task, held as arrays by group of tasks; events without a bearing on them never reach it.
    A mark without an instant is a NaN: as its task's first of a kind it leaves the task incomplete.
    """
    width = deadline_s * 1_000_000

    def instant(us):
        return None if us is None or us != us else int(us)

    def step(key, frames, state: GroupState):
        known = {t: rest for t, *rest in zip(*state.get, strict=True)} if state.exists else {}
        touched = set()
        for frame in frames:
            for task, returns, us in zip(frame["task"], frame["returns"], frame["us"], strict=True):
                returned, done, told = known.get(task, (None, None, False))
                if returns:
                    returned = us if returned is None else min(returned, us)
                else:
                    done = us if done is None else min(done, us)
                known[task] = (returned, done, told)
                touched.add(task)
        now, wake, kept, verdicts = state.getCurrentWatermarkMs(), None, [], []
        for task, (returned, done, told) in known.items():
            over = False
            if returned is not None:
                ends = (returned + width) // 1000 + 1
                over = not ends > now  # also for a NaN
                if not over:
                    wake = ends if wake is None else min(wake, ends)
                if not told:
                    met = done is not None and done <= returned + width
                    if met or over or done is not None:
                        verdicts.append((task, met))
                        told = True
            if not over or task in touched:
                kept.append((task, instant(returned), instant(done), told))
        if kept:
            state.update(tuple(list(c) for c in zip(*kept, strict=True)))
            if wake is not None:
                state.setTimeoutTimestamp(int(wake))
        elif state.exists:
            state.remove()
        if verdicts:
            yield pd.DataFrame(verdicts, columns=["task", "complete"])

    marks = event_time(events).where(F.col("kind").isin("returned", "done")).withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("task"), F.lit(COMPLETION_GROUPS)).alias("group"), "task", (F.col("kind") == "returned").alias("returns"),
        F.unix_micros("ts").alias("us"), "ts",
    )
    return marks.groupBy("group").applyInPandasWithState(
        step, "task string, complete boolean", "task array<string>, returned array<long>, done array<long>, told array<boolean>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


# --- sinks ---------------------------------------------------------------------


class TailSink:
    """Keeps every task's last bytes up to date, for ``foreachBatch``.

    Each micro-batch's chunks meet the tails so far in one batch job and become
    the table of that batch; replaying a batch rewrites the same table.
    """

    def __init__(self, path: str, limit: int = TAIL_BYTES):
        self.path, self.limit = path.rstrip("/"), limit

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        chunks = batch.select("task", "seq", F.col("data").cast("binary").alias("data"))
        if batch_id > 0:
            kept = self.read(batch.sparkSession, batch_id - 1)
            chunks = chunks.unionByName(kept.select("task", F.lit(-1).cast("long").alias("seq"), F.col("tail").alias("data")))
        stderr_tail(chunks, self.limit).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.schema("task string, tail binary").parquet(f"{self.path}/batch={batch_id}")


class ResultsSink:
    """Consumes results as they finish, for ``foreachBatch``: one row per run and task.

    A batch is written under its own number, so replaying it changes nothing; of
    several results of one task the latest batch, then the largest *order*, counts.
    """

    def __init__(self, path: str, keys: Sequence[str], order: str):
        self.path, self.keys, self.order = path.rstrip("/"), list(keys), order

    def _latest(self, df: DataFrame, *rank: str) -> DataFrame:
        rest = [c for c in df.columns if c not in self.keys]
        return df.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("_r")).select(*self.keys, "_r.*")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._latest(batch, self.order).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return self._latest(spark.read.parquet(self.path), "batch", self.order).drop("batch")
