"""Registered queries: streams over the events table, and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurispark.plans.registry import DERIVED, register, table
from plurispark.session import shared_folder
from plurispark.streaming import events as ev

_HOUR = 3_600_000_000


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table as a file stream, followed by one row far in the future.

    The extra row moves the watermark past every real row, so that append mode
    emits the windows that would otherwise stay open at the end.
    """
    schema = table(spark, folder, name).schema
    real = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    future = {"event_id": -1, "user_id": -1, "ts": "2199-01-01 00:00:00"}
    row = spark.range(1).select(*[F.lit(future.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    row.write.parquet(path)
    return real.unionByName(spark.readStream.schema(schema).parquet(path))


def _run(df: DataFrame, sink=None) -> str:
    """Run a stream over what is there now; its rows (or the sink's tables) land in a new folder."""
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if sink is None:
        started = writer.outputMode("append").format("parquet").start(f"{base}/rows")
    else:
        started = writer.outputMode("append").foreachBatch(sink).start()
    started.awaitTermination()
    return f"{base}/rows"


def _rows(df: DataFrame) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(_run(df))


def _naive(df: DataFrame) -> DataFrame:
    """Instants as zone-less times again, as the driver tables hold them."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
        for f in df.schema.fields
    ])


_BURSTS = """
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM r GROUP BY user_id, run"""


@register("coalesce_bursts", _BURSTS)
def coalesce_bursts(spark, folder):
    return _naive(ev.sessions(table(spark, folder, "events"), ["user_id"], F.lit(4 * _HOUR), bucket_us=24 * _HOUR))


@register("coalesce_bursts_stream", _BURSTS)
def coalesce_bursts_stream(spark, folder):
    return _naive(_rows(ev.coalesce_bursts(_stream(spark, folder, "events"), ["user_id"], gap="4 hours")))


#: Events change files; the customers' own folders are followed.
DERIVED["change_events"] = """
SELECT event_id, ts, CASE WHEN event_type = 'view' THEN 'data' WHEN event_type = 'click' THEN 'data/u' || cast(user_id AS string)
  ELSE 'data/u' || cast(user_id AS string) || '/' || event_type || '.csv' END AS path FROM events"""
DERIVED["followed"] = "SELECT 'data/u' || cast(c_custkey AS string) || '/error.csv' AS path FROM customer WHERE c_acctbal > 0"
_WATCHED = """
SELECT event_id, ts, path FROM change_events e WHERE EXISTS (SELECT 1 FROM followed f WHERE f.path = e.path OR starts_with(f.path, e.path || '/'))"""


@register("watch_set", _WATCHED)
def watch_set(spark, folder):
    return ev.watch_set(table(spark, folder, "change_events"), table(spark, folder, "followed")).select("event_id", "ts", "path")


@register("watch_set_stream", _WATCHED)
def watch_set_stream(spark, folder):
    own = F.concat(F.lit("data/u"), F.col("user_id").cast("string"))
    path = F.when(F.col("event_type") == "view", "data").when(F.col("event_type") == "click", own).otherwise(
        F.concat(own, F.lit("/"), F.col("event_type"), F.lit(".csv"))
    )
    changes = _stream(spark, folder, "events").where("event_id >= 0").select("event_id", "ts", path.alias("path"))
    return _rows(ev.watch_set(changes, table(spark, folder, "followed")).select("event_id", "ts", "path"))


#: A user's events of one day are one task; a view is its result, a click its marker.
_TASK = "cast(user_id AS string) || '/' || cast(cast(ts AS date) AS string)"
DERIVED["marks"] = f"""
SELECT {_TASK} AS task, ts, CASE event_type WHEN 'view' THEN 'returned' WHEN 'click' THEN 'done' ELSE 'output' END AS kind FROM events"""
_COMPLETE = """
SELECT task, coalesce(d <= r + INTERVAL 2 HOUR, false) AS complete FROM
 (SELECT task, min(ts) FILTER (kind = 'returned') AS r, min(ts) FILTER (kind = 'done') AS d FROM marks GROUP BY task) WHERE r IS NOT NULL"""


@register("completion", _COMPLETE)
def completion(spark, folder):
    return ev.completion_batch(table(spark, folder, "marks"), deadline_s=7200)


@register("completion_stream", _COMPLETE)
def completion_stream(spark, folder):
    kind = F.when(F.col("event_type") == "view", "returned").when(F.col("event_type") == "click", "done").otherwise("output")
    task = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("ts").cast("date").cast("string"))
    marks = _stream(spark, folder, "events").select(
        task.alias("task"), "ts", F.when(F.col("event_id") < 0, "done").otherwise(kind).alias("kind")
    )
    return _rows(ev.completion(marks, deadline_s=7200))


@register("tail_state_stream", """
WITH a AS (SELECT user_id, event_id, props, strlen(props) AS n, coalesce(sum(strlen(props)) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM events)
SELECT cast(user_id AS string) AS task, string_agg(CASE WHEN n > 100 - after THEN substr(props, cast(n - (100 - after) + 1 AS bigint)) ELSE props END, '' ORDER BY event_id) AS tail
FROM a WHERE after < 100 GROUP BY user_id""")
def tail_state_stream(spark, folder):
    from plurispark.operators.logs import tail_text

    chunks = _stream(spark, folder, "events").where("event_id >= 0").select(
        F.col("user_id").cast("string").alias("task"), F.col("event_id").alias("seq"), F.col("props").alias("data")
    )
    sink = ev.TailSink(f"{shared_folder(spark)}/tails-{uuid.uuid4().hex}", limit=100)
    last: list[int] = []

    def each(batch, batch_id):
        sink(batch, batch_id)
        last.append(batch_id)

    _run(chunks, each)
    return sink.read(spark, last[-1]).select("task", tail_text(F.col("tail")).alias("tail"))


#: Users as allocations with their own idle timeouts; some have a walltime.
DERIVED["activity"] = """
SELECT 'a' || cast(user_id AS string) AS allocation, ts, CASE WHEN user_id < 100 THEN 14400 ELSE 28800 END AS idle_s, CASE WHEN user_id < 50 THEN 21600 END AS walltime_s FROM events"""
_ENDED = """
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY allocation ORDER BY ts) <= to_seconds(idle_s) THEN 0 ELSE 1 END AS fresh FROM activity),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY allocation ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m)
SELECT allocation, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, least(max(ts) + to_seconds(any_value(idle_s)), coalesce(min(ts) + to_seconds(any_value(walltime_s)), TIMESTAMP '9999-01-01')) AS ended_at
FROM r GROUP BY allocation, run"""


@register("idle_end", _ENDED)
def idle_end(spark, folder):
    return _naive(ev.idle_end_batch(table(spark, folder, "activity")))


@register("idle_end_stream", _ENDED)
def idle_end_stream(spark, folder):
    user = F.col("user_id")
    activity = _stream(spark, folder, "events").select(
        F.concat(F.lit("a"), user.cast("string")).alias("allocation"), "ts",
        F.when(user < 100, 14400).otherwise(28800).alias("idle_s"), F.when((user >= 0) & (user < 50), 21600).alias("walltime_s"),
    )
    return _naive(_rows(ev.idle_end(activity)))


@register("results_stream", """
SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS outcome FROM orders GROUP BY o_custkey, o_orderpriority""")
def results_stream(spark, folder):
    schema = table(spark, folder, "orders").schema
    results = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(folder).select(
        "o_custkey", "o_orderpriority", "o_orderkey", F.col("o_orderstatus").alias("outcome")
    )
    sink = ev.ResultsSink(f"{shared_folder(spark)}/results-{uuid.uuid4().hex}", ["o_custkey", "o_orderpriority"], "o_orderkey")
    _run(results, sink)
    return sink.read(spark)


# --- sidecars ------------------------------------------------------------------

@register("sidecar_round_trip", """
SELECT 'n' || cast(c_nationkey AS string) AS universe_id, 'c' || cast(c_custkey AS string) AS output_id, 'fit ' || c_name AS recipe, c_mktsegment AS segment, 'v' || cast(c_custkey AS string) AS data_version,
  '' AS started_at, 1 AS schema_version FROM customer""")
def sidecar_round_trip(spark, folder):
    """Manifests of the customers' outputs written as hidden files and read back."""
    from plurispark.sources import sidecars

    text = lambda *parts: F.concat(*parts)
    customers = table(spark, folder, "customer")
    manifests = customers.select(
        F.lit(1).alias("schema_version"), text(F.lit("c"), F.col("c_custkey").cast("string")).alias("output_id"),
        text(F.lit("n"), F.col("c_nationkey").cast("string")).alias("universe_id"), text(F.lit("fit "), "c_name").alias("recipe"),
        F.lit("d").alias("definition_version"), F.lit("e").alias("env_version"), text(F.lit("v"), F.col("c_custkey").cast("string")).alias("data_version"),
        F.create_map(F.lit("segment"), "c_mktsegment").alias("decisions"), F.create_map(F.lit("in"), F.lit("x")).alias("input_versions"),
        F.lit("abc").alias("git_sha"), F.lit("").alias("git_remote"), F.lit("1").alias("lc_version"),
        F.struct(F.lit("none").alias("mechanism"), F.lit("").alias("fs"), F.lit("").alias("network"),
                 F.lit(None).cast("int").alias("landlock_abi"), F.lit(1).alias("exec_allowlist_version")).alias("hermeticity"),
    )
    root = f"{shared_folder(spark)}/project-{uuid.uuid4().hex}".removeprefix("file:")
    sidecars.write_manifests(manifests, root)
    return sidecars.read_manifests(spark, root).select(
        "universe_id", "output_id", "recipe", F.col("decisions")["segment"].alias("segment"), "data_version", "started_at", "schema_version"
    )
