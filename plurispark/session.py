"""Session set-up and the few cluster-facing helpers every operator shares."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is only hinted for broadcast when it is measured below both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
#: Bytes of input tables for each shuffle partition that a query starts with.
PART_BYTES = 8 * 1024 * 1024
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_JOINED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: With this set, Spark removes the shuffle files of a query when it has ended.
_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of staged tables, until they are discarded.
_STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def build_session(app: str = "plurispark", cores: str | None = None) -> SparkSession:
    """A session with the settings the operators assume.

    Where a master is configured (a submitted job), it and its number of shuffle
    partitions stay as they are; otherwise the session runs on this machine.
    """
    cores = cores or os.environ.get("BENCH_CPUS") or "8"
    builder = SparkSession.builder.appName(app)
    if not _submitted():
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", cores)
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEM", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _submitted() -> bool:
    """Whether the process was started with a master of its own."""
    given = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    return "--master" in given or bool(os.environ.get("MASTER") or os.environ.get("SPARK_REMOTE")) or SparkSession.getActiveSession() is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be unreadable from the other executors.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="plurispark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written in this block leaves no shuffle files: the written table stands for them."""
    before = spark.conf.get(_REMOVED, None)
    spark.conf.set(_REMOVED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVED)
        else:
            spark.conf.set(_REMOVED, before)


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing *df* to the shared folder and reading it back.

    A written table survives lost executors, and its file sizes give the next
    plan real statistics, which an in-memory cut would not. It stays until it is discarded.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[out] = path
    return out


def stage_split(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Write *df* once and read it back as (rows with *flag* true, the others); each can be discarded by itself."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.withColumn(flag, F.col(flag).cast("string")).write.partitionBy(flag).option("compression", "zstd").parquet(path)
    schema = df.drop(flag).schema.add(flag, "string")
    back = spark.read.schema(schema).parquet(path)
    out = tuple(back.where(F.col(flag) == value).drop(flag) for value in ("true", "false"))
    _STAGED.update({half: f"{path}/{flag}={value}" for half, value in zip(out, ("true", "false"))})
    return out


def discard(*tables: DataFrame | None) -> None:
    """Empty staged tables that no plan reads again, so the shared folder holds what is still needed.

    Only what :func:`stage` or :func:`stage_split` returned is emptied, once; other tables are left alone.
    """
    for table in tables:
        if table is not None and (path := _STAGED.pop(table, None)):
            table.sparkSession.range(0).write.mode("overwrite").parquet(path)


def is_empty(df: DataFrame) -> bool:
    """Whether a staged table holds no row."""
    return not df.head(1)


def fit_partitions(spark: SparkSession, folder: str) -> None:
    """Let shuffles start with partitions in proportion to the tables of *folder*, so a task's share stays the same.

    Adaptive execution joins small partitions again, up to twice PART_BYTES. Settings that the session was started with stay.
    """
    started = spark.sparkContext.getConf()
    if started.get(_INITIAL) or started.get(_JOINED):
        return
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    size = files.agg(F.sum("length")).first()[0] or 0
    wanted = -(-size // PART_BYTES)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_INITIAL, str(wanted))
        spark.conf.set(_JOINED, str(2 * PART_BYTES))
    else:
        spark.conf.unset(_INITIAL)
        spark.conf.unset(_JOINED)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure whether *df* is below the broadcast bounds, reading at most ``rows`` + 1."""
    width = F.lit(16)
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        text = c if field.dataType.typeName() == "binary" else c.cast("string")
        width = width + F.coalesce(F.octet_length(text), F.lit(0))
    seen = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return seen["n"] <= rows and (seen["b"] or 0) <= size


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast for a measured-small side; otherwise leave the join to AQE."""
    return F.broadcast(df) if small(df) else df


def ranked(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Add a dense global position without one task ever seeing all rows.

    Rows are range-partitioned on the order columns and written once, so that
    each row's partition number is a stored fact. The only global step is a
    running sum over one row per partition.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = stage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_part", "_base")
    )
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        placed.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, (F.col("_base") + within - 1 + start).cast("long"))
        .drop("_part", "_base")
    )


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
