"""Who last wrote what, and the run records in a change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurispark.functions.records import RUN_BLOCK, RUN_MARKER, run_subject

KEY = ["universe_id", "output_id"]


def last_writer(commits: DataFrame, commit_paths: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest commit touching any path of each group; groups nobody wrote get no row.

    *groups* is the *keys* columns plus ``path``. The log is first reduced to the
    newest commit per path, combined before the shuffle, so a path that most
    commits touch costs nothing; the commit's text columns join on last, for one
    row per group.
    """
    touched = commit_paths.groupBy("path").agg(F.max("seq").alias("seq"))
    newest = touched.join(groups, "path").groupBy(*keys).agg(F.max("seq").alias("seq"))
    return newest.join(commits, "seq")


def foreign_writes(tasks: DataFrame, last_write: DataFrame) -> DataFrame:
    """Last writes of tasks' files that are not the task's own run record."""
    return tasks.select(*KEY).join(last_write, KEY).where(
        F.col("sha").isNotNull() & ~F.col("subject").eqNullSafe(run_subject(F.col("universe_id"), F.col("output_id")))
    )


_RECORD = (
    "chain array<string>, cmd string, dsid string, exit int, inputs array<string>, outputs array<string>, "
    "pwd string, extra_inputs array<string>"
)


def run_ledger(commits: DataFrame) -> DataFrame:
    """The run records of a change log with a full ``message`` column, as columns.

    The subject names output and universe, the JSON between the marker lines the
    command and its files; commits that carry no such record are left out.
    """
    subject = F.substring_index("message", "\n", 1)
    shape = r"^\[DATALAD RUNCMD\] (\S+) \[(\S+)\]\z"
    block = F.nullif(F.regexp_extract("message", RUN_BLOCK, 1), F.lit(""))
    return (
        commits.where(F.startswith("message", F.lit(RUN_MARKER)))
        .select(
            *[c for c in commits.columns if c != "message"],
            F.nullif(F.regexp_extract(subject, shape, 1), F.lit("")).alias("output_id"),
            F.nullif(F.regexp_extract(subject, shape, 2), F.lit("")).alias("universe_id"),
            F.from_json(block, _RECORD).alias("_r"),
        )
        .where(F.col("output_id").isNotNull() & F.col("_r.cmd").isNotNull())
        .select("*", "_r.cmd", "_r.dsid", "_r.exit", "_r.inputs", "_r.outputs", "_r.extra_inputs")
        .drop("_r")
    )
