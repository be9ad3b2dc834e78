"""Change logs and storage listings, as version-control tools print them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurispark.schemas import COMMIT_PATHS, COMMITS
from plurispark.session import ranked, stage


def parse_commits(lines: DataFrame, column: str = "value") -> DataFrame:
    """``sha, subject, author, email, date`` from NUL-separated records; other columns stay.

    Lines that are not five fields answer nothing, which is never an error here.
    """
    parts = F.split(F.col(column), "\u0000")
    rest = [c for c in lines.columns if c != column]
    names = ("sha", "subject", "author", "email", "date")
    return lines.where(F.size(parts) == len(names)).select(
        *rest, *[parts[i].alias(n) for i, n in enumerate(names)]
    )


def read_change_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(commits, commit_paths)`` of a log with the newest commit first.

    The log has one line ``%H%x00%s%x00%an%x00%ae%x00%as`` for each commit, followed by one
    line for each path it touched. ``seq`` grows from the oldest commit to the
    newest. Positions come from range partitions, so the log may be of any size and
    in any number of files. A log that does not exist reads as empty tables: "cannot
    say" is an answer.
    """
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException:
        return spark.createDataFrame([], COMMITS), spark.createDataFrame([], COMMIT_PATHS)
    order = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}
    placed = stage(ranked(lines.select("value", *[c.alias(n) for n, c in order.items()]), list(order), "pos").select("pos", "value"))
    commits = stage(ranked(parse_commits(placed), ["pos"], "_k"))
    n, total = commits.count(), placed.count()
    following = commits.select((F.col("_k") - 1).alias("_k"), F.col("pos").alias("_next"))
    spans = commits.select("_k", "pos").join(following, "_k", "left").withColumn("_next", F.coalesce("_next", F.lit(total)))
    seq = (F.lit(n - 1) - F.col("_k")).cast("long").alias("seq")
    owned = spans.where("_next - pos > 1").select(seq, F.explode(F.sequence(F.col("pos") + 1, F.col("_next") - 1)).alias("pos"))
    touched = owned.join(placed, "pos").where("value <> ''").select("seq", F.col("value").alias("path"))
    return commits.select(seq, "sha", "subject", "author", "email", "date"), touched


def parse_storage_keys(lines: DataFrame, column: str = "value") -> DataFrame:
    """``path, key`` of ``file TAB key`` lines, split at the last tab; half-empty lines drop."""
    pattern = r"(?s)^(.+)\t([^\t]+)\z"
    rest = [c for c in lines.columns if c != column]
    return lines.where(F.col(column).rlike(pattern)).select(
        *rest, F.regexp_extract(column, pattern, 1).alias("path"), F.regexp_extract(column, pattern, 2).alias("key")
    )
