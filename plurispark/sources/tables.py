"""Files as tables, and result tables by universe and output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plurispark.sources.sidecars import all_files


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, content`` of every file below *root*, whatever its name or its folder's."""
    return all_files(spark, root)


def sink_results(df: DataFrame, root: str, format: str = "parquet") -> None:
    """Replace the results of the outputs in *df*, and of no others.

    Rows carry ``universe_id`` and ``output_id``, which become the folders;
    only the partitions that occur in *df* are overwritten.
    """
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("universe_id", "output_id").format(format).save(f"{root.rstrip('/')}/results")
    )


def write_manifest_table(manifests: DataFrame, path: str) -> None:
    """The primary store of manifests: a table partitioned by universe."""
    manifests.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("universe_id").parquet(path)
