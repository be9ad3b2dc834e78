"""Prefix containment of paths under roots, as an equality join on ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurispark.functions.paths import ancestors


def exploded_ancestors(paths: DataFrame, path: str = "path") -> DataFrame:
    """Each row once per ancestor of its path (itself included), in ``ancestor``."""
    return paths.withColumn("ancestor", F.explode(ancestors(F.col(path))))


def root_form(root: Column) -> Column:
    """A root without trailing separators; the filesystem's root stays ``/``."""
    return F.when(F.startswith(root, F.lit("/")) & (F.rtrim(root, F.lit("/")) == ""), F.lit("/")).otherwise(F.rtrim(root, F.lit("/")))


def under_any_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The distinct paths equal to a root or below one (``root`` and ``path`` columns).

    Only whole components count, so ``/a/bc`` is not under ``/a/b``. A root may end with
    separators, and the root ``/`` holds every absolute path; it is met by a flag, not
    by a join key that all paths would share.
    """
    given = paths.select("path").distinct()
    asked = roots.select(root_form(F.col("root")).alias("ancestor")).distinct()
    held = exploded_ancestors(given).join(asked.where("ancestor <> '/'"), "ancestor", "left_semi").select("path")
    everything = asked.where("ancestor = '/'").select(F.lit(True).alias("_all"))  # one row at most
    absolute = given.where(F.startswith("path", F.lit("/"))).join(F.broadcast(everything), F.col("_all"), "left_semi")
    return held.union(absolute).distinct()
