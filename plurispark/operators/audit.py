"""Auditing locked dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurispark.functions.records import pep503

#: Sources that record where a dependency was, not what was in it, as they are looked for.
UNPINNED = ("path", "directory", "editable")


def lock_audit(packages: DataFrame, projects: DataFrame) -> DataFrame:
    """``project_id, name, finding`` rows: ``refused:<kind>`` or ``sdist_built``.

    A package whose bytes the lock does not pin is refused, the project's own
    package (under any spelling) aside; a registry package without a wheel is
    built from source.
    """
    own = projects.select("project_id", F.col("name").alias("_own"))
    sources = F.col("source")
    kind = F.lit(None).cast("string")
    for name in reversed(UNPINNED):
        kind = F.when(F.map_contains_key(sources, name), F.lit(name)).otherwise(kind)
    rows = packages.join(own, "project_id").withColumn("_kind", kind)
    mine = pep503(F.col("name")) == pep503(F.coalesce("_own", F.lit("")))
    registry = F.map_contains_key(sources, "registry") & F.col("has_sdist") & (F.coalesce("n_wheels", F.lit(0)) == 0)
    finding = F.when(F.col("_kind").isNotNull(), F.when(~mine, F.concat(F.lit("refused:"), F.col("_kind")))).when(registry, F.lit("sdist_built"))
    return rows.select("project_id", "name", finding.alias("finding")).where("finding IS NOT NULL")


def non_default_groups(projects: DataFrame) -> DataFrame:
    """Dependency groups outside the default set, one row each; ``['all']`` leaves none.

    Projects that state no default have the one group ``dev``.
    """
    default = F.coalesce("default_groups", F.array(F.lit("dev")))
    extra = F.when(default == F.array(F.lit("all")), F.array().cast("array<string>")).otherwise(F.array_except("groups", default))
    return projects.select("project_id", F.explode(extra).alias("group"))
