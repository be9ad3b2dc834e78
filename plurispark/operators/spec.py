"""From a spec and its universes to tasks, inputs and targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurispark.functions.paths import artifact_path

KEY = ["universe_id", "output_id"]


def expand_tasks(universes: DataFrame, outputs: DataFrame, on: Sequence[str]) -> DataFrame:
    """One task per universe and executable output of the same project.

    *on* names the project columns both sides share. An output takes part when
    it is active and has a command; each task keeps only the decisions its
    output declares. The universe's decisions travel as one map per row.
    """
    executable = outputs.where(F.col("active") & F.col("command").isNotNull())
    declared = F.map_filter(
        F.col("_chosen"), lambda k, v: F.array_contains(F.col("decisions"), k)
    )
    chosen = universes.select(*on, "universe_id", F.col("decisions").alias("_chosen"))
    return (
        executable.join(chosen, list(on))
        .withColumn("decisions", declared)
        .drop("_chosen")
    )


def resolve_inputs(
    tasks: DataFrame, spec_inputs: DataFrame, root: str, on: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``(task_inputs, unresolved)`` of tasks carrying ``inputs array<string>`` and ``format``.

    An input is another task's output in the same universe, else a declared
    source; one that is neither is unresolved. An absolute source wins over *root*.
    """
    keys = [*on, "universe_id"]
    declared = tasks.select(*keys, "output_id", F.posexplode("inputs").alias("ord", "input_name"))
    made = tasks.select(
        *keys, F.col("output_id").alias("input_name"), F.col("output_id").alias("produced_by"),
        artifact_path(F.lit(root), F.col("universe_id"), F.col("output_id"), F.col("format")).alias("_made"),
    )
    sources = spec_inputs.select(*on, F.col("input_id").alias("input_name"), "source")
    source = F.when(F.startswith("source", F.lit("/")), F.col("source")).otherwise(
        F.concat(F.lit(f"{root}/"), F.col("source"))
    )
    found = declared.join(made, [*keys, "input_name"], "left").join(sources, [*on, "input_name"], "left")
    resolved = found.select(
        *keys, "output_id", "input_name", "ord", F.coalesce("_made", source).alias("path"), "produced_by"
    )
    return resolved.where("path IS NOT NULL"), resolved.where("path IS NULL").select(*keys, "output_id", "input_name")


def split_target(target: Column) -> tuple[Column, Column]:
    """A typed target as (universe or empty, output), cut at the last separator."""
    output = F.substring_index(target, "/", -1)
    rest = F.length(target) - F.length(output) - 1
    return F.when(rest > 0, F.substring(target, F.lit(1), rest)).otherwise(F.lit("")), output


def resolve_targets(tasks: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(matched, unmatched)`` of ``pos, target`` rows.

    A bare id matches every universe that has it, ``universe/id`` exactly one.
    Matches carry ``pos``, the order the targets were given in.
    """
    universe, output = split_target(F.col("target"))
    asked = targets.select("pos", "target", universe.alias("_u"), output.alias("output_id"))
    hits = tasks.select(*KEY).join(asked, "output_id").where(
        (F.col("_u") == "") | (F.col("_u") == F.col("universe_id"))
    )
    matched = hits.select("pos", "target", *KEY)
    return matched, targets.join(matched.select("pos").distinct(), "pos", "left_anti")


def duplicate_universes(universes: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Every file that claims a universe id which other files claim too, and how many claim it."""
    key = [*on, "universe_id"]
    claimed = universes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return universes.join(claimed, key).select(*key, "source_file", "n")


def missing_formats(outputs: DataFrame) -> DataFrame:
    """Every executable output without a format: there is nowhere to write it."""
    return outputs.where(
        F.col("active") & F.col("command").isNotNull() & (F.coalesce("format", F.lit("")) == "")
    ).select("output_id")


def unknown_keys(given: Column, allowed: Sequence[str]) -> Column:
    """The keys of a map outside the allowed set, sorted."""
    return F.array_sort(F.array_except(F.map_keys(given), F.array(*[F.lit(a) for a in allowed])))


def declared_diff(declared: Column, recorded: Column) -> Column:
    """The symmetric difference of two name arrays, sorted."""
    return F.array_sort(F.array_union(F.array_except(declared, recorded), F.array_except(recorded, declared)))


def declared_diff_rows(declared: DataFrame, recorded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows on one side only, with ``side``: the table form, for any number of names."""
    a, b = declared.select(*columns).distinct(), recorded.select(*columns).distinct()
    return (
        a.withColumn("side", F.lit("declared")).unionByName(b.withColumn("side", F.lit("recorded")))
        .groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"), F.min("side").alias("side"))
        .where("_n = 1").drop("_n")
    )
