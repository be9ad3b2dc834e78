"""Path expressions: composing, naming and typing artefact paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix (or whole name) to media type. Unknown stays empty.
MEDIA_TYPES = {
    ".toml": "application/toml",
    ".lock": "application/toml",
    ".yaml": "application/yaml",
    ".yml": "application/yaml",
    ".json": "application/json",
    ".md": "text/markdown",
    ".python-version": "text/plain",
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".fits": "image/fits",
    ".h5": "application/x-hdf5",
    ".hdf5": "application/x-hdf5",
    ".parquet": "application/vnd.apache.parquet",
    ".png": "image/png",
    ".pdf": "application/pdf",
}

MANIFEST_SUFFIX = ".manifest.json"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Everything before the last separator; empty when there is none."""
    cut = F.length(path) - F.length(base_name(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise(F.lit(""))


def media_type(path: Column) -> Column:
    """The media type of a path's suffix, else of its whole name, else empty."""
    name = base_name(path)
    # A leading or trailing dot makes no suffix.
    suffix = F.regexp_extract(name, r"(?s)[^.]\.*(\.[^.]+)\z", 1)
    key = F.when(suffix != "", suffix).otherwise(name)
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(""))


def artifact_path(root: Column, universe: Column, output: Column, fmt: Column) -> Column:
    return F.concat(root, F.lit("/results/"), universe, F.lit("/"), output, F.lit("."), fmt)


def artifact_path_error(universe: Column, output: Column, fmt: Column) -> Column:
    """Which part cannot be composed into a path: an error kind, or NULL when all can."""

    def component(c: Column) -> Column:
        return F.coalesce(c, F.lit("")).isin("", ".", "..") | c.rlike(r"[/\\]")

    return (
        F.when(component(universe), F.lit("universe"))
        .when(component(output), F.lit("output"))
        .when(F.contains(output, F.lit(".")), F.lit("dot"))
        .when((F.coalesce(fmt, F.lit("")) == "") | fmt.rlike(r"[/\\]|^\."), F.lit("format"))
    )


def sidecar_path(path: Column) -> Column:
    """The manifest beside an artefact, named up to the name's *first* dot."""
    name = base_name(path)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    stem = F.substring_index(name, ".", 1)
    return F.concat(folder, F.lit("."), stem, F.lit(MANIFEST_SUFFIX))


def declared_path(root: Column, path: Column) -> Column:
    """Relative to *root* when under it, unchanged otherwise; never resolved."""
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return (
        F.when(path == root, F.lit("."))
        .when(inside, F.substring(path, F.length(root) + 2, F.length(path)))
        .otherwise(path)
    )


def ancestors(path: Column) -> Column:
    """The path and each of its parent folders, longest first, as an array.

    The filesystem root is left out: no record is ever followed there.
    """
    parts = F.split(path, "/")
    lead = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")
    )
    return F.reverse(F.filter(lead, lambda p: p != ""))
