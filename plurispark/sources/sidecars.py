"""Manifests beside the outputs they describe.

Sidecars are hidden files, which Spark's own file readers never list; a Python
data source reads them. Folders are listed on the driver one level deep only;
each reading task lists and reads its own share of them. Paths may be local or
any address a shared file system of :mod:`pyarrow.fs` understands.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plurispark.functions.paths import MANIFEST_SUFFIX
from plurispark.schemas import MANIFESTS

# The helpers below run inside tasks: send them along, so that workers which do
# not have this package on their path can run them, too.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Folders per reading task.
FOLDERS_PER_TASK = 64


def _open(root: str):
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


class _Folders(InputPartition):
    def __init__(self, folders: list[str], recursive: bool):
        self.folders, self.recursive = folders, recursive


class _FilesReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.suffix = options.get("suffix", "")
        self.prefix = options.get("prefix", "")

    def partitions(self):
        from pyarrow import fs

        system, path = _open(self.root)
        here = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        folders = sorted(i.path for i in here if i.type == fs.FileType.Directory)
        shares = [folders[i:i + FOLDERS_PER_TASK] for i in range(0, len(folders), FOLDERS_PER_TASK)]
        return [_Folders([path], False), *[_Folders(s, True) for s in shares]]

    def read(self, partition):
        from pyarrow import fs

        system, _ = _open(self.root)
        for folder in partition.folders:
            found = system.get_file_info(
                fs.FileSelector(folder, recursive=partition.recursive, allow_not_found=True)
            )
            for info in found:
                if info.type != fs.FileType.File or not info.base_name.startswith(self.prefix) or not info.base_name.endswith(self.suffix):
                    continue
                with system.open_input_stream(info.path) as stream:
                    yield info.path, info.size, stream.read()


class AllFiles(DataSource):
    """``path, length, content`` of every file below a folder, optionally by first and last characters of the name.

    Spark's own readers pass over names and folders that start with ``.`` or ``_``; this one lists them all.
    """

    @classmethod
    def name(cls):
        return "allfiles"

    def schema(self):
        return "path string, length bigint, content binary"

    def reader(self, schema):
        return _FilesReader(self.options)


def all_files(spark: SparkSession, root: str, prefix: str = "", suffix: str = "") -> DataFrame:
    spark.dataSource.register(AllFiles)
    return spark.read.format("allfiles").option("prefix", prefix).option("suffix", suffix).load(root)


#: The keys a manifest must carry; the others have defaults.
REQUIRED = (
    "output_id", "universe_id", "recipe", "definition_version", "env_version", "data_version", "decisions",
    "input_versions", "git_sha", "git_remote", "lc_version", "hermeticity",
)


def parse_manifests(texts: DataFrame, column: str = "text") -> DataFrame:
    """Manifest columns of JSON texts; anything that is not a manifest object gives no row.

    Unknown keys are dropped and optional ones defaulted: what cannot be read is
    "no manifest", the safe direction.
    """
    parsed = F.from_json(F.col(column), f"{MANIFESTS}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    keys = F.json_object_keys(column)
    complete = F.forall(F.array(*[F.lit(k) for k in REQUIRED]), lambda k: F.array_contains(keys, k))
    rest = [c for c in texts.columns if c != column]
    rows = texts.where(F.try_validate_utf8(column).isNotNull() & F.coalesce(complete, F.lit(False)))
    read = rows.select(*rest, parsed.alias("_m")).where(F.col("_m").isNotNull() & F.col("_m._bad").isNull())
    return read.select(*rest, "_m.*").drop("_bad").fillna("", subset=["started_at", "finished_at", "uv_version"])


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Every readable manifest below ``<root>/results``, with the sidecar's ``path``."""
    files = all_files(spark, f"{root.rstrip('/')}/results", ".", MANIFEST_SUFFIX)
    return parse_manifests(files.select("path", F.col("content").cast("string").alias("text")))


def _place(system, path: str, data: bytes) -> None:
    """Write whole or not at all: a temporary beside the target, then a rename."""
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"  # a retried or speculative task writes a file of its own
    with system.open_output_stream(temporary) as stream:
        stream.write(data)
    system.move(temporary, path)


def write_manifests(manifests: DataFrame, root: str) -> None:
    """Export manifests as sidecars, one small file each, from the tasks that hold them."""
    order = [f.split()[0] for f in _fields(MANIFESTS)]
    known = [c for c in order if c in manifests.columns]
    text = F.to_json(F.struct(*known), {"ignoreNullFields": "false"})
    base = root.rstrip("/")

    def write(rows: Iterable) -> None:
        system, path = _open(base)
        for row in rows:
            pretty = json.dumps(json.loads(row["text"]), indent=2) + "\n"
            _place(system, f"{path}/results/{row['universe_id']}/.{row['output_id']}{MANIFEST_SUFFIX}", pretty.encode())

    manifests.select("universe_id", "output_id", text.alias("text")).foreachPartition(write)


def _fields(ddl: str) -> list[str]:
    """The top-level fields of a DDL text."""
    fields, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            fields.append(ddl[start:i].strip())
            start = i + 1
    return [*fields, ddl[start:].strip()]


def write_artifacts(outputs: DataFrame, root: str) -> None:
    """Place outputs given as bytes: exactly one file per output, earlier formats removed.

    *outputs* has ``universe_id, output_id, format, content``. Only
    ``<output_id>.*`` of the same folder is removed; siblings stay.
    """
    base = root.rstrip("/")

    def write(rows: Iterable) -> None:
        from pyarrow import fs

        system, path = _open(base)
        for row in rows:
            folder = f"{path}/results/{row['universe_id']}"
            target = f"{folder}/{row['output_id']}.{row['format']}"
            _place(system, target, bytes(row["content"]))
            for info in system.get_file_info(fs.FileSelector(folder)):
                mine = info.base_name.startswith(f"{row['output_id']}.") and info.type == fs.FileType.File
                if mine and info.path != target:
                    system.delete_file(info.path)

    outputs.select("universe_id", "output_id", "format", F.col("content").cast("binary").alias("content")).foreachPartition(write)
