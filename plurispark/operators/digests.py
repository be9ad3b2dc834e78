"""Content identity of files and folders at table scale."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurispark.functions.hashing import file_digest
from plurispark.functions.records import is_pointer
from plurispark.session import small


def file_digests(files: DataFrame) -> DataFrame:
    """``path, data_version`` of ``path, content`` rows; an unfetched file has no identity."""
    fetched = ~is_pointer(F.col("content"), F.octet_length("content"))
    return files.select("path", F.when(fetched, file_digest(F.col("content"))).alias("data_version"))


#: Files are hashed in pieces of this size, so that no batch holds many whole files.
PIECE_BYTES = 1 << 20


def tree_digest(files: DataFrame) -> DataFrame:
    """A folder's identity from ``dir, path, content`` rows, as ``dir, data_version``.

    Paths are relative to the folder and are fed in beside the bytes in sorted
    order, so a rename moves the digest. The digest is one SHA-256 over that
    stream, sequential by definition; so each folder's rows are streamed in order
    (sorted and spilled by Spark, cut into pieces) through one running hash, and
    no folder is ever held in memory. A folder with an unfetched file has none.
    """
    content = F.col("content").cast("binary")
    pieces = files.select(
        "dir", "path", is_pointer(content, F.octet_length(content)).alias("unfetched"),
        F.octet_length(content).alias("size"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(content) / F.lit(PIECE_BYTES)) - 1, F.lit(0)))).alias("piece"),
        content.alias("content"),
    ).select(
        "dir", "path", "unfetched", "size", "piece",
        F.substring(F.col("content"), (F.col("piece") * PIECE_BYTES + 1).cast("int"), F.lit(PIECE_BYTES)).alias("data"),
    )
    ordered = pieces.repartition("dir").sortWithinPartitions("dir", "path", "piece")

    def fold(batches):
        folder, running, known = None, None, True
        done: list[tuple[str, str | None]] = []

        def close():
            if running is not None:
                done.append((folder, f"sha256:{running.hexdigest()}" if known else None))

        end = b""
        for batch in batches:
            for d, path, unfetched, size, piece, data in batch.itertuples(index=False, name=None):
                if running is None or d != folder:
                    if running is not None:
                        running.update(end)
                    close()
                    folder, running, known, end = d, hashlib.sha256(b"dir:"), True, b""
                if piece == 0:
                    running.update(end + b"path:" + path.encode() + b"\0data:")
                    end = b"\0"
                running.update(data)
                known = known and not unfetched
            if done:
                yield pd.DataFrame(done, columns=["dir", "data_version"])
                done = []
        if running is not None:
            running.update(end)
        close()
        if done:
            yield pd.DataFrame(done, columns=["dir", "data_version"])

    return ordered.mapInPandas(fold, "dir string, data_version string")


def distinct_input_digests(task_inputs: DataFrame, files: DataFrame) -> DataFrame:
    """Fill in each task input's current version, hashing every shared file once.

    Bytes are hashed where they are read and never shuffled: unneeded files are
    skipped when the list of needed paths is small enough to send everywhere,
    and hashed along otherwise.
    """
    needed = task_inputs.select("path").distinct()
    if small(needed):
        files = files.join(F.broadcast(needed), "path", "left_semi")
    versions = file_digests(files).withColumnRenamed("data_version", "current_version")
    return task_inputs.join(versions, "path", "left")
