"""What several operators of this package share: words, hashes and packed columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are neither a space nor one of the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offsets of each, without a copy where possible."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


#: Bytes of a hash that travel in packed columns; the part it travels to tells further bits.
WIDTH = 5


def narrow(values: np.ndarray) -> bytes:
    """The low WIDTH bytes of 64-bit hashes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.reshape(-1).view("<u8")


#: Bytes of text whose hashes are held at once.
SLICE = 1 << 20


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about SLICE bytes: number of the first, bytes and offsets.

    A text is never cut, so a task holds one slice or one very long text at a time.
    """
    data, offsets = text_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        end = max(int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1, at + 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the number of words before it.

    Words never cross texts: every text starts and ends its own words.
    """
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    starts = edge[:-1] & inside
    ends = edge.copy()
    ends[1:] &= inside
    ends[0] = False
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[cuts] = inside[cuts]
    stops = offsets[1:][offsets[:-1] < offsets[1:]]
    ends[stops] = inside[stops - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    return first, last, np.searchsorted(first, offsets)


def hash_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, one pass per byte position over the spans that long."""
    h = np.full(len(first), 0x51ED270B, np.uint64)
    length = last - first
    left = np.arange(len(first))
    k = 0
    while len(left):
        left = left[length[left] > k] if k else left[length > 0]
        if not len(left):
            break
        h[left] = h[left] * _STEP + _BYTE[data[first[left] + k]]
        k += 1
        if k >= 64 and len(left):  # the few very long spans, one by one
            import hashlib

            for i in left:
                h[i] = np.uint64(int.from_bytes(hashlib.blake2b(data[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little"))
            break
    return mix(h)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of *n* neighbouring hashes (they may cross texts; callers cut those)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g = g * _STEP + h[k : len(h) - n + 1 + k]
    return mix(g)
