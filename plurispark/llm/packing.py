"""Packing along a space-filling curve: similar documents share sequences.

Each document's hashed token vector is projected to ``DIMS`` dimensions, quantised and
turned into a Hilbert key. Documents are range-sorted by key and cut into sequences of
``SIZE`` tokens where they come to lie; only the last, open sequence of each range is
smaller, and it is cut at powers of two, which need no padding.

Defined cases: null and empty texts are one end id; repeated rows are packed each; a
null id is packed like any other. A hot key (a third of all rows being copies) is split by
document id in the range sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurispark.llm.common import shuffle_partitions
from plurispark.llm.tokens import DTYPE, encoder
from plurispark.session import stage

VOCABULARY = "byte_bpe_50k"
SIZE = 2048
END = 1
DIMS = 4
BITS = 15

_PROJECTION = np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (65536, DIMS))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (one row each, coordinates below ``2 ** bits``).

    Transposes each point to Gray-coded axes from the highest bit down (exchange or
    invert the low bits of the first axis) and interleaves the result's bits.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projected(ids: np.ndarray) -> np.ndarray:
    """A document's position in the cube: its projected vector, by direction."""
    v = _PROJECTION[ids].sum(0, dtype=np.int64).astype(np.float64)
    norm = np.sqrt((v * v).sum())
    unit = v / norm if norm else v
    return np.clip(((unit + 1) * (1 << (BITS - 1))).astype(np.int64), 0, (1 << BITS) - 1)


def encoded(docs: DataFrame, id: str, text: str, vocabulary: str) -> DataFrame:
    """(``_id``, ``_key``, ``_ids``) per row: ids end with END and are packed as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [np.append(encode(x.as_py()), np.array([END], DTYPE)).astype(DTYPE) for x in part.column(1)]
                keys = hilbert_keys(np.array([projected(x) for x in ids]))
                yield pa.RecordBatch.from_pydict(
                    {"_id": part.column(0), "_key": pa.array(keys), "_ids": pa.array([x.tobytes() for x in ids], pa.binary())}
                )

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, _key long, _ids binary")


class _Sequences:
    """Fills sequences of SIZE tokens; hands out pieces as their sequence becomes full."""

    def __init__(self, first: int):
        self.number, self.fill, self.open, self.done = first, 0, [], []

    def add(self, doc, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(SIZE - self.fill, len(ids) - at)
            self.open.append((doc, at, ids[at : at + take], len(ids), self.fill))
            self.fill += take
            at += take
            if self.fill == SIZE:
                self.close()

    def close(self) -> None:
        import zlib

        for doc, start, ids, total, offset in self.open:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.done.append((doc, start, len(ids), crc, total, self.number, offset))
        self.number, self.fill, self.open = self.number + 1, 0, []

    def finish(self) -> None:
        """Cut the open sequence at the powers of two of its length."""
        left, self.open = self.open, []
        total, self.fill = self.fill, 0
        sizes = [1 << b for b in range(SIZE.bit_length(), -1, -1) if total >> b & 1]
        for size in sizes:
            while self.fill < size:
                doc, start, ids, all_ids, _ = left.pop(0)
                take = min(size - self.fill, len(ids))
                self.open.append((doc, start, ids[:take], all_ids, self.fill))
                self.fill += take
                if take < len(ids):
                    left.insert(0, (doc, start + take, ids[take:], all_ids, 0))
            self.close()

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


_PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    work, kind = _Sequences(TaskContext.get().partitionId() << 40), None

    def rows(pieces):
        columns = list(zip(*pieces)) or [()] * (len(_PIECE) + 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["_id", *_PIECE]
        )

    for batch in batches:
        kind = batch.schema.field("_id").type
        for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            work.add(doc, np.frombuffer(ids.as_py(), DTYPE))
        yield rows(work.take())
    if kind is not None:
        work.finish()
        yield rows(work.take())


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids grow along the curve; they are unique but not dense.
    """
    kind = docs.schema[id].dataType.simpleString()
    ready = stage(encoded(docs, id, text, vocabulary))
    parts = shuffle_partitions(docs.sparkSession)
    placed = ready.repartitionByRange(parts, "_key", "_id").sortWithinPartitions("_key", "_id").select("_id", "_ids")
    fields = ", ".join(f"{c} long" for c in _PIECE)
    return placed.mapInArrow(_packed, f"_id {kind}, {fields}").withColumnRenamed("_id", id)
