"""Quality rules: properties of each text, and lines that too many documents of a host share.

Words are runs of characters other than space and the controls 9 to 13. The base
rules look at one text. The cross-document rule hashes normalised lines, counts per
host the distinct documents (distinct texts: an exact copy counts once) that contain
each, removes lines above the limit, and rejects documents left with less than
``MIN_LEFT_PERCENT`` of their words.

Defined cases: null and empty texts have no words and fail the base rules; a null host
is a host of its own; repeated rows are judged each and count once for the lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurispark.llm import lines
from plurispark.llm.common import hash_spans, slices, words_of, windows
from plurispark.session import broadcast_if_small

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: A line is above the limit when so many distinct documents of its host have it: quotes and near
#: copies that put a line on 15 of them reach 30 by chance with a probability of 0.0004.
LIMIT_DOCS = 30
#: A share of the host's distinct documents to ask for besides; the share of pages is op10's rule.
LIMIT_PERCENT = 0
MIN_LEFT_PERCENT = 50

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _repeated_words(h: np.ndarray, first: int, last: int) -> int:
    """Words in windows of REPEAT_WINDOW words that occur twice or more between two word numbers."""
    g = windows(h[first:last], REPEAT_WINDOW)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(g), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    steps = np.zeros(last - first + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + REPEAT_WINDOW, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of a slice."""
    first, last, before = words_of(data, offsets)
    h = hash_spans(data, first, last)
    in_word = (data & 0xC0) != 0x80
    in_word &= (data != 32) & ((data < 9) | (data > 13))
    chars = np.concatenate(([0], np.cumsum(in_word, dtype=np.int64)))
    marks = np.concatenate(([0], np.cumsum(_SYMBOLS[data], dtype=np.int64)))
    n = len(offsets) - 1
    dup_lines, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
    feed_at = np.searchsorted(np.flatnonzero(data == 10), offsets)
    blank = b" \t\r\x0b\x0c"
    for i in range(n):
        a, b = int(before[i]), int(before[i + 1])
        if b - a > REPEAT_WINDOW:
            repeats[i] = _repeated_words(h, a, b)
        if feed_at[i + 1] > feed_at[i]:
            seen: set[bytes] = set()
            for line in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n"):
                if line.strip(blank):
                    dup_lines[i] += line in seen
                    seen.add(line)
    return {
        "n_words": np.diff(before), "word_chars": chars[offsets[1:]] - chars[offsets[:-1]],
        "n_symbols": marks[offsets[1:]] - marks[offsets[:-1]], "n_dup_lines": dup_lines, "n_repeat_words": repeats,
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(data, offsets) for _, data, offsets in slices(batch.column("_text"))]
        left = [np.diff(words_of(data, offsets)[2]) for _, data, offsets in slices(batch.column("_left"))]
        whole = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_pydict(
            {k: batch.column(k) for k in batch.schema.names if k != "_text"}
            | {m: whole([f[m] for f in found]) for m in MEASURES} | {"_words_left": whole(left)})


def frequent_lines(docs: DataFrame, text: str, host: str, limit_percent: int, limit_docs: int) -> DataFrame:
    """(``_host``, ``_line``) of the lines above the limit, over distinct texts."""
    slim = docs.select(F.col(host).alias("_host"), F.col(text).alias("_text"), F.xxhash64(text).alias("_copy"))
    totals = slim.select("_host", "_copy").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    counts = (
        slim.select("_host", "_copy", F.explode(lines.distinct_hashes(F.col("_text"))).alias("_line")).distinct()
        .groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_with")).where(F.col("_with") >= limit_docs)
    )
    totals = broadcast_if_small(totals.withColumnRenamed("_host", "_of"))
    return (
        counts.join(totals, F.col("_host").eqNullSafe(F.col("_of")))
        .where(F.col("_with") * 100 >= F.col("_docs") * limit_percent).select("_host", "_line")
    )


def quality_rules(
    docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source",
    limit_percent: int = LIMIT_PERCENT, limit_docs: int = LIMIT_DOCS, carry: Sequence[str] = (),
) -> DataFrame:
    """Per row: the id, the measures, ``base_failed``, ``kept``, ``n_words_left``, ``text_left`` and the columns to *carry*."""
    frequent = frequent_lines(docs, text, host, limit_percent, limit_docs)
    carried = [F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)]
    slim = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.col(host).alias("_host_of"), *carried)
    found = lines.with_host_lines(slim, frequent, "_host_of", "_drop", lines.BUCKETS)
    through = [f"_carry{i}" for i in range(len(carry))]
    judged = found.select("_id", *through, "_text", lines.kept_lines(F.col("_text"), F.col("_drop"), lines.BUCKETS).alias("_left"))
    fields = ", ".join(f"{m} long" for m in MEASURES)
    kind = docs.schema[id].dataType.simpleString()
    kinds = "".join(f"_carry{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry))
    out = judged.mapInArrow(_measured, f"_id {kind}, {kinds}_left string, {fields}, _words_left long")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    depleted = F.col("_words_left") * 100 < F.col("n_words") * MIN_LEFT_PERCENT
    return out.select(
        F.col("_id").alias(id), *MEASURES, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        F.col("_words_left").alias("n_words_left"), F.col("_left").alias("text_left"), *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)],
    )
