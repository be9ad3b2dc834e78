"""Exact length histogram: documents by encoded length, and suffix sums for every context limit.

Documents are aggregated by their number of token ids (null and empty texts: 0; repeated
rows count each). One row per occurring length answers, for that context limit, how many
documents fit and what they hold; between two occurring lengths all sums are linear,
so :func:`at_limits` answers any other limit from the same rows. The histogram is
bounded by the longest text, not by the number of documents; its running sums are taken
within blocks of lengths and over block totals, so no task sees all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurispark.llm.tokens import encoder

VOCABULARY = "byte_bpe_50k"
BLOCK = 1024


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``n_tokens`` of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            n = np.fromiter((len(encode(x.as_py())) for x in batch.column(0)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(n)})

    return docs.select(F.col(text).alias("_text")).mapInArrow(count, "n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """``n_tokens, n_docs`` per occurring length."""
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each occurring length taken as a context limit, from suffix sums over the lengths:

    ``docs_over`` and ``tokens_over`` (documents longer than the limit and their tokens),
    ``docs_total``, ``tokens_total``, ``tokens_truncated`` (tokens left when every
    document is cut at the limit) and ``quantile`` (share of documents that fit).
    """
    n, d = F.col("n_tokens"), F.col("n_docs")
    rows = hist.select(n, d, F.floor(n / BLOCK).alias("_block"), (n * d).alias("_t"))
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    later = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "_block", F.coalesce(F.sum("_bd").over(later), zero).alias("_ld"), F.coalesce(F.sum("_bt").over(later), zero).alias("_lt"),
        F.sum("_bd").over(everything).alias("docs_total"), F.sum("_bt").over(everything).alias("tokens_total"),
    )
    within = Window.partitionBy("_block").orderBy(n.desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = (F.coalesce(F.sum("n_docs").over(within), zero) + F.col("_ld")).alias("docs_over")
    held = (F.coalesce(F.sum("_t").over(within), zero) + F.col("_lt")).alias("tokens_over")
    out = rows.join(blocks, "_block").select("n_tokens", "n_docs", over, held, "docs_total", "tokens_total")
    return out.select(
        "*", (F.col("tokens_total") - F.col("tokens_over") + n * F.col("docs_over")).alias("tokens_truncated"),
        ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: DataFrame, limit: str = "limit") -> DataFrame:
    """Truncated totals for any limits, from the nearest occurring length not above each.

    Between occurring lengths every longer document gives one token per step of the limit.
    A limit below all lengths is answered from the shortest: all documents are cut at it.
    """
    nearest = limits.join(sums, sums["n_tokens"] <= limits[limit], "left").groupBy(limit).agg(
        F.max_by(F.struct("n_tokens", "docs_over", "tokens_truncated"), "n_tokens").alias("_at")
    )
    total = sums.agg(F.max("docs_total").alias("_docs"))
    step = F.col(limit) - F.col("_at.n_tokens")
    return nearest.join(F.broadcast(total)).select(
        limit, F.coalesce(F.col("_at.docs_over"), F.col("_docs")).alias("docs_over"),
        F.coalesce(F.col("_at.tokens_truncated") + step * F.col("_at.docs_over"), F.col("_docs") * F.col(limit)).alias("tokens_truncated"),
    )
