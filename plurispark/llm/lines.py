"""Site-relative line frequency: lines that a large part of a host's pages carry are boilerplate.

Every page is split at line feeds. A line counts in normal form (white space at its
ends cut, A to Z lower-cased); lines without a word never count and always stay. Per host
the pages that contain a line are divided by all pages of the host, and lines at or
above ``ratio`` (and on ``min_pages`` pages at least) are cut from the text.

Defined cases: a null text is one page without lines and stays null; an empty text
stays empty; a null host is a host of its own; repeated rows are pages each; a page
that loses all lines keeps an empty text. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurispark.session import broadcast_if_small, stage

#: A template on a tenth of a host's pages is found below 5 % of 100 pages with a probability of 0.024, of 200 pages 0.004.
RATIO_PERCENT = 5
#: A line that chance puts on one page of a host is found on 5 with a probability of 0.004.
MIN_PAGES = 5
#: A side too large to broadcast is repeated this often so that a hot host's pages spread.
SALTS = 64
#: Lists in which the lines of a host are kept where their number has no bound.
BUCKETS = 64
_SPACE = " \t\r\x0b\x0c"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def line_hash(line: Column) -> Column:
    """A line's 64-bit hash in normal form; null when it has no word."""
    return F.nullif(F.xxhash64(normal(line)), F.xxhash64(F.lit("")))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def distinct_hashes(text: Column) -> Column:
    """The distinct line hashes of a text."""
    return F.array_compact(F.array_distinct(F.transform(lines_of(text), line_hash)))


def with_host_lines(docs: DataFrame, frequent: DataFrame, host: str, name: str, buckets: int = 0) -> DataFrame:
    """Add *name*, the array of the frequent lines of the row's host (null: none).

    *frequent* holds (``_host``, ``_line``). Where each is on a fixed share of the host's
    pages, a host has at most (mean lines a page) / share of them. Else *buckets* deals them
    to so many arrays by their hash, and *name* is the array of those.
    """
    per_host = frequent.groupBy("_host").agg(F.collect_set("_line").alias(name))
    if buckets:
        dealt = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.filter(name, lambda x: F.pmod(x, F.lit(buckets)) == b))
        per_host = per_host.withColumn(name, dealt)
    per_host = stage(per_host)
    small = broadcast_if_small(per_host)
    if small is not per_host:
        return docs.join(small, docs[host].eqNullSafe(F.col("_host")), "left").drop("_host")
    salted = docs.withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int"))
    copies = per_host.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        salted.join(copies, salted[host].eqNullSafe(F.col("_host")) & (F.col("_salt") == F.col("_salt_r")), "left")
        .drop("_host", "_salt", "_salt_r")
    )


def kept_lines(text: Column, drop: Column, buckets: int = 0) -> Column:
    """*text* without the lines whose hash is in the array *drop*."""
    held = lambda h: F.get(drop, F.pmod(h, F.lit(buckets)).cast("int")) if buckets else drop
    left = F.filter(lines_of(text), lambda x: ~F.coalesce(F.array_contains(held(line_hash(x)), line_hash(x)), F.lit(False)))
    return F.when(drop.isNull(), text).otherwise(F.array_join(left, "\n"))


def boilerplate(docs: DataFrame, text: str, host: str, ratio_percent: int, min_pages: int) -> DataFrame:
    """(``_host``, ``_line``) of the lines at or above the ratio."""
    slim = docs.select(F.col(host).alias("_host"), F.col(text).alias("_text"))
    pages = slim.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    counts = (
        slim.select("_host", F.explode(distinct_hashes(F.col("_text"))).alias("_line"))
        .groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_with"))
        .where(F.col("_with") >= min_pages)
    )
    pages = broadcast_if_small(pages.withColumnRenamed("_host", "_of"))
    return (
        counts.join(pages, F.col("_host").eqNullSafe(F.col("_of")))
        .where(F.col("_with") * 100 >= F.col("_pages") * ratio_percent)
        .select("_host", "_line")
    )


def line_dedup(
    docs: DataFrame, text: str = "text", host: str = "source", ratio_percent: int = RATIO_PERCENT, min_pages: int = MIN_PAGES
) -> DataFrame:
    """*docs* with boilerplate lines cut from *text*, and ``_n_lines`` and ``_n_cut``."""
    frequent = boilerplate(docs, text, host, ratio_percent, min_pages)
    found = with_host_lines(docs, frequent, host, "_drop")
    new = found.withColumn("_new", kept_lines(F.col(text), F.col("_drop")))
    count = lambda c: F.coalesce(F.size(lines_of(c)), F.lit(0)).cast("long")
    cut = F.when(F.col("_drop").isNull() | F.col(text).isNull(), F.lit(0)).otherwise(
        F.size(F.filter(lines_of(F.col(text)), lambda x: F.coalesce(F.array_contains("_drop", line_hash(x)), F.lit(False))))
    )
    n = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(count(F.col(text)))
    return (
        new.withColumn("_n_lines", n).withColumn("_n_cut", cut.cast("long"))
        .withColumn(text, F.col("_new")).drop("_new", "_drop")
    )
